"""The report for people, in Markdown."""

from __future__ import annotations

import re

_SOURCE = {"ok": "done", "crashed": "crashed", "missing": "no result", "invalid": "invalid", "n/a": "-"}


def cell(x) -> str:
    return re.sub(r"\s*\n\s*", " ", str(x if x is not None else "").replace("|", "\\|"))


def place(finding: dict) -> str:
    first, *rest = finding["locations"]
    return first["file"] + (f":{first['line']}" if first.get("line") else "") + (f" and {len(rest)} more" if rest else "")


def render_report(report: dict) -> str:
    s = report["summary"]
    out = [f"# Consistency report: {report['run_id']}", "", f"**{report['outcome']}**: {s['block']} block, {s['warn']} warn, {s['info']} info", ""]
    out += [f"{s['axes_expected']} axes, {s['axes_skipped']} of them skipped with a reason; {s['coverage_blocks']} coverage blocks.", ""]
    if report["scan"]["status"] != "ok":
        out += [f"> scan: {report['scan']['reason']}", ""]
    out += ["## Axes", "", "| axis | kind | state | script | verdict | findings |", "|" + "---|" * 6]
    for name, a in report["axes"].items():
        state = f"skipped: {a['reason']}" if a["state"] == "skipped" else "active"
        out.append(f"| `{name}` | {cell(a['kind'])} | {cell(state)} | {_SOURCE[a['script']]} | {_SOURCE[a['contract']]} | {a['findings']} |")
    why = [f"- `{n}`: {a[k]}" for n, a in report["axes"].items() for k in ("script_reason", "contract_reason") if a.get(k)]
    if why:
        out += ["", "### Without a result", "", *why]
    out += ["", "## Findings", ""]
    if report["findings"]:
        out += ["| severity | code | place | finding | found by |", "|" + "---|" * 5]
        # they come in order: the severest first, then by code
        out += [f"| {f['severity']} | `{f['code']}` | {cell(place(f))} | {cell(f['message'])} | {', '.join(f['found_by'])} |" for f in report["findings"]]
    else:
        out.append("None.")
    marks = [f"- `{n}`: {a['stripped_self_reports']}" for n, a in report["axes"].items() if a["stripped_self_reports"]]
    if marks:
        out += ["", "## Findings that had marked themselves down", "", *marks]
    if report["waivers"]:
        out += ["", "## Waived", "", *[f"- `{w['code']}`: {w['applied']}" for w in report["waivers"]]]
    return "\n".join(out) + "\n"
