"""The deterministic stage: every active axis over one parse of the corpus, then a gate.

A broken axis is recorded and the others go on. Axes with a contract wait for an
outside verdict, unless their own script broke.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from plumbline.context import RunContext
from plumbline.findings import SEVERITIES, cap_severity, validate_scan_result
from plumbline.operators.markdown import parsed
from plumbline.registry import Axis, load_axes
from plumbline.sources.corpus import Corpus, load_corpus

RUN_ID = re.compile(r"[0-9A-Za-z][-.0-9A-Z_a-z]*\Z")
TAIL = 500


class ScanError(ValueError):
    pass


def run_paths(out: str, run_id: Any) -> dict[str, str]:
    if not isinstance(run_id, str) or not RUN_ID.match(run_id):
        raise ScanError(f"run id {run_id!r} can't be part of a path")
    at = os.path.join(out, run_id)
    return {"run_dir": at, "scan": os.path.join(at, "scan.json"), "verdicts": os.path.join(at, "verdicts"), "candidates": os.path.join(at, "candidates"), "report_json": os.path.join(at, "report.json"), "report_md": os.path.join(at, "report.md")}


def count_severities(findings: list[dict]) -> dict[str, int]:
    return {s: sum(f["severity"] == s for f in findings) for s in SEVERITIES}


def _none(status: str, reason: str, skipped: bool = False) -> dict:
    stats = {"files_scanned": 0, "excluded": [], "skipped": skipped} | ({"skip_reason": reason} if skipped else {})
    return dict(status=status, reason=reason, findings=[], candidates=[], stats=stats)


def run_one(axis: Axis, produce: Callable[[], dict]) -> dict:
    """An axis' entry; whatever breaks its contract counts as broken."""
    try:
        raw = produce()
    except Exception as e:
        text = f"{type(e).__name__}: {e}".strip()
        return _none("crashed", "the axis failed: " + (text if len(text) <= TAIL else "…" + text[-TAIL:]))
    if problems := validate_scan_result(raw):
        return _none("crashed", "the axis broke its contract: " + "; ".join(problems)[:TAIL])
    if raw["axis"] != axis.name:
        return _none("crashed", f"the result is of axis {raw['axis']}, not {axis.name}")
    if any(f["code"].startswith("coverage.") for f in raw["findings"]):
        return _none("crashed", "the axis claimed a coverage.* code, which is the merge's")
    findings = [f | {"severity": cap_severity(f["severity"], axis.severity_cap)} for f in raw["findings"]]
    return {"status": "ok", "findings": findings, "candidates": raw.get("candidates") or [], "stats": raw["stats"]}


def run_scan(spark: SparkSession, context: RunContext, run_id: str, out: str | None = None, only: list[str] | None = None, axes: list[Axis] | None = None, corpus: Corpus | None = None, write: bool = True) -> tuple[dict, dict, list[Axis]]:
    """(scan, paths, axes). The corpus is parsed once and kept for all axes."""
    axes = load_axes(context.config, only) if axes is None else axes
    paths = run_paths(os.path.join(context.repo_root, out) if out else context.out_dir, run_id)
    if write:
        for d in ("verdicts", "candidates"):
            os.makedirs(paths[d], exist_ok=True)
    docs = None
    if any(a.state == "active" and a.run for a in axes):
        corpus = load_corpus(spark, context) if corpus is None else corpus
        docs = parsed(corpus.documents).persist()
    entries: dict[str, dict] = {}
    waiting = []
    for axis in axes:
        base = {"kind": axis.kind, "title": axis.title, "severity_cap": axis.severity_cap}
        if axis.state == "skipped":
            entries[axis.name] = base | _none("skipped", axis.reason, True)
            continue
        ran = None
        if axis.script:
            def produce(axis: Axis = axis) -> dict:
                got = axis.run(context, corpus, docs)
                return got if isinstance(got, dict) else got.collect()

            ran = run_one(axis, produce)
            entries[axis.name] = base | ran
        if not axis.contract or (ran and ran["status"] != "ok"):
            continue
        file = os.path.join(paths["candidates"], f"{axis.name}.json") if ran else None
        if write and file:
            with open(file, "w", encoding="utf-8") as f:
                json.dump(ran["candidates"], f, ensure_ascii=False, indent=2)
        waiting.append({"axis": axis.name, "kind": axis.kind, "title": axis.title, "contract": axis.contract, "candidates_file": file, "candidates": len(ran["candidates"]) if ran else None, "verdict_file": os.path.join(paths["verdicts"], f"{axis.name}.json")})
    if docs is not None:
        docs.unpersist()
    findings = [f for e in entries.values() for f in e["findings"]]
    states = [e["status"] for e in entries.values()]
    summary = count_severities(findings) | {"findings": len(findings), **{s: states.count(s) for s in ("ok", "crashed", "skipped")}, "awaiting": len(waiting)}
    scan = {"run_id": run_id, "config": context.config_path, "repo": context.repo_root, "run_dir": paths["run_dir"], "axes": entries, "awaiting_verdicts": waiting, "summary": summary}
    if write:
        with open(paths["scan"], "w", encoding="utf-8") as f:
            json.dump(scan, f, ensure_ascii=False, indent=2)
    return scan, paths, axes


def gate_blocked(scan: dict) -> bool:
    """Whether verdicts need not be asked for yet."""
    return scan["summary"]["block"] > 0 or scan["summary"]["crashed"] > 0
