import json
import os
import re

import pytest

from plumbline import findings as E
from plumbline.context import context_of
from plumbline.plans.merge import MergeError, as_frame, normalize_waivers, read_verdict, run_merge, strip_self_report
from plumbline.plans.scan import ScanError, gate_blocked, run_paths, run_scan
from plumbline.registry import Axis, resolve_axes


def finding(axis="links", severity="warn", code=None, file="a.md", line=1, more=(), **rest):
    places = [{"file": file} | ({"line": line} if line else {}), *[{"file": f, "line": n} for f, n in more]]
    return {"axis": axis, "severity": severity, "code": code or f"{axis}.x", "message": f"by {axis}", "locations": places, **rest}


def test_validation_finds_all():
    assert E.validate_finding(finding()) == []
    bad = {"axis": "X", "severity": "bad", "code": "a", "message": "", "locations": [{"file": "", "line": 0, "quote": 1, "z": 1}, 3], "payload": [], "found_by": [1], "extra": 1}
    assert len(E.validate_finding(bad)) == 12
    assert E.validate_finding(finding(code="other.x")) and not E.validate_finding(finding(code="other.x"), ("other",)) and not E.validate_finding(finding(code="coverage.x"))
    assert E.validate_finding(3) and E.validate_finding(finding(line=True))


def test_constructors():
    assert E.create_finding("links", "block", "links.x", "m", [{"file": "a"}], severity_cap="warn")["severity"] == "warn"
    for call in (lambda: E.create_finding("links", "odd", "links.x", "m", []), lambda: E.create_skipped_scan_result("links", ""), lambda: E.create_scan_result("links", [finding("numbers")])):
        with pytest.raises(E.FindingError):
            call()
    r = E.create_skipped_scan_result("links", "why")
    assert r["stats"] == {"files_scanned": 0, "excluded": [], "skipped": True, "skip_reason": "why"} and E.validate_scan_result(r) == []
    assert len(E.validate_scan_result({"axis": "a", "findings": [], "candidates": 1, "stats": {"files_scanned": -1, "excluded": [{"path": 1, "reason": ""}], "skipped": 0}, "z": 1})) == 6
    assert [E.cap_severity(s, c) for s, c in (("block", "info"), ("info", "block"), ("warn", None))] == ["info", "info", "warn"]


def test_fold(spark):
    rows = [finding("links", "warn", "links.x", more=[("b.md", 2)], payload={"p": 1}), finding("numbers", "block", "links.x", more=[("b.md", 2), ("c.md", 3), ("a.md", 1)]), finding("links", "info", "links.x"), finding("links", line=None), finding("numbers", "block", "coverage.missing"), finding("numbers", "block", "coverage.missing")]
    got = {(x.code, x.locations[0].line): x for x in E.fold(as_frame(spark, rows)).where("code <> 'coverage.missing'").collect()}
    one = got["links.x", 1]
    assert one.found_by == ["links", "numbers"] and one.severity == "block" and one.message == "by links" and json.loads(one.payload) == {"p": 1}
    assert [(p.file, p.line) for p in one.locations] == [("a.md", 1), ("b.md", 2), ("c.md", 3)]
    assert len(got) == 2 and E.fold(as_frame(spark, rows)).count() == 4


KIT = [Axis("alpha", "A", "script", script="a", severity_cap="block"), Axis("beta", "B", "hybrid", script="b", contract="b.md", severity_cap="warn"), Axis("gamma", "C", "judgment", contract="c.md"), Axis("delta", "D", "hybrid", ("missing",), script="d", contract="d.md")]


@pytest.fixture()
def kit(spark, tmp_path):
    context = context_of(dict(docs=dict(root="docs"), out="out"), str(tmp_path))

    def scan(run_id="r", results=None, **more):
        from dataclasses import replace

        results = results or {}
        def one(name):
            def run(*_):
                x = results.get(name, [])
                if isinstance(x, Exception):
                    raise x
                return x if isinstance(x, dict) else E.create_scan_result(name, x, [{"k": 1}])

            return run

        axes = resolve_axes([replace(a, run=one(a.name)) if a.script else a for a in KIT], context.config, more.pop("only", None))
        from plumbline.sources.corpus import corpus_of

        corpus = corpus_of(spark.createDataFrame([("a.md", "x")], "path string, text string"), context.config)
        return run_scan(spark, context, run_id, axes=axes, corpus=corpus, **more)

    def verdict(name, rows, run_id="r"):
        at = os.path.join(context.out_dir, run_id, "verdicts")
        os.makedirs(at, exist_ok=True)
        with open(os.path.join(at, f"{name}.json"), "w") as f:
            f.write(rows if isinstance(rows, str) else json.dumps(rows))

    def merge(run_id="r", only=None, **more):
        return run_merge(spark, context, run_id, axes=resolve_axes(KIT, context.config, only), **more)[0]

    return scan, verdict, merge, context


def test_scan(kit):
    scan, _, _, context = kit
    s, paths, _ = scan(results={"alpha": [finding("alpha")], "beta": [finding("beta", "block")]})
    assert {n: e["status"] for n, e in s["axes"].items()} == {"alpha": "ok", "beta": "ok", "gamma": None, "delta": "skipped"} | ({} if "gamma" in s["axes"] else {}) or "gamma" not in s["axes"]
    assert s["axes"]["beta"]["findings"][0]["severity"] == "warn" and s["summary"]["block"] == 0 and not gate_blocked(s)
    assert [(a["axis"], a["candidates"]) for a in s["awaiting_verdicts"]] == [("beta", 1), ("gamma", None)]
    assert json.load(open(paths["scan"]))["run_id"] == "r" and json.load(open(s["awaiting_verdicts"][0]["candidates_file"])) == [{"k": 1}]
    s, _, _ = scan("r2", {"alpha": RuntimeError("boom " * 400), "beta": {"axis": "beta", "findings": []}})
    assert s["axes"]["alpha"]["status"] == "crashed" and len(s["axes"]["alpha"]["reason"]) < 540 and gate_blocked(s)
    assert s["axes"]["beta"]["status"] == "crashed" and [a["axis"] for a in s["awaiting_verdicts"]] == ["gamma"]
    s, _, _ = scan("r3", {"alpha": E.create_scan_result("alpha", [finding("alpha", code="coverage.missing")])})
    assert "coverage" in s["axes"]["alpha"]["reason"]
    with pytest.raises(ScanError):
        run_paths("x", "../y")


def test_coverage(kit):
    scan, verdict, merge, _ = kit
    scan(results={"alpha": RuntimeError("x")})
    verdict("beta", "not json")
    verdict("alpha", [])
    verdict("delta", [])
    verdict("stranger", [])
    r = merge()
    got = sorted((f["code"], f["axis"]) for f in r["findings"])
    assert got == [("coverage.invalid-verdict", "beta"), ("coverage.missing", "alpha"), ("coverage.missing", "gamma"), ("coverage.unexpected-verdict", "alpha"), ("coverage.unexpected-verdict", "coverage"), ("coverage.unexpected-verdict", "delta")]
    assert r["outcome"] == "fail" and r["axes"]["alpha"]["script"] == "crashed" and r["summary"]["coverage_blocks"] == 6
    assert merge("never")["scan"]["status"] == "missing"


def test_merge_folds_caps_strips_and_waives(kit):
    scan, verdict, merge, context = kit
    scan(results={"alpha": [finding("alpha", "block", "alpha.x")], "beta": []})
    verdict("beta", [finding("beta", "block", "alpha.x", more=[("z.md", 9)], _demoted=True, found_by=["me"])])
    verdict("gamma", [])
    r = merge()
    (f,) = r["findings"]
    assert f["found_by"] == ["alpha", "beta"] and f["severity"] == "block" and len(f["locations"]) == 2
    assert r["axes"]["beta"]["stripped_self_reports"] == 1 and r["axes"]["beta"]["findings"] == 1 and r["outcome"] == "fail"
    r = merge(waive=["code=alpha.x", "alpha.y"])
    assert r["outcome"] == "pass" and r["waivers"] == [{"code": "alpha.x", "applied": 1}, {"code": "alpha.y", "applied": 0}]
    text = open(os.path.join(context.out_dir, "r", "report.md")).read()
    assert "| info | `alpha.x` | a.md:1 and 1 more |" in text and "skipped: the configuration has no missing" in text
    assert re.search(r"`beta`: 1", text)


def test_narrowed_runs_keep_the_other_axes_in_sight(kit):
    scan, verdict, merge, _ = kit
    scan(only=["alpha"])
    r = merge(only=["alpha"])
    assert r["outcome"] == "pass" and r["summary"]["axes_expected"] == 4 and r["summary"]["axes_skipped"] == 3


def test_verdicts_and_waivers(tmp_path):
    assert strip_self_report({"waived": 1, "axis": "a"}) == ({"axis": "a"}, ["waived"]) and strip_self_report(3) == (3, [])
    p = tmp_path / "links.json"
    for rows, ok in (([finding()], True), ([finding("numbers")], False), ([finding(code="coverage.x")], False), ({}, False), ([finding(), {"bad": 1}], False)):
        p.write_text(json.dumps(rows))
        v = read_verdict(str(p), "links", ("links", "numbers"))
        assert (v["status"] == "ok") == ok and bool(v["findings"]) == ok
    for bad in (["coverage.missing"], ["code="]):
        with pytest.raises(MergeError):
            normalize_waivers(bad)
    assert normalize_waivers(["a.b", "code=a.b"]) == ["a.b"]
