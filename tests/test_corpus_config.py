import json
import os

import pytest

from plumbline.context import ConfigError, has_config_key, load_config, parse_cli_args, validate_config
from plumbline.registry import Axis, ManifestError, core_axes, load_axes, load_manifest, merge_manifests, parse_axis_selection, resolve_axes, validate_manifest
from plumbline.sources.corpus import CorpusError, expand_braces, glob_matches, load_corpus


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("**/*.md", ["a.md", "x/y/a.md", ".h/a.md"], ["a.markdown", "a.md/x"]),
        ("docs/**", ["docs/a", "docs/a/b"], ["docs", "x/docs/a"]),
        ("*.md", ["a.md"], ["x/a.md"]),
        ("a?.md", ["ab.md"], ["a.md", "a/.md"]),
        ("{a,b/{c,d}}.md", ["a.md", "b/c.md", "b/d.md"], ["b.md", "c.md"]),
        ("[ab].md", ["a.md", "b.md"], ["c.md"]),
        ("[!a].md", ["!.md", "a.md"], ["b.md"]),
        ("a{b", ["a{b"], ["ab"]),
        ("a+(b).md", ["a+(b).md"], ["aab.md"]),
    ],
)
def test_globs(spark, glob, yes, no):
    assert all(glob_matches(p, [glob]) for p in yes) and not any(glob_matches(p, [glob]) for p in no)
    from pyspark.sql import functions as F

    from plumbline.sources.corpus import first_glob

    rows = spark.createDataFrame([(p,) for p in yes + no], "path string").select("path", first_glob(F.col("path"), ["none", glob]).alias("g")).collect()
    assert {x.path for x in rows if x.g == glob} == set(yes)


def test_braces():
    assert expand_braces("{a,b}{1,2}") == ["a1", "a2", "b1", "b2"]


def test_listing(spark, tmp_path):
    for p in ("docs/a.md", "docs/_hidden/b.md", "docs/.c.markdown", "docs/d.txt", "docs/drafts/e.md", "docs/old/f.md", "docs/node_modules/g.md", "docs/n.markdown"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("# x\r\n")
    os.symlink(tmp_path / "docs/a.md", tmp_path / "docs/link.md")
    os.makedirs(tmp_path / "docs/dir.md")
    (tmp_path / "c.json").write_text(json.dumps(dict(docs=dict(root="docs", exclude=["drafts/**", "old/**"], frozen=["old/*.md"], include=["**/*.md", ".c.markdown"]))))
    corpus = load_corpus(spark, load_config(str(tmp_path / "c.json")))
    assert [x.path for x in corpus.scanned.orderBy("path").collect()] == [".c.markdown", "_hidden/b.md", "a.md"]
    assert [(x.path, x.text, x.frozen_by) for x in corpus.frozen.collect()] == [("old/f.md", "# x\r\n", "old/*.md")]
    reasons = {x.path: x.reason for x in corpus.excluded.collect()}
    assert set(reasons) == {"drafts/e.md", "link.md", "n.markdown", "node_modules", "old/f.md"} and all(reasons.values())
    with pytest.raises(CorpusError):
        load_corpus(spark, load_config(str(tmp_path / "c.json"), str(tmp_path / "docs")))


def test_all_problems_are_found(tmp_path):
    raw = {"docs": {"root": "", "include": "x", "odd": 1}, "ownership": [{"what": 1}, 3], "numbers": {"marker_pattern": "("}, "measurements": [{"label": "a"}], "schemas_complete": "yes", "BadKey": 1, "adr": {}, "concepts": [""]}
    problems = validate_config(raw)
    for part in ("docs.root", "docs.include", "docs.odd", "ownership[0].what", "ownership[0].owner", "ownership[1]", "numbers.marker_pattern", "measurements[0].cmd", "schemas_complete", "BadKey", "concepts"):
        assert any(p.startswith(part) for p in problems), part
    assert not any(p.startswith("adr") for p in problems)
    assert validate_config([]) and validate_config({"docs": {"root": "d"}}) == []
    (tmp_path / "bad.json").write_text("{")
    for path in ("bad.json", "none.json"):
        with pytest.raises(ConfigError):
            load_config(str(tmp_path / path))


def test_defaults(tmp_path):
    (tmp_path / "c.json").write_text('{"docs": {"root": "d"}, "numbers": {}}')
    c = load_config(str(tmp_path / "c.json"))
    assert c.config["docs"]["include"] == ["**/*.md"] and c.config["plugins"] == [] and c.docs_root == str(tmp_path / "d")
    assert [has_config_key({"a": x}, "a") for x in ([], {}, "", None, [0], {"b": 1}, "x", False, 0)] == [False] * 4 + [True] * 5


def test_cli_arguments():
    assert parse_cli_args(["--config=a", "--waive", "x", "--waive=y", "--run-id", "1"], ("config", "run-id"), ("waive",)) == {"config": "a", "run_id": "1", "waive": ["x", "y"]}
    for bad in (["--config"], ["--config", "--repo"], ["--no", "x"], ["x"], []):
        with pytest.raises(ConfigError):
            parse_cli_args(bad)


def test_manifests(tmp_path):
    bad = dict(axes=[dict(name="Bad", kind="odd", run={}), dict(name="a", kind="script", run=dict(contract="c"), x=1), dict(name="a", kind="judgment", run=dict(script="s", contract="c"), severity_cap="none", when=dict(requires=[1]))])
    problems = validate_manifest(bad)
    for part in ("axes[0].name", "axes[0].kind", "axes[1].run.script", "axes[1].run.contract", "axes[1].x", "axes[2].name", "axes[2].run.script", "axes[2].severity_cap", "axes[2].when.requires"):
        assert any(p.startswith(part) for p in problems), part
    (tmp_path / "m.json").write_text(json.dumps(dict(axes=[dict(name="mine", kind="hybrid", run=dict(script="s.py", contract="c.md"), when=dict(requires=["k"]))])))
    (axis,) = load_manifest(str(tmp_path / "m.json"))
    assert (axis.title, axis.severity_cap, axis.script, axis.requires) == ("mine", "block", str(tmp_path / "s.py"), ("k",))
    with pytest.raises(ManifestError):
        load_manifest(str(tmp_path / "m.json"), check_exists=True)
    with pytest.raises(ManifestError):
        merge_manifests([[axis], [axis]])


def test_axes_are_skipped_with_a_reason():
    axes = load_axes({"plugins": ["adr"], "ownership": []})
    assert {a.name: a.state for a in axes} == {"numbers": "active", "ownership": "skipped", "concepts": "active", "links": "active", "decisions": "skipped"}
    assert all(a.reason for a in axes if a.state == "skipped")
    assert [a.name for a in load_axes({}, ["links"]) if a.state == "active"] == ["links"]
    assert len(load_axes({}, ["links"])) == 4
    for call in (lambda: load_axes({}, ["nope"]), lambda: load_axes({"plugins": ["nope"]}), lambda: load_axes({"plugins": ["No"]}), lambda: parse_axis_selection(" , ")):
        with pytest.raises(ManifestError):
            call()
    assert parse_axis_selection("a, b,a") == ["a", "b"] and parse_axis_selection(None) is None
    again = resolve_axes(load_axes({}, ["links"]), {"ownership": [1]})
    assert all(a.state == "active" and a.reason is None for a in again)
    assert len(core_axes()) == 4 and isinstance(core_axes()[0], Axis)
