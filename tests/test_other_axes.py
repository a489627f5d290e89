import json

import pytest

from plumbline.operators import concepts, decisions, links, ownership
from plumbline.operators.markdown import parsed_lines
from plumbline.sources.manifests import SourceError, manifest_entries
from plumbline.sources.scratch import stored
from tests.helpers import axis, codes, docs, places

# == ownership

OWNER = "# Sizes\n\n| name | count |\n|---|---|\n| kitchen | 41 |\n| hall | 5 |\n| total | 46 |\n\n- **policy**: rooms are never shared between two tenants\n"
DECLARED = {"ownership": [{"what": "sizes", "owner": "sizes.md"}]}


def test_owned_items(spark):
    items, missing = ownership.owned_items(docs(spark, {"sizes.md": OWNER}), [*DECLARED["ownership"], {"what": "x", "owner": "none.md"}])
    assert [(x.name, x.value, x.column, x.line, x.kind) for x in items.orderBy("line").collect()] == [("kitchen", "41", "count", 5, "table-row"), ("hall", "5", "count", 6, "table-row"), ("policy", "rooms are never shared between two tenants", None, 9, "definition")]
    assert [x.owner for x in missing.collect()] == ["none.md"]


def test_key_column():
    assert ownership.key_column([["a", "x", "1"], ["a", "y", "2"]], 3) == 1
    assert ownership.key_column([["a", "x"], ["b", "x"]], 2) == 0
    assert ownership.key_column([["a", "l" * 41], ["a", "m" * 41]], 2) == 0


def test_drift_and_restatement(spark):
    files = {"sizes.md": OWNER, "a.md": "The kitchen has 49 rooms.", "b.md": "kitchen: 41\n\n# Other\n\nkitchen 41, see [sizes](sizes.md)", "c.md": "- policy: rooms are never shared at all\n```js\nkitchen 7\n```\n```\nkitchen 41\n```"}
    r = axis(spark, ownership.run_axis, files, DECLARED)
    (f,) = r["findings"]
    assert (f["code"], f["severity"]) == ("ownership.drifted-copy", "block") and places(f) == [("a.md", 1), ("sizes.md", 5)]
    assert f["payload"]["drift_detail"] == [{"file": "a.md", "line": 1, "owner_values": [41.0], "found_values": [49.0]}]
    by = {c["item"]["name"]: c for c in r["candidates"]}
    assert [(p["file"], p["line"], p["value_match"]) for p in by["kitchen"]["duplicate_locations"]] == [("b.md", 1, "same"), ("c.md", 6, "same")]
    assert [(p["file"], p["value_match"], p["missing_tokens"]) for p in by["policy"]["duplicate_locations"]] == [("c.md", "partial", ["between", "two", "tenants"])]
    assert codes(axis(spark, ownership.run_axis, {"a.md": "x"}, DECLARED)) == ["ownership.owner-missing"]


@pytest.mark.parametrize(
    ("item", "line", "columns", "want"),
    [
        ({"name": "age", "value": "5"}, "manage 6 of them", None, None),
        ({"name": "portal", "value": "20"}, "the north-portal-web 3", None, None),
        ({"name": "portal", "value": "20"}, "portal r121 i18n 1:1", None, None),
        ({"name": "portal", "value": "20"}, "### 5.2 portal", None, None),
        ({"name": "portal", "value": "20"}, "portal is up. 3 more came.", None, None),
        ({"name": "portal", "value": "20", "column": "tiles"}, "| portal | 3 |", {"rooms"}, None),
        ({"name": "portal", "value": "20", "column": "tiles"}, "| portal | 3 |", {"tiles"}, "different"),
        ({"name": "portal", "value": "20", "column": "tiles", "cross_tab": True}, "portal 3", None, None),
        ({"name": "portal", "value": "20", "column": "tiles", "cross_tab": True}, "portal tiles 3", None, "different"),
        ({"name": "gate", "value": "units 6"}, "gate 4 tiles", None, None),
        ({"name": "gate", "value": "units 6"}, "gate units 4", None, "different"),
        ({"name": "gate", "value": "1,200"}, "gate 1200", None, "same"),
        ({"name": "x", "value": "alpha beta gamma delta"}, "delta gamma beta alpha", None, "same"),
        ({"name": "rule", "value": "alpha beta gamma delta"}, "the rule: alpha beta", None, "partial"),
        ({"name": "rule", "value": "alpha beta gamma delta"}, "the rule: alpha", None, None),
    ],
)
def test_classify(item, line, columns, want):
    got = ownership.classify(item, line, columns)
    assert (got and got["match"]) == want


def test_links_to_owner():
    f = ownership.links_to
    assert f("../a/own.md#x", "b/c.md", "a/own.md") and f("#ns/own", "b.md", "a/own.md") and f("OWN.md", "b.md", "own.md")
    assert not f("#own", "b.md", "own.md") and not f("https://x.example/own.md", "b.md", "own.md") and not f("", "b.md", "own.md")


# == concepts


def test_ghosts_and_fields(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"properties": {"userName": {"properties": {"deep_key": {}}}}, "required": ["tileCount"]}))
    text = "`booking-core` " * 8 + "\n`booking-authoring` `userNames` `room-core`\n```\n`booking-author`\n```\n`plain` `a b` `userName` `tile_count`"
    files = {"a.md": text}
    r = axis(spark, concepts.run_axis, files, {"schemas": ["s.json", "none.json"], "schemas_complete": True, "concepts": ["booking-author", "zero"]}, str(tmp_path))
    assert codes(r) == ["concepts.ghost-field", "concepts.ghost-field", "concepts.schema-unreadable"]
    assert {f["payload"].get("concept"): f["payload"].get("candidates") for f in r["findings"] if "concept" in f["payload"]} == {"userNames": ["userName"], "tile_count": ["tileCount"]}
    ghost = [c for c in r["candidates"] if c["kind"] == "ghost"]
    assert [(c["name"], c["dominant"]["name"], c["dominant"]["occurrences"]) for c in ghost] == [("booking-authoring", "booking-core", 8)]
    use = {c["concept"]: c for c in r["candidates"] if c["kind"] == "concept-usage"}
    assert use["zero"]["occurrences"] == 0 and use["booking-author"]["occurrences"] == 2
    r = axis(spark, concepts.run_axis, files, {"schemas": ["s.json"]}, str(tmp_path))
    assert codes(r) == [] and sorted(c["name"] for c in r["candidates"] if c["kind"] == "ghost-field") == ["tile_count", "userNames"]
    assert r["stats"]["field_check"]["closed_world"] is False


def test_similarity_in_blocks_is_that_of_all_pairs(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import text as T

    names = ["userName", "user_name", "userNames", "user-name-x", "tile", "tiles", "title", "tilex", "a.b", "a.c", "x.b", "@repo/room-editor", "repo-room-editor", "roomEditor", "rooms", "Rooms", "boom"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("segments", T.segments(F.col("name")))
    other = df.toDF("other", "other_segments")
    why = T.identifier_similarity(F.col("name"), F.col("other"), F.col("segments"), F.col("other_segments"))
    want = {(x.name, x.other) for x in df.crossJoin(other).where(why.isNotNull()).collect()}
    assert {(x.name, x.other) for x in concepts.similar(df, other).collect()} == want
    assert ("tile", "tilex") not in want and ("tiles", "title") not in want and ("rooms", "boom") not in want and ("userName", "user_name") in want and ("rooms", "Rooms") in want


def test_field_names():
    assert concepts.field_names({"a": [{"b": 1, "required": ["c", 2]}]}) == {"a", "b", "c", "required"}
    assert concepts.field_names({"$defs": {"x": {"properties": {"y": {}}}}, "required": ["z"]}) == {"y", "z"}


# == links


def test_resolution(spark):
    files = {
        "a/one.md": "# One\n\n[x]() [x](http://h) [x](//h) [x](#ns/two) [x](#ns/none) [x](#home) [x](#one) [x](#gone)\n[x](../two.md) [x](/two.md#two) [x](two.md) [x](../two.md#gone) [x](pic.png) [x](b/../../two.md) [x](#) [x](../two.md#Tw%6F)",
        "two.md": "# Two\n",
    }
    d = docs(spark, files)
    ids = links.manifest_ids(d, manifest_entries({"docs": ["two", {"docId": "lost", "file": "gone.md"}]}), "docs")
    disk = spark.createDataFrame([("a/pic.png",)], "path string")
    rows = links.resolved(d, True, False, ids, ["home"], disk).orderBy("line", "col").collect()
    assert [(x.kind, x.ok, x.target_path, x.key) for x in rows] == [
        ("empty", True, None, None), ("external", True, None, None), ("external", True, None, None), ("manifest-id", True, "two.md", "two.md"), ("manifest-id", False, None, None), ("route", True, None, None),
        ("anchor", True, "a/one.md", "a/one.md#one"), ("anchor", False, None, None), ("path", True, "two.md", "two.md"), ("path", True, "two.md", "two.md#two"), ("path", False, None, None), ("path", False, None, None),
        ("path", True, None, None), ("path", True, "two.md", "two.md"), ("empty", True, None, None), ("path", True, "two.md", "two.md#two"),
    ]
    rows = links.resolved(d).where("kind = 'unverified-id'").collect()
    assert len(rows) == 2 and all(x.ok for x in rows)


def test_manifest_shapes():
    ids = lambda raw: [e["id"] for e in manifest_entries(raw)]
    assert ids(["a", {"slug": "b", "ns": "n"}, {"id": "n/c", "group": "g"}, 3, {"title": "t"}]) == ["a", "n/b", "n/c"]
    assert ids({"entries": [{"key": "a"}, {"key": "a", "title": "again"}]}) == ["a"] and ids({"a": {"path": "x"}, "b": 1}) == ["a", "b"]
    assert manifest_entries(3) is None and manifest_entries(["a"])[0]["path"] is None


def refs(spark, files):
    d = docs(spark, files)
    rows = links.section_targets(links.section_refs(d), links.resolved(d), links.registry(d), d)
    return {(x.path, x.line, x.section): (x.via, x.target_path, x.found) for x in rows.collect()}


def test_section_targets(spark):
    got = refs(spark, {
        "glossary.md": "# 용어집\n## 1 One\n## 2 Two\n",
        "my guide.md": "# Guide Book\n## 3 X\n",
        "a.md": "## 5 Mine\nsee [g](glossary.md) §1·§2, §9\nsee 용어집의 §2\nsee Guide Book (§3)\narc42 §10\nmisGuide Book §3\nplain §5 `§6`\n[x](http://h) §7\ntotal 58(§5)\n```\n§8\n```",
    })
    assert got == {
        ("a.md", 2, "1"): ("link", "glossary.md", True), ("a.md", 2, "2"): ("link", "glossary.md", True), ("a.md", 2, "9"): ("link", "glossary.md", False),
        ("a.md", 3, "2"): ("name", "glossary.md", True), ("a.md", 4, "3"): ("name", "my guide.md", True), ("a.md", 5, "10"): ("external", None, False),
        ("a.md", 6, "3"): ("self", "a.md", False), ("a.md", 7, "5"): ("self", "a.md", True), ("a.md", 8, "7"): ("unresolved-link", None, False), ("a.md", 9, "5"): ("self", "a.md", True),
    }


def test_names_of_two_documents_are_dropped(spark):
    d = docs(spark, {"x/guide.md": "# Same", "y/guide.md": "# Same", "z.md": "# Own"})
    assert {x.name for x in links.registry(d).collect()} == {"x/guide", "y/guide", "z", "own"}


def test_links_axis(spark):
    files = {
        "guide.md": "# Guide\n## 1 Start\n- **Term**: x\n\n| a | b |\n|---|---|\n| Cell | **Bold** |\n",
        "a.md": "[Guide](guide.md) [Start](guide.md#1-start) [Term](guide.md) [Cell](guide.md) [Bold](guide.md) [Gude](guide.md) [gone](no.md)\n§7 §8\n§9",
        "frozen/b.md": "[gone](no.md) [Weird](../guide.md)",
    }
    r = axis(spark, links.run_axis, files, {"docs": {"root": "docs", "frozen": ["frozen/**"]}})
    got = sorted((f["code"], f["severity"], f["locations"][0]["file"]) for f in r["findings"])
    assert got == [("links.dead-target", "block", "a.md"), ("links.dead-target", "warn", "frozen/b.md"), ("links.discredited-self", "info", "a.md"), ("links.display-mismatch", "warn", "a.md"), *[("links.display-variant", "warn", "a.md")]]
    mismatch = next(f for f in r["findings"] if f["code"] == "links.display-mismatch")
    assert mismatch["payload"]["closest"] == "Guide" and len(mismatch["payload"]["candidates"]) == 3
    tie = next(f for f in r["findings"] if f["code"] == "links.display-variant")
    assert tie["payload"]["tie"] is True and len(tie["payload"]["variants"]) == 5
    assert r["stats"]["files_scanned"] == 3


def test_variants(spark):
    line = lambda name, n: "\n".join(f"[{name}](t.md)" for _ in range(n))
    d = docs(spark, {"t.md": "# T", "a.md": line("Guide", 7), "b.md": line("*the* Guide", 2), "c.md": line("guide", 1), "f.md": line("Other", 9)}, frozen=("f.md",))
    (v,) = links.display_variants(links.displays(links.resolved(d))).collect()
    assert (v.majority, v.majority_count, v.variant, v.variant_count, v.tie, len(v.places)) == ("Guide", 8, "the Guide", 2, False, 2)
    d = docs(spark, {"t.md": "# T", "a.md": "[x](t.md) [y](t.md)"})
    assert links.display_variants(links.displays(links.resolved(d))).count() == 0


# == decisions

BODY = """# All
## ADR-001 First
- **Status** accepted
- **Decision** goes to [guide](../guide.md) §1·§2
  and [api](../api.md), [ADR-002](#adr-002)
- **Result** [other](../other.md)
## ADR-0071 Neighbour
## ADR-002: Second
Status: superseded by ADR-003
## ADR-003 Third
**Status**: Superseded by ADR-002
## ADR-004 Fourth
- **Status** superseded by ADR-099
## ADR-005 Fifth
- **Status** accepted
Context in [other](../other.md)
## ADR-006 Sixth
- **Status** superseded
"""
ADR = {"adr": {"bodies": "adr/all.md", "cards": "cards.json", "status_field": "Status", "decision_field": "Decision"}, "plugins": ["adr"]}


@pytest.fixture()
def record(tmp_path):
    (tmp_path / "docs/adr").mkdir(parents=True)
    (tmp_path / "docs/adr/all.md").write_text(BODY)
    (tmp_path / "docs/cards.json").write_text(json.dumps({"x": 1, "cards": [dict(id="ADR-001", status=" Accepted"), dict(id="ADR-003", status="draft"), dict(id="ADR-050"), dict(id="other")]}, indent=1))
    return str(tmp_path)


FILES = {"adr/all.md": BODY, "guide.md": "# G\n## 1 A\n## 2 B\nby ADR-001\n", "api.md": "# Api\n```\nADR-001\n```\nADR-002 and ADR-002\n", "other.md": "# O\nADR-005\n", "skip.md": "x"}


def test_decisions_of():
    from plumbline.operators.markdown import parse_markdown

    rows = decisions.decisions_of(parse_markdown(BODY), decisions.Settings("b", status_field="Status", decision_field="Decision"))
    assert [(r[1], r[2], r[8], r[10], r[5], r[6]) for r in rows][:3] == [("ADR-001", "First", "accepted", None, 2, 6), ("ADR-002", "Second", "superseded", "ADR-003", 8, 9), ("ADR-003", "Third", "superseded", "ADR-002", 10, 11)]
    assert rows[0][11:13] == (4, 5)


def test_decisions_axis(spark, record):
    config = {**ADR, "docs": dict(root="docs", frozen=["adr/**"], exclude=["skip.md"])}
    r = axis(spark, decisions.run_axis, FILES, config, record)
    by = {}
    for f in r["findings"]:
        by.setdefault(f["code"], []).append((f["payload"]["decision_id"], f["severity"], places(f)))
    assert by["decisions.supersede-cycle"] == [("ADR-002", "block", [("adr/all.md", 9)]), ("ADR-003", "block", [("adr/all.md", 11)])]
    assert [x[0] for x in by["decisions.supersede-dangling"]] == ["ADR-004", "ADR-006"]
    assert by["decisions.citation-missing"] == [("ADR-001", "warn", [("api.md", None), ("adr/all.md", 2)])]
    assert [x[0] for x in by["decisions.card-mismatch"]] == ["ADR-003"] and [x[0] for x in by["decisions.card-orphan"]] == ["ADR-050"]
    assert [x[0] for x in by["decisions.card-missing"]] == ["ADR-002", "ADR-004", "ADR-005", "ADR-006"]
    kinds = [(c["kind"], c["decision_id"]) for c in r["candidates"]]
    assert sorted(kinds) == [("reflection", "ADR-001"), ("reflection", "ADR-005"), ("stale_supersede", "ADR-002")]
    first = next(c for c in r["candidates"] if c["decision_id"] == "ADR-001")
    assert [(t["file"], t.get("section"), t.get("line_range"), t["cites_decision"]) for t in first["targets"]] == [("guide.md", "1", [2, 2], True), ("guide.md", "2", [3, 5], True), ("api.md", None, [1, 6], False)]
    fifth = next(c for c in r["candidates"] if c["decision_id"] == "ADR-005")
    assert fifth["designated_by"] == "body"
    assert r["stats"]["accepted"] == 2 and r["stats"]["decisions_parsed"] == 6


def test_out_of_scope_and_frozen(spark, record):
    config = {**ADR, "docs": dict(root="docs", exclude=["guide.md"], frozen=["api.md", "adr/**"])}
    r = axis(spark, decisions.run_axis, FILES, config, record)
    out = [f for f in r["findings"] if f["code"] == "decisions.target-out-of-scope"]
    assert [(f["severity"], places(f)) for f in out] == [("warn", [("adr/all.md", 4)])] and "guide.md" in out[0]["payload"]["scope_reason"]
    assert not any(f["code"] == "decisions.citation-missing" for f in r["findings"])
    assert any(e["path"] == "api.md" and "citation-missing" in e["reason"] for e in r["stats"]["excluded"])


def test_card_statuses(spark, record):
    config = {**ADR, "docs": {"root": "docs", "frozen": ["adr/**"]}}
    config["adr"] = {**ADR["adr"], "card_statuses": ["ACCEPTED"]}
    got = codes(axis(spark, decisions.run_axis, FILES, config, record))
    assert got.count("decisions.card-unexpected") == 1 and got.count("decisions.card-missing") == 1


def test_settings_problems():
    with pytest.raises(SourceError) as e:
        decisions.parse_settings({"adr": {"odd": 1, "id_pattern": "(", "card_statuses": []}})
    assert len(e.value.problems) == 4


def test_designations():
    r = decisions.Resolver("/r/docs/adr", "/r/docs", frozenset({"guide.md", "a/x.md", "b/x.md"}), {"told": "guide.md"}, {"old/y.md": "excluded"})
    d = lambda t: decisions.designation(t, r)[:2]
    none, guide = ("not-a-document", None), ("in-corpus", "guide.md")
    assert [d(x) for x in ("../guide.md#s", "#ns/guide", "#ns/told", "guide", "#guide", "http://x/guide.md", "", "#ns/x", "../none.md", "%zz.md")] == [guide, guide, guide, guide, none, none, none, none, none, none]
    assert d("../old/y.md") == d("#ns/y") == ("out-of-scope", "old/y.md")


def chased(records):
    """Each superseded record's chain, by a loop over a dict."""
    by, out = {r[0]: r for r in records}, {}
    for id_, status, to in records:
        if not by[id_][2]:
            continue
        chain, at, end = [id_], by[id_], None
        while at and at[2]:
            chain.append(at[2])
            if at[2] in chain[:-1]:
                end = "cycle"
                break
            at = by.get(at[2])
        out[id_] = (chain, end or ((at[1] or "unknown") if at else "missing"))
    return out


def test_chains_of_any_length(spark):
    records = [(f"a{k}", "superseded", f"a{k + 1}") for k in range(230)] + [("a230", "accepted", None)]
    records += [(f"b{k}", "superseded", f"b{k + 1}") for k in range(130)]  # ends in nothing
    records += [(f"c{k}", "superseded", f"c{(k + 1) % 7}") for k in range(7)] + [("d1", "superseded", "c3"), ("d0", "superseded", "d1"), ("e", "superseded", "e"), ("f", "superseded", "g"), ("g", None, None)]
    rows = decisions.chains(spark.createDataFrame(records, "id string, status string, superseded_by string")).collect()
    assert {x.id: (x.chain, x.terminal) for x in rows} == chased(records)
    assert decisions.chains(spark.createDataFrame([], "id string, status string, superseded_by string")).count() == 0


def test_chains_that_ended_are_left_alone(spark, monkeypatch):
    """A step writes only the chains that were open, not all (whose nulls met in one task)."""
    written = []
    monkeypatch.setattr(decisions, "stored", lambda df: written.append(df.count()) or df)
    records = [(f"a{k}", "superseded", f"a{k + 1}") for k in range(8)] + [("a8", "accepted", None)]
    records += [(f"b{k}", "superseded", "a8") for k in range(50)]
    rows = decisions.chains(spark.createDataFrame(records, "id string, status string, superseded_by string")).collect()
    assert {x.id: (x.chain, x.terminal) for x in rows} == chased(records)
    assert written[0] == 58 and written[1:] == [7, 6, 4]


def test_links_over_pieces(spark):
    """Links, names and references are the same over a document in pieces of any size."""
    files = {"a.md": ["# A", "## 1. One", "| x | y |", "|-|-|", "| term | 1 |", "**bold** text", "## 2. Two", "end"], "b.md": []}
    files["b.md"] = [x for k in range(30) for x in (f"[term](a.md) and [none {k % 3}](a.md) and [Two](a.md#2-two)", "see a §2", f"see [a](a.md) §{k % 4}", "plain §1", "[x](c.md) §1")]
    rows = [(p, n, x) for p, lines in files.items() for n, x in enumerate(lines)]
    pieces = stored(parsed_lines(spark.createDataFrame(rows, "path string, o long, line string"), size=4))
    assert pieces.where("path = 'b.md'").count() > 10

    def all_of(d):
        r = links.resolved(d)
        whole, anchored = links.target_names(d, links.document_names(d))
        dead, up = links.dead_sections(links.section_targets(links.section_refs(d), r, links.registry(d), d))
        return [sorted(map(repr, x.collect())) for x in (r.drop("frozen"), links.display_mismatch(links.displays(r), whole, anchored), links.display_variants(links.displays(r)), dead.select("path", "line", "pos", "section", "via"), up.drop("frozen"), links.registry(d))]

    got, want = all_of(pieces), all_of(stored(docs(spark, {p: "\n".join(x) for p, x in files.items()})))
    assert got == want and [len(x) for x in want[:2]] == [150, 30] and all(want)
