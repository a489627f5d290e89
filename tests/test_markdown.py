import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import markdown as M
from tests.helpers import docs


def parse(*lines):
    return M.parse_markdown("\n".join(lines))


def test_headings_sections_and_anchors():
    h = parse("# Top", "", "## 5.1 Tile sizes", "  ### §6. Rules ##", "####### no", "#no", "## 2026년 plan", "## Top", "# Top", "## 3.", "#").pop("headings")
    assert [(x["level"], x["text"], x["line"], x["anchor"], x["section"]) for x in h] == [
        (1, "Top", 1, "top", None), (2, "5.1 Tile sizes", 3, "51-tile-sizes", "5.1"), (3, "§6. Rules", 4, "6-rules", "6"), (2, "2026년 plan", 7, "2026년-plan", None),
        (2, "Top", 8, "top-1", None), (1, "Top", 9, "top-2", None), (2, "3.", 10, "3", "3"), (1, "", 11, "", None),
    ]


def test_line_ends_and_fences():
    d = M.parse_markdown("a\r\nb\rc\n~~~ sql\n# no\n```\n~~~~\n```x`y\n``` py\n[a](b)\n")
    assert [x["raw"] for x in d["lines"]][:3] == ["a", "b", "c"]
    assert [(f["start"], f["end"], f["info"], f["closed"]) for f in d["fences"]] == [(4, 7, "sql", True), (9, 11, "py", False)]
    assert d["headings"] == [] and d["links"] == []
    assert [x["in_fence"] for x in d["lines"]] == [False] * 3 + [True] * 4 + [False] + [True] * 3


def test_tables():
    d = parse("| a | b\\|c |", "|:--|:-:|", "| 1 | 2 | 3 |", "x | y", "", "| a |", "|---|---|", "p | q", "--|-:", "# h | x", "r | s")
    t = d["tables"]
    assert [(x["table_line"], x["end_line"], x["header"], x["alignments"]) for x in t] == [(1, 4, ["a", "b|c"], ["left", "center"]), (8, 9, ["p", "q"], [None, "right"])]
    assert [(r["line"], r["cells"]) for r in d["table_rows"]] == [(3, ["1", "2", "3"]), (4, ["x", "y"])]


def test_code_spans_and_links():
    d = parse("`a` ``b ` c`` `open [x](y) ![i](<p q.png>) [t](u \"v\") `[no](z)`", "```", "`in fence`", "```")
    assert [(s["text"], s["col"], s["end_col"]) for s in d["code_spans"]][:2] == [("a", 1, 3), ("b ` c", 5, 13)]
    assert d["code_spans"][-1] == {"line": 3, "col": 1, "end_col": 10, "backticks": 1, "text": "in fence", "raw": "`in fence`"}
    d = parse("[x](y) ![i](<p q.png>) [t](u \"v\") `[no](z)` []() [a b](#c/d)")
    assert [(x["text"], x["target"], x["is_image"]) for x in d["links"]] == [("x", "y", False), ("i", "p q.png", True), ("t", "u", False), ("", "", False), ("a b", "#c/d", False)]


def test_notes_of_tables():
    t = ["| a | b |", "|---|---|", "| x | 1 |"]
    kind = lambda *lines: M.parse_markdown("\n".join(lines))["tables"][0]["note_kind"]
    assert kind("Double counting applies.", *t) == "multi-assignment"
    assert kind(*t, "", "Just a note.", "An excerpt.") == "elision"
    assert kind(*t, "", "A note.") == "other-note"
    assert kind("# Excerpt", *t, "", "| excerpt") == "none"
    assert kind(*t, "", "", "", "", "", "", "excerpt") == "none"


cells = st.text(string.ascii_letters + "|* `", max_size=8).map(str.strip)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(cells, min_size=3, max_size=3), min_size=1, max_size=5))
def test_a_rendered_table_is_read_back(rows):
    line = lambda r: "|" + "|".join(" " + c.replace("|", "\\|") + " " for c in r) + "|"
    d = M.parse_markdown("\n".join([line(["h"] * 3), "|-|-|-|", *map(line, rows)]))
    assert [r["cells"] for r in d["table_rows"]] == rows


def test_views(spark):
    d = docs(spark, {"a.md": "# A\n## 1 B\n### C\n## D\n", "empty.md": "", "b.md": "| h | i |\n|--|--|\n| x | |"})
    assert [(x.text, x.line, x.end) for x in M.headings(d).orderBy("path", "line").collect()] == [("A", 1, 4), ("1 B", 2, 3), ("C", 3, 3), ("D", 4, 4)]
    assert sorted((x.col_idx, x.cell) for x in M.table_cells(d).collect()) == [(0, "x"), (1, "")]
    assert M.lines(d).where("path = 'empty.md'").count() == 1


_SOME = ["| a | b |", "|-|-|", "|1|2|", "", "text", "# H", "## 2. Two", "### H", "```", "~~~ x", "~~~", "`a` [l](b.md)", "multiple assignment", "excerpt", "see [it](a.md) §1, §2", "as in it §4 and it §4", "x\r", "one\ntwo"]


@pytest.mark.parametrize("size", [1, 3, 8])
def test_pieces_are_the_whole(spark, size):
    """A document in pieces has the parts of the whole one, and none of its rows holds more than some lines."""
    draw = random.Random(size)
    files = {f"{k}.md": [draw.choice(_SOME) for _ in range(draw.randint(1, 60))] for k in range(40)}
    rows = [(p, n, x) for p, lines in files.items() for n, x in enumerate(lines)] + [("null.md", 0, None), ("0.md", -1, None)]
    pieces = M.parsed_lines(spark.createDataFrame(rows, "path string, o long, line string"), size=size)
    got = {}
    for x in pieces.orderBy("path", "piece").collect():
        assert len(x["lines"]) <= 3 * size + 6
        for k in M.TYPES:
            got.setdefault(x.path, {}).setdefault(k, []).extend(r.asDict(True) for r in x[k])
    for path, lines in (files | {"null.md": [""]}).items():
        want = M.parse_markdown("\n".join(lines))
        for k in M.TYPES:
            if k == "refs":  # equal texts share a row in a piece
                flat = lambda rs: sorted((n, at, s, r["link_col"], r["one"], r["two"], r["foreign"]) for r in rs for n, at, s in zip(r["lines"], r["places"], r["sections"]))
                assert flat(got[path][k]) == flat(want[k])
            else:
                assert sorted(got[path][k], key=repr) == sorted(want[k], key=repr), (path, k)
    assert sorted(x.path for x in M.documents(pieces).collect()) == sorted([*files, "null.md"])
