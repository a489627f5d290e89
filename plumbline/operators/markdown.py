"""Markdown as relations: one narrow parse of each document, and views of its parts.

parsed() reads each text once and gives a row of nested arrays for each document;
lines(), headings(), tables() ... explode them. Line numbers count from 1, columns
too; positions are in code points.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_END = re.compile(r"\r\n|\r|\n")
HEADING = re.compile(r"[ ]{,3}(?P<marks>#{1,6})(?P<rest>\s.*|)\Z", re.S)
FENCE = re.compile(r"\s{,3}(?P<marker>`{3,}|~{3,})(?P<info>.*)\Z", re.S)
DELIMITER = re.compile(r":?-+:?\Z")
_TITLE = "|".join(f"[{a}][^{b}]*[{b}]" for a, b in ('""', "''", "()"))
LINK = re.compile(rf"(?P<image>!?)\[(?P<text>[^\]]*)\]\(\s*(?P<target>\<[^>]*\>|[^)\s]*)(?:\s+(?:{_TITLE}))?\s*\)")
DOTTED = "[0-9]+(?:[.][0-9]+)*"
SECTION = re.compile(rf"§?\s*(?P<number>{DOTTED})[.]?(?:\s|\Z)")
_TICKS = re.compile(r"`+")
_REF = re.compile(rf"§\s*({DOTTED})")
_GAP = re.compile(r"[\s의,(\[「]*\Z")
_ENUM = re.compile(r"[\s·,、/및와과]*\Z")
_OPENING = ",([「'\""
_WORD = "-+./ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_NOTE_STOP = re.compile(r"\s{,3}#{1,6}(?:\s|\Z)")
MULTIPLE = re.compile(r"overlap|double[\s-]?count|multiple\s+assignment|(?:다중|복수)\s*배정|중복\s*(?:계상|배정|집계|포함)", re.I)
ELISION = re.compile(r"excerpt|partial\s+list|abridged|생략(?!\s*없)|발췌|주요\s*항목만|일부만", re.I)


def _kept(c: str) -> bool:
    return c.isalpha() or c.isnumeric() or c.isspace() or c in "_-"


def slugify(text: str) -> str:
    return re.sub(r"\s+", "-", "".join(c for c in text.strip().lower() if _kept(c)))


def section_number(text: str) -> str | None:
    m = SECTION.match(text.strip())
    return m["number"] if m else None


@functools.lru_cache(4096)
def titled(rest: str) -> tuple[str, str, str | None]:
    """The title after a heading's marks, its slug and its section number."""
    title = re.sub(r"\s+#+\s*\Z", "", rest.strip()).strip()
    return title, slugify(title), section_number(title)


def _ended(text: str, more: str) -> str:
    """text without white space and letters of more at its end."""
    while text and (text[-1].isspace() or text[-1] in more):
        text = text.rstrip().rstrip(more)
    return text


def said_before(text: str) -> tuple[str, str | None, str | None]:
    """What a reference may go by: the text before it, that without a particle (null: no
    other), and a name with digits at its end."""
    one = _ended(text, _OPENING)
    two = _ended(one[:-1], _OPENING) if one.endswith("의") else None
    t = _ended(text, "의,")
    name = t[len(t.rstrip(_WORD)) :].lstrip("-+./")
    return one, two, name if any(c in "0123456789" for c in name) else None


def split_cells(raw: str) -> list[str]:
    """The cells of a table line; an escaped pipe is a letter."""
    line = raw.strip()
    cells = [c.replace("\0", "|") for c in line.replace("\\|", "\0").split("|")]
    if len(cells) > 1 and line.startswith("|") and not cells[0].strip():
        cells = cells[1:]
    if len(cells) > 1 and line.endswith("|") and not cells[-1].strip():
        cells = cells[:-1]
    return [c.strip() for c in cells]


def alignment(cell: str) -> str | None:
    left, right = cell.startswith(":"), cell.endswith(":")
    return "center" if left and right else "right" if right else "left" if left else None


def find_spans(raw: str, line: int) -> list[dict]:
    runs = [(m.start(), len(m.group())) for m in _TICKS.finditer(raw)]
    out, i = [], 0
    while i < len(runs):
        at, size = runs[i]
        j = next((j for j in range(i + 1, len(runs)) if runs[j][1] == size), None)
        if j is None:
            i += 1
            continue
        end = runs[j][0] + size
        out.append({"line": line, "col": at + 1, "end_col": end, "backticks": size, "text": raw[at + size : runs[j][0]].strip(), "raw": raw[at:end]})
        i = j + 1
    return out


def overlaps(spans: list[dict], start: int, end: int) -> bool:
    return any(start < s["end_col"] and end > s["col"] - 1 for s in spans)


def table_note(lines: list[str], fenced: list[bool], first: int, last: int, quote: int = 200) -> tuple[str, int | None, str | None]:
    """What a caption or the notes under a table say about its sums: kind, line and quote."""
    notes = []
    for n in range(first - 1, max(0, first - 3), -1):
        text = lines[n - 1].strip()
        if text:
            if not _NOTE_STOP.match(text) and "|" not in text:
                notes.append((n, text))
            break
    under = 0
    for n in range(last + 1, last + 6):
        if under == 3 or (n <= len(lines) and fenced[n - 1]):
            break
        text = lines[n - 1].strip() if n <= len(lines) else ""
        if not text:
            continue
        if _NOTE_STOP.match(text) or "|" in text:
            break
        notes.append((n, text))
        under += 1
    cut = lambda t: t if len(t) <= quote else t[: quote - 1] + "…"
    for kind, pattern in (("multi-assignment", MULTIPLE), ("elision", ELISION), ("other-note", re.compile(""))):
        for n, text in notes:
            if pattern.search(text):
                return kind, n, cut(text)
    return "none", None, None


PIECE = 2048
_AHEAD = 6  # lines that the end of a table looks at


class Parser:
    """The parts of one document, line by line: what it holds is bounded, however long the
    document. out takes the rows of the wanted parts, in the order of TYPES' fields."""

    def __init__(self, out: dict[str, list]):
        self.out = out
        self.raw: list[str] = []  # lines from before the one at hand to those ahead
        self.info: list[str | None] = []
        self.base = self.at = 0  # lines let go, and the place of the next one
        self.fence: dict | None = None
        self.closed: list[tuple] = []
        self.table: dict | None = None
        self.seen: dict[str, int] = {}
        self.open: list[list] = []
        self.groups: dict[tuple, tuple] = {}
        self.wants_tables = any(k in out for k in ("lines", "tables", "table_rows"))

    def add(self, kind: str, row) -> None:
        if kind in self.out:
            self.out[kind].append(row)

    def feed(self, lines: list[str]) -> None:
        """Takes lines, of which fences are told apart at once."""
        n = self.base + len(self.raw)
        for raw in lines:
            n += 1
            info = self.fence["info"] if self.fence else None
            if ("```" in raw or "~~~" in raw) and (m := FENCE.match(raw)):
                marker, rest = m["marker"], m["info"].strip()
                if self.fence is None:
                    if marker[0] == "~" or "`" not in rest:
                        self.fence, info = {"start": n, "marker": marker, "info": rest}, rest
                elif marker[0] == self.fence["marker"][0] and len(marker) >= len(self.fence["marker"]) and not rest:
                    self.closed.append((self.fence["start"], n, self.fence["marker"], self.fence["info"], True))
                    self.fence = None
            self.raw.append(raw)
            self.info.append(info)

    def advance(self, last: bool = False) -> None:
        """Parses all lines that have enough lines after them: all, after the last one."""
        stop = len(self.raw) if last else len(self.raw) - _AHEAD
        while self.at < stop:
            self.line(self.at)
            self.at += 1
        for f in self.closed:
            self.add("fences", f)
        self.closed.clear()
        if last:
            if self.table:
                self.end_table(self.at)
            if self.fence:
                self.add("fences", (self.fence["start"], self.base + len(self.raw), self.fence["marker"], self.fence["info"], False))
            self.close(0, self.base + len(self.raw))
        gone = self.at - 3
        if gone > 0:
            del self.raw[:gone], self.info[:gone]
            self.base, self.at = self.base + gone, 3

    def close(self, level: int, end: int) -> None:
        while self.open and self.open[-1][0] >= level:
            h = self.open.pop()
            h[-1] = end
            self.add("headings", h)

    def line(self, i: int) -> None:
        raw, info = self.raw[i], self.info[i]
        n, fenced = self.base + i + 1, info is not None
        spans, links, section = [], [], None
        if "`" in raw:
            for s in (spans := find_spans(raw, n)):
                self.add("code_spans", tuple(s.values()))
        if not fenced:
            if "#" in raw and (m := HEADING.match(raw)):
                level, (title, base, section) = len(m["marks"]), titled(m["rest"])
                k = self.seen[base] = self.seen.get(base, -1) + 1
                # a section ends before the next heading of its level or a higher one
                self.close(level, n - 1)
                self.open.append([level, title, n, base if not k else f"{base}-{k}", section, raw, None])
            if "](" in raw:
                for m in LINK.finditer(raw):
                    if not overlaps(spans, m.start(), m.end()):
                        target = m["target"]
                        links.append((n, m.start() + 1, m["text"], target[1:-1] if target.startswith("<") else target, m["image"] == "!", m.group()))
                        self.add("links", links[-1])
            if "§" in raw and "refs" in self.out:
                self.refs(raw, n, spans, links, section)
        if self.wants_tables:
            in_table, header = self.in_table(i, n, raw, fenced)
            self.add("lines", (n, raw, fenced, info, in_table, header))

    def in_table(self, i: int, n: int, raw: str, fenced: bool) -> tuple[bool, bool]:
        """Whether a line is in a table and in its header."""
        t = self.table
        if t:
            if n == t["first"] + 1:
                return True, True
            if not fenced and "|" in raw and raw.strip() and not HEADING.match(raw):
                self.add("table_rows", (t["first"], n, raw, split_cells(raw)))
                return True, False
            self.end_table(i)
        if fenced or "|" not in raw or i + 1 >= len(self.raw) or self.info[i + 1] is not None or "-" not in self.raw[i + 1]:
            return False, False
        cells, marks = split_cells(raw), split_cells(self.raw[i + 1])
        if len(cells) != len(marks) or not all(DELIMITER.match(c) for c in marks):
            return False, False
        self.table = {"first": n, "cells": cells, "marks": [alignment(c) for c in marks], "before": self.raw[max(0, i - 2) : i]}
        return True, True

    def end_table(self, i: int) -> None:
        """Adds the table that ends before place i."""
        t, self.table = self.table, None
        first, last, before = t["first"], self.base + i, t["before"]
        own = len(before) + 1
        after, infos = self.raw[i : i + 5], self.info[i : i + 5]
        kind, note, quote = table_note([*before, "|", *after], [False] * own + [x is not None for x in infos], own, own)
        if note is not None:
            note += last - own if note > own else first - own
        self.add("tables", (first, first + 1, last, t["cells"], t["marks"], len(t["cells"]), kind, note, quote))

    def refs(self, raw: str, n: int, spans: list[dict], links: list[tuple], section: str | None) -> None:
        end = group = None
        for k, m in enumerate(_REF.finditer(raw)):
            start = m.start()
            if overlaps(spans, start, m.end()) or (k == 0 and section == m.group(1)):
                continue
            if end is None or not _ENUM.match(raw, end, start):
                link = next((y[1] for y in links if y[1] - 1 + len(y[5]) <= start and _GAP.match(raw, y[1] - 1 + len(y[5]), start)), None)
                if link is not None:
                    group = (n, start, link, None, None, None, [], [], [])
                    self.out["refs"].append(group)
                else:
                    before = raw[:start]
                    group = self.groups.get(before)
                    if group is None:
                        group = self.groups[before] = (n, start, None, *said_before(before), [], [], [])
                        self.out["refs"].append(group)
            end = m.end()
            group[6].append(n)
            group[7].append(start)
            group[8].append(m.group(1))


def parse_markdown(text: str) -> dict:
    """All parts of a document, as lists of dicts."""
    out: dict[str, list] = {k: [] for k in TYPES}
    p = Parser(out)
    p.feed(LINE_END.split(text))
    p.advance(last=True)
    out["headings"].sort(key=lambda h: h[2])
    return {k: [dict(zip([n for n, _ in TYPES[k]], row, strict=True)) for row in rows] for k, rows in out.items()}


_S, _I, _B = pa.string(), pa.int32(), pa.bool_()
TYPES = {
    "lines": [("line", _I), ("raw", _S), ("in_fence", _B), ("fence_info", _S), ("in_table", _B), ("table_header", _B)],
    "fences": [("start", _I), ("end", _I), ("marker", _S), ("info", _S), ("closed", _B)],
    "headings": [("level", _I), ("text", _S), ("line", _I), ("anchor", _S), ("section", _S), ("raw", _S), ("end", _I)],
    "tables": [("table_line", _I), ("delimiter_line", _I), ("end_line", _I), ("header", pa.list_(_S)), ("alignments", pa.list_(_S)), ("n_columns", _I), ("note_kind", _S), ("note_line", _I), ("note_quote", _S)],
    "table_rows": [("table_line", _I), ("line", _I), ("raw", _S), ("cells", pa.list_(_S))],
    "links": [("line", _I), ("col", _I), ("text", _S), ("target", _S), ("is_image", _B), ("raw", _S)],
    "code_spans": [("line", _I), ("col", _I), ("end_col", _I), ("backticks", _I), ("text", _S), ("raw", _S)],
    "refs": [("line", _I), ("pos", _I), ("link_col", _I), ("one", _S), ("two", _S), ("foreign", _S), ("lines", pa.list_(_I)), ("places", pa.list_(_I)), ("sections", pa.list_(_S))],
}
_DDL = {_S: "string", _I: "int", _B: "boolean", pa.list_(_S): "array<string>", pa.list_(_I): "array<int>"}
SCHEMA = {k: f"{k} array<struct<{', '.join(f'{n}: {_DDL[t]}' for n, t in v)}>>" for k, v in TYPES.items()}


class _Sink:
    """Rows of nested parts, as columns."""

    def __init__(self, parts: tuple[str, ...]):
        self.out: dict[str, list] = {k: [] for k in parts}
        self.ends = {k: [0] for k in parts}

    def end(self) -> None:
        """Ends a row."""
        for k, rows in self.out.items():
            if k == "headings":
                rows[self.ends[k][-1] :] = sorted(rows[self.ends[k][-1] :], key=lambda h: h[2])
            self.ends[k].append(len(rows))

    def columns(self) -> list[pa.Array]:
        """All rows, which are let go."""
        out = []
        for k, rows in self.out.items():
            fields = zip(*rows, strict=True) if rows else [()] * len(TYPES[k])
            flat = pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(fields, TYPES[k], strict=True)], fields=[pa.field(n, t) for n, t in TYPES[k]])
            out.append(pa.ListArray.from_arrays(pa.array(self.ends[k], pa.int32()), flat))
            rows.clear()
            self.ends[k] = [0]
        return out


def parsed(docs: DataFrame, portion: int = 256) -> DataFrame:
    """docs (path, text, frozen) as path, frozen and the nested parts. portion: documents in a batch of results."""

    def parse(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, portion):
                part = batch.slice(first, portion)
                sink = _Sink(tuple(TYPES))
                for t in part.column(2).to_pylist():
                    p = Parser(sink.out)
                    p.feed(LINE_END.split(t or ""))
                    p.advance(last=True)
                    sink.end()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *sink.columns()], ["path", "frozen", *TYPES])

    rows = docs.select("path", (F.col("frozen") if "frozen" in docs.columns else F.lit(False)).alias("frozen"), "text")
    return rows.mapInArrow(parse, f"path string, frozen boolean, {', '.join(SCHEMA.values())}")


def parsed_lines(rows: DataFrame, parts: tuple[str, ...] = tuple(TYPES), size: int = PIECE) -> DataFrame:
    """Documents given as rows (path, o, line), in the order of o and line: path, frozen,
    piece and the wanted parts. A document is one row for about size lines, numbered by
    piece from 0, so that no document is ever whole in memory; documents() has each once.
    Null lines count as none; line ends in a line divide it."""

    def run(batches):
        sink, paths, pieces, weight = _Sink(parts), [], [], 0
        none = object()
        path, p, piece, held, fed = none, None, 0, None, 0

        def cut(last: bool) -> None:
            nonlocal piece
            p.advance(last)
            p.groups.clear()
            sink.end()
            paths.append(path)
            pieces.append(piece)
            piece += 1

        def finish() -> None:
            p.feed(LINE_END.split(held or ""))
            cut(True)

        def batch_of() -> pa.RecordBatch:
            n = len(paths)
            out = pa.RecordBatch.from_arrays([pa.array(paths, _S), pa.array([False] * n, _B), pa.array(pieces, _I), *sink.columns()], ["path", "frozen", "piece", *parts])
            paths.clear()
            pieces.clear()
            return out

        for batch in batches:
            all_paths, all_lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            i, n = 0, len(all_paths)
            while i < n:
                at, j = all_paths[i], i + 1
                while j < n and j - i < size and all_paths[j] == at:
                    j += 1
                if path is none or at != path:
                    if path is not none:
                        finish()
                    path, p, piece, held, fed = at, Parser(sink.out), 0, None, 0
                some = [x for x in ([held] if held is not None else []) + all_lines[i:j] if x is not None]
                if some:
                    # the last line is held, as what follows it may belong to its end
                    held = some.pop()
                    whole = "\n".join(some)
                    if some and ("\r" in whole or whole.count("\n") != len(some) - 1):
                        some = LINE_END.split(whole + "\n")[:-1]
                    p.feed(some)
                    fed += len(some)
                    if fed >= size:
                        cut(False)
                        fed = 0
                weight, i = weight + j - i, j
                if weight >= 4 * size and paths:
                    yield batch_of()
                    weight = 0
        if path is not none:
            finish()
        if paths:
            yield batch_of()

    sorted_ = rows.select("path", "o", "line").repartition("path").sortWithinPartitions("path", "o", "line").select("path", "line")
    return sorted_.mapInArrow(run, f"path string, frozen boolean, piece int, {', '.join(SCHEMA[k] for k in parts)}")


def documents(docs: DataFrame) -> DataFrame:
    """A row for each document of parsed() or parsed_lines()."""
    return docs.where("piece = 0") if "piece" in docs.columns else docs


def view(docs: DataFrame, part: str) -> DataFrame:
    """A part of parsed() as rows: path, frozen, and its fields. Other parts are not read."""
    return docs.select("path", "frozen", F.explode(part).alias("x")).select("path", "frozen", "x.*")


def lines(docs: DataFrame) -> DataFrame:
    return view(docs, "lines")


def headings(docs: DataFrame) -> DataFrame:
    """With end, the last line of the section: before the next heading of the same level or a higher one."""
    return view(docs, "headings")


def table_cells(docs: DataFrame) -> DataFrame:
    """path, table_line, line, col_idx (from 0) and cell."""
    return view(docs, "table_rows").select("path", "frozen", "table_line", "line", F.posexplode("cells").alias("col_idx", "cell"))


def section_start(line, heads):
    """The line of the last heading up to a line, or 1: the innermost section."""
    return F.coalesce(F.array_max(F.filter(F.transform(heads, lambda h: h["line"]), lambda n: n <= line)), F.lit(1))
