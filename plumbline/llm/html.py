"""HTML extraction by union-free regular-expression inference.

A page is a stream of tags and texts. Pages of one host are aligned one after
another with the host's wrapper, a regular expression without unions: where two
streams disagree in a text there is a slot; an element of any size that follows itself
becomes a repeated group, from the innermost outwards, in all pages of the host once
any page repeats it, so that groups may hold groups; and any other stretch that only
one side has becomes optional. A slot outside repeated groups
whose text is the same on all pages of a host that have it (two at least) belongs to
the template; all other texts are the page's content.

Pages are folded one by one and counted by (host, folded stream), so that a host's
inference sees each distinct stream once, most frequent first, however many pages
the host has.

Tags are known by name and class. Comments, scripts and styles are left out.
Attribute values and broken nesting are no matter. Defined results: html null: text
null. html without text: ''. A url null or without a host: no wrapper (null), all
texts kept. A host's only page keeps all texts. Repeated rows give a row each, and
count as pages. An empty table gives no rows.
"""

from __future__ import annotations

import difflib
import html as entities
import re
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import BROADCAST_ROWS, bounded, column, stored

ORACLE_SQL = None
TEXT = "#"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<([/!?]?)([a-zA-Z][\w:-]*)?([^<>]*)>|([^<]+|<)", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""", re.I)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLANK = re.compile(r"\s+")
_PART = re.compile(r"#|<[^>]*>|\(|\)\+")


def tokens(page: str) -> tuple[list[str], list[str]]:
    """The stream (<name.class>, </name>, <name/> for tags that have no end, TEXT) and the texts."""
    out, texts = [], []
    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            text = _BLANK.sub(" ", entities.unescape(text) if "&" in text else text).strip()
            if text:
                if out and out[-1] == TEXT:
                    texts[-1] += " " + text
                else:
                    out.append(TEXT)
                    texts.append(text)
            continue
        name = m.group(3)
        if not name or m.group(2) in ("!", "?"):
            continue
        name = name.lower()
        if m.group(2) == "/":
            out.append(f"</{name}>")
            continue
        if (rest := m.group(4)) and (c := _CLASS.search(rest)):
            label = f"{name}.{c.group(1)}"
        else:
            label = name
        out.append(f"<{label}/>" if name in _VOID else f"<{label}>")
    return out, texts


def parts(stream: str) -> list[str]:
    """The tokens of a stream that is written in one; a repeated group, ( )+, is one."""
    out, depth, begin = [], 0, 0
    for m in _PART.finditer(stream):
        t = m.group()
        if t == "(":
            begin = begin if depth else m.start()
            depth += 1
        elif t == ")+":
            depth -= 1
            if not depth:
                out.append(stream[begin : m.end()])
        elif not depth:
            out.append(t)
    return out


class Node:
    """A token, or an element or a repeated group with the nodes in it, of the places [start, end) of a stream."""

    __slots__ = ("children", "end", "group", "id", "start", "token")

    def __init__(self, id_: int, start: int, end: int, token: str = "", children: list[Node] | None = None, group: int = -1):
        self.id, self.start, self.end, self.token, self.children, self.group = id_, start, end, token, children, group


class Folder:
    """Folds streams: an element after an equal one, or equal to one that was folded
    before, becomes a repeated group. Elements are equal whose folded insides are."""

    def __init__(self):
        self.ids: dict[Any, int] = {}
        self.inside: dict[str, int] = {}
        self.written: dict[int, str] = {}
        #: The elements that are repeated.
        self.known: set[int] = set()

    def id_of(self, what: Any) -> int:
        return self.ids.setdefault(what, len(self.ids))

    def leaf(self, token: str, at: int) -> Node:
        if not token.startswith("("):
            return Node(self.id_of(token), at, at + 1, token)
        if token not in self.inside:
            (node,) = self.nodes(parts(token[1:-2]), False)
            self.inside[token] = node.id
            self.written[node.id] = token
            self.known.add(node.id)
        return self.group(self.inside[token], at, at + 1)

    def group(self, element: int, start: int, end: int) -> Node:
        return Node(self.id_of(("+", element)), start, end, group=element)

    def added(self, nodes: list[Node], node: Node, whole: bool, fold: bool) -> None:
        """node at the end of nodes, whole if it is an element."""
        if fold and whole:
            last = nodes[-1] if nodes else None
            if last and (last.group == node.id or (last.children is not None and last.id == node.id)):
                self.known.add(node.id)
            if node.id in self.known:
                if node.id not in self.written:
                    self.written[node.id] = "(" + "".join(t for t, _, _ in self.flat([node])) + ")+"
                start = nodes.pop().start if last and (last.group == node.id or last.id == node.id) else node.start
                node = self.group(node.id, start, node.end)
        elif fold and node.group >= 0 and nodes and nodes[-1].id == node.id:
            node = self.group(node.group, nodes.pop().start, node.end)
        nodes.append(node)

    def nodes(self, stream: list[str], fold: bool = True) -> list[Node]:
        """The tree of a stream. Tags without an end, or without a beginning, are by themselves."""
        frames: list[tuple[Node | None, str, list[Node]]] = [(None, "", [])]
        open_: dict[str, int] = {}

        def loosened(above: int) -> None:
            """The frames above one as loose nodes in it."""
            for begin, name, own in frames[above + 1 :]:
                frames[above][2].append(begin)
                frames[above][2].extend(own)
                open_[name] -= 1
            del frames[above + 1 :]

        for at, token in enumerate(stream):
            node = self.leaf(token, at)
            if token.startswith("</"):
                name = token[2:-1]
                if not open_.get(name):
                    frames[-1][2].append(node)
                    continue
                above = next(k for k in range(len(frames) - 1, 0, -1) if frames[k][1] == name)
                loosened(above)
                begin, _, own = frames.pop()
                open_[name] -= 1
                every = [begin, *own, node]
                self.added(frames[-1][2], Node(self.id_of(tuple(x.id for x in every)), begin.start, at + 1, children=every), True, fold)
            elif token.startswith("<") and not token.endswith("/>"):
                name = token[1:-1].split(".")[0]
                frames.append((node, name, []))
                open_[name] = open_.get(name, 0) + 1
            else:
                self.added(frames[-1][2], node, False, fold)
        loosened(0)
        return frames[0][2]

    def flat(self, nodes: list[Node]) -> list[tuple[str, int, int]]:
        """The tokens of nodes, groups in writing, each with the places that it stands for."""
        out, todo = [], nodes[::-1]
        while todo:
            x = todo.pop()
            if x.children is not None:
                todo += x.children[::-1]
            else:
                out.append((self.written[x.group] if x.group >= 0 else x.token, x.start, x.end))
        return out

    def folded(self, stream: list[str]) -> tuple[list[str], list[int]]:
        """The folded stream, and the place in it of each token of the stream."""
        flat = self.flat(self.nodes(stream))
        place = [0] * len(stream)
        for k, (_, start, end) in enumerate(flat):
            place[start:end] = [k] * (end - start)
        return [t for t, _, _ in flat], place


def host_of(url: str | None) -> str | None:
    try:
        return urlsplit(url or "").hostname or None
    except ValueError:
        return None


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, stream (folded, in writing), texts and slots (each text's place in the folded stream)."""

    def parse(batches):
        for batch in batches:
            rows = []
            kept: dict[str, tuple[str, list[int]]] = {}
            for url, page in zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist(), strict=True):
                if page is None:
                    rows.append((host_of(url), None, None, None))
                    continue
                stream, texts = tokens(page)
                plain = "".join(stream)
                if (found := kept.get(plain)) is None:
                    fold, place = Folder().folded(stream)
                    found = kept[plain] = "".join(fold), [place[k] for k, s in enumerate(stream) if s == TEXT]
                rows.append((host_of(url), found[0], texts, found[1]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], ["page_id", "host", "stream", "texts", "slots"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return bounded(pages).select("page_id", "url", "html").mapInArrow(parse, f"page_id {kind}, host string, stream string, texts array<string>, slots array<int>")


class Item:
    """A symbol of a wrapper. option: the number of the optional group it is in, or 0;
    pages: how many have a text there."""

    __slots__ = ("option", "pages", "symbol", "texts")

    def __init__(self, symbol: str, option: int = 0):
        self.symbol, self.option, self.texts, self.pages = symbol, option, set(), 0

    def fixed(self) -> bool:
        """Whether it is a slot whose text belongs to the template."""
        return self.symbol == TEXT and len(self.texts) == 1 and self.pages > 1


def refolded(streams: list[list[str]]) -> list[tuple[list[str], list[int]]]:
    """Each stream folded by what any of them repeats, and the place in it of each of its
    tokens. What is folded makes others equal: this ends when nothing new is repeated."""
    folder, known = Folder(), -1
    while known < len(folder.known):
        known = len(folder.known)
        out = [folder.folded(s) for s in streams]
    return out


def inferred(streams: list[tuple[list[str], dict[int, tuple[int, int]]]], pages: list[int] | None = None) -> tuple[list[Item], list[str], int]:
    """The wrapper of streams (with the least and greatest text hash by slot, and the
    number of their pages, else one each), and for each of them the mask of places that
    hold content."""
    wrapper: list[Item] = []
    options, mapped = 0, []
    for n, ((short, place), (_, hashes)) in enumerate(zip(refolded([s for s, _ in streams]), streams, strict=True)):
        if n == 0:
            wrapper = [Item(s) for s in short]
            items = list(wrapper)
        else:
            items, new = [], []
            for what, a, b, c, d in difflib.SequenceMatcher(None, [x.symbol for x in wrapper], short, autojunk=False).get_opcodes():
                if what == "equal":
                    new += wrapper[a:b]
                    items += wrapper[a:b]
                    continue
                if b > a:
                    # a part of an optional group that is left out by itself becomes one of its own
                    split: dict[int, int] = {}
                    for x in wrapper[a:b]:
                        if x.option not in split:
                            whole = x.option and all(y in wrapper[a:b] for y in wrapper if y.option == x.option)
                            if not whole:
                                options += 1
                            split[x.option] = x.option if whole else options
                    for x in wrapper[a:b]:
                        x.option = split[x.option]
                    new += wrapper[a:b]
                if d > c:
                    options += 1
                    added = [Item(s, options) for s in short[c:d]]
                    new += added
                    items += added
            wrapper = new
        for k, (low, high) in hashes.items():
            items[place[k]].texts |= {low, high}
            items[place[k]].pages += pages[n] if pages else 1
        mapped.append([items[p] for p in place])
    masks = ["".join("0" if x.fixed() else "1" for x in row) for row in mapped]
    return wrapper, masks, len(wrapper)


def shown(wrapper: list[Item]) -> str:
    """The wrapper in writing: #PCDATA for slots, ( )+ and ( )? for groups, text of the template as =."""
    def text(x: Item) -> str:
        return "=" if x.fixed() else x.symbol.replace(TEXT, "#PCDATA")

    out, k = [], 0
    while k < len(wrapper):
        end = k + 1
        while end < len(wrapper) and wrapper[end].option == wrapper[k].option and wrapper[k].option:
            end += 1
        run = "".join(text(x) for x in wrapper[k:end])
        out.append(f"({run})?" if wrapper[k].option else run)
        k = end
    return "".join(out)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, stream, mask, wrapper and pages (of the host), from parsed()."""
    some = pages.where("host IS NOT NULL AND stream IS NOT NULL")
    n = some.groupBy("host", "stream").agg(F.count("*").alias("n"))
    slot = some.select("host", "stream", F.explode(F.arrays_zip("texts", "slots")).alias("t")).select("host", "stream", F.col("t.slots").alias("slot"), F.xxhash64("t.texts").alias("h"))
    slot = slot.groupBy("host", "stream", "slot").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    slot = slot.groupBy("host", "stream").agg(F.collect_list(F.struct("slot", "low", "high")).alias("slots"))

    def infer(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "stream"], ascending=[False, True])
        streams = [(parts(s), {} if t is None else {int(x["slot"]): (x["low"], x["high"]) for x in t}) for s, t in zip(rows["stream"], rows["slots"], strict=True)]
        total = int(rows["n"].sum())
        wrapper, masks, _ = inferred(streams, rows["n"].tolist())
        return pd.DataFrame({"host": key[0], "stream": rows["stream"], "mask": masks, "wrapper": shown(wrapper), "pages": total})

    return n.join(slot, ["host", "stream"], "left").groupBy("host").applyInPandas(infer, "host string, stream string, mask string, wrapper string, pages long")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, host, pages (of the host), wrapper (by its hash; see wrappers()), fields and text of every page."""
    rows = stored(parsed(pages))
    masks = stored(wrappers(rows).withColumn("wrapper", F.md5("wrapper")))
    few = masks.limit(BROADCAST_ROWS // 5 + 1).count() <= BROADCAST_ROWS // 5
    out = rows.join(F.broadcast(masks) if few else masks, ["host", "stream"], "left")
    keep = F.filter("texts", lambda _, k: F.col("mask").isNull() | (F.substring(F.col("mask"), F.get("slots", k) + 1, F.lit(1)) == "1"))
    return out.withColumn("kept", keep).select("page_id", "host", "pages", "wrapper", F.size("kept").alias("fields"), F.array_join("kept", "\n").alias("text"))


def op3_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
