"""Restated facts: what an owning document states, and lines elsewhere that state it again."""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.context import DEFAULTS, RunContext, config_reference
from plumbline.findings import findings_frame, union
from plumbline.operators import markdown as M
from plumbline.operators.base import AxisResult
from plumbline.sources.corpus import Corpus

AXIS = "ownership"
RADIUS, NUMERIC_TOKENS, COVERAGE = 30, 3, 0.5
MIN_NAME, MAX_KEY, MAX_VALUE, MAX_QUOTE = 2, 40, 200, 200
_DEFINITION = re.compile(r"\s{,3}(?:[*+-]|[0-9]+[).])?\s*(?P<mark>__|[*]{2}|`)(?P<name>.{2,80}?)(?P=mark)\s*[:：—–-]\s+(?P<value>\S.*)\Z", re.S)
_ASCII_NAME = re.compile(r"[a-z0-9][-./_ a-z0-9]*\Z")
_SCHEME = re.compile(r"[a-z][-+.a-z0-9]*:", re.I)
_SENTENCE = re.compile(r"[.!?。](?=\s|\Z)")
_SECTION_REF = re.compile(rf"§\s*{M.DOTTED}")
_PLAIN = re.compile(r"\d+(?:\.\d+)?\Z")


def _letter(c: str) -> bool:
    return c.isalpha()


def _word(c: str) -> bool:
    return c.isalpha() or c.isnumeric()


def strip_markup(text: str) -> str:
    return re.sub(r"\*\*|__|`", "", re.sub(r"!?\[([^\]]*)][(][^)]*[)]", r"\1", text)).strip()


def normal(text: str) -> str:
    return re.sub(r"\s+", " ", strip_markup(unicodedata.normalize("NFC", text))).strip().lower()


def without_structure(line: str) -> str:
    """Without a heading's number or a list's."""
    return re.sub(r"\A(\s*)[0-9]+[).]\s+", r"\1", re.sub(rf"\A(\s*#{{1,6}}\s+){M.DOTTED}[.]?\s*", r"\1", line))


def to_number(token: str) -> float | None:
    x = re.sub(r",(?=[0-9]{3}(?![0-9]))", "", token)
    return float(x) if re.match(r"-?", x) and _PLAIN.match(x.lstrip("-")) else None


def _split(text: str, inside) -> list[str]:
    out, now = [], ""
    for c in text:
        if inside(c):
            now += c
        elif now:
            out.append(now)
            now = ""
    return [*out, now] if now else out


def numbers_in(text: str) -> list[float]:
    """Numbers that stand alone, in order: digits within names or ratios are none."""
    out: list[float] = []
    for token in _split(text, lambda c: _word(c) or c in ".,_/:-"):
        if ":" in token or any(map(_letter, token)):
            continue
        for m in re.findall(r"-?[0-9]+(?:[,.][0-9]+)*", token):
            if (v := to_number(m)) is not None and v not in out:
                out.append(v)
    return out


def significant(text: str) -> list[str]:
    return list(dict.fromkeys(t for t in _split(normal(text), lambda c: _word(c) or c == "%") if len(t) >= MIN_NAME))


def contains_name(line: str, name: str) -> bool:
    """Whether a normal line has the name; one of ASCII letters must stand alone."""
    n = normal(name)
    if len(n) < MIN_NAME:
        return False
    if _ASCII_NAME.match(n):
        return re.search(rf"(?<![-./_a-z0-9]){re.escape(n)}(?![-./_a-z0-9])", line) is not None
    return n in line


def _token(c: str) -> bool:
    return _word(c) or c in "._/-"


def value_window(line: str, name: str, radius: int = RADIUS) -> str:
    """What stands around each place of the name: up to radius characters, whole words, the same sentence."""
    n, parts, at = normal(name), [], 0
    while n and (i := line.find(n, at)) >= 0:
        end = i + len(n)
        low, high = max(0, i - radius), min(len(line), end + radius)
        head, tail = line[low:i], line[end:high]
        if low > 0 and head and _token(head[0]):
            k = next((k for k, c in enumerate(head) if not _token(c)), len(head))
            head = head[k:]
        if high < len(line) and tail and _token(tail[-1]):
            k = next((k for k in range(len(tail), 0, -1) if not _token(tail[k - 1])), 0)
            tail = tail[:k]
        if ends := list(_SENTENCE.finditer(head)):
            head = head[ends[-1].start() + 1 :]
        if ends := list(_SENTENCE.finditer(tail)):
            tail = tail[: ends[0].start()]
        parts += [head, tail]
        at = end
    return " ".join(parts)


def without_refs(text: str) -> str:
    return _SECTION_REF.sub(" ", text)


def is_numeric(value: str) -> bool:
    return bool(numbers_in(without_refs(value))) and len(significant(value)) <= NUMERIC_TOKENS


def classify(item: dict, raw: str, columns: set[str] | None = None) -> dict | None:
    """How a line restates an item: match same, different or partial; None if it doesn't.
    columns: the columns of the table that the line is a row of."""
    line = normal(without_structure(raw))
    if not line:
        return None
    named = contains_name(line, item["name"])
    if is_numeric(item["value"]):
        column = item.get("column")
        if not named or (column and (normal(column) not in columns if columns is not None else item.get("cross_tab") and not contains_name(line, column))):
            return None
        window = without_refs(value_window(line, item["name"]))
        subject = [t for t in significant(without_refs(item["value"])) if any(map(_letter, t))]
        if subject and not any(t in window for t in subject):
            return None
        own, found = numbers_in(without_refs(item["value"])), numbers_in(window)
        if not found:
            return None
        return {"match": "same" if all(v in found for v in own) else "different", "owner_values": own, "found_values": found}
    tokens = significant(item["value"])
    if not tokens:
        return None
    missing = [t for t in tokens if t not in line]
    share = (len(tokens) - len(missing)) / len(tokens)
    if not missing:
        return {"match": "same", "coverage": 1.0, "missing_tokens": []}
    if named and share >= COVERAGE:
        return {"match": "partial", "coverage": float(f"{share:.2f}"), "missing_tokens": missing}
    return None


# == owned items


def key_column(rows: list[list[str]], n_columns: int) -> int:
    """The column that tells rows apart: the first if it can, else the first short one that can, else the first."""
    for k in range(max(n_columns, 1)):
        values = [normal(strip_markup(r[k] if k < len(r) else "")) for r in rows]
        if all(values) and len(set(values)) == len(values) and (k == 0 or max(map(len, values), default=0) <= MAX_KEY):
            return k
    return 0


def owned_in(doc: dict, total_labels: list[str]) -> list[dict]:
    """Items of a document: table cells by row name and column, and definitions (**name**: value)."""
    totals = {normal(x) for x in total_labels}
    by_table: dict[int, list[dict]] = {}
    for r in doc["table_rows"]:
        by_table.setdefault(r["table_line"], []).append(r)
    items = []
    for t in doc["tables"]:
        rows, header = by_table.get(t["table_line"], []), t["header"]
        key = key_column([r["cells"] for r in rows], len(header))
        cell = lambda r, k: r["cells"][k] if k < len(r["cells"]) else ""
        measures = [k for k in range(len(header)) if k != key and any(is_numeric(strip_markup(cell(r, k))) for r in rows)]
        for r in rows:
            name = strip_markup(cell(r, key))
            if len(normal(name)) < MIN_NAME or normal(name) in totals:
                continue
            for k, c in enumerate(r["cells"]):
                value = strip_markup(c)
                if k == key or not value or len(value) > MAX_VALUE or not any(map(_word, value)) or normal(value) == normal(name):
                    continue
                column = strip_markup(header[k]) if k < len(header) else ""
                items.append({"kind": "table-row", "name": name, "value": value, "column": column or None, "cross_tab": len(measures) >= 2, "line": r["line"], "quote": r["raw"].strip()[:MAX_QUOTE]})
    for x in doc["lines"]:
        if x["in_table"] or (x["fence_info"] or "").strip():
            continue
        if m := _DEFINITION.match(x["raw"]):
            name, value = strip_markup(m["name"]), strip_markup(m["value"])
            if len(normal(name)) >= MIN_NAME and value and len(value) <= MAX_VALUE:
                items.append({"kind": "definition", "name": name, "value": value, "column": None, "cross_tab": False, "line": x["line"], "quote": x["raw"].strip()[:MAX_QUOTE]})
    return sorted(items, key=lambda i: (i["line"], i["name"]))


ITEM = [("owner", pa.string()), ("seq", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("name_key", pa.string()), ("value", pa.string()), ("column", pa.string()), ("cross_tab", pa.bool_()), ("line", pa.int32()), ("quote", pa.string())]
ITEM_DDL = "owner string, seq int, kind string, name string, name_key string, value string, column string, cross_tab boolean, line int, quote string"


def owned_items(docs: DataFrame, declarations: list[dict], total_labels: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, missing): the items of the declared owners, the first of each (owner,
    column, name), with id, what and hint; and declarations whose owner isn't there."""
    spark = docs.sparkSession
    labels = DEFAULTS["total_row_labels"] if total_labels is None else total_labels
    owners = spark.createDataFrame([(i, d["owner"], d["what"], d.get("hint")) for i, d in enumerate(declarations)], "decl int, owner string, what string, hint string")
    own = docs.join(F.broadcast(owners.select(F.col("owner").alias("path")).distinct()), "path", "left_semi")  # a row for each declaration

    def extract(batches):
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows = []
            for path, lines, tables, table_rows in zip(*cols, strict=True):
                for k, i in enumerate(owned_in({"lines": lines, "tables": tables, "table_rows": table_rows}, labels)):
                    rows.append((path, k, i["kind"], i["name"], normal(i["name"]), i["value"], i["column"], i["cross_tab"], i["line"], i["quote"]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(ITEM)], [n for n, _ in ITEM])

    items = own.select("path", "lines", "tables", "table_rows").mapInArrow(extract, ITEM_DDL).join(owners, "owner")
    w = Window.partitionBy("owner", F.coalesce("column", F.lit("")), "name_key").orderBy("decl", "seq")
    items = items.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    items = items.withColumn("id", F.xxhash64("owner", F.coalesce("column", F.lit("")), "name_key"))
    missing = owners.join(docs.select(F.col("path").alias("owner")), "owner", "left_anti")
    return items, missing


# == restatements


def _key(path: str) -> str:
    return re.sub(r"\.(md|markdown)\Z", "", path.rsplit("/", 1)[-1], flags=re.I).lower()


def links_to(target: str, base: str, owner: str) -> bool:
    """Whether a link of the document base points to owner, by path or by an id that ends in its name."""
    if not target:
        return False
    path, _, fragment = target.partition("#")
    to = None
    if path and not _SCHEME.match(path):
        parts: list[str] = []
        for s in (base.rsplit("/", 1)[0] + "/" if "/" in base else "").split("/") + path.split("/"):
            if s == "..":
                parts = parts[:-1]
            elif s not in ("", "."):
                parts.append(s)
        to = "/".join(parts)
    if to and to.lower() == owner.lower():
        return True
    ref = fragment if not path else to
    if not ref or ("/" not in ref and not path):
        return False
    return _key(ref) == _key(owner)


class Matcher:
    """Items by a word that any line that restates them must have."""

    def __init__(self, items: list[dict]):
        self.items, self.every = items, []
        words: dict[str, list[int]] = {}
        for k, i in enumerate(items):
            if is_numeric(i["value"]):
                words.setdefault(normal(i["name"]), []).append(k)
            else:
                # restated in full a line has all words of the value, in part it has the name
                tokens = significant(i["value"])
                if tokens:
                    words.setdefault(max(tokens, key=len), []).append(k)
                    words.setdefault(normal(i["name"]), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, own in words.items():
            if word:
                self.automaton.add_word(word, tuple(own))
        if len(self.automaton):
            self.automaton.make_automaton()

    def near(self, line: str) -> list[int]:
        return sorted({k for _, own in self.automaton.iter(line) for k in own}) if len(self.automaton) else []


RESTATED = "id long, path string, line int, quote string, match string, coverage double, missing_tokens array<string>, found_values array<double>, owner_values array<double>, cited boolean"


def restatements(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each line of another document that restates an item: RESTATED. cited:
    whether the line's section links to the owner. Each line is compared with the items
    that share a word with it, found by one automaton over all names and values."""
    # declared owners' items: their number follows the declarations, not the corpus
    rows = [x.asDict() for x in items.select("id", "owner", "name", "value", "column", "cross_tab").orderBy("owner", "id").collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_()]
    names = [f.split()[0] for f in RESTATED.split(", ")]

    def scan(batches):
        matcher = Matcher(held.value)
        for batch in batches:
            out = []
            for path, lines, tables, table_rows, heads, links in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                header = {t["table_line"]: {n for c in t["header"] if (n := normal(c))} for t in tables}
                columns = {r["line"]: header[r["table_line"]] for r in table_rows}
                starts = [h["line"] for h in heads]
                for x in lines:
                    if (x["fence_info"] or "").strip():
                        continue
                    raw, n = x["raw"], x["line"]
                    for k in matcher.near(normal(without_structure(raw))):
                        item = matcher.items[k]
                        if item["owner"] == path or not (v := classify(item, raw, columns.get(n))):
                            continue
                        start = max((s for s in starts if s <= n), default=1)
                        end = min((s for s in starts if s > start), default=1 << 30)
                        cited = any(start <= y["line"] < end and links_to(y["target"], path, item["owner"]) for y in links)
                        out.append((item["id"], path, n, raw.strip()[:MAX_QUOTE], v["match"], v.get("coverage"), v.get("missing_tokens"), v.get("found_values"), v.get("owner_values"), cited))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    return docs.select("path", "lines", "tables", "table_rows", "headings", "links").mapInArrow(scan, RESTATED)


def grouped(items: DataFrame, lines: DataFrame) -> DataFrame:
    """items with drifted (lines with other numbers) and restated (full copies that cite nobody, and partial ones)."""
    place = F.struct("path", "line", "quote", "match", "coverage", "missing_tokens", "found_values", "owner_values")
    drift = F.array_sort(F.collect_list(F.when(F.col("match") == "different", place)))
    again = F.array_sort(F.collect_list(F.when((F.col("match") == "partial") | ((F.col("match") == "same") & ~F.col("cited")), place)))
    per = lines.groupBy("id").agg(drift.alias("drifted"), again.alias("restated")).where("size(drifted) > 0 OR size(restated) > 0")
    return items.join(per, "id")


def run_axis(context: RunContext, corpus: Corpus, docs: DataFrame) -> AxisResult:
    spark: SparkSession = docs.sparkSession
    config = context.config
    items, missing = owned_items(docs, config["ownership"], (config.get("numbers") or {}).get("total_row_labels"))
    items = items.persist()
    rows = grouped(items, restatements(docs.where("NOT frozen"), items)).persist()
    place = lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["quote"].alias("quote"))
    show = lambda v: F.array_join(F.transform(v, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ", ")
    first = F.get("drifted", F.lit(0))
    owner = F.struct(F.col("owner").alias("file"), F.col("line"), F.col("quote"))
    bad = rows.where("size(drifted) > 0")
    item = F.struct("name", "value", "kind", "column", "line")
    detail = F.transform("drifted", lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["owner_values"].alias("owner_values"), p["found_values"].alias("found_values")))
    dup = lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["quote"].alias("quote"), p["match"].alias("value_match"), p["coverage"].alias("coverage"), p["missing_tokens"].alias("missing_tokens"), p["found_values"].alias("found_values"), p["owner_values"].alias("owner_values"))
    payload = F.to_json(F.struct("what", F.col("owner").alias("owner_doc"), item.alias("item"), F.lit(True).alias("already_drifted"), F.transform(F.concat("drifted", "restated"), dup).alias("duplicate_locations"), detail.alias("drift_detail")))
    message = F.format_string("%s:%d states \"%s\" as %s, but %s:%d as %s (%d of %d copies differ)", "owner", "line", "name", "value", first["path"], first["line"], show(first["found_values"]), F.size("drifted"), F.size("drifted") + F.size("restated"))
    order = [F.lit("2"), F.lpad(F.col("decl").cast("string"), 6, "0"), F.lpad(F.col("seq").cast("string"), 6, "0")]
    found = [findings_frame(bad, AXIS, "ownership.drifted-copy", "block", message, F.concat(F.transform("drifted", place), F.array(owner)), payload, order)]
    said = F.format_string("\"what\": %s, \"owner\": %s", F.to_json(F.array("what")), F.to_json(F.array("owner")))
    where = F.array(F.struct(F.lit(config_reference(context)).alias("file"), F.lit(None).cast("int").alias("line"), said.alias("quote")))
    found.append(findings_frame(missing, AXIS, "ownership.owner-missing", "block", F.format_string("the owner %s of \"%s\" is not in the corpus, so nothing of it is checked", "owner", "what"), where, F.to_json(F.struct("what", F.col("owner").alias("owner_doc"))), [F.lit("1"), F.lpad(F.col("decl").cast("string"), 6, "0")]))
    body = F.struct(F.lit(AXIS).alias("axis"), "what", F.col("owner").alias("owner_doc"), "hint", F.struct("name", "value", "kind", "column", "line", "quote").alias("item"), F.transform("restated", dup).alias("duplicate_locations"), F.transform("drifted", dup).alias("already_drifted_locations"), F.lit("states an owned value again without a link to the owner").alias("why"))
    candidates = rows.where("size(restated) > 0").select(F.lit("restatement").alias("kind"), F.to_json(body).alias("candidate"))
    return AxisResult(AXIS, union(found), candidates, corpus.excluded, corpus.scanned)
