"""Near-duplicate documents by SetSketch registers.

A document is the set of its runs of GRAM words. Its sketch has REGISTERS values:
register i is 1 - log_B(x) rounded down, and kept within 0 and TOP + 1, for the
least x of independent exponential values (rate A) of the elements. Such registers
merge by their maximum, and two sets agree in one about as often as their Jaccard
similarity. Bands of ROWS registers propose pairs; all registers of a pair
together give the likeliest Jaccard similarity, which drops pairs well under the
threshold; the others are verified on the sets themselves.

In a bucket, which may be as large as it likes, each member is paired with the
first and with the one before it, in the order of ids. Where that doesn't join a
bucket's members into one component, all pairs of its members in different
components are compared too, in tiles of TILE members: so buckets of copies cost in
proportion to their documents, and only buckets of documents that are no copies (they
share a passage) cost their square. The groups are the connected components of
verified pairs. Exact copies (the same words) are put together before, by hash.

Defined results: a null text is in no group. Texts without any word are copies of
each other where they are equal. A text of fewer than GRAM words is the set of its
one run. Rows that share doc_id and text are one document, of which one row stays.
A null doc_id is an id like any other. Of a group the smallest (doc_id, text hash)
stays, a null doc_id before others. An empty table gives no rows.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType

from plumbline.llm.common import U64, Words, bounded, chunks, column, documents, free_name, mixed, stored

GRAM = 3
REGISTERS, ROWS = 128, 4
B, A, TOP = 1.001, 20.0, 65534
THRESHOLD = 0.5
#: Keys of eight bytes that are sent to every executor at most.
KEYS = 8_000_000
#: Members of a bucket that are compared with as many others in one task.
TILE = 1000
#: Pairs are verified from this much under the threshold on: four deviations of the estimate.
MARGIN = 0.18
ORACLE_SQL = None


def element_hashes(w: Words, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Element hashes of all texts of a chunk, with repetitions, and each one's text."""
    h, at = w.grams(gram)
    text = w.text[at]
    few = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < gram))
    if len(few):
        start, end = w.first[few], w.first[few + 1]
        own = np.zeros(len(few), np.uint64)
        for k in range(gram - 1):
            there = start + k < end
            own[there] = own[there] * U64(0xA0761D6478BD642F) + w.hash[start[there] + k]
        h, text = np.concatenate([h, mixed(own)]), np.concatenate([text, few])
        at = np.argsort(text, kind="stable")
        h, text = h[at], text[at]
    return h, text


def seeds(m: int = REGISTERS) -> np.ndarray:
    return mixed(np.arange(1, m + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def registers(h: np.ndarray, text: np.ndarray, size: int, m: int = REGISTERS) -> np.ndarray:
    """Registers (size, m) of the texts 0 to size - 1; 0 where a text has no element."""
    out = np.zeros((size, m), np.uint16)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    low = np.empty((len(first), m), np.float64)
    folded = h ^ (h >> U64(32))
    for i, seed in enumerate(seeds(m)):
        v = folded * seed
        v >>= U64(24)
        low[:, i] = np.minimum.reduceat(v, first)
    x = -np.log1p(-(low + 0.5) / 2.0**40) / A
    out[text[first]] = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP + 1).astype(np.uint16)
    return out


def distinct(h: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """How many different elements each of the texts 0 to size - 1 has."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[new], minlength=size)


def estimated(one: np.ndarray, other: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs, from how many registers are greater
    in one, greater in the other, and equal, given the sizes of the sets."""
    above = (one > other).sum(1)
    below = (one < other).sum(1)
    equal = one.shape[1] - above - below
    n1, n2 = np.maximum(n1, 1).astype(float), np.maximum(n2, 1).astype(float)
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]
    p = lambda x: -np.log1p(-x * (B - 1) / B) / np.log(B)
    with np.errstate(all="ignore"):
        p1 = np.maximum(p(u[:, None] - v[:, None] * grid), 1e-9)
        p2 = np.maximum(p(v[:, None] - u[:, None] * grid), 1e-9)
        p0 = np.maximum(1 - p1 - p2, 1e-9)
    best = np.argmax(above[:, None] * np.log(p1) + below[:, None] * np.log(p2) + equal[:, None] * np.log(p0), 1)
    return grid[np.arange(len(best)), best]


def sketches(docs: DataFrame) -> DataFrame:
    """A row for each document with a text: doc_id, h (hash of the text), words (hash
    of its words), n (distinct elements), sketch (the registers, two bytes each)."""

    def sketch(batches):
        for batch in batches:
            for first, texts in chunks(column(batch, "text").to_pylist()):
                w = Words(texts)
                e, text = element_hashes(w)
                rows = registers(e, text, len(texts))
                n = distinct(e, text, len(texts))
                whole = np.zeros(len(texts), np.uint64)
                if len(w.hash):
                    place = np.arange(len(w.hash)) - w.first[w.text]
                    some = np.flatnonzero(np.diff(w.first) > 0)
                    whole[some] = np.add.reduceat(mixed(w.hash + place.astype(np.uint64) * U64(0x9FB21C651E98DF25)), w.first[some])
                part = batch.slice(first, len(texts))
                flat = pa.array([r.tobytes() for r in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), column(part, "h"), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), flat], ["doc_id", "h", "words", "n", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), "text")
    return bounded(rows).mapInArrow(sketch, f"doc_id {kind}, h long, words long, n long, sketch binary")


def band_keys(rows: int = ROWS):
    @F.pandas_udf("array<long>")
    def keys(sketch: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(sketch), np.uint16).reshape(len(sketch), -1).astype(np.uint64)
        h = np.arange(x.shape[1] // rows, dtype=np.uint64)[None, :] * U64(0x9E3779B97F4A7C15)
        for k in range(rows):
            h = mixed(h ^ x[:, k : x.shape[1] // rows * rows : rows]) if k else mixed(h + x[:, : x.shape[1] // rows * rows : rows])
        return pd.Series(list(h.view(np.int64)))

    return keys


def proposed(unique: DataFrame, rows: int = ROWS) -> DataFrame:
    """Pairs (a, b), a < b, of documents of unique (node, sketch) that share a bucket."""
    banded = unique.select("node", F.explode(band_keys(rows)("sketch")).alias("key"))
    w = Window.partitionBy("key").orderBy("node")
    linked = banded.select("node", F.first("node").over(w).alias("first"), F.lag("node").over(w).alias("last")).where("last IS NOT NULL")
    return linked.select(F.explode(F.array("first", "last")).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()


def unjoined(unique: DataFrame, roots: DataFrame, least: float, rows: int = ROWS) -> DataFrame:
    """Pairs (a, b, estimate), a < b, of documents of unique (node, sketch, n) in different
    components (node and root, of nodes other than roots) that share a bucket, have an
    estimate of least or more."""
    root = roots.select("node", "root")
    drawn = unique.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "sketch", "n")
    drawn = stored(drawn.withColumn("id", F.monotonically_increasing_id()).withColumn("root", F.xxhash64("root")))
    banded = drawn.select("id", "root", F.posexplode(band_keys(rows)("sketch")).alias("band", "key"))
    # all pairs of a bucket of three were proposed
    hot = stored(banded.groupBy("band", "key").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).where("size > 3 AND low <> high").select("band", "key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles")))
    member = banded.join(hot, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    tiles = member.select("band", "key", "own", "id", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiles = tiles.select("band", "key", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id").join(drawn.select("id", "root", "sketch", "n"), "id")

    def compare(key: tuple[Any, ...], part: pd.DataFrame) -> pd.DataFrame:
        band, _, low, high = key
        part = part.sort_values("id")
        sketch = np.frombuffer(b"".join(part["sketch"]), np.uint16).reshape(len(part), -1)
        ids, root, n, own = (part[c].to_numpy() for c in ("id", "root", "n", "own"))
        bands = sketch.shape[1] // rows
        keyed = sketch[:, : bands * rows].reshape(len(part), bands, rows)
        out, told = [np.empty((2, 0), np.int64)], [np.empty(0)]
        for k in np.flatnonzero(own == low):
            some = np.flatnonzero((own == high) & (root != root[k]) & ((ids > ids[k]) | (low != high)))
            # a pair belongs to the first of its buckets
            some = some[~(keyed[some, :band] == keyed[k, :band]).all(2).any(1)]
            for at in range(0, len(some), 2000):
                few = some[at : at + 2000]
                j = estimated(sketch[few].astype(np.int32), sketch[[k]].astype(np.int32), n[few], np.full(len(few), n[k]))
                good = j >= least
                out.append(np.stack([np.full(good.sum(), ids[k]), ids[few[good]]]))
                told.append(j[good])
        x, y = np.concatenate(out, 1)
        return pd.DataFrame({"x": x, "y": y, "estimate": np.concatenate(told)})

    found = tiles.groupBy("band", "key", "x", "y").applyInPandas(compare, "x long, y long, estimate double")
    side = lambda x, y: drawn.select(F.col("id").alias(x), F.col("node").alias(y))
    both = found.join(side("x", "nx"), "x").join(side("y", "ny"), "y")
    return both.select(F.least("nx", "ny").alias("a"), F.greatest("nx", "ny").alias("b"), "estimate")


@F.pandas_udf(DoubleType())
def likeliest(one: pd.Series, other: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    out = [np.empty(0)]
    for k in range(0, len(one), 2000):
        x, y = (np.frombuffer(b"".join(s.iloc[k : k + 2000]), np.uint16).reshape(-1, REGISTERS).astype(np.int32) for s in (one, other))
        out.append(estimated(x, y, n1.iloc[k : k + 2000].to_numpy(), n2.iloc[k : k + 2000].to_numpy()))
    return pd.Series(np.concatenate(out))


@F.pandas_udf(BinaryType())
def element_sets(texts: pd.Series) -> pd.Series:
    """The distinct element hashes of a text, sorted, eight bytes each."""
    out = []
    for _, part in chunks(list(texts)):
        h, text = element_hashes(Words(part))
        cut = np.searchsorted(text, np.arange(len(part) + 1))
        out += [np.unique(h[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def exact_jaccard(one: pd.Series, other: pd.Series) -> pd.Series:
    def of(x: bytes, y: bytes) -> float:
        both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
        if not len(both):
            return 1.0
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return shared / (len(both) - shared)

    return pd.Series([of(x, y) for x, y in zip(one, other, strict=True)], dtype=float)


def node_key(node: Column) -> Column:
    return F.xxhash64(node["doc_id"], node["h"])


def members(keys: DataFrame, most: int = KEYS):
    """A function that tells whether a key may be among keys (wrong about once in 2**40),
    with which rows are sorted out before a join; None for more than most keys, which
    are not to be sent to every executor."""
    spark = keys.sparkSession
    if keys.limit(most + 1).count() > most:
        return None
    held = spark.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()))

    @F.pandas_udf(BooleanType())
    def maybe(key: pd.Series) -> pd.Series:
        all_, own = held.value, key.to_numpy()
        at = np.searchsorted(all_, own)
        return pd.Series(np.r_[all_, 0][at] == own if len(all_) else np.zeros(len(own), bool)) & (at < len(all_))

    return maybe


def exact(docs: DataFrame, close: DataFrame, threshold: float) -> DataFrame:
    """The rows of close (a, b, estimate) whose jaccard is at the threshold or over it, with it."""
    need = close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct()
    hashed = docs.where("text IS NOT NULL").select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("node"), "text")
    maybe = members(need.select(node_key(F.col("node")).alias("key")))
    some = hashed if maybe is None else hashed.where(maybe(node_key(F.col("node"))))
    elements = stored(some.join(need, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")).select("node", element_sets("text").alias("set")))
    side = lambda x: elements.select(F.col("node").alias(x), F.col("set").alias(f"set{x}"))
    both = close.join(side("a"), "a").join(side("b"), "b").withColumn("jaccard", exact_jaccard("seta", "setb"))
    return both.where(F.col("jaccard") >= threshold).select("a", "b", "estimate", "jaccard")


def verified(docs: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(copies, pairs): (a, b) of documents with the same words, and (a, b, estimate,
    jaccard) of others at the threshold or over it. A document is struct(doc_id, h)."""
    node = F.struct("doc_id", "h")
    drawn = stored(sketches(docs).withColumn("node", node).drop("doc_id", "h"))
    # without words: copies only where the texts are equal, that is, one hash
    groups = drawn.groupBy("words", F.when(F.col("n") == 0, F.col("node.h")).alias("blank")).agg(F.min("node").alias("rep"), F.first("sketch").alias("sketch"), F.first("n").alias("n"), F.count("*").alias("size"))
    unique = stored(groups)
    some = unique.where("size > 1").select("words", "blank", "rep")
    kin = drawn.withColumn("blank", F.when(F.col("n") == 0, F.col("node.h")))
    copies = kin.join(some, (kin.words == some.words) & kin.blank.eqNullSafe(some.blank)).where(~F.col("rep").eqNullSafe(F.col("node"))).select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    sets = unique.where("n > 0").select(F.col("rep").alias("node"), "sketch", "n")
    pairs = proposed(sets)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("sketch").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    judged = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("estimate", likeliest("sa", "sb", "na", "nb"))
    close = stored(judged.where(F.col("estimate") >= threshold - MARGIN).select("a", "b", "estimate"))
    first = stored(exact(docs, close, threshold))
    more = stored(unjoined(sets, components(first.select("a", "b")), threshold - MARGIN))
    # pairs that were proposed and failed come again
    return copies, first.unionByName(exact(docs, more.join(close, ["a", "b"], "left_anti"), threshold))


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for every node of edges (a, b)
    other than roots. Alternates large-star and small-star steps until neither changes."""
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("x")).where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()
        new = stored(small)
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = new


def copies_of(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node and root of every document that isn't the one that stays of its group."""
    copies, pairs = verified(docs, threshold)
    return components(copies.unionByName(pairs.select("a", "b")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document that has a near copy which stays, and that one's doc_id."""
    out = copies_of(documents(spark, sf_dir))
    return out.select(F.col("node.doc_id").alias("doc_id"), F.col("root.doc_id").alias("kept_doc_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each group, with docs' own columns, and one row of each document.
    Only rows that may be copies or repeated are shuffled, unless those are very many."""
    gone = stored(copies_of(docs, threshold).select("node"))
    name, other = free_name(docs, "node"), free_name(docs, "gone")
    keyed = docs.withColumn(name, F.when(F.col("text").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h"))))
    again = stored(keyed.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("node")).count().where("count > 1").select("node"))
    maybe = members(gone.union(again).distinct().select(node_key(F.col("node")).alias("key")))
    flag = F.col(name).isNotNull() & (F.lit(True) if maybe is None else maybe(node_key(F.col(name))))
    doubtful = keyed.where(flag).join(gone.select(F.col("node").alias(other)), F.col(name) == F.col(other), "left_anti")
    return keyed.where(~flag).unionByName(doubtful.dropDuplicates([name])).drop(name)
