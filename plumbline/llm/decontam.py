"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance.

A document is contaminated with an item if some window of its words lies within
floor(EDITS * n) word edits of the item's n words. The CGK random walk reads a
sequence of words: at step j it writes the word under it and moves on if a random
function of (j, word) says so; steps past the end write a blank. A pair at edit
distance k then has Hamming distance of O(k**2), most often of a few k, between
its walks. Each of several walks is hashed by BITS sampled places (fewer where so many
would seldom agree), and windows that share a hash with an item are verified by their
edit distance.

Windows: of a match, k edits leave one of k + 1 parts of the item whole. A window
that holds none of the item's shortest such runs (of q words, q = n // (k + 1)) in
its place, give or take k words, is therefore no match, and is not embedded: this
leaves out no match. Every other window of every document is, whatever its place.
A walk sees the window's words from its start on, and reads on past the item's
size, so that a window stands for all lengths from n - k to n + k at once.

Recall: walks and bits follow from RECALL, for pairs at the largest distance and for
each class of item sizes by itself, as measured on the items (see planned()).

Items are held and sent in blocks of ITEMS words, each of which is a search of all
documents, so that what is sent has a bound whatever the benchmark's size.

Defined results: null text or item, item without a word: no match. An item of fewer
than LEAST words is looked for as it is, without edits; contaminated() tells it, but
clean() leaves documents that hold nothing more, as it can't be told from common
phrases. Repeated items are all reported; repeated rows of a document each give their
rows. Empty tables: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import U64, Table, Words, bounded, chunks, column, documents, mixed

EDITS, LEAST = 0.2, 8
BITS, RECALL = 3, 0.99
#: Words of the items searched for at once, and walks of a window at most where that reaches RECALL.
ITEMS, WALKS, MARGIN = 2_000_000, 64, 1.6
ORACLE_SQL = None


def budget(n: int) -> int:
    return int(EDITS * n) if n >= LEAST else 0


def size_class(n: int) -> int:
    """Sizes within a quarter of each other share a class."""
    return int(np.log(n) / np.log(1.25))


def seed(walk: np.ndarray, block: int) -> np.ndarray:
    return mixed(walk.astype(np.uint64) * U64(1000003) + U64(block + 1))


def walked(words: np.ndarray, start: np.ndarray, stop: np.ndarray, walk: np.ndarray, steps: int) -> np.ndarray:
    """The words written at each step by each walk (of its own random functions) from its start; 0 past its stop."""
    out = np.zeros((steps, len(start)), np.uint64)
    at, last = start.copy(), np.maximum(stop - 1, 0)
    for j in range(steps):
        if j % 64 == 0:
            own = seed(walk, j // 64)
        inside = at < stop
        read = words[np.minimum(at, last)]
        np.copyto(out[j], read, where=inside)
        at += ((mixed(read ^ own) >> U64(j % 64)) & U64(1)).astype(np.int64) * inside
    return out


@lru_cache(100_000)
def sampled(n: int, walk: int) -> np.ndarray:
    """The steps that an item of n words is hashed by in a walk: any of the first
    2 * (n - k), in which a walk over n - k words seldom comes to their end."""
    most = 2 * max(n - budget(n), 1)
    rng = np.random.default_rng([n, walk])
    return rng.choice(most, BITS, replace=most < BITS)


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    row = np.arange(len(b) + 1)
    steps = np.arange(len(b) + 1)
    for x in a:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def best_part(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to any part of text, and that part's start and length:
    of parts as near, one that ends first and is shortest."""
    n = len(text)
    index = np.arange(n + 1)
    step = n + 1
    key = n - index  # edits * step + n - start
    for x in item:
        new = np.empty_like(key)
        new[0] = key[0] + step
        new[1:] = np.minimum(key[1:] + step, key[:-1] + np.where(text == x, 0, step))
        key = np.minimum.accumulate(new - index * step) + index * step
    end = int(np.argmin(key // step))
    start = n - int(key[end] % step)
    return int(key[end] // step), start, end - start


class Index:
    """The items by run hash and by walk signature."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids, self.words = [], []
        for key, text in items:
            w = Words([text or ""])
            if len(w.hash):
                self.ids.append(key)
                self.words.append(w.hash)
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.k = np.array([budget(n) for n in self.n], np.int64)
        self.q = self.n // (self.k + 1)
        #: By item size: walks and bits.
        self.plan: dict[int, tuple[int, int]] = self.planned()

    def signed(self, words: np.ndarray, start: np.ndarray, stop: np.ndarray, n: np.ndarray, walk: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Each window's hash by the first bits sampled places in its walk, as a window for items of n words."""
        out = np.empty(len(start), np.uint64)
        size = 20_000
        for a in range(0, len(start), size):
            part = slice(a, a + size)
            both, which = np.unique(np.stack([n[part], walk[part]], 1), axis=0, return_inverse=True)
            steps = np.array([sampled(int(x), int(y)) for x, y in both])[which.ravel()]
            written = walked(words, start[part], stop[part], walk[part], int(steps.max()) + 1)
            h = n[part].astype(np.uint64) * U64(65536) + walk[part].astype(np.uint64)
            for k in range(BITS):
                h = np.where(k < bits[part], mixed(h * U64(0x9FB21C651E98DF25) + written[steps[:, k], np.arange(len(h))]), h)
            out[part] = h
        return out

    def agreements(self, items: np.ndarray, bits: int) -> np.ndarray:
        """Of items and copies at their full budget of edits, amid other words, a row of walks for
        each pair: whether any of a copy's windows agrees, of at most 17 of those that are tried."""
        largest = int(self.n[items].max())
        copies = -(-(192 if largest < 32 else 64 if largest < 100 else 32) // len(items))
        walk = np.arange(WALKS)
        one = np.ones(WALKS, np.int64)
        out = []
        for i in items.tolist():
            n, k = int(self.n[i]), int(self.k[i])
            own = self.signed(self.words[i], 0 * one, n * one, n * one, walk, bits * one)
            for copy in range(copies):
                rng = np.random.default_rng([7, i, copy])
                around = rng.integers(0, 1 << 63, 2 * (n + k), dtype=np.uint64)
                body = np.concatenate([around[:k], edited(self.words[i], k, rng), around[k:]])
                start = np.arange(0, 2 * k + 1, max(1, k // 8))
                many = np.ones(len(start) * WALKS, np.int64)
                signs = self.signed(body, np.repeat(start, WALKS), len(body) * many, n * many, np.tile(walk, len(start)), bits * many)
                out.append((signs.reshape(-1, WALKS) == own).any(0))
        return np.array(out)

    def planned(self) -> dict[int, tuple[int, int]]:
        """Walks and bits by item size. For each class of sizes, measured on copies of up to
        16 of its largest items: the most bits with which RECALL of the copies agree in any of
        WALKS walks, and MARGIN times the first so many walks that reach it."""
        out: dict[int, tuple[int, int]] = {}
        classes: dict[int, list[int]] = {}
        for i, n in enumerate(self.n.tolist()):
            if self.k[i]:
                classes.setdefault(size_class(n), []).append(i)
            else:
                out[n] = (1, BITS)
        for own in classes.values():
            few = np.array(sorted(own, key=lambda i: (-self.n[i], i))[:16])
            for bits in range(BITS, 0, -1):
                found = np.logical_or.accumulate(self.agreements(few, bits), 1).mean(0)
                if found[-1] >= RECALL:
                    break
            walks = int(np.ceil(MARGIN * (np.argmax(found >= RECALL) + 1))) if found[-1] >= RECALL else 4 * WALKS
            out |= {int(self.n[i]): (walks, bits) for i in own}
        return out

    def tried(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows for items of sizes n: (window, walk, bits) of all walks that their sizes take."""
        sizes, which = np.unique(n, return_inverse=True)
        walks, bits = np.array([self.plan[int(x)] for x in sizes], np.int64).reshape(-1, 2)[which.ravel()].T
        window = np.repeat(np.arange(len(n)), walks)
        walk = np.arange(len(window)) - np.repeat(np.cumsum(walks) - walks, walks)
        return window, walk, bits[window]

    def open(self) -> Index:
        runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, w in enumerate(self.words):
            q = int(self.q[i])
            for at in range(len(w) - q + 1):
                h = run_hash(w[at : at + q])
                runs.setdefault((q, h), []).append((i, at))
        self.runs = {}
        for q in sorted({q for q, _ in runs}):
            keys = np.array(sorted(h for x, h in runs if x == q), np.uint64)
            self.runs[q] = (Table(keys), [np.array(runs[q, int(h)], np.int64) for h in keys])
        items, walk, bits = self.tried(self.n)
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        first = np.r_[0, np.cumsum(self.n)][items]
        signs = self.signed(flat, first, first + self.n[items], self.n[items], walk, bits)
        order = np.argsort(signs, kind="stable")
        self.signs, self.signed_items = signs[order], items[order]
        return self


def run_hash(words: np.ndarray) -> int:
    h = np.zeros(1, np.uint64)
    for x in words:
        h = h * U64(0xD6E8FEB86659FD93) + x
    return int(mixed(h)[0])


def edited(words: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """words after k random replacements, insertions and deletions."""
    out = list(words)
    for _ in range(k):
        at, what = int(rng.integers(0, max(len(out), 1))), int(rng.integers(0, 3))
        new = U64(rng.integers(0, 1 << 63))
        if what == 0 and out:
            out[at] = new
        elif what == 1:
            out.insert(at, new)
        elif len(out) > 1:
            out.pop(at)
    return np.array(out, np.uint64)


def windows(w: Words, index: Index) -> dict[int, np.ndarray]:
    """By item size: (item size's) starts of windows that may match an item of that size."""
    out: dict[int, list[np.ndarray]] = {}
    for q, (table, places) in index.runs.items():
        h, at = w.grams(q)
        found = table.at(h)
        some = np.flatnonzero(found >= 0)
        if not len(some):
            continue
        groups: dict[int, list[np.ndarray]] = {}
        order = some[np.argsort(found[some], kind="stable")]
        cut = np.flatnonzero(np.r_[True, np.diff(found[order]) > 0, True])
        for a, b in zip(cut, cut[1:], strict=False):
            here = at[order[a:b]]
            for i, place in places[int(found[order[a]])]:
                k = int(index.k[i])
                groups.setdefault(int(index.n[i]), []).append((here[:, None] - place + np.arange(-k, k + 1)[None, :]).ravel())
        for n, starts in groups.items():
            out.setdefault(n, []).extend(starts)
    good = {}
    for n, starts in out.items():
        s = np.unique(np.concatenate(starts))
        good[n] = s[(s >= 0) & (s < len(w.hash))]
    return good


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, words) of the best part of each matched pair:
    the least distance, then the first, then the shortest."""
    w = Words(texts)
    found = windows(w, index)
    if not found:
        return []
    starts, n = np.concatenate(list(found.values())), np.repeat(list(found), [len(x) for x in found.values()])
    end = w.first[w.text[starts] + 1]
    which, walk, bits = index.tried(n)
    signs = index.signed(w.hash, starts[which], end[which], n[which], walk, bits)
    low, high = np.searchsorted(index.signs, signs), np.searchsorted(index.signs, signs, "right")
    pairs = {(int(w.text[at]), int(i), int(at)) for x in np.flatnonzero(high > low) for at in [starts[which[x]]] for i in index.signed_items[low[x] : high[x]]}
    best: dict[tuple[int, int], tuple[int, int, int]] = {}

    def verify(text: int, i: int, low: int, high: int) -> None:
        """All parts of a text that windows starting from low to high may stand for."""
        n, k = int(index.n[i]), int(index.k[i])
        low, high = max(low - k, int(w.first[text])), min(high + n + 2 * k, int(w.first[text + 1]))
        distance, at, size = best_part(index.words[i], w.hash[low:high])
        if distance <= k:
            new = (distance, low + at - int(w.first[text]), size)
            best[text, i] = min(best.get((text, i), new), new)

    # windows beside each other are verified at once
    open_: tuple[int, int, int, int] | None = None
    for text, i, at in sorted(pairs):
        if open_ and open_[:2] == (text, i) and at <= open_[3] + int(index.n[i]):
            open_ = (text, i, open_[2], at)
            continue
        if open_:
            verify(*open_)
        open_ = (text, i, at, at)
    if open_:
        verify(*open_)
    return [(t, i, *x) for (t, i), x in best.items()]


def blocks_of(benchmark: DataFrame, words: int, least: int = 1) -> Iterator[Index]:
    """The items of least words or more, in indexes of about so many words each."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (4 * words)))
    at = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        items = [(x.item_id, x.text) for x in rows.where(at == k).collect()]
        yield Index([x for x in items if len(Words([x[1]]).hash) >= least])


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = ITEMS) -> DataFrame:
    """doc_id, item_id, edits, first_word and words of the best window of every matched pair."""
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    rows = bounded(docs.where("text IS NOT NULL").select("doc_id", "text"))

    def against(index: Index) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches):
            index = held.value.open()
            for batch in batches:
                ids = column(batch, "doc_id")
                for first, texts in chunks(column(batch, "text").to_pylist()):
                    if rows := matches(texts, index):
                        t, i, edits, at, size = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + x for x in t])), pa.array([index.ids[x] for x in i]), pa.array(edits, pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32())], ["doc_id", "item_id", "edits", "first_word", "words"])

        return rows.mapInArrow(search, f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int, first_word int, words int")

    return reduce(DataFrame.unionByName, map(against, blocks_of(benchmark, words)))


def clean(docs: DataFrame, benchmark: DataFrame, words: int = ITEMS, least: int = LEAST) -> DataFrame:
    """The rows of docs whose text matches no item of least words or more; texts are not shuffled."""
    out = bounded(docs)
    for index in blocks_of(benchmark, words, least):
        out = out.where(passes(docs.sparkSession.sparkContext.broadcast(index))("text"))
    return out


def passes(held):
    @F.pandas_udf("boolean")
    def flag(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = held.value.open()
        for texts in parts:
            out = np.ones(len(texts), bool)
            for first, part in chunks(list(texts)):
                for t, *_ in matches(part, index):
                    out[first + t] = False
            yield pd.Series(out)

    return flag


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
