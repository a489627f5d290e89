"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The index holds at most EXAMPLES labelled documents, half of either kind where
there are enough, taken by a hash of their ids, near copies of each other counted
once (the one bound here: the fit of the classifier). Every word of the examples is
in it. A word's weight is (1 + ln tf) times its document frequency in contrast of
the labels (Delta TF-IDF): |ln| of the ratio of its rates in toxic and other
examples, each rate raised by SMOOTH documents of a kind. Plain inverse frequencies
were tried: invented and rare words then outweigh all others, and neighbours say
little of the label. A word that no example has weighs nothing.

Postings of a word lie in blocks of BLOCK examples. The words that many examples
have are known by the greatest weight in each block, the others' postings are
summed. That bounds each block's cosines: a document's two best blocks are scored
in full, then all whose bound reaches the cosine of its K-th neighbour so far: the K
nearest are exact (ties: first in the index). Their votes are weighted by cosine and
calibrated on the examples themselves, each left out, by isotonic regression at the
labels' own rates.

Every document is scored over its whole text, and one of more than PASSAGE words by each
such passage of it too, as few bad words drown in a long text: the greatest vote counts.
Defined results: text null or without
a word that weighs: the calibrated score of no vote, no evidence. Labels of one kind
only: all words weigh alike. No labels: score null, toxic false. Of a labelled id
with several texts the least one counts. Repeated rows give a row each; an empty
table gives none.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Table, Words, among, bounded, chunks, column, documents, labels
from plumbline.llm.neardup import element_hashes, registers

EXAMPLES, BLOCK, K = 4096, 64, 10
SMOOTH, COPY, FLAG = 4.0, 0.5, 0.5
#: Words that one example in so many has are scored as rows of a matrix, others by their postings.
COMMON = 10
#: Documents scored together, and words of a neighbour told in the evidence.
PORTION, TOLD = 128, 3
PASSAGE = 400
ORACLE_SQL = None


def term_counts(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[int, str]]:
    """Each text's word hashes with their counts, and the words by hash."""
    out, names = [], {}
    for _, part in chunks(texts):
        w = Words(part)
        for k in range(len(part)):
            h = w.hash[w.first[k] : w.first[k + 1]]
            out.append(np.unique(h, return_counts=True))
        u, at = np.unique(w.hash, return_index=True)
        for h, i in zip(u.tolist(), at.tolist(), strict=True):
            names[h] = "".join(map(chr, w.cp[w.start[i] : w.end[i]].tolist()))
    return out, names


def without_copies(texts: list[str]) -> np.ndarray:
    """Indices of texts that are no near copy of an earlier one."""
    rows = []
    for _, part in chunks(texts):
        e, text = element_hashes(Words(part))
        rows.append(registers(e, text, len(part)))
    sketch = np.concatenate(rows) if rows else np.zeros((0, 1), np.uint16)
    keep: list[int] = []
    for k in range(len(sketch)):
        if not keep or (sketch[keep] == sketch[k]).mean(1).max() < COPY:
            keep.append(k)
    return np.array(keep, np.int64)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from, value) of the least-squares non-decreasing function, ties pooled."""
    blocks: list[list[float]] = []
    for v in np.unique(x):
        some = x == v
        blocks.append([v, float((w[some] * y[some]).sum()), float(w[some].sum())])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, a, b = blocks.pop()
            blocks[-1][1] += a
            blocks[-1][2] += b
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges [first, last), and which range each is of."""
    size = last - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) + np.repeat(first - (np.cumsum(size) - size), size), which


class Index:
    """A block-max inverted index of the examples."""

    def __init__(self, ids: list, texts: list[str], toxic: np.ndarray, rates: tuple[float, float]):
        keep = without_copies(texts)
        counts, names = term_counts([texts[k] for k in keep])
        toxic = toxic[keep]
        n1, n0 = int(toxic.sum()), int((~toxic).sum())
        self.keys = np.unique(np.concatenate([u for u, _ in counts] or [np.zeros(0, np.uint64)]))
        self.names = [names[int(h)] for h in self.keys]
        self.table = Table(self.keys)
        size = np.array([len(u) for u, _ in counts], np.int64)
        term = np.searchsorted(self.keys, np.concatenate([u for u, _ in counts] or [np.zeros(0, np.uint64)]))
        many = np.concatenate([c for _, c in counts] or [np.zeros(0, np.int64)])
        bad = np.repeat(toxic, size)
        if n1 and n0:
            more = 2 * SMOOTH / (n1 + n0)
            df1, df0 = (np.bincount(term[x], minlength=len(self.keys)) for x in (bad, ~bad))
            self.weight = np.abs(np.log((df1 / n1 + more) / (df0 / n0 + more)))
        else:
            self.weight = np.ones(len(self.keys))
        x = (1 + np.log(many)) * self.weight[term]
        # blocks of like examples, by label and heaviest word, have bounds that tell more
        cut = np.r_[0, np.cumsum(size)]
        heaviest = np.array([term[a + int(np.argmax(x[a:b]))] if b > a else -1 for a, b in zip(cut, cut[1:], strict=False)], np.int64)
        order = np.lexsort((np.arange(len(keep)), heaviest, toxic))
        self.ids, self.toxic = [ids[keep[k]] for k in order], toxic[order]
        at, row = spread(cut[:-1][order], cut[1:][order])
        self.terms, x = term[at].astype(np.int32), x[at]
        self.first = np.r_[0, np.cumsum(size[order])]
        self.weights = x / np.maximum(np.sqrt(np.bincount(row, x * x, len(keep))), 1e-12)[row]
        self.scratch = np.zeros(len(self.keys))
        self.invert(row)
        own = np.repeat(np.arange(len(keep)), size[order])
        near = self.nearest(own, self.terms, self.weights, len(keep), leave=True)
        votes = np.array([self.vote(*x) for x in near])
        weight = np.where(self.toxic, rates[1] / max(n1, 1), rates[0] / max(n0, 1))
        self.steps = isotonic(votes, self.toxic.astype(float), weight) if len(votes) else (np.zeros(0), np.zeros(0))

    def invert(self, row: np.ndarray) -> None:
        """The postings of each word, in the order of examples; the matrix of common words and its greatest values by block."""
        n = len(self.ids)
        self.blocks = -(-n // BLOCK)
        by = np.argsort(self.terms, kind="stable")
        self.posted = np.searchsorted(self.terms[by], np.arange(len(self.keys) + 1))
        self.examples, self.values = row[by].astype(np.int32), self.weights[by]
        df = np.diff(self.posted)
        common = np.flatnonzero(df * COMMON >= max(n, COMMON * BLOCK))
        self.column = np.full(len(self.keys), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.blocks * BLOCK))
        at, which = spread(self.posted[common], self.posted[common + 1])
        self.matrix[which, self.examples[at]] = self.values[at]
        self.most = self.matrix.reshape(len(common), self.blocks, BLOCK).max(2) if self.blocks else np.zeros((len(common), 0))

    def vectors(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
        """Weights, of unit length by text, of n-fold words of the texts 0 to size - 1."""
        x = (1 + np.log(n)) * self.weight[term]
        return x / np.maximum(np.sqrt(np.bincount(text, x * x, size)), 1e-12)[text]

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, leave: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each of the texts 0 to size - 1 (which are sorted), the K examples of the
        greatest positive cosine, and it. leave: texts are the examples, and none is its own neighbour."""
        out = []
        for low in range(0, size, PORTION):
            high = min(low + PORTION, size)
            a, b = np.searchsorted(text, [low, high])
            out += self.portion(text[a:b] - low, term[a:b], weight[a:b], high - low, low if leave else -1)
        return out

    def portion(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, leave: int) -> list[tuple[np.ndarray, np.ndarray]]:
        width = self.blocks * BLOCK
        common = self.column[term] >= 0
        dense = np.zeros((size, len(self.matrix)))
        dense[text[common], self.column[term[common]]] = weight[common]
        rare = np.flatnonzero(~common)
        at, which = spread(self.posted[term[rare]], self.posted[term[rare] + 1])
        own = rare[which]
        cosines = np.bincount(text[own] * width + self.examples[at], weight[own] * self.values[at], size * width).astype(float).reshape(size, self.blocks, BLOCK)
        bound = dense @ self.most + cosines.max(2, initial=0)

        def finish(need: np.ndarray) -> None:
            for b in np.flatnonzero(need.any(0)):
                some = np.flatnonzero(need[:, b])
                cosines[some, b] += dense[some] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]

        if leave >= 0:
            k = np.arange(size)
            # so low that the rest of it makes no neighbour
            cosines[k, (leave + k) // BLOCK, (leave + k) % BLOCK] = -10.0
        best = np.argsort(-bound, 1, kind="stable")[:, :2]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, best, True, 1)
        finish(first & (bound > 0))
        known = np.take_along_axis(cosines, best[:, :, None], 1).reshape(size, -1)
        floor = np.maximum(np.partition(known, -K, 1)[:, -K], 0) if known.shape[1] >= K else np.zeros(size)
        finish(~first & (bound > 0) & (bound >= floor[:, None] - 1e-8))
        # what isn't finished stays under its bound, which is under the floor
        row, some = np.nonzero(cosines.reshape(size, width) >= np.maximum(floor - 1e-8, 5e-10)[:, None])
        value = np.round(cosines.reshape(size, width)[row, some], 9)
        order = np.lexsort((some, -value, row))
        some, value = some[order], value[order]
        cut = np.searchsorted(row, np.arange(size + 1))
        return [(some[a : min(a + K, b)], value[a : min(a + K, b)]) for a, b in zip(cut, cut[1:], strict=False)]

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines * self.toxic[ids]).sum() / cosines.sum()) if len(ids) else -1.0

    def calibrated(self, vote: float) -> float:
        at, value = self.steps
        return float(value[max(int(np.searchsorted(at, vote, "right")) - 1, 0)]) if len(at) else math.nan

    def evidence(self, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, cosines: np.ndarray) -> str:
        """JSON of the neighbours, each with the words that add most to its cosine."""
        self.scratch[terms] = weights
        out = []
        for e, c in zip(ids.tolist(), cosines.tolist(), strict=True):
            own = slice(self.first[e], self.first[e + 1])
            add = self.scratch[self.terms[own]] * self.weights[own]
            best = np.argpartition(-add, min(TOLD, len(add) - 1))[:TOLD]
            best = best[np.lexsort((best, -add[best]))]
            out.append({"example": self.ids[e], "toxic": bool(self.toxic[e]), "cosine": round(c, 6), "words": [self.names[self.terms[own.start + t]] for t in best if add[t] > 0]})
        self.scratch[terms] = 0
        return json.dumps(out, ensure_ascii=False)

    def queries(self, w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, word, weight), sorted, of the texts 0 to size - 1 and their passages, and
        the first query of each text, with one more for the end."""
        n = np.diff(w.first)
        parts = np.where(n > PASSAGE, -(-n // PASSAGE), 0)
        base = np.r_[0, np.cumsum(parts + 1)]
        at = self.table.at(w.hash)
        some = np.flatnonzero(at >= 0)
        long_ = some[parts[w.text[some]] > 0]
        query = np.r_[base[w.text[some]], base[w.text[long_]] + 1 + (long_ - w.first[w.text[long_]]) // PASSAGE]
        width = max(len(self.keys), 1)
        pair, many = np.unique(query * width + np.r_[at[some], at[long_]], return_counts=True)
        query, term = pair // width, pair % width
        return query, term, self.vectors(query, term, many, int(base[-1])), base


def examples(docs: DataFrame, marks: DataFrame, most: int = EXAMPLES) -> Index:
    marks = marks.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    sizes = {x.toxic: x["count"] for x in marks.groupBy("toxic").count().collect()}
    at = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id"))
    # a threshold of the hash leaves few rows to be ordered, whatever there are
    share = F.when(F.col("toxic"), F.lit(4 * most / max(sizes.get(True, 1), 1))).otherwise(F.lit(4 * most / max(sizes.get(False, 1), 1)))
    few = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    few = few.withColumn("at", at).where(F.col("at") <= most // 2).select("doc_id", "toxic")
    rows = among(docs.select("doc_id", "text").where("text IS NOT NULL"), few).join(F.broadcast(few), "doc_id")  # at most EXAMPLES rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    toxic = np.array(rows.column("toxic").to_pylist(), bool)
    total = sum(sizes.values()) or 1
    return Index(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), toxic, (sizes.get(False, 0) / total, sizes.get(True, 0) / total))


def rated(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, toxic, score (the calibrated probability) and evidence (the nearest
    examples, as JSON) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(index)

    def rate(batches):
        index = held.value
        for batch in batches:
            scores, evidence = np.full(batch.num_rows, index.calibrated(-1.0)), [None] * batch.num_rows
            for first, texts in chunks(column(batch, "text").to_pylist()):
                query, term, weight, base = index.queries(Words(texts), len(texts))
                near = index.nearest(query, term, weight, int(base[-1]))
                votes = np.array([index.vote(*x) for x in near])
                cut = np.searchsorted(query, np.arange(len(near) + 1))
                for k in range(len(texts)):
                    q = base[k] + int(np.argmax(votes[base[k] : base[k + 1]]))
                    if len(near[q][0]):
                        own = slice(cut[q], cut[q + 1])
                        scores[first + k], evidence[first + k] = index.calibrated(votes[q]), index.evidence(term[own], weight[own], *near[q])
            flag = np.nan_to_num(scores) >= FLAG
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(flag), pa.array(scores, from_pandas=True), pa.array(evidence, pa.string())], ["doc_id", "toxic", "score", "evidence"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, toxic boolean, score double, evidence string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rated(docs, examples(docs, labels(spark, sf_dir)))
