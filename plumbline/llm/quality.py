"""Quality rules by n-gram perplexity.

Character n-grams of the well-rated documents are counted by Spark for each
language; the counts become an interpolated modified Kneser-Ney model (three
discounts an order, continuation counts below the highest order) held in sorted
hash arrays. Every document is scored over its whole text, and one whose
perplexity lies outside its language's band is rejected.

A symbol is a code point, or half of one: code points from WIDE on are written as two
symbols (their higher and lower bits), so that five symbols of 12 bits fit 60. White
space is one blank.

Defined results: text null, empty or blank: perplexity null, rejected. Language
null or without a model: perplexity null, kept, for there is no band to judge by.
Repeated rows are judged alike, each for itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import CHUNK, U64, Table, among, bounded, chunks, code_points, column, documents, labels, looked_up, mixed, tables

ORDER = 5
#: Code points from WIDE on are two symbols: WIDE and more for the bits from the eleventh on, LOW and more for the ten before.
WIDE, LOW = 0x700, 0xB40
#: The band reaches from the least to the greatest usual log perplexity (the QUANTILE and 1 - QUANTILE
#: of the well-rated documents), each moved out by MARGIN times their distance, and more for short texts.
QUANTILE, MARGIN, SHORT = 0.02, 0.75, 4.0


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """12-bit symbols of all texts with order - 1 blanks before each, and where each text starts and ends."""
    pad = " " * (order - 2)
    cp, at = code_points([pad + t for t in texts])
    cp = np.where(looked_up(tables()["blank"], cp, False), 32, cp)
    start, end = at[:-1] + (order - 2), at[1:] - 1
    wide = np.flatnonzero(cp >= WIDE)
    if not len(wide):
        return cp.astype(np.uint64), start, end
    size = np.ones(len(cp), np.int64)
    size[wide] = 2
    place = np.cumsum(size) - size
    out = np.empty(len(cp) + len(wide), np.uint64)
    out[place] = np.where(cp >= WIDE, WIDE + (cp >> 10), cp)
    out[place[wide] + 1] = LOW + (cp[wide] & 0x3FF)
    return out, place[start], place[end]


def windows(cp: np.ndarray, order: int) -> np.ndarray:
    """The code of the order symbols that end at each place from order - 1 on."""
    code = cp[: len(cp) - order + 1]
    for k in range(1, order):
        code = (code << U64(12)) | cp[k : len(cp) - order + 1 + k]
    return code


def places(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Mask of the places within any [start, end)."""
    step = np.zeros(size + 1, np.int8)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    return np.cumsum(step[:-1]).astype(bool)


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, code and n of every n-gram of the texts, a row for each."""

    def count(batches):
        for batch in batches:
            lang = np.array(column(batch, "lang").to_pylist(), object)
            for first, texts in chunks(column(batch, "text").to_pylist(), 2 * CHUNK):  # fewer repeated n-grams to add up
                langs = lang[first : first + len(texts)]
                for name in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                    cp, start, end = symbols(own, order)
                    code = windows(cp, order)[places(start, end, len(cp))[order - 1 :]]
                    code, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "code", "n"])

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return bounded(rows).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def discounts(n: np.ndarray) -> np.ndarray:
    """Amounts taken from counts 0, 1, 2 and 3 or more; an estimate that the counts don't allow falls back to 0.5, 1 and 1.5."""
    c = [float((n == k).sum()) for k in range(5)]
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if c[1] and c[2]:
        y = c[1] / (c[1] + 2 * c[2])
        for k in (1, 2, 3):
            if c[k] and c[k + 1]:
                out[k] = min(max(k - (k + 1) * y * c[k + 1] / c[k], 0.1), k - 0.1)
    return out


def kneser_ney(code: np.ndarray, n: np.ndarray, order: int = ORDER) -> list[dict]:
    """From the counts of the highest order, for each order from 1 on: code, the
    interpolated probability p, and gamma by context code."""
    counts = {order: (code, n)}
    for k in range(order - 1, 0, -1):
        counts[k] = np.unique(counts[k + 1][0] & U64((1 << 12 * k) - 1), return_counts=True)
    out: list[dict] = []
    for k in range(1, order + 1):
        code, n = counts[k]
        d = discounts(n)
        taken = d[np.minimum(n, 3)]
        context, inverse = np.unique(code >> U64(12), return_inverse=True)
        total = np.bincount(inverse, n)
        gamma = np.bincount(inverse, taken) / total
        if k == 1:
            lower = np.full(len(code), 1 / (len(code) + 1))
        else:
            under = out[-1]
            lower = under["p"][np.searchsorted(under["code"], code & U64((1 << 12 * (k - 1)) - 1))]
        out.append({"code": code, "p": (n - taken) / total[inverse] + gamma[inverse] * lower, "context": context, "gamma": gamma})
    return out


class Model:
    """One language's orders as sorted hash arrays."""

    def __init__(self, orders: list[dict]):
        self.order = len(orders)
        self.unknown = float(orders[0]["gamma"][0] / (len(orders[0]["code"]) + 1))
        self.arrays = []
        for x in orders:
            pair = []
            for keys, values in ((x["code"], x["p"]), (x["context"], x["gamma"])):
                h = mixed(keys)
                at = np.argsort(h)
                pair += [h[at], np.log(values[at]).astype(np.float32)]
            self.arrays.append(pair)

    def open(self) -> Model:
        self.levels = [(Table(k), p, Table(c), g) for k, p, c, g in self.arrays]
        return self

    def log_p(self, code: np.ndarray) -> np.ndarray:
        """Log probability of the last symbol of each code, given the others."""
        out = np.zeros(len(code), np.float64)
        rest = np.arange(len(code))
        for k in range(self.order, 0, -1):
            keys, p, contexts, gamma = self.levels[k - 1]
            own = code[rest] & U64((1 << 12 * k) - 1)
            at = keys.at(mixed(own))
            hit = at >= 0
            out[rest[hit]] += p[at[hit]]
            rest, own = rest[~hit], own[~hit]
            if not len(rest):
                return out
            if k > 1:
                at = contexts.at(mixed(own >> U64(12)))
                hit = at >= 0
                out[rest[hit]] += gamma[at[hit]]
        out[rest] += np.log(self.unknown)
        return out


def fitted(counts: DataFrame, order: int = ORDER) -> dict[str, Model]:
    """A model for each language of gram_counts()."""
    t = counts.toArrow()
    lang = t.column("lang").combine_chunks().dictionary_encode() if t.num_rows else None
    out = {}
    if lang is not None:
        if isinstance(lang, pa.ChunkedArray):
            lang = lang.combine_chunks()
        which, code, n = lang.indices.to_numpy(), t.column("code").to_numpy().astype(np.uint64), t.column("n").to_numpy()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            own = np.flatnonzero(which == k)
            own = own[np.argsort(code[own])]
            out[name] = Model(kneser_ney(code[own], n[own], order))
    return out


def log_perplexity(lang: list, texts: list, models: dict[str, Model]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and log perplexity (nan: none) of each text."""
    n, out = np.zeros(len(texts), np.int64), np.full(len(texts), np.nan)
    lang = np.array(lang, object)
    for first, part in chunks(texts):
        langs = lang[first : first + len(part)]
        for name in set(langs) & set(models):
            own = np.flatnonzero(langs == name)
            order = models[name].order
            cp, start, end = symbols([part[k] for k in own], order)
            code = windows(cp, order)
            sums = np.zeros(len(cp) + 1)
            np.cumsum(models[name].log_p(code), out=sums[order:])
            n[first + own] = end - start
            some = np.array([bool(part[k].strip()) for k in own], bool)
            at = first + own[some]
            out[at] = (sums[start[some]] - sums[end[some]]) / (end - start)[some]
    return n, out


def scored(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, lang, blank, n (symbols scored) and log_ppl of every row."""
    held = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        models = {k: m.open() for k, m in held.value.items()}
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            n, ppl = log_perplexity(column(batch, "lang").to_pylist(), texts, models)
            blank = pa.array([not (x or "").strip() for x in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), blank, pa.array(n), pa.array(ppl, from_pandas=True)], ["doc_id", "lang", "blank", "n", "log_ppl"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return bounded(docs).select("doc_id", "lang", "text").mapInArrow(score, f"doc_id {kind}, lang string, blank boolean, n long, log_ppl double")


def trained(docs: DataFrame, marks: DataFrame, order: int = ORDER) -> tuple[dict[str, Model], dict[str, tuple[float, float]]]:
    """By language, the model and the usual least and greatest log perplexity, both
    from all documents that marks (doc_id, quality) rates 1; of a language that has
    none, from all its documents."""
    good = marks.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    rated = among(docs.select("doc_id", "lang", "text").where("lang IS NOT NULL"), good)
    langs = {x.lang for x in docs.select("lang").where("lang IS NOT NULL").distinct().collect()}
    without = langs - {x.lang for x in rated.select("lang").distinct().collect()}
    train = rated
    if without:
        train = train.unionByName(docs.select("doc_id", "lang", "text").where(F.col("lang").isin(sorted(without))))
    models = fitted(gram_counts(train, order), order)
    usual = scored(train, models).where("log_ppl IS NOT NULL").groupBy("lang").agg(F.percentile_approx("log_ppl", [QUANTILE, 1 - QUANTILE], 10000).alias("q"))
    return models, {x.lang: (x.q[0], x.q[1]) for x in usual.collect()}


def slack(lo, hi, n, sqrt):
    return MARGIN * (hi - lo) + SHORT / sqrt(n)


def judged(docs: DataFrame, marks: DataFrame, order: int = ORDER) -> DataFrame:
    """A row for each document: doc_id, lang, perplexity, lower, upper, keep."""
    models, usual = trained(docs, marks, order)
    band = docs.sparkSession.createDataFrame([(k, *v) for k, v in usual.items()], "lang string, lo double, hi double")
    out = scored(docs, models).join(F.broadcast(band), "lang", "left")  # a row for each language
    wide = slack(F.col("lo"), F.col("hi"), F.greatest("n", F.lit(1)), F.sqrt)
    out = out.withColumns({"lower": F.exp(F.col("lo") - wide), "upper": F.exp(F.col("hi") + wide), "perplexity": F.exp("log_ppl")})
    keep = ~F.col("blank") & F.coalesce(F.col("log_ppl").between(F.col("lo") - wide, F.col("hi") + wide), F.lit(True))
    return out.select("doc_id", "lang", "perplexity", "lower", "upper", keep.alias("keep"))


def kept(docs: DataFrame, marks: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows of docs that judged() keeps, with docs' own columns; no shuffle of texts."""
    models, usual = trained(docs, marks, order)
    held = docs.sparkSession.sparkContext.broadcast((models, usual))

    @F.pandas_udf("boolean")
    def keep(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        models, usual = held.value
        models = {k: m.open() for k, m in models.items()}
        for langs, texts in parts:
            n, ppl = log_perplexity(list(langs), list(texts), models)
            lo, hi = np.array([usual.get(x, (np.nan, np.nan)) for x in langs]).reshape(-1, 2).T
            wide = slack(lo, hi, np.maximum(n, 1), np.sqrt)
            outside = (ppl < lo - wide) | (ppl > hi + wide)
            yield pd.Series(np.array([bool((x or "").strip()) for x in texts], bool) & ~outside)

    return bounded(docs).where(keep("lang", "text"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), labels(spark, sf_dir))
