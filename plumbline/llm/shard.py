"""Sharding by a hypergeometric communication matrix.

A uniform shuffle of all rows into shards of exact sizes: the rows of each block of
the stored table are counted; how many rows of block i go to shard j is drawn from
the multivariate hypergeometric law of a uniform permutation; each block's shard
labels are permuted within it; rows are exchanged once; and each shard is permuted
again. Blocks are runs of BLOCK rows of a file, known by file and row number, so
that a row's label depends on the table and the seed alone, not on how files were
split or on which executor ran, and a task that runs again draws the same.

A matrix has COLUMNS columns at most: of more shards, runs of as many as needed share
one. Such a run is permuted as a whole and cut at its shards' sizes, which is the same
law, and a task's draws stay in proportion to COLUMNS, whatever the table's size.

The matrix is never held: its rows are the leaves of a tree of drawn halves. A node
over blocks [a, b) draws how many of its rows for each shard fall into the first
half, from a generator seeded with (seed, a, b); a task walks from the root to its
own blocks, about log2(blocks) draws.

Defined results: nulls and repeated rows are rows like any other. Shard sizes
differ by one at most, the first ones being larger; rows = 0 gives no rows. Columns
named like the new ones (shard, position) stay; the new ones then end in _1, _2 ...
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents, free_name, stored

BLOCK, ROWS_A_SHARD, SEED = 65_536, 4096, 20_240
#: Columns of the matrix at most.
COLUMNS = 65_536
ORACLE_SQL = None


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of drawn are good. Beyond numpy's range, by inversion over the 40
    deviations around the mode, outside which lies less than 1e-300."""
    if not good or not drawn:
        return 0
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    mode = (drawn + 1) * (good + 1) // (total + 2)
    deviation = (drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1))) ** 0.5
    reach = int(40 * deviation) + 40
    low, high = max(0, drawn - bad, mode - reach), min(good, drawn, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    p = np.r_[0.0, np.cumsum(ratio)]
    p = np.cumsum(np.exp(p - p.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], "right").clip(0, high - low))


def multivariate(rng: np.random.Generator, colours: np.ndarray, drawn: int) -> np.ndarray:
    """How many of each colour are among drawn of them all: by numpy, or by halves where they are too many for it."""
    if int(colours.sum()) < 10**9:
        return rng.multivariate_hypergeometric(colours, drawn, method="marginals") if len(colours) else colours
    if len(colours) == 1:
        return np.array([drawn], np.int64)
    one, other = np.array_split(colours, 2)
    first = hypergeometric(rng, int(one.sum()), int(other.sum()), drawn)
    return np.concatenate([multivariate(rng, one, first), multivariate(rng, other, drawn - first)])


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    out = np.full(shards, rows // shards, np.int64)
    out[: rows % shards] += 1
    return out


class Matrix:
    """Rows of the communication matrix on demand."""

    def __init__(self, sizes: np.ndarray, shards: np.ndarray, seed: int):
        self.upto, self.shards, self.seed = np.r_[0, np.cumsum(sizes)], shards, seed
        self.kept: dict[tuple[int, int], np.ndarray] = {}

    def row(self, block: int) -> np.ndarray:
        a, b, counts = 0, len(self.upto) - 1, self.shards
        while b - a > 1:
            mid = (a + b) // 2
            first = self.kept.get((a, b))
            if first is None:
                first = self.kept[a, b] = multivariate(np.random.default_rng([self.seed, a, b]), counts, int(self.upto[mid] - self.upto[a]))
                if len(self.kept) > 4096:
                    self.kept.pop(next(iter(self.kept)))
            if block < mid:
                b, counts = mid, first
            else:
                a, counts = mid, counts - first
        return counts

    def labels(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each row of a block, and its random key for the order within the shard."""
        counts = self.row(block)
        rng = np.random.default_rng([self.seed, block, len(self.upto), 1])
        out = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        rng.shuffle(out)
        return out, rng.integers(-(1 << 63), 1 << 63, len(out), dtype=np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """docs, its columns named c0, c1 ..., with __file and __row, which only a stored
    table has: one that isn't is written first."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    clash = any(c.lower() in ("_metadata", "__file", "__row") for c in docs.columns)
    if not clash and docs._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", *place).toDF(*names, "__file", "__row")
        except AnalysisException:  # a relation without such columns
            pass
    return stored(docs.toDF(*names)).select("*", *place)


def sharded(docs: DataFrame, shards: int | None = None, rows_a_shard: int = ROWS_A_SHARD, seed: int = SEED, columns: int = COLUMNS) -> DataFrame:
    """docs in random order, with shard and position (from 0, by which each shard is
    sorted). shards: from the number of rows where None."""
    names = free_name(docs, "shard"), free_name(docs, "position")
    rows = numbered(docs)
    block = F.expr(f"__row div {BLOCK}")
    counts = rows.groupBy("__file", block.alias("block")).agg(F.count("*").alias("n"), F.max("__row").alias("last")).toArrow()
    file, number, n, last = (counts.column(c).to_numpy() for c in ("__file", "block", "n", "last"))
    order = np.lexsort((number, file))
    file, number, n, last = file[order], number[order], n[order], last[order]
    if (n != last - number * BLOCK + 1).any():
        raise ValueError("two files share a hash, or a file has changed")
    total = int(n.sum())
    m = shards or max(1, -(-total // rows_a_shard))
    run = -(-m // columns)
    held = docs.sparkSession.sparkContext.broadcast((file, number, n, np.add.reduceat(shard_sizes(total, m), np.arange(0, m, run))))

    @F.pandas_udf("shard int, key long")
    def label(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        file, number, n, sizes = held.value
        matrix, kept = Matrix(n, sizes, seed), {}
        where = {(int(f), int(b)): k for k, (f, b) in enumerate(zip(file, number, strict=True))}
        for files, rows in parts:
            f, r = files.to_numpy(), rows.to_numpy()
            shard, key = np.empty(len(f), np.int32), np.empty(len(f), np.int64)
            cut = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (r[1:] // BLOCK != r[:-1] // BLOCK), True])
            for a, b in zip(cut, cut[1:], strict=False):
                block = where[int(f[a]), int(r[a]) // BLOCK]
                if block not in kept:
                    kept.clear()
                    kept[block] = matrix.labels(block)
                labels, keys = kept[block]
                shard[a:b], key[a:b] = labels[r[a:b] % BLOCK], keys[r[a:b] % BLOCK]
            yield pd.DataFrame({"shard": shard, "key": key})

    out = rows.withColumn("__to", label("__file", "__row"))
    own = [f"c{i}" for i in range(len(docs.columns))]
    out = out.select(*own, F.col("__to.shard").alias("__shard"), F.col("__to.key").alias("__key"), "__file", "__row")
    at = F.row_number().over(Window.partitionBy("__shard").orderBy("__key", "__file", "__row")) - 1
    out = out.select(*own, "__shard", at.cast("long").alias("__at"))
    # of all places in the order of shards, the first more shards have one row more than least
    least, more = divmod(total, m)
    before = lambda shard: f"({shard} * {least}L + least({shard}, {more}L))"
    out = out.withColumn("__place", F.expr(f"{before(f'__shard * {run}L')} + __at"))
    out = out.withColumn("__to", F.expr(f"IF(__place < {more * (least + 1)}L, __place div {least + 1}L, {more}L + (__place - {more * (least + 1)}L) div {max(least, 1)}L)"))
    return out.select(*own, F.col("__to").cast("int"), F.expr(f"__place - {before('__to')}").cast("int")).toDF(*docs.columns, *names)


def op2_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
