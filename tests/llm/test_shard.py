from collections import Counter

import numpy as np

from plumbline.llm import shard
from tests.llm.conftest import DOCS, prose


def test_exact_sizes_and_all_rows(spark, docs, tmp_path):
    docs(*[(i, prose(i, 5)) for i in range(1003)]).write.parquet(str(tmp_path / "d"))
    got = shard.sharded(spark.read.parquet(str(tmp_path / "d")), 10).collect()
    assert sorted(x.doc_id for x in got) == list(range(1003))
    sizes = Counter(x.shard for x in got)
    assert [sizes[k] for k in range(10)] == [101] * 3 + [100] * 7
    for k in range(10):
        assert sorted(x.position for x in got if x.shard == k) == list(range(sizes[k]))


def test_the_same_again_however_files_are_split(spark, docs, tmp_path):
    docs(*[(i, prose(i, 200)) for i in range(300)]).repartition(3).write.parquet(str(tmp_path / "d"))
    read = lambda: sorted((x.doc_id, x.shard, x.position) for x in shard.sharded(spark.read.parquet(str(tmp_path / "d")), 7).collect())
    first = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert read() == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_more_shards_than_columns(spark, docs, tmp_path):
    """Exact sizes, and each row in any shard as often, where shards share a column of the matrix."""
    docs(*[(i, "x") for i in range(23)]).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    got = shard.sharded(d, 7, columns=3).collect()
    assert sorted(x.doc_id for x in got) == list(range(23))
    assert sorted((x.shard, x.position) for x in got) == [(k, p) for k in range(7) for p in range(4 if k < 2 else 3)]
    got = shard.sharded(d, 40, columns=4).collect()
    assert sorted((x.shard, x.position) for x in got) == [(k, 0) for k in range(23)]
    by = Counter(x.shard for s in range(60) for x in shard.sharded(d, 5, seed=s, columns=2).collect() if x.doc_id == 3)
    assert len(by) == 5 and max(by.values()) < 26


def test_matrix_rows_add_up():
    sizes, shards = np.array([5, 0, 7, 30, 1, 2]), shard.shard_sizes(45, 4)
    rows = np.array([shard.Matrix(sizes, shards, 3).row(i) for i in range(6)])
    assert (rows.sum(1) == sizes).all() and (rows.sum(0) == shards).all()


def test_matrix_is_hypergeometric():
    """Means and variances of an entry over many seeds are those of a uniform permutation."""
    sizes, shards = np.array([30, 50, 20]), np.array([60, 40])
    x = np.array([shard.Matrix(sizes, shards, s).row(0)[0] for s in range(4000)])
    mean, var = 30 * 60 / 100, 30 * 0.6 * 0.4 * 70 / 99
    assert abs(x.mean() - mean) < 4 * (var / 4000) ** 0.5 and abs(x.var() / var - 1) < 0.15


def test_uniform_permutation():
    """All orders of four rows in two blocks are as frequent."""
    seen = Counter()
    for s in range(6000):
        m, rows = shard.Matrix(np.array([2, 2]), shard.shard_sizes(4, 2), s), []
        for b in range(2):
            labels, keys = m.labels(b)
            rows += [(labels[i], keys[i], 2 * b + i) for i in range(2)]
        seen[tuple(r[2] for r in sorted(rows))] += 1
    assert len(seen) == 24
    assert sum((n - 250) ** 2 / 250 for n in seen.values()) < 50  # chi-square, 23 degrees of freedom


def test_beyond_numpys_range():
    rng = np.random.default_rng(5)
    good, bad, n = 2 * 10**9, 6 * 10**9, 4 * 10**6
    x = np.array([shard.hypergeometric(rng, good, bad, n) for _ in range(400)])
    sd = (n * 0.25 * 0.75) ** 0.5
    assert abs(x.mean() - n / 4) < 4 * sd / 20 and abs(x.std() / sd - 1) < 0.15


def test_oddities(odd, spark):
    got = shard.sharded(odd, 3)
    assert got.columns == [*odd.columns, "shard_1", "position_1"]
    assert sorted(map(repr, got.select(odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert shard.sharded(spark.createDataFrame([], DOCS)).count() == 0
    assert shard.sharded(odd.withColumnRenamed("key", "_metadata"), 2).count() == odd.count()
