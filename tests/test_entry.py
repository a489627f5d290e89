import duckdb
import pytest

import __spark_entry__ as entry
from plumbline import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    c = db.execute(core.SQL[name])
    names = [d[0] for d in c.description]
    want = sorted((tuple(plain(r[names.index(x)]) for x in cols) for r in c.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["path", "line", "column", "n_parts", "parts_sum", "declared", "direction"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
