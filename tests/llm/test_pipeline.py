import importlib

import corpus_pipeline
from plumbline.llm import queries
from plumbline.llm.common import documents
from tests.llm.conftest import DOCS, LABELS, prose


def tables(spark, at):
    bench = prose(500, 40, 100_000)
    rows = [(i, prose(i, 80), "en", f"src{i % 3}") for i in range(150)]
    rows += [(200 + i, prose(i, 80), "en", "src1") for i in range(10)]  # copies
    rows += [(300 + i, prose(9000 + i, 40) + " " + bench, "en", "src2") for i in range(5)]  # leaks
    rows += [(400 + i, " ".join(w.upper() + "##%" for w in prose(i, 80).split()), "en", "src0") for i in range(10)]  # junk
    rows += [(500, None, None, None), (501, "", "en", "src0")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(100)], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_stages(spark, tmp_path):
    at = str(tmp_path)
    tables(spark, at)
    docs, left = documents(spark, at), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        if name != "uniform_shards":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        left[name] = {x.doc_id for x in docs.collect()}
    clean, leaks = set(range(150)), set(range(300, 305))
    assert left["quality_rules"] >= clean | leaks and not left["quality_rules"] & {*range(400, 410), 500, 501}
    assert left["minhash_near_dedup"] == clean | leaks
    assert left["benchmark_decontamination"] == clean
    assert left["source_mix"] <= clean and len(left["source_mix"]) > 50
    assert left["uniform_shards"] == left["source_mix"]
    assert {x.doc_id for x in corpus_pipeline.run(spark, at).collect()} == left["source_mix"]


def test_odd_documents(spark, odd, tmp_path):
    """Nulls, blank and very long texts, repeated rows and clashing columns: no stage fails,
    columns stay, and what goes is what the stages' docstrings say."""
    at = str(tmp_path)
    odd.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0)], LABELS).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, None), (None, prose(77, 30)), (2, ""), (3, "one")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = documents(spark, at)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x.doc_id, x.text) for x in docs.collect()]
        out = stage(spark, docs, at)
        assert out.columns == (docs.columns if name != "uniform_shards" else [*docs.columns, "shard_1", "position_1"])
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        after = [(x.doc_id, x.text) for x in docs.collect()]
        assert set(after) <= set(before) and len(after) <= len(before)
        if name == "quality_rules":
            assert not any(not (t or "").strip() for _, t in after)
        if name == "minhash_near_dedup":
            assert len(set(after)) == len(after)
        if name in ("benchmark_decontamination", "uniform_shards"):
            assert sorted(after, key=repr) == sorted(before, key=repr)


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    for name, schema in (("documents", DOCS), ("labels", LABELS), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{at}/{name}.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_every_operator_is_registered():
    found = queries.queries()
    assert [n.split("_")[0] for n in found] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) == {"op1_source_mix"}


def test_nothing_else_imports_this_package():
    import pathlib

    root = pathlib.Path(importlib.import_module("plumbline").__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "plumbline.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text().replace('glob("corpus_pipeline.py")', ""), p
