from pyspark.sql import SparkSession

from plumbline.context import context_of
from plumbline.operators.markdown import parsed
from plumbline.sources.corpus import corpus_of


def docs(spark: SparkSession, files: dict[str, str], frozen=()):
    rows = [(p, t.strip("\n"), p in frozen) for p, t in files.items()]
    return parsed(spark.createDataFrame(rows, "path string, text string, frozen boolean"))


def axis(spark, produce, files, config=None, root="/nonexistent", **more):
    """The collected result of an axis over files."""
    context = context_of({"docs": {"root": "docs"}, **(config or {})}, root)
    corpus = corpus_of(spark.createDataFrame(list(files.items()), "path string, text string"), context.config)
    return produce(context, corpus, parsed(corpus.documents), **more).collect()


def places(finding):
    return [(p["file"], p.get("line")) for p in finding["locations"]]


def codes(result):
    return sorted(f["code"] for f in result["findings"])
