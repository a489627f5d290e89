"""Mixing sources to target weights with hash-threshold histograms.

Each source shall give tokens in proportion to its weight, as many as the scarcest
source allows, and the k-th of LEVELS nested mixes k / LEVELS of that. A document's
place within its source is a 60-bit hash of its doc_id, and a mix takes the
documents up to a threshold of the hash: tokens are summed by source and the
hash's leading BITS bits, a running sum over these few buckets finds the one in
which a budget ends (a small stored table, whose size tells Spark how to join it), the next BITS bits are counted for that bucket alone, and
within it the hashes themselves. Documents are never sorted, and thresholds of
smaller mixes are never above those of larger ones.

A token is a run of anything but blanks, tabs and line ends. Documents of one hash
(repeated ids) are in or out together: the largest set of whole hashes within the
budget is taken.

Defined results: null or blank text has 0 tokens and goes with its hash. A null
source is a source of its own, with the default weight. All null doc_ids share one
hash. A source without tokens doesn't count as the scarcest. Weights are integers;
a source of weight 0 gives nothing. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import documents, free_name, stored

WEIGHTS, DEFAULT_WEIGHT, LEVELS = {"src0": 4}, 1, 4
SEED, BITS = "mix", 12


def place(doc_id: Column) -> Column:
    """The 60-bit hash of an id."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def tokens(text: Column) -> Column:
    """Runs of other than blank, tab, line feed and carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]++")), F.lit(0)).cast("long")


def weight_of(source: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in sorted(weights.items()):
        out = F.when(source == name, w).otherwise(out)
    return out.cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens and place of every document, stored."""
    return stored(docs.select("doc_id", "source", tokens(F.col("text")).alias("tokens"), place(F.col("doc_id")).alias("place")))


def thresholds(narrow: DataFrame, weights: dict[str, int], default: int = DEFAULT_WEIGHT, levels: int = LEVELS, bits: int = BITS) -> DataFrame:
    """source, level and the largest place that the level takes (-1: none)."""
    # a null source takes part in joins under a name that no other source has
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = narrow.select(key.alias("key"), "source", "tokens", "place")
    first = rows.groupBy("key", "source", F.shiftright("place", 60 - bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    first = stored(first, 1)
    total = first.groupBy("key", "source").agg(F.sum("tokens").alias("all")).withColumn("weight", weight_of(F.col("source"), weights, default))
    unit = total.where("`all` > 0 AND weight > 0").agg(F.min(F.expr("`all` div weight")).alias("unit"))
    budget = total.crossJoin(F.broadcast(unit)).select("key", "source", "weight", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"), "unit")
    budget = budget.select("key", "source", "level", F.expr(f"coalesce(unit * weight * level div {levels}, 0)").alias("budget"))

    def ended(sums: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
        """Of each budget, what precedes the first bucket at whose end it is exceeded: the
        tokens before it, the last place before it and the bucket (null: never exceeded)."""
        w = Window.partitionBy(*by).orderBy("bucket")
        run = sums.withColumn("to", F.sum("tokens").over(w))
        over = F.col("base") + F.col("to") > F.col("budget")
        return run.join(open_, by).groupBy("key", "source", "level", "budget", "base").agg(
            F.min(F.when(over, F.col("bucket"))).alias("bucket"), F.max(F.when(~over, F.col("to"))).alias("used"), F.max(F.when(~over, F.col("bucket"))).alias("last"))

    one = ended(first.drop("source"), budget.withColumn("base", F.lit(0).cast("long")), ["key"])
    one = stored(one.select("key", "source", "level", "budget", (F.col("base") + F.coalesce("used", F.lit(0))).alias("base"), F.col("bucket").alias("outer")), 1)
    edge = one.where("outer IS NOT NULL")
    inner = rows.select("key", "tokens", "place", F.shiftright("place", 60 - bits).alias("outer")).join(edge.select("key", "outer").distinct(), ["key", "outer"])
    second = inner.groupBy("key", "outer", F.shiftright("place", 60 - 2 * bits).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    two = ended(second, edge, ["key", "outer"]).select("key", "source", "level", "budget", (F.col("base") + F.coalesce("used", F.lit(0))).alias("base"), F.col("bucket").alias("outer"))
    two = stored(two, 1)
    deep = rows.select("key", "tokens", "place", F.shiftright("place", 60 - 2 * bits).alias("outer")).join(two.where("outer IS NOT NULL").select("key", "outer").distinct(), ["key", "outer"])
    third = deep.groupBy("key", "outer", F.col("place").alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    three = ended(third, two.where("outer IS NOT NULL"), ["key", "outer"]).select("key", "level", "last")
    cut = (1 << 60 - 2 * bits) - 1
    # a budget that ends in no bucket takes the whole source; one that takes none of its last bucket's places, all before it
    whole = one.select("key", "source", "level", F.col("outer").isNull().alias("everything"))
    inside = two.select("key", "level", F.col("outer").alias("deep"))
    out = whole.join(inside, ["key", "level"], "left").join(three, ["key", "level"], "left")
    before = F.expr(f"shiftleft(deep, {60 - 2 * bits}) - 1")
    last = F.when(F.col("everything"), F.lit((1 << 60) - 1)).otherwise(F.coalesce("last", before))
    return out.select("source", "level", last.alias("last"))


def levels_of(docs: DataFrame, limits: DataFrame, levels: int) -> DataFrame:
    """docs with limits' sources joined, and the least level that takes each row as __level."""
    wide = limits.groupBy("source").agg(*[F.max(F.when(F.col("level") == k, F.col("last"))).alias(f"__t{k}") for k in range(1, levels + 1)])
    wide = wide.select(F.col("source").alias("__source"), *[f"__t{k}" for k in range(1, levels + 1)])
    out = docs.join(wide, F.col("source").eqNullSafe(F.col("__source")))
    level = F.coalesce(*[F.when(F.col("__place") <= F.col(f"__t{k}"), k) for k in range(1, levels + 1)])
    return out.withColumn("__level", level).where("__level IS NOT NULL")


def mixed_in(docs: DataFrame, weights: dict[str, int] | None = None, default: int = DEFAULT_WEIGHT, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, tokens and level (the smallest mix with it) of the documents of the largest mix."""
    narrow = counted(docs)
    limits = thresholds(narrow, WEIGHTS if weights is None else weights, default, levels)
    out = levels_of(narrow.withColumn("__place", F.col("place")), limits, levels)
    return out.select("doc_id", "source", "tokens", F.col("__level").cast("int").alias("level"))


def mixture(docs: DataFrame, weights: dict[str, int] | None = None, default: int = DEFAULT_WEIGHT) -> DataFrame:
    """The rows of docs of the largest mix, with docs' own columns; texts are not shuffled."""
    limits = thresholds(counted(docs), WEIGHTS if weights is None else weights, default, LEVELS).where(F.col("level") == LEVELS)
    of, last = free_name(docs, "__source"), free_name(docs, "__last")
    limits = stored(limits.select(F.col("source").alias(of), F.col("last").alias(last)), 1)
    return docs.join(limits, F.col("source").eqNullSafe(F.col(of)) & (place(F.col("doc_id")) <= F.col(last)), "left_semi")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_in(documents(spark, sf_dir))


ORACLE_SQL = f"""
WITH narrow AS (
  SELECT doc_id, source,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS place,
    CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS tokens
  FROM documents),
weighted AS (
  SELECT source, sum(tokens) AS total, CASE WHEN source = 'src0' THEN 4 ELSE {DEFAULT_WEIGHT} END AS weight FROM narrow GROUP BY source),
unit AS (SELECT min(CAST(floor(total / weight) AS BIGINT)) AS unit FROM weighted WHERE total > 0 AND weight > 0),
run AS (
  SELECT n.*, w.weight, sum(tokens) OVER (PARTITION BY n.source ORDER BY place RANGE UNBOUNDED PRECEDING) AS upto
  FROM narrow n JOIN weighted w ON n.source IS NOT DISTINCT FROM w.source),
leveled AS (
  SELECT doc_id, source, tokens, (SELECT min(k) FROM range(1, {LEVELS + 1}) t(k) WHERE upto <= CAST(unit * weight * k AS BIGINT) // {LEVELS}) AS level
  FROM run CROSS JOIN unit)
SELECT doc_id, source, tokens, CAST(level AS INTEGER) AS level FROM leveled WHERE level IS NOT NULL
"""
