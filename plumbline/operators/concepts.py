"""Names and terms: misspelt identifiers, names that no schema has, and mentions of tracked concepts."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.context import RunContext
from plumbline.findings import empty, findings_frame, union
from plumbline.functions import text as T
from plumbline.operators import markdown as M
from plumbline.operators.base import AxisResult
from plumbline.sources.corpus import Corpus

AXIS = "concepts"
RARE_MAX, DOMINANT_MIN, RATIO = 2, 3, 3
IDENTIFIER = r"^(?:@[a-z\d][-._a-z\d]*/)?[_$A-Za-z][\w$]*(?:[-./][\w$]+)*\z"
CODE_SHAPED = r"[-_./]|[a-z\d][A-Z]|^@"
FIELD_SHAPED = r"^[_$A-Za-z][\w$]*\z"


def identifiers(docs: DataFrame) -> DataFrame:
    """name, occurrences, locations and segments of every code-shaped name in a code span outside fences."""
    spans = M.view(docs, "code_spans").where(F.col("text").rlike(IDENTIFIER) & F.col("text").rlike(CODE_SHAPED))
    lines = M.lines(docs).where("NOT in_fence").select("path", "line", F.col("raw").alias("line_raw"))
    each = spans.join(lines, ["path", "line"])
    place = F.struct("path", "line", "col", T.quote(F.col("line_raw")).alias("quote"))
    out = each.groupBy(F.col("text").alias("name")).agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_list(place)).alias("locations"))
    return out.withColumn("segments", T.segments(F.col("name")))


def _blocks(name: Column, segments: Column) -> Column:
    """Keys that two similar names share: all parts; for names of several parts these with
    each but the first left out (w: against a name that lacks it, with the place: against
    one that has another there); for names of one part itself with each letter left out."""
    low = F.lower(name)
    left = F.transform(F.sequence(F.lit(0), F.length(name)), lambda i: F.concat(F.lit("1:"), F.substring(low, F.lit(1), i), F.substring(low, i + 2, F.length(name))))
    single = F.concat(F.array(F.concat(F.lit("1:"), low)), left)
    whole = F.array(F.concat(F.lit("w:"), F.array_join(segments, "/")))
    places = F.when(F.size(segments) > 1, F.sequence(F.lit(1), F.size(segments) - 1)).otherwise(F.array().cast("array<int>"))
    rest = lambda i: F.array_join(F.filter(segments, lambda _, k: k != i), "/")
    several = F.concat(whole, F.transform(places, lambda i: F.concat(F.lit("w:"), rest(i))), F.transform(places, lambda i: F.concat(i.cast("string"), F.lit("/"), rest(i))))
    return F.array_distinct(F.when(F.size(segments) == 1, F.concat(whole, single)).otherwise(several))


def similar(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (name, segments, ...) with each similar name of right (other, other_segments,
    ...) and why. Similar names share a block, so names are joined by equality."""
    a = left.withColumn("block", F.explode(_blocks(F.col("name"), F.col("segments"))))
    b = right.withColumn("block", F.explode(_blocks(F.col("other"), F.col("other_segments"))))
    why = T.identifier_similarity(F.col("name"), F.col("other"), F.col("segments"), F.col("other_segments"))
    pairs = a.join(b, "block").drop("block").withColumn("why", why).where("why IS NOT NULL")
    return pairs.dropDuplicates(["name", "other"])


def ghosts(index: DataFrame) -> DataFrame:
    """name, occurrences, other, other_occurrences, why and rank of every rare name with a similar dominant one; rank 1 is the most frequent."""
    rare = index.where(F.col("occurrences") <= RARE_MAX).select("name", "occurrences", "segments")
    dominant = index.where(F.col("occurrences") >= DOMINANT_MIN).select(F.col("name").alias("other"), F.col("occurrences").alias("other_occurrences"), F.col("segments").alias("other_segments"))
    pairs = similar(rare, dominant).where(F.col("other_occurrences") >= F.col("occurrences") * RATIO)
    w = Window.partitionBy("name").orderBy(F.col("other_occurrences").desc(), "other")
    return pairs.select("name", "occurrences", "other", "other_occurrences", "why", F.row_number().over(w).alias("rank"))


def ghost_fields(index: DataFrame, fields: DataFrame) -> DataFrame:
    """name, occurrences, locations and candidates of each field-shaped name that is none of fields (field) but similar to some."""
    names = index.where(F.col("name").rlike(FIELD_SHAPED)).join(fields.select(F.col("field").alias("name")), "name", "left_anti")
    other = fields.select(F.col("field").alias("other"), T.segments(F.col("field")).alias("other_segments"))
    pairs = similar(names.select("name", "segments"), other)
    found = pairs.groupBy("name").agg(F.array_sort(F.collect_set("other")).alias("candidates"))
    return names.join(found, "name").select("name", "occurrences", "locations", "candidates")


def mentions(docs: DataFrame, concepts: list[str]) -> DataFrame:
    """concept, ord, occurrences and locations of every tracked concept, none left out; lines in fences count."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame(list(enumerate(concepts)), "ord int, concept string")
    lines = M.lines(docs).select("path", "line", "raw", F.nullif(T.stripped(F.col("fence_info")), F.lit("")).alias("in_code_example"))
    hits = lines.join(F.broadcast(wanted), F.contains("raw", "concept"))  # one row for each declared concept
    place = F.struct("path", "line", T.quote(F.col("raw")).alias("quote"), "in_code_example")
    per = hits.groupBy("ord").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(place)).alias("locations"))
    return wanted.join(per, "ord", "left").select("ord", "concept", F.coalesce("n", F.lit(0)).alias("occurrences"), F.coalesce("locations", F.array()).alias("locations"))


def field_names(schema) -> set[str]:
    """Names that a JSON Schema declares or requires; of a sample, all keys."""
    fields: set[str] = set()
    declared = False

    def walk(node, every: bool) -> None:
        nonlocal declared
        if isinstance(node, list):
            for x in node:
                walk(x, every)
        elif isinstance(node, dict):
            for k, v in node.items():
                if every:
                    fields.add(k)
                elif k == "properties" and isinstance(v, dict):
                    declared = True
                    fields.update(v)
                elif k == "required" and isinstance(v, list):
                    fields.update(x for x in v if isinstance(x, str))
                walk(v, every)

    walk(schema, False)
    if not declared:
        walk(schema, True)
    return fields


def load_fields(context: RunContext) -> tuple[set[str], list[tuple[str, str]]]:
    """All fields of the declared schemas, and (path, reason) of those that can't be read."""
    fields: set[str] = set()
    bad = []
    for path in context.config.get("schemas") or []:
        try:
            with open(os.path.join(context.repo_root, path), encoding="utf-8") as f:
                fields |= field_names(json.load(f))
        except (OSError, ValueError) as e:
            bad.append((path, str(e)))
    return fields, bad


def _places(col: str = "locations") -> Column:
    return F.transform(col, lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["quote"].alias("quote")))


def run_axis(context: RunContext, corpus: Corpus, docs: DataFrame) -> AxisResult:
    spark: SparkSession = docs.sparkSession
    config = context.config
    own = docs.where("NOT frozen")
    index = identifiers(own)
    fields, bad = load_fields(context)
    closed = config.get("schemas_complete") is True
    found, candidates = [empty_found(spark)], []
    names = index.select("name", "occurrences", "locations")
    best = ghosts(index)
    if fields:
        gf = ghost_fields(index, spark.createDataFrame([(f,) for f in sorted(fields)], "field string"))
        canonical = F.when(F.size("candidates") == 1, F.col("candidates")[0])
        reading = F.when(F.size("candidates") == 1, F.format_string("code written for %s would not fit the schema, which has %s", "name", F.col("candidates")[0])).otherwise(F.format_string("%s hides a distinction that the schema makes: %s", "name", F.array_join("candidates", ", ")))
        if closed:
            payload = F.to_json(F.struct(F.col("name").alias("concept"), canonical.alias("canonical_name"), "candidates", F.lit("ghost").alias("kind"), reading.alias("misreading")))
            message = F.format_string("`%s` is no field of the schema; it has %s", "name", F.array_join("candidates", ", "))
            found.append(findings_frame(gf, AXIS, "concepts.ghost-field", "block", message, _places(), payload, [F.lit("1"), F.col("name")]))
        else:
            body = F.struct(F.lit("ghost-field").alias("kind"), "name", "occurrences", _places().alias("locations"), canonical.alias("canonical_name"), "candidates", reading.alias("misreading"), F.lit("not in the schemas, which are not declared complete").alias("why"))
            candidates.append(gf.select(F.lit("ghost-field").alias("kind"), F.to_json(body).alias("candidate")))
        best = best.join(gf.select("name"), "name", "left_anti")
    if bad:
        rows = spark.createDataFrame(bad, "path string, reason string")
        place = F.array(F.struct(F.col("path").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("quote")))
        payload = F.to_json(F.struct(F.lit("ghost").alias("kind"), "reason"))
        found.append(findings_frame(rows, AXIS, "concepts.schema-unreadable", "block", F.format_string("schema %s can't be read: %s", "path", "reason"), place, payload, [F.lit("2"), F.col("path")]))
    rest = best.where("rank > 1").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other").alias("name"), F.col("other_occurrences").alias("occurrences"), F.col("why").alias("similarity")))).alias("rest"))
    top = best.where("rank = 1").join(rest, "name", "left").join(names.select("name", "locations"), "name")
    top = top.join(names.select(F.col("name").alias("other"), F.col("locations").alias("other_locations")), "other")
    others = F.transform(F.coalesce("rest", F.array().cast("array<struct<rank:int,name:string,occurrences:bigint,similarity:string>>")), lambda r: F.struct(r["name"].alias("name"), r["occurrences"].alias("occurrences"), r["similarity"].alias("similarity")))
    dominant = F.struct(F.col("other").alias("name"), F.col("other_occurrences").alias("occurrences"), F.col("why").alias("similarity"), _places("other_locations").alias("locations"))
    why = F.format_string("%s occurs %d times, %s %d times (%s)", "name", "occurrences", "other", "other_occurrences", "why")
    body = F.struct(F.lit("ghost").alias("kind"), "name", "occurrences", _places().alias("locations"), dominant.alias("dominant"), others.alias("other_candidates"), why.alias("why"))
    candidates.insert(0, top.select(F.lit("ghost").alias("kind"), F.to_json(body).alias("candidate")))
    if config.get("concepts"):
        place = F.transform("locations", lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["quote"].alias("quote"), p["in_code_example"].alias("in_code_example")))
        body = F.struct(F.lit("concept-usage").alias("kind"), "concept", "occurrences", place.alias("locations"))
        candidates.append(mentions(own, config["concepts"]).select(F.lit("concept-usage").alias("kind"), F.to_json(body).alias("candidate")))
    check = {"ran": True, "schemas": len(config["schemas"]), "fields": len(fields), "closed_world": closed} if config.get("schemas") else {"ran": False, "reason": "no schemas are declared"}
    return AxisResult(AXIS, union(found), union(candidates), corpus.excluded, corpus.scanned, {"identifiers_indexed": index.count, "field_check": check})


def empty_found(spark: SparkSession) -> DataFrame:
    return empty(spark).drop("ord").withColumn("sort", F.lit(""))
