"""The finding envelope: its schema, validation, severity cap, folding and roll-ups."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from plumbline.context import Problems, is_object
from plumbline.registry import NAME

SEVERITIES = ("info", "warn", "block")
RESERVED = ("coverage",)
FINDING_KEYS = tuple("axis severity code message locations payload found_by".split())
LOCATION_KEYS = ("file", "line", "quote")
LOCATION = StructType([StructField("file", StringType()), StructField("line", IntegerType()), StructField("quote", StringType())])
#: ord is the order of arrival; payload is JSON.
FINDING = StructType(
    [StructField("ord", LongType()), StructField("axis", StringType()), StructField("severity", StringType()), StructField("code", StringType()), StructField("message", StringType()), StructField("locations", ArrayType(LOCATION)), StructField("payload", StringType())]
)
CANDIDATE = StructType([StructField("kind", StringType()), StructField("candidate", StringType())])


class FindingError(Problems):
    pass


def rank(severity: str) -> int:
    if severity not in SEVERITIES:
        raise FindingError(f"unknown severity {severity!r}")
    return SEVERITIES.index(severity)


def cap_severity(severity: str, cap: str | None) -> str:
    return severity if not cap or rank(severity) <= rank(cap) else cap


def rank_column(severity: Column) -> Column:
    return F.when(severity == "block", 2).when(severity == "warn", 1).when(severity == "info", 0)


def severity_column(ranks: Column) -> Column:
    return F.when(ranks == 2, "block").when(ranks == 1, "warn").when(ranks == 0, "info")


def capped_column(severity: Column, cap: Column) -> Column:
    return severity_column(F.least(rank_column(severity), F.coalesce(rank_column(cap), F.lit(2))))


def frozen_severity(frozen: Column, base: str) -> Column:
    return F.when(frozen, "warn").otherwise(base)


def _whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def validate_location(x: Any, path: str = "locations[0]") -> list[str]:
    if not is_object(x):
        return [f"{path}: must be an object"]
    problems = []
    if not isinstance(x.get("file"), str) or not x["file"]:
        problems.append(f"{path}.file: must be a non-empty string")
    if "line" in x and not (_whole(x["line"]) and x["line"] >= 1):
        problems.append(f"{path}.line: must be an integer from 1 on")
    if "quote" in x and not isinstance(x["quote"], str):
        problems.append(f"{path}.quote: must be a string")
    return problems + [f"{path}.{k}: unknown key" for k in x if k not in LOCATION_KEYS]


def validate_finding(x: Any, namespaces: tuple[str, ...] = ()) -> list[str]:
    """All violations. namespaces: of codes that other registered axes own."""
    if not is_object(x):
        return ["finding: must be an object"]
    problems = []
    if not isinstance(x.get("axis"), str) or not NAME.match(x["axis"]):
        problems.append("axis: must be a kebab-case name")
    if x.get("severity") not in SEVERITIES:
        problems.append(f"severity: one of {', '.join(SEVERITIES)}")
    code = x.get("code")
    if not isinstance(code, str):
        problems.append("code: must be a string")
    else:
        parts = code.split(".")
        if len(parts) != 2 or not all(NAME.match(p) for p in parts):
            problems.append("code: must be <axis>.<kebab>")
        elif parts[0] not in (x.get("axis"), *RESERVED, *namespaces):
            problems.append(f"code: namespace {parts[0]} is not the axis {x.get('axis')}")
    if not isinstance(x.get("message"), str) or not x["message"]:
        problems.append("message: must be a non-empty string")
    places = x.get("locations")
    if not isinstance(places, list) or not places:
        problems.append("locations: at least one is needed")
    else:
        for i, place in enumerate(places):
            problems += validate_location(place, f"locations[{i}]")
    if "payload" in x and not is_object(x["payload"]):
        problems.append("payload: must be an object")
    if "found_by" in x and not (isinstance(x["found_by"], list) and all(isinstance(v, str) for v in x["found_by"])):
        problems.append("found_by: must be an array of strings")
    return problems + [f"{k}: unknown key" for k in x if k not in FINDING_KEYS]


def create_finding(axis: str, severity: str, code: str, message: str, locations: list, payload: dict | None = None, severity_cap: str | None = None) -> dict:
    finding = {"axis": axis, "severity": cap_severity(severity, severity_cap) if severity in SEVERITIES else severity, "code": code, "message": message, "locations": [dict(x) if is_object(x) else x for x in locations] if isinstance(locations, list) else locations}
    if payload is not None:
        finding["payload"] = payload
    if problems := validate_finding(finding):
        raise FindingError("invalid finding", problems)
    return finding


def validate_scan_result(x: Any) -> list[str]:
    if not is_object(x):
        return ["scan result: must be an object"]
    problems = []
    if not isinstance(x.get("axis"), str) or not NAME.match(x["axis"]):
        problems.append("axis: must be a kebab-case name")
    if not isinstance(x.get("findings"), list):
        problems.append("findings: must be an array (required)")
    else:
        for i, finding in enumerate(x["findings"]):
            problems += [f"findings[{i}].{p}" for p in validate_finding(finding)]
            if is_object(finding) and finding.get("axis") != x.get("axis"):
                problems.append(f"findings[{i}].axis: not the result's axis")
    if "candidates" in x and not isinstance(x["candidates"], list):
        problems.append("candidates: must be an array")
    stats = x.get("stats")
    if not is_object(stats):
        problems.append("stats: must be an object (required)")
    else:
        if not _whole(stats.get("files_scanned")) or stats["files_scanned"] < 0:
            problems.append("stats.files_scanned: must be an integer from 0 on")
        if not isinstance(stats.get("excluded"), list):
            problems.append("stats.excluded: must be an array; what was left out, and why, is not optional")
        else:
            for i, e in enumerate(stats["excluded"]):
                if not is_object(e):
                    problems.append(f"stats.excluded[{i}]: must be an object")
                    continue
                if not isinstance(e.get("path"), str):
                    problems.append(f"stats.excluded[{i}].path: must be a string")
                if not isinstance(e.get("reason"), str) or not e["reason"]:
                    problems.append(f"stats.excluded[{i}].reason: must be a non-empty string")
        if not isinstance(stats.get("skipped"), bool):
            problems.append("stats.skipped: must be a boolean")
    return problems + [f"{k}: unknown key" for k in x if k not in ("axis", "findings", "candidates", "stats")]


def create_scan_result(axis: str, findings: list | None = None, candidates: list | None = None, stats: dict | None = None) -> dict:
    stats = dict(stats or {})
    result = {"axis": axis, "findings": findings or [], "stats": {"files_scanned": stats.pop("files_scanned", 0), "excluded": stats.pop("excluded", []), "skipped": stats.pop("skipped", False), **stats}}
    if candidates is not None:
        result["candidates"] = candidates
    if problems := validate_scan_result(result):
        raise FindingError("invalid scan result", problems)
    return result


def create_skipped_scan_result(axis: str, reason: str) -> dict:
    if not reason:
        raise FindingError("a skipped axis needs a reason")
    return create_scan_result(axis, [], None, {"skipped": True, "skip_reason": reason})


# == as DataFrames


def empty(spark: SparkSession, schema: StructType = FINDING) -> DataFrame:
    return spark.createDataFrame([], schema)


def findings_frame(df: DataFrame, axis: str, code: str, severity: Column | str, message: Column, locations: Column, payload: Column, order: list[Column]) -> DataFrame:
    """df's rows as findings, one of each, in FINDING's schema; order by order is kept in sort, not in ord."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(axis).alias("axis"), level.alias("severity"), F.lit(code).alias("code"), message.alias("message"), locations.cast(ArrayType(LOCATION)).alias("locations"), payload.alias("payload"), F.struct(*order).cast("string").alias("sort"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fold(findings: DataFrame) -> DataFrame:
    """Findings of one (code, first file, first line) as one: found_by has the axes in
    order of arrival, the severity is the highest, message and payload are the first's,
    and the later locations of all are joined without repetition. coverage.* stays apart."""
    first = F.get("locations", F.lit(0))
    base = findings.withColumns({"file": first["file"], "at": first["line"]})
    apart = base.where(F.col("code").startswith("coverage."))
    rest = base.where(~F.col("code").startswith("coverage."))
    member = F.array_sort(F.collect_list(F.struct("ord", "axis", rank_column(F.col("severity")).alias("rank"), "locations", "message", "payload")))
    grouped = rest.groupBy("code", "file", "at").agg(member.alias("all"))
    later = F.expr("flatten(transform(slice(all, 2, greatest(size(all) - 1, 0)), x -> slice(x.locations, 2, greatest(size(x.locations) - 1, 0))))")
    key = lambda x: F.concat_ws("\0", x["file"], F.coalesce(x["line"].cast("string"), F.lit("")))
    # of the later locations the first of each (file, line), and none that the first finding has
    start = F.col("all")[0]["locations"]
    new = F.aggregate(
        later,
        start,
        lambda acc, x: F.when(F.exists(acc, lambda y: key(y) == key(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    folded = grouped.select(
        F.col("all")[0]["ord"].alias("ord"),
        F.col("all")[0]["axis"].alias("axis"),
        severity_column(F.array_max(F.transform("all", lambda x: x["rank"]))).alias("severity"),
        "code",
        F.col("all")[0]["message"].alias("message"),
        new.alias("locations"),
        F.col("all")[0]["payload"].alias("payload"),
        F.array_distinct(F.transform("all", lambda x: x["axis"])).alias("found_by"),
    )
    return folded.unionByName(apart.select(*FINDING.names, F.array("axis").alias("found_by")))


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row: block, warn, info and all."""
    count = lambda s: F.count(F.when(F.col("severity") == s, True)).alias(s)
    return findings.agg(count("block"), count("warn"), count("info"), F.count("*").alias("findings"))


def per_axis(folded: DataFrame) -> DataFrame:
    return folded.select(F.explode("found_by").alias("axis")).groupBy("axis").agg(F.count("*").alias("findings"))


def waived(folded: DataFrame, codes: list[str]) -> tuple[DataFrame, DataFrame]:
    """folded with the waived codes at info, and how often each code was waived."""
    spark = folded.sparkSession
    hit = F.col("code").isin(codes) if codes else F.lit(False)
    wanted = spark.createDataFrame([(c, i) for i, c in enumerate(codes)], "code string, at int")
    applied = wanted.join(folded.groupBy("code").agg(F.count("*").alias("n")), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("applied"), "at")
    return folded.withColumn("severity", F.when(hit, "info").otherwise(F.col("severity"))), applied


def report_order(folded: DataFrame) -> DataFrame:
    return folded.orderBy(rank_column(F.col("severity")).desc(), "code", "ord")
