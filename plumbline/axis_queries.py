"""Whole axes, and the resolution of declared names, on the relational tables, with equivalent SQL.

As in queries, documents are rendered from the tables with known defects; here the
findings and candidates of an axis are what is compared."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import queries as Q
from plumbline.context import context_of
from plumbline.operators import concepts, decisions, links, numbers, ownership
from plumbline.operators import markdown as M
from plumbline.operators.base import AxisResult
from plumbline.queries import docs_of, lines_of, longs, query, rendered, table, text
from plumbline.sources.corpus import corpus_of
from plumbline.sources.scratch import stored


def produced(axis: Callable, rows: list[DataFrame], config: dict | None = None, **more) -> AxisResult:
    """An axis over the documents of one row for each line."""
    context = context_of({"docs": {"root": "docs"}, **(config or {})}, "/nonexistent")
    corpus = corpus_of(stored(rendered(reduce(DataFrame.unionByName, rows))), context.config)
    return axis(context, corpus, stored(M.parsed(corpus.documents)), **more)


def found(result: AxisResult) -> DataFrame:
    first = F.col("locations")[0]
    return result.findings.select("code", "severity", "payload", first["file"].alias("file"), first["line"].cast("long").alias("line"), F.size("locations").cast("long").alias("n_places"))


def of_nations(spark: SparkSession, sf_dir: str, line) -> list[DataFrame]:
    """A document for each nation: its heading, and a line for each of its suppliers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return [
        lines_of(n, text("nation-%d.md", F.col("n_nationkey")), F.lit(-1), text("# Nation %d", F.col("n_nationkey"))),
        lines_of(s, text("nation-%d.md", F.col("s_nationkey")), F.col("s_suppkey"), line),
    ]


_LINES = "WITH s AS (SELECT s_suppkey AS s, s_nationkey AS k, 1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS line FROM supplier) "


# == headings and sections


@query(
    """
    WITH h AS (
      SELECT c_nationkey AS n, c_custkey % 3 + 1 AS level, 2 * row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS line, 2 * count(*) OVER (PARTITION BY c_nationkey) AS total FROM customer)
    SELECT 'nation-' || n || '.md' AS path, line, level, coalesce((SELECT min(x.line) FROM h x WHERE x.n = h.n AND x.line > h.line AND x.level <= h.level) - 1, total) AS last_line FROM h"""
)
def heading_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where sections end: before the next heading of their level or a higher one."""
    c, path = table(spark, sf_dir, "customer"), text("nation-%d.md", F.col("c_nationkey"))
    marks = F.repeat(F.lit("#"), (F.col("c_custkey") % 3 + 1).cast("int"))
    docs = docs_of(lines_of(c, path, F.col("c_custkey") * 2, F.concat(marks, F.lit(" "), "c_mktsegment")), lines_of(c, path, F.col("c_custkey") * 2 + 1, F.col("c_name")))
    return longs(M.headings(docs).select("path", "line", "level", F.col("end").alias("last_line")), "line", "level", "last_line")


@query(
    """
    WITH s AS (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS line FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT 'nation-' || k || '.md' AS path, line, section, via, found FROM s, (VALUES ('1', 'link', true), ('2', 'link', true), ('9', 'link', false), ('1', 'self', false)) t(section, via, found)"""
)
def section_enumerations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in a row share what the first of them points to; words between them end the row."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    r, path = table(spark, sf_dir, "region"), text("region-%d.md", F.col("r_regionkey"))
    docs = docs_of(
        lines_of(r, path, F.lit(1), F.lit("## 1. First")),
        lines_of(r, path, F.lit(2), F.lit("## 2. Second")),
        lines_of(s, text("nation-%d.md", F.col("s_nationkey")), F.col("s_suppkey"), text("see [it](region-%d.md) §1·§2, §9 and then §1", "n_regionkey")),
        once=True,
    )
    rows = links.section_targets(links.section_refs(docs), links.resolved(docs), links.registry(docs), docs)
    return longs(rows.select("path", "line", "section", "via", "found"), "line")


# == links


@query(
    _LINES
    + """SELECT 'nation-' || k || '.md' AS path, line, CASE s % 6 WHEN 2 THEN 'route' WHEN 3 THEN 'anchor' WHEN 4 THEN 'external' WHEN 5 THEN 'path' ELSE 'manifest-id' END AS kind,
      s % 6 NOT IN (1, 5) AS ok, CASE WHEN s % 6 IN (0, 3) THEN 'nation-' || k || '.md' END AS target_path FROM s"""
)
def manifest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by declared ids, routes, percent-encoded anchors, addresses and paths."""
    s, k = F.col("s_suppkey") % 6, F.col("s_nationkey")
    to = F.when(s == 0, text("#ns/nation-%d", k)).when(s == 1, text("#ns/none-%d", k)).when(s == 2, "#home").when(s == 3, F.concat(F.lit("#%6Eation-"), k)).when(s == 4, text("http://example.org/%d", k)).otherwise(text("nation-%d.md#gone", k))
    docs = docs_of(*of_nations(spark, sf_dir, F.concat(F.lit("[x]("), to, F.lit(")"))), once=True)
    # a manifest is a declaration: an entry for each nation
    entries = [{"id": f"ns/nation-{x.n_nationkey}", "path": f"docs/nation-{x.n_nationkey}.md", "title": x.n_name} for x in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    rows = links.resolved(docs, True, False, links.manifest_ids(docs, entries, "docs"), ["home"])
    return longs(rows.select("path", "line", "kind", "ok", "target_path"), "line")


@query(_LINES + "SELECT CASE s % 4 WHEN 0 THEN 'links.unverified-anchor' WHEN 1 THEN 'links.external-section' ELSE 'links.unverified-section' END AS code, 'info' AS severity, count(*) AS n_places FROM s WHERE s % 4 < 3 GROUP BY 1, 2")
def link_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be verified, one finding of each kind with all its places."""
    s = F.col("s_suppkey") % 4
    line = F.when(s == 0, "[x](#ns/one)").when(s == 1, "see ISO42 §3").when(s == 2, "[y](http://example.org) §4").otherwise("plain")
    return found(produced(links.run_axis, of_nations(spark, sf_dir, line))).select("code", "severity", "n_places")


@query(_LINES + "SELECT 'links.dead-target' AS code, CASE WHEN CAST(k AS VARCHAR) LIKE '1%' THEN 'warn' ELSE 'block' END AS severity, 'nation-' || k || '.md' AS file, line FROM s WHERE s % 2 = 0")
def frozen_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead links: in frozen documents they warn, in others they block."""
    line = F.when(F.col("s_suppkey") % 2 == 0, text("[gone](none-%d.md)", F.col("s_suppkey"))).otherwise("none")
    config = {"docs": {"root": "docs", "frozen": ["nation-1*.md"]}}
    return found(produced(links.run_axis, of_nations(spark, sf_dir, line), config)).select("code", "severity", "file", "line")


@query(
    Q._LINKED
    + """, c AS (
      SELECT path, line, name, CAST(round(greatest(1 - levenshtein('customer', lower(name)) / greatest(8, length(name)),
        CASE WHEN contains(CASE WHEN length(name) > 8 THEN lower(name) ELSE 'customer' END, CASE WHEN length(name) > 8 THEN 'customer' ELSE lower(name) END) THEN 0.5 + 0.5 * least(8, length(name)) / greatest(8, length(name)) ELSE 0.0 END), 3) AS DOUBLE) AS score
      FROM (SELECT path, line, unnest(['Customer ' || o_custkey, '1. Contact', 'Contact', CAST(o_custkey AS VARCHAR)]) AS name FROM l WHERE there AND anchor = '' AND said = 'CUSTOMER'))
    SELECT path, line, name, score FROM c QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY score DESC, name) <= 3"""
)
def display_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three names of a target that are closest to one that it lacks."""
    docs = Q._linked(spark, sf_dir)
    whole, anchored = links.target_names(docs, links.document_names(docs))
    rows = links.display_mismatch(links.displays(stored(links.resolved(docs))), whole, anchored)
    return longs(rows.select("path", "line", F.explode("candidates").alias("c")).select("path", "line", "c.name", F.col("c.score").cast("double").alias("score")), "line")


# == names, numbers and owners


@query("SELECT name, other AS dominant, other_occurrences AS dominant_occurrences FROM (" + Q.SQL["ghost_ids"] + ") QUALIFY row_number() OVER (PARTITION BY name ORDER BY other_occurrences DESC, other) = 1")
def ghost_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rare name with the most frequent of those it resembles."""
    p = table(spark, sf_dir, "part")
    result = produced(concepts.run_axis, [lines_of(p, text("size-%d.md", F.col("p_size")), F.col("p_partkey"), F.concat(F.lit("uses `"), Q._rare_name(), F.lit("` and `plain`")))])
    c = lambda at: F.get_json_object("candidate", at)
    return result.candidates.where("kind = 'ghost'").select(c("$.name").alias("name"), c("$.dominant.name").alias("dominant"), c("$.dominant.occurrences").cast("long").alias("dominant_occurrences"))


@query(
    """
    SELECT CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 'numbers.unverifiable' ELSE 'numbers.data-mismatch' END AS code,
      CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 'warn' ELSE 'block' END AS severity, o_orderpriority || ' orders' AS label,
      CASE WHEN o_orderpriority LIKE '4%' OR o_orderpriority LIKE '5%' THEN 1 ELSE 20 END AS n_places
    FROM (SELECT DISTINCT o_orderpriority FROM orders)"""
)
def measurement_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented numbers against declared measurements: half of the documents are wrong,
    one measurement fails and one gives no number."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    d = m.withColumn("doc", F.explode(F.sequence(F.lit(0), F.lit(39))))
    said = F.when(F.col("doc") % 2 == 0, F.col("n")).otherwise(F.col("n") + F.col("doc"))
    counts = {x.o_orderpriority: x.n for x in m.collect()}  # a handful of labels

    def measured(cmd: str, cwd: str) -> str:
        if cmd.startswith("4"):
            raise RuntimeError("no such table")
        return "no number" if cmd.startswith("5") else f"rows of orders\n{counts[cmd]}\n"

    config = {"measurements": [{"label": f"{p} orders", "cmd": p} for p in sorted(counts)]}
    rows = [lines_of(d, text("doc-%d.md", F.col("doc")), F.xxhash64("o_orderpriority"), text("%s orders are %d, then 7 others", "o_orderpriority", said))]
    out = found(produced(numbers.run_axis, rows, config, run=measured)).where("code IN ('numbers.unverifiable', 'numbers.data-mismatch')")
    return out.select("code", "severity", F.get_json_object("payload", "$.label").alias("label"), "n_places")


@query(Q._SUPPLIERS + "SELECT 'ownership.drifted-copy' AS code, 'block' AS severity, 'notes-' || n_nationkey || '.md' AS file, 2 AS n_places FROM n WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'ownership.owner-missing', 'block', 'plumbline.json', 1")
def owner_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that say something else than their owner, and an owner that isn't there."""
    _, docs = Q._suppliers(spark, sf_dir)
    context = context_of({"docs": {"root": "docs"}, "ownership": [{"what": "sizes", "owner": "sizes.md"}, {"what": "none", "owner": "gone.md"}]}, "/nonexistent")
    corpus = corpus_of(docs.select("path", F.lit("").alias("text")), context.config)
    return found(ownership.run_axis(context, corpus, docs)).select("code", "severity", "file", "n_places")


# == decisions


def _carried(spark: SparkSession, sf_dir: str) -> AxisResult:
    """Nations as decisions, each of which designates a document that cites it or doesn't;
    every fifth is superseded; some documents are excluded, others frozen."""
    names = [(x.n_nationkey, x.n_name) for x in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # the record is one document
    state = lambda k: f"superseded by ADR-{k + 1:03d}" if k % 5 == 0 else "accepted"
    body = "# Decisions\n" + "".join(f"## ADR-{k:03d} {name}\n- status: {state(k)}\n- decision: in [it](nation-{k}.md)\n" for k, name in names)
    some = lambda r: [f"nation-{k}.md" for k, _ in names if k % 7 == r]
    config = {"docs": {"root": "docs", "exclude": some(3), "frozen": some(4)}, "plugins": ["adr"], "adr": {"bodies": "decisions.md", "status_field": "status", "decision_field": "decision"}}
    k = F.col("s_nationkey")
    line = F.when((k % 2 == 0) & (F.col("s_suppkey") % 3 == 0), text("supplier %d by ADR-%03d", "s_suppkey", k)).otherwise("a supplier")
    return produced(decisions.run_axis, of_nations(spark, sf_dir, line), config, record=("decisions.md", body))


_CARRIED = """
    WITH n AS (
      SELECT n_nationkey AS k, 'ADR-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS decision_id, 'nation-' || n_nationkey || '.md' AS file,
        n_nationkey % 2 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) AS cites FROM nation)"""


@query(
    _CARRIED
    + """ SELECT CASE WHEN k % 7 = 3 THEN 'decisions.target-out-of-scope' ELSE 'decisions.citation-missing' END AS code, CASE WHEN k % 7 = 3 THEN 'warn' ELSE 'block' END AS severity, decision_id, CASE WHEN k % 7 = 3 THEN 'decisions.md' ELSE file END AS file
    FROM n WHERE k % 5 <> 0 AND (k % 7 = 3 OR (k % 7 <> 4 AND NOT cites))"""
)
def decision_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designated documents that don't cite their decision, or that the run doesn't see
    (told at the link in the record); frozen ones are not reported."""
    return found(_carried(spark, sf_dir)).select("code", "severity", F.get_json_object("payload", "$.decision_id").alias("decision_id"), "file")


@query(
    _CARRIED
    + """, s AS (SELECT s_suppkey AS s, s_nationkey AS k, 1 + row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS line FROM supplier)
    SELECT 'reflection' AS kind, decision_id, file, NULL AS line, cites FROM n WHERE k % 5 <> 0 AND k % 7 <> 3
    UNION ALL SELECT 'stale_supersede', decision_id, file, line, NULL FROM n JOIN s USING (k) WHERE k % 10 = 0 AND k % 7 <> 3 AND s % 3 = 0"""
)
def decision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted decisions with what they designate, and lines that still cite superseded ones."""
    c = lambda at: F.get_json_object("candidate", at)
    return _carried(spark, sf_dir).candidates.select("kind", c("$.decision_id").alias("decision_id"), F.coalesce(c("$.target.file"), c("$.targets[0].file")).alias("file"), c("$.target.line").cast("long").alias("line"), c("$.targets[0].cites_decision").cast("boolean").alias("cites"))
