"""The operators on the relational tables, with equivalent SQL.

The tables hold no Markdown, so most queries render documents from them, with
known defects, parse these and apply an operator; the SQL derives the same rows
from the tables themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import findings as E
from plumbline.context import normalize_config
from plumbline.functions import text as T
from plumbline.operators import concepts, decisions, links, numbers, ownership
from plumbline.operators import markdown as M
from plumbline.plans.merge import coverage
from plumbline.sources.corpus import corpus_of
from plumbline.sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rendered(rows: DataFrame, path: str = "path", order: str = "o", line: str = "line") -> DataFrame:
    """path and text of documents from one row for each line."""
    all_ = F.array_sort(F.collect_list(F.struct(order, line)))
    return rows.groupBy(path).agg(F.array_join(F.transform(all_, lambda x: x[line]), "\n").alias("text")).select(F.col(path).alias("path"), "text")


def docs_of(*parts: DataFrame, once: bool = False) -> DataFrame:
    """Parsed documents from one row for each line. once: written, for queries that read them more often."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    docs = M.parsed(rendered(rows))
    return stored(docs) if once else docs


def pieces_of(*parts: DataFrame, wanted: tuple[str, ...] = tuple(M.TYPES)) -> DataFrame:
    """As docs_of(), written, with documents of any length in pieces and only the wanted parts of them."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return stored(M.parsed_lines(rows, wanted))


def lines_of(df: DataFrame, path: Column, order: Column, line: Column) -> DataFrame:
    return df.select(path.alias("path"), order.cast("long").alias("o"), line.alias("line"))


def text(pattern: str, *columns) -> Column:
    return F.format_string(pattern, *columns)


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# == corpus and parser


@query(
    """
    SELECT lang || '/' || source || '/' || doc_id || '.md' AS path,
      CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'excluded' WHEN source = 'src1' OR (lang = 'fr' AND source = 'src2') THEN 'frozen'
        WHEN lang = 'fr' OR source LIKE 'src1_' THEN 'excluded' ELSE 'scanned' END AS status
    FROM documents"""
)
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include, exclude and frozen globs that overlap."""
    config = normalize_config({"docs": {"root": ".", "include": ["{en,fr,de}/**/*.md"], "exclude": ["fr/**", "*/src1?/*"], "frozen": ["*/src1/*.md", "fr/src2/**"]}})
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".md"))).alias("path"), "text")
    return corpus_of(files, config).files.select("path", "status")


@query(
    """
    SELECT doc_id || '.md' AS path, i AS line, length(string_split_regex(text, '\\r\\n|\\r|\\n')[i]) AS n_chars
    FROM documents, range(1, len(string_split_regex(text, '\\r\\n|\\r|\\n')) + 1) t(i)"""
)
def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), "text")
    return longs(M.lines(M.parsed(files)).select("path", "line", F.length("raw").alias("n_chars")), "line", "n_chars")


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 2 == 0, text("%d.%d ", F.col("c_custkey") % 9 + 1, F.col("c_custkey") % 4)).otherwise("")
    path = text("nation-%d.md", F.col("c_nationkey"))
    return docs_of(lines_of(c, path, F.col("c_custkey"), F.concat(F.lit("## "), number, "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, " ##").otherwise(""))))


_HEADED = """
    WITH h AS (
      SELECT 'nation-' || c_nationkey || '.md' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line,
        CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 9 + 1) || '.' || (c_custkey % 4) || ' ' ELSE '' END || c_mktsegment AS text,
        CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 9 + 1) || '.' || (c_custkey % 4) END AS section
      FROM customer),
    b AS (SELECT *, lower(replace(replace(text, '.', ''), ' ', '-')) AS base FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY path, base ORDER BY line) - 1 AS k FROM b)"""


@query(_HEADED + " SELECT path, line, text, section, base || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS anchor FROM n")
def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with section numbers and anchors that repeat."""
    return longs(M.headings(_headed(spark, sf_dir)).select("path", "line", "text", "section", "anchor"), "line")


@query(_HEADED + " SELECT path, section, min(line) AS line FROM n WHERE section IS NOT NULL GROUP BY path, section")
def heading_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading of each section number."""
    h = M.headings(_headed(spark, sf_dir)).where("section IS NOT NULL")
    return longs(h.groupBy("path", "section").agg(F.min("line").alias("line")), "line")


@query(
    """
    WITH r AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 2 AS line FROM nation)
    SELECT 'region-' || n_regionkey || '.md' AS path, line, k AS col_idx,
      CASE k WHEN 0 THEN CAST(n_nationkey AS VARCHAR) WHEN 1 THEN n_name || '|' || n_nationkey ELSE '' END AS cell
    FROM r, (VALUES (0), (1), (2)) t(k)"""
)
def md_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with escaped pipes and empty ones."""
    n = table(spark, sf_dir, "nation")
    path = text("region-%d.md", F.col("n_regionkey"))
    head = n.select("n_regionkey").distinct()
    docs = docs_of(
        lines_of(n, path, F.col("n_nationkey"), text("| %d | %s\\|%d |  |", "n_nationkey", "n_name", "n_nationkey")),
        lines_of(head, path, F.lit(-2), F.lit("| key | name | none |")),
        lines_of(head, path, F.lit(-1), F.lit("|:--|:-:|--:|")),
    )
    return longs(M.table_cells(docs).select("path", "line", "col_idx", "cell"), "line", "col_idx")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = text("size-%d.md", F.col("p_size"))
    body = text("part `%s` by [%s](parts/%d.md \"a part\"), ![x](i.png) and `[%s](no)`", "p_name", "p_brand", "p_partkey", "p_brand")
    return docs_of(lines_of(p, path, F.col("p_partkey"), body))


_PARTS = "WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS line FROM part) "


@query(
    _PARTS
    + """, b AS (SELECT *, 'part `' || p_name || '` by [' || p_brand || '](parts/' || p_partkey || '.md "a part"), ![x](i.png) and `[' || p_brand || '](no)`' AS raw FROM p)
    SELECT 'size-' || p_size || '.md' AS path, line, 6 AS col, p_name AS text FROM b
    UNION ALL SELECT 'size-' || p_size || '.md', line, strpos(raw, '`['), '[' || p_brand || '](no)' FROM b"""
)
def code_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(M.view(_parts(spark, sf_dir), "code_spans").select("path", "line", "col", "text"), "line", "col")


@query(_PARTS + "SELECT 'size-' || p_size || '.md' AS path, line, p_brand AS text, 'parts/' || p_partkey || '.md' AS target, false AS is_image FROM p UNION ALL SELECT 'size-' || p_size || '.md', line, 'x', 'i.png', true FROM p")
def md_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and images, but none within code spans."""
    return longs(M.view(_parts(spark, sf_dir), "links").select("path", "line", "text", "target", "is_image"), "line")


@query(
    """
    WITH l AS (
      SELECT s_nationkey, s_suppkey * 4 + j AS o, CASE WHEN s_suppkey % 3 = 0 THEN j < 3 ELSE false END AS in_fence
      FROM supplier, (VALUES (0), (1), (2), (3)) t(j))
    SELECT 'nation-' || s_nationkey || '.md' AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY o) AS line, in_fence FROM l"""
)
def fence_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier in a fence, whose closing mark may be longer."""
    s = table(spark, sf_dir, "supplier").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    fenced = F.col("s_suppkey") % 3 == 0
    body = F.when(fenced & (F.col("j") == 0), "```sql").when(fenced & (F.col("j") == 2), "`````").otherwise(F.concat(F.col("s_name"), F.lit(" ~~ ``x")))
    docs = docs_of(lines_of(s, text("nation-%d.md", F.col("s_nationkey")), F.col("s_suppkey") * 4 + F.col("j"), body))
    return longs(M.lines(docs).select("path", "line", "in_fence"), "line")


# == numbers


def _order_tables(spark: SparkSession, sf_dir: str, note: Column | None = None) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    path = text("customer-%d.md", F.col("o_custkey"))
    money = lambda c: text("%d.%02d", (c / 100).cast("long"), c % 100)
    per = o.groupBy("o_custkey").agg(F.sum("cents").alias("cents"))
    off = F.when(F.col("o_custkey") % 3 == 0, 100).when(F.col("o_custkey") % 3 == 1, -100).otherwise(0)
    parts = [
        lines_of(per, path, F.lit(-2), F.lit("| order | price | state |")),
        lines_of(per, path, F.lit(-1), F.lit("|---|--:|---|")),
        lines_of(o, path, F.col("o_orderkey"), text("| %d | **%s** | %s |", "o_orderkey", money(F.col("cents")), "o_orderstatus")),
        lines_of(per, path, F.lit(1 << 60), text("| Total | %s | - |", money(F.col("cents") + off))),
    ]
    if note is not None:
        parts.append(lines_of(per, path, F.lit((1 << 60) + 1), F.lit("")))
        parts.append(lines_of(per, path, F.lit((1 << 60) + 2), note))
    return docs_of(*parts)


_SUMS = """
    WITH o AS (
      SELECT o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, count(*) OVER (PARTITION BY o_custkey) AS n,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
    s AS (
      SELECT o_custkey, max(n) AS n_parts, sum(cents) AS cents, CASE o_custkey % 3 WHEN 0 THEN 100 WHEN 1 THEN -100 ELSE 0 END AS off FROM o GROUP BY o_custkey)
"""


@query(
    _SUMS
    + """SELECT 'customer-' || o_custkey || '.md' AS path, n_parts + 3 AS line, 'price' AS "column", n_parts,
      CAST(cents / 100.0 AS DOUBLE) AS parts_sum, CAST((cents + off) / 100.0 AS DOUBLE) AS declared, CASE WHEN off < 0 THEN 'over' ELSE 'under' END AS direction
    FROM s WHERE n_parts >= 2 AND off <> 0"""
)
def table_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals that are not the sum of their parts: a table of orders for each customer."""
    out = numbers.table_sums(_order_tables(spark, sf_dir)).select("path", "line", "column", "n_parts", F.col("parts_sum").cast("double").alias("parts_sum"), F.col("declared").cast("double").alias("declared"), "direction")
    return longs(out, "line", "n_parts")


@query(
    _SUMS
    + """SELECT 'customer-' || o_custkey || '.md' AS path, CASE WHEN off < 0 THEN 'over' ELSE 'under' END AS direction,
      CASE o_custkey % 4 WHEN 0 THEN 'multi-assignment' WHEN 1 THEN 'elision' WHEN 2 THEN 'other-note' ELSE 'none' END AS note_kind,
      CASE WHEN off < 0 AND o_custkey % 4 = 2 THEN 'warn' ELSE 'block' END AS severity
    FROM s WHERE n_parts >= 2 AND off <> 0 AND NOT (off < 0 AND o_custkey % 4 = 0) AND NOT (off > 0 AND o_custkey % 4 = 1)"""
)
def table_sum_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes under a table explain a difference, or lower it."""
    k = F.col("o_custkey") % 4
    note = F.when(k == 0, "With double counting.").when(k == 1, "An excerpt.").when(k == 2, "As of today.").otherwise("")
    return numbers.table_sums(_order_tables(spark, sf_dir, note)).select("path", "direction", "note_kind", "severity")


@query(
    """
    WITH m AS (SELECT o_orderpriority AS p, o_custkey % 50 AS doc, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT lower(split_part(p, '-', 1)) AS label, count(DISTINCT n) AS n_values, count(*) AS n_places, CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS greatest
    FROM m GROUP BY 1 HAVING count(DISTINCT n) >= 2"""
)
def marker_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers marked with one label that disagree between documents."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 50).alias("doc")).agg(F.count("*").alias("n"))
    label = F.split("o_orderpriority", "-")[0]
    docs = docs_of(lines_of(o, text("doc-%d.md", F.col("doc")), F.xxhash64("o_orderpriority"), F.concat(F.lit("so <!-- n:"), label, F.lit("="), F.col("n"), F.lit(" -->"))))
    g = numbers.marker_divergence(numbers.marked_numbers(docs, r"n:([^=]+)=(\d[\d,]*)"))
    value = lambda i: F.element_at("distinct_values", i).cast("double")
    return g.select(F.col("key").alias("label"), F.size("distinct_values").cast("long").alias("n_values"), F.size("occurrences").cast("long").alias("n_places"), value(1).alias("least"), value(-1).alias("greatest"))


@query(
    """
    WITH n AS (SELECT c_mktsegment AS seg, c_nationkey AS doc, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT 'segment ' || lower(seg) || ' customers' AS label, count(DISTINCT n) AS n_values, count(*) AS n_places FROM n GROUP BY 1 HAVING count(DISTINCT n) >= 2"""
)
def prose_cross_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmarked numbers with one label: the widest label that disagrees; narrower ones add no place."""
    c = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    docs = docs_of(lines_of(c, text("nation-%d.md", F.col("c_nationkey")), F.xxhash64("c_mktsegment"), text("The segment %s customers %d in all, see `x 5` and §7.", "c_mktsegment", "n")))
    g = numbers.cross_document(numbers.prose_numbers(docs))
    return g.select(F.lower("label").alias("label"), F.size("distinct_values").cast("long").alias("n_values"), F.size("occurrences").cast("long").alias("n_places"))


@query(
    """
    WITH m AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1),
    d AS (SELECT p, n, doc, CASE WHEN doc % 2 = 0 THEN n ELSE n + doc END AS said FROM m, range(0, 40) t(doc))
    SELECT p || ' orders' AS label, CAST(n AS DOUBLE) AS measured, 'doc-' || doc || '.md' AS path, CAST(said AS DOUBLE) AS said FROM d WHERE said <> n"""
)
def measured_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented numbers against a count of the table; an aside and a table heading bind to nothing."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    d = m.withColumn("doc", F.explode(F.sequence(F.lit(0), F.lit(39))))
    said = F.when(F.col("doc") % 2 == 0, F.col("n")).otherwise(F.col("n") + F.col("doc"))
    body = F.when(F.col("doc") % 3 == 0, text("| %s orders | %d |", "o_orderpriority", said)).otherwise(text("%s orders are %d, then 7 others", "o_orderpriority", said))
    docs = docs_of(lines_of(d, text("doc-%d.md", F.col("doc")), F.xxhash64("o_orderpriority"), body))
    # the measurements are a handful of labels
    told = [(i, f"{x.o_orderpriority} orders", "count(*)", str(x.n), None, None) for i, x in enumerate(m.orderBy("o_orderpriority").collect())]
    rows = numbers.against_measured(docs, told)
    return rows.select("label", F.col("measured").cast("double").alias("measured"), F.explode("wrong").alias("w")).select("label", "measured", F.col("w.path").alias("path"), F.col("w.value").cast("double").alias("said"))


# == ownership


def _suppliers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")), "n_nationkey")
    owner = F.lit("sizes.md")
    copy = text("notes-%d.md", F.col("n_nationkey"))
    k = F.col("n_nationkey") % 4
    said = F.when(k == 1, F.col("n") + 1).otherwise(F.col("n"))
    one = n.limit(1)
    docs = docs_of(
        lines_of(one, owner, F.lit(-2), F.lit("| nation | suppliers |")),
        lines_of(one, owner, F.lit(-1), F.lit("|---|---|")),
        lines_of(n, owner, F.col("n_nationkey"), text("| %s | %d |", "n_name", "n")),
        lines_of(n, owner, F.lit(1000), F.lit("| total | 99999 |")).distinct(),
        lines_of(n, copy, F.lit(1), F.lit("# Notes")),
        lines_of(n, copy, F.lit(2), F.concat(text("- For %s we count %d in all.", "n_name", said), F.when(k == 2, " See [sizes](sizes.md).").otherwise(""))),
        once=True,
    )
    return n, docs


_SUPPLIERS = "WITH n AS (SELECT n_nationkey, n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) "


@query(_SUPPLIERS + "SELECT n_name AS name, CAST(n AS VARCHAR) AS value, 'suppliers' AS \"column\", 2 + row_number() OVER (ORDER BY n_nationkey) AS line FROM n")
def owned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner states; not its total."""
    _, docs = _suppliers(spark, sf_dir)
    items, _ = ownership.owned_items(docs, [{"what": "sizes", "owner": "sizes.md"}])
    return longs(items.select("name", "value", "column", "line"), "line")


@query(_SUPPLIERS + "SELECT n_name AS name, 'notes-' || n_nationkey || '.md' AS path, CASE n_nationkey % 4 WHEN 1 THEN 'different' ELSE 'same' END AS match, n_nationkey % 4 = 2 AS cited FROM n")
def restatements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that state an owned number again, or another one in its place."""
    _, docs = _suppliers(spark, sf_dir)
    items, _ = ownership.owned_items(docs, [{"what": "sizes", "owner": "sizes.md"}])
    return ownership.restatements(docs, items).join(items.select("id", "name"), "id").select("name", "path", "match", "cited")


@query(_SUPPLIERS + "SELECT n_name AS name, CAST(n_nationkey % 4 = 1 AS BIGINT) AS n_drifted, CAST(n_nationkey % 4 IN (0, 3) AS BIGINT) AS n_restated FROM n WHERE n_nationkey % 4 <> 2")
def drifted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that differ from the owner, and copies that don't cite it."""
    _, docs = _suppliers(spark, sf_dir)
    items, _ = ownership.owned_items(docs, [{"what": "sizes", "owner": "sizes.md"}])
    g = ownership.grouped(items, ownership.restatements(docs, items))
    return g.select("name", F.size("drifted").cast("long").alias("n_drifted"), F.size("restated").cast("long").alias("n_restated"))


# == concepts


def _rare_name() -> Column:
    """Of a part; a few have one part of the name more."""
    name = F.lower(F.regexp_replace(F.concat_ws("-", F.lit("part"), "p_brand", "p_type"), "[^A-Za-z0-9]+", "-"))
    return F.when(F.col("p_partkey") % 97 == 0, F.concat(name, F.lit("-x"))).otherwise(name)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return docs_of(lines_of(p, text("size-%d.md", F.col("p_size")), F.col("p_partkey"), F.concat(F.lit("uses `"), _rare_name(), F.lit("` and `plain`"))), once=True)


_NAMES = """
    WITH p AS (
      SELECT lower(regexp_replace('part-' || p_brand || '-' || p_type, '[^A-Za-z0-9]+', '-', 'g')) || CASE WHEN p_partkey % 97 = 0 THEN '-x' ELSE '' END AS name
      FROM part),
    n AS (SELECT name, count(*) AS occurrences FROM p GROUP BY name)"""


@query(_NAMES + " SELECT * FROM n")
def identifier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.identifiers(_names(spark, sf_dir)).select("name", F.col("occurrences").cast("long").alias("occurrences"))


@query(
    _NAMES
    + """, s AS (SELECT *, list_filter(string_split(name, '-'), lambda x: x <> '') AS parts FROM n),
    pairs AS (
      SELECT r.name, r.occurrences, d.name AS other, d.occurrences AS other_occurrences
      FROM s r JOIN s d ON r.occurrences <= 2 AND d.occurrences >= 3 AND d.occurrences >= 3 * r.occurrences AND r.name <> d.name AND r.parts[1] = d.parts[1]
      WHERE (len(r.parts) = len(d.parts) AND len(list_filter(range(1, len(r.parts) + 1), lambda i: r.parts[i] <> d.parts[i])) = 1)
        OR (len(r.parts) = len(d.parts) + 1 AND len(list_filter(range(1, len(r.parts) + 1), lambda i: list_concat(r.parts[1:i-1], r.parts[i+1:len(r.parts)]) = d.parts)) > 0)
        OR (len(d.parts) = len(r.parts) + 1 AND len(list_filter(range(1, len(d.parts) + 1), lambda i: list_concat(d.parts[1:i-1], d.parts[i+1:len(d.parts)]) = r.parts)) > 0))
    SELECT * FROM pairs"""
)
def ghost_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare names with a similar frequent one."""
    return longs(concepts.ghosts(concepts.identifiers(_names(spark, sf_dir))).drop("why", "rank"), "occurrences", "other_occurrences")


_FIELDS = ["custKey", "orderKey", "marketSegment", "accountBalance", "shipDate"]


@query(
    """
    WITH f(a, b) AS (VALUES ('cust', 'Key'), ('order', 'Key'), ('market', 'Segment'), ('account', 'Balance'), ('ship', 'Date')),
    n AS (SELECT DISTINCT a, b, c_custkey % 7 AS k FROM f, customer)
    SELECT a || b || k AS name, a || b AS candidate FROM n"""
)
def ghost_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the schema lacks, but has a similar field for."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("k")).distinct().withColumn("f", F.explode(F.lit(_FIELDS)))
    docs = docs_of(lines_of(c, text("k-%d.md", F.col("k")), F.xxhash64("f"), F.concat(F.lit("`"), "f", "k", F.lit("` `"), "f", F.lit("` `someOther`"))))
    gf = concepts.ghost_fields(concepts.identifiers(docs), spark.createDataFrame([(f,) for f in _FIELDS], "field string"))
    return gf.select("name", F.explode("candidates").alias("candidate"))


_CONCEPTS = ["the", "License", "idiot", "no such words"]


@query(
    """
    WITH c(concept) AS (VALUES ('the'), ('License'), ('idiot'), ('no such words')),
    l AS (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS raw FROM documents)
    SELECT concept, (SELECT count(*) FROM l WHERE contains(raw, concept)) AS occurrences FROM c"""
)
def concept_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with each tracked concept; those without any count as 0."""
    files = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".md")).alias("path"), "text")
    return longs(concepts.mentions(M.parsed(files), _CONCEPTS).select("concept", "occurrences"), "occurrences")


# == links


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each customer with a balance, and one of orders for each of 20 clerks that links to all customers."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    path = text("customers/%d.md", F.col("c_custkey"))
    there = c.where("c_acctbal > 0")
    anchor = F.when(F.col("o_orderkey") % 3 == 0, "#contact").when(F.col("o_orderkey") % 3 == 1, "#nowhere").otherwise("")
    said = F.when(F.col("o_orderkey") % 5 == 0, "CUSTOMER").otherwise(F.concat(F.lit("Customer "), F.col("o_custkey")))
    return pieces_of(
        lines_of(there, path, F.lit(1), F.concat(F.lit("# Customer "), "c_custkey")),
        lines_of(there, path, F.lit(2), F.lit("## 1. Contact")),
        lines_of(there, path, F.lit(3), F.concat(F.lit("Segment: "), "c_mktsegment")),
        lines_of(o, text("orders/%d.md", F.col("o_orderkey") % 20), F.col("o_orderkey"), F.concat(F.lit("Order by ["), said, F.lit("](../customers/"), "o_custkey", F.lit(".md"), anchor, F.lit(")"))),
        wanted=("lines", "headings", "table_rows", "links"),
    )


_LINKED = """
    WITH l AS (
      SELECT 'orders/' || (o_orderkey % 20) || '.md' AS path, row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY o_orderkey) AS line,
        o_orderkey, o_custkey, coalesce(c_acctbal > 0, false) AS there,
        CASE o_orderkey % 3 WHEN 0 THEN '#contact' WHEN 1 THEN '#nowhere' ELSE '' END AS anchor,
        CASE WHEN o_orderkey % 5 = 0 THEN 'CUSTOMER' ELSE 'Customer ' || o_custkey END AS said
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


@query(_LINKED + " SELECT path, line, '../customers/' || o_custkey || '.md' || anchor AS target, there AS document FROM l WHERE NOT there OR anchor IN ('#contact', '#nowhere')")
def dead_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to no document, or to a heading that the document lacks."""
    r = links.resolved(_linked(spark, sf_dir)).where("NOT ok")
    return longs(r.select("path", "line", "target", F.col("reason").contains("heading").alias("document")), "line")


@query(
    _LINKED
    + """, k AS (SELECT path, line, o_custkey, said, 'Customer ' || o_custkey AS name FROM l WHERE there AND anchor = '')
    SELECT path, line, said AS display, 'customers/' || o_custkey || '.md' AS target_path FROM k WHERE said = 'CUSTOMER'"""
)
def display_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed names that the target lacks."""
    docs = _linked(spark, sf_dir)
    whole, anchored = links.target_names(docs, links.document_names(docs))
    rows = links.display_mismatch(links.displays(stored(links.resolved(docs))), whole, anchored)
    return longs(rows.select("path", "line", "display", "target_path"), "line")


@query(
    _LINKED
    + """, v AS (SELECT o_custkey, lower(said) AS k, min(said) AS said, count(*) AS n FROM l WHERE there AND anchor = '' GROUP BY 1, 2),
    w AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS kinds, max(n) OVER (PARTITION BY o_custkey) AS top, sum(n) OVER (PARTITION BY o_custkey) AS total FROM v),
    x AS (SELECT *, count(*) FILTER (n = top) OVER (PARTITION BY o_custkey) AS tops FROM w WHERE kinds >= 2)
    SELECT 'customers/' || o_custkey || '.md' AS key, false AS tie, said AS variant, n AS variant_count FROM x WHERE tops = 1 AND n < top
    UNION ALL
    SELECT DISTINCT 'customers/' || o_custkey || '.md', true, NULL, CAST(NULL AS BIGINT) FROM x WHERE tops > 1 AND total >= 3"""
)
def display_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by which a target is called less often than by another."""
    return links.display_variants(links.displays(stored(links.resolved(_linked(spark, sf_dir))))).select("key", "tie", "variant", F.col("variant_count").cast("long").alias("variant_count"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    path = text("orders/order%d.md", F.col("o_orderkey"))
    own = text("orders/order%d.md", F.col("l_orderkey"))
    k = F.sequence(F.lit(1), F.lit(3))
    head = o.withColumn("k", F.explode(k))
    # by name, by link, without either, and after an outside name
    way = (F.col("l_orderkey") / 4).cast("long") % 4
    said = F.when(way == 0, F.lit("as in it: §")).when(way == 1, F.concat(F.lit("see [it](order"), "l_orderkey", F.lit(".md) §"))).when(way == 2, F.concat(F.lit("see order"), "l_orderkey", F.lit(" §"))).otherwise(F.lit("see ISO42 §"))
    return pieces_of(
        lines_of(head, path, F.col("k"), F.concat(F.lit("## "), "k", F.lit(". Part"))),
        lines_of(l, own, F.lit(100) + F.col("l_linenumber"), F.concat(said, F.col("l_linenumber"))),
        wanted=("headings", "links", "refs"),
    )


_SECTIONS = """
    WITH r AS (
      SELECT 'orders/order' || l_orderkey || '.md' AS path, 3 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line, CAST(l_linenumber AS VARCHAR) AS section,
        CASE (l_orderkey // 4) % 4 WHEN 0 THEN 'self' WHEN 1 THEN 'link' WHEN 2 THEN 'name' ELSE 'external' END AS via, l_linenumber <= 3 AS found
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


@query(_SECTIONS + " SELECT path, line, section, via, found AND via <> 'external' AS found FROM r")
def section_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What § references point to: a link before them, a name, something outside, or their own document."""
    docs = _sections(spark, sf_dir)
    rows = links.section_targets(links.section_refs(docs), links.resolved(docs), links.registry(docs), docs)
    return longs(rows.select("path", "line", "section", "via", "found"), "line")


@query(
    _SECTIONS
    + """, m AS (SELECT *, count(*) FILTER (via = 'self' AND NOT found) OVER (PARTITION BY path) AS misses, count(*) FILTER (via = 'self' AND found) OVER (PARTITION BY path) AS hits FROM r WHERE via <> 'external')
    SELECT path, line, section, via FROM m WHERE NOT found AND NOT (via = 'self' AND misses >= 3 AND misses > hits)"""
)
def dead_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _sections(spark, sf_dir)
    rows, _ = links.dead_sections(links.section_targets(links.section_refs(docs), links.resolved(docs), links.registry(docs), docs))
    return longs(rows.select("path", "line", "section", "via"), "line")


@query(
    _SECTIONS
    + """ SELECT path, count(*) FILTER (NOT found) AS n_misses, count(*) FILTER (found) AS hits FROM r WHERE via = 'self' GROUP BY path
    HAVING count(*) FILTER (NOT found) >= 3 AND count(*) FILTER (NOT found) > count(*) FILTER (found)"""
)
def discredited_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose references without a document are not their own."""
    docs = _sections(spark, sf_dir)
    _, up = links.dead_sections(links.section_targets(links.section_refs(docs), links.resolved(docs), links.registry(docs), docs))
    return longs(up.select("path", F.size("misses").alias("n_misses"), "hits"), "n_misses", "hits")


# == decisions


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as decisions: of each 200, a chain of 150, cycles of two, gaps and decisions that stand."""
    k = F.col("p_partkey")
    m = k % 200
    to = F.when((m < 150) | ((m > 150) & (k % 10 == 5)), k + 1).when(m <= 150, None).when(k % 10 == 6, k - 1).when(k % 10 == 7, k + 1000000)
    status = F.when(to.isNotNull(), "superseded").when(k % 2 == 0, "accepted").otherwise("draft")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k).alias("id"), status.alias("status"), F.when(to.isNotNull(), F.concat(F.lit("P"), to)).alias("superseded_by"), status.alias("status_raw"), F.col("p_name").alias("title"))


_DECISIONS = """
    WITH RECURSIVE t AS (
      SELECT p_partkey, CASE WHEN p_partkey % 200 < 150 OR (p_partkey % 200 > 150 AND p_partkey % 10 = 5) THEN p_partkey + 1 WHEN p_partkey % 200 = 150 THEN NULL
        WHEN p_partkey % 10 = 6 THEN p_partkey - 1 WHEN p_partkey % 10 = 7 THEN p_partkey + 1000000 END AS to_key FROM part),
    d AS (
      SELECT 'P' || p_partkey AS id, CASE WHEN to_key IS NOT NULL THEN 'superseded' WHEN p_partkey % 2 = 0 THEN 'accepted' ELSE 'draft' END AS status, 'P' || to_key AS superseded_by, p_partkey FROM t)"""


@query(
    _DECISIONS
    + """, walk AS (
      SELECT id, superseded_by AS at, [id, superseded_by] AS chain, false AS done FROM d WHERE superseded_by IS NOT NULL
      UNION ALL
      SELECT w.id, d.superseded_by, list_append(w.chain, d.superseded_by), list_contains(w.chain, d.superseded_by)
      FROM walk w JOIN d ON d.id = w.at WHERE NOT w.done AND d.superseded_by IS NOT NULL),
    last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY len(chain) DESC) AS n FROM walk)
    SELECT l.id, array_to_string(l.chain, '>') AS chain, CASE WHEN l.done THEN 'cycle' WHEN d.id IS NULL THEN 'missing' ELSE d.status END AS terminal
    FROM last l LEFT JOIN d ON d.id = l.at WHERE l.n = 1"""
)
def supersede_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers followed to their end, a gap or a cycle."""
    return decisions.chains(_decisions(spark, sf_dir)).select("id", F.array_join("chain", ">").alias("chain"), "terminal")


@query(
    _DECISIONS
    + """, c AS (SELECT 'P' || CASE WHEN p_partkey % 30 = 0 THEN p_partkey + 2000000 ELSE p_partkey END AS id, CASE WHEN p_partkey % 6 = 0 THEN 'Draft ' ELSE 'accepted' END AS card_status FROM part WHERE p_partkey % 3 <> 1)
    SELECT coalesce(d.id, c.id) AS id, CASE WHEN d.id IS NULL THEN 'card-orphan' WHEN d.status = 'superseded' THEN CASE WHEN c.id IS NOT NULL THEN 'card-unexpected' END
      WHEN c.id IS NULL THEN 'card-missing' WHEN lower(trim(c.card_status)) <> d.status THEN 'card-mismatch' END AS outcome
    FROM d FULL JOIN c ON d.id = c.id WHERE outcome IS NOT NULL"""
)
def cards_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions against their cards: two in three have one, some of a decision that isn't there."""
    p = table(spark, sf_dir, "part").where("p_partkey % 3 <> 1")
    of = F.when(F.col("p_partkey") % 30 == 0, F.col("p_partkey") + 2000000).otherwise(F.col("p_partkey"))
    cards = p.select(F.concat(F.lit("P"), of).alias("id"), F.when(F.col("p_partkey") % 6 == 0, "Draft ").otherwise("accepted").alias("card_status"), F.lit(1).alias("card_line"))
    return decisions.reconciled(_decisions(spark, sf_dir), cards, ("accepted", "draft")).select("id", "outcome")


@query(
    """
    WITH l AS (SELECT DISTINCT o_custkey % 40 AS doc, o_orderkey % 90 AS d, o_orderkey % 2 = 0 AS in_code FROM orders)
    SELECT 'ADR-' || lpad(CAST(d AS VARCHAR), 3, '0') AS id, 'doc-' || doc || '.md' AS path, count(*) AS n, bool_and(in_code) AS in_code FROM l GROUP BY 1, 2"""
)
def citation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cite a decision, in and out of fences."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("doc"), (F.col("o_orderkey") % 90).alias("d"), (F.col("o_orderkey") % 2 == 0).alias("in_code")).distinct()
    path = text("doc-%d.md", F.col("doc"))
    edge = o.select("doc").distinct()
    docs = docs_of(
        lines_of(o.where("NOT in_code"), path, F.col("d"), text("by ADR-%03d and ADR-%03d again", "d", "d")),
        lines_of(edge, path, F.lit(999), F.lit("~~~")),
        lines_of(o.where("in_code"), path, F.col("d") + 1000, text("x = ADR-%03d", "d")),
    )
    return decisions.citations(docs, r"ADR-\d{3}").groupBy("id", "path").agg(F.count("*").alias("n"), F.min("in_code").alias("in_code"))


# == findings and merge


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings: the type is the code, the user the file, the hour the line."""
    e = table(spark, sf_dir, "events")
    axis = F.when(F.col("event_id") % 3 == 0, "links").when(F.col("event_id") % 3 == 1, "numbers").otherwise("concepts")
    severity = F.when(F.col("event_id") % 5 == 0, "block").when(F.col("event_id") % 5 < 3, "warn").otherwise("info")
    place = lambda f, n: F.struct(f.cast("string").alias("file"), n.cast("int").alias("line"), F.lit(None).cast("string").alias("quote"))
    code = F.concat(F.when(F.col("event_id") % 50 == 0, "coverage.").otherwise("links."), "event_type")
    return e.select(F.col("event_id").alias("ord"), axis.alias("axis"), severity.alias("severity"), code.alias("code"), F.col("event_type").alias("message"), F.array(place(F.col("user_id"), F.hour("ts") + 1), place(F.col("user_id") % 5, F.col("event_id") % 3 + 1)).alias("locations"), F.lit(None).cast("string").alias("payload"))


_EVENTS = """
    WITH e AS (
      SELECT event_id AS ord, CASE event_id % 3 WHEN 0 THEN 'links' WHEN 1 THEN 'numbers' ELSE 'concepts' END AS axis,
        CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 5 < 3 THEN 1 ELSE 0 END AS rank, event_type,
        CASE WHEN event_id % 50 = 0 THEN 'coverage.' ELSE 'links.' END || event_type AS code, CAST(user_id AS VARCHAR) AS file, CAST(hour(ts) + 1 AS BIGINT) AS line,
        CAST(user_id % 5 AS VARCHAR) || ':' || (event_id % 3 + 1) AS extra
      FROM events),
    f AS (
      SELECT code, file, line, min(ord) AS ord, max(rank) AS rank, count(*) AS n, count(DISTINCT axis) AS n_axes,
        count(DISTINCT extra) FILTER (extra <> file || ':' || line) + CASE WHEN bool_or(ord = o AND extra = file || ':' || line) THEN 1 ELSE 0 END + 1 AS n_places
      FROM (SELECT *, min(ord) OVER (PARTITION BY code, file, line) AS o FROM e) WHERE code LIKE 'links.%' GROUP BY code, file, line
      UNION ALL
      SELECT code, file, line, ord, rank, 1, 1, 2 FROM e WHERE code LIKE 'coverage.%')"""


@query(_EVENTS + " SELECT code, file, line, ord, CASE rank WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, n_axes, n_places FROM f")
def fold_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one place as one, with the severest mark and all their axes."""
    f = E.fold(_events(spark, sf_dir))
    first = F.col("locations")[0]
    return longs(f.select("code", first["file"].alias("file"), first["line"].alias("line"), "ord", "severity", F.size("found_by").alias("n_axes"), F.size("locations").alias("n_places")), "line", "n_axes", "n_places")


@query(_EVENTS + " SELECT axis, CASE least(rank, CASE axis WHEN 'links' THEN 1 WHEN 'numbers' THEN 2 ELSE 0 END) WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, count(*) AS n FROM e GROUP BY 1, 2")
def cap_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = F.when(F.col("axis") == "links", "warn").when(F.col("axis") == "numbers", "block").otherwise("info")
    return _events(spark, sf_dir).select("axis", E.capped_column(F.col("severity"), cap).alias("severity")).groupBy("axis", "severity").agg(F.count("*").alias("n"))


@query(_EVENTS + " SELECT count(*) FILTER (rank = 2) AS block, count(*) FILTER (rank = 1) AS warn, count(*) FILTER (rank = 0) AS info, count(*) AS findings FROM f")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.severity_summary(E.fold(_events(spark, sf_dir)))


@query(_EVENTS + " SELECT c.code, count(f.code) AS applied FROM (VALUES ('links.click'), ('links.view'), ('links.none')) c(code) LEFT JOIN f ON f.code = c.code GROUP BY c.code")
def waiver_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each waived code was met, unmet ones too."""
    _, applied = E.waived(E.fold(_events(spark, sf_dir)), ["links.click", "links.view", "links.none"])
    return longs(applied.drop("at"), "applied")


@query(_EVENTS + ", x AS (SELECT DISTINCT axis, CASE WHEN code LIKE 'coverage.%' THEN CAST(ord AS VARCHAR) ELSE code || file || ':' || line END AS k FROM e) SELECT axis, count(*) AS findings FROM x GROUP BY axis")
def findings_per_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(E.per_axis(E.fold(_events(spark, sf_dir))), "findings")


@query(_EVENTS + " SELECT ord, row_number() OVER (ORDER BY rank DESC, code, ord) AS place FROM f")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a report, block first: a full ordering, since a report is one list."""
    f = E.fold(_events(spark, sf_dir))
    return f.select("ord", F.row_number().over(Window.orderBy(E.rank_column(F.col("severity")).desc(), "code", "ord")).cast("long").alias("place"))


@query(
    """
    WITH a AS (SELECT n_name AS axis, n_nationkey % 5 <> 4 AS active, n_nationkey % 3 <> 2 AS has_script, n_nationkey % 2 = 0 AS has_contract, n_nationkey AS k FROM nation),
    v AS (SELECT n_name AS axis, n_nationkey % 7 <> 3 AS ok FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT 'STRANGER', true)
    SELECT axis, 'script' AS side, 'coverage.missing' AS code FROM a WHERE active AND has_script AND k % 6 = 0
    UNION ALL
    SELECT coalesce(a.axis, v.axis), 'verdict', CASE WHEN a.active AND a.has_contract THEN CASE WHEN v.axis IS NULL THEN 'coverage.missing' WHEN NOT v.ok THEN 'coverage.invalid-verdict' END
      WHEN v.axis IS NOT NULL THEN 'coverage.unexpected-verdict' END AS code
    FROM a FULL JOIN v ON a.axis = v.axis WHERE code IS NOT NULL"""
)
def coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as axes: what was to be reported, against what was."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    axes = n.select(F.col("n_name").alias("axis"), F.when(k % 5 != 4, "active").otherwise("skipped").alias("state"), (k % 3 != 2).alias("has_script"), (k % 2 == 0).alias("has_contract"))
    scans = n.select(F.col("n_name").alias("axis"), F.when(k % 6 == 0, "crashed").otherwise("ok").alias("status"))
    verdicts = n.where(k % 4 != 1).select(F.col("n_name").alias("axis"), F.when(k % 7 != 3, "ok").otherwise("invalid").alias("status"))
    stranger = spark.createDataFrame([("STRANGER", "ok")], "axis string, status string")
    return coverage(axes, scans, verdicts.unionByName(stranger))


# == scalar functions


@query("SELECT p_partkey, CAST(round(greatest(1 - levenshtein(a, b) / greatest(length(a), length(b)), CASE WHEN contains(CASE WHEN length(a) >= length(b) THEN a ELSE b END, CASE WHEN length(a) >= length(b) THEN b ELSE a END) THEN 0.5 + 0.5 * least(length(a), length(b)) / greatest(length(a), length(b)) ELSE 0.0 END), 3) AS DOUBLE) AS score FROM (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)")
def name_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.name_score(F.lower("p_name"), F.lower("p_type")).cast("double").alias("score"))


_BLANK = r"\t-\r\x{85}\p{Z}"


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '[^{_BLANK}\p{{N}}\p{{L}}_-]+', '', 'g'), '[{_BLANK}]+', '-', 'g') AS slug FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as anchors."""
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))
