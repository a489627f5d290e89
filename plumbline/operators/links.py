"""Links and anchors: dead targets and sections, displayed names that the target lacks, and names that vary."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.context import RunContext
from plumbline.findings import findings_frame, frozen_severity, union
from plumbline.functions import text as T
from plumbline.operators import markdown as M
from plumbline.operators.base import AxisResult
from plumbline.sources.corpus import Corpus
from plumbline.sources.manifests import candidate_paths, load_links_manifest

AXIS = "links"
SCHEME = r"(?i)^[a-z][-+.a-z\d]*:"
SECTION_PREFIX = rf"^§?\s*{M.DOTTED}[.]?(?:\s|$)"
DISCREDIT = 3
_BOUNDARY = "[\\s(\\[「\"'·,:/|>]"
_BOLD = r"^\s{0,3}(?:[*+-]|[0-9]+[).])?\s*[*]{2}([^*]+)[*]{2}"


# == the index of documents


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.(md|markdown)\z", "")


def titles(docs: DataFrame) -> DataFrame:
    """path and title: the first heading of level 1, else the first heading."""
    return M.headings(docs).groupBy("path").agg(F.min_by("text", F.struct(F.col("level") != 1, "line")).alias("title"))


def manifest_ids(docs: DataFrame, entries: list[dict], root: str) -> DataFrame:
    """id, title and path (null: no such document) of each manifest entry; a declared path is tried before <id>.md."""
    spark = docs.sparkSession
    rows = [(i, e["id"], e.get("title"), k, p) for i, e in enumerate(entries) for k, p in enumerate(candidate_paths(e, root))]
    tried = spark.createDataFrame(rows, "ord int, id string, title string, k int, path string")
    found = tried.join(M.documents(docs).select("path", F.lit(True).alias("there")), "path", "left").groupBy("ord", "id", "title")
    return found.agg(F.min_by(F.when(F.col("there"), F.col("path")), F.when(F.col("there"), F.col("k"))).alias("path"))


def document_names(docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """path, key and name: all that a document may be called by. Of names that differ in case or marks only the first is shown."""
    h = M.headings(docs)
    unnumbered = h.where("section IS NOT NULL").select("path", F.lit(1).alias("o1"), F.col("line").alias("o2"), F.lit(1).alias("o3"), F.regexp_replace("text", SECTION_PREFIX, "").alias("name"))
    parts = [h.select("path", F.lit(1).alias("o1"), F.col("line").alias("o2"), F.lit(0).alias("o3"), F.col("text").alias("name")), unnumbered]
    cells = M.table_cells(docs).where((F.col("col_idx") == 0) | T.stripped(F.col("cell")).rlike(r"^[*]{2}[^*]+[*]{2}\z"))
    parts.append(cells.select("path", F.lit(2), "line", "col_idx", "cell"))
    bold = F.regexp_extract("raw", _BOLD, 1)
    parts.append(M.lines(docs).where("NOT in_fence").select("path", F.lit(3), "line", F.lit(0), bold.alias("name")).where("name <> ''"))
    parts.append(M.documents(docs).select("path", F.lit(4), F.lit(0), F.lit(0), base_name(F.col("path")).alias("name")))
    if ids is not None:
        own = ids.where("path IS NOT NULL").groupBy("path").agg(F.min_by(F.struct("title", "id"), "ord").alias("e"))
        parts.append(own.select("path", F.lit(5), F.lit(0), F.lit(0), F.col("e.title").alias("name")))
        parts.append(own.select("path", F.lit(6), F.lit(0), F.lit(0), F.col("e.id").alias("name")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    named = every.select("path", "o1", "o2", "o3", T.clean_inline(F.col("name")).alias("name")).withColumn("key", F.lower("name")).where("key <> ''")
    return named.groupBy("path", "key").agg(F.min_by("name", F.struct("o1", "o2", "o3")).alias("name"))


def registry(docs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """name and path: names that stand for one document. A name that two claim is dropped."""
    path = F.col("path")
    one = M.documents(docs)
    parts = [one.select("path", base_name(path).alias("n")), one.select("path", F.regexp_replace(path, r"(?i)\.(md|markdown)\z", "").alias("n")), titles(docs).select("path", F.col("title").alias("n"))]
    if ids is not None:
        own = ids.where("path IS NOT NULL").groupBy("path").agg(F.min_by(F.struct("title", "id"), "ord").alias("e"))
        parts += [own.select("path", F.col("e.title").alias("n")), own.select("path", F.col("e.id").alias("n"))]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    named = every.select("path", T.name_key(F.col("n")).alias("name")).where("name <> ''").distinct()
    return named.groupBy("name").agg(F.count("*").alias("n"), F.first("path").alias("path")).where("n = 1").select("name", "path")


# == link resolution


def joined_path(base: Column, path: Column) -> Column:
    """path relative to the document base, normalised: . and .. are resolved, leading .. kept."""
    raw = F.when(path.startswith("/"), F.substring(path, F.lit(2), F.length(path))).otherwise(F.concat(F.regexp_replace(base, r"[^/]*\z", ""), path))
    parts = F.filter(F.split(raw, "/"), lambda s: (s != "") & (s != "."))
    up = lambda acc: (F.size(acc) > 0) & (F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit("..")) != "..")
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & up(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    out = F.array_join(walked, "/")
    return F.when(out == "", ".").otherwise(out)


def resolved(docs: DataFrame, declared: bool = False, broken: bool = False, ids: DataFrame | None = None, routes: list[str] | None = None, on_disk: DataFrame | None = None) -> DataFrame:
    """Each link with kind, ok, checkable, target_path, fragment, anchor, key, id, norm_path and reason.

    The first rule that fits holds: blank, external, manifest id (#ns/id), declared
    route, anchor of the document, path with or without an anchor. on_disk: path of
    files that exist outside the corpus; a link to one is neither dead nor checked."""
    links = M.view(docs, "links")
    t = T.stripped(F.col("target"))
    at = F.instr(t, "#")
    rows = links.withColumns({"t": t, "p": F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise(t), "f": F.when(at > 0, F.substring(t, at + 1, F.length(t)))})
    rows = rows.withColumn("d", T.decoded(F.col("f"))).withColumn("slug", T.slug(F.col("d")))
    has_f, no_path = F.coalesce(F.col("f") != "", F.lit(False)), F.col("p") == ""
    is_route = F.col("d").isin(routes) if routes else F.lit(False)
    kind = (
        F.when(F.col("t") == "", "empty")
        .when(F.col("t").rlike(SCHEME) | F.col("t").startswith("//"), "external")
        .when(no_path & has_f & F.col("f").contains("/"), F.lit("manifest-id" if declared and not broken else "unverified-id"))
        .when(no_path & has_f & is_route, "route")
        .when(no_path & has_f, "anchor")
        .when(no_path, "empty")
        .otherwise("path")
    )
    rows = rows.withColumn("kind", kind).withColumn("norm_path", F.when(F.col("kind") == "path", joined_path(F.col("path"), F.col("p"))))
    rows = rows.withColumn("to", F.when(F.col("kind") == "anchor", F.col("path")).otherwise(F.col("norm_path")))
    if ids is not None:
        one = ids.select(F.col("id").alias("d"), F.struct("path", "id").alias("full"))
        two = ids.select(F.col("id").alias("last"), F.struct("path", "id").alias("bare"))
        rows = rows.join(one, "d", "left").withColumn("last", F.element_at(F.split("d", "/"), -1)).join(two, "last", "left")
        rows = rows.withColumn("hit", F.when(F.col("kind") == "manifest-id", F.coalesce("full", "bare"))).drop("full", "bare", "last")
        rows = rows.withColumn("to", F.when(F.col("kind") == "manifest-id", F.col("hit.path")).otherwise(F.col("to"))).withColumn("id_known", F.col("hit").isNotNull()).drop("hit")
    else:
        rows = rows.withColumn("id_known", F.lit(False))
    there = M.documents(docs).select(F.col("path").alias("to"), F.lit(True).alias("there"))
    anchors = M.headings(docs).select(F.col("path").alias("to"), F.col("anchor").alias("slug"), F.lit(True).alias("anchored")).distinct()
    rows = rows.join(there, "to", "left").join(anchors, ["to", "slug"], "left")
    if on_disk is not None:
        rows = rows.join(on_disk.select(F.col("path").alias("norm_path"), F.lit(True).alias("disk")).distinct(), "norm_path", "left")
    else:
        rows = rows.withColumn("disk", F.lit(None).cast("boolean"))
    is_, yes = (lambda k: F.col("kind") == k), (lambda c: F.coalesce(F.col(c), F.lit(False)))
    reason = (
        F.when(is_("manifest-id") & ~F.col("id_known"), F.format_string("the manifest has no document \"%s\"", "d"))
        .when(is_("anchor") & ~yes("anchored"), F.format_string("this document has no heading \"#%s\"", "f"))
        .when(is_("path") & ~yes("there") & ~yes("disk"), F.format_string("there is no such file (%s)", "p"))
        .when(is_("path") & yes("there") & has_f & ~yes("anchored"), F.format_string("%s has no heading \"#%s\"", "norm_path", "f"))
    )
    rows = rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
    points = F.col("ok") & F.col("kind").isin("manifest-id", "anchor", "path") & yes("there")
    key = F.when(is_("manifest-id") | ~has_f, F.col("to")).otherwise(F.concat("to", F.lit("#"), "slug"))
    fragment = F.when(is_("manifest-id") | ~has_f, None).otherwise(F.col("d"))
    return rows.select("path", "frozen", "line", "col", "text", "target", "is_image", "raw", "kind", "ok", points.alias("checkable"), F.when(points, F.col("to")).alias("target_path"), F.when(points, fragment).alias("fragment"), F.when(points & fragment.isNotNull(), F.col("slug")).alias("anchor"), F.when(points, key).alias("key"), F.when(F.col("kind").isin("manifest-id", "unverified-id"), F.col("d")).alias("id"), "norm_path", "reason")


# == displayed names


def displays(links: DataFrame) -> DataFrame:
    """Checkable links with a displayed name: display, display_key."""
    d = T.clean_inline(F.col("text"))
    rows = links.where("checkable AND NOT is_image").withColumn("display", d).withColumn("display_key", F.lower("display"))
    same = (F.col("display_key") == T.name_key(F.col("target"))) | F.coalesce(F.col("display_key") == T.name_key(F.col("norm_path")), F.lit(False))
    return rows.where((F.col("display") != "") & F.col("display").rlike(r"[\p{L}\p{N}]") & ~same)


def target_names(docs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, key, name) of whole documents and (path, anchor, key, name) of headings."""
    h = M.headings(docs)
    own = h.select("path", "anchor", F.col("text").alias("n")).unionByName(h.where("section IS NOT NULL").select("path", "anchor", F.regexp_replace("text", SECTION_PREFIX, "").alias("n")))
    own = own.unionByName(h.select("path", "anchor").join(titles(docs), "path").select("path", "anchor", F.col("title").alias("n")))
    cleaned = own.select("path", "anchor", T.clean_inline(F.col("n")).alias("name")).withColumn("key", F.lower("name")).where("key <> ''")
    return names, cleaned.groupBy("path", "anchor", "key").agg(F.first("name").alias("name"))


def display_mismatch(shown: DataFrame, whole: DataFrame, anchored: DataFrame, limit: int = 3) -> DataFrame:
    """shown's rows whose target lacks the name, with the closest names that it has: candidates (name, score)."""
    keep = ["path", "line", "col", "kind", "display", "display_key", "target", "target_path", "fragment", "anchor"]
    rows = shown.select(*keep)
    a = rows.where("anchor IS NULL").join(whole.select(F.col("path").alias("target_path"), "key", "name"), "target_path")
    b = rows.where("anchor IS NOT NULL").join(anchored.select(F.col("path").alias("target_path"), "anchor", "key", "name"), ["target_path", "anchor"])
    every = a.select(*keep, "key", "name").unionByName(b.select(*keep, "key", "name"))
    at = ["path", "line", "col"]
    known = F.max(F.col("key") == F.col("display_key")).over(Window.partitionBy(*at))
    missed = every.withColumn("known", known).where("NOT known")
    w = Window.partitionBy(*at).orderBy(F.col("score").desc(), "name")
    best = missed.withColumn("score", T.name_score(F.col("display_key"), F.col("key"))).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    top = F.transform(F.array_sort(F.collect_list(F.struct("n", "name", "score"))), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))
    return best.groupBy(*keep).agg(top.alias("candidates"))


def display_variants(shown: DataFrame) -> DataFrame:
    """A row for each name that a target is called by less often than by another, or for
    all of a target's names where the most frequent are as many (three uses at least):
    key, target_path, tie, majority, majority_count, variant, variant_count, variants, places."""
    order = F.struct("path", "line", "col")
    votes = shown.where("NOT frozen").groupBy("key", "target_path", "display_key").agg(F.count("*").alias("n"), F.min_by("display", order).alias("display"), F.array_sort(F.collect_list(order)).alias("places"))
    by = Window.partitionBy("key")
    ranked = votes.withColumns({"rank": F.row_number().over(by.orderBy(F.col("n").desc(), "display")), "kinds": F.count("*").over(by), "total": F.sum("n").over(by), "top": F.max("n").over(by)})
    ranked = ranked.withColumn("tops", F.sum(F.when(F.col("n") == F.col("top"), 1).otherwise(0)).over(by)).where("kinds >= 2").withColumn("tie", F.col("tops") > 1)
    first = F.max(F.when(F.col("rank") == 1, F.col("display"))).over(by)
    ranked = ranked.withColumn("majority", first)
    minor = ranked.where("NOT tie AND rank > 1").select("key", "target_path", "tie", "majority", F.col("top").alias("majority_count"), F.col("display").alias("variant"), F.col("n").alias("variant_count"), F.lit(None).cast("array<struct<display:string,count:bigint>>").alias("variants"), "places")
    variant = F.transform(F.array_sort(F.collect_list(F.struct("rank", "display", "n"))), lambda v: F.struct(v["display"].alias("display"), v["n"].alias("count")))
    none = lambda t: F.lit(None).cast(t)
    tied = ranked.where("tie AND total >= 3").groupBy("key", "target_path").agg(variant.alias("variants"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    tied = tied.select("key", "target_path", F.lit(True).alias("tie"), none("string").alias("majority"), none("bigint").alias("majority_count"), none("string").alias("variant"), none("bigint").alias("variant_count"), "variants", "places")
    return minor.unionByName(tied)


# == sections


def section_refs(docs: DataFrame) -> DataFrame:
    """The § references outside fences and code spans that are no heading's own number,
    a row for each that share what they point to (a row of references, or those of a
    piece of a document after equal texts): path, frozen, line and pos of the first,
    link_col (of the link just before), one and two (the text before, for names; two
    null: as one), foreign (a name with digits), and all their lines, places and sections."""
    return M.view(docs, "refs")


def named_targets(refs: DataFrame, names: DataFrame) -> DataFrame:
    """path, line, pos, name and named_path: the longest registered name that ends the text
    before a reference, at a word's beginning. Names are joined by their last word."""
    last = lambda x: F.element_at(F.split(x, _BOUNDARY), -1)
    said = lambda k, s: F.struct(F.lit(k).alias("k"), F.lower(s).alias("s"))
    texts = F.when(F.col("two").isNull(), F.array(said(1, "one"))).otherwise(F.array(said(1, "one"), said(2, "two")))
    tried = refs.select("path", "line", "pos", F.explode(texts).alias("c")).select("path", "line", "pos", "c.k", "c.s")
    both = tried.withColumn("w", last(F.col("s"))).join(names.select("name", F.col("path").alias("named_path"), last(F.lower("name")).alias("w")), "w")
    before = F.substring(F.col("s"), F.length("s") - F.length("name"), F.lit(1))
    fits = both.where(F.col("s").endswith(F.col("name")) & ((F.length("s") == F.length("name")) | before.rlike(_BOUNDARY)))
    best = fits.groupBy("path", "line", "pos").agg(F.min_by(F.struct("name", "named_path"), F.struct("k", -F.length("name"))).alias("best"))
    return best.select("path", "line", "pos", "best.*")


def section_targets(refs: DataFrame, links: DataFrame, names: DataFrame, docs: DataFrame) -> DataFrame:
    """Each reference with via (link, unresolved-link, name, external or self), target_path, name and found."""
    keep = ["path", "frozen", "lines", "places", "sections"]
    none = F.lit(None).cast("string")
    by_link = links.select("path", "line", F.col("col").alias("link_col"), F.col("target_path").alias("link_path"), F.col("target").alias("link_target"))
    linked = refs.where("link_col IS NOT NULL").join(by_link, ["path", "line", "link_col"], "left")
    there = F.col("link_path").isNotNull()
    linked = linked.select(*keep, F.when(there, "link").otherwise("unresolved-link").alias("via"), F.col("link_path").alias("target_path"), F.when(~there, F.col("link_target")).alias("name"))
    plain = refs.where("link_col IS NULL")
    plain = plain.join(named_targets(plain, names), ["path", "line", "pos"], "left")
    via = F.when(F.col("named_path").isNotNull(), "name").when(F.col("foreign").isNotNull(), "external").otherwise("self")
    to = F.when(F.col("via") == "name", F.col("named_path")).when(F.col("via") == "self", F.col("path")).otherwise(none)
    name = F.when(F.col("via") == "name", F.col("name")).when(F.col("via") == "external", F.col("foreign")).otherwise(none)
    plain = plain.withColumn("via", via).select(*keep, "via", to.alias("target_path"), name.alias("name"))
    every = linked.unionByName(plain).select("path", "frozen", "via", "target_path", "name", F.explode(F.arrays_zip("lines", "places", "sections")).alias("x"))
    every = every.select("path", "frozen", F.col("x.lines").alias("line"), F.col("x.places").alias("pos"), F.col("x.sections").alias("section"), "via", "target_path", "name")
    # references to nothing known meet no section: they are spread by their documents
    at = F.coalesce("target_path", F.concat(F.lit("\0"), "path"))
    there = M.headings(docs).where("section IS NOT NULL").select(F.col("path").alias("at"), "section", F.lit(True).alias("found")).distinct()
    return every.withColumn("at", at).join(there, ["at", "section"], "left").drop("at").withColumn("found", F.coalesce("found", F.lit(False)))


def dead_sections(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References whose target lacks the section, and documents whose unattributed
    references miss so often (three times, and more often than not) that taking them
    for the document's own is given up: for these, one row of the second instead."""
    by = Window.partitionBy("path")
    self_ = F.col("via") == "self"
    counted = targets.where("target_path IS NOT NULL").withColumns({"hits": F.sum(F.when(self_ & F.col("found"), 1).otherwise(0)).over(by), "misses": F.sum(F.when(self_ & ~F.col("found"), 1).otherwise(0)).over(by)})
    discredited = self_ & (F.col("misses") >= DISCREDIT) & (F.col("misses") > F.col("hits"))
    own = targets.where(self_).groupBy("path", "frozen").agg(F.sum(F.col("found").cast("long")).alias("hits"), F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("line", "pos", "section")))).alias("misses"))
    given_up = own.where((F.size("misses") >= DISCREDIT) & (F.size("misses") > F.col("hits")))
    return counted.where(~F.col("found") & ~discredited), given_up


# == the axis


def _quotes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(M.lines(docs).select("path", "line", T.stripped(F.col("raw")).alias("quote")), ["path", "line"], "left")


def _place(path="path", line="line", quote="quote") -> Column:
    return F.struct(F.col(path).alias("file"), F.col(line).alias("line"), F.col(quote).alias("quote"))


def _order(code: str) -> list[Column]:
    return [F.col("path"), F.lpad(F.coalesce(F.col("line"), F.lit(0)).cast("string"), 9, "0"), F.lit(code)]


def _note(frozen: Column) -> Column:
    return F.when(frozen, " (a frozen document: for information)").otherwise("")


def _rolled(docs: DataFrame, rows: DataFrame, code: str, names: str, message: str, reason: str, link_type: str, list_name: str, raw: str) -> DataFrame:
    """rows as one finding with all their places."""
    each = _quotes(docs, rows.select("path", "line", F.coalesce("pos", F.lit(0)).alias("pos"), F.col(names).alias("name")))
    all_ = each.agg(F.array_sort(F.collect_list(F.struct("path", "line", "pos", "quote"))).alias("all"), F.array_sort(F.collect_set("name")).alias("names")).where("size(all) > 0")
    all_ = all_.withColumns({"path": F.col("all")[0]["path"], "line": F.col("all")[0]["line"]})
    places = F.transform("all", lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["quote"].alias("quote")))
    payload = F.to_json(F.struct(F.lit(link_type).alias("link_type"), F.col("names").alias(list_name), F.struct(F.lit(raw).alias("raw"), F.lit(False).alias("resolved"), F.lit(reason).alias("reason")).alias("target")))
    return findings_frame(all_, AXIS, code, "info", F.format_string(message, F.size("all")), places, payload, _order(code))


def run_axis(context: RunContext, corpus: Corpus, docs: DataFrame) -> AxisResult:
    spark: SparkSession = docs.sparkSession
    declared, entries, error = load_links_manifest(context)
    ids = manifest_ids(docs, entries, context.config["docs"]["root"]) if entries else (manifest_ids(docs, [], ".") if declared and not error else None)
    disk = None
    if corpus.root and os.path.isdir(corpus.root):
        disk = spark.createDataFrame(existing(context, docs), "path string")
    links = resolved(docs, declared, bool(error), ids, context.config["docs"]["routes"], disk)
    links = links.persist()
    found = []
    if declared and error:
        path = context.config["docs"]["manifest"]
        one = spark.createDataFrame([(path, error)], "path string, reason string").withColumn("line", F.lit(None).cast("int"))
        payload = F.to_json(F.struct(F.lit("manifest").alias("link_type"), F.struct(F.col("path").alias("raw"), F.lit(False).alias("resolved"), "reason").alias("target")))
        place = F.array(F.struct(F.col("path").alias("file"), F.col("line"), F.lit(None).cast("string").alias("quote")))
        found.append(findings_frame(one, AXIS, "links.manifest-unreadable", "warn", F.format_string("docs.manifest %s can't be read, so ids are not verified: %s", "path", "reason"), place, payload, _order("links.manifest-unreadable")))

    dead = _quotes(docs, links.where("NOT ok")).withColumn("display", T.clean_inline(F.col("text")))
    payload = F.to_json(F.struct(F.col("kind").alias("link_type"), "display", F.struct(F.col("target").alias("raw"), F.lit(False).alias("resolved"), "reason").alias("target"), "frozen"))
    message = F.concat(F.format_string("link to nothing: [%s](%s): %s", "display", "target", "reason"), _note(F.col("frozen")))
    found.append(findings_frame(dead, AXIS, "links.dead-target", frozen_severity(F.col("frozen"), "block"), message, F.array(_place()), payload, [*_order("links.dead-target"), F.lpad(F.col("col").cast("string"), 9, "0")]))

    refs = section_refs(docs)
    targets = section_targets(refs, links, registry(docs, ids), docs).persist()
    missed, given_up = dead_sections(targets)
    sections = docs.select(F.col("path").alias("target_path"), F.transform(F.filter("headings", lambda h: h["section"].isNotNull()), lambda h: h["section"]).alias("available"))
    missed = _quotes(docs, missed.join(sections, "target_path"))
    assumed = F.col("via") == "self"
    severity = F.when(F.col("frozen") | assumed, "warn").otherwise("block")
    none = F.size("available") == 0
    message = F.concat(F.when(none, F.format_string("§%s: %s has no numbered sections", "section", "target_path")).otherwise(F.format_string("§%s: %s has no such section (it has %s)", "section", "target_path", F.array_join("available", ", "))), F.when(assumed, "; taken for the document's own").otherwise(""), _note(F.col("frozen")))
    target = F.struct(F.concat(F.lit("§"), F.col("section")).alias("raw"), F.lit(False).alias("resolved"), F.col("target_path").alias("file"), F.col("available").alias("available_sections"), F.when(none, "the document has no numbered sections").otherwise("no section of that number").alias("reason"))
    payload = F.to_json(F.struct(F.lit("section").alias("link_type"), "section", F.col("via").alias("resolved_via"), F.when(F.col("via") == "name", F.col("name")).alias("resolved_by_name"), target.alias("target"), "frozen"))
    found.append(findings_frame(missed, AXIS, "links.dead-section", severity, message, F.array(_place()), payload, [*_order("links.dead-section"), F.lpad(F.col("pos").cast("string"), 9, "0")]))
    each = _quotes(docs, given_up.select("path", "frozen", "hits", F.explode("misses").alias("m")).select("path", "frozen", "hits", "m.line", "m.pos", "m.section"))
    up = each.groupBy("path", "frozen", "hits").agg(F.array_sort(F.collect_list(F.struct("line", "pos", "section", "quote"))).alias("all")).withColumn("line", F.col("all")[0]["line"])
    places = F.transform("all", lambda p: F.struct(F.col("path").alias("file"), p["line"].alias("line"), p["quote"].alias("quote")))
    payload = F.to_json(F.struct(F.lit("section").alias("link_type"), F.transform("all", lambda p: p["section"]).alias("sections"), F.col("hits").alias("self_hits"), F.struct(F.lit("§N").alias("raw"), F.lit(False).alias("resolved"), F.lit("not references within the document").alias("reason")).alias("target"), "frozen"))
    found.append(findings_frame(up, AXIS, "links.discredited-self", "info", F.format_string("%d references without a document miss this document's sections (%d hit): they are not compared", F.size("all"), "hits"), places, payload, _order("links.discredited-self")))

    shown = displays(links.where("NOT frozen"))
    whole, anchored = target_names(docs, document_names(docs, ids))
    wrong = _quotes(docs, display_mismatch(shown, whole, anchored))
    closest = F.get("candidates", F.lit(0))["name"]
    target = F.struct(F.col("target").alias("raw"), F.lit(True).alias("resolved"), F.col("target_path").alias("file"), F.col("fragment").alias("anchor"), F.lit("the target has no such title, heading or term").alias("reason"))
    payload = F.to_json(F.struct(F.col("kind").alias("link_type"), "display", target.alias("target"), closest.alias("closest"), "candidates"))
    found.append(findings_frame(wrong, AXIS, "links.display-mismatch", "warn", F.format_string("%s has no \"%s\"; closest is \"%s\"", "target_path", "display", closest), F.array(_place()), payload, [*_order("links.display-mismatch"), F.lpad(F.col("col").cast("string"), 9, "0")]))
    variants = display_variants(shown).withColumn("vid", F.concat_ws("\0", "key", "variant"))
    quotes = _quotes(docs, variants.select("vid", F.explode("places").alias("p")).select("vid", "p.path", "p.line", "p.col")).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("path", "line", "col", "quote"))).alias("all"))
    rows = variants.drop("places").join(quotes, "vid").withColumns({"path": F.col("all")[0]["path"], "line": F.col("all")[0]["line"]})
    places = F.transform("all", lambda p: F.struct(p["path"].alias("file"), p["line"].alias("line"), p["quote"].alias("quote")))
    payload = F.to_json(F.struct(F.lit("display-consistency").alias("link_type"), F.struct(F.col("key").alias("raw"), F.lit(True).alias("resolved"), F.col("target_path").alias("file")).alias("target"), "tie", "variants", "majority", "majority_count", "variant", "variant_count"))
    said = F.when(F.col("tie"), F.format_string("%s is called %s, none most often", "target_path", F.array_join(F.transform("variants", lambda v: v["display"]), ", "))).otherwise(F.format_string("%s is mostly called \"%s\" (%d times), here \"%s\" (%d)", "target_path", "majority", "majority_count", "variant", "variant_count"))
    found.append(findings_frame(rows, AXIS, "links.display-variant", "warn", said, places, payload, [*_order("links.display-variant"), F.col("key")]))

    why = "the manifest can't be read" if declared else "no docs.manifest is declared"
    found.append(_rolled(docs, links.where("kind = 'unverified-id'").withColumn("pos", F.col("col")), "links.unverified-anchor", "id", f"%d links to document ids are not verified: {why}", "the document ids are not known", "manifest-id", "ids", "docs.manifest"))
    found.append(_rolled(docs, targets.where("via = 'external'"), "links.external-section", "name", "%d section references follow a name from outside the corpus and are not compared", "points to a document outside the corpus", "section", "names", "§N"))
    found.append(_rolled(docs, targets.where("via = 'unresolved-link'"), "links.unverified-section", "name", "%d section references follow a link whose document is not known", "the link before it has no known document", "section", "targets", "§N"))
    return AxisResult(AXIS, union(found), None, corpus.excluded, docs)


def existing(context: RunContext, docs: DataFrame) -> list[tuple[str]]:
    """Files and directories under and beside docs.root that links may point to, as paths relative to it."""
    out = []
    for at, dirs, files in os.walk(context.repo_root):
        dirs[:] = [d for d in dirs if d not in (".git", "node_modules")]
        out += [(os.path.relpath(os.path.join(at, x), context.docs_root).replace(os.sep, "/"),) for x in [*dirs, *files]]
    return out or [("",)]
