"""Decision records: citations of designated documents, chains of superseded decisions, status cards."""

from __future__ import annotations

import os
import posixpath
import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.context import RunContext, check_keys, is_object
from plumbline.findings import findings_frame, union
from plumbline.functions import text as T
from plumbline.operators import markdown as M
from plumbline.operators.base import AxisResult
from plumbline.sources.corpus import Corpus
from plumbline.sources.manifests import SourceError, load_cards, load_decision_manifest
from plumbline.sources.scratch import stored

AXIS = "decisions"
KEYS = ("bodies", "cards", "id_pattern", "status_field", "decision_field", "card_statuses")
POINTERS = ("decisions.supersede-dangling", "decisions.supersede-cycle", "decisions.target-out-of-scope")
_SEPARATOR = r"[\s:：.,)\]·—-]"
_AFTER = re.compile(rf"\s*§\s*({M.DOTTED})((?:\s*[,·]\s*§\s*{M.DOTTED})*)")
_EXTERNAL = re.compile(r"//|[a-z][-+.a-z0-9]*:", re.I)


@dataclass(frozen=True)
class Settings:
    bodies: str
    cards: str | None = None
    id_pattern: str = r"ADR-\d{3}"
    status_field: str = "상태"
    decision_field: str = "결정"
    card_statuses: tuple[str, ...] | None = None


def parse_settings(config: dict) -> Settings:
    """The plugin's own configuration; every violation is reported."""
    raw = config.get("adr")
    if not is_object(raw):
        raise SourceError("adr: must be an object")
    problems: list[str] = []
    check_keys(raw, KEYS, "adr", problems)
    for key in KEYS[:-1]:
        x = raw.get(key)
        if x is None:
            if key == "bodies":
                problems.append("adr.bodies: required")
        elif not isinstance(x, str) or not x:
            problems.append(f"adr.{key}: must be a non-empty string")
    statuses = raw.get("card_statuses")
    if statuses is not None:
        if not isinstance(statuses, list) or not statuses or not all(isinstance(s, str) and s.strip() for s in statuses):
            problems.append("adr.card_statuses: must be a non-empty array of non-empty strings")
            statuses = None
    for key, patterns in (("id_pattern", [raw.get("id_pattern")]), ("card_statuses", statuses or [])):
        for p in patterns:
            if isinstance(p, str):
                try:
                    re.compile(p)
                except re.error as e:
                    problems.append(f"adr.{key}: {p} is no regular expression ({e})")
    if problems:
        raise SourceError("invalid adr settings", problems)
    given = {k: raw[k] for k in KEYS[:-1] if raw.get(k) is not None}
    return Settings(**given, card_statuses=tuple(s.strip() for s in statuses) if statuses else None)


def declared_path(value: str, context: RunContext, label: str) -> str:
    tried = [os.path.normpath(os.path.join(base, value)) for base in (context.docs_root, context.repo_root)]
    for at in tried:
        if os.path.exists(at):
            return at
    raise SourceError(f"{label}: no such file {value} (tried {', '.join(tried)})")


def shown_path(at: str, context: RunContext) -> str:
    rel = os.path.relpath(at, context.docs_root).replace(os.sep, "/")
    return rel if not rel.startswith("..") else os.path.relpath(at, context.repo_root).replace(os.sep, "/")


# == bodies


def labelled_block(lines: list[dict], first: int, last: int, field: str) -> tuple[int, int, str] | None:
    """(line, last line, value) of the first line in a range that gives a field, with the lines that go on from it."""
    name = re.escape(field)
    strong = rf"(?P<mark>__|[*]{{2}})\s*{name}\s*(?:__|[*]{{2}})"
    pattern = re.compile(rf"\s*(?:[*+-]\s+)?(?:{strong}|{name})(?:\s*[:：]\s*|\s+)(?P<value>.+?)\s*\Z")
    stop = re.compile(r"\s*(?:[*+-]|[0-9]+[).])\s|\s{,3}(?:~~~|```|#{1,6}(?:\s|\Z))")
    for n in range(first, last + 1):
        if lines[n - 1]["in_fence"] or not (m := pattern.match(lines[n - 1]["raw"])):
            continue
        end = n
        while end < last and lines[end]["raw"].strip() and not stop.match(lines[end]["raw"]):
            end += 1
        return n, end, m["value"].strip()
    return None


DECISION = "seq int, id string, title string, heading_line int, level int, first int, last int, status_line int, status string, status_raw string, superseded_by string, d_first int, d_last int, d_text string"


def decisions_of(doc: dict, s: Settings) -> list[tuple]:
    """A row (DECISION) for each heading that starts with an id."""
    start = re.compile(rf"(?:{s.id_pattern})")
    lines, heads, out = doc["lines"], doc["headings"], []
    for k, h in enumerate(heads):
        m = start.match(h["text"])
        rest = h["text"][m.end() :] if m else ""
        if not m or (rest and not re.match(_SEPARATOR, rest)):
            continue
        last = next((x["line"] for x in heads[k + 1 :] if x["level"] <= h["level"]), len(lines) + 1) - 1
        status, body = labelled_block(lines, h["line"], last, s.status_field), labelled_block(lines, h["line"], last, s.decision_field)
        raw = status[2] if status else None
        old = bool(raw and re.search("supersed", raw, re.I))
        by = re.search(s.id_pattern, raw) if old else None
        text = "\n".join(x["raw"] for x in lines[body[0] - 1 : body[1]]).strip() if body else None
        out.append((len(out), m.group(), re.sub(rf"\A{_SEPARATOR}+", "", rest).strip(), h["line"], h["level"], h["line"], last, status[0] if status else None, "superseded" if old else raw.lower() if raw else None, raw, by.group() if by else None, body[0] if body else None, body[1] if body else None, text))
    return out


def chains(decisions: DataFrame) -> DataFrame:
    """id, chain and terminal (a status, cycle or missing; unknown without a status) of
    each superseded decision. Of records with one id the last counts. Pointers are
    followed by doubling: chains of any length take the logarithm of it in steps, each
    a join on ids, whose result is stored. A chain ends with the first id it meets again.
    What has ended is stored apart and joined only as what others run into: no row is
    joined by a null, and each has its terminal from the step that ends it."""
    order = F.col("seq") if "seq" in decisions.columns else F.struct("status", "superseded_by")
    last = decisions.groupBy("id").agg(F.max_by(F.struct("status", "superseded_by"), order).alias("d")).select("id", "d.*")
    to = last.select(F.col("id").alias("superseded_by"), F.coalesce("status", F.lit("unknown")).alias("stands"), F.col("superseded_by").isNotNull().alias("on"))
    first = last.where("superseded_by IS NOT NULL").select("id", "superseded_by").join(to, "superseded_by", "left")
    itself = F.col("id") == F.col("superseded_by")
    ends = F.when(itself, "cycle").when(F.col("on"), None).otherwise(F.coalesce("stands", F.lit("missing")))
    walk = stored(first.select("id", F.array("id", "superseded_by").alias("chain"), ends.alias("terminal")))
    ended, walk = [walk.where("terminal IS NOT NULL")], walk.where("terminal IS NULL")
    while not walk.isEmpty():
        onward = walk
        for e in ended:
            onward = onward.unionByName(e)
        onward = onward.select(F.col("id").alias("at"), F.col("chain").alias("more"), F.col("terminal").alias("stands"))
        met = walk.select("id", "chain", F.element_at("chain", -1).alias("at")).join(onward, "at")
        whole = F.concat("chain", F.slice("more", F.lit(2), F.size("more") - 1))
        grown = met.select("id", whole.alias("chain"), "stands").withColumn("fresh", F.size(F.array_distinct("chain")))
        cycle = F.col("fresh") < F.size("chain")
        grown = stored(grown.select("id", F.slice("chain", F.lit(1), F.col("fresh") + 1).alias("chain"), F.when(cycle, "cycle").otherwise(F.col("stands")).alias("terminal")))
        ended, walk = [*ended, grown.where("terminal IS NOT NULL")], grown.where("terminal IS NULL")
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out.select("id", "chain", "terminal")


# == designations


@dataclass(frozen=True)
class Resolver:
    base: str
    docs_root: str
    paths: frozenset
    ids: dict
    outside: dict


def _unquoted(x: str) -> str:
    try:
        return unquote(x, errors="strict")
    except UnicodeDecodeError:
        return x


def designation(target: str, r: Resolver) -> tuple[str, str | None, str | None]:
    """(status, file, reason): in-corpus, out-of-scope (with the corpus' reason) or not-a-document."""
    none = ("not-a-document", None, None)
    t = target.strip()
    if not t or _EXTERNAL.match(t):
        return none
    if t.startswith("#"):
        return by_id(t[1:], r) if "/" in t else none
    path = t.partition("#")[0]
    if not re.search(r"\.(md|markdown)\Z", path, re.I):
        return by_id(_unquoted(path), r)
    at = os.path.normpath(os.path.join(r.base, _unquoted(path)))
    rel = os.path.relpath(at, r.docs_root).replace(os.sep, "/")
    if rel in r.paths:
        return "in-corpus", rel, None
    if rel in r.outside:
        return "out-of-scope", rel, r.outside[rel]
    if not rel.startswith("..") or not os.path.exists(at):
        return none
    return "out-of-scope", rel, "outside docs.root"


def by_id(id_: str, r: Resolver) -> tuple[str, str | None, str | None]:
    none = ("not-a-document", None, None)
    tail = id_.rsplit("/", 1)[-1]
    if not tail:
        return none

    def named(path: str) -> bool:
        bare = re.sub(r"\.(md|markdown)\Z", "", path, flags=re.I)
        return bare in (id_, tail) or posixpath.basename(bare) == tail

    told = r.ids.get(id_) or r.ids.get(tail)
    if told in r.paths:
        return "in-corpus", told, None
    hits = [p for p in r.paths if named(p)]
    if hits:
        return ("in-corpus", hits[0], None) if len(hits) == 1 else none
    if told in r.outside:
        return "out-of-scope", told, r.outside[told]
    hits = [p for p in r.outside if named(p)]
    return ("out-of-scope", hits[0], r.outside[hits[0]]) if len(hits) == 1 else none


def targets_of(doc: dict, first: int, last: int, r: Resolver, exact: re.Pattern, bodies: str) -> tuple[list[tuple], list[tuple]]:
    """((file, section, line, text) of designated documents, (file, reason, line, text) of those that this run doesn't see)."""
    seen, unseen = {}, {}
    for x in doc["links"]:
        if x["is_image"] or not first <= x["line"] <= last or exact.match(x["text"].strip()):
            continue
        status, file, reason = designation(x["target"], r)
        where = (x["line"], x["text"].strip())
        if status == "out-of-scope":
            unseen.setdefault(file, (file, reason, *where))
        elif status == "in-corpus" and file != bodies:
            m = _AFTER.match(doc["lines"][x["line"] - 1]["raw"][x["col"] - 1 + len(x["raw"]) :])
            for section in [m.group(1), *re.findall(rf"§\s*({M.DOTTED})", m.group(2))] if m else [None]:
                seen.setdefault((file, section or ""), (file, section, *where))
    return list(seen.values()), list(unseen.values())


# == citations and cards


def citations(docs: DataFrame, id_pattern: str) -> DataFrame:
    """id, path, line, quote and in_code of every line that has an id, once for each line."""
    found = F.array_distinct(F.regexp_extract_all("raw", F.lit(id_pattern), 0))
    t = T.stripped(F.col("raw"))
    quote = F.when(F.length(t) > 200, F.concat(F.substring(t, 1, 200), F.lit("…"))).otherwise(t)
    return M.lines(docs).select("path", "line", F.explode(found).alias("id"), quote.alias("quote"), F.col("in_fence").alias("in_code")).where("id <> ''")


def reconciled(decisions: DataFrame, cards: DataFrame, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """id, outcome (card-unexpected, card-missing, card-mismatch or card-orphan), and both
    sides, for decisions (id, title, status, status_raw, ...) and cards (id, card_status,
    card_line) that do not agree. statuses: patterns of those that should have a card."""
    both = decisions.withColumn("there", F.lit(True)).join(cards.withColumn("carded", F.lit(True)), "id", "full_outer")
    wanted = F.lit(True)
    if statuses:
        wanted = F.col("status").isNull() | F.coalesce(F.col("status_raw"), F.col("status")).rlike("(?i)^(?:" + "|".join(f"(?:{s})" for s in statuses) + r")\z")
    there, carded = F.col("there").isNotNull(), F.col("carded").isNotNull()
    outcome = (
        F.when(~there, "card-orphan")
        .when(~wanted, F.when(carded, "card-unexpected"))
        .when(~carded, "card-missing")
        .when(~T.same_status(F.col("card_status"), F.col("status_raw")), "card-mismatch")
    )
    return both.withColumn("outcome", outcome).where("outcome IS NOT NULL").drop("there", "carded")


# == the axis


def _rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def run_axis(context: RunContext, corpus: Corpus, docs: DataFrame, record: tuple[str, str] | None = None) -> AxisResult:
    """The record of decisions is one document, read by the driver; the corpus is searched
    by Spark. record: its path under docs.root and its text, where it is at hand."""
    spark: SparkSession = docs.sparkSession
    s = parse_settings(context.config)
    if record:
        bodies, at = record[0], os.path.join(context.docs_root, record[0])
        body = M.parse_markdown(record[1])
    else:
        at = declared_path(s.bodies, context, "adr.bodies")
        bodies = shown_path(at, context)
        with open(at, encoding="utf-8", errors="replace", newline="") as f:
            body = M.parse_markdown(f.read())
    others = docs.where(F.col("path") != bodies)
    known = {x.path for x in others.select("path").collect()}
    outside = {x.path: x.reason for x in corpus.excluded.where(F.lower("path").rlike(r"\.(md|markdown)\z")).collect() if x.path not in known and x.path != bodies}
    r = Resolver(os.path.dirname(at), context.docs_root, frozenset(known), load_decision_manifest(context), outside)
    exact = re.compile(rf"(?:{s.id_pattern})\Z")
    listed = decisions_of(body, s)
    decisions = _rows(spark, listed, DECISION)
    designated, unseen = [], []
    for d in listed:
        seq, first, last, own = d[0], d[5], d[6], d[11]
        if d[8] != "accepted":
            continue
        seen, missed = targets_of(body, own or first, d[12] if own else last, r, exact, bodies)
        scope = "decision" if own else "body"
        unseen += [(seq, scope, k, *x) for k, x in enumerate(missed)]
        # a decision that designates nothing is judged by all its links
        named = bool(seen)
        if not named:
            seen, scope = targets_of(body, first, last, r, exact, bodies)[0], "body"
        designated += [(seq, named, scope, k, *x) for k, x in enumerate(seen)]
    targets = _rows(spark, designated, "seq int, named boolean, scope string, k int, file string, section string, link_line int, link_text string")
    missed = _rows(spark, unseen, "seq int, scope string, k int, file string, reason string, link_line int, link_text string")
    cited = citations(others, s.id_pattern).join(F.broadcast(decisions.select("id").distinct()), "id", "left_semi").persist()  # a row for each decision
    quote = {n: x["raw"].strip() for n, x in enumerate(body["lines"], 1)}
    lines = _rows(spark, [(d[0], quote[d[7] or d[3]]) for d in listed], "seq int, status_quote string")
    base = decisions.join(lines, "seq")
    key = lambda n: [F.lit(n), F.lpad(F.col("seq").cast("string"), 6, "0")]
    file = F.lit(bodies)
    found = []

    chain = chains(decisions)
    old = base.where("status = 'superseded'").join(chain, "id", "left").withColumn("chain", F.coalesce("chain", F.array("id")))
    where = F.array(F.struct(file.alias("file"), F.coalesce("status_line", "heading_line").alias("line"), F.col("status_quote").alias("quote")))
    payload = F.to_json(F.struct(F.col("id").alias("decision_id"), F.col("title").alias("decision_summary"), F.lit("stale_supersede").alias("kind"), "chain", "superseded_by"))
    dangling = old.where("superseded_by IS NULL OR terminal = 'missing'")
    said = F.when(F.col("superseded_by").isNull(), F.format_string("%s is superseded, but by no decision that is named", "id")).otherwise(F.format_string("%s is superseded by %s, which leads to no decision", "id", "superseded_by"))
    found.append(findings_frame(dangling, AXIS, "decisions.supersede-dangling", "block", said, where, payload, key("1")))
    found.append(findings_frame(old.where("terminal = 'cycle'"), AXIS, "decisions.supersede-cycle", "block", F.format_string("a cycle of superseded decisions: %s", F.array_join("chain", " > ")), where, payload, key("1")))

    place = F.array(F.struct(file.alias("file"), F.col("link_line").alias("line"), F.col("link_text").alias("quote")))
    out = missed.join(base, "seq")
    payload = F.to_json(F.struct(F.col("id").alias("decision_id"), F.col("title").alias("decision_summary"), F.lit("target_out_of_scope").alias("kind"), F.struct("file", F.lit(None).cast("string").alias("section"), F.col("link_text").alias("current_text")).alias("target"), F.col("scope").alias("designated_by"), F.col("reason").alias("scope_reason")))
    found.append(findings_frame(out, AXIS, "decisions.target-out-of-scope", "warn", F.format_string("%s designates %s, which this run does not check (%s)", "id", "file", "reason"), place, payload, [*key("2"), F.lpad(F.col("k").cast("string"), 6, "0")]))

    own = targets.join(base.select("seq", "id", "title", "heading_line", "status_raw", "d_text", F.coalesce("d_first", "first").alias("from"), F.coalesce("d_last", "last").alias("to")), "seq")
    sections = M.headings(others).where("section IS NOT NULL").groupBy("path", "section").agg(F.min_by(F.struct("line", "end"), "line").alias("h"))
    own = own.join(sections.select(F.col("path").alias("file"), "section", F.col("h.line").alias("heading_at"), F.col("h.end").alias("heading_end")), ["file", "section"], "left")
    own = own.join(others.select(F.col("path").alias("file"), F.size("lines").alias("n_lines")), "file", "left")
    live = cited.where("NOT in_code")
    own = own.join(live.select("id", F.col("path").alias("file"), F.lit(True).alias("cites")).distinct(), ["id", "file"], "left").withColumn("cites", F.coalesce("cites", F.lit(False))).persist()
    per = own.where("named").groupBy("seq", "id", "title", "heading_line", "scope", "file").agg(F.max("cites").alias("cites"), F.min("k").alias("k"), F.min_by("link_text", "k").alias("link_text"), F.min_by("heading_at", F.when(F.col("heading_at").isNotNull(), F.col("k"))).alias("heading_at"), F.transform(F.array_sort(F.collect_list(F.when(F.col("section").isNotNull(), F.struct("k", "section")))), lambda x: x["section"]).alias("sections"))
    per = per.withColumn("broken", F.min(~F.col("cites")).over(Window.partitionBy("seq"))).where("NOT cites")
    elsewhere = live.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), "line"))).alias("elsewhere"))
    per = per.join(elsewhere, "id", "left").withColumn("elsewhere", F.coalesce("elsewhere", F.array().cast("array<struct<file:string,line:int>>")))
    severity = F.when((F.col("scope") == "decision") & F.col("broken"), "block").otherwise("warn")
    places = F.array(F.struct("file", F.col("heading_at").alias("line"), F.col("link_text").alias("quote")), F.struct(file.alias("file"), F.col("heading_line").alias("line"), F.col("title").alias("quote")))
    target = F.struct("file", F.get("sections", F.lit(0)).alias("section"), F.col("link_text").alias("current_text"))
    payload = F.to_json(F.struct(F.col("id").alias("decision_id"), F.col("title").alias("decision_summary"), F.lit("citation_missing").alias("kind"), target.alias("target"), "sections", F.col("scope").alias("designated_by"), F.col("elsewhere").alias("cited_elsewhere")))
    per = per.join(others.select(F.col("path").alias("file"), "frozen"), "file")
    missing = findings_frame(per.where("NOT frozen"), AXIS, "decisions.citation-missing", severity, F.format_string("%s designates %s, which does not cite it (cited in %d other places)", "id", "file", F.size("elsewhere")), places, payload, [*key("3"), F.lpad(F.col("k").cast("string"), 6, "0")])
    found.append(missing)
    kept_quiet = per.where("frozen").select(F.col("file").alias("path"), F.lit("frozen: decisions.citation-missing is not reported").alias("reason"))

    stale = old.join(live.select("id", F.col("path").alias("file"), F.col("line").alias("at"), F.col("quote").alias("text")), "id")
    body_ = F.struct(F.lit("stale_supersede").alias("kind"), F.col("id").alias("decision_id"), F.col("title").alias("decision_summary"), F.col("status_raw").alias("decision_status"), "superseded_by", "chain", F.struct(file.alias("file"), F.col("heading_line").alias("line")).alias("decision_heading"), F.struct("file", F.lit(None).cast("string").alias("section"), F.col("text").alias("current_text"), F.col("at").alias("line")).alias("target"))
    candidates = [stale.select(F.lit("stale_supersede").alias("kind"), F.to_json(body_).alias("candidate"))]
    owns = _rows(spark, [(e["owner"], e["what"]) for e in context.config.get("ownership") or []], "file string, what string").groupBy("file").agg(F.sort_array(F.collect_list("what")).alias("ownership_declared"))
    span = F.when(F.col("section").isNull(), F.array(F.lit(1), F.col("n_lines"))).when(F.col("heading_at").isNotNull(), F.array("heading_at", "heading_end"))
    each = F.struct("k", "file", "section", F.col("heading_at").alias("heading_line"), span.alias("line_range"), F.col("cites").alias("cites_decision"), F.coalesce("ownership_declared", F.array()).alias("ownership_declared"))
    reflect = own.join(owns, "file", "left").groupBy("seq", "id", "title", "status_raw", "heading_line", "from", "to", "d_text", "scope").agg(F.array_sort(F.collect_list(each)).alias("targets"))
    body_ = F.struct(F.lit("reflection").alias("kind"), F.col("id").alias("decision_id"), F.col("title").alias("decision_summary"), F.col("status_raw").alias("decision_status"), F.struct(file.alias("file"), F.col("heading_line").alias("line")).alias("decision_heading"), F.array("from", "to").alias("decision_range"), F.col("d_text").alias("decision_text"), F.col("scope").alias("designated_by"), F.transform("targets", lambda t: t.dropFields("k")).alias("targets"))
    candidates.append(reflect.select(F.lit("reflection").alias("kind"), F.to_json(body_).alias("candidate")))

    if s.cards:
        cards_at = declared_path(s.cards, context, "adr.cards")
        cards = _rows(spark, load_cards(cards_at, s.id_pattern), "id string, card_status string, card_line int")
        bad = reconciled(base, cards, s.card_statuses).persist()
        card = F.lit(shown_path(cards_at, context))
        at_ = lambda q: F.struct(card.alias("file"), F.col("card_line").alias("line"), q.alias("quote"))
        in_body = F.struct(file.alias("file"), F.coalesce("status_line", "heading_line").alias("line"), F.coalesce("status_raw", F.lit("")).alias("quote"))
        told = F.lit(list(s.card_statuses)) if s.card_statuses else F.lit(None).cast("array<string>")
        for outcome, text in (("card-unexpected", "%s has a card, though none is expected of its status"), ("card-missing", "%s has no card"), ("card-mismatch", "%s has one status in its body and another on its card"), ("card-orphan", "card %s has no decision")):
            rows = bad.where(F.col("outcome") == outcome)
            places = F.array(at_(F.coalesce("card_status", "id") if outcome == "card-mismatch" else F.col("id")), *([in_body] if outcome == "card-mismatch" else []))
            payload = F.to_json(F.struct(F.col("id").alias("decision_id"), F.col("title").alias("decision_summary"), F.lit(outcome.replace("-", "_")).alias("kind"), F.col("status_raw").alias("body_status"), "card_status", *([told.alias("card_statuses")] if outcome == "card-unexpected" else [])))
            found.append(findings_frame(rows, AXIS, f"decisions.{outcome}", "block", F.format_string(text, "id"), places, payload, [F.lit("5" if outcome == "card-orphan" else "4"), F.lpad(F.coalesce("seq", F.lit(0)).cast("string"), 6, "0"), F.col("id")]))
    excluded = corpus.excluded.unionByName(kept_quiet)
    stats = {"decisions_parsed": len(listed), "accepted": sum(d[8] == "accepted" for d in listed)}
    return AxisResult(AXIS, union(found), union(candidates), excluded, corpus.scanned, stats)


