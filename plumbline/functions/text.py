"""Text functions as Column expressions: cleaning, numbers, names, similarity."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC_CELL = r"^\s*(-?[0-9]+(?:,[0-9]{3})*(?:[.][0-9]+)?)\s*(?:" + "|".join("가지 항목 개 건 곳 명 종 회 줄 쪽 %".split()) + r")?\s*$"
SKIPPED_CELL = r"^(?:[\s.–—-]*|\s*(?:TBD|미정|(?:해당\s*)?없음|n/a|N/A)\s*)$"
DECIMAL = "decimal(38,10)"


def quoted(text: str) -> str:
    """text as a literal in a pattern, for Java and Python alike."""
    return re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", text)


def stripped(x: Column) -> Column:
    """Without white space of any kind around it."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")


def quote(x: Column, limit: int = 200, ellipsis: bool = True) -> Column:
    """A trimmed quotation of at most limit characters."""
    t = stripped(x)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…")) if ellipsis else F.substring(t, 1, limit)).otherwise(t)


def without_marks(x: Column) -> Column:
    return stripped(F.regexp_replace(x, "[*_`~]", ""))


def numeric_cell(x: Column) -> Column:
    """The number that is a whole cell, or null."""
    found = F.regexp_extract(without_marks(x), NUMERIC_CELL, 1)
    return F.when(found != "", F.regexp_replace(found, ",", "").try_cast(DECIMAL))


def skipped_cell(x: Column) -> Column:
    t = without_marks(x)
    return (t == "") | t.rlike(SKIPPED_CELL)


def total_label(x: Column, labels: list[str]) -> Column:
    """Whether a cell is the label of a total: a label, alone or before other than a letter or digit."""
    any_ = "|".join(quoted(s.lower()) for s in labels)
    return F.lower(without_marks(x)).rlike(f"^(?:{any_})(?![\\p{{L}}\\p{{N}}])") if labels else F.lit(False)


def plain_number(x: Column) -> Column:
    """A decimal as text without needless zeros."""
    s = x.cast("string")
    return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)


def clean_inline(x: Column) -> Column:
    """Displayed text: links as their text, no code or emphasis marks, single blanks."""
    t = F.regexp_replace(x, r"!?\[([^\]]*)][(][^)]*[)]", "$1")
    t = F.regexp_replace(F.regexp_replace(t, "`+", ""), r"\*\*|__|[*_]", "")
    # most texts have nothing to clean, which one look tells
    marked = x.rlike(r"(?U)[\[`*_]|[\s&&[^ ]]|  |^ | \z")
    return F.when(~marked, x).otherwise(stripped(F.regexp_replace(t, r"(?U)\s+", " ")))


def name_key(x: Column) -> Column:
    return F.lower(clean_inline(x))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(x)), r"(?U)[^\s\p{N}\p{L}_-]+", ""), r"(?U)\s+", "-")


def decoded(x: Column) -> Column:
    """Percent-decoded, or as it is where that fails; + is a letter."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def segments(x: Column) -> Column:
    """The parts of an identifier, in lower case."""
    hump = F.regexp_replace(F.regexp_replace(x, "^@", ""), r"(?<=[a-z\d])(?=[A-Z])", "_")
    return F.filter(F.split(F.lower(hump), r"[./\-_]+"), lambda s: s != "")


def one_apart(a: Column, b: Column) -> Column:
    """Whether two arrays differ by exactly one replacement, insertion or deletion."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    unequal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda same: ~same))
    dropped = F.exists(F.sequence(F.lit(0), F.greatest(F.size(long) - 1, F.lit(0))), lambda i: F.filter(long, lambda x, k: k != i) == short)
    return F.when(F.size(a) == F.size(b), unequal == 1).when(F.size(long) - F.size(short) == 1, dropped).otherwise(F.lit(False))


def identifier_similarity(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    """Why two identifiers look like one name, or null. sa, sb: their segments()."""
    single = (F.size(sa) == 1) & (F.size(sb) == 1)
    near = (F.least(F.length(a), F.length(b)) >= 5) & (F.levenshtein(F.lower(a), F.lower(b)) <= 1)
    return (
        F.when(a == b, None)
        .when(sa == sb, "same parts, written differently")
        .when(single, F.when(near, "one letter apart"))
        .when(F.get(sa, F.lit(0)) != F.get(sb, F.lit(0)), None)
        .when(one_apart(sa, sb), "one part apart")
    )


def name_score(a: Column, b: Column) -> Column:
    """Closeness of two names, 0 to 1 in thousandths; a name within the other counts at least a half."""
    long, short = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    within = F.contains(F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a))
    ratio = 1 - F.levenshtein(a, b) / long
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.round(F.greatest(ratio, F.when(within, 0.5 + 0.5 * short / long).otherwise(F.lit(0.0))), 3))


def same_status(a: Column, b: Column) -> Column:
    n = lambda x: F.lower(stripped(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))
    return n(a) == n(b)
