"""Column functions: cleaning, coercion, keys, dates, names, markup. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that normalised employer names leave out (after points have become blanks).
LEGAL_WORDS = ["INC", "INCORPORATED", "LLC", "LTD", "LIMITED", "CORP", "CORPORATION", "CO", "COMPANY", "PLC", "LP", "LLP", "PLLC", "PC", "NA", "USA", "US"]
# Periods a year of each wage unit.
PERIODS = {"Year": 1, "Month": 12, "Bi-Weekly": 26, "Week": 52, "Hour": 2080}


def blank_to_null(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def pct(x: Column, total: Column, digits: int) -> Column:
    """100 x / total, rounded; null for a total of 0 or null."""
    return F.round(F.lit(100.0) * x / F.nullif(total, F.lit(0)), digits)


def surrogate_key(*cols: Column) -> Column:
    """md5 of the columns as text joined by '-'; a null is written '_null_'."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit("_null_")) for c in cols]))


def content_hash(c: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of a text after line ends and outer blanks are made uniform; null stays null."""
    return F.substring(F.sha2(F.trim(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))), 256), 1, length)


def normalise_employer(c: Column) -> Column:
    """Upper case, points and commas as blanks, legal forms out, anything but A-Z 0-9 & as one blank; blank is null."""
    s = F.regexp_replace(F.upper(c), r"[.,]", " ")
    s = F.regexp_replace(s, r"\b(?:" + "|".join(LEGAL_WORDS) + r")\b", " ")
    return F.nullif(F.trim(F.regexp_replace(s, r"[^A-Z0-9&]+", " ")), F.lit(""))


def squashed(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by single dashes; 'unknown' where none are left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def html_to_text(c: Column) -> Column:
    """Tags as blanks, the common entities resolved, runs of blanks (not line ends) as one."""
    s = F.regexp_replace(c, r"<[^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(s, r"[ \t]+", " "))


def title_without_place(c: Column) -> Column:
    """Lower-case title without a trailing ', city, ST'."""
    return F.trim(F.regexp_replace(F.lower(c), r",\s*[a-z .'-]+,\s*[a-z]{2}\s*$", ""))


def annualise(wage: Column, unit: Column) -> Column:
    """Wage times the unit's periods, to cents, half to even; null for an unknown unit, a null or non-positive wage."""
    per = F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv])
    return F.when(wage > 0, F.bround(wage * F.try_element_at(per, F.coalesce(unit, F.lit(""))), 2))


def relative_date(c: Column, as_of: Column) -> Column:
    """'posted today', 'yesterday', 'N days ago', 'N+ days ago' against as_of; null for anything else."""
    n = F.regexp_extract(F.lower(c), r"(\d+)\+?\s+days?\s+ago", 1)
    return F.when(F.lower(c).rlike(r"\btoday\b"), as_of).when(F.lower(c).rlike(r"\byesterday\b"), F.date_sub(as_of, 1)).when(n != "", F.date_sub(as_of, n.try_cast("int")))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^https?://([^/?#]+)", 1))


def bare_url(c: Column) -> Column:
    """URL up to its query or fragment."""
    return F.regexp_extract(c, r"^([^?#]*)", 1)


def upper_median(values: Column) -> Column:
    """Element n // 2 (from 0) of the sorted array: the upper of the two middle values; null if empty."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)


def ladder(pairs: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first condition that holds."""
    c = F.when(pairs[0][0], pairs[0][1])
    for cond, value in pairs[1:]:
        c = c.when(cond, value)
    return c.otherwise(default)
