"""Column functions over names, titles, places and prose. Rules come as parameters; the defaults are stated below."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of each seniority level in a title, tried in this order; else 'mid'.
SENIORITY = [
    ("intern", r"^(.*[^a-z])?(intern|interns|internship|interning|co.?op|new.grad|new.graduate|university.grad|campus|student|students|placement|trainee|apprentice)([^a-z].*)?$"),
    ("intern", r"((winter|summer|fall|spring)[^a-z0-9]*20[0-9][0-9]|20[0-9][0-9][^a-z0-9]*(winter|summer|fall|spring)|[(][0-9]{1,2}[ -]*months?[)])"),
    ("senior", r"^(.*[^a-z])?(senior|sr|staff|principal|lead|distinguished|manager|director|head|vp|chief|architect|expert)([^a-z].*)?$"),
    ("entry", r"^(.*[^a-z])?(new grad|graduate|entry.level|junior|jr|associate|apprentice)([^a-z].*)?$"),
]
# Fixed value: titles of internships in the narrow sense.
INTERNSHIP = r"^(.*[^a-z])?(intern|interns|internship|co-?op)([^a-z].*)?$"
# Titles of technical roles, and decisions that count as certified.
TECH_ROLE = r"(?i)(data engineer|data scientist|software|machine learning|analytics|database|devops|site reliability|cloud|platform engineer|analyst)"
CERTIFIED = r"(?i)^certified"
# Titles worth reading.
RELEVANT = r"data|analytic|analyst|engineer|developer|software|machine learning|data scien|platform|infrastructur|backend|back-end|full.?stack|python|\bsql\b|cloud|devops|\bsre\b|quantitative|research engineer"
# Sentences by which a text turns visa sponsorship down, and by which it offers it.
REFUSES = [
    r"(will not|does not|do not|cannot|can not|are not able to|unable to|not be able to|not offer|not provide)[^.]{0,80}sponsor",
    r"sponsorship[^.]{0,60}(is not|not available|will not be|cannot be|is unavailable)",
    r"does not now or in the future require sponsorship",
    r"do not apply[^.]{0,80}sponsor",
    r"without the need for[^.]{0,40}sponsor",
]
OFFERS = [
    r"(we|company) (do|does|will|can|are able to|are willing to|are happy to)[^.]{0,20}sponsor",
    r"sponsorship (is|will be) available",
    r"will consider sponsor",
]
# States and provinces by code.
US_STATES = dict(
    x.split(" ", 1) for x in (
        "AL Alabama,AK Alaska,AZ Arizona,AR Arkansas,CA California,CO Colorado,CT Connecticut,DE Delaware,FL Florida,GA Georgia,HI Hawaii,ID Idaho,IL Illinois,IN Indiana,IA Iowa,KS Kansas,KY Kentucky,LA Louisiana,"
        "ME Maine,MD Maryland,MA Massachusetts,MI Michigan,MN Minnesota,MS Mississippi,MO Missouri,MT Montana,NE Nebraska,NV Nevada,NH New Hampshire,NJ New Jersey,NM New Mexico,NY New York,NC North Carolina,ND North Dakota,"
        "OH Ohio,OK Oklahoma,OR Oregon,PA Pennsylvania,RI Rhode Island,SC South Carolina,SD South Dakota,TN Tennessee,TX Texas,UT Utah,VT Vermont,VA Virginia,WA Washington,WV West Virginia,WI Wisconsin,WY Wyoming"
    ).split(",")
)
CA_PROVINCES = dict(
    x.split(" ", 1) for x in "ON Ontario,QC Quebec,BC British Columbia,AB Alberta,MB Manitoba,SK Saskatchewan,NS Nova Scotia,NB New Brunswick,NL Newfoundland and Labrador,PE Prince Edward Island".split(",")
)
# Words that may name a province instead of its full name.
PROVINCE_WORDS = {n.lower(): n for n in CA_PROVINCES.values() if n != "Newfoundland and Labrador"} | {"québec": "Quebec", "newfoundland": "Newfoundland and Labrador"}
# The capital district, a leading country and state, and words for the countries.
DISTRICT = r"(?i)\b(washington,?\s*d\.?\s?c\.?|district of columbia)\b"
PREFIX = r"(?i)^(US|CA)[-/]\s*([A-Z]{2})\b"
COUNTRY = r"(united states|\bu\.?s\.?a?\b)"
# Legal forms that names of boards leave out, and words of names that belong to agencies.
BOARD_LEGAL = r"\b(inc|llc|ltd|corp|corporation|company|co|plc|gmbh|sa|nv)\b\.?"
AGENCY = r"(?i)staffing|recruit|talent|consult|solutions|technologies inc|systems inc|resourc|placement|search group|agency"
# Fixed value: words that slug candidates may do without.
SLUG_WORDS = r"\b(inc|llc|ltd|corp|corporation|company|technologies|labs|the)\b"


def first_rung(c: Column, rungs: Sequence[tuple[str, str]], default: str) -> Column:
    """Name of the first pattern that the lower-case text matches; null text is ''."""
    t = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(t.rlike(rungs[0][1]), rungs[0][0])
    for name, pattern in rungs[1:]:
        out = out.when(t.rlike(pattern), name)
    return out.otherwise(default)


def any_of(c: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern matches, whatever the case; null stays null."""
    return c.rlike("(?i)(?:" + ")|(?:".join(patterns) + ")")


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _longest(c: Column, words: Sequence[str]) -> Column:
    """The longest of the words that occur whole in the text, ties by order; null if none does."""
    found = F.regexp_extract_all(c, F.lit(r"\b(" + "|".join(sorted(words, key=len, reverse=True)) + r")\b"), F.lit(1))
    return F.try_element_at(F.transform(F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), F.lit(1))


def place(c: Column) -> Column:
    """(country, state) of a location: the capital district, a leading country and state code, a full state name (the
    longest), a full province name, a two-letter code in capitals (the first known one), a country word."""
    text, low = F.trim(c), F.lower(F.trim(c))
    struct = lambda country, state: F.struct((F.lit(country) if country else F.lit(None).cast("string")).alias("country"), state.cast("string").alias("state"))
    us, ca = _longest(low, [n.lower() for n in US_STATES.values()]), _longest(low, list(PROVINCE_WORDS))
    country, code = F.lower(F.regexp_extract(text, PREFIX, 1)), F.upper(F.regexp_extract(text, PREFIX, 2))
    known = _lookup({k: f"us{v}" for k, v in US_STATES.items()} | {k: f"ca{v}" for k, v in CA_PROVINCES.items() if k not in US_STATES})
    token = F.try_element_at(F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2})\b"), F.lit(1)), lambda t: F.try_element_at(known, t)), lambda x: x.isNotNull()), F.lit(1))
    none = F.lit(None)
    return (
        F.when(text.isNull() | (text == ""), struct(None, none))
        .when(text.rlike(DISTRICT), struct("us", F.lit("District of Columbia")))
        .when(country == "us", struct("us", F.try_element_at(_lookup(US_STATES), code)))
        .when(country == "ca", struct("ca", F.try_element_at(_lookup(CA_PROVINCES), code)))
        .when(us.isNotNull(), struct("us", F.try_element_at(_lookup({n.lower(): n for n in US_STATES.values()}), us)))
        .when(ca.isNotNull(), struct("ca", F.try_element_at(_lookup(PROVINCE_WORDS), ca)))
        .when(token.isNotNull(), F.struct(F.substring(token, 1, 2).alias("country"), F.substring(token, F.lit(3), F.length(token)).alias("state")))
        .when(low.rlike(r"\bcanada\b"), struct("ca", none))
        .when(low.rlike(COUNTRY), struct("us", none))
        .otherwise(struct(None, none))
    )


def in_scope(c: Column) -> Column:
    """Whether a location names a place in the two countries; null and blank do not."""
    codes = "|".join([*US_STATES, "DC", *CA_PROVINCES])
    names = "|".join([*(n.lower() for n in US_STATES.values()), "district of columbia", "washington dc", *PROVINCE_WORDS])
    return F.coalesce(F.trim(c).rlike(r"(?i)^(US|CA)[-/]") | F.lower(c).rlike(COUNTRY + "|canada") | c.rlike(rf",\s*({codes})\b") | F.lower(c).rlike(names), F.lit(False))


def department(c: Column) -> Column:
    """A department without a leading number, blanks joined; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(c), r"^\s*\d+\s+", ""), r"\s+", " "), F.lit(""))


def board_canon(c: Column) -> Column:
    """Lower-case letters and digits of a name without legal forms; null is ''."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), BOARD_LEGAL, ""), "[^a-z0-9]", "")


def slug_variants(c: Column) -> Column:
    """Distinct candidates in order: letters and digits joined, by dashes, and both without filler words."""
    base = F.lower(F.trim(c))
    bare = F.trim(F.regexp_replace(base, SLUG_WORDS, ""))
    joined = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    dashed = lambda x: F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.array_distinct(F.filter(F.array(joined(base), dashed(base), joined(bare), dashed(bare)), lambda x: x != ""))


def long_date(c: Column) -> Column:
    """'March 5, 2026' as a date; anything else is null."""
    return F.try_to_date(F.trim(c), "MMMM d, yyyy")


def split_key(c: Column) -> Column:
    """(source, job_id) of 'source:job_id', cut at the first colon; without one the job_id is null."""
    at = F.instr(c, ":")
    return F.struct(F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("source"), F.when(at > 0, F.substring(c, at + 1, F.length(c))).alias("job_id"))


def name_candidates(c: Column, most: int = 12) -> Column:
    """Possible company names in a text, best first, each once whatever its case: lines that label one, then capitalised
    words after 'at', 'join' or 'with'."""
    stop = ["we", "our", "the", "this", "you", "your", "us", "job", "role", "apply", "posted", "location", "remote", "hybrid", "full", "part"]
    trimmed = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(x, r"^[ .,-]+|[ .,-]+$", "")), lambda x: x != "")
    labelled = trimmed(F.regexp_extract_all(c, F.lit(r"(?im)^[ \t]*(?:company|employer|organisation|organization|at)[ \t]*[:-][ \t]*([^\n]+)$"), F.lit(1)))
    after = trimmed(F.regexp_extract_all(c, F.lit(r"\b(?:[Aa]t|[Jj]oin|[Ww]ith)[ \t]+([A-Z][A-Za-z0-9&.,'-]*(?:[ \t]+[A-Z][A-Za-z0-9&.,'-]*){0,3})"), F.lit(1)))
    after = F.filter(after, lambda x: ~F.lower(F.split_part(x, F.lit(" "), F.lit(1))).isin(stop))
    both = F.concat(labelled, after)
    once = F.filter(both, lambda x, i: F.array_position(F.transform(both, F.lower), F.lower(x)) == i + 1)
    return F.slice(once, 1, most)


def stated_numbers(c: Column) -> Column:
    """Quantities of a text as bare numbers, links left out: '$85,000' and '85000' are the same, '17%' and '17' are too."""
    raw = F.regexp_extract_all(F.regexp_replace(c, r"https?://\S+", " "), F.lit(r"(\$?\d[\d,]*(?:\.\d+)?%?x?)"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda t: F.regexp_replace(F.regexp_replace(t, r"[$,]", ""), r"[%x.]+$", "")))


def allowed_numbers(values: Column) -> Column:
    """What may be written for an array of numbers: as they are, rounded, to one decimal, and as a percentage."""
    text = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    forms = lambda v: F.array(text(v), text(F.bround(v, 0).cast("long")), text(F.bround(v * 100, 0).cast("long")), F.format_string("%.1f", v))
    return F.array_distinct(F.flatten(F.transform(values, forms)))


def phrase_groups(c: Column, groups: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    """Categories of the first group of which the padded lower-case text has a phrase; none match: an empty array."""
    t = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "))
    out = F.when(F.trim(t) == "", F.array().cast("array<string>"))
    for phrases, categories in groups:
        has = F.lit(False)
        for p in phrases:
            has = has | t.contains(p)
        out = out.when(has, F.array(*map(F.lit, categories)))
    return out.otherwise(F.array().cast("array<string>"))


def own_product(company: Column, *names: Column) -> Column:
    """Whether the squashed company name and one of the names contain each other."""
    norm = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    c = norm(company)
    out = F.lit(False)
    for n in map(norm, names):
        out = out | (n.contains(c) | c.contains(n))
    return F.coalesce((c != "") & out, F.lit(False))


def escape_like(text: str) -> str:
    """User text for a LIKE pattern with '\\' as its escape."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
