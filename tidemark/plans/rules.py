"""Names, titles, places and prose under rules given as parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text as T
from tidemark.operators import quality as Q
from tidemark.plans.registry import query
from tidemark.sources.tables import table


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_RUNGS = " ".join(f"WHEN regexp_matches(lower(coalesce(job_title, '')), '{p}') THEN '{n}'" for n, p in T.SENIORITY)


@query("seniority_titles", f"SELECT job_title, CASE {_RUNGS} ELSE 'mid' END AS seniority, regexp_matches(lower(coalesce(job_title, '')), '{T.INTERNSHIP}') AS internship, count(*) AS n FROM raw_postings GROUP BY 1, 2, 3")
def seniority_titles(spark: SparkSession, d: str) -> DataFrame:
    """Level of each title by the first rung that holds, and whether it is an internship in the narrow sense."""
    t = F.col("job_title")
    return table(spark, d, "raw_postings").groupBy("job_title", T.first_rung(t, T.SENIORITY, "mid").alias("seniority"), F.lower(F.coalesce(t, F.lit(""))).rlike(T.INTERNSHIP).alias("internship")).agg(F.count("*").alias("n"))


def _any(c: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}', 'i')" for p in patterns) + ")"


@query("text_verdicts", f"SELECT source, {_any('description_raw', T.REFUSES)} AS refuses, {_any('description_raw', T.OFFERS)} AS offers, count(*) AS n FROM raw_postings GROUP BY 1, 2, 3")
def text_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What texts say, by lists of patterns; a text that is not there says nothing (null)."""
    t = F.col("description_raw")
    return table(spark, d, "raw_postings").groupBy("source", T.any_of(t, T.REFUSES).alias("refuses"), T.any_of(t, T.OFFERS).alias("offers")).agg(F.count("*").alias("n"))


@query(
    "title_flags",
    f"""SELECT source, count(*) FILTER (regexp_matches(job_title, '{T.TECH_ROLE}')) AS technical, count(*) FILTER (regexp_matches(lower(job_title), '{T.RELEVANT}')) AS relevant,
 count(*) FILTER (regexp_matches(coalesce(search_term, '') || category, '{T.CERTIFIED}')) AS certified FROM raw_postings GROUP BY 1""",
)
def title_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("job_title")
    return table(spark, d, "raw_postings").groupBy("source").agg(
        F.count_if(t.rlike(T.TECH_ROLE)).alias("technical"), F.count_if(F.lower(t).rlike(T.RELEVANT)).alias("relevant"), F.count_if(F.concat(F.coalesce("search_term", F.lit("")), "category").rlike(T.CERTIFIED)).alias("certified")
    )


def surface_forms(t: DataFrame) -> DataFrame:
    """(tech_slug, form): what a technology is written as. The display name, unless it is shorter than three letters and
    so an ordinary word (match_name), the slug with blanks, and the name with 'js' or ' db' endings taken apart."""
    name = F.lower("tech_name")
    forms = F.array(F.when(F.length(name) > 2, name), F.regexp_replace("tech_slug", "[_-]", " "), F.regexp_replace(name, "(ops|lake|grid)$", " $1"))
    return t.select("tech_slug", F.explode(F.array_distinct(F.array_compact(forms))).alias("form"))


_FORMS = """f AS (SELECT DISTINCT tech_slug, form FROM (SELECT tech_slug, CASE WHEN length(tech_name) > 2 THEN lower(tech_name) END AS form FROM technologies UNION ALL SELECT tech_slug, regexp_replace(tech_slug, '[_-]', ' ', 'g') FROM technologies
 UNION ALL SELECT tech_slug, regexp_replace(lower(tech_name), '(ops|lake|grid)$', ' \\1') FROM technologies) WHERE form IS NOT NULL)"""


@query(
    "tech_match",
    f"""WITH {_FORMS}, p AS (SELECT DISTINCT source, job_id, lower(description_raw) AS d FROM raw_postings WHERE description_raw IS NOT NULL)
SELECT DISTINCT source, job_id, tech_slug FROM p JOIN f ON contains(d, form) WHERE regexp_matches(d, '(^|[^\\p{{L}}\\p{{N}}_/])' || form || '($|[^\\p{{L}}\\p{{N}}_/])')""",
)
def tech_match(spark: SparkSession, d: str) -> DataFrame:
    """Surface forms of a vocabulary in texts, as whole words: one alternation finds what there is, longest first at each
    place; forms within a longer one that was found are looked for in it."""
    forms = surface_forms(table(spark, d, "technologies")).distinct()
    words = sorted((r.form for r in forms.select("form").distinct().collect()), key=lambda n: (-len(n), n))  # the vocabulary: a few forms an entry
    quoted = "|".join(w.replace(".", r"\.").replace("+", r"\+") for w in words)
    pattern = rf"(?<![\p{{L}}\p{{N}}_/])(?:{quoted})(?![\p{{L}}\p{{N}}_/])"
    p = table(spark, d, "raw_postings").select("source", "job_id", F.lower("description_raw").alias("t")).filter("t is not null")
    hits = p.select("source", "job_id", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)))).alias("form")).distinct()
    return hits.join(F.broadcast(forms), "form").select("source", "job_id", "tech_slug").distinct()  # the vocabulary


@query("alias_slugs", f"WITH {_FORMS} SELECT p.tech_slug AS typed, f.tech_slug AS slug, count(*) AS n FROM posting_technologies p LEFT JOIN f ON f.form = lower(trim(p.tech_slug)) GROUP BY 1, 2")
def alias_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Names typed freely to the slug of the vocabulary."""
    f = surface_forms(table(spark, d, "technologies")).distinct().select(F.col("tech_slug").alias("slug"), "form")
    typed = table(spark, d, "posting_technologies").groupBy(F.col("tech_slug").alias("typed")).agg(F.count("*").alias("n"))
    return typed.join(f, F.lower(F.trim("typed")) == F.col("form"), "left").select("typed", "slug", "n")


_US = ", ".join(f"('{k}', '{v}')" for k, v in T.US_STATES.items())
_CA = ", ".join(f"('{k}', '{v}')" for k, v in T.CA_PROVINCES.items())
_WORDS = ", ".join(f"('{k}', '{v}')" for k, v in T.PROVINCE_WORDS.items())


@query(
    "parsed_locations",
    f"""
WITH us(code, name) AS (VALUES {_US}), ca(code, name) AS (VALUES {_CA}), w(word, name) AS (VALUES {_WORDS}), v AS (SELECT DISTINCT location, trim(location) AS t FROM raw_postings),
n AS (SELECT v.location, arg_min(us.name, (-length(us.name), us.name)) AS state FROM v JOIN us ON regexp_matches(lower(t), '\\b' || lower(us.name) || '\\b') GROUP BY 1),
p AS (SELECT v.location, arg_min(w.name, (-length(word), word)) AS state FROM v JOIN w ON regexp_matches(lower(t), '\\b' || word || '\\b') GROUP BY 1),
k AS (SELECT location, unnest(regexp_extract_all(t, '\\b([A-Z]{{2}})\\b', 1)) AS code, generate_subscripts(regexp_extract_all(t, '\\b([A-Z]{{2}})\\b', 1), 1) AS i FROM v),
c AS (SELECT location, arg_min(coalesce('us' || us.name, 'ca' || ca.name), i) AS found FROM k LEFT JOIN us ON us.code = k.code LEFT JOIN ca ON ca.code = k.code WHERE us.code IS NOT NULL OR ca.code IS NOT NULL GROUP BY 1),
x AS (SELECT v.location, t, lower(regexp_extract(t, '{T.PREFIX}', 1)) AS iso, upper(regexp_extract(t, '{T.PREFIX}', 2)) AS isc, n.state AS ns, p.state AS ps, found FROM v LEFT JOIN n ON n.location = v.location LEFT JOIN p ON p.location = v.location LEFT JOIN c ON c.location = v.location)
SELECT location, CASE WHEN regexp_matches(t, '{T.DISTRICT}') THEN 'us' WHEN iso <> '' THEN iso WHEN ns IS NOT NULL THEN 'us' WHEN ps IS NOT NULL THEN 'ca' WHEN found IS NOT NULL THEN left(found, 2) WHEN regexp_matches(lower(t), '\\bcanada\\b') THEN 'ca' WHEN regexp_matches(lower(t), '{T.COUNTRY}') THEN 'us' END AS country,
 CASE WHEN regexp_matches(t, '{T.DISTRICT}') THEN 'District of Columbia' WHEN iso = 'us' THEN us.name WHEN iso = 'ca' THEN ca.name ELSE coalesce(ns, ps, substring(found, 3)) END AS state FROM x LEFT JOIN us ON us.code = isc LEFT JOIN ca ON ca.code = isc""",
)
def parsed_locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").select("location").distinct().select("location", T.place(F.col("location")).alias("p")).select("location", "p.country", "p.state")


_CODES = "|".join([*T.US_STATES, "DC", *T.CA_PROVINCES])
_NAMES = "|".join([*(n.lower() for n in T.US_STATES.values()), "district of columbia", "washington dc", *T.PROVINCE_WORDS])


@query("in_scope_locations", f"SELECT location, coalesce(regexp_matches(trim(location), '(?i)^(US|CA)[-/]') OR regexp_matches(lower(location), '{T.COUNTRY}|canada') OR regexp_matches(location, ',\\s*({_CODES})\\b') OR regexp_matches(lower(location), '{_NAMES}'), false) AS kept, count(*) AS n FROM raw_postings GROUP BY 1, 2")
def in_scope_locations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").groupBy("location", T.in_scope(F.col("location")).alias("kept")).agg(F.count("*").alias("n"))


@query("departments", "SELECT p_partkey, regexp_replace(regexp_replace(trim(' ' || p_partkey || '  ' || p_type || '   team '), '^\\s*\\d+\\s+', ''), '\\s+', ' ', 'g') AS department FROM part")
def departments(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("  "), "p_type", F.lit("   team "))
    return table(spark, d, "part").select("p_partkey", T.department(raw).alias("department"))


_CANON = f"regexp_replace(regexp_replace(lower(coalesce(company_name, '')), '{T.BOARD_LEGAL}', '', 'g'), '[^a-z0-9]', '', 'g')"
DENIED = ["Orrin Hires", "Vandor Jobs Inc.", "Talvi Corporation"]


@query("board_names", f"SELECT DISTINCT company_name, {_CANON} AS canon, {_CANON} IN ('orrinhires', 'vandorjobs', 'talvi') OR coalesce(regexp_matches(company_name, '{T.AGENCY}'), false) AS denied FROM raw_postings")
def board_names(spark: SparkSession, d: str) -> DataFrame:
    """Comparable form of a name, and whether a list (compared in that form) or a word of agencies turns it down."""
    names = table(spark, d, "raw_postings").select("company_name").distinct().withColumn("canon", T.board_canon(F.col("company_name")))
    denied = spark.createDataFrame([(x,) for x in DENIED], "name string").select(T.board_canon(F.col("name")).alias("canon")).distinct().withColumn("listed", F.lit(True))
    listed = names.join(F.broadcast(denied), "canon", "left")  # a list given as a parameter
    return listed.select("company_name", "canon", (F.coalesce("listed", F.lit(False)) | F.coalesce(F.col("company_name").rlike(T.AGENCY), F.lit(False))).alias("denied"))


_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


@query(
    "slug_forms",
    f"""WITH n AS (SELECT DISTINCT company_name AS x FROM raw_postings WHERE company_name IS NOT NULL), b AS (SELECT x, lower(trim(x)) AS base, trim(regexp_replace(lower(trim(x)), '{T.SLUG_WORDS}', '', 'g')) AS bare FROM n),
v AS (SELECT x, regexp_replace(base, '[^a-z0-9]', '', 'g') AS a, regexp_replace(regexp_replace(base, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS b, regexp_replace(bare, '[^a-z0-9]', '', 'g') AS c, regexp_replace(regexp_replace(bare, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS d FROM b)
SELECT x AS company_name, {_SLUG} AS slug, array_to_string(list_filter([CASE WHEN a <> '' THEN a END, CASE WHEN b <> '' AND b <> a THEN b END, CASE WHEN c <> '' AND c <> a AND c <> b THEN c END, CASE WHEN d <> '' AND d <> a AND d <> b AND d <> c THEN d END], lambda y: y IS NOT NULL), '|') AS variants FROM v""",
)
def slug_forms(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "raw_postings").select("company_name").filter("company_name is not null").distinct()
    return n.select("company_name", C.slug(F.col("company_name")).alias("slug"), F.array_join(T.slug_variants(F.col("company_name")), "|").alias("variants"))


@query("slug_collisions", f"SELECT slug, count(*) AS names, count(*) = 1 AS ok FROM (SELECT DISTINCT x, {_SLUG} AS slug FROM (SELECT trim(company_name) AS x FROM raw_postings WHERE company_name IS NOT NULL)) GROUP BY 1")
def slug_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Slugs that several names would share; a site built on them is refused (quality.refuse_collisions)."""
    return Q.collisions(table(spark, d, "raw_postings").select(F.trim("company_name").alias("x")).filter("x is not null"), "x", C.slug(F.col("x")))


@query("long_dates", "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS said, CAST(strptime(strftime(o_orderdate, '%B %-d, %Y'), '%B %-d, %Y') AS DATE) AS day FROM orders UNION ALL SELECT 0, 'soon', NULL")
def long_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMMM d, yyyy").alias("said"))
    o = o.unionByName(spark.createDataFrame([(0, "soon")], "o_orderkey long, said string"))
    return o.withColumn("day", T.long_date(F.col("said")))


@query("composite_keys", "SELECT DISTINCT k, split_part(k, ':', 1) AS source, CASE WHEN contains(k, ':') THEN substring(k, strpos(k, ':') + 1) END AS job_id FROM (SELECT source || ':' || job_id || ':x' AS k FROM raw_postings UNION ALL SELECT source FROM raw_postings)")
def composite_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys put together and taken apart at the first colon."""
    p = table(spark, d, "raw_postings")
    k = p.select(F.concat_ws(":", "source", "job_id", F.lit("x")).alias("k")).unionByName(p.select(F.col("source").alias("k"))).distinct()
    return k.select("k", T.split_key(F.col("k")).alias("s")).select("k", "s.source", "s.job_id")


@query(
    "name_candidates",
    r"""WITH t AS (SELECT DISTINCT source, job_id, description_raw AS x FROM raw_postings WHERE description_raw IS NOT NULL),
l AS (SELECT source, job_id, x, list_filter(list_transform(regexp_extract_all(x, '(?im)^[ \t]*(?:company|employer|organisation|organization|at)[ \t]*[:-][ \t]*([^\n]+)$', 1), lambda y: regexp_replace(y, '^[ .,-]+|[ .,-]+$', '', 'g')), lambda y: y <> '') AS a,
 list_filter(list_transform(regexp_extract_all(x, '\b(?:[Aa]t|[Jj]oin|[Ww]ith)[ \t]+([A-Z][A-Za-z0-9&.,''-]*(?:[ \t]+[A-Z][A-Za-z0-9&.,''-]*){0,3})', 1), lambda y: regexp_replace(y, '^[ .,-]+|[ .,-]+$', '', 'g')), lambda y: y <> '') AS b FROM t),
f AS (SELECT source, job_id, x, unnest(list_concat(a, list_filter(b, lambda y: NOT list_contains(['we', 'our', 'the', 'this', 'you', 'your', 'us', 'job', 'role', 'apply', 'posted', 'location', 'remote', 'hybrid', 'full', 'part'], lower(split_part(y, ' ', 1)))))) AS name,
 generate_subscripts(list_concat(a, list_filter(b, lambda y: NOT list_contains(['we', 'our', 'the', 'this', 'you', 'your', 'us', 'job', 'role', 'apply', 'posted', 'location', 'remote', 'hybrid', 'full', 'part'], lower(split_part(y, ' ', 1))))), 1) AS i FROM l),
o AS (SELECT source, job_id, x, arg_min(name, i) AS name, min(i) AS i FROM f GROUP BY source, job_id, x, lower(name)), r AS (SELECT *, row_number() OVER (PARTITION BY source, job_id, x ORDER BY i) AS k FROM o)
SELECT DISTINCT source, job_id, name FROM r WHERE k <= 12""",
)
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("source", "job_id", "description_raw").filter("description_raw is not null")
    return p.select("source", "job_id", F.explode(T.name_candidates(F.col("description_raw"))).alias("name")).distinct()


_TEXT = r"regexp_replace(description_raw, 'https?://\S+', ' ', 'g')"


@query(
    "numeric_claims",
    rf"""WITH p AS (SELECT DISTINCT source, job_id, salary_min, salary_max, list_distinct(list_transform(regexp_extract_all({_TEXT}, '(\$?\d[\d,]*(?:\.\d+)?%?x?)', 1), lambda t: regexp_replace(regexp_replace(t, '[$,]', '', 'g'), '[%x.]+$', ''))) AS c FROM raw_postings WHERE description_raw IS NOT NULL),
a AS (SELECT *, list_concat(['1', '2', '3', '4'], list_concat(CASE WHEN salary_min IS NULL THEN [] ELSE [regexp_replace(CAST(salary_min AS VARCHAR), '\.0$', ''), CAST(CAST(round_even(salary_min, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(salary_min * 100, 0) AS BIGINT) AS VARCHAR), format('{{:.1f}}', salary_min)] END,
 CASE WHEN salary_max IS NULL THEN [] ELSE [regexp_replace(CAST(salary_max AS VARCHAR), '\.0$', ''), CAST(CAST(round_even(salary_max, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(salary_max * 100, 0) AS BIGINT) AS VARCHAR), format('{{:.1f}}', salary_max)] END)) AS ok FROM p)
SELECT DISTINCT source, job_id, len(c) AS claims, len(list_filter(c, lambda x: NOT list_contains(ok, x))) AS unsupported FROM a""",
)
def numeric_claims(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that a text states, and those that neither its salaries (as they are, rounded, to one decimal, as a
    percentage) nor the small numbers of ordinary prose account for."""
    salaries = F.array_compact(F.array("salary_min", "salary_max"))
    p = table(spark, d, "raw_postings").filter("description_raw is not null").select("source", "job_id", T.stated_numbers(F.col("description_raw")).alias("c"), T.allowed_numbers(salaries).alias("ok"))
    ok = F.concat(F.array(*[F.lit(str(n)) for n in range(1, 5)]), "ok")
    return p.select("source", "job_id", F.size("c").cast("long").alias("claims"), F.size(F.array_except("c", ok)).cast("long").alias("unsupported")).distinct()


PHRASES = ["guaranteed", "no experience", "act now", "unlimited"]


@query(
    "text_rules",
    f"""WITH t AS (SELECT doc_id, text, lower(text) AS low, company_name FROM documents)
SELECT doc_id, concat_ws('; ', {", ".join(f"CASE WHEN contains(low, '{p}') THEN 'phrase {p}' END" for p in PHRASES)}, CASE WHEN length(text) > 1500 THEN 'long' END, CASE WHEN len(regexp_extract_all(text, '\\S+')) > 200 THEN 'wordy' END,
 CASE WHEN company_name IS NOT NULL AND NOT contains(low, lower(company_name)) THEN 'unnamed' END) AS failures FROM t WHERE text IS NOT NULL""",
)
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that a text breaks: forbidden phrases, limits of length, a name that must appear."""
    t = table(spark, d, "documents").filter("text is not null")
    low = F.lower("text")
    rules = [F.when(low.contains(p), f"phrase {p}") for p in PHRASES]
    rules += [F.when(F.length("text") > 1500, "long"), F.when(F.regexp_count("text", F.lit(r"\S+")) > 200, "wordy"), F.when(F.col("company_name").isNotNull() & ~low.contains(F.lower("company_name")), "unnamed")]
    return t.select("doc_id", F.concat_ws("; ", *rules).alias("failures"))


# Phrase groups in order, more specific ones first, each with the categories it stands for.
FIELDS = [
    (["machine learning", "data scien", " ai "], ["ml"]), (["data engineer", "pipeline", "etl"], ["ingestion", "transform", "warehouse"]), (["analyst", "analytics", "reporting"], ["bi", "warehouse"]),
    (["devops", "platform engineer", "cloud", "infra"], ["cloud", "infra"]), (["software", "developer", "backend", "full stack"], ["database", "infra", "language"]),
]


@query("field_categories", "SELECT job_title, CASE " + " ".join("WHEN " + " OR ".join(f"contains(' ' || lower(trim(coalesce(job_title, ''))) || ' ', '{p}')" for p in ps) + f" THEN '{','.join(cs)}'" for ps, cs in FIELDS) + " ELSE '' END AS categories, count(*) AS n FROM raw_postings GROUP BY 1, 2")
def field_categories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").groupBy("job_title").agg(F.count("*").alias("n")).select("job_title", F.array_join(T.phrase_groups(F.col("job_title"), FIELDS), ",").alias("categories"), "n")


@query(
    "own_products",
    """WITH x AS (SELECT DISTINCT tech_slug AS company FROM technologies UNION SELECT DISTINCT tech_name || ' Inc' FROM technologies UNION SELECT ''), n AS (SELECT company, regexp_replace(lower(company), '[^a-z0-9]', '', 'g') AS c FROM x),
t AS (SELECT tech_slug, regexp_replace(lower(tech_slug), '[^a-z0-9]', '', 'g') AS a, regexp_replace(lower(tech_name), '[^a-z0-9]', '', 'g') AS b FROM technologies WHERE is_tracked)
SELECT company, tech_slug, c <> '' AND (contains(a, c) OR contains(c, a) OR contains(b, c) OR contains(c, b)) AS own FROM n JOIN t ON left(t.tech_slug, 2) = left(lower(n.company), 2)""",
)
def own_products(spark: SparkSession, d: str) -> DataFrame:
    """Whether a technology is a company's own product, for names that begin alike."""
    t = table(spark, d, "technologies")
    x = t.select(F.col("tech_slug").alias("company")).unionByName(t.select(F.concat("tech_name", F.lit(" Inc")).alias("company"))).unionByName(spark.createDataFrame([("",)], "company string")).distinct()
    j = x.withColumn("k", F.left(F.lower("company"), F.lit(2))).join(t.filter("is_tracked").select("tech_slug", "tech_name", F.left("tech_slug", F.lit(2)).alias("k")), "k")
    return j.select("company", "tech_slug", T.own_product(F.col("company"), F.col("tech_slug"), F.col("tech_name")).alias("own"))


@query("location_parts", "SELECT location, nullif(trim(split_part(location, ',', 1)), '') AS city, count(*) AS n FROM raw_postings GROUP BY 1, 2")
def location_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_postings").groupBy("location", C.blank_to_null(F.split_part("location", F.lit(","), F.lit(1))).alias("city")).agg(F.count("*").alias("n"))


@query("user_like", "SELECT source, count(*) AS n FROM raw_postings WHERE (contains(lower(redirect_url), '?ref=7') OR contains(lower(category), '& f')) AND source NOT LIKE 'seeded%' AND NOT contains(coalesce(job_title, ''), '100%_') GROUP BY 1")
def user_like(spark: SparkSession, d: str) -> DataFrame:
    """Words of a user in LIKE patterns: %, _ and the escape itself mean themselves."""
    like = lambda c, s: F.expr(f"{c} ilike '%{T.escape_like(s)}%' escape '/'".replace("\\", "/"))
    p = table(spark, d, "raw_postings").filter(like("redirect_url", "?ref=7") | F.coalesce(like("category", "& f"), F.lit(False)))
    return p.filter(~F.col("source").like("seeded%")).filter(~like("coalesce(job_title, '')", "100%_")).groupBy("source").agg(F.count("*").alias("n"))
