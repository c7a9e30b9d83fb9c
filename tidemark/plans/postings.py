"""Posting-grain models: cleaning, deduplication, dimensions, names, text features, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import relational as R
from tidemark.plans.registry import query
from tidemark.sources.tables import table

AS_OF = "2026-10-18"
_BLANK = "nullif(trim({0}), '')"


@query(
    "staged_postings",
    f"""
WITH s AS (SELECT source, job_id, trim(company_name) AS company_name, job_title, location, CAST(posted_date AS DATE) AS posted, ingested_at,
 date_diff('day', CAST(posted_date AS DATE), DATE '{AS_OF}') AS days_since_posted FROM raw_postings WHERE nullif(trim(company_name), '') IS NOT NULL)
SELECT source, job_id, company_name, job_title, location, posted, CAST(days_since_posted AS INT) AS days_since_posted, coalesce(days_since_posted > 60, false) AS is_stale FROM s
QUALIFY row_number() OVER (PARTITION BY lower(company_name), lower(job_title), lower(location) ORDER BY posted DESC NULLS LAST, job_id, source, ingested_at) = 1""",
)
def staged_postings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("source", "job_id", C.blank_to_null(F.col("company_name")).alias("company_name"), "job_title", "location", F.to_date("posted_date").alias("posted"), "ingested_at")
    p = p.filter("company_name is not null").withColumn("days_since_posted", F.datediff(F.lit(AS_OF), "posted"))
    one = R.first_per_key(p, [F.lower("company_name"), F.lower("job_title"), F.lower("location")], [F.col("posted").desc_nulls_last(), F.col("job_id"), F.col("source"), F.col("ingested_at")])
    return one.withColumn("is_stale", F.coalesce(F.col("days_since_posted") > 60, F.lit(False))).drop("ingested_at")


@query("dedup_latest", "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(o_orderpriority) ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    return R.first_per_key(o, [F.col("o_custkey"), F.lower("o_orderpriority")], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")])


@query("lateral_latest", "SELECT c_custkey, o.o_orderkey, o.o_orderdate FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) o ON true")
def lateral_latest(spark: SparkSession, d: str) -> DataFrame:
    o = R.first_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")])
    return table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


@query(
    "company_metrics",
    f"""
WITH p AS (SELECT trim(company_name) AS company, job_title, CAST(first_seen AS DATE) AS d, salary_min, salary_max FROM raw_postings WHERE nullif(trim(company_name), '') IS NOT NULL)
SELECT company, count(*) AS postings, count(DISTINCT job_title) AS distinct_titles, count(CASE WHEN salary_max IS NOT NULL THEN 1 END) AS paid, round(avg((salary_min + salary_max) / 2), 0) AS mean_salary,
 count(CASE WHEN d > DATE '{AS_OF}' - 30 AND d <= DATE '{AS_OF}' THEN 1 END) AS last_30, count(CASE WHEN d > DATE '{AS_OF}' - 60 AND d <= DATE '{AS_OF}' - 30 THEN 1 END) AS prior_30,
 round(count(DISTINCT job_title) / greatest(date_diff('day', min(d), max(d)) / 7.0::DOUBLE, 1.0::DOUBLE), 2) AS roles_per_week FROM p GROUP BY 1""",
)
def company_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select(C.blank_to_null(F.col("company_name")).alias("company"), "job_title", F.to_date("first_seen").alias("d"), "salary_min", "salary_max").filter("company is not null")
    day = lambda n: F.date_sub(F.lit(AS_OF).cast("date"), n)
    between = lambda lo, hi: F.count(F.when((F.col("d") > day(lo)) & (F.col("d") <= day(hi)), 1))
    weeks = F.greatest(F.datediff(F.max("d"), F.min("d")) / F.lit(7.0), F.lit(1.0))
    return p.groupBy("company").agg(
        F.count("*").alias("postings"), F.countDistinct("job_title").alias("distinct_titles"), F.count("salary_max").alias("paid"), F.round(F.avg((F.col("salary_min") + F.col("salary_max")) / 2), 0).alias("mean_salary"),
        between(30, 0).alias("last_30"), between(60, 30).alias("prior_30"), F.round(F.countDistinct("job_title") / weeks, 2).alias("roles_per_week"),
    )


@query(
    "company_pace",
    """
WITH c AS (SELECT o_custkey AS company, count(*) AS total, count(CASE WHEN CAST(o_orderdate AS DATE) > DATE '2001-08-01' - 365 THEN 1 END) AS last, count(CASE WHEN CAST(o_orderdate AS DATE) > DATE '2001-08-01' - 730 AND CAST(o_orderdate AS DATE) <= DATE '2001-08-01' - 365 THEN 1 END) AS prior FROM orders GROUP BY 1)
SELECT md5(CAST(company AS VARCHAR)) AS company_key, company, total, last, prior, CASE WHEN prior >= 3 THEN round(100.0 * (last - prior) / prior, 0) END AS pace_change_pct, total >= 8 AS enough FROM c""",
)
def company_pace(spark: SparkSession, d: str) -> DataFrame:
    at = F.to_date("o_orderdate")
    day = lambda n: F.date_sub(F.lit("2001-08-01").cast("date"), n)
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.count("*").alias("total"), F.count(F.when(at > day(365), 1)).alias("last"), F.count(F.when((at > day(730)) & (at <= day(365)), 1)).alias("prior"))
    change = F.when(F.col("prior") >= 3, F.round(100.0 * (F.col("last") - F.col("prior")) / F.col("prior"), 0))
    return c.select(C.surrogate_key(F.col("company")).alias("company_key"), "company", "total", "last", "prior", change.alias("pace_change_pct"), (F.col("total") >= 8).alias("enough"))


@query(
    "role_collapse",
    """
WITH p AS (SELECT source, job_id, trim(company_name) AS company, trim(regexp_replace(lower(job_title), ',\\s*[a-z .''-]+,\\s*[a-z]{2}\\s*$', '')) AS role, location, first_seen, ingested_at FROM raw_postings WHERE nullif(trim(company_name), '') IS NOT NULL),
k AS (SELECT *, count(*) OVER w AS locations_posted, row_number() OVER (w ORDER BY first_seen NULLS LAST, job_id, source, ingested_at) AS rn FROM p WINDOW w AS (PARTITION BY company, role))
SELECT source, job_id, company, role, locations_posted FROM k WHERE rn = 1""",
)
def role_collapse(spark: SparkSession, d: str) -> DataFrame:
    """One row per company and normalised title, with the number of postings it stands for."""
    p = table(spark, d, "raw_postings").select("source", "job_id", C.blank_to_null(F.col("company_name")).alias("company"), C.title_without_place(F.col("job_title")).alias("role"), "first_seen", "ingested_at").filter("company is not null")
    first = R.first_per_key(p, ["company", "role"], [F.col("first_seen").asc_nulls_last(), F.col("job_id"), F.col("source"), F.col("ingested_at")])
    n = p.groupBy("company", "role").agg(F.count("*").alias("locations_posted"))
    n = n.select(F.col("company").alias("c2"), F.col("role").alias("r2"), "locations_posted")
    return first.join(n, (F.col("company") == F.col("c2")) & F.col("role").eqNullSafe(F.col("r2"))).select("source", "job_id", "company", "role", "locations_posted")


@query(
    "date_spine",
    """SELECT CAST(x AS DATE) AS day, CAST(year(x) AS INT) AS y, CAST(quarter(x) AS INT) AS q, CAST(month(x) AS INT) AS m, strftime(x, '%Y-%m') AS month_key, strftime(x, '%b %Y') AS month_label, CAST(dayofweek(x) AS INT) AS dow, dayofweek(x) IN (0, 6) AS is_weekend
FROM range(TIMESTAMP '2018-01-01', TIMESTAMP '2030-01-01', INTERVAL 1 DAY) r(x)""",
)
def date_spine(spark: SparkSession, d: str) -> DataFrame:
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2018-01-01").cast("date"), F.lit("2029-12-31").cast("date"))).alias("day"))
    dow = F.dayofweek("day") - 1
    return days.select("day", F.year("day").alias("y"), F.quarter("day").alias("q"), F.month("day").alias("m"), F.date_format("day", "yyyy-MM").alias("month_key"), F.date_format("day", "MMM yyyy").alias("month_label"), dow.alias("dow"), dow.isin(0, 6).alias("is_weekend"))


@query("dim_technology", "SELECT md5(t.tech_slug) AS tech_key, t.tech_slug, t.tech_name, t.category, t.is_tracked, coalesce(n, 0) AS postings, coalesce(n, 0) > 0 AS is_used FROM technologies t LEFT JOIN (SELECT lower(trim(tech_slug)) AS s, count(DISTINCT (source, job_id)) AS n FROM posting_technologies GROUP BY 1) u ON u.s = t.tech_slug")
def dim_technology(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "posting_technologies").select(F.lower(F.trim("tech_slug")).alias("tech_slug"), "source", "job_id").distinct().groupBy("tech_slug").agg(F.count("*").alias("n"))
    t = table(spark, d, "technologies").join(n, "tech_slug", "left")
    n = F.coalesce("n", F.lit(0))
    return t.select(C.surrogate_key(F.col("tech_slug")).alias("tech_key"), "tech_slug", "tech_name", "category", "is_tracked", n.alias("postings"), (n > 0).alias("is_used"))


_NORM = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[.,]', ' ', 'g'), '\\b(?:INC|INCORPORATED|LLC|LTD|LIMITED|CORP|CORPORATION|CO|COMPANY|PLC|LP|LLP|PLLC|PC|NA|USA|US)\\b', ' ', 'g'), '[^A-Z0-9&]+', ' ', 'g')), '')"


@query("employer_normalise", f"SELECT DISTINCT company_name, {_NORM.format('company_name')} AS employer, replace({_NORM.format('company_name')}, ' ', '') AS squashed FROM raw_postings WHERE company_name IS NOT NULL")
def employer_normalise(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("company_name").filter("company_name is not null").distinct().withColumn("employer", C.normalise_employer(F.col("company_name")))
    return p.withColumn("squashed", C.squashed(F.col("employer")))


@query(
    "identity_canonical",
    f"WITH c AS (SELECT {_NORM.format('company_name')} AS company_key, company_name AS canonical_name, count(*) AS uses FROM raw_postings GROUP BY 1, 2) SELECT company_key, canonical_name, uses FROM c WHERE company_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY uses DESC, length(canonical_name), canonical_name) = 1",
)
def identity_canonical(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("company_name", C.normalise_employer(F.col("company_name")).alias("company_key"))
    return R.most_frequent_spelling(p, group="company_key", spelling="company_name").select("company_key", F.col("company_name").alias("canonical_name"), "uses")


@query(
    "prefix_entity_match",
    f"""
WITH k AS (SELECT DISTINCT {_NORM.format('company_name')} AS company FROM raw_postings), e AS (SELECT DISTINCT employer_key AS employer FROM dol_employer_summary WHERE employer_key IS NOT NULL),
x AS (SELECT company, employer FROM k JOIN e ON company = employer), p AS (SELECT company, employer FROM k JOIN e ON length(company) >= 8 AND starts_with(employer, company || ' ') WHERE company NOT IN (SELECT company FROM x)),
a AS (SELECT company, employer, 'exact' AS kind FROM x UNION ALL SELECT company, employer, 'prefix' FROM p)
SELECT company, CASE WHEN count(*) = 1 THEN min(employer) END AS employer, CASE WHEN min(kind) = 'exact' THEN 'exact' WHEN count(*) > 1 THEN 'prefix_ambiguous' WHEN position(' ' IN company) > 0 THEN 'prefix_strong' ELSE 'prefix_weak' END AS match_type FROM a GROUP BY company
UNION ALL SELECT company, NULL, NULL FROM k WHERE company IS NOT NULL AND company NOT IN (SELECT company FROM a)""",
)
def prefix_entity_match(spark: SparkSession, d: str) -> DataFrame:
    """Exact before prefix; one prefix match is strong if the key has several words, weak if one; several are ambiguous."""
    k = table(spark, d, "raw_postings").select(C.normalise_employer(F.col("company_name")).alias("company")).filter("company is not null").distinct()
    e = table(spark, d, "dol_employer_summary").select(F.col("employer_key").alias("employer")).filter("employer is not null").distinct()
    m = R.prefix_matches(k, e, key="company", name="employer").groupBy("company").agg(F.max("exact").alias("exact"), F.count("*").alias("n"), F.min(F.when(F.col("exact"), F.col("employer"))).alias("x"), F.min("employer").alias("one"))
    kind = F.when(F.col("exact"), "exact").when(F.col("n") > 1, "prefix_ambiguous").when((F.col("n") == 1) & F.col("company").contains(" "), "prefix_strong").when(F.col("n") == 1, "prefix_weak")
    employer = F.when(F.col("exact"), F.col("x")).when(F.col("n") == 1, F.col("one"))
    return k.join(m, "company", "left").select("company", employer.alias("employer"), kind.alias("match_type"))


_CLEAN = "regexp_replace(description_raw, '<[^<>]*>', ' ', 'g')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _CLEAN = f"replace({_CLEAN}, '{_e}', '{_c}')"


@query("html_clean", f"SELECT source, job_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS loaded, md5(trim(regexp_replace({_CLEAN}, '[ \\t]+', ' ', 'g'))) AS text_md5 FROM raw_postings WHERE description_raw IS NOT NULL")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").filter("description_raw is not null")
    return p.select("source", "job_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"), F.md5(C.html_to_text(F.col("description_raw"))).alias("text_md5"))


@query("url_parts", "SELECT source, job_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS loaded, lower(regexp_extract(redirect_url, '^https?://([^/?#]+)', 1)) AS host, regexp_extract(redirect_url, '^([^?#]*)', 1) AS bare, regexp_extract(redirect_url, '^(.*/)[^/]*$', 1) AS prefix FROM raw_postings WHERE redirect_url IS NOT NULL")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("redirect_url")
    return table(spark, d, "raw_postings").filter(u.isNotNull()).select("source", "job_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"), C.url_host(u).alias("host"), C.bare_url(u).alias("bare"), F.regexp_extract(u, r"^(.*/)[^/]*$", 1).alias("prefix"))


@query(
    "search_payload",
    """WITH c AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS c FROM (SELECT DISTINCT category FROM raw_postings WHERE category IS NOT NULL)), x AS (SELECT prefix, row_number() OVER (ORDER BY prefix) - 1 AS u FROM (SELECT DISTINCT regexp_extract(redirect_url, '^(.*/)[^/]*$', 1) AS prefix FROM raw_postings WHERE redirect_url IS NOT NULL))
SELECT source, job_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS loaded, CAST(c AS INT) AS c, CAST(u AS INT) AS u, regexp_extract(redirect_url, '([^/]*)$', 1) AS rest FROM raw_postings r LEFT JOIN c ON c.category = r.category LEFT JOIN x ON x.prefix = regexp_extract(redirect_url, '^(.*/)[^/]*$', 1)""",
)
def search_payload(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary-encoded rows: indexes into sorted dictionaries of categories and URL prefixes."""
    p = table(spark, d, "raw_postings").withColumn("prefix", F.regexp_extract("redirect_url", r"^(.*/)[^/]*$", 1))

    def dictionary(c: str, name: str) -> DataFrame:
        values = p.select(c).filter(F.col(c).isNotNull()).distinct()
        return R.global_row_number(values, [F.col(c)], name).withColumn(name, (F.col(name) - 1).cast("int"))

    j = p.join(dictionary("category", "c"), "category", "left").join(dictionary("prefix", "u"), "prefix", "left")
    return j.select("source", "job_id", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"), "c", "u", F.regexp_extract("redirect_url", r"([^/]*)$", 1).alias("rest"))


_FILTER = "contains(lower(coalesce(job_title, '')), 'engineer') AND (salary_max IS NULL OR salary_max >= 80000) AND (location_state IN ('Texas', 'Ohio') OR location ILIKE '%remote%')"


def search(p: DataFrame, *, words: list[str] = (), states: list[str] = (), remote: bool = False, paid_only: bool = False, least_salary: float | None = None, skills: DataFrame | None = None) -> DataFrame:
    """All of the words in the title, any of the states (remote being one more), salary unknown or high enough unless
    paid_only, any of the skills (source, job_id); an absent parameter filters nothing."""
    for w in words:
        p = p.filter(F.lower(F.coalesce("job_title", F.lit(""))).contains(w.lower()))
    if states or remote:
        place = F.col("location_state").isin(list(states)) if states else F.lit(False)
        p = p.filter(F.coalesce(place, F.lit(False)) | (F.coalesce(F.col("location").ilike("%remote%"), F.lit(False)) if remote else F.lit(False)))
    if least_salary is not None:
        p = p.filter(F.col("salary_max").isNull() | (F.col("salary_max") >= least_salary))
    if paid_only:
        p = p.filter(F.coalesce("salary_max", F.lit(0)) > 0)
    return p if skills is None else p.join(skills.select("source", "job_id").distinct(), ["source", "job_id"], "left_semi")


@query("search_filter", f"SELECT source, job_id, job_title, location FROM raw_postings WHERE {_FILTER} ORDER BY first_seen DESC, job_id, source, ingested_at LIMIT 50 OFFSET 50")
def search_filter(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 50 of a search; the page is the feature."""
    p = search(table(spark, d, "raw_postings"), words=["engineer"], states=["Texas", "Ohio"], remote=True, least_salary=80000)
    return p.orderBy(F.col("first_seen").desc(), "job_id", "source", "ingested_at").offset(50).limit(50).select("source", "job_id", "job_title", "location")


@query("search_facets", f"SELECT 'state' AS facet, coalesce(location_state, 'none') AS value, count(*) AS n FROM raw_postings WHERE {_FILTER} GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM raw_postings WHERE {_FILTER} GROUP BY 2")
def search_facets(spark: SparkSession, d: str) -> DataFrame:
    p = search(table(spark, d, "raw_postings"), words=["engineer"], states=["Texas", "Ohio"], remote=True, least_salary=80000)
    values = F.explode(F.array(F.struct(F.lit("state").alias("facet"), F.coalesce("location_state", F.lit("none")).alias("value")), F.struct(F.lit("source").alias("facet"), F.col("source").alias("value"))))
    return p.select(values.alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


@query("company_techs", "SELECT trim(company_name) AS company, string_agg(DISTINCT lower(trim(tech_slug)), ',' ORDER BY lower(trim(tech_slug))) AS techs FROM raw_postings r JOIN posting_technologies t ON r.source = t.source AND r.job_id = t.job_id WHERE trim(coalesce(tech_slug, '')) <> '' AND nullif(trim(company_name), '') IS NOT NULL GROUP BY 1")
def company_techs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("source", "job_id", C.blank_to_null(F.col("company_name")).alias("company")).filter("company is not null").distinct()
    t = table(spark, d, "posting_technologies").select("source", "job_id", C.blank_to_null(F.lower("tech_slug")).alias("tech")).filter("tech is not null").distinct()
    pairs = p.join(t, ["source", "job_id"]).select("company", "tech").distinct()  # at most the vocabulary per company
    return pairs.groupBy("company").agg(F.array_join(F.array_sort(F.collect_list("tech")), ",").alias("techs"))


@query(
    "wage_annualise",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS wage, CASE l_linenumber WHEN 1 THEN 'Year' WHEN 2 THEN 'Hour' WHEN 3 THEN 'Week' WHEN 4 THEN 'Bi-Weekly' WHEN 5 THEN 'Month' ELSE 'Other' END AS unit FROM lineitem)
SELECT unit, count(*) AS n, round(sum(round_even(wage * CASE unit WHEN 'Year' THEN 1 WHEN 'Hour' THEN 2080 WHEN 'Week' THEN 52 WHEN 'Bi-Weekly' THEN 26 WHEN 'Month' THEN 12 END, 2)), 2) AS annual FROM x GROUP BY 1""",
)
def wage_annualise(spark: SparkSession, d: str) -> DataFrame:
    unit = C.ladder([(F.col("l_linenumber") == i, u) for i, u in enumerate(["Year", "Hour", "Week", "Bi-Weekly", "Month"], 1)], "Other")
    x = table(spark, d, "lineitem").select(F.col("l_quantity").alias("wage"), unit.alias("unit"))
    return x.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.sum(C.annualise(F.col("wage"), F.col("unit"))), 2).alias("annual"))


@query("json_props", "SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(try_cast(json_extract_string(props, '$.missing') AS BIGINT)) AS missing FROM events GROUP BY 1")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k string, missing string").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("p.k").try_cast("bigint")).alias("k"), F.count(F.col("p.missing").try_cast("bigint")).alias("missing"))
