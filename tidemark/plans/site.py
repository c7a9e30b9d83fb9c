"""Serving queries: rankings, peers, details of a technology or company, searches, orders of work, expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text as X
from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators.peers import nearest_peers
from tidemark.plans.postings import search
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_ONE = "(SELECT * FROM raw_postings QUALIFY row_number() OVER (PARTITION BY source, job_id ORDER BY ingested_at DESC, job_title DESC) = 1)"
_TECH = "(SELECT DISTINCT source, job_id, lower(trim(tech_slug)) AS tech FROM posting_technologies WHERE trim(coalesce(tech_slug, '')) <> '')"


def one_per_key(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The last load of each posting."""
    p = table(spark, d, "raw_postings").select(*dict.fromkeys(["source", "job_id", *cols, "ingested_at", "job_title"]))
    return R.first_per_key(p, ["source", "job_id"], [F.col("ingested_at").desc(), F.col("job_title").desc()])


def techs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "posting_technologies").select("source", "job_id", C.blank_to_null(F.lower("tech_slug")).alias("tech")).filter("tech is not null").distinct()


# --- joins and sets


@query("left_join_on", "SELECT DISTINCT p.company_name, k.employer_key FROM raw_postings p LEFT JOIN company_employer_key k ON k.company_name = p.company_name AND k.match_type = 'exact'")
def left_join_on(spark: SparkSession, d: str) -> DataFrame:
    """A condition on the right side belongs to the join: rows that fail it keep their left side."""
    k = table(spark, d, "company_employer_key").filter("match_type = 'exact'").select("company_name", "employer_key")
    return table(spark, d, "raw_postings").select("company_name").distinct().join(k, "company_name", "left").distinct()


@query(
    "not_in_nulls",
    """SELECT 'no nulls' AS case_, count(*) AS n FROM dol_employer_summary WHERE employer_key NOT IN (SELECT employer_key FROM company_employer_key WHERE employer_key IS NOT NULL)
UNION ALL SELECT 'nulls', count(*) FROM dol_employer_summary WHERE employer_key NOT IN (SELECT employer_key FROM company_employer_key) UNION ALL SELECT 'empty', count(*) FROM dol_employer_summary WHERE employer_key NOT IN (SELECT employer_key FROM company_employer_key WHERE false)""",
)
def not_in_nulls(spark: SparkSession, d: str) -> DataFrame:
    e, k = table(spark, d, "dol_employer_summary").select("employer_key"), table(spark, d, "company_employer_key").select("employer_key")
    cases = {"no nulls": k.filter("employer_key is not null"), "nulls": k, "empty": k.filter("false")}
    return reduce(DataFrame.unionByName, [R.not_in(e, "employer_key", o, "employer_key").agg(F.count("*").alias("n")).select(F.lit(c).alias("case_"), "n") for c, o in cases.items()])


_KEY = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[.,]', ' ', 'g'), '\\b(?:" + "|".join(C.LEGAL_WORDS) + ")\\b', ' ', 'g'), '[^A-Z0-9&]+', ' ', 'g')), '')"


@query(
    "squashed_lookup",
    f"""WITH k AS (SELECT key, min(name) AS name FROM (SELECT {_KEY.format('company_name')} AS key, company_name AS name FROM raw_postings) WHERE key IS NOT NULL GROUP BY 1), s AS (SELECT replace(key, ' ', '') AS flat, min(name) AS name FROM k GROUP BY 1),
q AS (SELECT DISTINCT CASE WHEN job_id < '5' THEN lower(replace(company_name, ' ', '')) ELSE company_name END AS typed FROM raw_postings WHERE company_name IS NOT NULL)
SELECT typed, coalesce(k.name, s.name) AS company FROM q LEFT JOIN k ON k.key = {_KEY.format('typed')} LEFT JOIN s ON s.flat = replace({_KEY.format('typed')}, ' ', '')""",
)
def squashed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Names as typed, or as one word of a link: by key first, then by the key without blanks."""
    p = table(spark, d, "raw_postings").select("company_name", "job_id")
    key = lambda c: C.normalise_employer(F.col(c))
    k = p.select(key("company_name").alias("key"), F.col("company_name").alias("name")).filter("key is not null").groupBy("key").agg(F.min("name").alias("name"))
    s = k.groupBy(C.squashed(F.col("key")).alias("flat")).agg(F.min("name").alias("flat_name"))
    q = p.filter("company_name is not null").select(F.when(F.col("job_id") < "5", F.lower(C.squashed(F.col("company_name")))).otherwise(F.col("company_name")).alias("typed")).distinct()
    q = q.withColumn("key", key("typed")).withColumn("flat", C.squashed(F.col("key")))
    return q.join(k, "key", "left").join(s, "flat", "left").select("typed", F.coalesce("name", "flat_name").alias("company"))


@query(
    "url_lookup",
    "WITH u AS (SELECT split_part(split_part(redirect_url, '?', 1), '#', 1) AS bare, min(company_name) AS company FROM raw_postings WHERE company_name IS NOT NULL AND redirect_url IS NOT NULL GROUP BY 1), q AS (SELECT DISTINCT redirect_url || '?utm=x#top' AS pasted FROM raw_postings WHERE redirect_url IS NOT NULL) SELECT pasted, company FROM q LEFT JOIN u ON bare = rtrim(split_part(split_part(pasted, '?', 1), '#', 1), '/')",
)
def url_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The employer of the posting that a pasted link points at, whatever its query and fragment."""
    p = table(spark, d, "raw_postings").filter("redirect_url is not null")
    u = p.filter("company_name is not null").groupBy(C.bare_url(F.col("redirect_url")).alias("bare")).agg(F.min("company_name").alias("company"))
    q = p.select(F.concat("redirect_url", F.lit("?utm=x#top")).alias("pasted")).distinct().withColumn("bare", F.regexp_replace(C.bare_url(F.col("pasted")), "/+$", ""))
    return q.join(u, "bare", "left").select("pasted", "company")


@query("set_ops", "SELECT 'only_filed' AS side, k FROM (SELECT employer_key AS k FROM dol_employer_summary EXCEPT SELECT employer_key FROM company_employer_key) UNION ALL SELECT 'only_mapped', k FROM (SELECT employer_key AS k FROM company_employer_key EXCEPT SELECT employer_key FROM dol_employer_summary) UNION ALL SELECT 'both', k FROM (SELECT employer_key AS k FROM dol_employer_summary INTERSECT SELECT employer_key FROM company_employer_key)")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Differences and intersection of two sets of keys, null being a value."""
    a, b = table(spark, d, "dol_employer_summary").select(F.col("employer_key").alias("k")), table(spark, d, "company_employer_key").select(F.col("employer_key").alias("k"))
    named = lambda side, x: x.select(F.lit(side).alias("side"), "k")
    return named("only_filed", a.subtract(b)).unionByName(named("only_mapped", b.subtract(a))).unionByName(named("both", a.intersect(b)))


@query("tech_overlap", f"SELECT a.source, a.job_id, count(*) AS shared FROM {_TECH} a JOIN (SELECT tech_slug FROM technologies WHERE is_tracked) t ON t.tech_slug = a.tech GROUP BY 1, 2")
def tech_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Number of a posting's technologies that a wanted list has."""
    wanted = [r.tech_slug for r in table(spark, d, "technologies").filter("is_tracked").collect()]  # the vocabulary
    lists = techs(spark, d).groupBy("source", "job_id").agg(F.collect_set("tech").alias("t"))  # at most the vocabulary
    return lists.select("source", "job_id", F.size(F.array_intersect("t", F.array(*map(F.lit, wanted)))).cast("long").alias("shared")).filter("shared > 0")


# --- aggregates


@query("first_known", "SELECT company_name, arg_min(location, (first_seen, job_id, source, location)) FILTER (location IS NOT NULL AND first_seen IS NOT NULL) AS first_location, any_value(country) IS NOT NULL AS has_country FROM raw_postings GROUP BY 1")
def first_known(spark: SparkSession, d: str) -> DataFrame:
    """First non-null value in an order that is total, so that the answer does not depend on the plan."""
    known = F.col("location").isNotNull() & F.col("first_seen").isNotNull()
    return table(spark, d, "raw_postings").groupBy("company_name").agg(F.min_by(F.when(known, F.col("location")), F.when(known, F.struct("first_seen", "job_id", "source", "location"))).alias("first_location"), F.any_value("country", F.lit(True)).isNotNull().alias("has_country"))


@query(
    "upper_medians",
    f"""WITH c AS (SELECT company_name, category, count(*) FILTER (CAST(first_seen AS DATE) > DATE '2026-09-18') AS n FROM {_ONE} GROUP BY 1, 2), x AS (SELECT category, n FROM c)
SELECT category, list_sort(list(n) FILTER (n > 0))[CAST(floor(count(*) FILTER (n > 0) / 2) AS INT) + 1] AS without_zeros, list_sort(list(n))[CAST(floor(count(*) / 2) AS INT) + 1] AS with_zeros FROM x GROUP BY 1""",
)
def upper_medians(spark: SparkSession, d: str) -> DataFrame:
    """Element n // 2 of the sorted counts, with zeros left out and with them in; from a histogram of the counts."""
    recent = F.count_if(F.to_date("first_seen") > F.lit("2026-09-18").cast("date"))
    c = one_per_key(spark, d, "company_name", "category", "first_seen").groupBy("company_name", "category").agg(recent.alias("n"))
    h = c.groupBy("category", "n").agg(F.count("*").alias("k"))
    return R.upper_median(h.filter("n > 0"), ["category"], "n", "k", "without_zeros").join(R.upper_median(h, ["category"], "n", "k", "with_zeros").withColumnRenamed("category", "c2"), F.col("category").eqNullSafe(F.col("c2")), "right").select(F.col("c2").alias("category"), "without_zeros", "with_zeros")


@query(
    "eval_metrics",
    """WITH s AS (SELECT DISTINCT lower(state) AS n, state FROM ref_locations), p AS (SELECT source, location_state AS label, nullif(trim(split_part(location, ',', 2)), '') AS said, salary_max, category FROM raw_postings),
m AS (SELECT category, avg(salary_max) AS mean FROM raw_postings GROUP BY 1), e AS (SELECT source, label, s.state AS predicted, salary_max, mean FROM p LEFT JOIN s ON s.n = lower(said) LEFT JOIN m ON m.category = p.category)
SELECT source, count(*) FILTER (label IS NOT NULL AND predicted IS NOT NULL) AS n, round(100.0 * avg(CASE WHEN label = predicted THEN 1.0::DOUBLE WHEN label IS NOT NULL AND predicted IS NOT NULL THEN 0.0::DOUBLE END), 2) AS accuracy, round(avg(abs(salary_max - mean)), 0) AS mae FROM e GROUP BY 1""",
)
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Two predictions against their labels: the state that a location names against the state given (accuracy in percent
    of the rows that have both), and the mean salary of a category against each salary (mean absolute error)."""
    s = table(spark, d, "ref_locations").select(F.lower("state").alias("said"), F.col("state").alias("predicted")).distinct()
    p = table(spark, d, "raw_postings").select("source", F.col("location_state").alias("label"), F.lower(C.blank_to_null(F.split_part("location", F.lit(","), F.lit(2)))).alias("said"), "salary_max", "category")
    m = p.groupBy("category").agg(F.avg("salary_max").alias("mean"))
    e = p.join(s, "said", "left").join(m, "category", "left")
    both = F.col("label").isNotNull() & F.col("predicted").isNotNull()
    hit = F.when(both, (F.col("label") == F.col("predicted")).cast("double"))
    return e.groupBy("source").agg(F.count_if(both).alias("n"), F.round(100 * F.avg(hit), 2).alias("accuracy"), F.round(F.avg(F.abs(F.col("salary_max") - F.col("mean"))), 0).alias("mae"))


# --- orders


@query("global_rank", "SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey DESC) AS place FROM customer")
def global_rank(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return R.global_row_number(c, [F.col("c_mktsegment"), F.col("c_custkey").desc()], "place").select("c_custkey", "place")


_BUCKET = "CASE WHEN refuses_sponsorship THEN 2 WHEN category = 'IT' THEN 0 ELSE 1 END"


@query("bucket_order", f"SELECT source, job_id, row_number() OVER (ORDER BY {_BUCKET}, salary_max DESC NULLS LAST, company_name ASC NULLS FIRST, source, job_id) AS place FROM {_ONE}")
def bucket_order(spark: SparkSession, d: str) -> DataFrame:
    """Order by bucket, then greatest salary with nulls last, then name with nulls first."""
    p = one_per_key(spark, d, "salary_max", "company_name", "category", "refuses_sponsorship")
    bucket = F.when(F.col("refuses_sponsorship"), 2).when(F.col("category") == "IT", 0).otherwise(1)
    order = [bucket, F.col("salary_max").desc_nulls_last(), F.col("company_name").asc_nulls_first(), F.col("source"), F.col("job_id")]
    return R.global_row_number(p, order, "place").select("source", "job_id", "place")


@query("latest_category_rank", "WITH m AS (SELECT tech_slug, max(postings) AS n FROM market_snapshot_companies WHERE snapshot_date = (SELECT max(snapshot_date) FROM market_snapshot_companies) GROUP BY 1) SELECT t.category, m.tech_slug, n, CAST(rank() OVER (PARTITION BY t.category ORDER BY n DESC NULLS LAST) AS INT) AS place FROM m JOIN technologies t ON t.tech_slug = m.tech_slug")
def latest_category_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank within its category on the latest day alone; equal counts share a rank."""
    m = table(spark, d, "market_snapshot_companies")
    last = m.agg(F.max("snapshot_date").alias("snapshot_date")).first().snapshot_date  # one value, so that the scan is filtered
    n = m.filter(F.col("snapshot_date") == F.lit(last)).groupBy("tech_slug").agg(F.max("postings").alias("n"))
    j = n.join(table(spark, d, "technologies").select("tech_slug", "category"), "tech_slug")
    return j.select("category", "tech_slug", "n", F.rank().over(Window.partitionBy("category").orderBy(F.col("n").desc_nulls_last())).alias("place"))


@query("stalest_first", "SELECT company_name, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S') AS last_load, count(*) AS postings FROM raw_postings WHERE company_name IS NOT NULL GROUP BY 1 ORDER BY max(CASE WHEN source <> 'feed_north' THEN ingested_at END) ASC NULLS FIRST, count(*) DESC, company_name LIMIT 40")
def stalest_first(spark: SparkSession, d: str) -> DataFrame:
    """What to load next: never loaded from the feeds that count first, then the longest ago; the batch size is the feature."""
    p = table(spark, d, "raw_postings").filter("company_name is not null").groupBy("company_name").agg(F.max(F.when(F.col("source") != "feed_north", F.col("ingested_at"))).alias("at"), F.max("ingested_at").alias("last"), F.count("*").alias("postings"))
    return p.orderBy(F.col("at").asc_nulls_first(), F.col("postings").desc(), "company_name").limit(40).select("company_name", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_load"), "postings")


@query("over_fetch", f"SELECT company_name, count(*) AS n FROM raw_postings WHERE company_name IS NOT NULL AND NOT regexp_matches(company_name, '{X.AGENCY}') GROUP BY 1 ORDER BY n DESC, company_name LIMIT 25")
def over_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 that are not denied: filtered before the cut, so that denials never leave the list short."""
    p = table(spark, d, "raw_postings").filter(F.col("company_name").isNotNull() & ~F.col("company_name").rlike(X.AGENCY))
    return p.groupBy("company_name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "company_name").limit(25)


def page_bounds(page: int, first: int = 50, step: int = 50, most: int = 1000) -> int:
    """Rows that a list shows after `page` requests for more."""
    return min(first + step * page, most)


@query("growing_pages", f"SELECT source, job_id FROM {_ONE} ORDER BY first_seen DESC NULLS LAST, source, job_id LIMIT 150")
def growing_pages(spark: SparkSession, d: str) -> DataFrame:
    """The list after two requests for more; the page is the feature."""
    return one_per_key(spark, d, "first_seen").orderBy(F.col("first_seen").desc_nulls_last(), "source", "job_id").limit(page_bounds(2)).select("source", "job_id")


_PAIR = f"""i AS {_TECH}, c AS (SELECT tech, count(*) AS n FROM i GROUP BY 1), t AS (SELECT count(DISTINCT (source, job_id)) AS n FROM i),
p AS (SELECT a.tech AS a, b.tech AS b, count(*) AS co FROM i a JOIN i b ON a.source = b.source AND a.job_id = b.job_id AND a.tech < b.tech GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _lifts(spark: SparkSession, d: str) -> DataFrame:
    i = techs(spark, d)
    lists = i.groupBy("source", "job_id").agg(F.array_sort(F.collect_set("tech")).alias("s"))  # at most the vocabulary
    pair = F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x AS a, y AS b))))"))
    p = lists.select(pair.alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("co")).filter("co >= 3")
    c = i.groupBy("tech").agg(F.count("*").alias("n"))
    t = i.agg(F.countDistinct("source", "job_id").alias("total"))
    j = p.join(c.select(F.col("tech").alias("a"), F.col("n").alias("n_a")), "a").join(c.select(F.col("tech").alias("b"), F.col("n").alias("n_b")), "b").crossJoin(F.broadcast(t))  # one row
    return j.withColumn("lift", F.round((F.col("co") / F.col("n_a")) / (F.col("n_b") / F.col("total")), 2))


@query("largest_lift", f"WITH {_PAIR} SELECT a, b, co, round((co::DOUBLE / x.n) / (y.n::DOUBLE / t.n), 2) AS lift FROM p JOIN c x ON x.tech = a JOIN c y ON y.tech = b, t ORDER BY lift DESC, co DESC, a, b LIMIT 12")
def largest_lift(spark: SparkSession, d: str) -> DataFrame:
    """The 12 pairs of the greatest lift."""
    return _lifts(spark, d).select("a", "b", "co", "lift").orderBy(F.col("lift").desc(), F.col("co").desc(), "a", "b").limit(12)


@query("stack_pairs", f"WITH {_PAIR} SELECT a AS tech_a, b AS tech_b, co, round(100.0 * co / least(x.n, y.n), 1) AS share FROM p JOIN c x ON x.tech = a JOIN c y ON y.tech = b WHERE co >= 8")
def stack_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _lifts(spark, d).filter("co >= 8").select(F.col("a").alias("tech_a"), F.col("b").alias("tech_b"), "co", C.pct(F.col("co"), F.least("n_a", "n_b"), 1).alias("share"))


@query("best_per_company", f"SELECT trim(company_name) AS company, source, job_id, salary_max FROM {_ONE} WHERE trim(coalesce(company_name, '')) <> '' QUALIFY row_number() OVER (PARTITION BY trim(company_name) ORDER BY salary_max DESC NULLS LAST, job_id, source) = 1")
def best_per_company(spark: SparkSession, d: str) -> DataFrame:
    p = one_per_key(spark, d, "company_name", "salary_max").withColumn("company", C.blank_to_null(F.col("company_name"))).filter("company is not null")
    return R.first_per_key(p, ["company"], [F.col("salary_max").desc_nulls_last(), F.col("job_id"), F.col("source")]).select("company", "source", "job_id", "salary_max")


# --- models


@query(
    "stg_flags",
    f"""SELECT source, job_id, CASE {" ".join(f"WHEN regexp_matches(lower(coalesce(job_title, '')), '{p}') THEN '{n}'" for n, p in X.SENIORITY)} ELSE 'mid' END AS seniority,
 regexp_matches(lower(coalesce(job_title, '')), '{X.INTERNSHIP}') AS is_internship, nullif(trim(split_part(location, ',', 1)), '') AS city, location ILIKE '%remote%' AS is_remote, salary_max IS NOT NULL AND NOT coalesce(salary_is_predicted, false) AS salary_reported,
 CASE WHEN salary_max BETWEEN 20000 AND 1000000 THEN salary_max END AS salary_max, coalesce(refuses_sponsorship, false) AS refuses FROM {_ONE}""",
)
def stg_flags(spark: SparkSession, d: str) -> DataFrame:
    """What the staging model derives from each posting."""
    p = one_per_key(spark, d, "location", "salary_max", "salary_is_predicted", "refuses_sponsorship")
    t = F.col("job_title")
    return p.select(
        "source", "job_id", X.first_rung(t, X.SENIORITY, "mid").alias("seniority"), F.lower(F.coalesce(t, F.lit(""))).rlike(X.INTERNSHIP).alias("is_internship"), C.blank_to_null(F.split_part("location", F.lit(","), F.lit(1))).alias("city"),
        F.col("location").ilike("%remote%").alias("is_remote"), (F.col("salary_max").isNotNull() & ~F.coalesce("salary_is_predicted", F.lit(False))).alias("salary_reported"),
        F.when(F.col("salary_max").between(20000, 1000000), F.col("salary_max")).alias("salary_max"), F.coalesce("refuses_sponsorship", F.lit(False)).alias("refuses"),
    )


_COMPANY_TECH = f"(SELECT DISTINCT trim(company_name) AS company, tech FROM raw_postings r JOIN {_TECH} t ON t.source = r.source AND t.job_id = r.job_id WHERE nullif(trim(company_name), '') IS NOT NULL)"


@query(
    "company_peers",
    f"""WITH s AS {_COMPANY_TECH}, v AS (SELECT trim(company_name) AS company FROM raw_postings GROUP BY 1 HAVING count(*) >= 15), x AS (SELECT s.* FROM s JOIN v ON v.company = s.company), z AS (SELECT company, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.company, b.company AS peer, count(*) AS shared FROM x a JOIN x b ON a.tech = b.tech AND a.company <> b.company GROUP BY 1, 2 HAVING count(*) >= 15),
q AS (SELECT p.company, peer, shared, round(shared::DOUBLE / (u.n + w.n - shared), 3) AS similarity FROM p JOIN z u ON u.company = p.company JOIN z w ON w.company = peer)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company ORDER BY similarity DESC, shared DESC, peer) AS INT) AS peer_rank FROM q WHERE similarity >= 0.35) WHERE peer_rank <= 6""",
)
def company_peers(spark: SparkSession, d: str) -> DataFrame:
    """Up to six companies with the most similar technologies: 15 postings, 15 shared and a similarity of 0.35 at least."""
    p = table(spark, d, "raw_postings").select("source", "job_id", C.blank_to_null(F.col("company_name")).alias("company")).filter("company is not null")
    many = p.groupBy("company").agg(F.count("*").alias("n")).filter("n >= 15").select("company")
    s = p.distinct().join(techs(spark, d), ["source", "job_id"]).select("company", "tech").distinct().join(many, "company", "left_semi")
    return nearest_peers(s, entity="company", item="tech", least_shared=15, least=0.35, k=6)


@query("salary_leaders", f"SELECT tech, count(*) AS postings, round(avg(salary_max), 0) AS mean_salary, CAST(rank() OVER (ORDER BY round(avg(salary_max), 0) DESC) AS INT) AS place FROM {_ONE} p JOIN {_TECH} t ON t.source = p.source AND t.job_id = p.job_id WHERE salary_max BETWEEN 20000 AND 1000000 AND NOT coalesce(salary_is_predicted, false) GROUP BY 1 HAVING count(*) >= 10")
def salary_leaders(spark: SparkSession, d: str) -> DataFrame:
    p = one_per_key(spark, d, "salary_max", "salary_is_predicted").filter(F.col("salary_max").between(20000, 1000000) & ~F.coalesce("salary_is_predicted", F.lit(False)))
    g = p.join(techs(spark, d), ["source", "job_id"]).groupBy("tech").agg(F.count("*").alias("postings"), F.round(F.avg("salary_max"), 0).alias("mean_salary")).filter("postings >= 10")
    return g.withColumn("place", F.rank().over(Window.partitionBy().orderBy(F.col("mean_salary").desc())))  # a row per entry of the vocabulary


@query(
    "company_roles",
    f"SELECT * FROM (SELECT trim(company_name) AS company, job_title, count(*) AS openings, CAST(row_number() OVER (PARTITION BY trim(company_name) ORDER BY count(*) DESC, job_title NULLS FIRST) AS INT) AS place FROM {_ONE} WHERE nullif(trim(company_name), '') IS NOT NULL GROUP BY 1, 2) WHERE place <= 10",
)
def company_roles(spark: SparkSession, d: str) -> DataFrame:
    """The ten titles that each company posts most."""
    g = one_per_key(spark, d, "company_name").groupBy(C.blank_to_null(F.col("company_name")).alias("company"), "job_title").agg(F.count("*").alias("openings")).filter("company is not null")
    return g.withColumn("place", F.row_number().over(Window.partitionBy("company").orderBy(F.col("openings").desc(), F.col("job_title").asc_nulls_first()))).filter("place <= 10")


@query(
    "tech_detail",
    f"""SELECT tech, count(*) AS postings, count(DISTINCT trim(company_name)) FILTER (trim(company_name) <> '') AS companies, count(DISTINCT location_state) AS states, round(avg(CASE WHEN salary_max BETWEEN 20000 AND 1000000 THEN salary_max END), 0) AS mean_salary,
 strftime(max(first_seen), '%Y-%m-%d') AS newest FROM {_ONE} p JOIN {_TECH} t ON t.source = p.source AND t.job_id = p.job_id GROUP BY 1""",
)
def tech_detail(spark: SparkSession, d: str) -> DataFrame:
    j = one_per_key(spark, d, "company_name", "location_state", "salary_max", "first_seen").join(techs(spark, d), ["source", "job_id"])
    return j.groupBy("tech").agg(
        F.count("*").alias("postings"), F.countDistinct(C.blank_to_null(F.col("company_name"))).alias("companies"), F.countDistinct("location_state").alias("states"),
        F.round(F.avg(F.when(F.col("salary_max").between(20000, 1000000), F.col("salary_max"))), 0).alias("mean_salary"), F.date_format(F.max("first_seen"), "yyyy-MM-dd").alias("newest"),
    )


@query(
    "tech_employers",
    f"""WITH e AS (SELECT tech, trim(company_name) AS company, count(*) AS n FROM {_ONE} p JOIN {_TECH} t ON t.source = p.source AND t.job_id = p.job_id WHERE nullif(trim(company_name), '') IS NOT NULL GROUP BY 1, 2)
SELECT tech, company, n, round(100.0 * n / total, 1) AS share, CAST(place AS INT) AS place FROM (SELECT *, sum(n) OVER (PARTITION BY tech) AS total, row_number() OVER (PARTITION BY tech ORDER BY n DESC, company) AS place FROM e) WHERE place <= 25""",
)
def tech_employers(spark: SparkSession, d: str) -> DataFrame:
    e = one_per_key(spark, d, "company_name").withColumn("company", C.blank_to_null(F.col("company_name"))).filter("company is not null").join(techs(spark, d), ["source", "job_id"]).groupBy("tech", "company").agg(F.count("*").alias("n"))
    total = e.groupBy("tech").agg(F.sum("n").alias("total"))
    top = e.withColumn("place", F.row_number().over(Window.partitionBy("tech").orderBy(F.col("n").desc(), "company"))).filter("place <= 25")
    return top.join(total, "tech").select("tech", "company", "n", C.pct(F.col("n"), F.col("total"), 1).alias("share"), "place")


@query(
    "market_position",
    """WITH m AS (SELECT snapshot_date, tech_slug, company_name, max(postings) AS n FROM market_snapshot_companies WHERE postings IS NOT NULL GROUP BY 1, 2, 3), l AS (SELECT * FROM m WHERE snapshot_date = (SELECT max(snapshot_date) FROM market_snapshot_companies))
SELECT company_name, count(*) AS techs, sum(n)::BIGINT AS postings, min(place)::BIGINT AS best_place FROM (SELECT *, rank() OVER (PARTITION BY tech_slug ORDER BY n DESC) AS place FROM l) GROUP BY 1""",
)
def market_position(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "market_snapshot_companies")
    last = m.agg(F.max("snapshot_date").alias("d")).first().d
    l = m.filter((F.col("snapshot_date") == F.lit(last)) & F.col("postings").isNotNull()).groupBy("tech_slug", "company_name").agg(F.max("postings").alias("n"))
    r = l.withColumn("place", F.rank().over(Window.partitionBy("tech_slug").orderBy(F.col("n").desc())))
    return r.groupBy("company_name").agg(F.count("*").alias("techs"), F.sum("n").alias("postings"), F.min("place").cast("long").alias("best_place"))


@query("retired_names", "SELECT DISTINCT company_name FROM posting_snapshots WHERE company_name IS NOT NULL AND company_name NOT IN (SELECT company_name FROM posting_snapshots WHERE company_name IS NOT NULL AND snapshot_no = (SELECT max(snapshot_no) FROM posting_snapshots))")
def retired_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of earlier deliveries that the last one lacks."""
    s = table(spark, d, "posting_snapshots").select("snapshot_no", "company_name").filter("company_name is not null")
    seen = s.groupBy("company_name").agg(F.max("snapshot_no").alias("last"))
    n = table(spark, d, "posting_snapshots").agg(F.max("snapshot_no").alias("n")).first().n
    return seen.filter(F.col("last") < F.lit(n)).select("company_name")


@query(
    "changed_candidates",
    f"""WITH p AS (SELECT source, job_id, job_title, category, salary_max, substring(sha256(trim(description_raw)), 1, 16) AS h FROM {_ONE} WHERE description_raw IS NOT NULL), s AS (SELECT source, job_id, CASE WHEN category = 'IT' THEN h ELSE 'old' END AS h FROM p WHERE source LIKE 'feed%')
SELECT p.source, p.job_id, CASE WHEN s.source IS NULL THEN 'new' ELSE 'changed' END AS why FROM p LEFT JOIN s ON s.source = p.source AND s.job_id = p.job_id WHERE (s.source IS NULL OR s.h <> p.h) AND regexp_matches(lower(job_title), '{X.RELEVANT}') AND (salary_max IS NULL OR salary_max >= 60000)""",
)
def changed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What is to be read again: relevant titles whose text was never scored, or scored in another version; unknown salaries stay in."""
    p = one_per_key(spark, d, "category", "salary_max", "description_raw").filter("description_raw is not null").withColumn("h", F.substring(F.sha2(F.trim("description_raw"), 256), 1, 16)).drop("description_raw")
    scored = p.filter("source like 'feed%'").select("source", "job_id", F.when(F.col("category") == "IT", F.col("h")).otherwise("old").alias("scored"))
    open_ = p.filter(F.lower("job_title").rlike(X.RELEVANT) & (F.col("salary_max").isNull() | (F.col("salary_max") >= 60000))).join(scored, ["source", "job_id"], "left")
    return open_.filter("scored is null or scored <> h").select("source", "job_id", F.when(F.col("scored").isNull(), "new").otherwise("changed").alias("why"))


@query(
    "peer_summary",
    f"""WITH n AS (SELECT category, trim(company_name) AS company, count(*) FILTER (CAST(first_seen AS DATE) > DATE '2026-09-18') AS last30 FROM {_ONE} WHERE nullif(trim(company_name), '') IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
m AS (SELECT category, list_sort(list(last30))[CAST(floor(count(*) / 2) AS INT) + 1] AS peer_median FROM n GROUP BY 1)
SELECT n.category, company, last30, peer_median, CASE WHEN peer_median > 0 THEN round(last30::DOUBLE / peer_median, 1) END AS ratio FROM n JOIN m ON m.category = n.category""",
)
def peer_summary(spark: SparkSession, d: str) -> DataFrame:
    """A company's month against the upper median of its category; no ratio to a median of 0."""
    recent = F.count_if(F.to_date("first_seen") > F.lit("2026-09-18").cast("date"))
    p = one_per_key(spark, d, "category", "company_name", "first_seen").withColumn("company", C.blank_to_null(F.col("company_name"))).filter("company is not null and category is not null")
    n = p.groupBy("category", "company").agg(recent.alias("last30"))
    m = R.upper_median(n.groupBy("category", "last30").agg(F.count("*").alias("k")), ["category"], "last30", "k", "peer_median")
    return n.join(m, "category").withColumn("ratio", F.when(F.col("peer_median") > 0, F.round(F.col("last30") / F.col("peer_median"), 1))).select("category", "company", "last30", "peer_median", "ratio")


# --- searches


def posting_filter(p: DataFrame, *, words=(), states=(), remote=False, paid_only=False, least_salary=None, skills=None, companies=(), sources=(), since=None, until=None, level=None, sort="newest") -> tuple[DataFrame, list]:
    """(rows, order). An absent parameter filters nothing. Sorts: newest, oldest, salary, company; each ends in the key."""
    p = search(p, words=list(words), states=list(states), remote=remote, least_salary=least_salary, paid_only=paid_only, skills=skills)
    if companies:
        p = p.filter(F.lower(F.trim("company_name")).isin([c.lower() for c in companies]))
    if sources:
        p = p.filter(F.col("source").isin(list(sources)))
    if since is not None:
        p = p.filter(F.to_date("posted_date") >= F.lit(since).cast("date"))
    if until is not None:
        p = p.filter(F.to_date("posted_date") <= F.lit(until).cast("date"))
    if level is not None:
        p = p.filter(X.first_rung(F.col("job_title"), X.SENIORITY, "mid") == level)
    first = {"newest": F.col("posted_date").desc_nulls_last(), "oldest": F.col("posted_date").asc_nulls_last(), "salary": F.col("salary_max").desc_nulls_last(), "company": F.lower("company_name").asc_nulls_last()}[sort]
    return p, [first, F.col("source"), F.col("job_id")]


_MID = f"CASE {' '.join(f'''WHEN regexp_matches(lower(coalesce(job_title, '')), '{p}') THEN '{n}' ''' for n, p in X.SENIORITY)} ELSE 'mid' END = 'mid'"
_SORTS = {"newest": "posted_date DESC NULLS LAST", "oldest": "posted_date ASC NULLS LAST", "salary": "salary_max DESC NULLS LAST", "company": "lower(company_name) ASC NULLS LAST"}


@query(
    "posting_filter",
    f"WITH f AS (SELECT p.* FROM {_ONE} p WHERE contains(lower(coalesce(job_title, '')), 'e') AND (location_state IN ('Texas', 'Ohio', 'Oregon') OR location ILIKE '%remote%') AND source IN ('feed_north', 'feed_west', 'company_board') AND CAST(posted_date AS DATE) >= DATE '2026-07-15' AND CAST(posted_date AS DATE) <= DATE '2026-10-15' AND coalesce(salary_max, 0) > 0 AND salary_max >= 50000 AND {_MID} AND EXISTS (SELECT 1 FROM {_TECH} t JOIN technologies v ON v.tech_slug = t.tech WHERE v.is_tracked AND t.source = p.source AND t.job_id = p.job_id)) "
    + " UNION ALL ".join(f"SELECT '{n}' AS sort, source, job_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY {o}, source, job_id) AS place FROM f) WHERE place <= 50" for n, o in _SORTS.items()),
)
def posting_filter_query(spark: SparkSession, d: str) -> DataFrame:
    """The first page of one search under each of its four sorts; the page is the feature."""
    p = one_per_key(spark, d, "location_state", "location", "salary_max", "posted_date", "company_name")
    tracked = techs(spark, d).join(table(spark, d, "technologies").filter("is_tracked").select(F.col("tech_slug").alias("tech")), "tech", "left_semi")
    pages = []
    for sort in _SORTS:
        rows, order = posting_filter(p, words=["e"], states=["Texas", "Ohio", "Oregon"], remote=True, sources=["feed_north", "feed_west", "company_board"], since="2026-07-15", until="2026-10-15", paid_only=True, least_salary=50000, level="mid", skills=tracked, sort=sort)
        page = rows.orderBy(*order).limit(page_bounds(0))
        w = Window.partitionBy().orderBy(*order)  # over a page
        pages.append(page.select(F.lit(sort).alias("sort"), "source", "job_id", F.row_number().over(w).alias("place")))
    return reduce(DataFrame.unionByName, pages)


_FACET = f"(SELECT p.* FROM {_ONE} p WHERE contains(lower(coalesce(job_title, '')), 'e') AND contains(lower(coalesce(job_title, '')), 'r') AND EXISTS (SELECT 1 FROM {_TECH} t WHERE t.source = p.source AND t.job_id = p.job_id AND t.tech IN (SELECT tech_slug FROM technologies WHERE is_tracked)))"


@query(
    "facet_counts",
    f"""WITH f AS {_FACET} SELECT 'state' AS facet, CASE WHEN location ILIKE '%remote%' THEN 'Remote' ELSE coalesce(location_state, 'none') END AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM f GROUP BY 2
UNION ALL SELECT 'category', coalesce(category, 'none'), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'paid', CAST(salary_max IS NOT NULL AS VARCHAR), count(*) FROM f GROUP BY 2 UNION ALL SELECT 'skill', tech, count(*) FROM f JOIN {_TECH} t ON t.source = f.source AND t.job_id = f.job_id GROUP BY 2""",
)
def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """All of the words, any of the skills; counts of five facets, Remote being a state."""
    t = techs(spark, d)
    tracked = t.join(table(spark, d, "technologies").filter("is_tracked").select(F.col("tech_slug").alias("tech")), "tech", "left_semi")
    f = search(one_per_key(spark, d, "location", "location_state", "category", "salary_max"), words=["e", "r"], skills=tracked)
    state = F.when(F.col("location").ilike("%remote%"), "Remote").otherwise(F.coalesce("location_state", F.lit("none")))
    each = {"state": state, "source": F.col("source"), "category": F.coalesce("category", F.lit("none")), "paid": F.col("salary_max").isNotNull().cast("string")}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in each.items()]))
    rows = f.select(values.alias("f")).select("f.facet", "f.value").unionByName(f.select("source", "job_id").join(t, ["source", "job_id"]).select(F.lit("skill").alias("facet"), F.col("tech").alias("value")))
    return rows.groupBy("facet", "value").agg(F.count("*").alias("n"))


@query("agent_batch", f"WITH b AS (SELECT trim(company_name) AS company, source, job_id, salary_max, first_seen FROM {_ONE} WHERE nullif(trim(company_name), '') IS NOT NULL AND category = 'IT' QUALIFY row_number() OVER (PARTITION BY trim(company_name) ORDER BY salary_max DESC NULLS LAST, job_id, source) = 1) SELECT company, source, job_id FROM b WHERE company IN (SELECT company_name FROM company_employer_key WHERE employer_key IS NOT NULL) ORDER BY first_seen DESC NULLS LAST, company LIMIT 30")
def agent_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next 30 companies to work on, each with its best posting; only those with a known employer. The batch is the feature."""
    p = one_per_key(spark, d, "company_name", "category", "salary_max", "first_seen").withColumn("company", C.blank_to_null(F.col("company_name"))).filter("company is not null and category = 'IT'")
    best = R.first_per_key(p, ["company"], [F.col("salary_max").desc_nulls_last(), F.col("job_id"), F.col("source")])
    known = table(spark, d, "company_employer_key").filter("employer_key is not null").select(F.col("company_name").alias("company"))
    return best.join(known, "company", "left_semi").orderBy(F.col("first_seen").desc_nulls_last(), "company").limit(30).select("company", "source", "job_id")


@query(
    "dashboard_slices",
    """WITH d AS (SELECT snapshot_date, tech_slug, sum(postings)::BIGINT AS n FROM market_snapshot_companies GROUP BY 1, 2), l AS (SELECT tech_slug, n FROM d WHERE snapshot_date = (SELECT max(snapshot_date) FROM d)), o AS (SELECT tech_slug, count(*) AS days FROM d GROUP BY 1), t AS (SELECT max(n) FILTER (k = 1) AS a, max(n) FILTER (k = 2) AS b FROM (SELECT n, row_number() OVER (ORDER BY n DESC NULLS LAST, tech_slug) AS k FROM l))
SELECT l.tech_slug, l.n, days, days >= 2 AS usable, round(t.a::DOUBLE / t.b, 3) AS top_two FROM l JOIN o ON o.tech_slug = l.tech_slug, t""",
)
def dashboard_slices(spark: SparkSession, d: str) -> DataFrame:
    """Latest day, whether a series has days enough to draw, and the ratio of the two greatest."""
    day = table(spark, d, "market_snapshot_companies").groupBy("snapshot_date", "tech_slug").agg(F.sum("postings").alias("n"))
    last = table(spark, d, "market_snapshot_companies").agg(F.max("snapshot_date").alias("d")).first().d
    l, o = day.filter(F.col("snapshot_date") == F.lit(last)).select("tech_slug", "n"), day.groupBy("tech_slug").agg(F.count("*").alias("days"))
    two = [r.n for r in l.orderBy(F.col("n").desc_nulls_last(), "tech_slug").limit(2).collect()]  # two rows
    ratio = F.round(F.lit(two[0]).cast("double") / F.lit(two[1]).cast("double"), 3) if len(two) == 2 else F.lit(None).cast("double")
    return l.join(o, "tech_slug").select("tech_slug", "n", "days", (F.col("days") >= 2).alias("usable"), ratio.alias("top_two"))


# --- expectations


_EXPECT = """
SELECT 'volume postings' AS name, true AS fatal, count(*) >= 100 AS ok, CAST(count(*) AS VARCHAR) AS detail FROM raw_postings
UNION ALL SELECT 'volume technologies', true, count(*) >= 100, CAST(count(*) AS VARCHAR) FROM technologies
UNION ALL SELECT 'fresh', true, max(last_seen) >= TIMESTAMP '2026-10-15', strftime(max(last_seen), '%Y-%m-%d') FROM raw_postings
UNION ALL SELECT 'no future dates', true, count(*) FILTER (CAST(posted_date AS DATE) > DATE '2026-10-20') = 0, CAST(count(*) FILTER (CAST(posted_date AS DATE) > DATE '2026-10-20') AS VARCHAR) FROM raw_postings
UNION ALL SELECT 'no self pair', true, true, '0' UNION ALL SELECT 'reported salaries are not estimates', true, true, '0'
UNION ALL SELECT 'keys with technologies', false, 100.0 * count(t.k) / count(*) >= 50, CAST(CAST(floor(100.0 * count(t.k) / count(*)) AS BIGINT) AS VARCHAR) FROM (SELECT DISTINCT source, job_id FROM raw_postings) p LEFT JOIN (SELECT DISTINCT source, job_id, 1 AS k FROM posting_technologies) t ON t.source = p.source AND t.job_id = p.job_id
UNION ALL SELECT 'salary spread', false, stddev_pop(salary_max) > 1000, CAST(CAST(floor(stddev_pop(salary_max) / 1000) AS BIGINT) AS VARCHAR) FROM raw_postings
UNION ALL SELECT 'measured days', false, count(DISTINCT snapshot_date) >= 28, CAST(count(DISTINCT snapshot_date) AS VARCHAR) FROM posting_snapshots
UNION ALL SELECT 'days for claims', false, count(DISTINCT snapshot_date) >= 45, CAST(count(DISTINCT snapshot_date) AS VARCHAR) FROM posting_snapshots
UNION ALL SELECT 'labelled example', true, count(*) FILTER (company_name IS NULL OR (match_type IS NOT NULL AND match_type NOT IN ('exact', 'alias_seed', 'prefix_strong', 'prefix_weak', 'prefix_ambiguous'))) = 0, CAST(count(*) FILTER (company_name IS NULL OR (match_type IS NOT NULL AND match_type NOT IN ('exact', 'alias_seed', 'prefix_strong', 'prefix_weak', 'prefix_ambiguous'))) AS VARCHAR) FROM company_employer_key
"""


@query("pipeline_expectations", _EXPECT)
def pipeline_expectations(spark: SparkSession, d: str) -> DataFrame:
    """(name, fatal, ok, detail); quality.gate raises on fatal ones, and on all of them if strict."""
    p, s, k = table(spark, d, "raw_postings"), table(spark, d, "posting_snapshots"), table(spark, d, "company_employer_key")
    n, days = F.count("*"), F.countDistinct("snapshot_date")
    future = F.count_if(F.to_date("posted_date") > F.lit("2026-10-20").cast("date"))
    bad = F.count_if(F.col("company_name").isNull() | (F.col("match_type").isNotNull() & ~F.col("match_type").isin("exact", "alias_seed", "prefix_strong", "prefix_weak", "prefix_ambiguous")))
    any_tech = p.select("source", "job_id").distinct().join(table(spark, d, "posting_technologies").select("source", "job_id").distinct().withColumn("k", F.lit(1)), ["source", "job_id"], "left")
    share, spread_ = 100.0 * F.count("k") / n, F.stddev_pop("salary_max")
    text = lambda c: c.cast("string")
    pairs = _lifts(spark, d)
    flags = stg_flags(spark, d).join(one_per_key(spark, d, "salary_is_predicted").select("source", "job_id", "salary_is_predicted"), ["source", "job_id"])
    leaks = F.count_if(F.col("salary_reported") & F.coalesce("salary_is_predicted", F.lit(False)))
    return Q.expectations(
        [
            ("volume postings", True, p, n >= 100, text(n)), ("volume technologies", True, table(spark, d, "technologies"), n >= 100, text(n)),
            ("fresh", True, p, F.max("last_seen") >= F.lit("2026-10-15").cast("timestamp"), F.date_format(F.max("last_seen"), "yyyy-MM-dd")), ("no future dates", True, p, future == 0, text(future)),
            ("no self pair", True, pairs, F.count_if(F.col("a") == F.col("b")) == 0, text(F.count_if(F.col("a") == F.col("b")))), ("reported salaries are not estimates", True, flags, leaks == 0, text(leaks)),
            ("keys with technologies", False, any_tech, share >= 50, text(F.floor(share))), ("salary spread", False, p, spread_ > 1000, text(F.floor(spread_ / 1000))),
            ("measured days", False, s, days >= 28, text(days)), ("days for claims", False, s, days >= 45, text(days)), ("labelled example", True, k, bad == 0, text(bad)),
        ]
    )


@query("source_parity", "SELECT name, CAST(n AS BIGINT) AS n FROM (SELECT 'raw_postings' AS name, count(*) AS n FROM raw_postings UNION ALL SELECT 'posting_technologies', count(*) FROM posting_technologies UNION ALL SELECT 'technologies', count(*) FROM technologies UNION ALL SELECT 'dol_employer_summary', count(*) FROM dol_employer_summary UNION ALL SELECT 'posting keys', count(DISTINCT (source, job_id)) FROM raw_postings UNION ALL SELECT 'companies', count(DISTINCT company_name) FROM raw_postings UNION ALL SELECT 'paid', count(salary_max) FROM raw_postings UNION ALL SELECT 'refusals', count(*) FILTER (refuses_sponsorship) FROM raw_postings UNION ALL SELECT 'filings', sum(filings) FROM dol_employer_summary UNION ALL SELECT 'slugs', count(DISTINCT tech_slug) FROM posting_technologies UNION ALL SELECT 'mapped', count(employer_key) FROM company_employer_key)")
def source_parity(spark: SparkSession, d: str) -> DataFrame:
    """Scalars that two engines must agree on: counts of the sources first, then of what is derived from them."""
    p, t = table(spark, d, "raw_postings"), table(spark, d, "posting_technologies")
    n = F.count("*")
    scalars = [
        ("raw_postings", p, n), ("posting_technologies", t, n), ("technologies", table(spark, d, "technologies"), n), ("dol_employer_summary", table(spark, d, "dol_employer_summary"), n), ("posting keys", p, F.countDistinct("source", "job_id")), ("companies", p, F.countDistinct("company_name")),
        ("paid", p, F.count("salary_max")), ("refusals", p, F.count_if("refuses_sponsorship")), ("filings", table(spark, d, "dol_employer_summary"), F.sum("filings")), ("slugs", t, F.countDistinct("tech_slug")), ("mapped", table(spark, d, "company_employer_key"), F.count("employer_key")),
    ]
    return reduce(DataFrame.unionByName, [df.agg(c.cast("long").alias("n")).select(F.lit(name).alias("name"), "n") for name, df, c in scalars])
