"""Sources, sinks and serving queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans.registry import query
from tidemark.session import new_path
from tidemark.sources import documents as D
from tidemark.sources.tables import table


@query("json_documents", "SELECT source, job_id, country, company_name, job_title, location, location_state, salary_min, salary_max, salary_is_predicted, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS loaded FROM raw_postings")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Postings written as nested JSON documents and read back flat."""
    path = new_path(spark, "documents")
    D.to_documents(table(spark, d, "raw_postings")).write.json(path)
    flat = D.read_postings(spark, path)
    return flat.withColumn("loaded", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss")).drop("ingested_at")


@query("export_partitions", "SELECT source, coalesce(strftime(posted_date, '%Y-%m'), 'none') AS posted_month, count(*) AS n FROM raw_postings GROUP BY 1, 2")
def export_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Export by source and month; a second export of one source replaces its partitions only."""
    path = new_path(spark, "export")
    p = table(spark, d, "raw_postings")
    month = F.coalesce(F.date_format("posted_date", "yyyy-MM"), F.lit("none"))
    D.export(p, path, source=F.col("source"), posted_month=month)
    D.export(p.filter("source = 'feed_west'"), path, source=F.col("source"), posted_month=month)
    return spark.read.option("basePath", path).parquet(path).groupBy("source", F.col("posted_month").cast("string").alias("posted_month")).agg(F.count("*").alias("n"))


@query("resume_partitions", "SELECT DISTINCT source FROM raw_postings WHERE source NOT LIKE 'feed%'")
def resume_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Partitions that an interrupted export still lacks."""
    path = new_path(spark, "partial")
    p = table(spark, d, "raw_postings").select("source", "job_id")
    D.export(p.filter("source like 'feed%'"), path, source=F.col("source"))
    return D.missing_partitions(p.select("source").distinct(), spark, path, ["source"])


_STAMPS = ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {c}" for c in ("posted_date", "ingested_at", "first_seen", "last_seen", "description_dropped_at"))


@query(
    "mirror_json",
    f"""SELECT * EXCLUDE (location_area, posted_date, ingested_at, first_seen, last_seen, description_dropped_at, salary_min), CASE WHEN location_area IS NOT NULL THEN CAST(to_json(location_area) AS VARCHAR) END AS location_area, {_STAMPS},
 CAST(CAST(salary_min AS DECIMAL(12, 2)) AS DOUBLE) AS salary_min FROM raw_postings""",
)
def mirror_json(spark: SparkSession, d: str) -> DataFrame:
    """All columns: arrays as JSON, timestamps as text to the microsecond, decimals as doubles."""
    return D.mirror(table(spark, d, "raw_postings").withColumn("salary_min", F.col("salary_min").cast("decimal(12,2)")))


@query("keyset_page", "SELECT DISTINCT source, job_id FROM raw_postings WHERE (source, job_id) > ('feed_north', '1') ORDER BY source, job_id LIMIT 100")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return D.keyset_page(table(spark, d, "raw_postings").select("source", "job_id").distinct(), ["source", "job_id"], ["feed_north", "1"], 100)


@query(
    "histogram_bands",
    """WITH h AS (SELECT source, CAST(floor(salary_max / 20000) * 20000 AS INT) AS bucket, count(*) AS n FROM raw_postings WHERE salary_max IS NOT NULL GROUP BY 1, 2) SELECT source, bucket, n FROM h""",
)
def histogram_bands(spark: SparkSession, d: str) -> DataFrame:
    """A histogram held as a map of text to count per source, and taken apart again; keys that are no numbers drop out."""
    p = table(spark, d, "raw_postings").groupBy("source", F.coalesce((F.floor(F.col("salary_max") / 20000) * 20000).cast("string"), F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))
    maps = p.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("h"))  # a bounded number of bands
    return maps.select("source", F.explode("h").alias("k", "n")).select("source", F.col("k").try_cast("int").alias("bucket"), "n").filter("bucket is not null")


@query(
    "ranked_lists",
    "SELECT source, company_name, CAST(place AS INT) AS place FROM (SELECT source, company_name, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, company_name) AS place FROM raw_postings WHERE company_name IS NOT NULL GROUP BY 1, 2) WHERE place <= 15",
)
def ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    """Delivered lists taken apart by position: rank is the place in the list."""
    c = table(spark, d, "raw_postings").filter("company_name is not null").groupBy("source", "company_name").agg(F.count("*").alias("n"))
    top = c.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "company_name"))).filter("place <= 15")
    lists = top.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "company_name"))).alias("names"))  # 15 entries
    return lists.select("source", F.posexplode("names").alias("pos", "x")).select("source", "x.company_name", (F.col("pos") + 1).alias("place"))


@query(
    "corpus_stats",
    """SELECT (SELECT count(DISTINCT (source, job_id)) FROM raw_postings) AS postings, (SELECT count(DISTINCT trim(company_name)) FROM raw_postings WHERE trim(company_name) <> '') AS companies,
 (SELECT count(*) FROM posting_technologies) AS mentions, (SELECT sum(filings)::BIGINT FROM dol_employer_summary) AS filings, (SELECT count(*) FROM technologies WHERE is_tracked) AS tracked""",
)
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings")
    one = p.agg(F.countDistinct("source", "job_id").alias("postings"), F.countDistinct(C.blank_to_null(F.col("company_name"))).alias("companies"))
    rest = [table(spark, d, "posting_technologies").agg(F.count("*").alias("mentions")), table(spark, d, "dol_employer_summary").agg(F.sum("filings").alias("filings")), table(spark, d, "technologies").agg(F.count_if("is_tracked").alias("tracked"))]
    for r in rest:
        one = one.crossJoin(r)  # one row each
    return one


@query("freshness", "SELECT source, strftime(max(last_seen), '%Y-%m-%d %H:%M:%S') AS last_seen, CAST(date_diff('day', CAST(max(last_seen) AS DATE), DATE '2026-10-18') AS INT) AS days_behind, date_diff('day', CAST(max(last_seen) AS DATE), DATE '2026-10-18') <= 3 AS fresh FROM raw_postings GROUP BY 1")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "raw_postings").groupBy("source").agg(F.max("last_seen").alias("last_seen"))
    behind = F.datediff(F.lit("2026-10-18"), F.col("last_seen"))
    return g.select("source", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), behind.alias("days_behind"), (behind <= 3).alias("fresh"))


@query(
    "location_states",
    r"""WITH s AS (SELECT DISTINCT lower(state) AS n, state FROM ref_locations), k AS (SELECT DISTINCT lower(state_code) AS n, state FROM ref_locations), v AS (SELECT DISTINCT location FROM raw_postings WHERE trim(location) <> ''),
x AS (SELECT location, nullif(trim(regexp_extract(lower(location), '([^,]*?)(?:,\s*(?:usa|can|united states|canada))?\s*\.?\s*$', 1)), '') AS tail FROM v)
SELECT location, coalesce(s.state, k.state) AS state FROM x LEFT JOIN s ON s.n = tail LEFT JOIN k ON k.n = tail""",
)
def location_states(spark: SparkSession, d: str) -> DataFrame:
    """State that ends a typed location, by full name before code, after a country word is taken off."""
    ref = table(spark, d, "ref_locations")
    s = ref.select(F.lower("state").alias("tail"), F.col("state").alias("by_name")).distinct()
    k = ref.select(F.lower("state_code").alias("tail"), F.col("state").alias("by_code")).distinct()
    tail = F.regexp_extract(F.lower("location"), r"([^,]*?)(?:,\s*(?:usa|can|united states|canada))?\s*\.?\s*$", 1)
    v = table(spark, d, "raw_postings").select("location").filter(F.trim("location") != "").distinct().withColumn("tail", C.blank_to_null(tail))
    return v.join(s, "tail", "left").join(k, "tail", "left").select("location", F.coalesce("by_name", "by_code").alias("state"))


_SAID = "CASE WHEN n IS NULL THEN 'soon' WHEN n <= 0 THEN 'listed today' WHEN n = 1 THEN 'listed yesterday' WHEN n > 30 THEN 'listed 30+ days ago' ELSE 'listed ' || n || ' days ago' END"


@query(
    "prose_dates",
    f"WITH x AS (SELECT source, job_id, date_diff('day', CAST(posted_date AS DATE), DATE '2026-10-18') AS n FROM raw_postings) SELECT source, job_id, {_SAID} AS said, CASE WHEN n IS NOT NULL THEN DATE '2026-10-18' - CAST(least(greatest(n, 0), 30) AS INT) END AS day FROM x",
)
def prose_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates told in words, read back against the day they were told on."""
    n = F.datediff(F.lit("2026-10-18"), F.to_date("posted_date"))
    said = F.when(n.isNull(), "soon").when(n <= 0, "listed today").when(n == 1, "listed yesterday").when(n > 30, "listed 30+ days ago").otherwise(F.concat(F.lit("listed "), n.cast("string"), F.lit(" days ago")))
    return table(spark, d, "raw_postings").select("source", "job_id", said.alias("said")).withColumn("day", C.relative_date(F.col("said"), F.lit("2026-10-18").cast("date")))
