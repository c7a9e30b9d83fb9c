"""Upserts, incremental loads, archive, history and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import relational as R
from tidemark.operators import retention
from tidemark.plans.registry import query
from tidemark.session import new_path
from tidemark.sources.tables import table

_ORDERS = "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CAST(o_orderdate AS DATE) AS first_seen, CAST(o_orderdate AS DATE) AS last_seen FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), day.alias("first_seen"), day.alias("last_seen"))


@query(
    "upsert_merge",
    f"""WITH o AS ({_ORDERS}), e AS (SELECT * FROM o WHERE status <> 'P'), i AS (SELECT k, 'X' AS status, CASE WHEN status = 'O' THEN price * 2 END AS price, last_seen + 30 AS first_seen, last_seen + 30 AS last_seen FROM o WHERE status <> 'F')
SELECT coalesce(i.k, e.k) AS k, coalesce(i.status, e.status) AS status, coalesce(i.price, e.price) AS price, coalesce(e.first_seen, i.first_seen) AS first_seen, coalesce(i.last_seen, e.last_seen) AS last_seen FROM e FULL JOIN i ON e.k = i.k""",
)
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """first_seen is kept, price is filled where the new one is known, the rest is replaced."""
    o = _orders(spark, d)
    later = F.date_add("last_seen", 30)
    i = o.filter("status <> 'F'").select("k", F.lit("X").alias("status"), F.when(F.col("status") == "O", F.col("price") * 2).alias("price"), later.alias("first_seen"), later.alias("last_seen"))
    return R.upsert(o.filter("status <> 'P'"), i, keys=["k"], keep=["first_seen"], fill=["price"])


@query("last_load_wins", "SELECT source, job_id, job_title, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS loaded FROM raw_postings QUALIFY row_number() OVER (PARTITION BY source, job_id ORDER BY ingested_at DESC, job_title DESC) = 1")
def last_load_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("source", "job_id", "job_title", "ingested_at")
    last = R.first_per_key(p, ["source", "job_id"], [F.col("ingested_at").desc(), F.col("job_title").desc()])
    return last.select("source", "job_id", "job_title", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@query("insert_ignore", f"WITH o AS ({_ORDERS}) SELECT * FROM o WHERE status <> 'P' UNION ALL SELECT k, 'N', price, first_seen, last_seen FROM o WHERE status = 'P'")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    return R.insert_ignore(o.filter("status <> 'P'"), o.withColumn("status", F.lit("N")), ["k"])


@query(
    "incremental_orphans",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS q FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) - INTERVAL 200 DAY FROM lineitem)), m AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_orderkey = l.l_orderkey AND b.l_linenumber = l.l_linenumber) UNION ALL SELECT * FROM b)
SELECT l_orderkey, l_linenumber, q FROM m WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')""",
)
def incremental_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows past the high-water mark replace their keys; rows without a parent go."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), "l_shipdate")
    mark = l.agg((F.max("l_shipdate") - F.expr("interval 200 days")).alias("mark"))
    b = l.crossJoin(F.broadcast(mark)).filter("l_shipdate > mark").select("l_orderkey", "l_linenumber", (F.col("q") + 1).alias("q"))  # one row
    m = R.replace_batch(l.drop("l_shipdate"), b, ["l_orderkey", "l_linenumber"])
    return R.drop_orphans(m, table(spark, d, "orders").filter("o_orderstatus <> 'P'"), [("l_orderkey", "o_orderkey")])


@query(
    "keep_top_union_ref",
    """WITH t AS (SELECT employer_key FROM (SELECT employer_key, row_number() OVER (ORDER BY sum(filings) DESC, employer_key) AS r FROM dol_employer_summary WHERE employer_key IS NOT NULL GROUP BY 1) WHERE r <= 20)
SELECT employer_key, fiscal_year, filings FROM dol_employer_summary WHERE employer_key IN (SELECT employer_key FROM t) OR employer_key IN (SELECT employer_key FROM company_employer_key WHERE employer_key IS NOT NULL)""",
)
def keep_top_union_ref(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "dol_employer_summary").select("employer_key", "fiscal_year", "filings").filter("employer_key is not null")
    return R.keep_top_or_referenced(e, key="employer_key", measure="filings", n=20, referenced=table(spark, d, "company_employer_key").filter("employer_key is not null"))


_DIGEST = "substring(sha256(trim(replace(replace(description_raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)))), 1, 16)"


@query(
    "content_hash_changes",
    f"""WITH p AS (SELECT DISTINCT source, job_id, {_DIGEST} AS digest FROM raw_postings WHERE description_raw IS NOT NULL), m AS (SELECT source, job_id, CASE WHEN source = 'feed_north' THEN 'old' ELSE digest END AS digest FROM p WHERE source <> 'state_bank')
SELECT source, job_id, digest FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source = p.source AND m.job_id = p.job_id AND m.digest = p.digest)""",
)
def content_hash_changes(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a manifest lacks or holds in another version."""
    p = table(spark, d, "raw_postings").filter("description_raw is not null").select("source", "job_id", C.content_hash(F.col("description_raw")).alias("digest")).distinct()
    m = p.filter("source <> 'state_bank'").withColumn("digest", F.when(F.col("source") == "feed_north", "old").otherwise(F.col("digest")))
    return R.changed_or_missing(p, m, ["source", "job_id"], "digest")


@query(
    "retention_flags",
    f"""WITH p AS (SELECT DISTINCT source, job_id, {_DIGEST} AS digest, CAST(last_seen AS DATE) AS seen, category FROM raw_postings), a AS (SELECT source, job_id, digest FROM p WHERE source <> 'state_bank' AND digest IS NOT NULL), n AS (SELECT source, job_id FROM p WHERE category = 'IT')
SELECT source, job_id, digest, seen, coalesce(seen < DATE '2026-10-11', false) AND EXISTS (SELECT 1 FROM a WHERE a.source = p.source AND a.job_id = p.job_id AND a.digest = p.digest) AND NOT EXISTS (SELECT 1 FROM n WHERE n.source = p.source AND n.job_id = p.job_id) AS "drop" FROM p""",
)
def retention_flags(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("source", "job_id", C.content_hash(F.col("description_raw")).alias("digest"), F.to_date("last_seen").alias("seen"), "category").distinct()
    rows = p.drop("category")
    out = retention.droppable_text(p, keys=["source", "job_id"], digest="digest", age="seen", archived=rows.filter("source <> 'state_bank'"), needed=p.filter("category = 'IT'"), as_of="2026-10-18", days=7)
    return out.select("source", "job_id", "digest", "seen", "drop")


@query("retention_windows", "SELECT CAST(w AS INT) AS window_days, (SELECT count(*) FROM raw_postings WHERE CAST(posted_date AS DATE) < DATE '2026-10-18' - CAST(w AS INT) AND CAST(last_seen AS DATE) < DATE '2026-10-11') AS rows FROM (VALUES (180), (120), (90), (60), (45), (30)) t(w)")
def retention_windows(spark: SparkSession, d: str) -> DataFrame:
    return retention.deletable_counts(table(spark, d, "raw_postings"), posted="posted_date", seen="last_seen", as_of="2026-10-18", windows=[180, 120, 90, 60, 45, 30], idle=7)


_PRESENCE = "SELECT source, trim(job_id) AS job_id, CAST(first_seen AS DATE) AS observed_date, 'first_seen' AS via FROM posting_snapshots UNION ALL SELECT source, trim(job_id), CAST(last_seen AS DATE), 'last_seen' FROM posting_snapshots"


def presence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "posting_snapshots").select("source", F.trim("job_id").alias("job_id"), F.to_date("first_seen").alias("f"), F.to_date("last_seen").alias("l"))
    both = p.select("source", "job_id", F.explode(F.array(F.struct(F.col("f").alias("observed_date"), F.lit("first_seen").alias("via")), F.struct(F.col("l").alias("observed_date"), F.lit("last_seen").alias("via")))).alias("x"))
    return both.select("source", "job_id", "x.observed_date", "x.via").groupBy("source", "job_id", "observed_date").agg(F.min("via").alias("observed_via"))


@query("presence_distinct_on", f"SELECT source, job_id, observed_date, min(via) AS observed_via FROM ({_PRESENCE}) GROUP BY 1, 2, 3")
def presence_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    """One row per posting and observed day; first_seen wins over last_seen."""
    return presence(spark, d)


_HIST = f"WITH p AS (SELECT DISTINCT source, job_id, observed_date FROM ({_PRESENCE})), runs AS (SELECT DISTINCT snapshot_date AS observed_date FROM posting_snapshots), c AS (SELECT p.* FROM p WHERE observed_date IN (SELECT observed_date FROM runs))"


def _complete(spark: SparkSession, d: str) -> DataFrame:
    """Presence on days with a run marker."""
    runs = table(spark, d, "posting_snapshots").select(F.col("snapshot_date").cast("date").alias("observed_date")).distinct()
    return presence(spark, d).join(runs, "observed_date", "left_semi").select("source", "job_id", "observed_date")


@query("history_coverage", _HIST + " SELECT (SELECT count(*) FROM runs) AS measured_days, (SELECT count(DISTINCT observed_date) FROM p) AS panel_days, (SELECT min(observed_date) FROM runs) AS first_measured, (SELECT max(observed_date) FROM runs) AS last_measured, (SELECT count(*) FROM runs) >= 28 AS publishable")
def history_coverage(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "posting_snapshots").agg(F.countDistinct("snapshot_date").alias("measured_days"), F.min(F.col("snapshot_date").cast("date")).alias("first_measured"), F.max(F.col("snapshot_date").cast("date")).alias("last_measured"))
    panel = presence(spark, d).agg(F.countDistinct("observed_date").alias("panel_days"))
    return runs.crossJoin(panel).withColumn("publishable", F.col("measured_days") >= 28)  # one row each


@query("history_daily_roles", _HIST + " SELECT observed_date, source, count(DISTINCT job_id) AS open_roles FROM c GROUP BY 1, 2")
def history_daily_roles(spark: SparkSession, d: str) -> DataFrame:
    return _complete(spark, d).groupBy("observed_date", "source").agg(F.countDistinct("job_id").alias("open_roles"))


@query(
    "history_pace",
    _HIST
    + """, s AS (SELECT source, job_id, min(observed_date) AS f, max(observed_date) AS l, count(*) AS days FROM p GROUP BY 1, 2), z AS (SELECT max(observed_date) AS z FROM runs)
SELECT source, count(*) AS postings, min(f) AS first_observed, max(l) AS last_observed, median(date_diff('day', f, l)) FILTER (WHERE l < z) AS median_days_open, round(avg(CASE WHEN l < z THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS closed_share FROM s, z GROUP BY 1 HAVING count(*) >= 8""",
)
def history_pace(spark: SparkSession, d: str) -> DataFrame:
    """Days open are measured on closed postings only."""
    s = presence(spark, d).groupBy("source", "job_id").agg(F.min("observed_date").alias("f"), F.max("observed_date").alias("l"))
    z = table(spark, d, "posting_snapshots").agg(F.max(F.col("snapshot_date").cast("date")).alias("z"))
    s = s.crossJoin(F.broadcast(z)).withColumn("closed", F.col("l") < F.col("z"))  # one row
    g = s.groupBy("source").agg(
        F.count("*").alias("postings"), F.min("f").alias("first_observed"), F.max("l").alias("last_observed"),
        F.median(F.when(F.col("closed"), F.datediff("l", "f"))).alias("median_days_open"), F.round(F.avg(F.col("closed").cast("double")), 4).alias("closed_share"),
    )
    return g.filter("postings >= 8")


@query("history_tech_daily", _HIST + " SELECT observed_date, lower(trim(tech_slug)) AS tech_slug, count(DISTINCT (c.source, c.job_id)) AS postings FROM c JOIN posting_technologies t ON t.source = c.source AND t.job_id = c.job_id WHERE trim(coalesce(tech_slug, '')) <> '' GROUP BY 1, 2")
def history_tech_daily(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "posting_technologies").select("source", "job_id", C.blank_to_null(F.lower("tech_slug")).alias("tech_slug")).filter("tech_slug is not null").distinct()
    return _complete(spark, d).join(t, ["source", "job_id"]).groupBy("observed_date", "tech_slug").agg(F.count("*").alias("postings"))


@query("presence_partitions", f"SELECT observed_date, count(*) AS n FROM (SELECT DISTINCT source, job_id, observed_date FROM ({_PRESENCE}) WHERE observed_date IN (SELECT CAST(snapshot_date AS DATE) FROM posting_snapshots)) GROUP BY 1")
def presence_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Daily partitions written twice: dynamic overwrite replaces the days that a write names, and nothing else."""
    path = new_path(spark, "presence")
    rows = _complete(spark, d).repartition("observed_date")
    for _ in range(2):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("observed_date").parquet(path)
    return spark.read.parquet(path).groupBy("observed_date").agg(F.count("*").alias("n"))


@query(
    "eval_diff",
    """WITH a AS (SELECT company_name AS k, employer_key AS e FROM company_employer_key WHERE match_type = 'exact'), b AS (SELECT company_name AS k, employer_key AS e FROM company_employer_key WHERE employer_key IS NOT NULL AND match_type <> 'prefix_weak')
SELECT coalesce(a.k, b.k) AS k, a.e AS old, b.e AS new, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'gone' WHEN a.e = b.e THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k""",
)
def eval_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two runs side by side."""
    k = table(spark, d, "company_employer_key")
    a = k.filter("match_type = 'exact'").select(F.col("company_name").alias("k"), F.struct("employer_key").alias("a"))
    b = k.filter("employer_key is not null and match_type <> 'prefix_weak'").select(F.col("company_name").alias("k"), F.struct("employer_key").alias("b"))
    status = C.ladder([(F.col("a").isNull(), "new"), (F.col("b").isNull(), "gone"), (F.col("a") == F.col("b"), "same")], "changed")
    return a.join(b, "k", "full").select("k", F.col("a.employer_key").alias("old"), F.col("b.employer_key").alias("new"), status.alias("status"))


@query(
    "review_queue",
    """WITH l AS (SELECT * FROM dol_employer_summary QUALIFY row_number() OVER (PARTITION BY employer_key ORDER BY fiscal_year DESC, filings DESC, employer_name) = 1), p AS (SELECT company_name, count(*) AS postings, count(*) FILTER (WHERE category = 'IT') AS it FROM raw_postings GROUP BY 1)
SELECT k.company_name, k.employer_key, p.postings, p.it, l.fiscal_year, l.filings FROM company_employer_key k LEFT JOIN p ON p.company_name = k.company_name LEFT JOIN l ON l.employer_key = k.employer_key
WHERE k.match_type IN ('prefix_weak', 'prefix_ambiguous') AND NOT EXISTS (SELECT 1 FROM company_employer_key x WHERE x.employer_key = k.employer_key AND x.match_type = 'exact')""",
)
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Undecided pairs that no sure match settles, with evidence of both sides."""
    k = table(spark, d, "company_employer_key")
    e = table(spark, d, "dol_employer_summary").select("employer_key", "fiscal_year", "filings", "employer_name").filter("employer_key is not null")
    l = R.first_per_key(e, ["employer_key"], [F.col("fiscal_year").desc(), F.col("filings").desc_nulls_last(), F.col("employer_name").asc_nulls_last()]).drop("employer_name")
    p = table(spark, d, "raw_postings").groupBy("company_name").agg(F.count("*").alias("postings"), F.count(F.when(F.col("category") == "IT", 1)).alias("it"))
    open_ = k.filter(F.col("match_type").isin("prefix_weak", "prefix_ambiguous")).join(k.filter("match_type = 'exact'").select("employer_key").distinct(), "employer_key", "left_anti")
    return open_.join(p, "company_name", "left").join(l, "employer_key", "left").select("company_name", "employer_key", "postings", "it", "fiscal_year", "filings")
