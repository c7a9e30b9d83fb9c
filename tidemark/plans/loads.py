"""Loads: files of several shapes, merge rules, incremental appends, retention, archive, streams that resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.functions import text as X
from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators import retention
from tidemark.plans.registry import query
from tidemark.session import new_path
from tidemark.sources import documents as D
from tidemark.sources.tables import csv_table, dataset_or_empty, table
from tidemark.streaming import events as E


@query("history_or_empty", "SELECT source, count(*) AS n FROM raw_postings WHERE country = 'us' GROUP BY 1")
def history_or_empty(spark: SparkSession, d: str) -> DataFrame:
    """A Hive-partitioned dataset beside one that was never written, which is an empty table of the same schema."""
    path = new_path(spark, "history")
    D.export(table(spark, d, "raw_postings").select("source", "job_id", "country"), path, source=F.col("source"))
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("country", T.StringType()), T.StructField("source", T.StringType())])
    both = dataset_or_empty(spark, path, schema).unionByName(dataset_or_empty(spark, path + "-never-written", schema))
    return both.filter("country = 'us'").groupBy("source").agg(F.count("*").alias("n"))


@query("wide_csv_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def wide_csv_columns(spark: SparkSession, d: str) -> DataFrame:
    """A few columns of a wide file with a header, by name; the others are not parsed."""
    path = new_path(spark, "wide")
    l = table(spark, d, "lineitem")
    l.write.option("header", True).csv(path)
    return csv_table(spark, path, l.schema).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("vocabulary_seed", "SELECT category, count(DISTINCT p.source || p.job_id) AS postings FROM technologies t JOIN posting_technologies p ON lower(trim(p.tech_slug)) = t.tech_slug GROUP BY 1")
def vocabulary_seed(spark: SparkSession, d: str) -> DataFrame:
    """A seed vocabulary from CSV, joined to the postings."""
    path = new_path(spark, "seed")
    t = table(spark, d, "technologies").select("tech_slug", "category")
    t.write.option("header", True).csv(path)
    p = table(spark, d, "posting_technologies").select(F.lower(F.trim("tech_slug")).alias("tech_slug"), "source", "job_id")
    seed = csv_table(spark, path, t.schema)
    return p.join(seed, "tech_slug").select("category", "source", "job_id").distinct().groupBy("category").agg(F.count("*").alias("postings"))


_NORM = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(upper({0}), '[.,]', ' ', 'g'), '\\b(?:" + "|".join(C.LEGAL_WORDS) + ")\\b', ' ', 'g'), '[^A-Z0-9&]+', ' ', 'g')), '')"


@query(
    "employer_mapping",
    f"""
WITH c AS (SELECT company_name, employer_key, CASE match_type WHEN 'exact' THEN 'accept' WHEN 'prefix_ambiguous' THEN 'reject' END AS verdict FROM company_employer_key WHERE match_type IN ('exact', 'prefix_ambiguous')),
k AS (SELECT DISTINCT {_NORM.format('company_name')} AS company FROM raw_postings), e AS (SELECT DISTINCT employer_key AS employer FROM dol_employer_summary WHERE employer_key IS NOT NULL),
al AS (SELECT {_NORM.format('company_name')} AS company, min(employer_key) AS employer FROM c WHERE verdict = 'accept' AND employer_key IN (SELECT employer FROM e) GROUP BY 1),
rj AS (SELECT DISTINCT {_NORM.format('company_name')} AS company, employer_key AS employer FROM c WHERE verdict = 'reject' AND employer_key IS NOT NULL),
a AS (SELECT company, employer, company = employer AS exact FROM k JOIN e ON company = employer OR (length(company) >= 8 AND starts_with(employer, company || ' ')) WHERE (company, employer) NOT IN (SELECT company, employer FROM rj)),
m AS (SELECT company, bool_or(exact) AS exact, count(*) AS n, min(employer) FILTER (exact) AS x, min(employer) AS one FROM a GROUP BY 1)
SELECT k.company, CASE WHEN al.employer IS NOT NULL THEN al.employer WHEN exact THEN x WHEN n = 1 THEN one END AS employer,
 CASE WHEN al.employer IS NOT NULL THEN 'alias' WHEN exact THEN 'exact' WHEN n > 1 THEN 'prefix_ambiguous' WHEN n = 1 AND contains(k.company, ' ') THEN 'prefix_strong' WHEN n = 1 THEN 'prefix_weak' END AS match_type
FROM k LEFT JOIN al ON al.company = k.company LEFT JOIN m ON m.company = k.company WHERE k.company IS NOT NULL""",
)
def employer_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Levels alias, exact, prefix and none; a CSV of decisions gives the aliases (accept) and takes pairs out (reject)."""
    path = new_path(spark, "decisions")
    verdict = F.when(F.col("match_type") == "exact", "accept").when(F.col("match_type") == "prefix_ambiguous", "reject")
    c = table(spark, d, "company_employer_key").select("company_name", "employer_key", verdict.alias("verdict")).filter("verdict is not null")
    c.write.option("header", True).csv(path)
    decided = csv_table(spark, path, c.schema).select(C.normalise_employer(F.col("company_name")).alias("company"), F.col("employer_key").alias("employer"), "verdict").filter("employer is not null")
    k = table(spark, d, "raw_postings").select(C.normalise_employer(F.col("company_name")).alias("company")).filter("company is not null").distinct()
    e = table(spark, d, "dol_employer_summary").select(F.col("employer_key").alias("employer")).filter("employer is not null").distinct()
    alias = decided.filter("verdict = 'accept'").join(e, "employer", "left_semi").groupBy("company").agg(F.min("employer").alias("alias"))
    found = R.prefix_matches(k, e, key="company", name="employer").join(decided.filter("verdict = 'reject'").select("company", "employer"), ["company", "employer"], "left_anti")
    m = found.groupBy("company").agg(F.max("exact").alias("exact"), F.count("*").alias("n"), F.min(F.when(F.col("exact"), F.col("employer"))).alias("x"), F.min("employer").alias("one"))
    has = F.col("alias").isNotNull()
    kind = F.when(has, "alias").when(F.col("exact"), "exact").when(F.col("n") > 1, "prefix_ambiguous").when((F.col("n") == 1) & F.col("company").contains(" "), "prefix_strong").when(F.col("n") == 1, "prefix_weak")
    employer = F.when(has, F.col("alias")).when(F.col("exact"), F.col("x")).when(F.col("n") == 1, F.col("one"))
    return k.join(alias, "company", "left").join(m, "company", "left").select("company", employer.alias("employer"), kind.alias("match_type"))


@query("board_documents", "SELECT source, 'b-' || source || ':' || job_id AS job_id, job_title, location_state, strftime(ingested_at, '%Y-%m-%d %H:%M:%S') AS loaded FROM raw_postings WHERE location_state IN (SELECT state FROM ref_locations WHERE country_code = 'US')")
def board_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of boards: the key is board and id, there are no salaries, and the state is read off the location."""
    path = new_path(spark, "boards")
    states = table(spark, d, "ref_locations").filter("country_code = 'US'").select(F.col("state").alias("location_state")).distinct()
    p = table(spark, d, "raw_postings").join(F.broadcast(states), "location_state", "left_semi").withColumn("location", F.concat(F.lit("Somewhere, "), "location_state"))  # states of a country
    D.to_board_documents(p, F.concat(F.lit("b-"), "source")).write.json(path)
    b = D.read_board_postings(spark, path)
    assert {"salary_min", "salary_max"} <= set(b.columns)
    return b.filter("salary_min is null and country = 'us'").select("source", "job_id", "job_title", "location_state", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("loaded"))


@query("keyed_layout", "SELECT source, country, strftime(ingested_at, '%Y-%m-%d') AS ingest_date, count(*) AS n FROM raw_postings WHERE source = 'feed_north' AND country = 'us' AND strftime(ingested_at, '%Y-%m-%d') >= '2026-10-01' GROUP BY 1, 2, 3")
def keyed_layout(spark: SparkSession, d: str) -> DataFrame:
    """source=/country=/ingest_date= folders; a filter on them reads only the folders it names."""
    path = new_path(spark, "layout")
    p = table(spark, d, "raw_postings").select("source", "country", "job_id", "ingested_at")
    D.export(p, path, source=F.col("source"), country=F.col("country"), ingest_date=F.date_format("ingested_at", "yyyy-MM-dd"))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("job_id", "source", "country", "ingest_date")])
    part = spark.read.schema(schema).parquet(path).filter("source = 'feed_north' and country = 'us' and ingest_date >= '2026-10-01'")
    return part.groupBy("source", "country", "ingest_date").agg(F.count("*").alias("n"))


@query("run_stamped_log", "SELECT 'run-1' AS run, source, count(*) AS n FROM raw_postings WHERE country = 'us' GROUP BY 2 UNION ALL SELECT 'run-2', source, count(*) FROM raw_postings GROUP BY 2")
def run_stamped_log(spark: SparkSession, d: str) -> DataFrame:
    """Objects stamped with their run are added and never overwritten: a second write of a run is an error."""
    path = new_path(spark, "log")
    p = table(spark, d, "raw_postings").select("source", "job_id", "country")
    D.append_run(p.filter("country = 'us'"), path, "run-1")
    D.append_run(p, path, "run-2")
    try:
        D.append_run(p, path, "run-1")
        raise AssertionError("a run was written twice")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return spark.read.option("basePath", path).parquet(path).groupBy("run", "source").agg(F.count("*").alias("n"))


@query("warehouse_json", "SELECT source, count(*) AS n, round(sum(salary_max), 0) AS salaries, max(strftime(posted_date, '%Y-%m-%d')) AS last_day FROM raw_postings GROUP BY 1")
def warehouse_json(spark: SparkSession, d: str) -> DataFrame:
    """Export as JSON lines: decimals as doubles, dates as ISO text; a required result without rows is an error, an
    optional one is an empty file. The file is read back and summed up."""
    path = new_path(spark, "export-json")
    p = Q.require_rows(table(spark, d, "raw_postings"), "postings").select("source", F.col("salary_max").cast("decimal(12,2)").alias("salary_max"), F.to_date("posted_date").alias("posted"))
    D.export_json(p, path)
    D.export_json(p.filter("false"), path + "-optional")
    schema = "source string, salary_max double, posted string"
    back = spark.read.schema(schema).json(path).unionByName(spark.read.schema(schema).json(path + "-optional"))
    return back.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("salary_max"), 0).alias("salaries"), F.max("posted").alias("last_day"))


@query(
    "merge_rules",
    f"""WITH e AS (SELECT * FROM raw_postings QUALIFY row_number() OVER (PARTITION BY source, job_id ORDER BY ingested_at DESC, description_raw DESC) = 1),
i AS (SELECT source, job_id, CASE WHEN country = 'ca' THEN NULL WHEN category = 'IT' THEN 'We cannot sponsor visas. New text.' ELSE description_raw END AS d, job_title || ' II' AS t FROM e WHERE source <> 'feed_north')
SELECT e.source, e.job_id, CASE WHEN i.source IS NULL THEN e.job_title ELSE i.t END AS job_title, CASE WHEN i.source IS NULL THEN md5(description_raw) WHEN e.description_dropped_at IS NOT NULL THEN NULL ELSE md5(i.d) END AS text_md5,
 CASE WHEN i.source IS NULL THEN e.refuses_sponsorship ELSE {"(" + " OR ".join(f"regexp_matches(i.d, '{p}', 'i')" for p in X.REFUSES) + ")"} END AS refuses, coalesce(e.category, 'unknown') AS category FROM e LEFT JOIN i ON i.source = e.source AND i.job_id = e.job_id""",
)
def merge_rules(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each column of a merge: text that was dropped stays out, titles are replaced, verdicts come from the
    incoming text even where the text itself is not kept, and nulls alone are filled afterwards."""
    cols = ["source", "job_id", "job_title", "description_raw", "description_dropped_at", "refuses_sponsorship", "category", "country", "ingested_at"]
    e = R.first_per_key(table(spark, d, "raw_postings").select(*cols), ["source", "job_id"], [F.col("ingested_at").desc(), F.col("description_raw").desc()])
    text = F.when(F.col("country") == "ca", F.lit(None)).when(F.col("category") == "IT", "We cannot sponsor visas. New text.").otherwise(F.col("description_raw"))
    i = e.filter("source <> 'feed_north'").withColumns({"description_raw": text, "job_title": F.concat("job_title", F.lit(" II"))})
    out = R.merge(
        e, i, keys=["source", "job_id"],
        rules={
            "description_raw": lambda old, new: F.when(old["description_dropped_at"].isNull(), new["description_raw"]),
            "job_title": lambda old, new: new["job_title"],
            "refuses_sponsorship": lambda old, new: X.any_of(new["description_raw"], X.REFUSES),
        },
    )
    out = R.backfill(out, {"category": F.lit("unknown")})
    return out.select("source", "job_id", "job_title", F.md5("description_raw").alias("text_md5"), F.col("refuses_sponsorship").alias("refuses"), "category")


@query("counter_events", "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS runs, greatest(count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'error'), 0) AS open FROM events GROUP BY 1")
def counter_events(spark: SparkSession, d: str) -> DataFrame:
    """Counters as sums over a log of events, not below 0."""
    n = lambda k: F.count_if(F.col("event_type") == k)
    return table(spark, d, "events").groupBy("user_id").agg(n("purchase").alias("runs"), F.greatest(n("purchase") - n("error"), F.lit(0)).alias("open"))


@query("incremental_append", "SELECT event_id, event_type FROM events")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """Three loads of a growing source: each adds what is later than the target's greatest time, the first to an empty one."""
    path = new_path(spark, "incremental")
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    days = e.select(F.expr("percentile_approx(cast(ts as timestamp), array(0.3, 0.7), 1000)").alias("c")).first().c
    for upto in [*days, None]:
        source = e if upto is None else e.filter(F.col("ts") <= F.lit(upto))
        R.append_later(source, path, "ts")
    return spark.read.parquet(path).select("event_id", "event_type")


@query("full_replace", "SELECT employer_key, count(*) AS names FROM company_employer_key WHERE match_type = 'exact' GROUP BY 1")
def full_replace(spark: SparkSession, d: str) -> DataFrame:
    """A mapping table is written whole each time, beside the old one; readers see one or the other."""
    k = table(spark, d, "company_employer_key")
    path = new_path(spark, "mapping")
    D.replace_whole(k, path)
    D.replace_whole(k.filter("match_type = 'exact'"), path)
    return D.read_current(spark, path).groupBy("employer_key").agg(F.count("*").alias("names"))


_DEL = "CAST(posted_date AS DATE) < DATE '2026-10-18' - CAST(w AS INT) AND CAST(last_seen AS DATE) < DATE '2026-10-11'"


@query(
    "retention_delete",
    f"""WITH n AS (SELECT count(*) AS n FROM raw_postings), c AS (SELECT w, (SELECT count(*) FROM raw_postings WHERE {_DEL}) AS gone FROM (VALUES (180), (120), (90), (60), (45), (30)) t(w)),
p AS (SELECT coalesce(max(w) FILTER (n - gone <= 0.9 * n), 30) AS w FROM c, n) SELECT source, CAST(w AS INT) AS window_days, count(*) AS kept FROM raw_postings, p WHERE NOT coalesce({_DEL}, false) GROUP BY 1, 2""",
)
def retention_delete(spark: SparkSession, d: str) -> DataFrame:
    """The longest window that leaves at most nine tenths of the rows, or the shortest there is, is applied."""
    p = table(spark, d, "raw_postings")
    kept, window = retention.delete_to_size(p, posted="posted_date", seen="last_seen", as_of="2026-10-18", windows=[180, 120, 90, 60, 45, 30], idle=7, share=0.9)
    return kept.groupBy("source").agg(F.count("*").alias("kept")).withColumn("window_days", F.lit(window))


@query("expired_reset", "SELECT source, job_id, CASE WHEN coalesce(last_seen < TIMESTAMP '2026-10-01', true) THEN 'new' ELSE category END AS state FROM raw_postings")
def expired_reset(spark: SparkSession, d: str) -> DataFrame:
    """Rows past their time go back to where they began; a row without a time is past it."""
    expired = F.coalesce(F.col("last_seen") < F.lit("2026-10-01").cast("timestamp"), F.lit(True))
    return table(spark, d, "raw_postings").select("source", "job_id", F.when(expired, "new").otherwise(F.col("category")).alias("state"))


@query("values_join", "SELECT s.source, s.job_id, job_title FROM (VALUES ('feed_north', 'nothing'), ('company_board', 'x')) v(source, job_id) JOIN raw_postings s ON s.source = v.source AND s.job_id = v.job_id UNION ALL SELECT source, job_id, job_title FROM raw_postings WHERE (source, job_id) IN (SELECT source, min(job_id) FROM raw_postings GROUP BY 1)")
def values_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a batch of keys held by the caller."""
    p = table(spark, d, "raw_postings").select("source", "job_id", "job_title")
    keys = [(r.source, r.job_id) for r in p.groupBy("source").agg(F.min("job_id").alias("job_id")).collect()]  # a row per source
    batch = spark.createDataFrame([*keys, ("feed_north", "nothing"), ("company_board", "x")], "source string, job_id string")
    return p.join(F.broadcast(batch), ["source", "job_id"])  # a batch that the caller holds


@query(
    "archive_day",
    """WITH p AS (SELECT DISTINCT source, job_id, CAST(last_seen AS DATE) AS day, job_title, company_name, md5(description_raw) AS digest FROM raw_postings WHERE last_seen IS NOT NULL)
SELECT 'presence' AS kind, day, count(DISTINCT (source, job_id)) AS n FROM p GROUP BY 2 UNION ALL SELECT 'attributes', day, count(DISTINCT (source, job_id, job_title, company_name)) FROM p GROUP BY 2
UNION ALL SELECT 'texts', min(day), 1 FROM p WHERE digest IS NOT NULL GROUP BY source, job_id, digest UNION ALL SELECT 'run', day, 1 FROM p GROUP BY 2""",
)
def archive_day(spark: SparkSession, d: str) -> DataFrame:
    """Archive of each day: presence, attributes, texts not archived under the same digest yet, and a marker of the run,
    written last. Folders of a day are replaced whole."""
    path = new_path(spark, "archive")
    p = table(spark, d, "raw_postings").filter("last_seen is not null").select("source", "job_id", F.to_date("last_seen").alias("day"), "job_title", "company_name", F.md5("description_raw").alias("digest"))
    write = lambda df, name: df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")
    write(p.select("source", "job_id", "day").distinct(), "presence")
    write(p.drop("digest").distinct(), "attributes")
    write(p.filter("digest is not null").groupBy("source", "job_id", "digest").agg(F.min("day").alias("day")), "texts")
    write(p.select("day", F.lit(1).alias("done")).distinct(), "run")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    n = lambda name: read(name).groupBy("day").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "day", "n")
    texts = read("texts").select(F.lit("texts").alias("kind"), "day", F.lit(1).cast("long").alias("n"))
    return n("presence").unionByName(n("attributes")).unionByName(texts).unionByName(n("run"))


# --- streams that keep their place


def _deliver(spark: SparkSession, d: str, path: str, what: str = "true") -> None:
    table(spark, d, "events").filter(what).write.mode("append").parquet(path)


@query("stream_resume", "SELECT CAST(event_id % 1 AS INT) AS zero, event_type, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT 1, 'alerts after a third run without new files', 0")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    """A named stream run again keeps its mark: the second run reads the files that came since, the third none. Clicks
    and views come before the first run, all other events before the second."""
    path, out = new_path(spark, "feed"), new_path(spark, "resumed")
    counts = []
    for k in range(3):
        if k < 2:
            _deliver(spark, d, path, "event_type in ('click', 'view')" if k == 0 else "coalesce(event_type not in ('click', 'view'), true)")
        counts.append(E.resume(E.read_events(spark, path), out).count())
    third = spark.createDataFrame([(1, "alerts after a third run without new files", counts[2] - counts[1])], "zero int, event_type string, n long")
    rows = spark.read.parquet(f"{out}/data")
    return rows.groupBy(F.lit(0).alias("zero"), "event_type").agg(F.count("*").alias("n")).unionByName(third)


@query("stream_replay", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY 1")
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """The last ten days are read again under a mark of their own; the stream's own mark does not move."""
    path, out = new_path(spark, "feed"), new_path(spark, "resumed")
    _deliver(spark, d, path)
    first = E.resume(E.read_events(spark, path), out).count()
    since = spark.read.parquet(path).agg((F.max(F.col("ts").cast("timestamp")) - F.expr("interval 10 days")).alias("t")).first().t
    again = E.replay(E.read_events(spark, path), "ts", since)
    assert E.resume(E.read_events(spark, path), out).count() == first
    return again.groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_keyed_sink", "SELECT event_type || ':' || user_id AS key, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY 1")
def stream_keyed_sink(spark: SparkSession, d: str) -> DataFrame:
    """Keyed records in a log with one folder a key hash: all records of a key lie in one place, in order of arrival, as a
    partition of a topic would hold them. Two watch rounds, the second finding nothing new."""
    path = new_path(spark, "feed")
    _deliver(spark, d, path)
    log = E.watch(lambda: E.keyed(E.read_events(spark, path), F.concat_ws(":", "event_type", F.col("user_id").cast("string")), 4), new_path(spark, "topic"), rounds=2)
    r = log.groupBy("key").agg(F.count("*").alias("n"), F.max(F.get_json_object("value", "$.event_id").cast("long")).alias("last"), F.countDistinct("slot").alias("slots"))
    return r.filter("slots = 1").select("key", "n", "last")
