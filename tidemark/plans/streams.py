"""Stream queries, each with a batch statement of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.streaming.events import insert_absent, read_events, run_to_table, scored


@query(
    "stream_alerts",
    """WITH s AS (SELECT event_id, user_id, event_type, c_mktsegment AS segment, CASE WHEN event_type = 'purchase' THEN 30 ELSE 0 END + CASE WHEN value > 50 THEN 20 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 20 ELSE 0 END + CASE WHEN event_type = 'error' THEN -40 ELSE 0 END AS score,
 concat_ws('; ', CASE WHEN event_type = 'purchase' THEN 'purchase' END, CASE WHEN value > 50 THEN 'large' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN event_type = 'error' THEN 'error' END) AS reason FROM events LEFT JOIN customer ON c_custkey = user_id)
SELECT event_id, user_id, CAST(score AS INT) AS score, reason FROM s WHERE score >= 40""",
)
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Stream joined to a static table, scored, above a threshold, inserted if absent."""
    e = read_events(spark, f"{d}/events.parquet").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("user_id") == F.col("c_custkey"), "left")
    rules = [
        ("purchase", F.col("event_type") == "purchase", F.lit(30)), ("large", F.col("value") > 50, F.lit(20)),
        ("segment", F.col("c_mktsegment") == "BUILDING", F.lit(20)), ("error", F.col("event_type") == "error", F.lit(-40)),
    ]
    return run_to_table(scored(e, rules, 40).select("event_id", "user_id", "score", "reason"), "alerts", insert_absent(["event_id"]))


@query("stream_tumbling", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    e = read_events(spark, f"{d}/events.parquet").withWatermark("ts", "1 day")
    w = e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return run_to_table(w.select(F.to_date("window.start").alias("day"), "event_type", "n"), "tumbling", mode="complete")


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, count(*) AS n, count(DISTINCT s) AS sessions FROM s GROUP BY 1""",
)
def stream_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user end after 30 idle minutes."""
    e = read_events(spark, f"{d}/events.parquet").withWatermark("ts", "1 day")
    s = e.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    done = run_to_table(s.select("user_id", F.col("w.start").alias("start"), "n"), "sessions", mode="complete")
    return done.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"))


@query("stream_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes twice and counts once; dropDuplicatesWithinWatermark keeps state for a bounded time only."""
    e = read_events(spark, f"{d}/events.parquet")
    twice = e.select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    one = twice.withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    return run_to_table(one.select("event_id", "event_type"), "dedup").groupBy("event_type").agg(F.count("*").alias("n"))
