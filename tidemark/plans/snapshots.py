"""p1: what changed between the deliveries of posting_snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshot_diff import snapshot_diff
from tidemark.plans.registry import query
from tidemark.sources.tables import table

COMPARED = ["country", "company_name", "job_title", "location", "location_state", "posted_date", "salary_min", "salary_max", "salary_is_predicted", "category"]

_STATES = f"""
WITH state AS (
  SELECT snapshot_no, source, trim(job_id) AS job_id, {", ".join(COMPARED)}
  FROM posting_snapshots
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, source, trim(job_id) ORDER BY last_seen DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1),
pair AS (
  SELECT coalesce(c.snapshot_no, p.snapshot_no + 1) AS snapshot_no, coalesce(c.source, p.source) AS source, coalesce(c.job_id, p.job_id) AS job_id,
    CASE WHEN p.snapshot_no IS NULL THEN 'added' WHEN c.snapshot_no IS NULL THEN 'removed'
         WHEN {" OR ".join(f"c.{x} IS DISTINCT FROM p.{x}" for x in COMPARED)} THEN 'changed' END AS change
  FROM state c FULL JOIN state p ON c.snapshot_no = p.snapshot_no + 1 AND c.source = p.source AND c.job_id = p.job_id)
"""
_RANGE = "change IS NOT NULL AND snapshot_no BETWEEN (SELECT min(snapshot_no) + 1 FROM posting_snapshots) AND (SELECT max(snapshot_no) FROM posting_snapshots)"


def _diff(spark: SparkSession, d: str, values: bool) -> DataFrame:
    return snapshot_diff(
        table(spark, d, "posting_snapshots"),
        snapshot="snapshot_no",
        keys={"source": F.col("source"), "job_id": F.trim("job_id")},
        compare=COMPARED,
        latest_by=["last_seen", "ingested_at"],
        values=values,
    )


@query("p1_found", _STATES + f"SELECT snapshot_no, source, job_id, change FROM pair WHERE {_RANGE}")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _diff(spark, d, values=False)


@query("p1_change_report", _STATES + f"SELECT snapshot_no, source, change, count(*) AS postings FROM pair WHERE {_RANGE} GROUP BY 1, 2, 3")
def p1_change_report(spark: SparkSession, d: str) -> DataFrame:
    """Changes per delivery, source and kind."""
    return _diff(spark, d, values=False).groupBy("snapshot_no", "source", "change").agg(F.count("*").alias("postings"))
