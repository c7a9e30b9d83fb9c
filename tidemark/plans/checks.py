"""Quality report over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_SQL = """
SELECT 'not_null source' AS "check", count(*) AS failures, count(*) = 0 AS ok FROM raw_postings WHERE source IS NULL
UNION ALL SELECT 'unique source job_id', count(*), count(*) = 0 FROM (SELECT 1 FROM raw_postings GROUP BY source, job_id HAVING count(*) > 1)
UNION ALL SELECT 'accepted country', count(*), count(*) = 0 FROM raw_postings WHERE country NOT IN ('us', 'ca')
UNION ALL SELECT 'in_range salary_max', count(*), count(*) = 0 FROM raw_postings WHERE salary_max NOT BETWEEN 20000 AND 1000000
UNION ALL SELECT 'related tech_slug', count(*), count(*) = 0 FROM posting_technologies WHERE tech_slug IS NOT NULL AND tech_slug NOT IN (SELECT tech_slug FROM technologies)
UNION ALL SELECT 'salary order', count(*), count(*) = 0 FROM raw_postings WHERE salary_min > salary_max
UNION ALL SELECT 'no future dates', count(*), count(*) = 0 FROM raw_postings WHERE posted_date > first_seen
UNION ALL SELECT 'volume', greatest(1000 - count(*), 0), count(*) >= 1000 FROM raw_postings
UNION ALL SELECT 'drift', CAST(abs(b - a) * 100.0 / a > 20 AS BIGINT), abs(b - a) * 100.0 / a <= 20 FROM (SELECT count(*) FILTER (WHERE snapshot_no = (SELECT min(snapshot_no) FROM posting_snapshots)) AS a, count(*) FILTER (WHERE snapshot_no = (SELECT max(snapshot_no) FROM posting_snapshots)) AS b FROM posting_snapshots)
"""


@query("quality_report", _SQL)
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    p, s = table(spark, d, "raw_postings"), table(spark, d, "posting_snapshots")
    first, last = s.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    ordered = F.coalesce(F.col("salary_min") <= F.col("salary_max"), F.lit(True))
    dated = F.coalesce(F.col("posted_date") <= F.col("first_seen"), F.lit(True))
    return Q.report(
        [
            Q.not_null(p, "source"), Q.unique(p, ["source", "job_id"]), Q.accepted(p, "country", ["us", "ca"]), Q.in_range(p, "salary_max", 20000, 1000000),
            Q.related(table(spark, d, "posting_technologies"), "tech_slug", table(spark, d, "technologies"), "tech_slug"),
            Q.holds(p, "salary order", ordered), Q.holds(p, "no future dates", dated), Q.at_least(p, "volume", 1000),
            Q.drift(s.filter(F.col("snapshot_no") == first), s.filter(F.col("snapshot_no") == last), "drift", 20),
        ]
    )
