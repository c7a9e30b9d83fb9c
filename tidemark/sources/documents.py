"""JSON documents of postings, partitioned exports, mirrors and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import place

AGGREGATOR = """_meta struct<source: string, country: string, ingested_at: string>, results array<struct<id: string, title: string, company: struct<display_name: string>,
 location: struct<display_name: string, area: array<string>>, salary_min: string, salary_max: string, salary_is_predicted: string, description: string>>"""


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of documents {_meta, results[]}; any level may be missing, numbers that are none are null, and
    'salary_is_predicted' is true for '1', false for another value, null if missing. The second area is the state."""
    d = spark.read.schema(AGGREGATOR).json(path)
    r = d.select("_meta.*", F.explode("results").alias("r"))
    return r.select(
        "source", F.col("r.id").alias("job_id"), "country", F.col("r.company.display_name").alias("company_name"), F.col("r.title").alias("job_title"), F.col("r.location.display_name").alias("location"),
        F.get("r.location.area", F.lit(1)).alias("location_state"), F.col("r.salary_min").try_cast("double").alias("salary_min"), F.col("r.salary_max").try_cast("double").alias("salary_max"),
        (F.col("r.salary_is_predicted") == "1").alias("salary_is_predicted"), F.col("ingested_at").try_cast("timestamp").alias("ingested_at"),
    )


def to_documents(rows: DataFrame, size: int = 500) -> DataFrame:
    """The reverse of read_postings: documents of about `size` rows that share a source, country and load, by hashed ids."""
    meta = ["source", "country", "ingested_at"]
    n = rows.groupBy(*meta).agg(F.ceil(F.count("*") / size).alias("_n")).select(F.struct(*meta).alias("_m"), "_n")
    rows = rows.join(n, F.struct(*meta).eqNullSafe(F.col("_m")))
    block = F.pmod(F.xxhash64("job_id"), F.col("_n")).alias("block")
    r = F.struct(
        F.col("job_id").alias("id"), F.col("job_title").alias("title"), F.struct(F.col("company_name").alias("display_name")).alias("company"),
        F.struct(F.col("location").alias("display_name"), F.array(F.col("country"), F.col("location_state")).alias("area")).alias("location"),
        F.col("salary_min").cast("string").alias("salary_min"), F.coalesce(F.col("salary_max").cast("string"), F.lit("negotiable")).alias("salary_max"),
        F.when(F.col("salary_is_predicted"), "1").when(~F.col("salary_is_predicted"), "0").alias("salary_is_predicted"),
    )
    meta = F.struct("source", "country", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at")).alias("_meta")
    return rows.groupBy(meta, block).agg(F.collect_list(r).alias("results")).drop("block")


def export(rows: DataFrame, path: str, **partitions: Column) -> None:
    """Write partitioned by the given expressions; partitions that the rows name are replaced, others stay."""
    rows = rows.withColumns(partitions)
    rows.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def missing_partitions(wanted: DataFrame, spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Rows of wanted whose partition the dataset does not have; a dataset that is not there has none."""
    try:
        have = spark.read.parquet(path).select(*[F.col(c).cast("string").alias(c) for c in columns]).distinct()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return wanted
    return wanted.join(have, list(columns), "left_anti")


def mirror(rows: DataFrame) -> DataFrame:
    """Complex columns as JSON text, timestamps as text to the microsecond, decimals as doubles."""
    out = []
    for f in rows.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith(("array", "struct", "map")):
            c = F.to_json(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return rows.select(*out)


def keyset_page(rows: DataFrame, keys: Sequence[str], after: Sequence | None, size: int) -> DataFrame:
    """The next `size` rows in key order after a key; a page is the feature."""
    if after is not None:
        rows = rows.filter(F.struct(*keys) > F.struct(*[F.lit(v) for v in after]))
    return rows.orderBy(*keys).limit(size)


BOARD = "_meta struct<source: string, board: string, ingested_at: string>, results array<struct<id: string, title: string, location: string>>"


def read_board_postings(spark: SparkSession, path: str) -> DataFrame:
    """Flat rows of documents of boards: job_id is 'board:id', salaries are null, country and state are read off the
    location. Any level may be missing."""
    r = spark.read.schema(BOARD).json(path).select("_meta.*", F.explode("results").alias("r")).withColumn("p", place(F.col("r.location")))
    none = F.lit(None).cast("double")
    return r.select(
        "source", F.concat_ws(":", "board", "r.id").alias("job_id"), "p.country", F.col("r.title").alias("job_title"), F.col("r.location").alias("location"), F.col("p.state").alias("location_state"),
        none.alias("salary_min"), none.alias("salary_max"), F.col("ingested_at").try_cast("timestamp").alias("ingested_at"),
    )


def to_board_documents(rows: DataFrame, board: Column) -> DataFrame:
    """A document for each row."""
    meta = F.struct("source", board.alias("board"), F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ingested_at")).alias("_meta")
    return rows.select(meta, F.array(F.struct(F.col("job_id").alias("id"), F.col("job_title").alias("title"), "location")).alias("results"))


def append_run(rows: DataFrame, path: str, run: str) -> None:
    """Objects of one run under its stamp; a run that is there already is an error."""
    rows.write.mode("errorifexists").parquet(f"{path}/run={run}")


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines: decimals as doubles, dates as ISO text, timestamps to the microsecond."""
    out = []
    for f in rows.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        c = c.cast("double") if kind.startswith("decimal") else F.date_format(c, "yyyy-MM-dd") if kind == "date" else F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind.startswith("timestamp") else c
        out.append(c.alias(f.name))
    rows.select(*out).write.mode("overwrite").json(path)


def replace_whole(rows: DataFrame, path: str) -> None:
    """A new version of a whole table beside the old one; the marker that readers go by is written last."""
    spark = rows.sparkSession
    version = _current(spark, path) + 1
    rows.write.mode("overwrite").parquet(f"{path}/version={version}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current/{version}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True).close()


def _current(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((int(f.getPath().getName()) for f in fs.listStatus(p)), default=-1) if fs.exists(p) else -1


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version that was replaced last."""
    return spark.read.parquet(f"{path}/version={_current(spark, path)}")
