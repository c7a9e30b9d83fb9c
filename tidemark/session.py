"""Session construction and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tidemark", master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with AQE and dynamic partition overwrite; `conf` uses `__` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own if everything runs on this
    machine, and an error on a cluster, whose executors would not see it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[app] = "file://" + folder
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


_written: dict[str, list[str]] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder; drop_intermediate() removes it."""
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor
    costs nothing but the tasks it was running. Columns, types and rows are unchanged."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> int:
    """Remove what this session wrote by new_path() and durable(); returns the number of paths. Results not yet
    written elsewhere are lost: call it when a query's rows have been stored."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in map(hadoop, paths):
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """`df` over as many partitions as shuffles have, by `cols`: for few bytes that cost much work a row, which the
    adaptive planner would put into one task. The hash keeps Spark from taking an exchange before it for this one."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*cols))


def by_merge(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that sorts and merges. Spark's guess of a side's size knows neither the rows that explode and
    mapInArrow make of one nor how files are compressed; a side broadcast by such a guess can be many times the threshold,
    and the driver holds all of it."""
    return df.hint("merge")
