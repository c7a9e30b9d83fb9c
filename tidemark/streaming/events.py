"""Structured Streaming over files of events; each run takes what is there and stops (availableNow)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_path


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Stream of parquet files; ts becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    s = s.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_dir(spark, path) else s.parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).isDirectory()


def run_to_table(stream: DataFrame, label: str, sink: Callable[[DataFrame, str], None] | None = None, mode: str = "append") -> DataFrame:
    """Run the stream to the end of its input into a folder and read that.

    The sink gets (batch, folder), and must be idempotent: a batch may come again after a failure. By default a batch
    is written to a subfolder of its number, overwriting an earlier try; in complete mode only the last counts.
    """
    spark = stream.sparkSession
    path = new_path(spark, label)
    base = f"{path}/data"

    def write(batch: DataFrame, n: int) -> None:
        if sink is not None:
            sink(batch, base)
        else:
            batch.write.mode("overwrite").parquet(f"{base}/batch={0 if mode == 'complete' else n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    try:
        return spark.read.schema(stream.schema).parquet(base).select(*stream.columns)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)


def insert_absent(keys: list[str]) -> Callable[[DataFrame, str], None]:
    """Sink that appends rows whose key the folder does not hold; one row per key within a batch."""

    def sink(batch: DataFrame, base: str) -> None:
        batch = batch.dropDuplicates(keys)
        try:
            batch = batch.join(batch.sparkSession.read.parquet(base).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.write.mode("append").parquet(base)

    return sink


def scored(rows: DataFrame, rules: list[tuple[str, Column, Column]], threshold: float) -> DataFrame:
    """rows with score and reason of the rules (name, condition, points) that hold, joined in order; those at or
    above the threshold."""
    on = [F.coalesce(c, F.lit(False)) for _, c, _ in rules]
    score = sum((F.when(c, p).otherwise(0) for c, (_, _, p) in zip(on, rules)), F.lit(0))
    reason = F.concat_ws("; ", *[F.when(c, F.lit(n)) for c, (n, _, _) in zip(on, rules)])
    return rows.withColumns({"score": score, "reason": reason}).filter(F.col("score") >= threshold)


def resume(stream: DataFrame, path: str) -> DataFrame:
    """Run a named stream from where its last run ended to the end of its input. Offsets are kept under path/checkpoint, rows
    under path/data by batch number, so a batch that comes again after a failure replaces its first try."""
    spark = stream.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/data/batch={n}")

    q = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data").select(*stream.columns)


def replay(stream: DataFrame, at: str, since) -> DataFrame:
    """What came at or after `since`, read again under a mark of its own; the marks of named streams stay where they are."""
    return run_to_table(stream.filter(F.col(at) >= F.lit(since)), "replay")


def keyed(stream: DataFrame, key: Column, slots: int) -> DataFrame:
    """Records of a log: key, value (the row as JSON), slot (by key hash). Rows of a key share a slot."""
    value = F.to_json(F.struct(*stream.columns))
    return stream.select(key.alias("key"), value.alias("value"), F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("slot"))


def watch(source: Callable[[], DataFrame], path: str, rounds: int = 1, seconds: float = 0.0) -> DataFrame:
    """Resume the stream `rounds` times, `seconds` apart; 1 is one shot."""
    for k in range(rounds):
        if k and seconds:
            time.sleep(seconds)
        out = resume(source(), path)
    return out
