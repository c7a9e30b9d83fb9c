"""Parquet sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of `<name>.parquet` files or directories."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dataset_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A partitioned dataset; a path that does not exist gives an empty table of `schema`."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header line, columns by name; of a wide file only the selected ones are parsed. Values that do not fit
    their type are null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").csv(path)
