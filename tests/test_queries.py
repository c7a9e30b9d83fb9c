"""Every core query runs; streams agree with their batch statement; sources take what is missing."""

import duckdb
import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from tidemark import plans
from tidemark.session import durable, new_path
from tidemark.sources.tables import dataset_or_empty

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "").replace("T00:00:00", "")
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.load_queries()))
def test_query(spark, duck, name):
    df = plans.load_queries()[name](spark, DATA)
    got = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    r = duck.execute(plans.load_oracle()[name])
    cols = [x[0] for x in r.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sources(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert dataset_or_empty(spark, new_path(spark, "nothing"), schema).count() == 0
    assert durable(spark.range(5), "five").count() == 5
