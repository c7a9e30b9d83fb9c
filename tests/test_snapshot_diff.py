import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.snapshot_diff import differing, snapshot_diff

SCHEMA = "n int, source string, id string, a string, b double, seen int, before string, kh long"


def diff(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = snapshot_diff(df, snapshot="n", keys={"source": F.col("source"), "id": F.trim("id")}, compare=["a", "b"], latest_by=["seen"], **kw)
    return sorted([tuple(r) for r in out.select("n", "source", "id", "change").collect()], key=str)


def brute(rows):
    state = {}
    for n, s, i, a, b, seen in rows:
        if n is None:
            continue
        k = (n, s, i.strip(" ") if i is not None else None)
        if k not in state or (seen is not None and (state[k][0] is None or seen > state[k][0])):
            state[k] = (seen, (a, b))
    order = sorted({k[0] for k in state})
    out = []
    for p, n in zip(order, order[1:]):
        for s, i in {k[1:] for k in state if k[0] in (p, n)}:
            x, y = state.get((p, s, i)), state.get((n, s, i))
            c = "added" if x is None else "removed" if y is None else "changed" if x[1] != y[1] else None
            if c:
                out.append((n, s, i, c))
    return sorted(out, key=str)


def test_cases(spark):
    rows = [
        (1, "s", " k1", "v", 1.0, 1), (1, "s", "k2", "v", None, 1), (1, None, "k3", None, 1.0, 1), (1, "s", None, "v", 1.0, 1), (1, "s", "k5", "old", 1.0, 1), (1, "s", "k5", "new", 1.0, 2),
        (3, "s", "k1 ", "v", 1.0, 5), (3, "s", "k2", "v", 2.0, 1), (3, None, "k3", "x", 1.0, 1), (3, "s", "k5", "new", 1.0, 9), (3, "s", "k5", "new", 1.0, 9), (3, "s", "k6", "", 1.0, None),
        (4, "s", "k6", None, 1.0, None), (None, "s", "k9", "v", 1.0, 1),
    ]
    got = diff(spark, rows)
    assert got == brute(rows)
    assert (3, "s", None, "removed") in got and (4, "s", "k6", "changed") in got and (3, "s", "k2", "changed") in got


def test_empty_and_one_snapshot(spark):
    assert diff(spark, []) == []
    assert diff(spark, [(1, "s", "k", "v", 1.0, 1)]) == []


def test_values_and_hot_key(spark):
    rows = [(1, "s", "hot", f"v{i}", 1.0, i) for i in range(500)] + [(2, "s", "hot", "z", 1.0, 1)] + [(n, "s", str(i), "v", 1.0, 1) for n in (1, 2) for i in range(100)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = snapshot_diff(df, snapshot="n", keys={"source": F.col("source"), "id": F.col("id")}, compare=["a", "b"], latest_by=["seen"]).collect()
    assert [(r.id, r.change, r.before.a, r.after.a) for r in out] == [("hot", "changed", "v499", "z")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from(["s", "t", None]), st.sampled_from(["a", "b", "c", None]), st.sampled_from(["x", "y", None]), st.sampled_from([1.0, None]), st.integers(0, 10**6)), max_size=25, unique_by=lambda r: (r[0], r[1], r[2], r[5])))
def test_against_brute_force(spark, rows):
    assert diff(spark, rows, buckets=2) == brute(rows)


def test_colliding_hashes_are_looked_at():
    p, c = np.array([1, 1, 2], np.int64), np.array([1, 1, 2], np.int64)
    assert differing((p, np.array([5, 6, 7])), (c, np.array([5, 6, 7]))).tolist() == [1]


def test_dates_as_snapshots(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), "a", 1), (dt.date(2024, 2, 1), "a", 2)], "d date, k string, v int")
    out = snapshot_diff(df, snapshot="d", keys={"k": F.col("k")}, compare=["v"], latest_by=["v"]).collect()
    assert [(r.d, r.change) for r in out] == [(dt.date(2024, 2, 1), "changed")]
