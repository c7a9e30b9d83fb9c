"""Checks as one-row aggregates: (check, failures, ok)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(name: str, failures: DataFrame) -> DataFrame:
    return failures.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures", (F.col("failures") == 0).alias("ok"))


def not_null(df: DataFrame, c: str) -> DataFrame:
    return _row(f"not_null {c}", df.filter(F.col(c).isNull()))


def unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return _row(f"unique {' '.join(cols)}", df.groupBy(*cols).count().filter("count > 1"))


def accepted(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    """Nulls pass."""
    return _row(f"accepted {c}", df.filter(F.col(c).isNotNull() & ~F.col(c).isin(*values)))


def in_range(df: DataFrame, c: str, low, high) -> DataFrame:
    """Bounds included; nulls pass."""
    return _row(f"in_range {c}", df.filter(F.col(c).isNotNull() & ~F.col(c).between(low, high)))


def related(df: DataFrame, c: str, parent: DataFrame, p: str) -> DataFrame:
    """Rows whose key the parent lacks; null keys pass."""
    return _row(f"related {c}", df.filter(F.col(c).isNotNull()).join(parent.select(F.col(p).alias(c)).distinct(), c, "left_anti"))


def holds(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return _row(name, df.filter(~F.coalesce(condition, F.lit(False))))


def at_least(df: DataFrame, name: str, rows: int) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    missing = F.greatest(F.lit(rows) - F.col("n"), F.lit(0)).cast("long")
    return n.select(F.lit(name).alias("check"), missing.alias("failures"), (missing == 0).alias("ok"))


def drift(before: DataFrame, after: DataFrame, name: str, most_pct: float) -> DataFrame:
    """One failure if the row count moved by more than most_pct percent; from 0 rows any row is a drift."""
    b, a = before.agg(F.count("*").alias("b")), after.agg(F.count("*").alias("a"))
    moved = F.when(F.col("b") == 0, F.col("a") > 0).otherwise(100.0 * F.abs(F.col("a") - F.col("b")) / F.col("b") > most_pct)
    return b.crossJoin(a).select(F.lit(name).alias("check"), moved.cast("long").alias("failures"), (~moved).alias("ok"))


def report(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def require_rows(df: DataFrame, name: str) -> DataFrame:
    """df itself; an empty one is an error."""
    if df.isEmpty():
        raise ValueError(f"{name}: no rows")
    return df


def collisions(df: DataFrame, name: str, slug: Column) -> DataFrame:
    """(slug, names, ok): the number of distinct names that each slug stands for."""
    return df.select(F.col(name).alias("_name"), slug.alias("slug")).distinct().groupBy("slug").agg(F.count("*").alias("names")).withColumn("ok", F.col("names") == 1)


def refuse_collisions(df: DataFrame, name: str, slug: Column) -> DataFrame:
    """df itself; names that share a slug are an error that states some of them."""
    bad = [r.slug for r in collisions(df, name, slug).filter("not ok").orderBy("slug").limit(5).collect()]
    if bad:
        raise ValueError(f"slugs of several names: {', '.join(bad)}")
    return df


def expectations(rows: Sequence[tuple[str, bool, DataFrame, Column, Column]]) -> DataFrame:
    """(name, fatal, ok, detail), one aggregate row for each (name, fatal, table, ok, detail); an ok that is null is not met."""
    one = lambda name, fatal, df, ok, detail: df.agg(F.coalesce(ok, F.lit(False)).alias("ok"), detail.alias("detail")).select(F.lit(name).alias("name"), F.lit(fatal).alias("fatal"), "ok", "detail")
    return reduce(DataFrame.unionByName, [one(*r) for r in rows])


def gate(result: DataFrame, strict: bool = False) -> list[str]:
    """Raise if a fatal expectation, or if `strict` any, is not met; returns the names of those that only warn."""
    failed = [(r.name, r.fatal) for r in result.filter("not ok").orderBy("name").collect()]  # a row an expectation
    bad = [n for n, fatal in failed if fatal or strict]
    if bad:
        raise ValueError(f"expectations not met: {', '.join(bad)}")
    return [n for n, _ in failed]
