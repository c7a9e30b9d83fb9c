"""Retention rules over text and rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def droppable_text(rows: DataFrame, *, keys: Sequence[str], digest: str, age: str, archived: DataFrame, needed: DataFrame, as_of: str, days: int) -> DataFrame:
    """rows with `drop`: older than `days`, archived under the same digest, and not named by `needed`.

    The EXISTS tests become flags by left joins on distinct keys, so that they combine freely; a null digest is
    never archived."""
    a = archived.select(*keys, digest).distinct().withColumn("_a", F.lit(True))
    n = needed.select(*keys).distinct().withColumn("_n", F.lit(True))
    j = rows.join(a, [*keys, digest], "left").join(n, list(keys), "left")
    old = F.col(age) < F.date_sub(F.lit(as_of).cast("date"), days)
    return j.withColumn("drop", F.coalesce(old, F.lit(False)) & F.col("_a").isNotNull() & F.col("_n").isNull()).drop("_a", "_n")


def deletable_counts(rows: DataFrame, *, posted: str, seen: str, as_of: str, windows: Sequence[int], idle: int) -> DataFrame:
    """Per window in days: rows posted before it and not seen for `idle` days."""
    at = F.lit(as_of).cast("date")
    aggs = [F.count(F.when((F.to_date(posted) < F.date_sub(at, w)) & (F.to_date(seen) < F.date_sub(at, idle)), 1)).alias(str(w)) for w in windows]
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(w).alias("window_days"), F.col(str(w)).alias("rows")) for w in windows])).alias("x")).select("x.*")


def delete_to_size(rows: DataFrame, *, posted: str, seen: str, as_of: str, windows: Sequence[int], idle: int, share: float) -> tuple[DataFrame, int]:
    """(rows that stay, window applied): the longest window whose deletion leaves at most `share` of the rows, or the
    shortest if none does. Rows without a date stay."""
    gone = {r.window_days: r.rows for r in deletable_counts(rows, posted=posted, seen=seen, as_of=as_of, windows=windows, idle=idle).collect()}  # a row a window
    n = rows.count()
    window = max((w for w in windows if n - gone[w] <= share * n), default=min(windows))
    at = F.lit(as_of).cast("date")
    old = (F.to_date(posted) < F.date_sub(at, window)) & (F.to_date(seen) < F.date_sub(at, idle))
    return rows.filter(~F.coalesce(old, F.lit(False))), window
