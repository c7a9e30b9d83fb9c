"""Top N items within every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, *, group: Sequence[str], item: str, score: str, n: int, place: str = "place") -> DataFrame:
    """The `n` items of each group with the highest score, ties by item ascending (by bytes).

    An item counts once per group, with its greatest score; the maximum is taken map-side first, so a hot
    group is spread over its items. The rank filter on row_number() lets Spark's WindowGroupLimit keep n
    rows per group in every task before the shuffle by group, so the final task of even the largest group
    reads n rows per upstream task.

    Defined cases: null scores never count, and an item with null scores only is absent; a null item is an
    item like any other and comes first among equals; a null in `group` is a group of its own; repeated
    rows change nothing; an empty table gives no rows; groups with fewer than n items give what they have.
    Other columns of `df` are not read.
    """
    best = df.filter(F.col(score).isNotNull()).groupBy(*group, item).agg(F.max(score).alias(score))
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(item).asc_nulls_first())
    return best.withColumn(place, F.row_number().over(w)).filter(F.col(place) <= n).select(*group, item, score, place)
