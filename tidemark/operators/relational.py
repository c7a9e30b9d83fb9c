"""Relational operators that Spark has no single call for. None collects rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in `order`, which should be total; null keys are a group of their own. The rank
    filter is pruned before the shuffle by Spark's group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def movement(df: DataFrame, *, key: str, time: str, value: str, spans: Sequence[int]) -> DataFrame:
    """Previous value, value `n` rows back (the earliest there is, if fewer) and its change in percent per span,
    and the number of observations per key. Change is null on the first row or a base of 0."""
    w = Window.partitionBy(key).orderBy(time)
    out = df.withColumns({f"previous_{value}": F.lag(value).over(w), "observations": F.count("*").over(Window.partitionBy(key))})
    for n in spans:
        base = F.first(value).over(w.rowsBetween(-(n - 1), 0))
        out = out.withColumn(f"{value}_{n}_back", base)
        out = out.withColumn(f"change_{n}_pct", F.when((base > 0) & (F.col("observations") > 1), F.round(100.0 * (F.col(value) - base) / base, 1)))
    return out


def pairs_by_item(x: DataFrame, *, entity: str, item: str, block: int = 1000) -> DataFrame:
    """(e, f), e < f, for each two entities of (entity, item), distinct, that share an item; a row for each item they share.

    The entities of an item are cut into blocks of about `block`, and pairs of blocks are joined by themselves, so that no
    task holds a hot item.
    """
    n = x.groupBy(item).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    b = x.join(n, item).withColumn("_b", F.pmod(F.xxhash64(entity), F.col("_n")).cast("int"))
    left = b.select(item, F.col(entity).alias("e"), F.col("_b").alias("_p"), F.explode(F.sequence("_b", F.col("_n") - 1)).alias("_q"))
    right = b.select(item, F.col(entity).alias("f"), F.col("_b").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_p"))
    j = left.join(right, [item, "_p", "_q"]).filter((F.col("_p") < F.col("_q")) | (F.col("e") < F.col("f")))
    return j.select(F.least("e", "f").alias("e"), F.greatest("e", "f").alias("f"))


def jaccard_peers(sets: DataFrame, *, entity: str, item: str, least_shared: int, least: float, k: int, block: int = 1000) -> DataFrame:
    """Up to k most similar entities of each entity by Jaccard similarity of item sets, ties by name.

    Entities below least_shared items are left out before the self-join, which cuts hot items into blocks. Each pair is
    counted once and mirrored afterwards.
    """
    s = sets.select(F.col(entity).alias("e"), F.col(item).alias("i")).filter("e is not null and i is not null").distinct()
    size = s.groupBy("e").agg(F.count("*").alias("n")).filter(F.col("n") >= least_shared)
    shared = pairs_by_item(s.join(size.select("e"), "e", "left_semi"), entity="e", item="i", block=block).groupBy("e", "f").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least_shared)
    shared = shared.join(size, "e").join(size.select(F.col("e").alias("f"), F.col("n").alias("m")), "f")
    p = shared.withColumn("similarity", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 3)).filter(F.col("similarity") >= least)
    both = p.select("e", F.col("f").alias("peer"), "shared", "similarity").unionByName(p.select(F.col("f").alias("e"), F.col("e").alias("peer"), "shared", "similarity"))
    w = Window.partitionBy("e").orderBy(F.col("similarity").desc(), F.col("shared").desc(), "peer")
    return both.withColumn("peer_rank", F.row_number().over(w)).filter(F.col("peer_rank") <= k).withColumnRenamed("e", entity)


def prefix_matches(left: DataFrame, right: DataFrame, *, key: str, name: str, least_length: int = 8) -> DataFrame:
    """Rows (key, name, exact) where name equals key or starts with key and a blank.

    Every name is exploded into its whole-word prefixes, so the range condition becomes an equi-join. Keys
    shorter than least_length match exactly only; null keys and names match nothing.
    """
    words = F.split(F.col(name), " ")
    prefixes = right.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("_p"))
    hit = left.select(key).filter(F.col(key).isNotNull()).distinct().join(prefixes.distinct(), F.col(key) == F.col("_p"))
    exact = F.col(key) == F.col(name)
    return hit.filter(exact | (F.length(key) >= least_length)).select(key, name, exact.alias("exact"))


def upsert(existing: DataFrame, incoming: DataFrame, *, keys: Sequence[str], keep: Sequence[str] = (), fill: Sequence[str] = ()) -> DataFrame:
    """existing with incoming merged in, on keys that are unique in each: `keep` columns stay as they were, `fill`
    columns are replaced where the new value is not null, all others are replaced."""
    i = incoming.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("_i"))
    e = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("_e"))
    j = e.join(i, list(keys), "full")

    def merged(c: str) -> Column:
        old, new = F.col(f"_e.{c}"), F.col(f"_i.{c}")
        if c in fill:
            return F.coalesce(new, old).alias(c)
        prefer_old = F.col("_e").isNotNull() if c in keep else F.col("_i").isNull()
        return F.when(prefer_old, old).otherwise(new).alias(c)

    return j.select(*[F.col(c) if c in keys else merged(c) for c in existing.columns])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing and the incoming rows whose key it lacks, one per key (the least by all columns)."""
    new = incoming.select(*existing.columns).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(first_per_key(new, keys, [F.col(c).asc_nulls_last() for c in existing.columns]))


def replace_batch(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """delete + insert: rows of target whose key the batch names are dropped, then the batch is added."""
    return target.join(batch.select(*keys).distinct(), list(keys), "left_anti").unionByName(batch)


def drop_orphans(child: DataFrame, parent: DataFrame, on: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of child that have a row in parent; rows with a null key have none."""
    cond = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in on]
    c = cond[0]
    for x in cond[1:]:
        c = c & x
    return child.alias("c").join(parent.select(*[b for _, b in on]).distinct().alias("p"), c, "left_semi")


def keep_top_or_referenced(df: DataFrame, *, key: str, measure: str, n: int, referenced: DataFrame) -> DataFrame:
    """Rows of the n keys with the greatest sum of measure (ties by key), and of keys that `referenced` names."""
    top = df.groupBy(key).agg(F.sum(measure).alias("_m")).orderBy(F.col("_m").desc_nulls_last(), F.col(key)).limit(n).select(key)
    return df.join(top.unionByName(referenced.select(key)).distinct(), key, "left_semi")


def most_frequent_spelling(df: DataFrame, *, group: str, spelling: str) -> DataFrame:
    """Per group: its most frequent spelling, ties to the shorter, then the lesser by bytes."""
    c = df.filter(F.col(group).isNotNull() & F.col(spelling).isNotNull()).groupBy(group, spelling).agg(F.count("*").alias("uses"))
    return first_per_key(c, [group], [F.col("uses").desc(), F.length(spelling), F.col(spelling)])


def changed_or_missing(source: DataFrame, manifest: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Rows of source whose (keys, digest) the manifest does not hold."""
    return source.join(manifest.select(*keys, digest).distinct(), [*keys, digest], "left_anti")


def merge(existing: DataFrame, incoming: DataFrame, *, keys: Sequence[str], rules: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """existing with incoming merged in, on keys that are unique in each. A key in both takes rules[c](old row, new row) for
    each column c that has a rule and keeps the others; a key in incoming only is added as it is."""
    rest = [c for c in existing.columns if c not in keys]
    e = existing.select(*keys, F.struct(*rest).alias("_e"))
    i = incoming.select(*keys, F.struct(*rest).alias("_i"))
    old, new = F.col("_e"), F.col("_i")
    out = [rules[c](old, new) if c in rules else old[c] for c in rest]
    merged = [F.when(new.isNull(), old[c]).when(old.isNull(), new[c]).otherwise(x).alias(c) for c, x in zip(rest, out)]
    j = e.join(i, list(keys), "full").select(*keys, *merged)
    return j.select(*existing.columns)


def backfill(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Nulls alone are filled."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def append_later(source: DataFrame, path: str, time: str) -> None:
    """Append to the table at `path` the rows of source that are later than its greatest `time`; all of them if it is empty or
    not there. The mark is one value; a row without a time is never appended."""
    spark = source.sparkSession
    try:
        mark = spark.read.parquet(path).agg(F.max(time).alias("m")).first().m
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        mark = None
    rows = source.filter(F.col(time).isNotNull() if mark is None else F.col(time) > F.lit(mark))
    rows.write.mode("append").parquet(path)


def global_row_number(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Row numbers from 1 over the whole of df in `order`, which should be total, without one task for all rows: rows are
    ranged by the order, numbered within ranges, and ranges are moved on by the sizes of those before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy("_p").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "_p").withColumn(name, F.row_number().over(w) + F.col("_before")).drop("_p", "_before")  # a row a range


def not_in(df: DataFrame, c: str, other: DataFrame, o: str) -> DataFrame:
    """SQL's NOT IN: a null among the others leaves no row, and a null on the left passes only if there are no others. The
    two facts are one row, so the anti join stays a plain equi-join."""
    others = other.select(F.col(o).alias(c))
    n, nulls = others.agg(F.count("*"), F.count_if(F.col(c).isNull())).first()
    if n == 0:
        return df
    if nulls:
        return df.filter("false")
    return df.filter(F.col(c).isNotNull()).join(others.distinct(), c, "left_anti")


def median(h: DataFrame, by: Sequence[str], value: str, count: str, name: str) -> DataFrame:
    """Interpolated median of each group, given as a histogram (by, value, count)."""
    h = h.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    upto = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    x = h.withColumns({"_upto": upto, "_all": F.sum(count).over(w)})
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(value)))
    return x.groupBy(*by).agg(((at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2).alias(name))


def upper_median(h: DataFrame, by: Sequence[str], value: str, count: str, name: str) -> DataFrame:
    """Element n // 2 (from 0) of the sorted values of each group, given as a histogram (by, value, count): no group is held
    row by row. Null values are not counted."""
    h = h.filter(F.col(value).isNotNull())
    w = Window.partitionBy(*by)
    upto = F.sum(count).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    x = h.withColumns({"_upto": upto, "_all": F.sum(count).over(w)}).filter(F.col("_upto") > F.floor(F.col("_all") / 2))
    return x.groupBy(*by).agg(F.min(value).alias(name))
