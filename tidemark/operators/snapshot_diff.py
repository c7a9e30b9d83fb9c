"""What changed between consecutive full snapshots of a table.

Every row is reduced to (snapshot, 64-bit key hash, 64-bit row hash). The compact rows are bucketed by
key hash and streamed bucket by bucket, snapshot by snapshot, through sorted numpy arrays; a set
difference by searchsorted names the keys that differ. Full values are then fetched for those keys only,
and the verdict on them is taken from the values themselves, so a hash collision cannot reach the result:
two keys with one hash in the same snapshot are always fetched, and the row hash covers the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = 0x5EED


def null_safe_hash(cols: Sequence[Column], salt: int | None = None) -> Column:
    """64-bit hash in which a null differs from every value and from a null in the next column."""
    parts: list[Column] = [] if salt is None else [F.lit(salt)]
    for c in cols:
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def _sorted(kh: np.ndarray, rh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(kh, kind="stable")
    return kh[o], rh[o]


def _missing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the entries of sorted `a` that are not in sorted `b`, and their places in `b`."""
    pos = np.searchsorted(b, a)
    hit = np.zeros(len(a), bool)
    inside = pos < len(b)
    hit[inside] = b[pos[inside]] == a[inside]
    return ~hit


def differing(prev: tuple[np.ndarray, np.ndarray], cur: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Key hashes to look at: in one of the two only, with another row hash, or held by several keys."""
    (pk, pr), (ck, cr) = prev, cur
    new, gone = _missing(ck, pk), _missing(pk, ck)
    kept = np.nonzero(~new)[0]
    changed = kept[pr[np.searchsorted(pk, ck[kept])] != cr[kept]] if len(kept) else kept
    dup = [k[1:][k[1:] == k[:-1]] for k in (pk, ck)]
    return np.unique(np.concatenate([ck[new], pk[gone], ck[changed], *dup]))


def _diff_stream(order: list):
    """mapInArrow function over rows sorted by (bucket, snapshot index)."""
    last = len(order) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.empty(0, np.int64), np.empty(0, np.int64))
        out: list[tuple[int, np.ndarray]] = []
        state: dict = {"bucket": None, "idx": -1, "arrays": empty}
        at, held = None, []

        def finish_bucket() -> None:
            if state["bucket"] is not None and state["idx"] < last:
                out.append((state["idx"] + 1, np.unique(state["arrays"][0])))
            state.update(bucket=None, idx=-1, arrays=empty)

        def close() -> None:
            bucket, idx = at
            cur = _sorted(*(np.concatenate(x) for x in zip(*held)))
            if state["bucket"] != bucket:
                finish_bucket()
                state["bucket"] = bucket
            elif state["idx"] < idx - 1:
                out.append((state["idx"] + 1, np.unique(state["arrays"][0])))
                state["arrays"] = empty
            if idx > 0:
                out.append((idx, differing(state["arrays"], cur)))
            state.update(idx=idx, arrays=cur)

        def flush() -> pa.RecordBatch:
            idx = np.concatenate([np.full(len(k), i, np.int32) for i, k in out] or [np.empty(0, np.int32)])
            kh = np.concatenate([k for _, k in out] or [np.empty(0, np.int64)])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(idx), pa.array(kh)], names=["idx", "kh"])

        for b in batches:
            bucket, idx, kh, rh = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            cuts = np.nonzero((bucket[1:] != bucket[:-1]) | (idx[1:] != idx[:-1]))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(kh)]):
                if lo == hi:
                    continue
                here = (int(bucket[lo]), int(idx[lo]))
                if here != at:
                    if at is not None:
                        close()
                    at, held = here, []
                held.append((kh[lo:hi], rh[lo:hi]))
            if sum(len(k) for _, k in out) > 50_000:
                yield flush()
        if at is not None:
            close()
            finish_bucket()
        yield flush()

    return run


def snapshot_diff(
    df: DataFrame,
    *,
    snapshot: str,
    keys: dict[str, Column],
    compare: Sequence[str],
    latest_by: Sequence[str],
    buckets: int | None = None,
    values: bool = True,
) -> DataFrame:
    """Records added, removed or changed between each snapshot and the one delivered before it.

    keys: output name -> expression over `df` (normalise there). compare: columns whose difference makes a
    record `changed`; null equals null only. latest_by: within one snapshot the row with the greatest
    values of these columns is the record's state (a null is below every value; rows that tie are ordered
    by their row hash). Returns snapshot, the keys, change ('added' | 'removed' | 'changed') and, with
    `values`, structs `before` and `after` of the compared columns.

    Defined cases: a null in a key column is a key value of its own; rows with a null snapshot are ignored;
    exact repeats of a row count once; columns of `df` that are not named are not read, so their names may
    clash with anything; an empty table, or one snapshot, gives no rows; the first snapshot is not reported.
    Snapshots need not be numbered without gaps: each is held against the one before it in order.
    """
    spark = df.sparkSession
    df = df.filter(F.col(snapshot).isNotNull())
    order = [r[0] for r in df.select(snapshot).distinct().orderBy(snapshot).collect()]  # one value per delivery
    key_names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        F.col(snapshot).alias("s"),
        *[e.alias(k) for k, e in zip(key_names, keys.values())],
        *[F.col(c).alias(f"v{i}") for i, c in enumerate(compare)],
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(latest_by)],
    )
    kc = [F.col(k) for k in key_names]
    vc = [F.col(f"v{i}") for i in range(len(compare))]
    oc = [F.col(f"o{i}") for i in range(len(latest_by))]
    schema_idx = "idx int, kh long"
    rows = rows.withColumns({"kh": null_safe_hash(kc), "kh2": null_safe_hash(kc, SALT)}).withColumn("rh", null_safe_hash([F.col("kh2"), *vc]))

    if buckets is None:
        buckets = max(256, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    positions = spark.createDataFrame([(v, i) for i, v in enumerate(order)], f"s {df.schema[snapshot].dataType.simpleString()}, idx int")
    compact = (
        rows.groupBy("s", "kh", "kh2")
        .agg(F.max(F.struct(*oc, "rh")).getField("rh").alias("rh"))
        .join(F.broadcast(positions), "s")  # one row per delivery
        .select(F.pmod(F.col("kh"), F.lit(buckets)).cast("int").alias("bucket"), "idx", "kh", "rh")
    )
    flagged = compact.repartition("bucket").sortWithinPartitions("bucket", "idx").mapInArrow(_diff_stream(order), schema_idx)

    now = F.broadcast(positions.select(F.col("idx"), F.col("s").alias("n")))
    wanted = flagged.join(now, "idx").select("n", "idx", "kh", F.explode(F.array(F.col("idx"), F.col("idx") - 1)).alias("at"))
    wanted = wanted.join(F.broadcast(positions.select(F.col("idx").alias("at"), F.col("s").alias("at_s"))), "at").withColumn("is_now", F.col("at") == F.col("idx"))
    full = F.struct(*oc, "rh", F.struct(*[v.alias(c) for v, c in zip(vc, compare)]).alias("v"))
    fetched = rows.join(wanted.select("n", F.col("kh").alias("w_kh"), "at_s", "is_now"), (F.col("s") == F.col("at_s")) & (F.col("kh") == F.col("w_kh")))
    sides = fetched.groupBy("n", *key_names).agg(
        F.max(F.when(~F.col("is_now"), full)).getField("v").alias("before"),
        F.max(F.when(F.col("is_now"), full)).getField("v").alias("after"),
    )
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = sides.withColumn("change", change).filter(F.col("change").isNotNull())
    named = [F.col("n").alias(snapshot), *[F.col(k).alias(name) for k, name in zip(key_names, keys)], "change"]
    return out.select(*named, *(["before", "after"] if values else []))
