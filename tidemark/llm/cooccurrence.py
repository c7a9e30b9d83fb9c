"""Items that appear together: persistent pair counts kept by signed deltas.

State is three tables under a folder: counts of pairs and of items, hash-bucketed by item, and the number of baskets. An
update compares the old and new item set of every basket named in a change, and emits +1/-1 for the pairs, items
and baskets that the change adds or takes away. The summed deltas are merged into the buckets they fall in: those are
written anew in a folder of the update's version, all others stay where they are, so a reader takes each count from
one file and sums nothing. Which version of each bucket counts is said by the last manifest, written after the
buckets, so a table can be opened again by any session and an update that was cut off leaves no trace. The delta of the
last update is kept beside the counts, for the scores that it moved. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import durable

#: Baskets up to this many distinct items expand in one row; larger ones in blocks of about this size.
BLOCK = 256


def basket_items(df: DataFrame, basket: Sequence[str], item) -> DataFrame:
    """Distinct (basket, item) rows; `item` is an expression, whose null and '' results are dropped.
    A null in a basket column is a value of its own. Columns of `df` not named are not read."""
    b = F.struct(*[F.col(c) for c in basket])
    rows = df.select(b.alias("basket"), item.alias("item")).filter(F.col("item").isNotNull() & (F.col("item") != ""))
    return rows.distinct()


def basket_sizes(items: DataFrame) -> DataFrame:
    """basket, sign, n: the number of items of each basket of (basket, item, sign)."""
    return items.groupBy("basket", "sign").agg(F.count("*").alias("n"))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, sign, item), rows of a basket (h, g) side by side with items rising, to summed (a, b, n) of the pairs of each batch."""

    def pairs(h: np.ndarray, g: np.ndarray, sign: np.ndarray, item: pa.Array) -> pa.RecordBatch:
        words = item.dictionary_encode()
        code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
        edges = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]), [True]])) if len(h) else np.zeros(1, np.int64)
        size = np.diff(edges)
        keys, signs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n in np.unique(size[size > 1]):
            p, q = np.triu_indices(n, 1)
            starts = edges[:-1][size == n]
            step = max(1, 2_000_000 // len(p))  # pairs looked at together
            for lo in range(0, len(starts), step):
                at = starts[lo : lo + step, None]
                keys.append((code[at + p] * len(names) + code[at + q]).ravel())
                signs.append(np.repeat(sign[at[:, 0]], len(p)))
        k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(signs), minlength=len(k)).astype(np.int64)
        k, n = k[n != 0], n[n != 0]
        return pa.RecordBatch.from_arrays([names.take(pa.array(k // max(1, len(names)))), names.take(pa.array(k % max(1, len(names)))), pa.array(n)], names=["a", "b", "n"])

    tail: pa.RecordBatch | None = None
    for batch in batches:
        if tail is not None and tail.num_rows:
            batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        h, g = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        new = np.flatnonzero((h[1:] != h[:-1]) | (g[1:] != g[:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0  # the last basket may go on
        yield pairs(h[:cut], g[:cut], batch.column(2).to_numpy(zero_copy_only=False)[:cut], batch.column(3).slice(0, cut))
        tail = batch.slice(cut)
    if tail is not None and tail.num_rows:
        yield pairs(*(tail.column(c).to_numpy(zero_copy_only=False) for c in range(3)), tail.column(3))


def pair_deltas(items: DataFrame, block: int = BLOCK, largest: int | None = None) -> DataFrame:
    """(a, b, n): for each pair of items the sum of the signs of the baskets of (basket, item, sign) that have both, where it is
    not 0; the sign is constant in a basket.

    Baskets are told apart by two 64-bit hashes, sorted by them and expanded by numpy, batch by batch, which sums before
    the shuffle. No task expands a basket of more than `block` items: a larger one is cut into blocks by item hash, and each
    pair of blocks is expanded by itself. `items` is read more than once and should be written down; `largest` is the
    size of the largest basket, counted here if it is not given.
    """
    if largest is None:
        largest = basket_sizes(items).agg(F.max("n")).first()[0] or 0
    small = items
    if largest > block:
        big = durable(basket_sizes(items).filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "big-baskets")
        small = items.join(big.select("basket"), "basket", "left_anti")
    rows = small.select(F.xxhash64("basket").alias("h"), F.xxhash64(F.lit(7), "basket").alias("g"), F.col("sign").cast("int").alias("sign"), "item")
    deltas = rows.repartition("h").sortWithinPartitions("h", "g", "item").mapInArrow(_expand, "a string, b string, n long")
    if largest > block:
        chunks = (
            items.join(big.select("basket", "blocks"), "basket")
            .withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
            .groupBy("basket", "chunk", "sign")
            .agg(F.sort_array(F.collect_list("item")).alias("s"))
        )
        within = chunks.select("sign", F.explode(F.expr("flatten(transform(s, (x, i) -> transform(slice(s, i + 2, size(s)), y -> struct(x AS a, y AS b))))")).alias("p"))
        other = chunks.select(F.col("basket").alias("b2"), F.col("chunk").alias("c2"), F.col("s").alias("s2"))
        both = chunks.join(other, F.col("basket").eqNullSafe(F.col("b2")) & (F.col("chunk") < F.col("c2")))
        across = both.select("sign", F.explode(F.expr("flatten(transform(s, x -> transform(s2, y -> struct(least(x, y) AS a, greatest(x, y) AS b))))")).alias("p"))
        deltas = deltas.unionByName(within.unionByName(across).select("p.a", "p.b", F.col("sign").cast("long").alias("n")))
    return deltas.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n <> 0")


class PairCounts:
    """Counts of baskets, items and item pairs under a folder that all executors share. The number of buckets is fixed when
    the table is made."""

    KEYS = {"pairs": ["a", "b"], "items": ["item"]}
    SCHEMA = {"pairs": "a string, b string, n long", "items": "item string, n long"}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._state = {"version": -1, "baskets": 0, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "at": {"pairs": {}, "items": {}}}
        self._open()

    def _at(self, name: str):
        p = self._hadoop.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        p, fs = self._at("manifest")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getPath().getName().isdigit()) if fs.exists(p) else []

    def _open(self) -> None:
        if versions := self._versions():
            p, fs = self._at(f"manifest/{versions[-1]}")
            stream = fs.open(p)
            try:
                self._state = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()

    def _publish(self, state: dict) -> None:
        """Written under another name and renamed, so that a manifest is there whole or not at all."""
        temporary, fs = self._at(f"manifest/_{state['version']}")
        out = fs.create(temporary, True)
        try:
            out.write(json.dumps(state).encode())
        finally:
            out.close()
        if not fs.rename(temporary, self._at(f"manifest/{state['version']}")[0]):
            raise RuntimeError(f"version {state['version']} of {self.path} is there already: another writer?")
        self._state = state

    def _read(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame:
        at = {int(k): v for k, v in self._state["at"][name].items() if buckets is None or int(k) in buckets}
        if not at:
            return self.spark.createDataFrame([], self.SCHEMA[name])
        return self.spark.read.schema(self.SCHEMA[name]).parquet(*[f"{self.path}/{name}/version={v}/bucket={k}" for k, v in sorted(at.items())])

    def pairs(self) -> DataFrame:
        """a, b, n_ab"""
        return self._read("pairs").withColumnRenamed("n", "n_ab")

    def items(self) -> DataFrame:
        return self._read("items")

    def baskets(self) -> int:
        return self._state["baskets"]

    def _merge(self, name: str, delta: DataFrame, version: int) -> dict[str, int]:
        """Write the buckets that `delta` touches anew; returns the version of each bucket."""
        keys, n = self.KEYS[name], self._state["buckets"]
        bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
        touched = [r.bucket for r in delta.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return self._state["at"][name]
        # one task a bucket: hot items are spread over their partners' hash, and a pair is one row
        rows = self._read(name, touched).unionByName(delta).groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0").withColumn("bucket", bucket)
        rows.repartition(n, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{name}/version={version}")
        p, fs = self._at(f"{name}/version={version}")
        there = {f.getPath().getName()[7:] for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket=")}  # a bucket may have become empty
        kept = {k: v for k, v in self._state["at"][name].items() if int(k) not in touched}
        return kept | {k: version for k in there}

    def _deltas(self, new: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
        if old is None:
            signed = new.withColumn("sign", F.lit(1))
        else:
            sides = new.withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
            # order-free fingerprint of each side's item set: two independent 64-bit sums and the size
            def mark(s: int):
                mine = F.when(F.col("sign") == s, F.xxhash64("item").cast("decimal(38,0)"))
                salted = F.when(F.col("sign") == s, F.xxhash64(F.lit(7), "item").cast("decimal(38,0)"))
                return F.struct(F.coalesce(F.sum(mine), F.lit(0)).alias("h"), F.coalesce(F.sum(salted), F.lit(0)).alias("g"), F.count(F.when(F.col("sign") == s, 1)).alias("k"))

            changed = sides.groupBy("basket").agg(mark(1).alias("x"), mark(-1).alias("y")).filter("x <> y").select("basket")
            signed = durable(sides.join(changed, "basket", "left_semi").withColumn("basket", F.struct("sign", "basket")), "signed")
        sizes = basket_sizes(signed).agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("baskets"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
        n = F.sum("sign").cast("long").alias("n")
        return pair_deltas(signed, largest=sizes.largest), signed.groupBy("item").agg(n).filter("n <> 0"), sizes.baskets

    def update(self, new: DataFrame, old: DataFrame | None = None) -> int:
        """Apply a change; returns the new version.

        new and old hold (basket, item), distinct, for the baskets that the change names: their item sets
        after and before it. A basket in one of the two only appears or vanishes; one whose set is the same
        in both adds nothing, not even intermediate rows. Both are read more than once and should be written down.
        """
        self._open()
        version = self._state["version"] + 1
        pairs, items, baskets = self._deltas(new, old)
        at = {}
        for name, delta in (("pairs", pairs), ("items", items)):
            folder = f"{self.path}/delta/{name}/version={version}"
            delta.write.mode("overwrite").parquet(folder)
            at[name] = self._merge(name, self.spark.read.schema(self.SCHEMA[name]).parquet(folder), version)
        self._publish({**self._state, "version": version, "baskets": self._state["baskets"] + baskets, "at": at})
        return version

    def clean(self) -> None:
        """Remove versions of buckets, deltas and manifests that the last manifest does not name; readers of older ones lose them."""
        self._open()
        version = self._state["version"]
        for name, at in self._state["at"].items():
            p, fs = self._at(name)
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if int(f.getPath().getName()[8:]) not in at.values():
                    fs.delete(f.getPath(), True)
            p, fs = self._at(f"delta/{name}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f.getPath().getName() != f"version={version}":
                    fs.delete(f.getPath(), True)
        for v in self._versions()[:-1]:
            p, fs = self._at(f"manifest/{v}")
            fs.delete(p, False)

    def scores(self, touched_by: int | None = None) -> DataFrame:
        """Association table: a, b, n_ab, n_a, n_b, n, lift = n_ab * n / (n_a * n_b), pmi = log2(lift).

        With touched_by, a version, only pairs whose own count or an item's count moved in it. The number of
        baskets moves every lift by one common factor, so n comes as a column and lift is taken at read time.
        """
        pairs = self.pairs()
        if touched_by is not None:
            delta = lambda name: self.spark.read.schema(self.SCHEMA[name]).parquet(f"{self.path}/delta/{name}/version={touched_by}")
            moved = delta("items").select("item")
            flag = lambda c: moved.select(F.col("item").alias(c), F.lit(True).alias(f"moved_{c}"))
            own = delta("pairs").select("a", "b", F.lit(True).alias("own"))
            pairs = pairs.join(flag("a"), "a", "left").join(flag("b"), "b", "left").join(own, ["a", "b"], "left").filter("moved_a or moved_b or own").select("a", "b", "n_ab")
        items = self.items()
        n_a, n_b = items.select(F.col("item").alias("a"), F.col("n").alias("n_a")), items.select(F.col("item").alias("b"), F.col("n").alias("n_b"))
        lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
        return (
            pairs.join(n_a, "a").join(n_b, "b").withColumn("n", F.lit(self.baskets()).cast("long"))
            .select("a", "b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
        )
