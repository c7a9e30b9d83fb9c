"""Near-duplicate records by a multi-index Hamming join over b-bit minwise signatures.

A text is the set of its runs of `width` plain words. Its signature is `symbols` minwise hashes of that set, cut
to 16 bits each; two signatures are as far apart as the number of symbols in which they differ, on average
(1 - J) of them for sets of Jaccard similarity J. The signature is split into chunks of `chunk` symbols. By the
pigeonhole principle two signatures that differ in fewer than chunks * (errors + 1) symbols agree on some
chunk up to `errors` symbols, so each chunk is indexed under every way of leaving `errors` of its symbols out:
equal keys find every pair below that distance, and most pairs beyond it. Index rows carry a sketch, three bits of
each symbol, so that pairs are held against the whole signature where they are found; the ones left are verified by
their exact sets.

Texts with one and the same set are one class; only one of them takes part in the join.

Keys that are frequent within tasks are counted before the index is moved; those that surely have more than
`longest_run` texts are kept out of it. Rows of the index are 40 bytes and are sorted by key, in partitions whose number
follows its size; each task streams over runs of equal keys. A run that turns out longer is not paired there either. The
texts of all such keys are cut into blocks, and pairs of blocks are compared by sketch in tasks of their own, which
emit only pairs within reach. Nothing is dropped.

Groups are the connected components of the links, found by alternating star operations on written edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import batch_ids, mixed, window_hashes
from tidemark.session import durable


INDEX = "key long, id long, x0 long, x1 long, x2 long"
#: Bytes of the index in a partition, and the greatest number of partitions, beyond which they grow.
PARTITION, MOST_PARTITIONS = 32 << 20, 100_000


@dataclass(frozen=True)
class Plan:
    width: int = 5
    threshold: float = 0.8
    symbols: int = 60
    chunk: int = 4
    errors: int = 1
    longest_run: int = 20_000

    @property
    def guaranteed(self) -> int:
        """Largest signature distance at which no pair is missed."""
        return (self.symbols // self.chunk) * (self.errors + 1) - 1

    @property
    def reach(self) -> int:
        """Sketch distance up to which a found pair is verified: what similarity `threshold` makes expect and three
        deviations, and never less than `guaranteed`."""
        p = 0.875 * (1 - self.threshold)
        return min(self.symbols, max(self.guaranteed, int(np.ceil(self.symbols * p + 3 * np.sqrt(self.symbols * p * (1 - p))))))

    @property
    def masks(self) -> list[tuple[int, ...]]:
        """Symbols kept for each index key, chunk by chunk."""
        return [tuple(c + i for i in keep) for c in range(0, self.symbols, self.chunk) for keep in combinations(range(self.chunk), self.chunk - self.errors)]


def signatures(h: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """uint16 [texts, symbols] of the hashes of each text's set; no text is empty."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 2**32, symbols, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, symbols, dtype=np.uint64).astype(np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), symbols), np.uint16)
    with np.errstate(over="ignore"):
        for s in range(symbols):
            x = (low ^ b[s]) * a[s]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x85EBCA6B)
            m = np.minimum.reduceat(x, starts)
            out[:, s] = (m ^ (m >> np.uint32(16))).astype(np.uint16)
    return out


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's runs of `width` words, and where each text begins; a text of 1 to width - 1
    words is its one shorter run; a text without words has none."""
    ids, offsets = batch_ids(texts)
    h, at = window_hashes(ids, offsets, width)
    owner = np.searchsorted(offsets, at, side="right") - 1
    sizes = np.diff(offsets)
    short = np.nonzero((sizes > 0) & (sizes < width))[0]
    if len(short):
        extra = np.array([window_hashes(ids[offsets[i] : offsets[i + 1]], np.array([0, sizes[i]]), int(sizes[i]))[0][0] for i in short], np.uint64)
        h, owner = np.concatenate([h, extra]), np.concatenate([owner, short])
    o = np.lexsort((h, owner))
    h, owner = h[o], owner[o]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _sign(plan: Plan):
    """(text, *kept) batches to (*kept, set_a, set_b, n_shingles, sig); texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                h, starts = shingle_sets(b.column(0).to_pylist(), plan.width)
                n = np.diff(starts)
                keep = np.nonzero(n)[0]
                names = [*b.schema.names[1:], "set_a", "set_b", "n_shingles", "sig"]
                if not len(keep):
                    continue
                s = starts[:-1][keep]
                sig = signatures(h, s, plan.symbols)
                with np.errstate(over="ignore"):
                    set_a, set_b = np.add.reduceat(h, s), np.add.reduceat(mixed(h), s)
                kept = [c.take(pa.array(keep)) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array(n[keep].astype(np.int32)), pa.array([r.tobytes() for r in sig], pa.binary())], names=names
                )

    return run


def _sig_matrix(column: pa.Array, symbols: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, symbols)


def sketches(sig: np.ndarray) -> tuple[np.ndarray, ...]:
    """The three lowest bits of each symbol: three words a text."""
    place = np.arange(sig.shape[1], dtype=np.uint64)
    return tuple((((sig >> np.uint16(i)) & np.uint16(1)).astype(np.uint64) << place).sum(1, dtype=np.uint64).view(np.int64) for i in range(3))


def apart(x: list[np.ndarray], l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Number of symbols whose three bits differ between rows l and r; never more than the signature distance."""
    return np.bitwise_count((x[0][l] ^ x[0][r]) | (x[1][l] ^ x[1][r]) | (x[2][l] ^ x[2][r]))


def index_keys(plan: Plan, sig: np.ndarray) -> np.ndarray:
    """uint64 [texts, keys]"""
    keys = np.empty((len(sig), len(plan.masks)), np.uint64)
    wide = sig.astype(np.uint64)
    for k, mask in enumerate(plan.masks):
        x = np.full(len(sig), k + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in mask:
                x = x * np.uint64(0x9E3779B97F4A7C15) + wide[:, i]
        keys[:, k] = mixed(x)
    return keys


def _frequent(plan: Plan, least: int, together: int = 20_000):
    """(sig) batches to (key, n) of the keys that `least` or more of up to `together` texts of a task have."""

    def counted(sigs: list[np.ndarray]) -> pa.RecordBatch:
        k = np.sort(index_keys(plan, np.concatenate(sigs)).ravel())
        edges = np.nonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))[0]
        n = np.diff(edges)
        hit = n >= least
        return pa.RecordBatch.from_arrays([pa.array(k[edges[:-1][hit]].view(np.int64)), pa.array(n[hit].astype(np.int64))], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(_sig_matrix(b.column(0), plan.symbols))
            n += b.num_rows
            if n >= together:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    return run


def _keys(plan: Plan):
    """(id, sig) batches to a row (key, id, x0, x1, x2) for each index key, the rows of a text side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(plan.masks)
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                sig = _sig_matrix(b.column(1), plan.symbols)
                keys = index_keys(plan, sig)
                same = [b.column(0).to_numpy(zero_copy_only=False), *sketches(sig)]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), *[pa.array(np.repeat(c, n)) for c in same]], names=["key", "id", "x0", "x1", "x2"])

    return run


def _runs(plan: Plan):
    """(key, id, x0, x1, x2) sorted by key to the pairs (a, b) of ids under one key whose sketches are within reach; a null b
    marks the key of a run that is too long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [np.empty(0, np.int64)] * 5
        skipping: int | None = None

        def emit(k: np.ndarray, i: np.ndarray, *x: np.ndarray) -> pa.RecordBatch | None:
            edges = np.concatenate([[0], np.nonzero(k[1:] != k[:-1])[0] + 1, [len(k)]]) if len(k) else np.zeros(1, int)
            n = np.diff(edges)
            out = []
            for size in np.unique(n[(n > 1) & (n <= plan.longest_run)]):
                starts = edges[:-1][n == size]
                if size > 1000:  # strip by strip
                    for s in starts:
                        for lo in range(s, s + size, 100):
                            l, r = np.arange(lo, min(lo + 100, s + size))[:, None], np.arange(lo, s + size)
                            l, r = np.nonzero((apart(x, l, r) <= plan.reach) & (l < r))
                            l, r = i[lo + l], i[lo + r]
                            out.append(np.stack([np.minimum(l, r), np.maximum(l, r)], axis=1))
                    continue
                p, q = np.triu_indices(size, 1)
                step = max(1, 2_000_000 // len(p))  # pairs looked at together
                for lo in range(0, len(starts), step):
                    at = starts[lo : lo + step, None]
                    l, r = (at + p).ravel(), (at + q).ravel()
                    near = apart(x, l, r) <= plan.reach
                    l, r = i[l[near]], i[r[near]]
                    out.append(np.stack([np.minimum(l, r), np.maximum(l, r)], axis=1))
            long = k[edges[:-1][n > plan.longest_run]]
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            if not len(pairs) and not len(long):
                return None
            a = pa.array(np.concatenate([pairs[:, 0], long]))
            b = pa.array(np.concatenate([pairs[:, 1], np.zeros(len(long), np.int64)]), mask=np.arange(len(pairs) + len(long)) >= len(pairs))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)]
            if skipping is not None:  # the rest of a run already marked as too long
                past = np.searchsorted(cols[0], skipping, side="right")
                cols = [c[past:] for c in cols]
                if not len(cols[0]):
                    continue
                skipping = None
            cols = [np.concatenate([t, c]) for t, c in zip(tail, cols)]
            if not len(cols[0]):
                continue
            cut = np.searchsorted(cols[0], cols[0][-1], side="left")
            r = emit(*[c[:cut] for c in cols])
            if r is not None:
                yield r
            tail = [c[cut:] for c in cols]
            if len(tail[0]) > plan.longest_run:
                yield emit(*tail)
                skipping = int(tail[0][0])
                tail = [c[:0] for c in tail]
        r = emit(*tail)
        if r is not None:
            yield r

    return run


def _block_pairs(plan: Plan):
    """All (side, id, x0, x1, x2) of one pair of blocks to the pairs of ids within reach."""

    def run(t: pa.Table) -> pa.Table:
        ids, side, *x = (t[c].to_numpy() for c in ("id", "side", "x0", "x1", "x2"))
        left, right = np.nonzero(side <= 1)[0], np.nonzero(side >= 1)[0]  # side 1: both, a block with itself
        a, b = [], []
        for i in left:
            hit = ids[right[apart(x, i, right) <= plan.reach]]
            hit = hit[hit > ids[i]] if side[i] == 1 else hit[hit != ids[i]]
            a.append(np.full(len(hit), ids[i])), b.append(hit)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _exact(plan: Plan):
    """(a, b, sets of both as sorted hashes) to (a, b, similarity) at or above the threshold, a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                rows = big.slice(lo, 2000)
                sides = [rows.column(k).to_pylist() for k in (2, 3)]
                size = [np.fromiter((len(x) // 8 for x in side), np.int64, rows.num_rows) for side in sides]
                h = np.concatenate([np.frombuffer(b"".join(side), np.uint64) for side in sides])
                row = np.concatenate([np.repeat(np.arange(rows.num_rows), n) for n in size])
                o = np.lexsort((h, row))
                h, row = h[o], row[o]
                # a set has no hash twice, so neighbours that are equal are one of either side
                shared = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows.num_rows)
                sim = shared / (size[0] + size[1] - shared)
                keep = pa.array(np.nonzero(sim >= plan.threshold)[0])
                yield pa.RecordBatch.from_arrays([rows.column(0).take(keep), rows.column(1).take(keep), pa.array(sim).take(keep)], names=["a", "b", "similarity"])

    return run


def _sets(plan: Plan, wanted: np.ndarray, n_bits: int):
    """(text, h, *kept) to (*kept, set_a, bytes of the sorted set) for the texts whose h the bit table lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            place = big.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - n_bits)
            hit = np.nonzero((wanted[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))[0]
            for lo in range(0, len(hit), 2000):
                b = big.take(pa.array(hit[lo : lo + 2000]))
                h, starts = shingle_sets(b.column(0).to_pylist(), plan.width)
                sets = [h[x:y] for x, y in zip(starts, starts[1:])]
                with np.errstate(over="ignore"):
                    set_a = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(set_a), pa.array([x.tobytes() for x in sets], pa.binary())], names=[*b.schema.names[2:], "set_a", "elements"])

    return run


def bit_table(keys: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """A table of bits by the first bits of a hash, and their number: 16 bits a distinct key, at most 2 ** 27 (16 MB), beyond
    which more rows pass it. It only saves work; what passes is compared by full keys."""
    n = keys.count()
    n_bits = min(27, max(16, int(np.ceil(np.log2(16 * max(1, n))))))
    bits = keys.select(F.shiftrightunsigned(key, 64 - n_bits).alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    table = np.zeros(1 << (n_bits - 6), np.uint64)
    got = bits.toArrow()  # at most 2 ** (n_bits - 6) rows
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return table, n_bits


def near_duplicates(rows: DataFrame, *, key: str, text: str, version: str | None = None, plan: Plan = Plan(), blocks: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: key, class_id, copy, representative (bool), a row per distinct non-null key whose text has
    words. links: a, b, similarity for each two classes whose sets reach plan.threshold, a < b.

    class_id is the id of a class of texts with one and the same set; copy is one value for byte-equal texts. Where a
    key comes with several texts the one with the greatest `version` counts, a null version being the least; of those the one
    with the greatest set fingerprint. Defined cases: null, empty and markup-only texts have no words and are left out; texts
    shorter than plan.width words are one run; equal texts are one class and no link; rows with a null key are left out;
    an empty table gives empty results; columns not named are not read, so their names may clash with anything.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(text).alias("text"), F.col(key).alias("key"), (F.col(version) if version else F.lit(None).cast("string")).alias("version")).filter("key is not null and text is not null")
    vt = src.schema["version"].dataType.simpleString()
    signed = src.withColumn("copy", F.xxhash64("text")).mapInArrow(_sign(plan), f"key string, version {vt}, copy long, set_a long, set_b long, n_shingles int, sig binary")
    one = signed.groupBy("key").agg(F.max(F.struct("version", "set_a", "set_b", "copy", "sig")).alias("m"))
    # from here on an id names a key, for good: the numbering is written down
    keyed = durable(one.select("key", "m.version", "m.set_a", "m.set_b", "m.copy", "m.sig", F.monotonically_increasing_id().alias("id")), "signed")
    classes = keyed.groupBy("set_a", "set_b").agg(F.min("id").alias("class_id"))
    reps = keyed.select("id", "sig").join(classes.select(F.col("class_id").alias("id")), "id", "left_semi")
    members = keyed.join(classes, ["set_a", "set_b"]).select("key", "class_id", "copy", (F.col("id") == F.col("class_id")).alias("representative"))

    # a sum of counts within tasks is never above the true one
    hot = keyed.select("sig").mapInArrow(_frequent(plan, min(64, plan.longest_run + 1)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > plan.longest_run).select("key")
    hot = durable(hot, "hot-keys")
    index = reps.mapInArrow(_keys(plan), INDEX)
    if not hot.isEmpty():
        index = index.join(hot, "key", "left_anti")
    parts = min(MOST_PARTITIONS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), keyed.count() * len(plan.masks) * 40 // PARTITION))
    found = durable(index.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_runs(plan), "a long, b long").distinct(), "found")
    pairs = found.filter("b is not null")
    long = found.filter("b is null").select(F.col("a").alias("key")).unionByName(hot)
    if not long.isEmpty():
        pairs = durable(pairs.unionByName(_long_runs(reps, long, plan, blocks)).distinct(), "near")

    # exact sets of the texts that are left; texts are read again rather than moved
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(keyed.select("id", F.col("key").alias("k"), F.col("version").alias("v"), F.col("set_a").alias("w")), "id")
    wanted = durable(wanted.withColumn("h", F.xxhash64("k")), "wanted")
    sets = src.select("text", F.xxhash64("key").alias("h"), "key", "version").mapInArrow(_sets(plan, *bit_table(wanted, "h")), f"key string, version {vt}, set_a long, elements binary")
    same = (F.col("key") == F.col("k")) & F.col("version").eqNullSafe(F.col("v")) & (F.col("set_a") == F.col("w"))
    sets = sets.join(wanted, same).groupBy("id").agg(F.first("elements").alias("elements"))  # rows of one id have one set
    ea, eb = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))
    links = pairs.join(ea, "a").join(eb, "b").select("a", "b", "ea", "eb").mapInArrow(_exact(plan), "a long, b long, similarity double")
    return members, links


def _long_runs(reps: DataFrame, long: DataFrame, plan: Plan, blocks: int) -> DataFrame:
    """Pairs within reach among the texts of each long run, in blocks of about `blocks` texts."""
    rows = reps.mapInArrow(_keys(plan), INDEX).join(long, "key").distinct()
    n = rows.groupBy("key").agg(F.ceil(F.count("*") / blocks).cast("int").alias("n"))
    rows = rows.join(n, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    spread = rows.select("key", "id", "x0", "x1", "x2", "block", others).select(
        "key", "id", "x0", "x1", "x2", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.when(F.col("block") == F.col("other"), 1).when(F.col("block") < F.col("other"), 0).otherwise(2).alias("side")
    )
    return spread.groupBy("key", "x", "y").applyInArrow(_block_pairs(plan), "a long, b long")


def class_pairs(members: DataFrame, links: DataFrame, expand: int = 64) -> DataFrame:
    """(key_a, key_b), key_a < key_b by bytes, of keys whose texts are linked or have one set.

    All pairs between different texts are written. Byte-equal texts are written out in full up to `expand` keys; the keys
    of a larger group of copies are each paired with its least key, which stands for them in all other pairs, so that no
    link between different texts is lost and no group of copies is squared.
    """
    copies = members.groupBy("class_id", "copy").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    layouts = copies.groupBy("class_id").agg(F.count("*").alias("layouts")).filter("layouts > 1").select("class_id")
    m = members.select("class_id", "copy", "key").join(copies, ["class_id", "copy"])
    some = m.filter((F.col("n") <= expand) | (F.col("key") == F.col("first"))).select("class_id", "copy", "key")
    several = m.filter("n > 1")
    small, large = several.filter(F.col("n") <= expand).select("class_id", "copy", "key"), several.filter((F.col("n") > expand) & (F.col("key") != F.col("first")))
    equal = small.join(small.withColumnRenamed("key", "other"), ["class_id", "copy"]).filter("key < other").select("key", "other").unionByName(large.select("key", F.col("first").alias("other")))
    mixed_ = some.join(layouts, "class_id", "left_semi")
    alike = mixed_.join(mixed_.select("class_id", F.col("copy").alias("copy2"), F.col("key").alias("other")), "class_id").filter("copy <> copy2 and key < other").select("key", "other")
    la = some.select(F.col("class_id").alias("a"), F.col("key").alias("ka"))
    lb = some.select(F.col("class_id").alias("b"), F.col("key").alias("kb"))
    across = links.join(la, "a").join(lb, "b").select(F.col("ka").alias("key"), F.col("kb").alias("other"))
    both = equal.unionByName(alike).unionByName(across)
    return both.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) of each node of the edges (a, b): root is the least node of its connected component.

    Rounds of large-star and small-star operations; each is written down, and the rounds end when one changes nothing.
    Minima are taken map-side first, and a node of very many edges is one key of a join, which the adaptive planner
    splits. Self-links and repeated edges change nothing; no edges give no rows.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = lambda x: tuple(x.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first())
    before = state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = durable(small.filter("u <> v").distinct(), "small-star")
        after = state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, group_id, size: each key's group of records linked directly or through others, named by its least class."""
    root = components(links.select("a", "b"))
    g = members.join(root, F.col("class_id") == F.col("node"), "left").select("key", F.coalesce("root", "class_id").alias("group_id"))
    return g.join(g.groupBy("group_id").agg(F.count("*").alias("size")), "group_id").select("key", "group_id", "size")
