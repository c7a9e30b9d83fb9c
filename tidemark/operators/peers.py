"""The most similar entities by items in common, where items are few and entities many: most pairs share something, so
pairs are counted by matrix products inside a task and only the best of each entity leave it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import global_row_number
from tidemark.session import by_merge, durable

#: Bits of a score: thousandths of similarity above the number shared above the number of the entity, counted down.
SHARED, NUMBER = 20, 33
#: Entities of the stream that are held against a block at once.
STEP = 2048


class _Block:
    """Entities of one block with the best scores met so far."""

    def __init__(self, number: np.ndarray, size: np.ndarray, code: np.ndarray, least_shared: int, least: float, k: int):
        self.number, self.size, self.least_shared, self.k = number, size, least_shared, k
        self.floor = int(np.ceil(least * 1000 - 1e-9))
        self.items, at = np.unique(code, return_inverse=True)
        self.bits = np.zeros((len(number), len(self.items)), np.float32)
        self.bits[np.repeat(np.arange(len(number)), size), at] = 1
        self.best = np.full((len(number), k), -1, np.int64)
        self.step = 64  # few at first: until each has its k, nearly all are candidates

    def meet(self, number: np.ndarray, size: np.ndarray, code: np.ndarray) -> None:
        ends = np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(number):
            hi = min(lo + self.step, len(number))
            self._some(number[lo:hi], size[lo:hi], code[ends[lo] : ends[hi]])
            lo, self.step = hi, min(2 * self.step, STEP)

    def _some(self, number: np.ndarray, size: np.ndarray, code: np.ndarray) -> None:
        row = np.repeat(np.arange(len(number)), size)
        at = np.minimum(np.searchsorted(self.items, code), len(self.items) - 1)
        mine = self.items[at] == code
        bits = np.zeros((len(number), len(self.items)), np.float32)
        bits[row[mine], at[mine]] = 1
        shared = self.bits @ bits.T  # whole numbers below 2^24, so exact
        # what can't reach the k-th best is dropped, with room for the error of float32; the rest is judged in integers
        last = self.best[:, -1]
        bound = (np.maximum(self.floor, np.where(last < 0, 0, last >> (SHARED + NUMBER))) - 0.5) / 1000
        bound = (bound / (1 + bound)).astype(np.float32) * np.float32(1 - 1e-5)
        e, f = np.nonzero(shared >= np.maximum(bound[:, None] * (self.size[:, None] + size[None, :]).astype(np.float32), np.float32(self.least_shared)))
        s = shared[e, f].astype(np.int64)
        united = self.size[e] + size[f] - s
        score = ((2000 * s + united) // (2 * united) << (SHARED + NUMBER)) | (s << NUMBER) | (2**NUMBER - 1 - number[f])
        keep = (score >> (SHARED + NUMBER) >= self.floor) & (score > last[e]) & (self.number[e] != number[f])
        if keep.any():
            self._add(e[keep], score[keep])

    def _add(self, e: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(e)
        e, score = np.concatenate([np.repeat(rows, self.k), e]), np.concatenate([self.best[rows].ravel(), score])
        order = np.lexsort((-score, e))
        e, score = e[order], score[order]
        place = np.arange(len(e)) - np.searchsorted(e, e)
        self.best[e[place < self.k], place[place < self.k]] = score[place < self.k]

    def rows(self) -> pa.RecordBatch:
        e, place = np.nonzero(self.best >= 0)
        score = self.best[e, place]
        peer = 2**NUMBER - 1 - (score & (2**NUMBER - 1))
        columns = [self.number[e], peer, (score >> NUMBER) & (2**SHARED - 1), score >> (SHARED + NUMBER)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "peer", "shared", "thousandths"])


def _best(least_shared: int, least: float, k: int):
    """(block, own, number, codes), a block's rows side by side with its own first, to the best k of each of its own."""

    def parts(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            p, own = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (own[1:] != own[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi > lo:
                    codes = b.column(3).slice(lo, hi - lo)
                    yield int(p[lo]), bool(own[lo]), b.column(2).to_numpy()[lo:hi], codes.value_lengths().to_numpy().astype(np.int64), codes.flatten().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None

        def made() -> _Block:
            own = [np.concatenate(x) for x in zip(*held)]
            b = _Block(*own, least_shared, least, k)
            b.meet(*own)
            return b

        for p, own, *rows in parts(batches):
            if p != at:
                if held:
                    yield (block or made()).rows()
                at, held, block = p, [], None
            if own:
                held.append(rows)
            else:
                block = block or made()
                block.meet(*rows)
        if held:
            yield (block or made()).rows()

    return run


def nearest_peers(sets: DataFrame, *, entity: str, item: str, least_shared: int, least: float, k: int, block: int = 4000) -> DataFrame:
    """Up to k most similar entities of each entity by Jaccard similarity of item sets, ties by name: as
    relational.jaccard_peers, without a row for each pair and item.

    Entities are numbered in their order and cut into blocks. A task holds the items of one block and meets all entities
    as a stream, so n entities give n * n / block rows to shuffle, and k rows each come back. A set must have fewer than 2^20 items.
    """
    s = sets.select(F.col(entity).alias("e"), F.col(item).alias("i")).filter("e is not null and i is not null").distinct()
    s = durable(s, "entity-items")
    codes = global_row_number(s.select("i").distinct(), [F.col("i")], "code")
    lists = s.join(by_merge(codes), "i").groupBy("e").agg(F.collect_list(F.col("code").cast("int")).alias("codes")).filter(F.size("codes") >= least_shared)
    numbered = durable(global_row_number(durable(lists, "item-lists"), [F.col("e")], "number"), "numbered")
    n, largest = numbered.agg(F.count("*"), F.coalesce(F.max(F.size("codes")), F.lit(0))).first()
    if largest >= 2**SHARED or n >= 2**NUMBER:
        raise ValueError(f"{n} entities, {largest} items in the largest: beyond what a score can hold")
    blocks = max(1, -(-n // block))
    each = numbered.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "number", "codes")
    each = each.select("block", (F.floor((F.col("number") - 1) / block) == F.col("block")).cast("int").alias("own"), F.col("number").cast("long").alias("number"), "codes")
    best = each.repartition(blocks, "block").sortWithinPartitions("block", F.col("own").desc()).mapInArrow(_best(least_shared, least, k), "number long, peer long, shared long, thousandths long")
    named = numbered.select("number", "e")
    out = best.join(by_merge(named), "number").join(by_merge(named.select(F.col("number").alias("peer"), F.col("e").alias("name"))), "peer")
    out = out.select("e", F.col("name").alias("peer"), "shared", (F.col("thousandths") / 1000).alias("similarity"))
    w = Window.partitionBy("e").orderBy(F.col("similarity").desc(), F.col("shared").desc(), "peer")
    return out.withColumn("peer_rank", F.row_number().over(w)).withColumnRenamed("e", entity)
