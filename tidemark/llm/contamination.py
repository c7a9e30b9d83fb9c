"""Evaluation texts leaking into a corpus, by greedy string tiling.

1. Seeds. Each item's windows of `seed` plain words are hashed by a Karp-Rabin value. Every text of the corpus
   is read whole and its windows are hashed the same way; seeds that both share are where tiles can begin.
2. Tiling. In the same pass, for each item that shares a seed with the document, the longest common stretch of
   unmarked words is marked, again and again, until none of `seed` words is left. The words of every tile are
   compared, so a hash collision cannot make one. Marked words are taken out on both sides, so tiles do not overlap
   and may come in any order.

The corpus is read once for each slice of at most `slice_seeds` item seeds, and is not shuffled: the words and seeds of a
slice are what a task holds. Slices of any number give the same rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import batch_ids, plain_words, slices, window_hashes

#: Some 40 bytes a seed with the item's words: at most 80 MB in a task.
SLICE_SEEDS = 2_000_000


def _runs(place_d: np.ndarray, place_i: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches (start in doc, start in item, length) of seeds side by side on one diagonal."""
    o = np.lexsort((place_d, place_d - place_i))
    d, i = place_d[o], place_i[o]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1] + 1) | (i[1:] != i[:-1] + 1)
    at = np.nonzero(first)[0]
    return d[at], i[at], np.diff(np.append(at, len(d))) + least - 1


def _mark(runs: list[tuple[int, int, int]], n_doc: int, n_item: int, least: int) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles of common stretches, longest first; ties go to the earlier place in doc, then in item."""
    used_d, used_i = np.zeros(n_doc, bool), np.zeros(n_item, bool)
    heap = [(-n, p, q) for p, q, n in runs]
    heapq.heapify(heap)
    out = []
    while heap:
        n, p, q = heapq.heappop(heap)
        n = -n
        busy = used_d[p : p + n] | used_i[q : q + n]
        if not busy.any():
            used_d[p : p + n] = used_i[q : q + n] = True
            out.append((p, q, n))
            continue
        edges = np.nonzero(np.diff(np.concatenate([[1], busy.astype(np.int8), [1]])))[0]
        for lo, hi in zip(edges[::2], edges[1::2]):
            if hi - lo >= least:
                heapq.heappush(heap, (-int(hi - lo), p + int(lo), q + int(lo)))
    return out


class Items:
    """The seeds and words of a slice of items."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.least, self.ids = least, np.array(ids, np.int64)
        self.words = [plain_words(t) for t in texts]
        word_ids, offsets = batch_ids(texts)
        h, at = window_hashes(word_ids, offsets, least)
        owner = np.searchsorted(offsets, at, side="right") - 1
        o = np.argsort(h, kind="stable")
        self.h, self.owner, self.place = h[o], owner[o], (at - offsets[owner])[o]
        self.size = np.diff(offsets)
        # a table of bits that lets few windows of other texts through
        self.bits = max(16, int(np.ceil(np.log2(max(1, 16 * len(h))))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.h >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def shared(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Sorted by (text, item): text, item, place in the text, place in the item of each shared seed; and the texts' sizes."""
        word_ids, offsets = batch_ids(texts)
        h, at = window_hashes(word_ids, offsets, self.least)
        maybe = np.nonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])[0]
        h, at = h[maybe], at[maybe]
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        n = hi - lo
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(at, n)
        text = np.searchsorted(offsets, at, side="right") - 1
        o = np.lexsort((self.owner[k], text))
        return text[o], self.owner[k][o], (at - offsets[text])[o], self.place[k][o], np.diff(offsets)

    def tiles(self, texts: list[str], longest: int, coverage: float) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """(text, item, tiles) of each two whose longest tile has `longest` words or whose tiles can cover `coverage` of the item."""
        text, item, d, i, sizes = self.shared(texts)
        edges = np.nonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))[0] if len(text) else np.empty(0, np.int64)
        out = []
        words: tuple[int, list[str]] = (-1, [])
        for a, b in zip(edges, np.append(edges[1:], len(text))):
            t, k = int(text[a]), int(item[a])
            p, q, n = _runs(d[a:b], i[a:b], self.least)
            # words of the item that any stretch covers: no tiling covers more
            step = np.zeros(self.size[k] + 1, np.int64)
            np.add.at(step, q, 1)
            np.add.at(step, q + n, -1)
            if n.max() < longest and (np.cumsum(step) > 0).sum() < coverage * self.size[k]:
                continue
            if words[0] != t:
                words = (t, plain_words(texts[t]))
            same = [(x, y, z) for x, y, z in zip(p.tolist(), q.tolist(), n.tolist()) if words[1][x : x + z] == self.words[k][y : y + z]]
            if found := _mark(same, int(sizes[t]), int(self.size[k]), self.least):
                out.append((t, k, found))
        return out


def tiles(doc: str, item: str, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two texts: (start in doc, start in item, length) in plain words, longest first."""
    found = Items([0], [item], least).tiles([doc], 0, 0.0)
    return found[0][2] if found else []


def _tile(items: Items, longest: int, coverage: float):
    """(id, text) batches to a row for each item of the slice that a text shares enough with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t, k, found in items.tiles(b.column(1).to_pylist(), longest, coverage):
                total = sum(n for _, _, n in found)
                rows.append((t, int(items.ids[k]), len(found), max(n for _, _, n in found), total, total / int(items.size[k])))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], types)]], names=["doc_id", "item_id", "n_tiles", "longest", "covered_words", "coverage"])

    return run


def tile_overlaps(docs: DataFrame, items: DataFrame, *, seed: int = 13, longest: int = 0, coverage: float = 0.0, slice_seeds: int = SLICE_SEEDS) -> DataFrame:
    """doc_id, item_id, n_tiles, longest, covered_words, coverage for each document and item that share a
    stretch of at least `seed` plain words. coverage is the share of the item's words that lie in tiles. Pairs without
    a stretch of `longest` words whose stretches cover less than `coverage` of the item are left out early.

    docs: doc_id bigint, text; items: item_id bigint, text; other columns are not read, whatever their names.
    Defined cases: null or empty texts, and texts shorter than `seed` words, match nothing; documents with
    equal text give a row each; of a repeated doc_id the text with the greatest coverage counts, of a repeated item_id the
    least text; rows with a null id are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    # characters bound words and seeds; slices by the sum of them
    whole = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-whole // (2 * slice_seeds)))
    schema = "doc_id long, item_id long, n_tiles int, longest int, covered_words int, coverage double"
    found = []
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()  # about `slice_seeds` seeds
        found.append(docs.mapInArrow(_tile(Items([r.item_id for r in rows], [r.text for r in rows], seed), longest, coverage), schema))
    best = F.max(F.struct("coverage", "longest", "covered_words", "n_tiles")).alias("m")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.n_tiles", "m.longest", "m.covered_words", "m.coverage")


def leaked(docs: DataFrame, items: DataFrame, *, seed: int = 6, coverage: float = 0.5, passage: int = 13, **kw) -> DataFrame:
    """Documents that hold a passage of at least `passage` consecutive words of an item, or in which tiles of at
    least `seed` words cover at least `coverage` of it, in any order. The longest tile is the longest common stretch
    if `seed` is not above `passage`."""
    found = tile_overlaps(docs, items, seed=seed, longest=passage, coverage=coverage, **kw)
    return found.filter((F.col("longest") >= passage) | (F.col("coverage") >= coverage))
