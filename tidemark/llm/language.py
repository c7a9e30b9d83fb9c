"""Language of documents and of their paragraphs, by rank-order n-gram profiles.

A language's profile is its `profile_size` most frequent character n-grams (1 to 4 letters, words padded with
blanks) in rank order, counted over every document whose label names that language; wrong labels are a small
share and do not reach the top of a profile. All n-grams of a text are ranked the same way, those of profiles before
others of the same count, and the out-of-place distance to a profile is the sum of the rank differences over the
profile_size first ones, profile_size for an n-gram that the profile lacks. N-grams that no profile has take their places in
the ranking; what they add, the same to every distance, is left out of it. The nearest profile wins; confidence is its
lead over the next one as a share of that one's distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANGUAGES = ["de", "en", "es", "fr", "nl", "pt"]

# ISO 639 codes and names, English and native, of the six languages.
SPELLINGS = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands", "flemish"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
}

LONGEST = 4
#: Letters that have a place of their own in n-grams, after the blank; all others share the last of 64 places.
ALPHABET = " abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœß"
SEP = "\x01"
#: Paragraphs looked at together.
TOGETHER = 400

_MARKUP = re.compile(r"<[^<>]*>|&[A-Za-z][A-Za-z0-9]*;|&#[0-9]+;")
_BLANK_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")


def label_code(c) -> F.Column:
    """Two-letter code that a label spells, whatever its case and region suffix; null if it names none of the six."""
    base = F.regexp_replace(F.lower(F.trim(c)), r"[-_].*$", "")
    pairs = [F.lit(x) for code, names in SPELLINGS.items() for name in names for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), F.coalesce(base, F.lit("")))


def paragraphs(text: str) -> list[str]:
    """Stretches between lines that hold nothing but blanks."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [p for p in _BLANK_LINES.split("\n" + text + "\n") if p.strip()]


_table: list[np.ndarray] = []


def letters(texts: list[str]) -> np.ndarray:
    """Places of the letters of all texts in lower case, 64 between texts; each text is padded with blanks, and
    whatever is not a letter is a blank, several blanks being one. Markup is left out."""
    if not _table:
        t = np.zeros(0x110000, np.uint8)
        t[[i for i in range(0x110000) if chr(i).isalpha()]] = 63
        for place, c in enumerate(ALPHABET):
            t[ord(c)] = place
        t[ord(SEP)] = 64
        _table.append(t)
    clean = [t.lower().replace(SEP, " ") for t in texts]
    clean = [_MARKUP.sub(" ", t) if "<" in t or "&" in t else t for t in clean]
    c = _table[0][np.frombuffer(f" {f' {SEP} '.join(clean)} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    return c[keep]


def gram_codes(c: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1: n, the codes (n places of 6 bits) of all n-grams within one text but the lone blank, and where each begins."""
    wide = c.astype(np.uint32)
    code, whole = np.zeros(len(c), np.uint32), np.ones(len(c), bool)
    for n in range(1, min(LONGEST, len(c)) + 1):  # each n-gram is the one before it and a letter
        m = len(c) - n + 1
        code = code[:m] << np.uint32(6) | wide[n - 1 :]
        whole = whole[:m] & (c[n - 1 :] != 64)
        at = np.flatnonzero(whole & (c != 0) if n == 1 else whole)
        yield n, code[at], at


def gram_counts(c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct n-grams, as n and their code, and how often each occurs; an entry for each n."""
    grams, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for n, code, _ in gram_codes(c):
        if n < 4:
            all_ = np.bincount(code, minlength=1)
            found = np.flatnonzero(all_)
            grams.append(found.astype(np.uint32) + np.uint32(n << 6 * n)), counts.append(all_[found])
        else:
            found, k = np.unique(code, return_counts=True)
            grams.append(found + np.uint32(n << 6 * n)), counts.append(k)
    return grams, counts


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    o = np.argsort(code, kind="stable")
    code, n = code[o], n[o]
    first = np.nonzero(np.concatenate([[True], code[1:] != code[:-1]]))[0] if len(code) else np.empty(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, text) to the n-gram counts of each language; a task holds the counts of its n-grams only."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for big in batches:
        for lo in range(0, big.num_rows, 1000):
            b = big.slice(lo, 1000)
            by: dict[str, list[str]] = {}
            for code, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(code, []).append(text)
            for code, texts in by.items():
                grams, n = gram_counts(letters(texts))
                if code in held:
                    grams.append(held[code][0]), n.append(held[code][1])
                held[code] = _summed(grams, n)
    for code, (grams, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([code] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n.astype(np.int64))], names=["code", "gram", "n"])


def profiles(docs: DataFrame, *, profile_size: int = 500) -> dict[str, list[int]]:
    """The ranked n-grams of each language found among the labels, as codes; at most 6 x profile_size of them."""
    labelled = docs.select(label_code(F.col("lang")).alias("code"), "text").filter("code is not null and text is not null")
    counts = labelled.mapInArrow(_count, "code string, gram int, n long").groupBy("code", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("code").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= profile_size)
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r.code, r.rank)):
        out.setdefault(r.code, []).append(r.gram)
    return out


class Ranker:
    """Out-of-place distances of texts to a set of profiles, over the n-grams that any profile has."""

    def __init__(self, known: dict[str, list[int]], profile_size: int):
        self.langs, self.k = sorted(known), profile_size
        self.vocabulary = np.unique(np.concatenate([np.array(known[x], np.int64) for x in self.langs] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.vocabulary)), -1, np.int16 if profile_size < 1 << 15 else np.int32)
        for j, lang in enumerate(self.langs):
            self.ranks[j, np.searchsorted(self.vocabulary, known[lang])] = np.arange(len(known[lang]))
        self.place = []  # for each n, from code to place in the vocabulary
        for n in range(1, LONGEST + 1):
            t = np.full(1 << 6 * n, -1, np.int16)
            mine = np.nonzero(self.vocabulary >> 6 * n == n)[0]
            t[self.vocabulary[mine] - (n << 6 * n)] = mine
            self.place.append(t)

    def grams(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(text, place in the vocabulary) of each n-gram that a profile has, and (text, code) of all others."""
        c = letters(texts)
        owner = np.cumsum(c == 64)
        known, other = [], []
        for n, code, at in gram_codes(c):
            place = self.place[n - 1].take(code)
            hit = place >= 0
            known.append((owner[at[hit]], place[hit]))
            at = at[~hit]
            other.append((owner[at], code[~hit] | np.uint32(n << 6 * n)))
        return [np.concatenate(x) for x in zip(*known)], [np.concatenate(x) for x in zip(*other)]

    def counts(self, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """[n, vocabulary]"""
        g = len(self.vocabulary)
        return np.bincount(owner * g + place, minlength=n * g).reshape(n, g)

    def nearest(self, counts: np.ndarray, row_o: np.ndarray, n_o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest language (ties by code) and its confidence; (-1, 0) for rows without known n-grams.
        row_o, n_o: row and count, 2 or more, of each n-gram that no profile has and that is repeated."""
        best, lead = np.full(len(counts), -1), np.zeros(len(counts))
        flat, g = counts.ravel(), np.int64(counts.shape[1])
        at = np.flatnonzero(flat != 0)
        if not len(at):
            return best, lead
        row = at // g  # rising, before the sort and after it
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
        start, size = edges[:-1], np.diff(edges)
        rows = row[start]
        # one number holds row, falling count and place: 20, 28 and 16 bits
        most = np.int64((1 << 28) - 1)
        falling = lambda r, n: r << 28 | (most - np.minimum(n, most))
        k = falling(row, flat[at]).astype(np.uint64) << np.uint64(16)
        k |= (at - row * g).astype(np.uint64)
        k.sort()
        col = (k & np.uint64(0xFFFF)).astype(np.int64)
        mine = np.arange(len(row)) - np.repeat(start, size)
        if len(row_o):  # others of a greater count come before; all of a row do where the count is 1
            o = np.sort(falling(row_o, n_o))
            ends = np.searchsorted(o, np.stack([rows << 28, (rows + 1) << 28]), "left")
            mine += np.repeat(ends[1] - ends[0], size)
            k >>= np.uint64(16)
            more = np.flatnonzero((k & np.uint64(most)) != np.uint64(most - 1))
            mine[more] += np.searchsorted(o, k[more].astype(np.int64), "left") - np.repeat(ends[1], size)[more]
        # a language at a time, over the first k of each row; a row may have none of a profile among them
        top = mine < self.k
        if not top.all():
            keep = np.add.reduceat(top.astype(np.int64), start)
            rows, col, mine = rows[keep > 0], col[top], mine[top]
            keep = keep[keep > 0]
            start = np.cumsum(keep) - keep
            if not len(rows):
                return best, lead
        kind = self.ranks.dtype.type
        mine = mine.astype(kind)
        d = np.empty((len(rows), len(self.langs)), np.int64)
        for j in range(len(self.langs)):
            theirs = self.ranks[j].take(col)
            d[:, j] = np.add.reduceat(np.where(theirs < 0, kind(self.k), np.abs(theirs - mine)), start, dtype=np.int64)
        best[rows] = d.argmin(1)
        two = np.partition(d, min(1, d.shape[1] - 1), axis=1)
        lead[rows] = 1.0 if d.shape[1] == 1 else np.where(two[:, 1] > 0, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1), 0.0)
        return best, lead


def repeated(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, count) of each two of them."""
    k = np.sort(owner.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64))
    edges = np.nonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))[0] if len(k) else np.zeros(1, np.int64)
    first = k[edges[:-1]]
    return (first >> np.uint64(32)).astype(np.int64), (first & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.diff(edges)


def _assign(known: dict[str, list[int]], profile_size: int, least_lead: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(known, profile_size)
        name = [*rank.langs, None]
        for big in batches:
            parts = [paragraphs(t) for t in big.column(2).to_pylist()]
            lo = 0
            while lo < len(parts):
                hi, n = lo + 1, len(parts[lo])
                while hi < len(parts) and hi - lo < TOGETHER and n + len(parts[hi]) <= TOGETHER:
                    n += len(parts[hi])
                    hi += 1
                yield batch(rank, name, big.slice(lo, hi - lo), parts[lo:hi])
                lo = hi

    def batch(rank: Ranker, name: list, b: pa.RecordBatch, parts: list[list[str]]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts])
        doc = np.repeat(np.arange(len(parts)), sizes)
        flat = [p for x in parts for p in x]
        if not flat or not rank.langs:
            own = whole = np.full(len(flat), -1)
            lead = whole_lead = np.zeros(len(flat))
        else:
            # a document of many paragraphs is taken in pieces; one of a single paragraph is judged once
            several = np.nonzero(sizes > 1)[0]
            at = np.full(len(parts), -1)
            at[several] = np.arange(len(several))
            total, others, own, lead = np.zeros((len(several), len(rank.vocabulary)), np.int64), [], [], []
            for i in range(0, len(flat), TOGETHER):
                part = flat[i : i + TOGETHER]
                (owner, place), (owner_o, code_o) = rank.grams(part)
                counts = rank.counts(owner, place, len(part))
                row_o, code_o, n_o = repeated(owner_o, code_o)
                more = n_o > 1  # what occurs once stands behind all n-grams of profiles
                x, y = rank.nearest(counts, row_o[more], n_o[more])
                own.append(x), lead.append(y)
                of = at[doc[i : i + TOGETHER]]
                np.add.at(total, of[of >= 0], counts[of >= 0])
                whole_o = of[row_o]
                others.append((whole_o[whole_o >= 0], code_o[whole_o >= 0], n_o[whole_o >= 0]))
            own, lead = np.concatenate(own), np.concatenate(lead)
            first = np.cumsum(sizes) - sizes
            d, d_lead = own[np.minimum(first, len(own) - 1)], lead[np.minimum(first, len(own) - 1)]
            if len(several):
                row_o, code_o, n_o = (np.concatenate(x) for x in zip(*others))
                k = row_o.astype(np.uint64) << np.uint64(32) | code_o.astype(np.uint64)
                o = np.argsort(k, kind="stable")
                k, n_o = k[o], n_o[o]
                edges = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.empty(0, np.int64)
                n_o = np.add.reduceat(n_o, edges) if len(edges) else n_o
                row_o = (k[edges] >> np.uint64(32)).astype(np.int64)
                d[several], d_lead[several] = rank.nearest(total, row_o[n_o > 1], n_o[n_o > 1])
            whole, whole_lead = d[doc], d_lead[doc]
            keep = (own >= 0) & ((lead >= least_lead) | (own == whole))
            own = np.where(keep, own, whole)
        first = np.cumsum(sizes) - sizes
        mixed = np.zeros(len(parts), bool)
        np.logical_or.at(mixed, doc, own != own[first[doc]] if len(own) else np.empty(0, bool))
        take = pa.array(doc)
        named = lambda i: pa.array([name[k] for k in i], pa.string())
        cols = [b.column(0).take(take), pa.array((np.arange(len(doc)) - first[doc] + 1).astype(np.int32)), named(own), pa.array(lead), named(whole), pa.array(whole_lead), b.column(1).take(take), pa.array(mixed[doc])]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "segment_no", "lang", "confidence", "doc_lang", "doc_confidence", "label", "mixed"])

    return run


def segment_languages(docs: DataFrame, *, known: dict[str, list[int]] | None = None, profile_size: int = 500, least_lead: float = 0.02) -> DataFrame:
    """A row per paragraph: doc_id, segment_no (from 1), lang, confidence, doc_lang, doc_confidence, label (the code
    the given lang spells), mixed.

    A paragraph whose lead is under `least_lead` takes the language of its document. Reads doc_id, text and lang;
    other columns are not read, whatever their names. Defined cases: null or blank texts have no paragraphs and
    give no rows; a paragraph without known n-grams takes its document's language with confidence 0, which is null if
    the document has none either; with no usable label in the table there are no profiles and lang is null throughout;
    repeated rows give repeated results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    if known is None:
        known = profiles(docs, profile_size=profile_size)
    texts = docs.select("doc_id", label_code(F.col("lang")).alias("label"), "text").filter("text is not null")
    schema = "doc_id long, segment_no int, lang string, confidence double, doc_lang string, doc_confidence double, label string, mixed boolean"
    return texts.mapInArrow(_assign(known, profile_size, least_lead), schema)


def wrong_or_mixed(segments: DataFrame) -> DataFrame:
    """Segments of documents in several languages, or whose label is missing or names another language."""
    return segments.filter(F.col("mixed") | ~F.col("label").eqNullSafe(F.col("doc_lang"))).filter("lang is not null")
