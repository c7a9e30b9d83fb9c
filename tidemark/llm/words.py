"""Plain words of a text: lower case, complete tags and entities as blanks, runs of letters and digits."""

from __future__ import annotations

import re

import numpy as np

SEP = "\x01"
MARKUP = re.compile(r"<[^<>\x01]*>|&[A-Za-z][A-Za-z0-9]*;|&#[0-9]+;")
WORD = re.compile(r"[^\W_]+")
WORD_OR_SEP = re.compile(r"[^\W_]+|\x01")


def slices(batches, rows: int = 2000):
    """Record batches of at most `rows` rows, so that a task holds the words of few texts at once."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def plain_words(text: str | None) -> list[str]:
    """Null gives no words."""
    return WORD.findall(MARKUP.sub(" ", text.lower().replace(SEP, " "))) if text else []


def batch_words(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All words of a batch in order, and the offsets at which each text begins (one more than texts)."""
    joined = SEP.join([t.replace(SEP, " ") if t else "" for t in texts]).lower()
    tokens = WORD_OR_SEP.findall(MARKUP.sub(" ", joined))
    if not texts:
        return [], np.zeros(1, np.int64)
    is_sep = np.fromiter((t == SEP for t in tokens), bool, len(tokens))
    cuts = np.nonzero(is_sep)[0] - np.arange(is_sep.sum())
    words = [t for t in tokens if t != SEP]
    return words, np.concatenate([[0], cuts, [len(words)]]).astype(np.int64)


class WordHash:
    """64-bit ids of words; a bounded cache keeps the hash of words met before."""

    def __init__(self, limit: int = 2_000_000):
        import xxhash

        self._hash, self._seen, self._limit = xxhash.xxh64_intdigest, {}, limit

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        if len(seen) > self._limit:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = self._hash(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of a 64-bit value."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words that lie within one text, and the place of each window's first word."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):  # Horner's rule: the Karp-Rabin value of each window, modulo 2**64
            h = h * MIX + ids[i : i + n]
    # the next cut after a window's first word must not come before its end
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(ids))
    at = np.nonzero(left[:n] >= k)[0]
    return mixed(h[at]), at


_tables: dict[str, np.ndarray] = {}


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or digit, and a 64-bit value; made once in a process."""
    if not _tables:
        _tables["alnum"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
        with np.errstate(over="ignore"):
            _tables["value"] = mixed(np.arange(1, 0x110001, dtype=np.uint64) * MIX)
    return _tables["alnum"], _tables["value"]


def batch_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the plain words of a batch, and the offsets at which each text begins: as batch_words, without
    making a string of each word. A word's id is a polynomial in its characters, modulo 2**64, mixed."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    clean = [t.lower().replace(SEP, " ") if t else "" for t in texts]
    clean = [MARKUP.sub(" ", t) if "<" in t or "&" in t else t for t in clean]
    codes = np.frombuffer(SEP.join(clean).encode("utf-32-le", "surrogatepass"), np.uint32)
    alnum, value = _char_tables()
    inside = alnum[codes]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, stop = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    seps = np.nonzero(codes == ord(SEP))[0]
    offsets = np.concatenate([[0], np.searchsorted(start, seps), [len(start)]]).astype(np.int64)
    if not len(start):
        return np.empty(0, np.uint64), offsets
    chars = np.nonzero(inside)[0]
    n = stop - start
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        power = np.ones(int(n.max()), np.uint64)
        if len(power) > 1:
            power[1:] = np.multiply.accumulate(np.full(len(power) - 1, np.uint64(0x9E3779B97F4A7C15)))
        place = np.arange(len(chars)) - np.repeat(first, n)
        ids = mixed(np.add.reduceat(value[codes[chars]] * power[place], first))
    return ids, offsets
