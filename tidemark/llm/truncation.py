"""Texts cut off by field limits.

1. Lengths. Per source, the hazard of length L is the share of texts of length L among those that are at least L
   long. It is tested against the hazard of the lengths around it (an upper binomial tail), and the tests of all
   lengths are put under Benjamini-Hochberg control. Lengths that pass are field limits.
2. Endings. A text is made of units: sentences, lines, list entries, contents of tags. For the words in which a
   text ends, all texts are counted for how often the same words end a unit and how often the unit goes on; a
   text whose last words mostly go on elsewhere, or are known nowhere, ends in the middle of something. Words
   stand for each other with their digits masked, and are looked up as the last three with the first word of their
   unit if these are known, else as the last two with it, else as the last three alone.
3. A text is cut if it ends inside a tag, an entity, a character or an open element, if the source marked it as
   shortened (and not with a mark that belongs to a closing line many texts share), if it ends in a comma, dash or
   the like, or if its ending is incomplete by 2. At a field limit an
   ending must be all but certain to pass as complete; elsewhere (transfers that broke off) more often than not.

The words looked up reach the counting tasks as a bit table, sized by their number, which only saves work: counts are
joined to endings by their full keys.

Field limits are all that lengths can show. A transfer that broke off leaves no length behind, so endings away from limits
are judged as well, by a cut-off of their own, and are reported apart from those at limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.neardup import bit_table
from tidemark.llm.words import MIX, mixed, slices
from tidemark.session import durable

SEP = "\x01"
TOKEN = re.compile(r"\x01|\n|<[^<>\x01]*>|&[A-Za-z][A-Za-z0-9]*;|&#[0-9]+;|[^\W_]+|[.!?]+(?=[\s<\"')\]\x01]|$)|[^\w\s]|_")
INNER = re.compile(r"(?<=\w)[.!?](?=\w)")
DIGIT = re.compile(r"\d")
# What feeds put where they shortened a text.
MARK = re.compile(r"(?:…|\.\.\.+|\[(?:…|\.\.\.)\]|\((?:…|\.\.\.)\)|[\[(](?:text |content )?(?:shortened|truncated|cut|continued|more|read more)[\])]|(?:read|see|show|view) more)\s*[.>»→]*\s*\Z", re.I)
OPEN_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]*|#[0-9]*)?\Z")
TAGS = re.compile(r"<\s*(/?)\s*([A-Za-z][A-Za-z0-9]*)[^<>]*?(/?)>")
VOID = {"br", "hr", "img", "input", "meta", "link", "wbr"}
CLOSED = re.compile(r"[.!?][\"'”’»)\]]*\Z")

# Kinds of ending.
OPEN, MARKED, DANGLING, WORDS, COMPLETE = "open markup", "marked", "dangling", "words", "complete"


def body(text: str) -> tuple[str, bool]:
    """Text without trailing blanks and without marks of shortening, and whether there was one."""
    t, marked = text.rstrip(), False
    while m := MARK.search(t, max(0, len(t) - 60)):  # no mark is longer; "..." may stand before "read more"
        t, marked = t[: m.start()].rstrip(), True
    return t, marked


def last_unit(text: str) -> str:
    """The end of a text from a boundary on, its last unit at least."""
    return text[max(0, *(text.rfind(b) for b in ("\n", ". ", "! ", "? ", "; "))) :]


def unbalanced(text: str) -> bool:
    """Whether an element is left open at the end."""
    stack: list[str] = []
    for close, name, alone in TAGS.findall(text):
        name = name.lower()
        if alone or name in VOID:
            continue
        if not close:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return bool(stack)


def ending(text: str) -> str:
    """The kind of ending; WORDS is left to the counts."""
    t, marked = body(text)
    if t.rfind("<") > t.rfind(">") or OPEN_ENTITY.search(t, max(0, t.rfind("&"))) or t.endswith("�") or ("<" in t and unbalanced(t)):
        return OPEN
    if marked:
        return MARKED
    if t.endswith(">") or CLOSED.search(t):
        return COMPLETE
    return WORDS if t and (t[-1].isalnum() or t[-1] in ")]\"'”’»%+#*") else DANGLING


class Contexts:
    """Keys of the words in which units end or go on."""

    def __init__(self, limit: int = 2_000_000):
        import xxhash

        self._hash, self._seen, self._limit = xxhash.xxh64_intdigest, {}, limit

    def _id(self, token: str) -> int:
        """Low bit: a boundary. 1 is the end of a text."""
        if token == SEP:
            return 1
        if token == "\n" or token == ";" or token == "•" or (len(token) > 1 and token[0] == "<") or token[0] in ".!?":
            return 3
        if token == "&":
            token = "and"
        if token in "-*–":
            return 5  # a bullet where a unit begins
        return (self._hash(DIGIT.sub("0", token)) << 1) & 0xFFFFFFFFFFFFFFFF | 0

    def __call__(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys uint64 [3, words], state uint8 [words] (0 goes on, 1 a unit ends, 2 the text ends), owner [words]."""
        tokens = TOKEN.findall(INNER.sub("·", SEP.join([t.replace(SEP, " ") for t in texts])) + SEP)
        seen = self._seen
        if len(seen) > self._limit:
            seen.clear()
        for t in set(tokens).difference(seen):
            seen[t] = self._id(t)
        ids = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
        sep = ids == 1
        hard = (ids == 1) | (ids == 3)
        bullet = ids == 5
        bullet[1:] &= hard[:-1]
        edge = hard | bullet
        n = len(ids)
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(edge, at + 1, 0))
        state = np.zeros(n, np.uint8)
        state[:-1][edge[1:]] = 1
        state[:-1][sep[1:]] = 2
        owner = np.cumsum(sep) - sep
        w = np.nonzero(~edge)[0]
        s = start[w]
        zero = np.uint64(0)
        first, last = ids[s], ids[w]
        p1 = np.where(w - 1 >= s, ids[np.maximum(w - 1, 0)], zero)
        p2 = np.where(w - 2 >= s, ids[np.maximum(w - 2, 0)], zero)
        with np.errstate(over="ignore"):
            k2 = mixed(mixed(mixed(first + MIX) * MIX + last) * MIX + p1 + np.uint64(11))
            k3 = mixed(k2 * MIX + p2 + np.uint64(23))
            j3 = mixed(mixed(mixed(last + np.uint64(37)) * MIX + p1) * MIX + p2 + np.uint64(41))
        return np.stack([k3, k2, j3]), state[w], owner[w]


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    contexts = Contexts()
    for b in slices(batches):
        texts = b.column(0).to_pylist()
        kinds = [ending(t) for t in texts]
        keys, state, owner = contexts([last_unit(body(t)[0]) for t in texts])
        last = np.nonzero(state == 2)[0]
        k = np.zeros((3, len(texts)), np.int64)
        k[:, owner[last]] = keys[:, last].view(np.int64)
        lengths = pa.array([len(t) for t in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], lengths, pa.array(kinds, pa.string()), *[pa.array(x) for x in k]], names=[*b.schema.names[1:], "length", "kind", "k3", "k2", "j3"])


def _counts(wanted: np.ndarray, n_bits: int):
    """Texts to (key, ends, goes_on) for keys that the bit table lets through, summed up batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts()
        for b in slices(batches):
            keys, state, _ = contexts([body(t)[0] for t in b.column(0).to_pylist()])
            flat, s = keys.ravel(), np.tile(state, 3)
            place = flat >> np.uint64(64 - n_bits)
            hit = (wanted[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
            u, inverse = np.unique(flat[hit], return_inverse=True)
            n = [np.bincount(inverse[s[hit] == v], minlength=len(u)) for v in (1, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *[pa.array(x.astype(np.int64)) for x in n]], names=["key", "ends", "goes_on"])

    return run


def length_hazards(lengths: DataFrame, *, by: str, around: int = 40, apart: int = 1, fdr: float = 0.001, least: int = 5) -> DataFrame:
    """Per source and length: texts, at_risk, hazard, expected (of the neighbours), p_value, limit (bool).

    lengths has `by` and length, a row per text. Neighbours are the lengths within `around` but for those within
    `apart`; a length nobody has counts as hazard 0. The binomial tail is bounded by Chernoff's inequality, which
    errs to the safe side; Benjamini-Hochberg over all lengths seen at least `least` times. A null `by` is a
    source of its own.
    """
    c = lengths.groupBy(by, "length").agg(F.count("*").alias("texts"))
    # lengths of one source: at most as many rows as a text can have lengths
    later = Window.partitionBy(by).orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = Window.partitionBy(by).orderBy("length").rangeBetween(-around, around)
    close = Window.partitionBy(by).orderBy("length").rangeBetween(-apart, apart)
    c = c.withColumn("at_risk", F.sum("texts").over(later))
    c = c.withColumn("around", F.sum("texts").over(near) - F.sum("texts").over(close))
    c = c.withColumn("hazard", F.col("texts") / F.col("at_risk"))
    # one pseudo-count keeps an empty neighbourhood from making every length a limit
    c = c.withColumn("expected", F.least(F.lit(0.999), (F.col("around") + 1) / (F.lit(2.0 * (around - apart)) * F.greatest(F.col("at_risk"), F.lit(1)))))
    h, e = F.col("hazard"), F.col("expected")
    kl = F.when(h >= 1, -F.log(e)).otherwise(h * F.log(h / e) + (1 - h) * F.log((1 - h) / (1 - e)))
    c = c.withColumn("p_value", F.when(h <= e, F.lit(1.0)).otherwise(F.exp(-F.col("at_risk") * kl)))
    tests = c.filter(F.col("texts") >= least)
    # Benjamini-Hochberg: ranks are taken within ranges of p-values and moved on by the sizes of those before; a p-value
    # above fdr can't pass and changes no rank below it
    m = tests.count()
    low = tests.filter(F.col("p_value") <= fdr).select("p_value", F.floor(F.log10(F.greatest("p_value", F.lit(1e-300))) * 10).alias("range"))
    sizes = low.groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most 3,001 ranges
    ranked = low.join(F.broadcast(sizes.select("range", before.alias("before"))), "range")  # as many
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("range").orderBy("p_value")) + F.col("before"))
    cut = ranked.filter(F.col("p_value") <= F.lit(fdr) * F.col("r") / F.lit(m)).agg(F.max("p_value").alias("cut"))
    most = cut.first().cut  # null if no length passes
    passed = F.lit(False) if most is None else (F.col("texts") >= least) & (F.col("p_value") <= most)
    return c.withColumn("limit", passed).drop("around")


def cut_texts(rows: DataFrame, *, keys: Sequence[str], text: str, by: str, at_limit: float = 0.9, elsewhere: float = 0.5, seen: int = 3, closing: float = 0.0005) -> DataFrame:
    """A row per non-blank text: keys, length, kind, share (of like endings that end a unit; null if decided by kind), limit, cut.

    closing: words that end at least this share of all texts (and more than 5) count as an ending even if no unit
    inside a text ends so, texts at a field limit aside; a mark after a line that ten times as large a share of the
    distinct texts have is no sign of a cut, unless the text ends at a boundary or at a field limit. Defined cases: null and blank texts give no row; repeated rows give a row each; texts
    of one word are judged like others; an empty table gives no rows; null keys are kept; columns not named are not
    read.
    """
    src = rows.select(F.col(text).alias("text"), *[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], F.col(by).alias("by"), F.xxhash64(text).alias("same_text")).filter(F.col("text").rlike(r"\S"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[1:])
    tails = durable(src.mapInArrow(_tails, fields + ", length int, kind string, k3 long, k2 long, j3 long"), "tails")
    open_ = tails.filter(F.col("kind") == WORDS)
    wanted = durable(open_.select(F.explode(F.array("k3", "k2", "j3")).alias("k")).distinct(), "ending-keys")
    counts = src.select("text").mapInArrow(_counts(*bit_table(wanted, "k")), "key long, ends long, goes_on long")
    counts = counts.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on")).filter("ends + goes_on > 0").join(wanted.withColumnRenamed("k", "key"), "key", "left_semi")

    limits = length_hazards(tails, by="by").filter("limit").select(F.col("by").alias("l_by"), F.col("length").alias("l_length"))
    t = tails.join(limits, F.col("by").eqNullSafe(F.col("l_by")) & (F.col("length") == F.col("l_length")), "left")
    t = durable(t.withColumn("limit", F.col("l_length").isNotNull()).drop("l_by", "l_length"), "limits")
    total, different = t.agg(F.count("*"), F.countDistinct("same_text")).first()
    floor = F.greatest(F.lit(5), F.lit(closing * total))
    # words that end many whole texts; what stands at a field limit may have been cut there, again and again
    finals = t.filter((F.col("kind") == WORDS) & ~F.col("limit")).select(F.explode(F.array("k3", "k2", "j3")).alias("key")).groupBy("key").agg(F.count("*").alias("final")).filter(F.col("final") > floor)
    stats = counts.join(finals, "key", "full")
    end = F.coalesce("ends", F.lit(0)) + F.coalesce("final", F.lit(0))
    stats = durable(stats.select("key", end.alias("end"), (end + F.coalesce("goes_on", F.lit(0))).alias("all")), "ending-counts")

    # the distinct endings, with the counts of their three keys
    endings = open_.select("k3", "k2", "j3").distinct()
    for k in ("k3", "k2", "j3"):
        endings = endings.join(stats.select(F.col("key").alias(k), F.struct("end", "all").alias(f"c_{k}")), k, "left")
    share = F.coalesce(*[F.when(F.col(f"c_{k}.all") >= seen, F.col(f"c_{k}.end") / F.col(f"c_{k}.all")) for k in ("k3", "k2", "j3")], F.lit(0.0))
    endings = endings.select("k3", "k2", "j3", share.alias("share"))

    t = t.join(endings, ["k3", "k2", "j3"], "left")
    # a mark after one and the same line in many different texts belongs to that line; k3 is 0 where no word ends the text
    line = (F.col("kind") == MARKED) & (F.col("k3") != 0) & ~F.col("limit")
    lines = t.filter(line).groupBy("k3").agg(F.countDistinct("same_text").alias("same")).filter(F.col("same") >= F.greatest(F.lit(5), F.lit(10 * closing * different)))
    t = t.join(lines.withColumnRenamed("k3", "l3"), line & (F.col("k3") == F.col("l3")), "left")
    t = t.withColumn("kind", F.when(F.col("same").isNotNull(), F.lit(COMPLETE)).otherwise(F.col("kind")))
    share = F.when(F.col("kind") == WORDS, F.col("share"))
    need = F.when(F.col("limit"), F.lit(at_limit)).otherwise(F.lit(elsewhere))
    cut = F.when(F.col("kind") == WORDS, F.col("share") < need).otherwise(F.col("kind") != COMPLETE)
    return t.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "length", "kind", share.alias("share"), "limit", cut.alias("cut"))
