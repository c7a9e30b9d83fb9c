"""Mixing sources to target weights.

Shares. Let s be the sources' own token shares and q the wanted ones. The tempered weights are
w(a) ~ s^(1-a) * q^a: a = 0 leaves the corpus as it is, a = 1 is the target. The exponent is the largest in [0, 1] whose
weights keep every source within max_repeats at the total size, found by bisection. Without a size it is that of the
largest mixture with a = 1, so that the shares are the targets. With a wanted entropy the targets are left aside:
w(a) ~ s^a, with a bisected to that entropy.

Realisation. A source with budget t and tokens c is repeated floor(t / c) whole blocks, each a permutation of
all its documents (order by a seeded hash of block and document), and one last block cut where the budget is
reached. The cut never sorts a source in one task: the permutation is taken in hash ranges, range totals are
summed up first, and only the range in which the budget ends is ranked.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Word pattern of the public byte-level vocabulary; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """path: the tokenizer's vocabulary file, readable on every executor. `docs` without the text and with the number of tokens of its whole text; null text has 0."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{out}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], out])

    return docs.select(text, *[f.name for f in keep]).mapInArrow(run, schema)


def clean_source(c) -> F.Column:
    """Spelling of a source name: trimmed, lower case, dashes as underscores; blank is null."""
    return F.nullif(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(""))


def _bisect(f: Callable[[float], bool], lo: float, hi: float) -> float:
    """The end of the stretch from `lo` on which f holds, within [lo, hi]."""
    if f(hi):
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) else (lo, mid)
    return lo


def _last_within(excess: Sequence[Callable[[float], float]]) -> float:
    """The largest point of [0, 1] at which no function is above 0; 0 if there is none. Each is concave, so that it is above 0
    on one stretch, whose ends are bisected on either side of its peak."""
    stretches = []
    for g in excess:
        lo, hi = 0.0, 1.0
        for _ in range(100):  # ternary search for the peak
            x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (x, hi) if g(x) < g(y) else (lo, y)
        peak = max((0.0, 1.0, lo), key=g)
        if g(peak) > 0:
            stretches.append((-1.0 if g(0.0) > 0 else _bisect(lambda a: g(a) <= 0, 0.0, peak), 2.0 if g(1.0) > 0 else 1 - _bisect(lambda b: g(1 - b) <= 0, 0.0, 1 - peak)))
    a = 1.0
    while over := [lo for lo, hi in stretches if lo < a < hi]:
        a = min(over)
    return max(a, 0.0)


def entropy_of(weights: dict[str, float]) -> float:
    """In nats."""
    return 0.0 - sum(w * math.log(w) for w in weights.values() if w > 0)


def plan(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, entropy: float | None = None) -> tuple[int, float, dict[str, float]]:
    """Total size, exponent and weight of each target source that has tokens; see the head of the module.

    The entropy of s^a falls from that of equal shares (a = 0); one that no exponent up to 16 reaches gives the nearest.
    A total that the limits forbid even at the exponent found is cut to what they allow."""
    have = {k: tokens.get(k, 0) for k, (q, r) in targets.items() if q and q > 0 and r and r > 0 and tokens.get(k, 0) > 0}
    if not have:
        return 0, 1.0, {}
    s, q = sum(have.values()), sum(targets[k][0] for k in have)

    def weights(a: float) -> dict[str, float]:
        raw = {k: (c / s) ** a if entropy is not None else (c / s) ** (1 - a) * (targets[k][0] / q) ** a for k, c in have.items()}
        z = sum(raw.values())
        return {k: v / z for k, v in raw.items()}

    limit = lambda w: min(targets[k][1] * c / w[k] for k, c in have.items())
    if entropy is not None:
        a = _bisect(lambda x: entropy_of(weights(x)) >= entropy, 0.0, 16.0)
    else:
        size = limit(weights(1.0)) if total is None else total
        over = lambda k: lambda x: math.log(weights(x)[k] * size / (targets[k][1] * have[k])) - 1e-12
        a = _last_within([over(k) for k in have])
    w = weights(a)
    most = int(limit(w) * (1 + 1e-9))  # the exponent is bisected to rounding
    return most if total is None else min(total, most), a, w


def mix(docs: DataFrame, targets: DataFrame, *, total: int | None = None, epochs: float | None = None, entropy: float | None = None, seed: int = 17, range_docs: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). docs: doc_id, source, tokens; targets: source, target_share, max_repeats.

    The size is `total` tokens, or `epochs` times the tokens of the listed sources; `entropy` in nats is that of plan().
    drawn has doc_id, source, tokens, block (1 for a document's first use): each document of a listed source at
    most max_repeats times. report has a row per listed source: docs, tokens_available, target_share, weight, exponent and
    entropy of the mixture, budget_tokens, drawn_tokens, actual_share, most_repeats; targets are one row per source by contract, and
    the number of sources is what the driver holds.

    Defined cases: a source with no tokens, or with a null or non-positive share or limit, draws nothing and its
    share goes to the others in proportion; documents of unlisted or null sources are not drawn; documents of 0
    or null tokens, or null id, are not drawn; repeated doc_ids are documents of their own; empty tables give an
    empty draw. A source falls short of its budget by less than one document.
    """
    spark = docs.sparkSession
    t = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").filter("source is not null")
    t = t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = {r.source: (r.target_share, r.max_repeats) for r in t.collect()}
    d = docs.select("doc_id", clean_source("source").alias("source"), F.col("tokens").cast("long").alias("tokens")).filter("doc_id is not null and tokens > 0")
    d = d.join(F.broadcast(t.select("source")), "source", "left_semi")  # one row per listed source
    held = {r.source: (r.tokens, r.docs) for r in d.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    if epochs is not None:
        total = int(epochs * sum(v[0] for v in held.values()))
    size, exponent, weights = plan({k: v[0] for k, v in held.items()}, wanted, total, entropy)
    ranges = max(64, -(-max((v[1] for v in held.values()), default=0) // range_docs))  # a range is what one task ranks
    budget = {k: min(int(w * size), wanted[k][1] * held[k][0]) for k, w in weights.items()}
    blocks = [(k, b, min(held[k][0], budget[k] - (b - 1) * held[k][0])) for k in budget for b in range(1, -(-budget[k] // held[k][0]) + 1) if budget[k]]
    blocks = spark.createDataFrame(blocks, "source string, block int, block_budget long")

    rows = d.join(F.broadcast(blocks), "source")  # at most sources x max_repeats rows
    order = F.xxhash64(F.lit(seed), "block", "doc_id")
    rows = rows.withColumns({"o": order, "r": F.pmod(F.shiftright(order, 20), F.lit(ranges))})
    sums = rows.groupBy("source", "block", "r").agg(F.sum("tokens").alias("range_tokens"))
    before = F.sum("range_tokens").over(Window.partitionBy("source", "block").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
    rows = rows.join(sums, ["source", "block", "r"]).filter("before < block_budget")
    whole = rows.filter("before + range_tokens <= block_budget")
    w = Window.partitionBy("source", "block", "r").orderBy("o", "doc_id", "tokens")
    cut = rows.filter("before + range_tokens > block_budget").withColumn("upto", F.col("before") + F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("upto <= block_budget")
    cols = ["doc_id", "source", "tokens", "block"]
    drawn = whole.select(*cols).unionByName(cut.select(*cols))

    rep = spark.createDataFrame(
        [(k, float(q or 0), int(r or 0), *(held.get(k, (0, 0))), weights.get(k, 0.0), exponent, entropy_of(weights), budget.get(k, 0)) for k, (q, r) in wanted.items()],
        "source string, target_share double, max_repeats int, tokens_available long, docs long, weight double, exponent double, entropy double, budget_tokens long",
    )
    got = drawn.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("draws"), F.max("block").alias("most_repeats"))
    all_tokens = F.sum("drawn_tokens").over(Window.partitionBy())  # over one row per source
    report = rep.join(F.broadcast(got), "source", "left").fillna(0, ["drawn_tokens", "draws", "most_repeats"])
    report = report.withColumn("actual_share", F.when(all_tokens > 0, F.col("drawn_tokens") / all_tokens).otherwise(F.lit(0.0)))
    return drawn, report
