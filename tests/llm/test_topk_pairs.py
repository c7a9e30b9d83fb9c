import itertools
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import cooccurrence as co
from tidemark.llm.topk import top_n_per_group
from tidemark.session import new_path


def test_top_n(spark):
    rows = [("g", "a", 5), ("g", "a", 9), ("g", "b", 9), ("g", None, 9), ("g", "c", None), ("g", "d", 1), (None, "x", 1), ("g", "B", 9)]
    df = spark.createDataFrame([(*r, 7, "w") for r in rows], "g string, item string, score int, place int, rank string")
    got = [(r.g, r.item, r.score, r.place) for r in top_n_per_group(df, group=["g"], item="item", score="score", n=3).collect()]
    assert sorted(got, key=str) == sorted([("g", None, 9, 1), ("g", "B", 9, 2), ("g", "a", 9, 3), (None, "x", 1, 1)], key=str)
    assert top_n_per_group(df.limit(0), group=["g"], item="item", score="score", n=3).count() == 0


def test_group_limit_is_planned(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("item"), "id")
    plan = top_n_per_group(df, group=["g"], item="item", score="id", n=2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def brute(baskets):
    pairs, items = Counter(), Counter()
    for s in baskets.values():
        items.update(s)
        pairs.update(itertools.combinations(sorted(s), 2))
    return pairs, items, len(baskets)


def items(spark, baskets):
    df = spark.createDataFrame([(b, i, "x") for b, s in baskets.items() for i in s for _ in range(2)], "b string, i string, basket string")
    return co.basket_items(df, ["b"], F.lower(F.trim("i")))


def state(counts):
    return {(r.a, r.b): r.n_ab for r in counts.pairs().collect()}, {r.item: r.n for r in counts.items().collect()}, counts.baskets()


def test_incremental_equals_recount(spark):
    old = {"1": {"a", "b", "c"}, "2": {"a", "b"}, "3": {"c"}, "4": {"x", "y"}}
    new = {"1": {"a", "b", "d"}, "2": {"a", "b"}, "4": set(), "5": {"a", "d"}}
    counts = co.PairCounts(spark, new_path(spark, "t"))
    counts.update(items(spark, old))
    assert state(counts) == brute(old)
    named = [k for k in new]
    seg = counts.update(items(spark, new), items(spark, {k: old[k] for k in named if k in old}))
    now = {k: v for k, v in {**old, **new}.items() if v}
    assert state(counts) == tuple(Counter({k: n for k, n in x.items() if n}) if isinstance(x, Counter) else x for x in brute(now))
    moved = {(r.a, r.b) for r in counts.scores(touched_by=seg).collect()}
    assert ("a", "d") in moved and all("c" not in p or "a" in p for p in moved)
    s = {(r.a, r.b): r.lift for r in counts.scores().collect()}
    assert abs(s["a", "b"] - 2 * 4 / (3 * 2)) < 1e-9
    before = state(counts)
    counts.clean()
    assert state(counts) == state(co.PairCounts(spark, counts.path)) == before


def test_opened_again(spark):
    """A table opened again has its counts and takes an update on top of them; one that was cut off leaves no trace."""
    old, new = {"1": {"a", "b"}, "2": {"a", "b", "c"}}, {"2": {"a", "c"}}
    path = new_path(spark, "t")
    co.PairCounts(spark, path, buckets=5).update(items(spark, old))
    again = co.PairCounts(spark, path)
    assert state(again) == brute(old) and again._state["buckets"] == 5
    again._publish = lambda state: None
    again.update(items(spark, {"1": set(), "9": {"x", "y"}}), items(spark, {"1": old["1"]}))
    assert state(co.PairCounts(spark, path)) == brute(old)
    co.PairCounts(spark, path).update(items(spark, new), items(spark, {"2": old["2"]}))
    last = co.PairCounts(spark, path)
    assert state(last) == brute({**old, **new}) and last._state["version"] == 1


def test_only_touched_buckets_are_written(spark):
    baskets = {str(k): {f"i{k}", f"j{k}"} for k in range(40)}
    counts = co.PairCounts(spark, new_path(spark, "t"), buckets=16)
    counts.update(items(spark, baskets))
    counts.update(items(spark, {"new": {"i1", "j1"}}))
    assert sorted(counts._state["at"]["pairs"].values()).count(1) == 1 and state(counts)[0]["i1", "j1"] == 2


def test_large_baskets_in_blocks(spark):
    baskets = {"big": {f"i{k:03d}" for k in range(40)}, "small": {"i001", "i002"}, "one": {"z"}}
    signed = items(spark, baskets).withColumn("sign", F.lit(1))
    want = dict(brute(baskets)[0])
    assert {(r.a, r.b): r.n for r in co.pair_deltas(signed, block=7).collect()} == {(r.a, r.b): r.n for r in co.pair_deltas(signed).collect()} == want


def test_baskets_across_batches(spark):
    """Baskets that Arrow's batches cut in two are expanded whole; signs that cancel leave nothing."""
    baskets = {str(k): {f"i{(k * j) % 23:02d}" for j in range(1, 9)} for k in range(60)}
    signed = items(spark, baskets).withColumn("sign", F.lit(1))
    both = signed.unionByName(signed.withColumn("basket", F.struct(F.concat("basket.b", F.lit("-")).alias("b"))).withColumn("sign", F.lit(-1)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert {(r.a, r.b): r.n for r in co.pair_deltas(signed).collect()} == dict(brute(baskets)[0])
        assert co.pair_deltas(both).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blank_and_empty(spark):
    df = spark.createDataFrame([(None, " A "), (None, "b"), ("x", None), ("x", " ")], "b string, i string")
    counts = co.PairCounts(spark, new_path(spark, "t"))
    counts.update(co.basket_items(df, ["b"], F.lower(F.trim("i"))))
    assert state(counts) == ({("a", "b"): 1}, {"a": 1, "b": 1}, 1)
    none = co.PairCounts(spark, new_path(spark, "t"))
    assert none.scores().count() == 0
    none.update(co.basket_items(df.limit(0), ["b"], F.col("i")))
    assert none.scores().count() == 0 and none.baskets() == 0
