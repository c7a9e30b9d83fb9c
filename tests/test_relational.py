import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality as Q
from tidemark.operators import relational as R
from tidemark.operators import retention
from tidemark.operators.peers import nearest_peers
from tidemark.plans import load_queries


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_upsert(spark):
    e = spark.createDataFrame([(1, "a", 10, "f1"), (2, "b", None, "f2")], "k int, v string, w int, first string")
    i = spark.createDataFrame([(2, None, 5, "f9"), (3, "c", 7, "f3")], "k int, v string, w int, first string")
    assert rows(R.upsert(e, i, keys=["k"], keep=["first"], fill=["v"])) == [(1, "a", 10, "f1"), (2, "b", 5, "f2"), (3, "c", 7, "f3")]
    assert rows(R.upsert(e, i.limit(0), keys=["k"])) == rows(e)
    assert rows(R.upsert(e.limit(0), i, keys=["k"])) == rows(i)


def test_insert_ignore_and_replace(spark):
    e = spark.createDataFrame([(1, "a")], "k int, v string")
    i = spark.createDataFrame([(1, "z"), (2, "y"), (2, "b")], "k int, v string")
    assert rows(R.insert_ignore(e, i, ["k"])) == [(1, "a"), (2, "b")]
    assert rows(R.replace_batch(e, i.filter("v = 'z'"), ["k"])) == [(1, "z")]
    assert rows(R.drop_orphans(i, e, [("k", "k")])) == [(1, "z")]


def test_prefix_matches_equal_nested_loop(spark):
    keys = ["ALPHA BETA", "ALPHA", "GAMMADELTA", "X", None, "X Y"]
    names = ["ALPHA BETA", "ALPHA BETA GAMMA", "GAMMADELTA LLC", "GAMMADELTAS", "X Y", "X", None]
    got = rows(R.prefix_matches(spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame([(n,) for n in names], "n string"), key="k", name="n"))
    want = sorted([(k, n, k == n) for k in keys for n in names if k and n and (k == n or (len(k) >= 8 and n.startswith(k + " ")))], key=str)
    assert got == want


def test_peers_equal_brute_force(spark):
    sets = {"a": {1, 2, 3, 4}, "b": {2, 3, 4, 5}, "c": {9}, "d": {1, 2, 3, 4}}
    df = spark.createDataFrame([(e, i) for e, s in sets.items() for i in s] + [("a", 1), (None, 1), ("a", None)], "e string, i int")
    got = {(r[0], r[1]): r[3] for r in R.jaccard_peers(df, entity="e", item="i", least_shared=2, least=0.5, k=6).collect()}
    assert got == {("a", "b"): 0.6, ("b", "a"): 0.6, ("a", "d"): 1.0, ("d", "a"): 1.0, ("b", "d"): 0.6, ("d", "b"): 0.6}


def test_spelling_and_kept_keys(spark):
    df = spark.createDataFrame([("g", "bb"), ("g", "bb"), ("g", "a"), ("g", "a"), ("h", None)], "g string, s string")
    assert rows(R.most_frequent_spelling(df, group="g", spelling="s")) == [("g", "a", 2)]
    m = spark.createDataFrame([("x", 5), ("y", 5), ("z", 1), ("w", None)], "k string, m int")
    assert rows(R.keep_top_or_referenced(m, key="k", measure="m", n=1, referenced=spark.createDataFrame([("z",)], "k string"))) == [("x", 5), ("z", 1)]


def test_movement(spark):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate([0, 10, 20, 30])], "k string, t int, v int")
    got = R.movement(df, key="k", time="t", value="v", spans=[2]).orderBy("t").collect()
    assert [r.change_2_pct for r in got] == [None, None, 100.0, 50.0] and [r.previous_v for r in got] == [None, 0, 10, 20]


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "q")], "k int, v string")
    got = {r.check: (r.failures, r.ok) for r in Q.report([Q.not_null(df, "v"), Q.unique(df, ["k"]), Q.accepted(df, "v", ["a"]), Q.in_range(df, "k", 1, 1), Q.related(df, "k", df.filter("k = 1"), "k"), Q.holds(df, "h", F.col("v") == "a"), Q.at_least(df, "n", 5), Q.drift(df, df.limit(1), "d", 50)]).collect()}
    assert got == {"not_null v": (1, False), "unique k": (1, False), "accepted v": (1, False), "in_range k": (1, False), "related k": (1, False), "h": (2, False), "n": (2, False), "d": (1, False)}
    with pytest.raises(ValueError):
        Q.require_rows(df.limit(0), "empty")


def test_retention(spark):
    df = spark.createDataFrame([("a", "h", "2024-01-01"), ("b", "h", "2024-01-01"), ("c", None, "2024-01-01"), ("d", "h", "2024-03-01")], "k string, digest string, at string").withColumn("at", F.col("at").cast("date"))
    out = retention.droppable_text(df, keys=["k"], digest="digest", age="at", archived=df, needed=df.filter("k = 'b'"), as_of="2024-03-02", days=7)
    assert {r.k for r in out.filter("drop").collect()} == {"a"}


def test_hot_items_are_cut_into_blocks(spark):
    """The same peers, whatever the block."""
    df = spark.createDataFrame([(f"e{e}", i) for e in range(30) for i in range(12) if i == 0 or (e * i) % 5 < 2], "e string, i int")
    got = [rows(R.jaccard_peers(df, entity="e", item="i", least_shared=2, least=0.3, k=4, block=b)) for b in (1000, 7, 1)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 40


def test_nearest_peers_equal_pairs_by_item(spark):
    """The same rows with many ties at the k-th place, whatever the block, also for numbers and unknown values."""
    df = spark.createDataFrame([(f"e{e % 97}", (e * i) % 31) for e in range(194) for i in range(14)] + [("one", 1), (None, 1), ("e1", None)], "e string, i int")
    numbers = df.select(F.substring("e", 2, 3).try_cast("int").alias("e"), F.concat(F.lit("i"), "i").alias("i"))
    for sets in (df, numbers, df.limit(0)):
        for k, least in ((3, 0.35), (6, 0.2)):
            want = rows(R.jaccard_peers(sets, entity="e", item="i", least_shared=2, least=least, k=k))
            for block in (1000, 10):
                out = nearest_peers(sets, entity="e", item="i", least_shared=2, least=least, k=k, block=block)
                assert out.columns == ["e", "peer", "shared", "similarity", "peer_rank"] and rows(out) == want
    assert rows(nearest_peers(df, entity="e", item="i", least_shared=2, least=0.3, k=4, block=1)) == rows(R.jaccard_peers(df, entity="e", item="i", least_shared=2, least=0.3, k=4))


def test_company_peers_shuffles_no_pairs(spark, tmp_path):
    """250 companies of 20 technologies make 31,125 pairs; no stage writes as many rows."""
    e, n = F.floor(F.col("id") / 20), F.col("id") % 20
    df = spark.range(250 * 20).select(F.lit("s").alias("source"), F.concat_ws("-", e, n).alias("job_id"), F.concat(F.lit("c"), e).alias("company_name"), F.concat(F.lit("t"), (n + e % 3).cast("string")).alias("tech_slug"))
    df.drop("tech_slug").write.parquet(f"{tmp_path}/raw_postings.parquet")
    df.drop("company_name").write.parquet(f"{tmp_path}/posting_technologies.parquet")
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {x.stageId(): x.shuffleWriteRecords() for x in (found.apply(i) for i in range(found.length()))}

    before = stages()
    got = load_queries()["company_peers"](spark, str(tmp_path)).collect()
    assert len(got) == 250 * 6 and {r.similarity for r in got} == {1.0}
    assert 0 < max(n for k, n in stages().items() if k not in before) < 20_000


def test_merge_rules(spark):
    e = spark.createDataFrame([(1, "a", None), (2, "b", "gone"), (3, None, None)], "k int, v string, d string")
    i = spark.createDataFrame([(1, "x", None), (2, "y", None), (4, "z", None)], "k int, v string, d string")
    out = R.merge(e, i, keys=["k"], rules={"v": lambda old, new: F.when(old["d"].isNull(), new["v"])})
    assert rows(out) == [(1, "x", None), (2, None, "gone"), (3, None, None), (4, "z", None)]
    assert rows(R.backfill(out, {"v": F.lit("f")})) == [(1, "x", None), (2, "f", "gone"), (3, "f", None), (4, "z", None)]


def test_row_numbers_over_everything(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    got = R.global_row_number(df, [F.col("g").asc_nulls_last(), F.col("x").desc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 501))
    assert [(r.g is None, r.g or 0, -r.x) for r in got] == sorted((r.g is None, r.g or 0, -r.x) for r in got)
    assert R.global_row_number(df.limit(0), [F.col("x")], "n").count() == 0


def test_not_in(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    other = spark.createDataFrame([(2,), (3,)], "b int")
    assert rows(R.not_in(df, "a", other, "b")) == [(1,)] and R.not_in(df, "a", other.unionByName(spark.createDataFrame([(None,)], "b int")), "b").count() == 0
    assert R.not_in(df, "a", other.limit(0), "b").count() == 3


def test_medians_of_histograms(spark):
    values = {"even": [0, 0, 3, 9], "odd": [5, 1, 1], "one": [4], "none": [None]}
    h = spark.createDataFrame([(g, x) for g, v in values.items() for x in v], "g string, x int").groupBy("g", "x").count()
    assert rows(R.upper_median(h, ["g"], "x", "count", "m")) == [("even", 3), ("odd", 1), ("one", 4)]
    assert rows(R.median(h, ["g"], "x", "count", "m")) == [("even", 1.5), ("odd", 1.0), ("one", 4.0)]


def test_gates(spark):
    df = spark.createDataFrame([("A b",), ("a-B",), ("c",), (None,)], "x string")
    slugged = F.regexp_replace(F.lower("x"), "[^a-z]", "")
    with pytest.raises(ValueError, match="ab"):
        Q.refuse_collisions(df, "x", slugged)
    assert Q.refuse_collisions(df.filter("x = 'c'"), "x", slugged).count() == 1
    e = Q.expectations([("some", True, df, F.count("*") > 0, F.count("*").cast("string")), ("many", False, df, F.count("*") > 9, F.lit("")), ("unknown", False, df.limit(0), F.max("x") == "a", F.lit(""))])
    assert Q.gate(e) == ["many", "unknown"]
    with pytest.raises(ValueError):
        Q.gate(e, strict=True)


def test_retention_chooses_a_window(spark):
    df = spark.createDataFrame([(f"2024-0{m}-01", "2024-01-05") for m in range(1, 7)] + [(None, None)], "p string, s string").selectExpr("cast(p as date) p", "cast(s as date) s")
    kept, window = retention.delete_to_size(df, posted="p", seen="s", as_of="2024-06-30", windows=[180, 90, 30], idle=7, share=0.6)
    assert window == 90 and kept.count() == 4  # of January to June and one without a date, January to March go
