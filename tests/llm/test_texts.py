import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import contamination as con
from tidemark.llm import language as lang
from tidemark.llm import neardup as nd
from tidemark.llm import truncation as tr
from tidemark.llm import words as W


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("aB1_ <>&;é#²\x01\nİ𝒜")), max_size=30)), max_size=6))
def test_batch_ids_equal_words(texts):
    ids, offsets = W.batch_ids(texts)
    words, same = W.batch_words(texts)
    assert offsets.tolist() == same.tolist()
    seen = {}
    for w, i in zip(words, ids.tolist()):
        assert seen.setdefault(w, i) == i
    assert len(set(seen.values())) == len(seen)
    assert [words[a:b] for a, b in zip(offsets, offsets[1:])] == [W.plain_words(t) for t in texts]


def test_markup_is_a_blank():
    assert W.plain_words("A<b>c</b>&amp;D &#39;x < y &no z_9") == ["a", "c", "d", "x", "y", "no", "z", "9"]


# --- 8


def text(rng, n):
    return " ".join(rng.choice(["red", "green", "blue", "one", "two", "six", "cat", "dog"]) for _ in range(n))


def longest_common(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(k, text(rng, 30)) for k in range(6)]
    docs = [(k, text(rng, 40)) for k in range(30)] + [(100 + k, f"<p>{text(rng, 10)}</p> {' '.join(items[k][1].split()[5:22]).upper()}, {text(rng, 10)}") for k in range(4)]
    docs += [(200, None), (201, ""), (202, "short"), (None, items[0][1]), (100, docs[30][1]), (203, "x " * 5000 + items[5][1])]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id int, coverage int")
    it = spark.createDataFrame([*items, (50, None), (51, "")], "item_id long, text string")
    want = {(d, i) for d, t in docs for i, u in items if d is not None and longest_common(W.plain_words(t), W.plain_words(u)) >= 13}
    assert want
    for bound in (10**6, 100):
        got = con.tile_overlaps(df, it, seed=13, slice_seeds=bound).select("doc_id", "item_id").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert con.tile_overlaps(df.limit(0), it).count() == 0 and con.tile_overlaps(df, it.limit(0)).count() == 0


def test_reordered_passages(spark):
    item = [f"w{k}" for k in range(40)]
    doc = item[20:] + ["x"] * 3 + item[:20]
    found = con.tiles(" ".join(doc), " ".join(item), 6)
    assert sorted(n for _, _, n in found) == [20, 20]
    assert con.tiles("a " * 50, "a " * 20, 6) == [(0, 0, 20)]
    df = spark.createDataFrame([(1, " ".join(doc)), (2, " ".join(item[:10]))], "doc_id long, text string")
    got = con.leaked(df, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_tiles, r.coverage) for r in got] == [(1, 2, 1.0)]


def test_short_passages_leak(spark):
    """13 consecutive words are a leak however long the item is; 12 words of it are none."""
    item = [f"w{k}" for k in range(100)]
    docs = [(1, item[40:53]), (2, item[40:52]), (3, item[:12] + ["x"] + item[50:60]), (4, ["y"] * 5 + item[80:100])]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in docs], "doc_id long, text string")
    it = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, r.longest) for r in con.leaked(df, it).collect()}
    assert got == {(1, 13), (4, 20)} and {k for k, _ in got} == {r.doc_id for r in con.tile_overlaps(df, it, seed=13).collect()}


# --- 10


SAMPLE = {
    "en": "the people who work here like their jobs and the weather is often good in the north of the country",
    "fr": "les gens qui travaillent ici aiment leur emploi et le temps est souvent beau dans le nord du pays",
    "de": "die Leute die hier arbeiten mögen ihre Stelle und das Wetter ist oft gut im Norden des Landes",
}


def corpus(spark, extra=()):
    rows = [(k, t, c) for k, (c, t) in enumerate(list(SAMPLE.items()) * 3)]
    return spark.createDataFrame([(*r, 3, True) for r in [*rows, *extra]], "doc_id long, text string, lang string, segment_no int, mixed boolean")


def test_languages(spark):
    mixed = f"{SAMPLE['en']}\r\n \t\r\n{SAMPLE['fr']}\n\n\n12 34\n"
    extra = [(100, mixed, "en"), (101, SAMPLE["de"], "fr"), (102, SAMPLE["de"], " DE-at "), (103, SAMPLE["fr"], "und"), (104, None, "en"), (105, " \n ", "en"), (106, "123", None), (107, SAMPLE["en"], "English")]
    got = lang.segment_languages(corpus(spark, extra), profile_size=200)
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.segment_no, r.lang))
    assert sorted(by[100])[:2] == [(1, "en"), (2, "fr")] and len(by[100]) == 3
    assert by[101] == [(1, "de")] and 104 not in by and 105 not in by and by[106] == [(1, None)]
    assert {r.doc_id for r in lang.wrong_or_mixed(got).collect()} == {100, 101, 103}


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["EN", "en_CA", "fra", "Español", "xx", "", None, "it"]], "x string")
    assert [r.c for r in df.select(lang.label_code(F.col("x")).alias("c")).collect()] == ["en", "en", "fr", "es", None, None, None, None]


def test_no_labels_or_rows(spark):
    df = corpus(spark)
    assert lang.segment_languages(df.limit(0)).count() == 0
    assert {r.lang for r in lang.segment_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


# --- 6


def sets(t, width):
    w = W.plain_words(t)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize("longest_run", [20_000, 1])
def test_near_duplicates_equal_brute_force(spark, longest_run):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocab) for _ in range(120)] for _ in range(12)]
    texts = {}
    for k, b in enumerate(base):
        for v in range(4):
            c = list(b)
            for _ in range(rng.choice([0, 1, 3, 12])):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            texts[f"s:{k}-{v}"] = " ".join(c)
    texts |= {"s:same": texts["s:0-0"], "s:same2": "<b>" + texts["s:0-0"].upper() + "</b>", "s:short": "one two", "s:short2": "one, two", "s:none": None, "s:blank": " ", "s:tags": "<p></p>"}
    rows = [(k, t, 2, 5, "c") for k, t in texts.items()] + [("s:0-0", "older text", 1, 5, "c"), (None, texts["s:0-0"], 1, 5, "c"), ("s:1-0", texts["s:1-0"], 2, 5, "c")]
    df = spark.createDataFrame(rows, "key string, text string, at int, id int, class_id string")
    plan = nd.Plan(width=3, threshold=0.6, longest_run=longest_run)
    members, links = nd.near_duplicates(df, key="key", text="text", version="at", plan=plan, blocks=7)
    assert {r.key: r.size for r in nd.groups(members, links).collect()}["s:same"] >= 3
    got = {tuple(r) for r in nd.class_pairs(members, links).collect()}
    s = {k: x for k, t in texts.items() if (x := sets(t, 3))}
    want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.6 * len(s[a] | s[b])}
    assert got == want and len(want) > 40
    assert members.count() == len(s)


def test_large_class_is_not_squared(spark):
    df = spark.createDataFrame([(f"k{i:03d}", "same text of several words", i) for i in range(90)] + [("other", None, 1)], "key string, text string, n int")
    members, links = nd.near_duplicates(df, key="key", text="text", plan=nd.Plan(width=2, threshold=0.6))
    assert links.count() == 0 and members.filter("representative").count() == 1
    pairs = nd.class_pairs(members, links, expand=10).collect()
    assert len(pairs) == 89 and len({x for p in pairs for x in p}) == 90
    m, l = nd.near_duplicates(df.limit(0), key="key", text="text")
    assert m.count() == 0 and l.count() == 0 and nd.class_pairs(m, l).count() == 0 and nd.groups(m, l).count() == 0


def test_layouts_of_one_set_are_all_paired(spark):
    """Only byte-equal texts stand for each other; texts that differ in case or markup are paired one by one."""
    text = "one two three four five"
    rows = [(f"a{i:02d}", text) for i in range(20)] + [(f"b{i:02d}", f"<i>{text}</i>" + "!" * i) for i in range(15)]
    members, links = nd.near_duplicates(spark.createDataFrame(rows, "key string, text string"), key="key", text="text", plan=nd.Plan(width=2, threshold=0.6))
    got = {tuple(r) for r in nd.class_pairs(members, links, expand=10).collect()}
    b = [k for k, _ in rows[20:]]
    assert got == {("a00", k) for k, _ in rows[1:]} | {(x, y) for x in b for y in b if x < y}


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(50)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = nd.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(linked) and {r.node: r.root for r in got} == {x: find(x) for x in linked}


def test_recall_at_the_threshold(spark):
    """Pairs at a similarity of just 0.6: the guaranteed distance lies above the expected one, and none of 600 is lost."""
    plan = nd.Plan(width=1, threshold=0.6)
    assert plan.guaranteed >= plan.symbols * (1 - plan.threshold)
    rows = []
    for k in range(600):
        common = " ".join(f"c{k}x{i}" for i in range(60))
        rows += [(f"a{k}", common + "".join(f" a{k}x{i}" for i in range(20))), (f"b{k}", common + "".join(f" b{k}x{i}" for i in range(20)))]
    links = nd.near_duplicates(spark.createDataFrame(rows, "key string, text string"), key="key", text="text", plan=plan)[1]
    assert links.filter("similarity = 0.6").count() >= 599


def test_guarantee():
    """Every pair within the guaranteed distance shares an index key."""
    plan = nd.Plan()
    rng = np.random.default_rng(3)
    for _ in range(200):
        differs = set(rng.choice(plan.symbols, plan.guaranteed, replace=False).tolist())
        assert any(not differs & set(m) for m in plan.masks)


# --- 4


def test_cut_texts(spark):
    rng = random.Random(2)
    ends = ["in the north", "for all customers", "with great care", "on most days"]
    full = lambda: " ".join(f"You will {rng.choice(['test', 'build', 'check'])} {rng.choice(['tools', 'maps', 'carts'])} {rng.choice(ends)}." for _ in range(rng.randrange(6, 14)))
    rows, cut = [], set()
    for k in range(900):
        t = full() + rng.choice(["", "\nApply now", "\n- Free lunch\n- Good pay"])
        if k % 3 == 0 and len(t) > 200:
            t = t[:200]
        rows.append(("feed", str(k), t))
    # what stands at the limit in the middle of a sentence is cut
    cut = {k for _, k, t in rows if len(t) == 200 and not t.rstrip().endswith((".", "north", "customers", "care", "days"))}
    cases = [("x1", "<p>Good</p><p>Open"), ("x2", "<p>Good</p><ul><li"), ("x3", "You will test tools &am"), ("x4", "You will test tools in the…"), ("x5", "You will test tools,"), ("x6", "You will te")]
    fine = [("y1", "<p>You will test tools.</p>"), ("y2", "You will test tools with great care"), ("y3", "Done."), ("y4", "You will build maps.\n\nApply now")]
    rows += [("a", k, t) for k, t in cases + fine] + [("a", "n1", None), ("a", "n2", "  "), ("a", "x6", "You will te")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "source string, id string, text string, length int, kind string")
    out = tr.cut_texts(df, keys=["source", "id"], text="text", by="source").collect()
    got = {r.id for r in out if r.cut}
    assert len(out) == len(rows) - 2
    assert {k for k, _ in cases} <= got and not {k for k, _ in fine} & got
    assert len(cut - got) <= 0.02 * len(cut) and len(got - cut - {k for k, _ in cases}) <= 0.02 * len(rows)
    assert {(r.length, r.limit) for r in out if r.length == 200 and r.id.isdigit()} == {(200, True)}
    assert tr.cut_texts(df.limit(0), keys=["source", "id"], text="text", by="source").count() == 0


def test_marks_that_many_texts_share(spark):
    """Marks at a boundary, on copies of one text and at a field limit are cuts; only a line of many different texts is none."""
    assert tr.body("You will test tools in the... read more ") == ("You will test tools in the", True)
    word = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:03d}")
    rows = [("plain", f"p{k}", f"You will test {word(k)} tools. " * (1 + k % 7) + "Good pay.") for k in range(200)]
    edge = [("digest", f"e{k}", f"You will build {word(k)} carts. " * (1 + k % 9) + "... read more") for k in range(40)]
    copies = [("copied", f"c{k}", "You will check maps in the north with great...") for k in range(40)]
    # cut at 300 characters: another start each, one and the same end
    limit = [("field", f"l{k}", f"{word(k)} carts ".ljust(250, "x") + ". You check maps for all the customers who ask...".rjust(50, "y")) for k in range(40)]
    lines = [("closed", f"f{k}", f"You will sort {'many ' * k}boxes.\nFor more about this role...") for k in range(40)]
    df = spark.createDataFrame(rows + edge + copies + limit + lines, "source string, id string, text string")
    out = tr.cut_texts(df, keys=["source", "id"], text="text", by="source").collect()
    assert {len(t) for _, _, t in limit} == {300} and {r.limit for r in out if r.source == "field"} == {True}
    assert {r.id for r in out if r.cut} == {i for _, i, _ in edge + copies + limit}


def test_hazards(spark):
    lengths = [("s", n) for n in range(100, 300) for _ in range(2)] + [("s", 180)] * 150 + [(None, 5)]
    h = tr.length_hazards(spark.createDataFrame(lengths, "source string, length int"), by="source").filter("limit").collect()
    assert [(r.source, r.length) for r in h] == [("s", 180)]


def test_long_texts(spark):
    """A text of many paragraphs, and one of a single very long one."""
    many = "\n\n".join([SAMPLE["en"], SAMPLE["fr"]] * 600)
    one = (SAMPLE["de"] + " ") * 20_000
    got = lang.segment_languages(corpus(spark, [(500, many, "en"), (501, one, "en")]), profile_size=200).filter("doc_id >= 500")
    rows = {(r.doc_id, r.segment_no): r.lang for r in got.collect()}
    assert len(rows) == 1201 and rows[500, 1] == "en" and rows[500, 1200] == "fr" and rows[501, 1] == "de"
    df = spark.createDataFrame([("a", one), ("b", one + " x"), ("c", "x" * 3_000_000)], "key string, text string")
    members, links = nd.near_duplicates(df, key="key", text="text")
    assert members.count() == 3 and links.count() == 1
    cut = tr.cut_texts(df.withColumn("source", F.lit("s")), keys=["key"], text="text", by="source")
    assert cut.count() == 3
