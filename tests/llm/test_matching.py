import pytest
from pyspark.sql import functions as F

from tidemark.llm import entities as en
from tidemark.llm import locations as lo
from tidemark.llm import mixing as mx

REF = [(1, "Falford", "Arizona", "AZ"), (2, "Falford", "North Carolina", "NC"), (3, "Saint Quorwick", "Virginia", "VA"), (4, "Brincombe", "Texas", "TX"), (5, "Kelville Falls", "Ontario", "ON"), (6, "Nestfield", "Oregon", "OR"), (7, "Langdale", "Minnesota", "MN")]


def ref(spark):
    return spark.createDataFrame(REF + [REF[0], (None, "Nowhere", "Texas", "TX"), (8, None, "Texas", "TX")], "location_id long, city string, state string, state_code string")


CASES = [
    ("Falford, AZ", None, 1), ("FALFORD NC", "Arizona", 2), ("Falford", "nc", 2), ("Falford", None, -1), ("Falford", "Texas", -1), ("St. Quorwick, Virginia", None, 3), ("US-TX-Brincmbe", None, 4), ("Building 3, Brincombe, Texas", None, 4),
    ("Brincombe TX 12345", None, 4), ("Greater Brincombe Area", "Ohio", 4), ("CA-ON-Kelville Falls", None, 5), ("Remote or - Nestfield, OR", None, 6), ("nestfield, or", None, 6), ("Nestfield (2 days remote)", None, 6), ("Lángdalé, Highmark County", None, 7),
    ("Langdale, TX", None, -1), ("Texas, USA", "Texas", -1), ("Remote", None, -1), ("Millford, TX", None, -1), ("2 locations", None, -1), ("x" * 5000, None, -1), (None, "Texas", None), (" ", "Texas", None),
]


def test_locations(spark):
    df = spark.createDataFrame([(t, h, 9, "z") for t, h, _ in CASES for _ in range(2)], "location string, location_state string, location_id int, city string")
    got = {(r.location, r.hint): (r.location_id, r.uses) for r in lo.map_locations(df, ref(spark)).collect()}
    assert got == {(t, h): (w, 2) for t, h, w in CASES if w is not None}
    assert lo.map_locations(df.limit(0), ref(spark)).count() == 0
    assert {r.location_id for r in lo.map_locations(df, ref(spark).limit(0)).collect()} == {-1}


def test_edit_distance():
    assert [lo.edit_distance(a, b) for a, b in [("abcd", "abdc"), ("abc", "abc"), ("abc", "axc"), ("abc", "ab"), ("", "ab"), ("abcdef", "x")]] == [1, 0, 1, 1, 2, 4]


def one_slip(n):
    return {x for k in range(len(n)) for x in (n[:k] + n[k + 1 :], n[: k + 1] + "q" + n[k + 1 :], n[:k] + "q" + n[k + 1 :], n[:k] + n[k : k + 2][::-1] + n[k + 2 :])}


def test_names_in_reach_equal_brute_force(spark):
    """Every name within the allowed slips, as a look at the whole list finds it; short names with one swap too."""
    names = ["falford", "lorport", "mosgate", "ashford", "wexford", "ashwick", "kelville falls", "saint quorwick hills", "banana", "oak"]
    typed = {x for n in names for x in one_slip(n)} | {"flaford", "qaint quorwick hilsl", "aint quorwick hill", "x" * 5000, "q"} | set(names)
    df = lambda rows, c: spark.createDataFrame([(x,) for x in sorted(rows)], f"{c} string")
    got = lo.near_names(df(typed, "city"), df(names, "name"), 0.15).collect()
    want = {(t, n) for t in typed for n in names if (t == n or t not in names) and lo.edit_distance(t, n, lo.slips(t)) <= lo.slips(t)}
    assert len(got) == len(want) and {(r.city, r.name) for r in got} == want


def test_answers_do_not_depend_on_list_size(spark):
    """Typed values of a short list mean the same when the list has many other names, in as many partitions as there are."""
    near = [(k, n, "Texas", "TX") for k, n in enumerate(["Varlow", "Harlow", "Tostead"])]
    typed = [("Xarlow", None), ("Tosetad", None), ("Varlow, TX", None), ("Tostaed", "TX"), ("Nowhere", None)]
    rows = spark.createDataFrame(typed, "location string, location_state string")
    schema = "location_id long, city string, state string, state_code string"
    many = near + [(100 + k, f"Q{k:05d}zz", "Ohio", "OH") for k in range(3000)]
    answers = [{(r.location, r.hint): r.location_id for r in lo.map_locations(rows, spark.createDataFrame(x, schema).repartition(n)).collect()} for x, n in ((near, 1), (near, 7), (many, 5))]
    assert answers[0] == answers[1] == answers[2] == {("Xarlow", None): -1, ("Tosetad", None): 2, ("Varlow, TX", None): 0, ("Tostaed", "TX"): 2, ("Nowhere", None): -1}


def test_names():
    lines = en.Lines([("MANUFACTURING", 50), ("FOODS", 40), ("MFG", 9)])
    assert lines.split("Lotada Febako Mfg. Corporation") == ("LOTADAFEBAKO", "MANUFACTURING", "LOTADA", "LF")
    assert lines.split("The Lotádà-Febako Global Foods Group, LLC") == ("LOTADAFEBAKO", "FOODS", "LOTADA", "LF")
    assert lines.split("LotadaFebako Foods c/o Some Staffing")[:2] == lines.split("Lotada & Febako Food (USA)")[:2] == ("LOTADAFEBAKO", "FOODS")
    assert lines.split("Inc.") == ("", None, "", "")


def test_entities(spark):
    brands = ["lotada febako", "kebake korimi", "rapodo bararo", "zogogo koleva", "mirata gafeba", "tidana konobo", "pofafe rovala", "denano gakaro", "sasava sarama", "levasa mirife"]
    lines = ["Foods", "Energy", "Logistics"]
    left, right, truth, labels, words = [], [], set(), [], []
    for i, b in enumerate(brands):
        for j, l in enumerate(lines):
            if (i + j) % 3 == 2:
                continue
            name, key = f"{b.title()} {l}", f"{b.upper()} {l.upper()}"
            left += [name, f"{name}, Inc."]
            right.append((key, f"{key} GLOBAL LLC"))
            truth |= {(n, key) for n in (name, f"{name}, Inc.")}
            labels.append((name, key))
            words += [(name, f"job{j}"), (f"{name}, Inc.", f"job{j}")]
    left += ["Lotada Febbako Foods", "Lotada Febako", None, " ", "LLC", "Unknown Maker Foods"]
    words.append(("Lotada Febako", "job0"))
    truth |= {("Lotada Febbako Foods", "LOTADA FEBAKO FOODS"), ("Lotada Febako", "LOTADA FEBAKO FOODS")}
    l = spark.createDataFrame([(n, n, 1) for n in left * 2], "id string, name string, confidence int")
    r = spark.createDataFrame([(k, n) for k, n in right] + [(None, "NOBODY"), ("GONE", None)], "id string, name string")
    w = spark.createDataFrame([*words, ("x", None), (None, "y")], "id string, word string")
    none = spark.createDataFrame([], "id string, word string")
    wage = spark.createDataFrame([(left[0], 100.0), (left[1], None)], "id string, wage double")
    lab = spark.createDataFrame([*labels, ("nobody", "NOTHING"), (None, "x")], "left_id string, right_id string")
    got = en.match_entities(l, w, wage, r, none, wage.limit(0), lab).collect()
    assert len({(x.left_id, x.right_id) for x in got}) == len(got)
    assert {(x.left_id, x.right_id) for x in got if x.confidence >= 0.5} == truth
    unlabelled = en.match_entities(l, w, wage, r, none, wage.limit(0), lab.limit(0)).collect()
    assert {(x.left_id, x.right_id) for x in unlabelled if x.confidence >= 0.5} == truth
    assert en.match_entities(l.limit(0), w, wage, r, none, wage, lab).count() == 0


def test_only_lines_of_business_are_broadcast(spark, monkeypatch):
    """What grows with the names is joined by merging, however small it looks: a brand makes 24 rows that no estimate counts."""
    plans, write = {}, en.durable

    def seen(df, label):
        df.collect()
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0])
        return write(df, label)

    monkeypatch.setattr(en, "durable", seen)
    names = spark.createDataFrame([(f"Bo{a}ra Ke{b}mi {l}",) * 2 for a in "klmnp" for b in "rstv" for l in ("Foods", "Energy")], "id string, name string")
    words, wage = names.selectExpr("id", "'cook' AS word"), names.selectExpr("id", "100.0D AS wage")
    assert en.match_entities(names, words, wage, names, words, wage, names.selectExpr("id AS left_id", "id AS right_id")).count() >= 40
    broadcasts = {label: max(p.count("BroadcastExchange") for p in x) for label, x in plans.items()}
    assert {label for label, n in broadcasts.items() if n} <= {"left", "right"} and max(broadcasts.values()) <= 2  # a row a line
    assert "SortMergeJoin" in plans["pairs"][0]


def test_model_is_calibrated_on_held_out_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    n = 6000
    sim = rng.random(n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(8 * sim - 4)))).astype(int)
    rows = [(str(i), "r", *[float(sim[i]) if f == "similarity" else 0.0 for f in en.FEATURES], int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "left_id string, right_id string, " + ", ".join(f"{f} double" for f in en.FEATURES) + ", label int")
    m = en.train(df.filter("cast(left_id as int) < 4000"))
    p = df.filter("cast(left_id as int) >= 4000").select(m.probability().alias("p"), "label").toPandas()
    for lo_, hi in [(0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1)]:
        b = p[(p.p >= lo_) & (p.p < hi)]
        assert abs(b.p.mean() - b.label.mean()) < 0.08


# --- 9


def test_plan():
    size, a, w = mx.plan({"a": 100, "b": 1000}, {"a": (0.5, 4), "b": (0.5, 2), "gone": (0.2, 1)})
    assert (size, a, w) == (800, 1.0, {"a": 0.5, "b": 0.5})
    size, a, w = mx.plan({"a": 100, "b": 1000}, {"a": (0.5, 4), "b": (0.5, 2)}, total=1600)
    assert size == 1600 and 0 < a < 1 and abs(w["a"] * size - 400) < 1
    assert mx.plan({}, {"a": (1.0, 1)}) == (0, 1.0, {})


def test_exponent_solved_independently():
    """The exponent is the last point of a fine grid at which every source stays within its limit."""
    import numpy as np

    rng = np.random.default_rng(8)
    for _ in range(40):
        tokens = {f"s{k}": int(x) for k, x in enumerate(rng.integers(10, 10**6, 6))}
        shares = rng.dirichlet(np.ones(6))
        targets = {f"s{k}": (float(shares[k]), int(rng.integers(1, 5))) for k in range(6)}
        total = sum(tokens.values())
        size, a, w = mx.plan(tokens, targets, total=total)
        grid = np.linspace(0, 1, 20_001)[:, None]
        s, q, r = (np.array([f(k) for k in tokens]) for f in (lambda k: tokens[k], lambda k: targets[k][0], lambda k: targets[k][1]))
        raw = (s / s.sum()) ** (1 - grid) * q**grid
        fits = (raw / raw.sum(1, keepdims=True) * total <= r * s * (1 + 1e-9)).all(1)
        assert abs(a - grid[np.nonzero(fits)[0][-1], 0]) < 1e-4 and size <= total
        assert all(w[k] * size <= targets[k][1] * tokens[k] * (1 + 1e-9) for k in tokens)


def test_entropy():
    tokens, targets = {"x": 900, "y": 100}, {"x": (0.5, 2), "y": (0.5, 2)}
    _, a, w = mx.plan(tokens, targets, entropy=0.5)
    assert abs(mx.entropy_of(w) - 0.5) < 1e-6 and 0 < a < 1
    _, a, w = mx.plan(tokens, targets, entropy=0.2)
    assert abs(mx.entropy_of(w) - 0.2) < 1e-6 and a > 1
    assert mx.plan({}, targets, entropy=0.5) == (0, 1.0, {})


@pytest.mark.parametrize("name", ["p9_mix_report", "p9_tempered_report", "p9_entropy_report"])
def test_mixture_reports(spark, name):
    """Every share within one document of its weight, no document over its limit, the exponent where the size puts it."""
    from tidemark.llm import queries as q

    rows = [r for r in q.QUERIES[name](spark, "/root/testdata/sf0.01").collect()]
    used = [r for r in rows if r.weight > 0]
    assert len(rows) == 12 and len(used) > 5 and abs(sum(r.weight for r in used) - 1) < 1e-9
    for r in used:
        assert 0 <= r.budget_tokens - r.drawn_tokens < 5000 and r.most_repeats <= r.max_repeats
        assert r.drawn_tokens <= r.max_repeats * r.tokens_available
    exponent, = {r.exponent for r in rows}
    assert exponent == 1 if name == "p9_mix_report" else 0 < exponent < 1 if name == "p9_tempered_report" else exponent > 0
    if name == "p9_mix_report":
        z = sum(r.target_share for r in used)
        assert all(abs(r.actual_share - r.target_share / z) < 0.01 for r in used)


def test_mix(spark):
    docs = [(i, "A " if i % 2 else "a", 10, "p") for i in range(60)] + [(1000 + i, "b-c", 7, "p") for i in range(300)] + [(5000, None, 5, "p"), (None, "a", 5, "p"), (5001, "a", None, "p"), (5002, "zzz", 9, "p")]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long, block string")
    t = spark.createDataFrame([("a", 0.5, 3), ("B_C", 0.5, 1), ("none", 0.1, 2), (None, 0.3, 1), ("zzz", None, 2)], "source string, target_share double, max_repeats int")
    for docs_a_range in (20_000, 2):
        drawn, report = mx.mix(df, t, range_docs=docs_a_range)
        rows = drawn.collect()
        uses = {}
        for r in rows:
            uses.setdefault((r.source, r.doc_id), []).append(r.block)
        assert all(sorted(b) == list(range(1, len(b) + 1)) and len(b) <= {"a": 3, "b_c": 1}[s] for (s, _), b in uses.items())
        rep = {r.source: r for r in report.collect()}
        assert abs(rep["a"].actual_share - 0.5) < 0.01 and rep["none"].drawn_tokens == 0
        assert sum(r.tokens for r in rows) == sum(r.drawn_tokens for r in rep.values())
    # every document of a whole block is in it
    assert sum(1 for (s, _), b in uses.items() if s == "a") == 60
    drawn, report = mx.mix(df.limit(0), t)
    assert drawn.count() == 0 and report.count() == 4


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, tokens int")
    assert sorted(tuple(r) for r in mx.token_counts(df, "/opt/tokenizers/byte_bpe_50k.tiktoken").select("doc_id", "tokens").collect()) == [(1, 2), (2, 0), (3, 0)]
