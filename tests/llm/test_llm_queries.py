"""Queries with SQL agree with it; of the others, the whole result keeps what their problem says of it."""

import glob
import os

import duckdb
import pytest

from tidemark.llm import queries as q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.fixture(scope="module")
def result(spark):
    """Rows of a query as tuples by column name; each is run once."""
    held = {}

    def run(name):
        if name not in held:
            df = q.QUERIES[name](spark, DATA)
            held[name] = df.columns, df.collect()
        return held[name][1]

    run.columns = lambda name: held[name][0]
    return run


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(result, duck, name):
    rows = result(name)
    columns = sorted(result.columns(name))
    r = duck.execute(q.ORACLE[name])
    cols = [x[0] for x in r.description]
    at = [cols.index(x) for x in sorted(cols)]
    assert columns == sorted(cols)
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(tuple(row[i] for i in at)) for row in r.fetchall())


def keys(duck, what):
    return {tuple(r) for r in duck.execute(f"select distinct source, job_id from raw_postings where {what}").fetchall()}


def test_cut_texts(result, duck):
    cut = [(r.source, r.job_id) for r in result("p4_found")]
    report = {r.source: r for r in result("p4_report")}
    assert len(cut) == len(set(cut)) and set(cut) <= keys(duck, "trim(description_raw) <> ''")
    assert sum(r.postings for r in report.values()) == len(keys(duck, "trim(description_raw) <> ''"))
    for s, r in report.items():
        assert r.cut == sum(1 for x, _ in cut if x == s) == r.cut_at_limit + r.marked_elsewhere + r.cut_elsewhere


def test_locations(result, duck):
    found = {(r.source, r.job_id): r.location_id for r in result("p5_found")}
    listed = {r[0] for r in duck.execute("select location_id from ref_locations").fetchall()}
    assert len(found) == len(result("p5_found")) and set(found.values()) <= listed | {-1}
    assert sum(1 for x in found.values() if x == -1) == sum(r.uses for r in result("p5_unmatched"))
    exact = duck.execute("select source, job_id, min(location_id) from raw_postings join ref_locations on lower(location) = lower(city || ', ' || state_code) group by 1, 2 having count(distinct location_id) = 1 and count(distinct location) = 1").fetchall()
    assert exact and all(found[s, j] == i for s, j, i in exact)


def test_near_duplicates(result, duck):
    pairs = [(r.posting_a, r.posting_b) for r in result("p6_found")]
    group = {r.posting: r.group_name for r in result("p6_groups")}
    classes = result("p6_classes")
    assert len(group) == len(classes) == len(keys(duck, "trim(description_raw) <> ''"))
    assert all(group[a] == group[b] for a, b in pairs)
    assert len({x for p in pairs for x in p}) == sum(1 for r in result("p6_groups") if r.size > 1)


def test_entities(result):
    matches = {(r.company_name, r.employer_key): r.confidence for r in result("p7_matches")}
    assert len(matches) == len(result("p7_matches")) and all(0 <= c <= 1 for c in matches.values())
    assert {(r.company_name, r.employer_key) for r in result("p7_found")} == {k for k, c in matches.items() if c >= 0.5}


def test_leak_report(result):
    documents = {}
    for r in result("p8_found"):
        documents.setdefault(r.item_id, set()).add(r.doc_id)
    report = {r.item_id: r for r in result("p8_leak_report")}
    assert set(documents) <= set(report) and all(report[i].documents >= len(d) and report[i].longest >= 13 for i, d in documents.items())


def test_mixture(result):
    report = {r.source: r for r in result("p9_mix_report")}
    drawn = {}
    for r in result("p9_mixture"):
        drawn.setdefault(r.source, []).append(r)
    for s, r in report.items():
        assert r.drawn_tokens == sum(x.tokens for x in drawn.get(s, [])) and all(x.block <= r.max_repeats for x in drawn.get(s, []))
    assert all({r.exponent for r in result(n)} for n in ("p9_tempered_report", "p9_entropy_report"))


def test_languages(result):
    segments = {(r.doc_id, r.segment_no): r.lang for r in result("p10_segments")}
    found = {(r.doc_id, r.segment_no): r.lang for r in result("p10_found")}
    assert len(segments) == len(result("p10_segments")) and found.items() <= segments.items()
    assert all(0 <= r.confidence <= 1 for r in result("p10_segments"))


def test_all_are_held_to_something():
    assert set(q.QUERIES) - set(q.ORACLE) == {"p4_found", "p4_report", "p5_found", "p5_unmatched", "p6_classes", "p6_groups", "p7_matches", "p7_found", "p8_leak_report", "p9_mix_report", "p9_mixture", "p9_tempered_report", "p9_entropy_report", "p10_found", "p10_segments"}
