import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text as T


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name, want", [("Lumo Kettle, Inc.", "LUMO KETTLE"), ("Vandor Corporation", "VANDOR"), ("ORRIN USA PLLC", "ORRIN"), ("Q&R  Co.", "Q&R"), (" , ", None), (None, None)])
def test_normalise_employer(spark, name, want):
    assert one(spark, C.normalise_employer, name) == want


@settings(max_examples=10, deadline=None)
@given(st.text(max_size=30))
def test_normaliser_is_idempotent(spark, name):
    once = one(spark, C.normalise_employer, name)
    assert once is None or one(spark, C.normalise_employer, once) == once


@pytest.mark.parametrize("text, want", [("listed 30+ days ago", dt.date(2024, 4, 1)), ("Listed today", dt.date(2024, 5, 1)), ("yesterday", dt.date(2024, 4, 30)), ("soon", None), (None, None)])
def test_relative_date(spark, text, want):
    assert one(spark, lambda c: C.relative_date(c, F.lit("2024-05-01").cast("date")), text) == want


def test_markup_and_slugs(spark):
    assert one(spark, C.html_to_text, "<p>Hi&nbsp;&amp; bye</p>") == "Hi & bye"
    assert one(spark, C.slug, "C++ / Go!") == "c-go" and one(spark, C.slug, "!!") == "unknown" and one(spark, C.slug, None) == "unknown"
    assert one(spark, C.title_without_place, "Kiln Operator, Saint Orly, OR") == "kiln operator"
    assert one(spark, C.bare_url, "https://a.b/c?d#e") == "https://a.b/c" and one(spark, C.url_host, "https://A.b/c") == "a.b"


def test_wages_and_medians(spark):
    assert one(spark, lambda c: C.annualise(c, F.lit("Hour")), 10.0, "double") == 20800.0
    assert one(spark, lambda c: C.annualise(c, F.lit("Fortnight")), 10.0, "double") is None
    assert one(spark, lambda c: C.annualise(c, F.lit("Year")), 0.0, "double") is None
    assert one(spark, C.upper_median, [4, 1, 3, 2], "array<int>") == 3 and one(spark, C.upper_median, [], "array<int>") is None


def test_keys(spark):
    assert one(spark, lambda c: C.surrogate_key(c, F.lit("b")), None) != one(spark, lambda c: C.surrogate_key(c, F.lit("b")), "")
    assert one(spark, C.content_hash, "a\r\nb ") == one(spark, C.content_hash, "a\nb")
    assert one(spark, lambda c: C.pct(c, F.lit(0), 1), 1, "int") is None


@pytest.mark.parametrize(
    "raw, want",
    [
        ("US-OR-Nestfield", ("us", "Oregon")), ("ca/ZZ-Somewhere", ("ca", None)), ("Orly, West Virginia", ("us", "West Virginia")), ("Orly, Québec", ("ca", "Quebec")), ("Orly, XX, ON", ("ca", "Ontario")), ("Orly, TX, ON", ("us", "Texas")),
        ("Washington, D.C.", ("us", "District of Columbia")), ("Remote - Canada", ("ca", None)), ("Remote, USA", ("us", None)), ("Remote", (None, None)), ("INDIA", (None, None)), (" ", (None, None)), (None, (None, None)), ("x" * 9000, (None, None)),
    ],
)
def test_place(spark, raw, want):
    assert tuple(one(spark, T.place, raw)) == want


def test_titles_and_names(spark):
    level = lambda t: one(spark, lambda c: T.first_rung(c, T.SENIORITY, "mid"), t)
    assert [level(t) for t in ["Senior Student Planner", "Kiln Analyst (4 months)", "Winter 2031 Planner", "Internal Auditor", "Sr Planner", "Jr. Planner", "Planner", None]] == ["intern", "intern", "intern", "mid", "senior", "entry", "mid", "mid"]
    assert one(spark, T.slug_variants, " The Orrin Labs, Inc. ") == ["theorrinlabsinc", "the-orrin-labs-inc", "orrin"] and one(spark, T.slug_variants, "!") == []
    assert one(spark, T.board_canon, "Orrin Kettle Co.") == "orrinkettle" and one(spark, T.board_canon, None) == ""
    assert one(spark, T.department, " 2317  Kiln   Team ") == "Kiln Team" and one(spark, T.department, " ") is None
    assert one(spark, T.name_candidates, "Company: Orrin Kettle.\nYou will work at Vandor Mills and join us. At the mill, with vandor mills") == ["Orrin Kettle", "Vandor Mills"]
    assert one(spark, lambda c: T.own_product(c, F.lit("kettle_db"), F.lit("Kettle DB")), "Kettle") is True and one(spark, lambda c: T.own_product(c, F.lit("kettle_db")), "") is False
    assert tuple(one(spark, T.split_key, "a:b:c")) == ("a", "b:c") and tuple(one(spark, T.split_key, "a")) == ("a", None)
    assert T.escape_like("5%_\\") == "5\\%\\_\\\\"


def test_numbers_in_prose(spark):
    assert one(spark, T.stated_numbers, "See https://a.b/365 for $85,000, 17% and 3.1x of 85000.") == ["85000", "17", "3.1"]
    assert set(one(spark, T.allowed_numbers, [0.17, 12.06], "array<double>")) == {"0.17", "0", "17", "0.2", "12.06", "12", "1206", "12.1"}
    assert one(spark, T.long_date, "March 5, 2026") == dt.date(2026, 3, 5) and one(spark, T.long_date, "5 March") is None
