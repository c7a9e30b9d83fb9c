"""Market movement, shares, pairs, peers and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import blank_to_null, pct, surrogate_key
from tidemark.operators.relational import jaccard_peers, median, movement
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_DAILY = """
WITH daily AS (SELECT event_type AS tech_slug, CAST(ts AS DATE) AS snapshot_date, count(*) AS openings, CASE WHEN event_type IN ('error', 'signup') THEN 'rare' ELSE 'common' END AS category FROM events GROUP BY 1, 2, 4)
"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    c = F.when(F.col("event_type").isin("error", "signup"), "rare").otherwise("common").alias("category")
    return e.groupBy(F.col("event_type").alias("tech_slug"), F.to_date("ts").alias("snapshot_date"), c).agg(F.count("*").alias("openings"))


@query(
    "market_demand",
    _DAILY
    + """
, w AS (SELECT *, lag(openings) OVER p AS previous_openings, first_value(openings) OVER (PARTITION BY tech_slug ORDER BY snapshot_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS openings_7_back,
 first_value(openings) OVER (PARTITION BY tech_slug ORDER BY snapshot_date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS openings_30_back, count(*) OVER (PARTITION BY tech_slug) AS observations,
 rank() OVER (PARTITION BY snapshot_date ORDER BY openings DESC) AS day_rank, rank() OVER (PARTITION BY snapshot_date, category ORDER BY openings DESC) AS category_rank,
 round(100.0 * openings / nullif(sum(openings) OVER (PARTITION BY snapshot_date, category), 0), 1) AS category_share
 FROM daily WINDOW p AS (PARTITION BY tech_slug ORDER BY snapshot_date))
SELECT tech_slug, snapshot_date, openings, category, previous_openings, observations, openings_7_back,
 CASE WHEN openings_7_back > 0 AND observations > 1 THEN round(100.0 * (openings - openings_7_back) / openings_7_back, 1) END AS change_7_pct, openings_30_back,
 CASE WHEN openings_30_back > 0 AND observations > 1 THEN round(100.0 * (openings - openings_30_back) / openings_30_back, 1) END AS change_30_pct,
 CAST(day_rank AS INT) AS day_rank, CAST(category_rank AS INT) AS category_rank, category_share, observations >= 7 AS has_trend FROM w
""",
)
def market_demand(spark: SparkSession, d: str) -> DataFrame:
    m = movement(daily(spark, d), key="tech_slug", time="snapshot_date", value="openings", spans=(7, 30))
    day = Window.partitionBy("snapshot_date").orderBy(F.col("openings").desc())
    cat = Window.partitionBy("snapshot_date", "category")
    return m.withColumns(
        {
            "day_rank": F.rank().over(day),
            "category_rank": F.rank().over(cat.orderBy(F.col("openings").desc())),
            "category_share": pct(F.col("openings"), F.sum("openings").over(cat), 1),
            "has_trend": F.col("observations") >= 7,
        }
    )


@query("market_demand_range", _DAILY + "SELECT tech_slug, snapshot_date, openings, first_value(openings) OVER (PARTITION BY tech_slug ORDER BY snapshot_date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS openings_week_ago FROM daily")
def market_demand_range(spark: SparkSession, d: str) -> DataFrame:
    """Value a week ago by calendar days, not by rows."""
    w = Window.partitionBy("tech_slug").orderBy(F.datediff("snapshot_date", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    return daily(spark, d).select("tech_slug", "snapshot_date", "openings", F.first("openings").over(w).alias("openings_week_ago"))


@query(
    "market_snapshot_fact",
    _DAILY
    + """SELECT md5(concat_ws('-', strftime(snapshot_date, '%Y-%m-%d'), tech_slug)) AS snapshot_key, snapshot_date, tech_slug, openings,
 CAST(rank() OVER (PARTITION BY snapshot_date ORDER BY openings DESC) AS INT) AS day_rank, round(100.0 * openings / sum(openings) OVER (PARTITION BY snapshot_date), 2) AS day_share FROM daily""",
)
def market_snapshot_fact(spark: SparkSession, d: str) -> DataFrame:
    day = Window.partitionBy("snapshot_date")
    return daily(spark, d).select(
        surrogate_key(F.date_format("snapshot_date", "yyyy-MM-dd"), F.col("tech_slug")).alias("snapshot_key"), "snapshot_date", "tech_slug", "openings",
        F.rank().over(day.orderBy(F.col("openings").desc())).alias("day_rank"), pct(F.col("openings"), F.sum("openings").over(day), 2).alias("day_share"),
    )


@query("demand_by_category_latest", _DAILY + "SELECT category, sum(openings)::BIGINT AS openings, count(*) AS techs FROM daily WHERE snapshot_date = (SELECT max(snapshot_date) FROM daily) GROUP BY 1")
def demand_by_category_latest(spark: SparkSession, d: str) -> DataFrame:
    x = daily(spark, d)
    latest = x.agg(F.max("snapshot_date").alias("snapshot_date"))
    return x.join(F.broadcast(latest), "snapshot_date").groupBy("category").agg(F.sum("openings").alias("openings"), F.count("*").alias("techs"))  # one row


@query("pivot_month", "SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"avg(CASE WHEN event_type = '{t}' THEN value END) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def pivot_month(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.avg("value"))


@query(
    "bars_minmax",
    _DAILY
    + """SELECT tech_slug, snapshot_date, round(100.0 * openings / max(openings) OVER t, 1) AS bar,
 round(CASE WHEN max(openings) OVER t > min(openings) OVER t THEN (openings - min(openings) OVER t)::DOUBLE / (max(openings) OVER t - min(openings) OVER t) ELSE 0.5 END, 4) AS y,
 CAST(row_number() OVER (PARTITION BY tech_slug ORDER BY snapshot_date) AS INT) AS x FROM daily WINDOW t AS (PARTITION BY tech_slug)""",
)
def bars_minmax(spark: SparkSession, d: str) -> DataFrame:
    t = Window.partitionBy("tech_slug")
    top, low = F.max("openings").over(t), F.min("openings").over(t)
    y = F.when(top > low, (F.col("openings") - low) / (top - low)).otherwise(0.5)
    return daily(spark, d).select("tech_slug", "snapshot_date", pct(F.col("openings"), top, 1).alias("bar"), F.round(y, 4).alias("y"), F.row_number().over(t.orderBy("snapshot_date")).alias("x"))


@query(
    "cooccurrence_lift",
    """
WITH i AS (SELECT DISTINCT l_orderkey AS o, p_name AS t FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT t, count(*) AS n FROM i GROUP BY 1),
p AS (SELECT a.t AS tech_a, b.t AS tech_b, count(*) AS together FROM i a JOIN i b ON a.o = b.o AND a.t <> b.t GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT tech_a, tech_b, together, x.n AS n_a, round(100.0 * together / x.n, 1) AS pct_b_given_a, round((together::DOUBLE / x.n) / (y.n::DOUBLE / (SELECT count(DISTINCT o) FROM i)), 2) AS lift
FROM p JOIN c x ON x.t = tech_a JOIN c y ON y.t = tech_b""",
)
def cooccurrence_lift(spark: SparkSession, d: str) -> DataFrame:
    """Ordered pairs of part names in one order; each unordered pair is counted once, then mirrored."""
    i = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), "l_partkey").join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("t")), F.col("l_partkey") == F.col("p_partkey")).select("o", "t").distinct()
    c = i.groupBy("t").agg(F.count("*").alias("n"))
    p = i.select("o", F.col("t").alias("a")).join(i.select("o", F.col("t").alias("b")), "o").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("together")).filter("together >= 3")
    both = p.select(F.col("a").alias("tech_a"), F.col("b").alias("tech_b"), "together").unionByName(p.select(F.col("b").alias("tech_a"), F.col("a").alias("tech_b"), "together"))
    n = i.agg(F.countDistinct("o").alias("orders"))
    j = both.join(c.select(F.col("t").alias("tech_a"), F.col("n").alias("n_a")), "tech_a").join(c.select(F.col("t").alias("tech_b"), F.col("n").alias("n_b")), "tech_b").crossJoin(F.broadcast(n))  # one row
    lift = (F.col("together") / F.col("n_a")) / (F.col("n_b") / F.col("orders"))
    return j.select("tech_a", "tech_b", "together", "n_a", pct(F.col("together"), F.col("n_a"), 1).alias("pct_b_given_a"), F.round(lift, 2).alias("lift"))


@query(
    "peers_jaccard",
    """
WITH s AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey AS i FROM lineitem), z AS (SELECT supplier, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.supplier, b.supplier AS peer, count(*) AS shared FROM s a JOIN s b ON a.i = b.i AND a.supplier <> b.supplier GROUP BY 1, 2),
q AS (SELECT p.supplier, peer, shared, round(shared::DOUBLE / (x.n + y.n - shared), 3) AS similarity FROM p JOIN z x ON x.supplier = p.supplier JOIN z y ON y.supplier = peer WHERE shared >= 15)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY supplier ORDER BY similarity DESC, shared DESC, peer) AS INT) AS peer_rank FROM q WHERE similarity >= 0.015) WHERE peer_rank <= 6""",
)
def peers_jaccard(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("supplier"), "l_partkey")
    return jaccard_peers(s, entity="supplier", item="l_partkey", least_shared=15, least=0.015, k=6)


@query(
    "salary_band",
    """
WITH b AS (SELECT p_brand AS brand, year(l_shipdate) AS y, CAST(floor(l_extendedprice / 20000) * 20000 AS INT) AS bucket, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
t AS (SELECT y, max(bucket) AS top FROM b GROUP BY 1)
SELECT brand, CAST(b.y AS INT) AS y, sum(n)::BIGINT AS postings, round(100.0 * sum(CASE WHEN bucket = top THEN n ELSE 0 END) / sum(n), 1) AS top_band_pct,
 round(100.0 * sum(CASE WHEN bucket < 80000 THEN n ELSE 0 END) / sum(n), 1) AS low_pct, round(sum(bucket::DOUBLE * n) / sum(n), 0) AS floor_mean, sum(n) >= 150 AS enough FROM b JOIN t ON b.y = t.y GROUP BY 1, 2""",
)
def salary_band(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice").join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    b = j.groupBy(F.col("p_brand").alias("brand"), F.year("l_shipdate").alias("y"), (F.floor(F.col("l_extendedprice") / 20000) * 20000).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    x = b.join(b.groupBy("y").agg(F.max("bucket").alias("top")), "y")
    n = F.sum("n")
    return x.groupBy("brand", "y").agg(
        n.alias("postings"), pct(F.sum(F.when(F.col("bucket") == F.col("top"), F.col("n")).otherwise(0)), n, 1).alias("top_band_pct"),
        pct(F.sum(F.when(F.col("bucket") < 80000, F.col("n")).otherwise(0)), n, 1).alias("low_pct"), F.round(F.sum(F.col("bucket").cast("double") * F.col("n")) / n, 0).alias("floor_mean"), (n >= 150).alias("enough"),
    )


@query(
    "demand_history",
    """
WITH x AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS o, p_name AS t FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey),
m AS (SELECT month, count(DISTINCT o) AS total FROM x GROUP BY 1)
SELECT x.month, t AS tech_slug, count(DISTINCT o) AS postings, total, round(100.0 * count(DISTINCT o) / total, 2) AS share, total >= 500 AS enough FROM x JOIN m ON m.month = x.month GROUP BY 1, 2, 4""",
)
def demand_history(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("month"))
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("tech_slug")), F.col("l_partkey") == F.col("p_partkey"))
    x = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("month", "o_orderkey", "tech_slug").distinct()
    total = x.select("month", "o_orderkey").distinct().groupBy("month").agg(F.count("*").alias("total"))
    n = x.groupBy("month", "tech_slug").agg(F.count("*").alias("postings"))
    return n.join(total, "month").select("month", "tech_slug", "postings", "total", pct(F.col("postings"), F.col("total"), 2).alias("share"), (F.col("total") >= 500).alias("enough"))


@query(
    "rollup_weighted",
    """
WITH y AS (SELECT s_nationkey AS nation, l_suppkey AS s, year(l_shipdate) AS y, count(*) AS n, avg(l_extendedprice) AS wage FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
k AS (SELECT nation, s, sum(n) AS n, round(sum(wage * n) / sum(n), 2) AS wage FROM y GROUP BY 1, 2)
SELECT nation, sum(n)::BIGINT AS filings, count(*) AS entities, round(sum(wage * n) / sum(n), 2) AS wage FROM k GROUP BY 1""",
)
def rollup_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean per entity, rounded, then weighted again over entities."""
    j = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    y = j.groupBy(F.col("s_nationkey").alias("nation"), F.col("l_suppkey").alias("s"), F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("wage"))
    w = lambda: F.round(F.sum(F.col("wage") * F.col("n")) / F.sum("n"), 2).alias("wage")
    k = y.groupBy("nation", "s").agg(w(), F.sum("n").alias("n"))
    return k.groupBy("nation").agg(F.sum("n").alias("filings"), F.count("*").alias("entities"), w())


@query(
    "employer_summary",
    """
WITH x AS (SELECT l_suppkey AS employer_key, year(l_shipdate) AS fiscal_year, l_returnflag, l_partkey, CASE WHEN l_extendedprice BETWEEN 20000 AND 1000000 THEN l_extendedprice END AS wage, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT employer_key, fiscal_year, count(*) AS filings, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS certified, count(DISTINCT l_partkey) AS distinct_titles,
 quantile_disc(wage, 0.5) AS median_wage, quantile_disc(wage, 0.25) AS p25_wage, quantile_disc(wage, 0.75) AS p75_wage, max(wage) AS max_wage,
 array_to_string(list_slice(list_sort(list(DISTINCT p_brand)), 1, 5), ',') AS brands FROM x GROUP BY 1, 2)
SELECT employer_key, CAST(fiscal_year AS INT) AS fiscal_year, filings, certified, round(100.0 * certified / filings, 1) AS certified_pct, distinct_titles, median_wage, p25_wage, p75_wage, max_wage, brands,
 CAST(rank() OVER (PARTITION BY fiscal_year ORDER BY filings DESC) AS INT) AS rank_in_year FROM g""",
)
def employer_summary(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_partkey", F.when(F.col("l_extendedprice").between(20000, 1000000), F.col("l_extendedprice")).alias("wage"))
    x = l.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    q = lambda p: F.percentile_approx("wage", p, 1000000)
    g = x.groupBy(F.col("l_suppkey").alias("employer_key"), F.year("l_shipdate").alias("fiscal_year")).agg(
        F.count("*").alias("filings"), F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("certified"), F.countDistinct("l_partkey").alias("distinct_titles"),
        q(0.5).alias("median_wage"), q(0.25).alias("p25_wage"), q(0.75).alias("p75_wage"), F.max("wage").alias("max_wage"),
        F.array_join(F.slice(F.array_sort(F.collect_set("p_brand")), 1, 5), ",").alias("brands"),
    )
    return g.withColumns({"certified_pct": pct(F.col("certified"), F.col("filings"), 1), "rank_in_year": F.rank().over(Window.partitionBy("fiscal_year").orderBy(F.col("filings").desc()))})


@query("medians", "SELECT l_suppkey AS s, median(l_extendedprice) AS exact, quantile_disc(l_quantity, 0.5) AS discrete, list_sort(list(l_quantity))[CAST(floor(count(l_quantity) / 2) AS INT) + 1] AS upper FROM lineitem GROUP BY 1")
def medians(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated, discrete and upper median, from value histograms, so no group is collected row by row."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), "l_extendedprice", "l_quantity")
    prices = l.groupBy("s", "l_extendedprice").agg(F.count("*").alias("n"))
    h = l.groupBy("s", "l_quantity").agg(F.count("*").alias("n"))
    w = Window.partitionBy("s")
    upto = F.sum("n").over(w.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0))
    least = lambda k: F.min(F.when(F.col("upto") >= k, F.col("l_quantity")))
    up = h.withColumns({"upto": upto, "all": F.sum("n").over(w)}).groupBy("s").agg(least(F.ceil(F.col("all") / 2)).alias("discrete"), least(F.floor(F.col("all") / 2) + 1).alias("upper"))
    return median(prices, ["s"], "l_extendedprice", "n", "exact").join(up, "s")


@query(
    "rare_items",
    """
WITH x AS (SELECT DISTINCT trim(company_name) AS company, r.source, r.job_id, lower(trim(tech_slug)) AS t FROM raw_postings r JOIN posting_technologies p ON r.source = p.source AND r.job_id = p.job_id WHERE nullif(trim(company_name), '') IS NOT NULL AND trim(coalesce(tech_slug, '')) <> ''),
own AS (SELECT company, t, count(*) AS n FROM x GROUP BY 1, 2), b AS (SELECT t, count(*) AS breadth FROM own GROUP BY 1), k AS (SELECT count(DISTINCT company) AS companies FROM own)
SELECT company, own.t AS tech_slug, n, breadth, round(100.0 * breadth / companies, 1) AS share FROM own JOIN b ON b.t = own.t, k WHERE n >= 3 AND breadth <= 0.1 * companies""",
)
def rare_items(spark: SparkSession, d: str) -> DataFrame:
    """Items an entity uses at least three times and few entities use at all."""
    p = table(spark, d, "raw_postings").select("source", "job_id", blank_to_null(F.col("company_name")).alias("company")).filter("company is not null").distinct()
    t = table(spark, d, "posting_technologies").select("source", "job_id", blank_to_null(F.lower("tech_slug")).alias("tech_slug")).filter("tech_slug is not null").distinct()
    own = p.join(t, ["source", "job_id"]).groupBy("company", "tech_slug").agg(F.count("*").alias("n"))
    breadth = own.groupBy("tech_slug").agg(F.count("*").alias("breadth"))
    k = own.agg(F.countDistinct("company").alias("companies"))
    j = own.filter("n >= 3").join(breadth, "tech_slug").crossJoin(F.broadcast(k)).filter("breadth <= 0.1 * companies")  # one row
    return j.select("company", "tech_slug", "n", "breadth", pct(F.col("breadth"), F.col("companies"), 1).alias("share"))


@query(
    "baseline_minus_self",
    """
WITH own AS (SELECT c_mktsegment AS seg, o_custkey AS c, count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT seg, c, n, f, round((sum(f) OVER w - f)::DOUBLE / nullif(sum(n) OVER w - n, 0), 4) AS peer_share FROM own WINDOW w AS (PARTITION BY seg)""",
)
def baseline_minus_self(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    own = o.groupBy(F.col("c_mktsegment").alias("seg"), F.col("o_custkey").alias("c")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"))
    total = own.groupBy("seg").agg(F.sum("n").alias("tn"), F.sum("f").alias("tf"))
    return own.join(total, "seg").select("seg", "c", "n", "f", F.round((F.col("tf") - F.col("f")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0)), 4).alias("peer_share"))


@query("top_two_ratio", "WITH c AS (SELECT source, company_name, count(*) AS n FROM raw_postings WHERE company_name IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, company_name) AS k FROM c) SELECT source, round(max(CASE WHEN k = 1 THEN n END)::DOUBLE / max(CASE WHEN k = 2 THEN n END), 3) AS ratio FROM r WHERE k <= 2 GROUP BY 1")
def top_two_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "raw_postings").filter("company_name is not null").groupBy("source", "company_name").agg(F.count("*").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n").desc(), "company_name"))).filter("k <= 2")
    return r.groupBy("source").agg(F.round(F.max(F.when(F.col("k") == 1, F.col("n"))) / F.max(F.when(F.col("k") == 2, F.col("n"))), 3).alias("ratio"))


@query(
    "groups_by_total",
    """WITH c AS (SELECT t.category, t.tech_slug, count(p.job_id) AS n FROM technologies t LEFT JOIN posting_technologies p ON p.tech_slug = t.tech_slug GROUP BY 1, 2),
g AS (SELECT *, sum(n) OVER (PARTITION BY category)::BIGINT AS total, row_number() OVER (PARTITION BY category ORDER BY n DESC, tech_slug) AS place FROM c)
SELECT category, tech_slug, n, total, CAST(place AS INT) AS place FROM g WHERE place <= 10""",
)
def groups_by_total(spark: SparkSession, d: str) -> DataFrame:
    """Top 10 inside each group, with the group total that orders the groups."""
    used = table(spark, d, "posting_technologies").groupBy("tech_slug").agg(F.count("job_id").alias("n"))
    c = table(spark, d, "technologies").select("category", "tech_slug").join(used, "tech_slug", "left").fillna(0, ["n"])
    w = Window.partitionBy("category")
    g = c.withColumns({"total": F.sum("n").over(w), "place": F.row_number().over(w.orderBy(F.col("n").desc(), "tech_slug"))})
    return g.filter("place <= 10").select("category", "tech_slug", "n", "total", "place")
