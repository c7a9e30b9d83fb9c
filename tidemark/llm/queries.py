"""Queries of the llm operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, cooccurrence, entities, language, locations, mixing, neardup, topk, truncation
from tidemark.session import durable, new_path
from tidemark.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# --- 2: top N in every group


@query(
    "p2_found",
    """
WITH best AS (SELECT snapshot_date, tech_slug, company_name, max(postings) AS m FROM market_snapshot_companies WHERE postings IS NOT NULL GROUP BY 1, 2, 3)
SELECT strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date, tech_slug, company_name, CAST(place AS INT) AS place
FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_date, tech_slug ORDER BY m DESC, company_name) AS place FROM best) WHERE place <= 10
""",
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    top = topk.top_n_per_group(table(spark, d, "market_snapshot_companies"), group=["snapshot_date", "tech_slug"], item="company_name", score="postings", n=10)
    return top.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "tech_slug", "company_name", "place")


# --- 3: items that appear together

_PAIRS = """
WITH i AS (SELECT DISTINCT source, job_id, lower(trim(tech_slug)) AS t FROM posting_technologies WHERE trim(coalesce(tech_slug, '')) <> ''),
c AS (SELECT t, count(*) AS n FROM i GROUP BY t),
p AS (SELECT a.t AS tech_a, b.t AS tech_b, count(*) AS n_ab FROM i a JOIN i b ON a.source = b.source AND a.job_id = b.job_id AND a.t < b.t GROUP BY 1, 2),
s AS (SELECT tech_a, tech_b, n_ab, x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT (source, job_id)) FROM i) AS n FROM p JOIN c x ON x.t = tech_a JOIN c y ON y.t = tech_b)
"""


def _pair_counts(spark: SparkSession, d: str) -> cooccurrence.PairCounts:
    """The postings as they were delivered are loaded first, slugs in the spelling they came in; then the table is opened
    again and the postings whose slugs are spelled in another case are put right by signed deltas."""
    slug = F.trim("tech_slug")
    rows = table(spark, d, "posting_technologies").select(F.struct("source", "job_id").alias("basket"), slug.alias("typed"), F.lower(slug).alias("item"))
    rows = durable(rows.filter("item <> ''").distinct(), "basket-items")
    path = new_path(spark, "pair-counts")
    cooccurrence.PairCounts(spark, path).update(rows.select("basket", F.col("typed").alias("item")))
    wrong = rows.filter("typed <> item").select("basket").distinct()
    named = durable(rows.join(wrong, "basket", "left_semi"), "respelled")
    counts = cooccurrence.PairCounts(spark, path)
    counts.update(named.select("basket", "item").distinct(), named.select("basket", F.col("typed").alias("item")))
    return counts


@query("p3_found", _PAIRS + "SELECT tech_a, tech_b FROM s WHERE n_ab >= 8 AND n_ab * n >= 2 * n_a * n_b")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = _pair_counts(spark, d).scores()
    return s.filter("n_ab >= 8 and n_ab * n >= 2 * n_a * n_b").select(F.col("a").alias("tech_a"), F.col("b").alias("tech_b"))


@query("p3_lift", _PAIRS + "SELECT tech_a, tech_b, n_ab, n_a, n_b, round(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b), 6) AS lift FROM s")
def p3_lift(spark: SparkSession, d: str) -> DataFrame:
    s = _pair_counts(spark, d).scores()
    return s.select(F.col("a").alias("tech_a"), F.col("b").alias("tech_b"), "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


@query(
    "p3_moved",
    """
WITH l AS (SELECT max(snapshot_no) AS m FROM posting_snapshots),
i AS (SELECT DISTINCT snapshot_no - m AS k, company_name AS e, lower(trim(location_state)) AS t FROM posting_snapshots, l WHERE snapshot_no >= m - 1 AND company_name IS NOT NULL AND trim(coalesce(location_state, '')) <> ''),
c AS (SELECT k, t, count(*) AS n FROM i GROUP BY 1, 2),
p AS (SELECT a.k, a.t AS a, b.t AS b, count(*) AS n_ab FROM i a JOIN i b ON a.k = b.k AND a.e = b.e AND a.t < b.t GROUP BY 1, 2, 3),
moved AS (SELECT t FROM c GROUP BY t HAVING coalesce(max(n) FILTER (k = 0), 0) <> coalesce(max(n) FILTER (k = -1), 0))
SELECT p.a AS state_a, p.b AS state_b, p.n_ab, x.n AS n_a, y.n AS n_b FROM p
JOIN c x ON x.k = 0 AND x.t = p.a JOIN c y ON y.k = 0 AND y.t = p.b LEFT JOIN p o ON o.k = -1 AND o.a = p.a AND o.b = p.b
WHERE p.k = 0 AND (p.a IN (SELECT t FROM moved) OR p.b IN (SELECT t FROM moved) OR p.n_ab <> coalesce(o.n_ab, 0))
""",
)
def p3_moved(spark: SparkSession, d: str) -> DataFrame:
    """States that the same employers hire in: the pairs whose counts the last delivery moved, by a signed update of a table opened again."""
    p = table(spark, d, "posting_snapshots").filter("company_name is not null")
    last = p.agg(F.max("snapshot_no").alias("m")).first().m or 0
    before, now = (durable(cooccurrence.basket_items(p.filter(F.col("snapshot_no") == k), ["company_name"], F.lower(F.trim("location_state"))), "basket-items") for k in (last - 1, last))
    path = new_path(spark, "pair-counts")
    cooccurrence.PairCounts(spark, path).update(before)
    counts = cooccurrence.PairCounts(spark, path)
    s = counts.scores(touched_by=counts.update(now, before))
    return s.select(F.col("a").alias("state_a"), F.col("b").alias("state_b"), "n_ab", "n_a", "n_b")


# --- 8: evaluation texts in the corpus

_WORDS = r"regexp_extract_all(regexp_replace(lower({0}), '<[^<>]*>|&[a-z][a-z0-9]*;|&#[0-9]+;', ' ', 'g'), '[\p{{L}}\p{{N}}]+')"


def _windows(name: str, key: str, text: str, n: int, source: str) -> str:
    """SQL for the distinct runs of n plain words of each text."""
    words = _WORDS.format(text)
    return f"{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + {n - 1}], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {words} AS w FROM {source})))"


@query("p8_found", f"WITH {_windows('d', 'doc_id', 'text', 13, 'documents')}, {_windows('i', 'item_id', 'text', 13, 'eval_items')} SELECT DISTINCT doc_id, item_id FROM d JOIN i ON d.s = i.s")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.tile_overlaps(table(spark, d, "documents"), table(spark, d, "eval_items"), seed=13).select("doc_id", "item_id")


@query("p8_leak_report")
def p8_leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that hold 13 consecutive words of it, or in which tiles of 6 words or more cover half of it or more, in any order."""
    hits = contamination.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("coverage").alias("best_coverage"), F.max("longest").alias("longest"))


# --- 9: mixing sources


def _mixture(spark: SparkSession, d: str, **size):
    """tidemark.tokenizer names the vocabulary file, which every executor must be able to read."""
    vocabulary = spark.conf.get("tidemark.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    tokens = mixing.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"), vocabulary)
    return mixing.mix(durable(tokens, "tokens"), table(spark, d, "mix_targets"), **size)


@query("p9_mix_report")
def p9_mix_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the largest mixture that keeps every target share and every repetition limit."""
    return _mixture(spark, d)[1]


@query("p9_mixture")
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


@query("p9_tempered_report")
def p9_tempered_report(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of one and a half times the listed sources: the limits forbid the target shares at that size, and the exponent is bisected."""
    return _mixture(spark, d, epochs=1.5)[1]


@query("p9_entropy_report")
def p9_entropy_report(spark: SparkSession, d: str) -> DataFrame:
    """Source shares tempered to the entropy of the target shares."""
    shares = {str(k): r.target_share for k, r in enumerate(table(spark, d, "mix_targets").filter("target_share > 0").collect())}  # a row per source
    return _mixture(spark, d, entropy=mixing.entropy_of({k: v / sum(shares.values()) for k, v in shares.items()}))[1]


# --- 10: languages


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_or_mixed(language.segment_languages(table(spark, d, "documents"))).select("doc_id", "segment_no", "lang")


@query("p10_segments")
def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph of every document with its language and confidence."""
    return language.segment_languages(table(spark, d, "documents"))


# --- 5: typed locations to the canonical list


def _latest_locations(spark: SparkSession, d: str) -> DataFrame:
    """One (location, location_state) per posting key, of its latest load."""
    p = table(spark, d, "raw_postings").select("source", "job_id", "location", "location_state", "ingested_at")
    one = p.groupBy("source", "job_id").agg(F.max(F.struct("ingested_at", "location", "location_state")).alias("m"))
    return one.select("source", "job_id", "m.location", "m.location_state").filter(F.trim("location") != "")


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest_locations(spark, d)
    found = locations.map_locations(rows, table(spark, d, "ref_locations")).select(F.col("location").alias("l"), "hint", "location_id")
    return rows.join(found, (F.col("location") == F.col("l")) & F.col("location_state").eqNullSafe(F.col("hint"))).select("source", "job_id", "location_id")


@query("p5_unmatched")
def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that belong to no entry of the list, with the number of postings that use them."""
    found = locations.map_locations(_latest_locations(spark, d), table(spark, d, "ref_locations"))
    return found.filter("location_id = -1").select("location", F.col("hint").alias("location_state"), "city", "state", "uses")


# --- 6: near-duplicate postings

ADVERT = neardup.Plan(width=3, threshold=0.6)


def _adverts(spark: SparkSession, d: str):
    p = table(spark, d, "raw_postings").filter(F.trim(F.regexp_replace("description_raw", r"\s+", " ")) != "")
    text = F.concat_ws(" ", F.coalesce("job_title", F.lit("")), F.coalesce("company_name", F.lit("")), F.col("description_raw"))
    rows = p.select(F.concat_ws(":", "source", "job_id").alias("posting"), text.alias("advert"), "ingested_at")
    return neardup.near_duplicates(rows, key="posting", text="advert", version="ingested_at", plan=ADVERT)


_TEXTS = "(SELECT source || ':' || job_id AS k, arg_max(coalesce(job_title, '') || ' ' || coalesce(company_name, '') || ' ' || description_raw, ingested_at) AS t FROM raw_postings WHERE trim(regexp_replace(description_raw, '\\s+', ' ', 'g')) <> '' GROUP BY 1)"


@query(
    "p6_found",
    f"""WITH {_windows('s', 'k', 't', 3, _TEXTS)}, n AS (SELECT k, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2)
SELECT a AS posting_a, b AS posting_b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c >= 0.6 * (x.n + y.n - c)""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.class_pairs(*_adverts(spark, d))
    return pairs.select(F.col("key_a").alias("posting_a"), F.col("key_b").alias("posting_b"))


@query("p6_classes")
def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    """A row per posting: the class of equal adverts it belongs to and the number of other classes linked to it."""
    members, links = _adverts(spark, d)
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    first = members.filter("representative").select("class_id", F.col("key").alias("class_name"))
    return members.join(first, "class_id").join(n, "class_id", "left").select("key", "class_name", F.coalesce("links", F.lit(0)).alias("links"))


@query("p6_groups")
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """A row per posting: the group of adverts linked to it directly or through others, named by its least posting, and its size."""
    g = durable(neardup.groups(*_adverts(spark, d)), "groups")
    named = g.groupBy("group_id").agg(F.min("key").alias("group_name"))
    return g.join(named, "group_id").select(F.col("key").alias("posting"), "group_name", "size")


# --- 4: texts cut off


def _cut_postings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings")
    return truncation.cut_texts(p, keys=["source", "job_id"], text="description_raw", by="source")


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut_postings(spark, d).filter("cut").select("source", "job_id").distinct()


@query("p4_report")
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per source: postings with text, those cut, their share, how many of them end at a field limit, bear a mark of the
    source, or end incomplete elsewhere, and the field limits found."""
    c = F.col("cut")
    marked = F.col("kind") == truncation.MARKED
    per_key = _cut_postings(spark, d).groupBy("source", "job_id").agg(F.max("cut").alias("cut"), F.max(c & F.col("limit")).alias("at_limit"), F.max(c & marked).alias("marked"), F.max(F.when(F.col("limit"), F.col("length"))).alias("at"))
    return per_key.groupBy("source").agg(
        F.count("*").alias("postings"), F.count_if("cut").alias("cut"), F.avg(c.cast("int")).alias("cut_share"), F.count_if("at_limit").alias("cut_at_limit"), F.count_if(~F.col("at_limit") & F.col("marked")).alias("marked_elsewhere"),
        F.count_if(c & ~F.col("at_limit") & ~F.col("marked")).alias("cut_elsewhere"), F.array_sort(F.collect_set("at")).alias("limits"),
    )


# --- 7: employers behind the company names of postings


def _employers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "raw_postings").select("company_name", "job_title", "category", "salary_min", "salary_max").filter(F.trim("company_name") != "")
    e = table(spark, d, "dol_employer_summary").select("employer_key", "employer_name", "tech_soc_titles", "median_wage").filter("employer_key is not null")
    id_ = F.col("company_name").alias("id")
    titles = p.select(id_, F.explode(F.split(F.lower("job_title"), r"[^\p{L}]+")).alias("word"))
    categories = p.select(id_, F.concat(F.lit("category:"), F.col("category")).alias("word"))
    left_words = titles.unionByName(categories).filter("word <> ''").distinct()
    left_wage = p.select(id_, F.coalesce((F.col("salary_min") + F.col("salary_max")) / 2, "salary_min", "salary_max").alias("wage")).filter("wage between 20000 and 1000000")
    key = F.col("employer_key").alias("id")
    right = e.select(key, F.col("employer_name").alias("name")).unionByName(e.select(key, F.col("employer_key").alias("name")))
    right_words = e.select(key, F.explode("tech_soc_titles").alias("word"))
    right_wage = e.select(key, F.col("median_wage").alias("wage"))
    earlier = table(spark, d, "company_employer_key").filter(F.col("match_type").isin("exact", "alias_seed"))
    labels = earlier.select(F.col("company_name").alias("left_id"), F.col("employer_key").alias("right_id"))
    left = p.select(id_, F.col("company_name").alias("name"))
    return entities.match_entities(left, left_words, left_wage, right, right_words, right_wage, labels)


@query("p7_matches")
def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair with its probability of being one employer."""
    return _employers(spark, d).select(F.col("left_id").alias("company_name"), F.col("right_id").alias("employer_key"), "confidence")


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).filter("confidence >= 0.5").select("company_name", "employer_key")
