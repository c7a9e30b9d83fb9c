"""Mapping typed locations to a canonical list of cities.

Values are deduplicated, taken apart into a city and a state, and the city is normalised. An inverted index of
character n-grams gives the candidate names; a candidate is scored by the cosine of n-gram vectors under
inverse-frequency weights, and accepted above a threshold, with a margin to the next one, if an exact check finds it
within the typing slips allowed. A state decides among cities of one name. Everything else is reported as
unmatched (-1).

Retrieval is by joins on n-grams, for lists of any length alike. A slip changes at most three padded 2-grams of what
was typed (a swap of neighbours), so of any 3 * slips + 1 of them a name in reach has one: the rarest in the list
are looked up, and frequent n-grams are not expanded.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable, spread

# Words that decorate a typed place, and spellings of the two countries.
DECORATION = ["building", "greater", "area", "metro", "downtown", "hybrid", "onsite", "remote", "flexible", "anywhere", "various", "multiple", "locations", "nationwide", "home", "office", "tbd", "days", "day", "see", "description", "field", "based", "suburb", "suburbs", "region", "near", "north of", "city of", "campus", "headquarters", "hq", "floor", "suite", "unit"]
COUNTRIES = ["usa", "us", "united states", "united states of america", "u s a", "u s", "can", "canada"]
SHORT = {"st": "saint", "ste": "saint", "ft": "fort", "mt": "mount"}


def plain(s: str) -> str:
    """Lower case, accents off, anything but letters, digits and the separators , - / | ( ) as a blank."""
    s = unicodedata.normalize("NFKD", s.lower())
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.sub(r"[^\w,\-/|()]|_", " ", s)


def city_form(s: str) -> str:
    """Words of a city name with Saint, Fort and Mount written out."""
    words = re.findall(r"\w+", plain(s))
    return " ".join([SHORT.get(w, w) if i == 0 and len(words) > 1 else w for i, w in enumerate(words)])


class Parser:
    """Takes a typed location apart, given the list's states: name and code of each."""

    def __init__(self, states: list[tuple[str, str]]):
        self.name = {" ".join(re.findall(r"\w+", plain(n))): n for n, _ in states if n}
        self.code = {c.lower(): n for n, c in states if n and c}
        self.longest = max((len(n.split()) for n in self.name), default=1)
        words = sorted(DECORATION, key=len, reverse=True)
        self.noise = re.compile(r"\b(?:" + "|".join(words) + r")\b")
        self.country = re.compile(r"\b(?:" + "|".join(sorted(COUNTRIES, key=len, reverse=True)) + r")\b")

    def state(self, s: str | None) -> str | None:
        """The state that a whole value names, by name or code."""
        w = " ".join(re.findall(r"\w+", plain(s))) if s else ""
        return self.name.get(w) or self.code.get(w)

    def __call__(self, typed: str) -> tuple[str, str | None]:
        """(city, state) of a location; city is '' if none is named."""
        s = plain(typed)
        s = re.sub(r"\bremote or\b", " ", s)
        s = re.sub(r"\bon[- ]site\b", " ", s)
        s = re.sub(r"\([^()]*\)?", " ", s)
        s = re.sub(r"[^,|/]*\bcounty\b", " ", s)
        s = re.sub(r"\bbuilding\s*\w*\d\w*\b", " ", s)
        parts = re.split(r"[,|/]|\s-\s|(?<=\b\w\w)-(?=\w)", s)
        words = [re.findall(r"\w+", self.noise.sub(" ", p)) for p in parts]
        words = [[w for w in p if not any(c.isdigit() for c in w)] for p in words]
        words = [p for p in words if p]
        state = None
        # a leading "ca" before another state is the country
        if len(words) > 2 and words[0] in (["ca"], ["us"]):
            words = words[1:]
        words = [p for i, p in enumerate(words) if not self.country.fullmatch(" ".join(p))]
        if words and len(words[-1]) > 1 and self.country.fullmatch(words[-1][-1]):
            words[-1] = words[-1][:-1]
        rest = []
        for i in range(len(words) - 1, -1, -1):
            text = " ".join(words[i])
            whole = self.name.get(text) or self.code.get(text)
            if whole and state is None:
                state = whole
            elif not whole:
                rest.insert(0, words[i])
        if state is None and rest:
            tail = rest[-1]
            for n in range(min(self.longest, len(tail)), 0, -1):
                text = " ".join(tail[-n:])
                state = self.name.get(text) or (self.code.get(text) if n == 1 else None)
                if state:
                    rest[-1] = tail[:-n]
                    break
            else:
                head = rest[0]
                if len(head) > 1 and head[0] in self.code:
                    state, rest[0] = self.code[head[0]], head[1:]
        flat = [w for p in rest for w in p]
        return city_form(" ".join(flat)), state


def edit_distance(a: str, b: str, most: int = 3) -> int:
    """Optimal string alignment distance, cut off above `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def slips(s: str) -> int:
    """Edit distance allowed from a typed name."""
    return 1 if len(s) < 16 else 2


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def grams(s: str, n: int) -> list[str]:
    """The n-grams of a name with a blank at either end, one after another. Letters beyond a-z, 0-9 and the blank are
    one and the same here, so that there are no more than 38 ** n of them."""
    t = f" {''.join(c if c in _LETTERS else '?' for c in s)} "
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def vector(s: str, names: int, df: dict[str, int]) -> dict[str, float]:
    """Weights of the 1- to 3-grams of a name, of length 1; an n-gram that the list lacks weighs as one of a single name."""
    w = {g: n * math.log(1 + names / df.get(g, 1)) for g, n in Counter(g for n in (1, 2, 3) for g in grams(s, n)).items()}
    norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
    return {g: x / norm for g, x in w.items()}


def index_keys(s: str) -> list[tuple[str, int]]:
    """What a name is looked up by: its 2-grams, each with the number of times it came before. A name of up to 3 letters
    can lose all of them by one swap and is looked up by its letters besides."""
    seen: Counter = Counter()
    out = []
    for g in grams(s, 2) + ([x for x in grams(s, 1) if x != " "] if len(s) <= 4 else []):
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def _keys(rarest: Callable[[str], list[tuple[str, int]]]):
    """Names to (name, g, k): `rarest` of their index keys, and the name itself under "=" for equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, g, k) for s in b.column(0).to_pylist() for g, k in [*rarest(s), ("=" + s, 0)]]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32()))], names=["name", "g", "k"])

    return run


def near_names(typed: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(city, name, score) for each typed city and each listed name in reach, equal names scoring 1.

    typed: city; names: name; both distinct. What all tasks hold is the number of names of each n-gram, of which there
    are at most 38 + 38 ** 2 + 38 ** 3.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = Counter(g for s in b.column(0).to_pylist() for g in {g for n in (1, 2, 3) for g in grams(s, n)} | {"=", f"#{len(s)}"})
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["g", "n"])

    df = {r.g: r.n for r in names.mapInArrow(counted, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    n = df.pop("=", 0)
    longest = max((int(g[1:]) for g in df if g[0] == "#"), default=0)

    def rarest(s: str) -> list[tuple[str, int]]:
        if len(s) > longest + slips(s):
            return []
        keys = sorted(index_keys(s), key=lambda x: (df.get(x[0], 0), x))
        return [x for x in keys[: 3 * slips(s) + 1 if len(s) > 3 else None] if x[0] in df]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = lru_cache(20_000)(lambda s: vector(s, n, df))
        for b in batches:
            out = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if x == y:
                    out.append(1.0)
                    continue
                v, w = vectors(x), vectors(y)
                cosine = min(0.999999, sum(a * w[g] for g, a in v.items() if g in w))
                out.append(cosine if cosine >= threshold and edit_distance(x, y, slips(x)) <= slips(x) else None)
            b = pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=["city", "name", "score"])
            yield b.filter(b.column(2).is_valid())

    left = typed.mapInArrow(_keys(rarest), "city string, g string, k int")
    right = names.mapInArrow(_keys(index_keys), "name string, g string, k int")
    pairs = left.join(right, ["g", "k"]).select("city", "name")
    return spread(pairs.distinct(), "city", "name").mapInArrow(score, "city string, name string, score double")


def _parse(states: list[tuple[str, str]]):
    """(location, hint, uses) with the city typed, the state typed and the state that decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = Parser(states)
        for b in batches:
            got = [(c, s, s or parse.state(h)) for (c, s), h in zip(map(parse, b.column(0).to_pylist()), b.column(1).to_pylist())]
            cols = list(zip(*got)) if got else [[]] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, pa.string()) for c in cols]], names=["location", "hint", "uses", "city", "stated", "state"])

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(city_form, b.column(2).to_pylist())), pa.string())], names=["location_id", "entry_state", "name"])


def map_locations(rows: DataFrame, ref: DataFrame, *, location: str = "location", hint: str = "location_state", threshold: float = 0.15, margin: float = 0.02) -> DataFrame:
    """A row per distinct (location, hint): location, hint, location_id (-1 if unmatched), score, city, state, uses.

    An exact normalised name scores 1 and is taken. Otherwise the name of the greatest weighted cosine is, if that
    reaches `threshold`, leads the next name in reach by `margin`, and lies within one typing slip (two if 16
    letters or more are typed). A state written in the location must be the entry's: names without an entry there
    are no candidates. A hint prefers
    names that have an entry in its state, and decides between entries of one name.

    ref: location_id, city, state, state_code. Defined cases: null and blank locations are left out; a null or
    unreadable hint is no hint; entries with a null id or city are ignored; repeated list entries count once; an
    empty list leaves everything unmatched; a typed name that shares no n-gram with a listed one is no candidate.
    Columns not named are not read.
    """
    ref = ref.select(F.col("location_id").cast("long").alias("location_id"), "city", "state", "state_code").filter("location_id is not null and city is not null").distinct()
    states = [(r.state, r.state_code) for r in ref.select("state", "state_code").distinct().collect()]  # states of the list's countries
    entries = ref.select("location_id", "state", "city").mapInArrow(_forms, "location_id long, entry_state string, name string").filter("name <> ''").distinct()
    values = rows.select(F.col(location).alias("location"), F.col(hint).alias("hint")).filter(F.trim("location") != "").groupBy("location", "hint").agg(F.count("*").alias("uses"))
    values = durable(spread(values, "location", "hint").mapInArrow(_parse(states), "location string, hint string, uses long, city string, stated string, state string"), "values")
    near = near_names(values.select("city").filter("city <> ''").distinct(), entries.select("name").distinct(), threshold)

    there = F.col("entry_state") == F.col("state")
    each = values.join(near, "city", "left").join(entries, "name", "left").groupBy("location", "hint", "uses", "city", "stated", "state", "name").agg(
        F.max("score").alias("score"), F.count("location_id").alias("entries"), F.max("location_id").alias("any"), F.count(F.when(there, 1)).alias("fitting"), F.max(F.when(there, F.col("location_id"))).alias("fits")
    )
    w = Window.partitionBy("location", "hint")
    each = each.withColumn("equal", F.max(F.coalesce(F.col("score") == 1, F.lit(False))).over(w))
    each = each.withColumn("some", F.max((F.col("fitting") > 0) & (~F.col("equal") | (F.col("score") == 1))).over(w))
    # names that are left: an equal one alone; with a state written down, and with a hint that one of them meets, those of that state
    left = (~F.col("equal") | (F.col("score") == 1)) & ((F.col("stated").isNull() & ~(F.col("state").isNotNull() & F.col("some"))) | (F.col("fitting") > 0))
    each = each.withColumn("score", F.when(left, F.col("score")))
    best = w.orderBy(F.col("score").desc_nulls_last(), "name")
    each = each.withColumns({"place": F.row_number().over(best), "next": F.lead("score").over(best)}).filter("place = 1")
    one = F.when((F.col("entries") > 1) | F.col("stated").isNotNull(), F.when(F.col("fitting") == 1, F.col("fits"))).otherwise(F.col("any"))
    clear = F.col("score").isNotNull() & (F.col("next").isNull() | (F.col("score") - F.col("next") >= margin))
    return each.select("location", "hint", "uses", F.coalesce(F.when(clear, one), F.lit(-1)).cast("long").alias("location_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "city", "state")
