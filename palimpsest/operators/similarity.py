"""Set containment, idf cosine, weighted edit similarity, presence and increasing chains."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.plans.lineage import written

#: Pairs of letters that scanning confuses, by substitution cost (fixed values).
CHEAP = {0.10: "כך מם נן פף צץ", 0.35: "דר דך רך בכ בם כם הח חת הת הן גנ גז וי ון וז ין טס טם סם עצ לג שם"}
#: Pairs of letters that differ by one stroke (fixed values).
STROKES = "דר בכ הח הת חת וז וי ונ גנ מס"


def idf(grams: DataFrame, sections: int) -> DataFrame:
    """(gram, weight) ln(sections / df) of `grams`(section, gram), each gram once a section."""
    return grams.groupBy("gram").agg(F.count("*").alias("df")).select("gram", F.log(F.lit(float(sections)) / F.col("df")).alias("weight"))


def cosine(queries: DataFrame, sections: DataFrame) -> DataFrame:
    """(unit, section, score, rank) of `queries`(unit, gram) against `sections`(section, gram).

    Vectors are binary and weighted by idf; grams of every section weigh 0 and
    are dropped before the join, as are grams no unit holds, so only informative
    postings are shuffled.  Ties go to the greater section key.
    """
    postings = written(sections, "postings")
    total = postings.select("section").distinct().count()
    square = F.col("weight") * F.col("weight")
    held = written(postings.join(idf(postings, total).where("weight > 0"), "gram").select("section", "gram", square.alias("square")), "weighed")
    asked = queries.join(held.groupBy("gram").agg(F.first("square").alias("square")), "gram")
    norms = held.groupBy("section").agg(F.sqrt(F.sum("square")).alias("s_norm"))
    q_norms = asked.groupBy("unit").agg(F.sqrt(F.sum("square")).alias("q_norm"))
    dots = queries.join(held, "gram").groupBy("unit", "section").agg(F.sum("square").alias("dot"))
    scored = dots.join(norms, "section").join(q_norms, "unit").select("unit", "section", F.round(F.col("dot") / (F.col("s_norm") * F.col("q_norm")), 4).alias("score"))
    order = Window.partitionBy("unit").orderBy(F.desc("score"), F.desc("section"))
    return scored.withColumn("rank", F.row_number().over(order))


def containment(a: Column, b: Column) -> Column:
    """Share of set `a` that set `b` holds, 0 for an empty `a`."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def near(a: Column, b: Column) -> Column:
    """P5: one substitution or one inserted letter apart; equal strings are not."""
    return F.levenshtein(a, b, 1) == 1


def stroke_only(a: Column, b: Column) -> Column:
    """Of one length, unequal, and different only by one stroke a letter."""
    pairs = {p for p in STROKES.split()} | {p[::-1] for p in STROKES.split()}
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) | F.concat(x, y).isin(*sorted(pairs)))
    return (F.length(a) == F.length(b)) & (a != b) & F.forall(same, lambda s: s)


def _costs() -> dict[tuple[str, str], float]:
    out = {}
    for cost, pairs in CHEAP.items():
        for p in pairs.split():
            out[p[0], p[1]] = out[p[1], p[0]] = cost
    return out


_COSTS = _costs()


def weighted_similarity(a: str | None, b: str | None) -> float:
    """1 - weighted edit distance / greater length, at least 0; 0 if either has no letter."""
    a = "".join(c for c in a or "" if "א" <= c <= "ת")
    b = b or ""
    if not a or not b:
        return 0.0
    row = list(map(float, range(len(b) + 1)))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1.0
        for j, y in enumerate(b):
            step = diagonal + (0.0 if x == y else _COSTS.get((x, y), 1.0))
            diagonal = row[j + 1]
            row[j + 1] = min(step, diagonal + 1.0, row[j] + 1.0)
    return max(0.0, 1.0 - row[-1] / max(len(a), len(b)))


@F.pandas_udf(T.DoubleType())
def numeral_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """E2 as a column function of two strings; null counts as empty."""
    return pd.Series([weighted_similarity(x, y) for x, y in zip(a, b)])


def best_window(want: list[str], hay: list[str]) -> float:
    """Greatest share of `want`'s words in any window of its length, order ignored; 0 where `hay` is shorter."""
    n = len(want)
    if not n or len(hay) < n:
        return 0.0
    need = Counter(want)
    missing = Counter(need)
    lack = n
    best = n
    for i, word in enumerate(hay):
        if i >= n and (gone := hay[i - n]) in need:
            missing[gone] += 1
            lack += missing[gone] > 0
        if word in need:
            lack -= missing[word] > 0
            missing[word] -= 1
        if i >= n - 1:
            best = min(best, lack)
    return (n - best) / n


@F.pandas_udf(T.DoubleType())
def presence(want: pd.Series, hay: pd.Series) -> pd.Series:
    """E7 as a column function of two arrays of words; nulls count as empty."""
    return pd.Series([best_window([] if w is None else list(w), [] if h is None else list(h)) for w, h in zip(want, hay)])


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """E5: longest chain increasing in both members, one pair for each first member."""
    ordered = sorted(set(pairs), key=lambda p: (p[0], -p[1]))
    ends: list[int] = []
    holders: list[int] = []
    before: list[int | None] = []
    for k, (_, h) in enumerate(ordered):
        place = bisect_left(ends, h)
        before.append(holders[place - 1] if place else None)
        ends[place : place + 1] = [h]
        holders[place : place + 1] = [k]
    out = []
    k = holders[-1] if holders else None
    while k is not None:
        out.append(ordered[k])
        k = before[k]
    return out[::-1]


def chains(matches: DataFrame, unit: str = "unit") -> DataFrame:
    """E5: the longest increasing chain of `matches`(unit, i, h) for each unit, a text of bounded length."""
    schema = f"{unit} {dict(matches.dtypes)[unit]}, i long, h long"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        chain = increasing(list(zip(frame["i"].tolist(), frame["h"].tolist())))
        return pd.DataFrame({unit: frame[unit].iloc[0], "i": [i for i, _ in chain], "h": [h for _, h in chain]})

    return matches.select(unit, "i", "h").where("i is not null and h is not null").groupBy(unit).applyInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 × matched words / words of both, matched as the longest common blocks; 0 if both are empty."""
    from difflib import SequenceMatcher

    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() if x or y else 0.0
    return pd.Series([ratio([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b)], dtype=float)
