"""Alignment of readings and monotone assignment.

Dynamic programmes run on one page, passage or volume outline at a time, never
on a gathered collection; pairs of texts are matched by equi-joins outside.
Empty inputs give empty results, nulls in the word arrays count as empty words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH, NEAR, MISS, GAP, BAND = 2, 1, -1, -1, 24
_FOLD = str.maketrans("ךםןףץ", "כמנפצ")


def bare(word: str | None) -> str:
    """Folded letters of a word; a word without Hebrew letters stays as it is."""
    kept = "".join(c for c in word or "" if "א" <= c <= "ת").translate(_FOLD)
    return kept or (word or "")


def one_apart(a: str, b: str) -> bool:
    """P5 in Python: one substitution or one inserted letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def _neighbours(x: list[str], y: list[str]) -> np.ndarray:
    """Score of each word of `x` beside each of `y`; near words are found by what is left when a letter is taken out."""
    table = np.full((len(x), len(y)), MISS, np.int32)
    gaps: dict[tuple[str, str], list[int]] = {}
    shorter: dict[str, list[int]] = {}
    same: dict[str, int] = {}
    for j, w in enumerate(y):
        same[w] = j
        for k in range(len(w)):
            gaps.setdefault((w[:k], w[k + 1 :]), []).append(j)
            shorter.setdefault(w[:k] + w[k + 1 :], []).append(j)
    for i, w in enumerate(x):
        for k in range(len(w)):
            table[i, gaps.get((w[:k], w[k + 1 :]), [])] = NEAR  # one letter replaced
            if (j := same.get(w[:k] + w[k + 1 :])) is not None:
                table[i, j] = NEAR  # one letter more in `x`
        table[i, shorter.get(w, [])] = NEAR  # one letter more in `y`
        if (j := same.get(w)) is not None:
            table[i, j] = MATCH
    return table


def align(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Best global alignment within the band; on ties the diagonal, then a gap in `b`, then a gap in `a`.

    A row is done at once: gaps in `a` only carry a value to the right at a
    fixed loss, so their best is a running maximum.
    """
    x, y = [bare(w) for w in a], [bare(w) for w in b]
    n, m = len(x), len(y)
    width = max(BAND, abs(n - m) + 2)
    (own, x_at), (other, y_at) = (np.unique(np.array(w, dtype=object), return_inverse=True) if w else (np.empty(0, object), np.empty(0, int)) for w in (x, y))
    scores = _neighbours(list(own), list(other))
    out_of = -(10**9)
    above = np.full(m + 1, out_of)
    above[: min(m, width) + 1] = GAP * np.arange(min(m, width) + 1)
    moves = []
    for i in range(1, n + 1):
        low, high = max(0, i - width), min(m, i + width)
        diagonal = np.full(high - low + 1, out_of)
        first = max(low, 1)
        diagonal[first - low :] = above[first - 1 : high] + scores[x_at[i - 1]][y_at[first - 1 : high]]
        down = above[low : high + 1] + GAP
        best = np.maximum(diagonal, down)
        steps = np.arange(high - low + 1)
        row = np.maximum.accumulate(best - GAP * steps) + GAP * steps
        taken = np.where(diagonal >= down, 0, 1)
        taken[1:][row[:-1] + GAP > best[1:]] = 2
        moves.append((low, taken))
        above = np.full(m + 1, out_of)
        above[low : high + 1] = row
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        move = moves[i - 1][1][j - moves[i - 1][0]] if i else 2
        if move == 0:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif move == 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType())])))
def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
    """J2 as a column function of two arrays of words."""
    return pd.Series([[{"i": i, "j": j} for i, j in align([] if x is None else list(x), [] if y is None else list(y))] for x, y in zip(a, b)])


def spread(pages: DataFrame, key: list[str]) -> DataFrame:
    """`pages` in as many partitions as a shuffle has: few bytes of them are much work, so they are not to be coalesced by size."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def projected(pairs: DataFrame, key: list[str]) -> DataFrame:
    """(key, at, word, inserted) of `pairs`(key, n, i, j, word): the other reading at each position of the backbone.

    Inserted words are keyed by the position they come before; those at the end
    by the backbone's length.
    """
    ahead = Window.partitionBy(*key).orderBy("n").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*key)
    nxt = F.coalesce(F.min("i").over(ahead), F.max("i").over(whole) + 1, F.lit(0))
    return pairs.withColumn("at", nxt).where("j is not null").select(*key, "n", "at", "word", F.col("i").isNull().alias("inserted"))


def monotone_pages(scores: list[list[float]]) -> list[int]:
    """A section for each page, never decreasing, of greatest total score; the first such section on ties."""
    if not scores or not scores[0]:
        return []
    table = np.array(scores, float)
    best = table[0].copy()
    back = []
    for row in table[1:]:
        reach = np.maximum.accumulate(best)
        first = np.concatenate([[True], best[1:] > reach[:-1]])
        back.append(np.maximum.accumulate(np.where(first, np.arange(len(best)), 0)))
        best = reach + row
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def sparse_assignment(scores: list[list[float]], accept: float, bounds: list[int] | None = None) -> list[tuple[int, int]]:
    """Strictly increasing (candidate, section) pairs of greatest total; either side may be skipped.

    Only scores of at least `accept` count, and a candidate takes no section
    below its bound.
    """
    rows = len(scores)
    columns = len(scores[0]) if rows else 0
    total = np.zeros((rows + 1, columns + 1))
    chosen = np.zeros((rows + 1, columns + 1), bool)
    for i in range(rows):
        for j in range(columns):
            skip = max(total[i, j + 1], total[i + 1, j])
            if scores[i][j] >= accept and (not bounds or j >= bounds[i]) and total[i, j] + scores[i][j] > skip:
                total[i + 1, j + 1], chosen[i + 1, j + 1] = total[i, j] + scores[i][j], True
            else:
                total[i + 1, j + 1] = skip
    out = []
    i, j = rows, columns
    while i and j:
        if chosen[i, j]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif total[i, j] == total[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def numbered_chain(numbers: list[int], part_lengths: dict[int, int], restart: float = 0.5, opening: int = 3, closing: int = 20, longest: int = 76) -> list[tuple[int, int]]:
    """(index, part) of the best chain of chapter numbers: rising within a part, or starting the next part.

    A rise by r adds 1 / r, a new part `restart`: it opens with a number of at
    most `opening` behind one of at least `closing`.  No number passes its
    part's length (`longest` where none is given); there are as many parts as
    `part_lengths` names, or three.  Ties go to the earliest predecessor.
    """
    if not numbers:
        return []
    value = np.array(numbers)
    score, part = np.ones(len(value)), np.ones(len(value), int)
    before = np.full(len(value), -1)
    parts = max(part_lengths, default=3)
    room = np.array([part_lengths.get(k, longest) for k in range(parts + 2)])
    for i in range(1, len(value)):
        rise = value[i] - value[:i]
        opens = (rise <= 0) & (value[i] <= opening) & (value[:i] >= closing) & (part[:i] < parts)
        gain = np.where(rise > 0, 1.0 / np.maximum(rise, 1), np.where(opens, restart, -np.inf))
        reached = part[:i] + opens
        total = np.where(value[i] <= room[reached], score[:i] + gain, -np.inf)
        j = int(total.argmax())
        if total[j] > 1.0:
            score[i], part[i], before[i] = total[j], reached[j], j
    at, out = int(score.argmax()), []
    while at >= 0:
        out.append((at, int(part[at])))
        at = int(before[at])
    return out[::-1]


def located(passages: DataFrame, hay: DataFrame, pad: int = BAND) -> DataFrame:
    """(passage, volume, n, anchors, from_at, to_at): where in a volume a passage stands.

    passages(passage, words); hay(volume, at, n, gram), the word n-grams of the
    volumes with their running places, n in (3, 2); the longer n that finds an
    anchor decides.  Anchors are n-grams a volume holds once; the greatest
    group whose offsets lie within the passage's length is believed, the
    earliest on ties, and padded.  Anchors of a passage are gathered, at most
    one for each of its words; volumes never are.
    """
    size = F.size("words")
    gram = lambda n: F.expr(f"transform(sequence(0, size(words) - {n}), i -> struct(cast(i as long) as i, {n} as n, array_join(slice(words, i + 1, {n}), ' ') as gram))")
    grams = passages.select("passage", size.alias("span"), F.explode(F.concat(*(F.when(size >= n, gram(n)).otherwise(F.array()) for n in (3, 2)))).alias("g")).select("passage", "span", "g.*")
    once = hay.groupBy("volume", "n", "gram").agg(F.count("*").alias("k"), F.min("at").alias("at")).where("k = 1").drop("k")
    offsets = grams.join(once, ["n", "gram"]).groupBy("passage", "volume", "span", "n").agg(F.array_sort(F.collect_list(F.col("at") - F.col("i"))).alias("o"))
    groups = F.expr("transform(o, (x, j) -> struct(j + 1 - size(filter(o, y -> y < x - span)) as anchors, -j as turn))")
    best = offsets.withColumn("b", F.array_max(groups)).withColumn("last", F.expr("get(o, -b.turn)")).withColumn("from_at", F.expr("array_min(filter(o, y -> y >= last - span))"))
    longer = best.groupBy("passage", "volume").agg(F.max_by(F.struct("n", F.col("b.anchors").alias("anchors"), "from_at", "last", "span"), "n").alias("r")).select("passage", "volume", "r.*")
    return longer.select("passage", "volume", "n", "anchors", F.greatest(F.lit(0), F.col("from_at") - pad).alias("from_at"), (F.col("last") + F.col("span") + pad).alias("to_at"))
