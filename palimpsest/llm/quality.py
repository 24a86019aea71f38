"""Problem 9: quality figures of each document and a verdict by learned rules.

The figures are SQL expressions over the text.  An ordered rule list is induced
on labelled documents by incremental reduced-error pruning: for each class,
rarest first, rules are grown on two thirds of the labels still uncovered,
pruned on the other third, and kept while they pay on it; what no rule covers
is prose.  The thresholds become one CASE expression, applied where the figures
are computed.

The labelled rows used for fitting are bounded by `MAX_LABELLED` (in the order
of a hash of their id); verdicts are given to every document.  Null texts have
null figures and no verdict; empty texts have figures of 0 and the verdict the
rules give to them; repeated documents are judged each by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELLED = 20_000
#: Statistics reported for each document.
FIGURES = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
_TERMINAL = r"""[.!?…׃。！？؟۔።:;]["'”“’»)\]]*\s*$"""
_BULLET = r"^\s*(?:[-•*·–—▪◦+]|[(\[]?(?:\p{N}{1,4}|\p{L}{1,2})[.)\]])\s"
_FIELDS = r"\t|\||;(?=\S)|\.{4,}|\S {2,}(?=\S)"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def measures(common: list[str]) -> dict[str, str]:
    """Name → SQL over t (text), w (its words), l (its non-blank lines) and n (code points, at least 1)."""
    words = ", ".join(_sql(w) for w in sorted(set(common))) or "''"
    left = lambda pattern: f"length(regexp_replace(t, {_sql(pattern)}, ''))"
    lines = lambda test: f"size(filter(l, x -> {test})) / greatest(size(l), 1)"
    share = lambda test: f"size(filter(w, x -> {test})) / greatest(size(w), 1)"
    return {
        "words": "size(w)",
        "mean_word_length": "aggregate(w, 0, (s, x) -> s + length(x)) / greatest(size(w), 1)",
        "symbol_ratio": f"{left(r'[\p{L}\p{M}\p{N}\s]')} / n",
        "punctuated_lines": lines(f"x rlike {_sql(_TERMINAL)}"),
        "common_words": share(f"lower(x) in ({words})"),
        "letter_ratio": f"{left(r'[^\p{L}\p{M}]')} / n",
        "digit_ratio": f"{left(r'[^\p{N}]')} / n",
        "words_per_line": "size(w) / greatest(size(l), 1)",
        "bullet_lines": lines(f"x rlike {_sql(_BULLET)}"),
        "number_ended_lines": lines(f"x rlike {_sql(r'\p{N}\s*\|?\s*$')}"),
        "field_lines": lines(f"size(regexp_extract_all(x, {_sql(_FIELDS)}, 0)) >= 2"),
        "dash_lines": lines(f"x rlike {_sql(r'^\S+(?: \S+)? [—–-] ')}"),
        "short_lines": lines("size(split(trim(x), ' +')) <= 6"),
        "distinct_lines": "size(array_distinct(l)) / greatest(size(l), 1)",
        "distinct_words": "size(array_distinct(w)) / greatest(size(w), 1)",
        "number_words": share(f"x rlike {_sql(r'^[\p{N}\p{P}]*\p{N}[\p{N}\p{P}]*$')}"),
        "mixed_words": share(f"x rlike {_sql('[א-ת][A-Za-z]|[A-Za-z][א-ת]|[×ÃÂ][^A-Za-z ]')}"),
        "repeated_characters": f"1 - length(regexp_replace(t, {_sql(r'(.)\1{3,}')}, '')) / n",
        "fields_per_word": f"size(regexp_extract_all(t, {_sql(_FIELDS)}, 0)) / greatest(size(w), 1)",
        "coded_words": share(f"x rlike {_sql(r'[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]')}"),
        "lines": "size(l)",
    }


def with_measures(documents: DataFrame, common: list[str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns plus every measure of `documents.text`, in one pass of built-in expressions."""
    base = documents.select(*keep, F.col("text").alias("t"), F.expr("filter(split(trim(text), '\\\\s+'), x -> x != '')").alias("w"), F.expr("filter(split(text, '\\n'), x -> trim(x) != '')").alias("l"), F.expr("greatest(length(text), 1)").alias("n"))
    return base.select(*keep, *(F.expr(f"if(t is null, null, round(cast({sql} as double), 6))").alias(name) for name, sql in measures(common).items()))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for name, side, bound in rule:
        column = x[:, names.index(name)]
        hit &= column >= bound if side == ">=" else column < bound
    return hit


def _grow(x: np.ndarray, y: np.ndarray, names: list[str]) -> Rule:
    """Add the condition of highest information gain, of all cuts between neighbouring values, until no negative is covered."""
    rule: Rule = []
    hit = np.ones(len(x), bool)
    while y[hit].any() and (~y[hit]).any():
        own, truth = x[hit], y[hit]
        p, n = truth.sum(), (~truth).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(names):
            order = np.argsort(own[:, k], kind="stable")
            column, below = own[order, k], np.cumsum(truth[order])
            cuts = np.flatnonzero(column[1:] > column[:-1])  # a cut lies behind each of these rows
            if not len(cuts):
                continue
            for side, good, taken in ((">=", p - below[cuts], len(column) - 1 - cuts), ("<", below[cuts], cuts + 1)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(good > 0, good * (np.log2(good / taken) - base), 0.0)
                i = int(gains.argmax())
                if gains[i] > best[0]:
                    best = (gains[i], (name, side, float((column[cuts[i]] + column[cuts[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _covers(rule, x, names)
    return rule


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray, names: list[str]) -> float:
    hit = _covers(rule, x, names)
    p, n = y[hit].sum(), (~y[hit]).sum()
    return (p - n) / (p + n) if p + n else -1.0


def induce(x: np.ndarray, labels: np.ndarray, names: list[str], rest: str = "prose") -> list[tuple[str, Rule]]:
    """Ordered (class, rule) list; rows of `x` come in a fixed shuffled order, every third of a class prunes."""
    found: list[tuple[str, Rule]] = []
    left = np.ones(len(x), bool)
    kinds = [k for k in sorted(set(labels), key=lambda k: ((labels == k).sum(), k)) if k != rest]
    for kind in kinds:
        while (y := labels[left] == kind).any():  # every kept rule covers a label of its own
            own = x[left]
            turn = np.zeros(len(y), int)
            turn[y], turn[~y] = np.arange(y.sum()), np.arange((~y).sum())
            few = y.sum() < 3
            prune = np.ones(len(y), bool) if few else turn % 3 == 2
            grow = np.ones(len(y), bool) if few else ~prune
            rule = _grow(own[grow], y[grow], names)
            if not rule:
                break
            lengths = range(1, len(rule) + 1)
            rule = rule[: max(lengths, key=lambda k: (_worth(rule[:k], own[prune], y[prune], names), k))]
            if _worth(rule, own[prune], y[prune], names) <= 0:
                break
            found.append((kind, rule))
            hit = np.zeros(len(x), bool)
            hit[np.flatnonzero(left)[_covers(rule, own, names)]] = True
            left &= ~hit
    return found


def as_case(rules: list[tuple[str, Rule]], rest: str = "prose") -> str:
    """The rule list as one SQL CASE expression; null figures have no verdict."""
    whens = " ".join(f"WHEN {' AND '.join(f'{name} {side} {bound!r}' for name, side, bound in rule)} THEN '{kind}'" for kind, rule in rules)
    return f"CASE WHEN words IS NULL THEN NULL {whens} ELSE '{rest}' END"


def fit(documents: DataFrame, labels: DataFrame, common: list[str], limit: int = MAX_LABELLED) -> list[tuple[str, Rule]]:
    """Rules learned from at most `limit` labelled documents; without labels there are none."""
    sample = labels.where("label is not null").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `limit` ids and labels
    names = list(measures([]))
    measured = with_measures(texts, common, ("doc_id", "label")).withColumn("_turn", F.xxhash64("doc_id")).collect()  # at most `limit` labels
    rows = sorted(measured, key=lambda r: (r["_turn"], r["doc_id"], r["label"]))
    if not rows:
        return []
    return induce(np.array([[r[n] for n in names] for r in rows], float), np.array([r["label"] for r in rows]), names)


def verdicts(documents: DataFrame, labels: DataFrame, common: list[str], limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, FIGURES, verdict) of every document."""
    case: Column = F.expr(as_case(fit(documents, labels, common, limit))).alias("verdict")
    return with_measures(documents, common).select("doc_id", *FIGURES, case)
