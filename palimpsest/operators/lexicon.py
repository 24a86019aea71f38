"""Attestation against clean texts, and the measures built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import normal, tokens

#: Letters that join a word from the left (fixed value).
PARTICLES = "והבכלמש"
ABBREVIATION = "^[א-ת]+״[א-ת]$"


def stripped(word: str, k: int) -> Column:
    """The folded word without its first `k` letters if they are particles and enough is left, else null."""
    return F.when((F.length(word) > k + 1) & F.col(word).rlike(f"^[{PARTICLES}]{{{k}}}"), F.expr(f"substring({word}, {k + 1})"))


def attested(forms: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """`forms` with attested: in the lexicon whole or without one or two particles, or shaped as an abbreviation.

    Distinct forms are tested, not occurrences: one equi-join for the three
    readings of each form, so a frequent form costs no more than a rare one.
    Null words are unattested.
    """
    distinct = forms.select(F.col(word).alias("_w")).where("_w is not null").distinct()
    readings = distinct.select("_w", F.explode(F.array(F.col("_w"), stripped("_w", 1), stripped("_w", 2))).alias("_r")).where("_r is not null")
    known = readings.join(lexicon.select(F.col("word").alias("_r")).distinct(), "_r", "left_semi").select("_w").distinct().withColumn("_hit", F.lit(True))
    joined = forms.join(known, forms[word] == known["_w"], "left").drop("_w")
    return joined.withColumn("attested", F.coalesce("_hit", F.lit(False)) | F.coalesce(F.col(word).rlike(ABBREVIATION), F.lit(False))).drop("_hit")


def token_quality(frame: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """P2 and G1 for tokens: (key, words, unattested, suspect); a token without a word is not suspect, a foreign one is.

    P2's `ok` is `words > 0 and not suspect`.
    """
    base = frame.where(F.col(text).isNotNull()).select(key, text, F.col(text).rlike("[A-Za-z0-9]").alias("foreign"), tokens.is_damaged(text).alias("damaged"), tokens.words(text).alias("w"))
    forms = base.select(key, F.explode("w").alias("x")).select(key, normal.fold("x").alias("word"))
    bad = attested(forms, lexicon).groupBy(key).agg(F.count("*").alias("words"), F.sum(F.when(~F.col("attested"), 1).otherwise(0)).alias("unattested"))
    joined = base.join(bad, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    suspect = (zero("words") > 0) & (F.col("foreign") | F.col("damaged") | (zero("unattested") > 0)) | F.col("foreign")
    return joined.select(key, zero("words").alias("words"), zero("unattested").alias("unattested"), suspect.alias("suspect"))


def held_out_floor(words: DataFrame) -> DataFrame:
    """(witness, tokens, flagged, rate) of each witness of `words`(witness, word) against the lexicon of all others.

    A reading of a form is attested for a witness iff another witness has it,
    which the count and the only holder of each lexicon entry tell without a
    lexicon per witness.
    """
    counts = words.groupBy("witness", "word").agg(F.count("*").alias("n"))
    entries = counts.groupBy("word").agg(F.count("*").alias("holders"), F.min("witness").alias("only"))
    readings = counts.select("witness", "word", "n", F.explode(F.array(F.col("word"), stripped("word", 1), stripped("word", 2))).alias("reading")).where("reading is not null")
    found = readings.join(entries.withColumnRenamed("word", "reading"), "reading", "left")
    elsewhere = (F.col("holders") > 1) | ((F.col("holders") == 1) & (F.col("only") != F.col("witness")))
    judged = found.groupBy("witness", "word", "n").agg(F.max(F.coalesce(elsewhere, F.lit(False))).alias("hit"))
    ok = F.col("hit") | F.col("word").rlike(ABBREVIATION)
    return judged.groupBy("witness").agg(F.sum("n").alias("tokens"), F.sum(F.when(~ok, F.col("n")).otherwise(0)).alias("flagged")).withColumn("rate", F.round(F.col("flagged") / F.col("tokens"), 4))
