"""Tokens, character grams and word grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import normal


def words(c: Column | str) -> Column:
    """Words of an unpointed text, an abbreviation's mark kept before its last letter."""
    return F.regexp_extract_all(normal.strip_points(c), F.lit(normal.WORD), F.lit(0))


def is_damaged(c: Column | str) -> Column:
    """More than one word in a token that no hyphen joins."""
    return (F.size(words(c)) > 1) & ~normal._col(c).rlike(f"[{normal.MAQAF}]")


def grams(c: Column | str, n: int) -> Column:
    """T4: distinct character n-grams; the array of characters is bound once, so linear in the text."""

    def of(chars: Column) -> Column:
        starts = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(*(F.get(chars, i + k) for k in range(n)))))

    return F.transform(F.array(F.split(normal._col(c), "")), of)[0]


def spans(frame: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n, token, start_at, end_at) of the tokens between single blanks."""
    parts = frame.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, " ", -1)).alias("n", "token"))
    order = Window.partitionBy(key).orderBy("n")
    end = F.sum(F.length("token") + 1).over(order) - 1
    return parts.withColumn("end_at", end).withColumn("start_at", F.col("end_at") - F.length("token")).where("token != ''")


def neighbours(frame: DataFrame, page: list[str], order: list[str], word: str, ahead: int) -> DataFrame:
    """T5: `frame` with the next `ahead` words of the same page as word_1, word_2, …; pages are never joined up."""
    window = Window.partitionBy(*page).orderBy(*order)
    return frame.withColumns({f"word_{k}": F.lead(word, k).over(window) for k in range(1, ahead + 1)})


def lexicon(frame: DataFrame, text: str) -> DataFrame:
    """(word, n) of the folded words of all texts."""
    return frame.select(F.explode(words(text)).alias("w")).select(normal.fold("w").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
