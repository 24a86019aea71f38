"""Folded substring search with context and keyed navigation (Q1–Q3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import normal


def occurrences(frame: DataFrame, keys: list[str], text: str, needle: str, context: int = 45, limit: int | None = 400) -> DataFrame:
    """Q1: (keys, at, before, after) of the non-overlapping folded hits in the order of `keys`, at most `limit` of them.

    Needles of fewer than two letters find nothing.
    """
    folded = frame.select(*keys, normal.searchable(text).alias("t")).where(F.col("t").contains(needle) & F.lit(len(needle) >= 2))
    parts = folded.select(*keys, "t", F.posexplode(F.split("t", "\\Q" + needle + "\\E", -1)).alias("k", "part"))
    order = Window.partitionBy(*keys).orderBy("k")
    placed = parts.withColumn("at", F.sum(F.length("part")).over(order) + F.col("k") * len(needle)).withColumn("last", F.max("k").over(Window.partitionBy(*keys))).where("k < last")
    hits = placed.select(*keys, "at", F.expr(f"substring(t, greatest(at - {context}, 0) + 1, least(at, {context}))").alias("before"), F.expr(f"substring(t, at + {len(needle)} + 1, {context})").alias("after"))
    return hits.orderBy(*keys, "at").limit(limit) if limit else hits


def filtered(frame: DataFrame, group: str, text: str, needle: str) -> DataFrame:
    """Q2: paragraphs holding `needle`, counted by group; groups without any are there with 0."""
    return frame.groupBy(group).agg(F.count_if(F.col(text).contains(needle)).alias("hits"), F.count("*").alias("paragraphs"))


def navigation(frame: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """Q3: each key with the one before and the one after it in its group, a book's spine of bounded length."""
    window = Window.partitionBy(group).orderBy(*order)
    return frame.withColumn("previous", F.lag(key).over(window)).withColumn("following", F.lead(key).over(window))
