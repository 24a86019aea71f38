"""The clean witnesses' vocabulary as a size-checked in-memory set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most distinct words that may be shipped to every worker.
MAX_TERMS = 2_000_000


def words_with_counts(corpus: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """(lang, word, n) of the clean witnesses; function words count at least once."""
    word = F.explode(F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{M}]+(?:[׳״\'’\"][\\p{L}\\p{M}]+)*', 0)"))
    base = corpus.where("text is not null").select("lang", word.alias("word"))
    if common is not None:
        base = base.unionByName(common.where("word is not null").select("lang", "word"))
    return base.groupBy("lang", "word").agg(F.count("*").alias("n"))


def bounded(counts: DataFrame, limit: int = MAX_TERMS) -> list[tuple[str, str, int]]:
    """The rows of `counts` on the driver, refused beyond `limit`.

    The clean corpus is a fixed reference table (its size does not follow the
    collection); the limit is the proof asked for before it is shipped.
    """
    rows = counts.select("lang", "word", "n").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the vocabulary holds more than {limit} words; raise the bound only with the workers' memory")
    return sorted((r[0] or "", r[1], r[2]) for r in rows)
