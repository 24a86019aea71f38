"""A lexicon kept up from a stream of texts, one merge for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.functions import tokens

SCHEMA = "word string, n bigint"


def keep_lexicon(texts: DataFrame, path: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Add the words of each micro-batch of `texts` to the counts under `path`.

    A batch is aggregated by itself and written under its own number, so a
    batch that runs again after a failure replaces its own rows and no other's;
    `lexicon` sums the batches.
    """

    def merge(batch: DataFrame, number: int) -> None:
        tokens.lexicon(batch.where(f"{text} is not null"), text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lexicon(spark, path: str) -> DataFrame:
    """(word, n) of all batches so far."""
    return spark.read.schema(SCHEMA + ", batch int").parquet(path).groupBy("word").sum("n").withColumnRenamed("sum(n)", "n")
