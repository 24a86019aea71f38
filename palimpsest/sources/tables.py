"""Table loading: one place that knows how the parquet tables are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """The table `name` under `base`, optionally pruned to `columns`.

    Extra columns in the file never reach an operator that names what it needs,
    so clashing names in wider inputs are harmless.
    """
    frame = spark.read.parquet(f"{base}/{name}.parquet")
    return frame.select(*columns) if columns else frame
