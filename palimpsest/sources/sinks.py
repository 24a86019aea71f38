"""Writers: JSON, transcripts, study packs, self-contained pages (K1–K6)."""

from __future__ import annotations

import base64
import gzip
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_json(frame: DataFrame, path: str) -> None:
    """K1: one JSON object a line, characters kept as they are."""
    frame.write.mode("overwrite").json(path)


def transcript_pages(lines: DataFrame) -> DataFrame:
    """K2: (volume, page, value) of lines(volume, page, line_no, text): each page under its banner, lines as printed."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = lines.where("text is not null").groupBy("volume", "page").agg(F.transform(ordered, lambda s: s["text"]).alias("lines"))
    return pages.select("volume", "page", F.concat(F.lit("===== PDF3 page "), F.col("page").cast("string"), F.lit(" =====\n"), F.array_join("lines", "\n")).alias("value"))


def chapter_pack(chapters: DataFrame, units: DataFrame) -> DataFrame:
    """K4: every chapter of chapters(part_no, last) from 1 on with its text of units(part_no, chapter, text), absences stated."""
    spine = chapters.select("part_no", F.explode(F.sequence(F.lit(1), "last")).alias("chapter"))
    return spine.join(units, ["part_no", "chapter"], "left").withColumn("text", F.coalesce("text", F.lit("[absent]")))


def library_package(units: DataFrame) -> DataFrame:
    """K5: (part_no, chapters, n): one map from chapter to text for each part of a book."""
    return units.groupBy("part_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "text")))).alias("chapters"), F.count("*").alias("n"))


def write_volumes(pages: DataFrame, path: str) -> None:
    """K6: pages(volume, value) as text, a folder for each volume."""
    pages.select("volume", "value").write.mode("overwrite").partitionBy("volume").text(path)


def data_page(payload: dict, title: str) -> str:
    """K3: a page that carries `payload` as a gzip and base64 island."""
    packed = base64.b64encode(gzip.compress(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode(), mtime=0)).decode()
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><script id="data" type="application/gzip">{packed}</script>'


@F.pandas_udf(T.StringType())
def data_pages(payload: pd.Series) -> pd.Series:
    """K3 as a column function of JSON texts; nulls give null."""
    return payload.map(lambda p: None if p is None else data_page(json.loads(p), "data"))
