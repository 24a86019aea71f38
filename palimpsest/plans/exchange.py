"""Queries of the sources and sinks: tables written in the exchange formats and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.catalogue import register
from palimpsest.plans.lineage import scratch
from palimpsest.sources import sinks, transcript
from palimpsest.sources.tables import load


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    """(witness, part_no, chapter, paras) of the Hebrew chapters."""
    own = load(spark, d, "corpus", "witness", "kind", "lang", "part_no", "chapter", "para_no", "text").where("kind = 'ch' and lang = 'he' and text is not null")
    return own.groupBy("witness", "part_no", "chapter").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda s: s["text"]).alias("paras"))


@register("""SELECT witness, 'ch:' || part_no || ':' || row_number() OVER (PARTITION BY witness, part_no ORDER BY chapter) AS key, n AS paragraphs, letters
FROM (SELECT witness, part_no, chapter, count(*) AS n, sum(length(text))::BIGINT AS letters FROM corpus WHERE kind = 'ch' AND lang = 'he' AND trim(text) <> '' GROUP BY ALL)
UNION ALL SELECT DISTINCT witness, 'other:0:0', 1, 1 FROM corpus WHERE kind = 'ch' AND lang = 'he' AND trim(text) <> ''""")
def ref_S1_sections(spark: SparkSession, d: str) -> DataFrame:
    """Nested books written as JSON, one for each witness, and flattened to citation keys."""
    parts = _chapters(spark, d).groupBy("witness", "part_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter", "paras"))), lambda s: s["paras"]).alias("chapters"))
    body = F.when(F.col("part_no") % 2 == 0, F.to_json("chapters")).otherwise(F.concat(F.lit('{"": '), F.to_json("chapters"), F.lit("}")))
    section = F.concat(F.lit('"Part '), F.col("part_no").cast("string"), F.lit('": '), body)
    books = parts.groupBy("witness").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(section)), ", "), F.lit(', "Colophon": "x"}')).alias("value"))
    path = scratch(spark, "books")
    books.write.partitionBy("witness").text(path)
    read = transcript.sections(spark.read.text(path, wholetext=True), "value", ("witness",))
    return read.select("witness", "key", F.size("paras").cast("long").alias("paragraphs"), F.aggregate("paras", F.lit(0).cast("long"), lambda a, p: a + F.length(p)).alias("letters"))


@register("SELECT witness, cite_key AS key, row_number() OVER (PARTITION BY witness, cite_key ORDER BY para_no, text) - 1 AS para_no, text FROM corpus WHERE text IS NOT NULL AND witness IS NOT NULL AND cite_key IS NOT NULL")
def ref_S2_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Every witness from a file of its own, a missing file passed over."""
    own = load(spark, d, "corpus", "witness", "cite_key", "para_no", "text").where("text is not null and witness is not null and cite_key is not null")
    keyed = own.groupBy("witness", "cite_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda s: s["text"]).alias("paras"))
    path = scratch(spark, "witnesses")
    keyed.groupBy("witness").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("cite_key", "paras")))).alias("value")).write.partitionBy("witness").text(path)
    names = [r[0] for r in own.select("witness").distinct().collect()]  # the witnesses of one book
    return transcript.corpus(spark, {w: f"{path}/witness={w}" for w in names} | {"absent": f"{path}/witness=none"})


@register("SELECT DISTINCT volume, page, CAST(NULL AS VARCHAR) AS notes FROM page_lines WHERE text IS NOT NULL")
def ref_S4_optional(spark: SparkSession, d: str) -> DataFrame:
    """Pages with a reading that is not there: the join holds, its columns are null."""
    pages = load(spark, d, "page_lines", "volume", "page", "text").where("text is not null").select("volume", "page").distinct()
    return pages.join(transcript.optional_reading(spark, scratch(spark, "none")), "page", "left").select("volume", "page", "notes")


@register("SELECT line_id, text AS body, string_split(text, ' ')[1] AS hedged FROM page_lines WHERE text IS NOT NULL AND string_split(text, ' ')[1] <> '' AND NOT regexp_matches(text, '[⟪⟫]')")
def ref_S8_eye_readings(spark: SparkSession, d: str) -> DataFrame:
    """Lines under a folio line with their first word hedged, read as an eye reading."""
    own = load(spark, d, "page_lines", "line_id", "text").where("text is not null").withColumn("first", F.split("text", " ")[0]).where("first != '' and not text rlike '[⟪⟫]'")
    value = F.concat(F.lit("[12]\n⟪"), F.col("first"), F.lit("⟫"), F.expr("substring(text, length(first) + 1)"))
    return transcript.eye_readings(own.select("line_id", value.alias("value"))).select("line_id", "body", F.array_join("hedged", " ").alias("hedged"))


@register("SELECT DISTINCT unit_id, volume, page, score FROM units")
def ref_S9_island(spark: SparkSession, d: str) -> DataFrame:
    """Units written into self-contained pages (K3) and read back from their data islands."""
    own = load(spark, d, "units", "unit_id", "volume", "page", "score").distinct()
    pages = own.select(sinks.data_pages(F.to_json(F.struct("unit_id", "volume", "page", "score"))).alias("html"))
    schema = "struct<unit_id:string,volume:string,page:int,score:double>"
    return pages.select(F.from_json(transcript.data_island("html"), schema).alias("u")).select("u.*")


_MARKDOWN = """SELECT volume, kind, count(*) AS blocks FROM (
  SELECT volume, CASE WHEN starts_with(t, '>') THEN 'note' WHEN starts_with(t, '## ') THEN 'page' WHEN starts_with(t, '# ') THEN 'title' ELSE 'paragraph' END AS kind
  FROM (SELECT volume, trim(text) AS t FROM page_lines WHERE text IS NOT NULL AND volume IS NOT NULL AND page IS NOT NULL) WHERE t <> ''
  UNION ALL SELECT volume, 'page' FROM (SELECT DISTINCT volume, page FROM page_lines WHERE text IS NOT NULL AND volume IS NOT NULL AND page IS NOT NULL)) GROUP BY ALL"""


@register(_MARKDOWN)
def ref_S10_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Volumes written as markdown, a folder each (K6), and the kinds of the blocks read back."""
    lines = load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null and volume is not null and page is not null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda s: s["text"]), "\n\n")
    pages = lines.groupBy("volume", "page").agg(F.concat(F.lit("\n## page "), F.first("page").cast("string"), F.lit("\n\n"), body, F.lit("\n")).alias("value"))
    path = scratch(spark, "markdown")
    sinks.write_volumes(pages, path)
    read = transcript.markdown_volume(spark.read.text(path, wholetext=True), keep=("volume",))
    return read.groupBy("volume", "kind").agg(F.count("*").alias("blocks"))


@register("""SELECT volume, count(*) AS tokens, round(count_if(why IN ('guide', 'agree')) / count(*), 4) AS sure FROM tokens WHERE volume IS NOT NULL GROUP BY volume""")
def ref_K6_index(spark: SparkSession, d: str) -> DataFrame:
    """The index of the raw volumes: tokens and the share decided surely."""
    own = load(spark, d, "tokens", "volume", "why").where("volume is not null")
    return own.groupBy("volume").agg(F.count("*").alias("tokens"), F.round(F.count_if(F.col("why").isin("guide", "agree")) / F.count("*"), 4).alias("sure"))
