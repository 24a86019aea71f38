"""Readers of the collation's inputs: nested JSON corpora, banner-delimited transcripts, page readings, markdown volumes."""

from __future__ import annotations

import base64
import gzip
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import normal

BANNER = r"===== PDF3 page (\d+) ====="


#: Sections that stand before the first part (fixed values).
FRONT = {"Prefatory Remarks": "pref", "Introduction": "pref", "Letter to R Joseph son of Judah": "letter", "Introduction of Ibn Tibon": "tibbon"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the file system of `path` has it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _strings(raw: Column) -> Column:
    """The non-blank strings of nested JSON lists, in order, cleaned of markup."""
    found = F.regexp_extract_all(raw, F.lit(r'"(?:[^"\\]|\\.)*"'), F.lit(0))
    plain = F.transform(found, lambda x: normal.without_markup(F.from_json(F.concat(F.lit('{"a": '), x, F.lit("}")), "a string")["a"]))
    return F.filter(plain, lambda x: x != "")


def sections(frame: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, key, paras) of nested JSON books, section → body.

    A body is a list of chapters, an object of an introduction and chapters, or
    text.  Parts give `ch:part:chapter`, their introductions `intro:part:0`, the
    front sections their own key, any other section `other:0:0`.  Of sections
    that land on one key the later wins; empty ones give no row.
    """
    outer = frame.select(*keep, F.posexplode(F.from_json(text, "map<string,string>")).alias("n", "section", "body"))
    part = F.regexp_extract("section", r"^Part (\d+)(?: Introduction)?$", 1)
    known = outer.withColumn("part", part)
    front = F.element_at(F.create_map(*(F.lit(x) for pair in FRONT.items() for x in pair)), F.col("section"))
    whole = known.where("part = '' or section like '% Introduction'").select(*keep, "n", F.lit(0).alias("m"), F.when(F.col("part") != "", F.concat(F.lit("intro:"), "part", F.lit(":0"))).otherwise(F.concat(F.coalesce(front, F.lit("other")), F.lit(":0:0"))).alias("key"), F.when(F.col("body").rlike(r"^\s*[\[{]"), _strings(F.col("body"))).otherwise(F.filter(F.array(normal.without_markup("body")), lambda x: x != "")).alias("paras"))
    parts = known.where("part != '' and section not like '% Introduction'")
    inner = parts.select(*keep, "n", "part", F.posexplode(F.when(F.col("body").rlike(r"^\s*\{"), F.from_json("body", "map<string,string>")).otherwise(F.create_map(F.lit(""), F.col("body")))).alias("m", "sub", "node"))
    opening = F.col("sub").isin("Introduction", "Foreword")
    intros = inner.where(opening).select(*keep, "n", "m", F.concat(F.lit("intro:"), "part", F.lit(":0")).alias("key"), _strings(F.col("node")).alias("paras"))
    chapters = inner.where(~opening).select(*keep, "n", "m", "part", F.posexplode(F.from_json("node", "array<string>")).alias("i", "c"))
    listed = chapters.select(*keep, "n", "m", F.concat(F.lit("ch:"), "part", F.lit(":"), (F.col("i") + 1).cast("string")).alias("key"), F.when(F.col("c").rlike(r"^\s*\["), _strings(F.col("c"))).otherwise(F.filter(F.array(normal.without_markup("c")), lambda x: x != "")).alias("paras"))
    held = whole.unionByName(intros).unionByName(listed).where("size(paras) > 0")
    return held.groupBy(*keep, "key").agg(F.max_by("paras", F.struct("n", "m")).alias("paras"))


def corpus(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(witness, key, para_no, text) of JSON files witness → {key: [paragraphs]}; missing files are skipped."""
    out = spark.createDataFrame([], "witness string, key string, para_no int, text string")
    for witness, path in paths.items():
        if not exists(spark, path):
            continue
        read = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
        exploded = read.select(F.explode("m").alias("key", "paras")).select(F.lit(witness).alias("witness"), "key", F.posexplode("paras").alias("para_no", "text"))
        out = out.unionByName(exploded)
    return out


def overwritten(sections: DataFrame) -> DataFrame:
    """Of sections(key, section_order, paras) that land on one key the later wins; collisions are counted."""
    return sections.groupBy("key").agg(F.max_by("paras", "section_order").alias("paras"), (F.count("*") - 1).alias("collisions"))


def transcript(frame: DataFrame, text: str = "value", least_letters: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """S3: (keep, page, body, start_at) of transcripts with page banners, start_at running over the bodies of one transcript."""
    pages = F.regexp_extract_all(text, F.lit(BANNER), F.lit(1))
    bodies = F.filter(F.split(text, BANNER), lambda b, i: i > 0)
    zipped = F.transform(F.arrays_zip(pages.alias("p"), bodies.alias("b")), lambda s: F.struct(s["p"].cast("int").alias("page"), F.btrim(s["b"], F.lit("\n")).alias("body")))
    rows = frame.select(*keep, F.posexplode(zipped).alias("n", "s"), zipped.alias("all")).select(
        *keep, F.col("s.page").alias("page"), F.col("s.body").alias("body"), F.expr("aggregate(slice(all, 1, n), 0, (a, x) -> a + length(x.body))").alias("start_at")
    )
    return rows.where(F.length(F.regexp_replace("body", r"[^\p{L}]", "")) >= least_letters)


def optional_reading(spark: SparkSession, path: str) -> DataFrame:
    """(page, body, notes) of a JSON array of pages, empty where the file is absent."""
    schema = "page int, body string, notes string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def eye_readings(frame: DataFrame, text: str = "value") -> DataFrame:
    """`frame` with body (folio line and hedge marks out) and hedged (sorted distinct forms in ⟪⟫)."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*[\[(]?\d+[\])]?\s*\n", ""), "[⟪⟫]", "")
    return frame.withColumn("hedged", F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("⟪([^⟫]*)⟫"), F.lit(1))))).withColumn("body", body)


@F.pandas_udf(T.StringType())
def data_island(html: pd.Series) -> pd.Series:
    """The JSON in a page's gzip and base64 data island, null where there is none."""

    def one(page: str | None) -> str | None:
        start = (page or "").find('<script id="data"')
        if start < 0:
            return None
        start = page.index(">", start) + 1
        packed = page[start : page.index("</script>", start)]
        return json.dumps(json.loads(gzip.decompress(base64.b64decode(packed))), ensure_ascii=False)

    return html.map(one)


def markdown_volume(frame: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, n, kind, value) of a volume's blocks: title, note, page head or paragraph."""
    blocks = F.filter(F.transform(F.split(text, "\n\\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    kind = F.when(F.col("b").startswith("# "), "title").when(F.col("b").startswith(">"), "note").when(F.col("b").startswith("## "), "page").otherwise("paragraph")
    return frame.select(*keep, F.posexplode(blocks).alias("n", "b")).select(*keep, "n", kind.alias("kind"), F.regexp_replace("b", "^(?:#+|>) *", "").alias("value"))
