"""Spans on a text: conflicts, snapping, clipping, numbering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of spans by the order in which conflicts are settled (fixed values); kinds not named come with the words' marks.
PRIORITY = {"q": 0, "note": 2}


def resolved(spans: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Spans without conflict, the lower priority giving way; one strictly inside a quotation may stay."""
    kept: list[tuple[int, int, str, int]] = []
    for s in sorted(spans, key=lambda s: (PRIORITY.get(s[2], 1), s[0])):
        clash = False
        for k in kept:
            apart = s[1] <= k[0] or k[1] <= s[0]
            nested = k[2] == "q" and k[0] <= s[0] and s[1] <= k[1] and (k[0], k[1]) != (s[0], s[1])
            clash = clash or not (apart or nested)
        if not clash:
            kept.append(s)
    return sorted(kept, key=lambda s: (s[0], -s[1]))


_SPANS = T.ArrayType(T.StructType([T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType())]))


@F.pandas_udf(_SPANS)
def _resolved(spans: pd.Series) -> pd.Series:
    names = ("start_at", "end_at", "kind", "n")
    return spans.map(lambda own: [dict(zip(names, r)) for r in resolved([tuple(s[k] for k in names) for s in own])])


def resolve(frame: DataFrame, unit: str) -> DataFrame:
    """W2 for every unit, a text of bounded length, of (unit, start_at, end_at, kind, n); spans of equal place keep their order by n."""
    own = frame.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("start_at", "end_at", "kind", "n"))).alias("s"))
    return own.select(unit, F.explode(_resolved("s")).alias("x")).select(unit, "x.*")


def snapped(frame: DataFrame, text: str) -> DataFrame:
    """start_at and end_at moved out to the blanks around them, then clipped at the first line feed inside."""
    outward = frame.withColumn("start_at", F.expr(f"length(regexp_extract(substring({text}, 1, start_at), '(?s)^(.*[ \\\\n])?', 1))")).withColumn("end_at", F.expr(f"end_at + length(regexp_extract(substring({text}, end_at + 1), '^[^ \\\\n]*', 0))"))
    inner = F.expr(f"locate('\\n', substring({text}, start_at + 1, end_at - start_at))")
    return outward.withColumn("end_at", F.when(inner > 0, F.col("start_at") + inner - 1).otherwise(F.col("end_at")))


def numbered(frame: DataFrame, unit: list[str], start: str) -> DataFrame:
    """Notes numbered from 1 in each unit by place."""
    return frame.withColumn("note_no", F.row_number().over(Window.partitionBy(*unit).orderBy(start)))


def first_stride(frame: DataFrame, form: str, order: list[str], take: int) -> DataFrame:
    """The first occurrence of each form, then an even stride of `take` of them in order.

    The stride needs only each row's rank, counted in buckets of the order.
    """
    from palimpsest.operators.windows import running_sum

    first = frame.withColumn("_k", F.row_number().over(Window.partitionBy(form).orderBy(*order))).where("_k = 1").drop("_k").withColumn("_one", F.lit(1))
    total = first.count()
    lined = running_sum(first.withColumn("_slot", F.floor(F.col(order[0]) / 1000)), [], "_slot", order, "_one", "_rank")
    step = F.floor((F.col("_rank") - 1) * take / total)
    before = F.floor((F.col("_rank") - 2) * take / total)
    return lined.where((F.lit(total) <= take) | (F.col("_rank") == 1) | (step > before)).drop("_one", "_slot", "_rank")
