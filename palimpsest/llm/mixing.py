"""Problem 8: combining sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time, its source's cumulative
tokens in shuffled order divided by the source's weight; the copies are put in
one global order of finish times and cut at the token budget.  A source that
has used up its allowed repetitions falls silent and the others go on in their
own proportion, so the budget is met as far as the sources last.

Order is made by range partitioning, both of the shuffled documents of all
sources and of the copies by finish time: a source with a third of all rows
lies in many ranges, sums are taken per range, and only the one range in which
the budget runs out is looked at row by row.  Null texts have no tokens and are
left out, as are unlisted sources; an empty text can be chosen and weighs
nothing; a repeated row is a document of its own.  Ties of finish time are
broken by source, document and copy.
"""

from __future__ import annotations

import base64
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.lineage import written

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Largest vocabulary file sent to the workers.
MOST_BYTES = 64 << 20
#: Documents or copies in a range.
RANGE_ROWS = 500_000


def count_tokens(spark: SparkSession, path: str = TOKENIZER, pattern: str = PATTERN):
    """Column → tokens of a public byte-level vocabulary file of ranks.

    `path` is read on the driver only and sent to the workers, whose machines need not have it.
    """
    with open(path, "rb") as file:
        content = file.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError(f"the vocabulary file is larger than {MOST_BYTES} bytes")
    shared, name = spark.sparkContext.broadcast(content), uuid.uuid4().hex

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        import tiktoken

        cached = globals().setdefault("_PALIMPSEST_ENCODINGS", {})
        if name not in cached:
            cached.clear()
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
            cached[name] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return texts.map(lambda t: None if t is None else len(cached[name].encode_ordinary(t))).astype("Int64")

    return run


def _ranges(frame: DataFrame, rows: int, order: list[str], size: int, name: str) -> DataFrame:
    """`frame` of `rows` rows, written in ranges of `order` of about `size` rows, with the range's number `part`."""
    n = max(1, -(-rows // size))
    return written(frame.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), name)


def mixture(sized: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(source, doc_id, copy, tokens, finish): the chosen copies of `sized`(doc_id, source, tokens), in queue order.

    `targets`(source, target_share, max_repeats); `budget` in tokens, by default
    the total of the listed sources once over.
    """
    wanted = targets.where("target_share > 0 and max_repeats > 0").select("source", F.col("target_share").alias("weight"), "max_repeats")
    docs = sized.where("tokens is not null").select("doc_id", "source", "tokens").join(wanted, "source")
    # as many rows as listed sources
    totals = docs.groupBy("source", "weight", "max_repeats").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("most"), F.count("*").alias("n")).collect()
    if not totals or not sum(r["total"] for r in totals):
        return docs.select("source", "doc_id", F.lit(1).alias("copy"), "tokens", F.lit(0.0).alias("finish")).limit(0)
    budget = sum(r["total"] for r in totals) if budget is None else budget
    until = _virtual_end([(r["weight"], r["total"] * r["max_repeats"]) for r in totals], budget)
    until += max(r["most"] for r in totals) / min(r["weight"] for r in totals)
    shuffled = docs.withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    lined = _ranges(shuffled, sum(r["n"] for r in totals), ["source", "key", "doc_id"], range_rows, "shuffled")
    # a table of at most ranges plus sources rows
    sums = lined.groupBy("source", "part").agg(F.sum("tokens").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(Window.partitionBy("source").orderBy("part")) - F.col("own")).drop("own")
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    served = lined.withColumn("served", F.sum("tokens").over(inside)).join(before, ["source", "part"]).withColumn("served", F.col("served") + F.col("before"))
    whole = sized.sparkSession.createDataFrame([(r["source"], r["total"]) for r in totals], "source string, total long")
    copies = served.join(F.broadcast(whole), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("max_repeats").cast("int"))))
    timed = copies.withColumn("finish", ((F.col("copy") - 1) * F.col("total") + F.col("served")) / F.col("weight")).where(F.col("finish") <= until)
    order = ["finish", "source", "doc_id", "copy"]
    queue = _ranges(timed.select(*order, "tokens"), sum(r["n"] * r["max_repeats"] for r in totals), order, range_rows, "queue")
    # one row for each range: the ranges that fit, and the one in which the budget runs out
    sent, last = 0, None
    for row in queue.groupBy("part").agg(F.sum("tokens").alias("own")).orderBy("part").collect():
        if sent + row["own"] > budget:
            last = row["part"]
            break
        sent += row["own"]
    chosen = queue
    if last is not None:
        within = queue.where(F.col("part") == last).withColumn("sent", F.sum("tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        chosen = queue.where(F.col("part") < last).unionByName(within.where(F.col("sent") <= budget - sent).drop("sent"))
    return chosen.orderBy(*order).select("source", "doc_id", "copy", "tokens", "finish")


def _virtual_end(sources: list[tuple[float, float]], budget: float) -> float:
    """Virtual time at which sources of (weight, most tokens) have sent `budget`, or have all ended."""
    clock, sent, live = 0.0, 0.0, sorted(sources, key=lambda s: s[1] / s[0])
    while live:
        weight = sum(w for w, _ in live)
        ends = live[0][1] / live[0][0]
        if sent + weight * (ends - clock) >= budget:
            return clock + (budget - sent) / weight
        sent += weight * (ends - clock)
        clock = ends
        live = live[1:]
    return clock


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: documents, copies and tokens chosen, the share reached and the target; absent sources reach 0."""
    own = chosen.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("copies"), F.sum("tokens").alias("tokens"))
    own = own.withColumn("_all", F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # as many rows as listed sources
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        targets.select("source", "target_share", "max_repeats").join(own, "source", "left")
        .select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("_all"), 6), F.lit(0.0)).alias("actual_share"))
    )
