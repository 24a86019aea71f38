"""Problem 5: occurrences and record counts of every term, kept up by signed deltas.

A batch holds added (+1) and removed (-1) record versions; a changed record is
its old version removed and its new one added.  Only the batch is aggregated,
map-side first, into per-term changes, which are merged into counts that lie
partitioned by a hash of the term.  Buckets a batch doesn't touch are not
rewritten: a manifest names the version each bucket was last written in.

Null texts count nowhere; an empty whole-text term is a term, an empty piece is
none; repeated rows count each by itself.  Terms whose counts fall to zero
leave the store; a negative count means that a version was removed that was
never added and raises when marks are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.lineage import Manifests

#: Terms a bucket holds before the number of buckets is doubled.
BUCKET_TERMS = 250_000


def deltas(batch: DataFrame) -> DataFrame:
    """(field, term, occurrences, records) changes of `batch`(field, terms, sign); a null term counts the field's records.

    `batch.terms` is an array<string> of the record's terms.  The array is
    sorted once, so a record's repeated terms are told from its first one in
    linear space however long it is.
    """
    in_order = batch.select("field", "sign", F.array_sort("terms").alias("s"))
    own = "transform(s, (x, i) -> struct(x as term, if(i = 0 or s[i - 1] != x, 1, 0) as first))"
    flagged = in_order.select("field", "sign", F.explode(F.expr(f"array_append({own}, struct(cast(null as string) as term, 1 as first))")).alias("e"))
    return flagged.groupBy("field", F.col("e.term").alias("term")).agg(F.sum("sign").alias("occurrences"), F.sum(F.col("sign") * F.col("e.first")).alias("records"))


def whole(text: str = "text") -> Column:
    return F.array(F.col(text))


def pieces(text: str = "text") -> Column:
    """Non-empty pieces between U+0020."""
    return F.filter(F.split(F.col(text), " ", -1), lambda x: x != "")


class CountStore:
    """Per-term counts under `path`, a folder all executors share.

    The number of buckets follows the number of terms: a batch that would fill
    them beyond `bucket_terms` each doubles it, as often as is needed, and
    rewrites the store.  A manifest names the version each bucket was last
    written in; versions no bucket needs any longer are deleted once the next
    manifest stands, so a reader of the manifest before may go on.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_terms: int = BUCKET_TERMS):
        self.spark, self.path, self.bucket_terms = spark, path.rstrip("/"), bucket_terms
        self.manifests = Manifests(spark, self.path)

    def _state(self) -> dict:
        return self.manifests.read() or {"version": 0, "size": 1, "terms": 0, "buckets": {}, "totals": {}, "old": []}

    def _counts(self, state: dict) -> DataFrame:
        schema = "field string, term string, occurrences bigint, records bigint, bucket int"
        versions: dict[int, list[int]] = {}
        for bucket, version in state["buckets"].items():
            versions.setdefault(version, []).append(int(bucket))
        out = None
        for version, own in sorted(versions.items()):
            part = self.spark.read.schema(schema).parquet(f"{self.path}/v{version}").where(F.col("bucket").isin(own))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """(field, term, occurrences, records, bucket) as of the last committed batch."""
        return self._counts(self._state())

    def totals(self) -> dict[str, int]:
        """Records per field."""
        return self._state()["totals"]

    def apply(self, batch: DataFrame) -> None:
        """Merge `batch`(field, terms array<string>, sign) into the store; null terms (null texts) are no records."""
        state = self._state()
        version = state["version"] + 1
        target = f"{self.path}/delta{version}"
        deltas(batch.where("terms is not null")).write.mode("overwrite").parquet(target)
        change = self.spark.read.parquet(target)
        totals = change.where("term is null").collect()  # one row for each field the caller named
        own = change.where("term is not null")
        size = state["size"]
        while size * self.bucket_terms < state["terms"] + own.count():
            size *= 2
        bucket = F.pmod(F.xxhash64("term"), F.lit(size)).cast("int").alias("bucket")
        own = own.select("field", "term", "occurrences", "records", bucket)
        if size == state["size"]:
            touched = [r[0] for r in own.select("bucket").distinct().collect()]  # at most `size` numbers
            old = self._counts(state).where(F.col("bucket").isin(touched))
        else:
            touched = list(range(size))
            old = self._counts(state).select("field", "term", "occurrences", "records", bucket)
        if touched:
            merged = (
                old.unionByName(own)
                .groupBy("bucket", "field", "term")
                .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
                .where("occurrences != 0 or records != 0")
            )
            spread = merged.repartition("bucket") if size > 1 else merged
            spread.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/v{version}")
        self.manifests.delete(f"delta{version}")
        for row in totals:
            state["totals"][row["field"]] = state["totals"].get(row["field"], 0) + row["records"]
        dead = set(state["buckets"].values())
        kept = state["buckets"] if size == state["size"] else {}
        state |= {"version": version, "size": size, "buckets": kept | {str(b): version for b in touched}}
        state["terms"] = self._counts(state).count()
        doomed, state["old"] = state["old"], sorted(dead - set(state["buckets"].values()))
        self.manifests.write(state)
        for v in doomed:
            self.manifests.delete(f"v{v}")

    def marks(self, common: dict[str, float], rare: int) -> DataFrame:
        """(field, term, occurrences, records, mark): `common` above the field's share of records, else `rare` below `rare` records, else null."""
        totals = self.totals()
        bound = F.lit(None).cast("double")
        for field, share in common.items():
            bound = F.when(F.col("field") == field, F.lit(totals.get(field, 0) * share)).otherwise(bound)
        checked = self.counts().withColumn("records", F.when(F.col("records") < 0, F.raise_error(F.lit("a removed record was never added"))).otherwise(F.col("records")))
        return checked.select("field", "term", "occurrences", "records", F.when(F.col("records") > bound, "common").when(F.col("records") < rare, "rare").alias("mark"))


def batches(fields: Sequence[tuple[str, DataFrame, Column]], sign: int = 1) -> DataFrame:
    """One batch of (field, terms, sign) from (name, records with a column text, term rule)."""
    out = None
    for name, frame, rule in fields:
        part = frame.select(F.lit(name).alias("field"), F.when(F.col("text").isNotNull(), rule).alias("terms"), F.lit(sign).alias("sign"))
        out = part if out is None else out.unionByName(part)
    return out
