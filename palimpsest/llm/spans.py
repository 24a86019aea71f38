"""Problem 4: long spans that stand verbatim in more than one record.

Window fingerprints are chosen so that any span of at least `SPAN` code points
shared by two texts holds a fingerprint chosen in both (the first smallest of
every `REACH` neighbouring gram hashes).  Fingerprints of all texts seen so far
lie in sorted, bucketed, immutable runs that a versioned manifest names, so an
index can be opened again in another session.  A new batch becomes a run of its
own, is merge-joined in the runs' stored order with every older run and itself,
and runs are compacted when they grow too many.

No group is multiplied out to find candidates.  A hash with at most `LIGHT`
fingerprints on either side gives candidate pairs, verified on the texts.  Of
any other hash only the fingerprints are listed; their texts' windows of `SPAN`
code points around them are grouped by a 128-bit hash, which makes exact classes
in linear space.  A hash that fills a good part of a batch is kept out of the
buckets, in files of its own, so a passage held by a third of all texts is no
single task.  Repetitive text counts once for each different surrounding.

Exact copies are one text with many records, so a text held by a third of all
records costs one set of fingerprints.  Null and short texts share nothing;
repeated rows are records of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.plans.lineage import Manifests

SPAN, GRAM = 50, 30
REACH = SPAN - GRAM + 1
#: Code points hashed at a time; longer texts are cut with an overlap of a span, so no window is lost.
PIECE = 1 << 20
#: Most fingerprints of a hash in one run for it to be paired; a hash with more is resolved by windows.
LIGHT = 64
#: A hash standing this often among the fingerprints of one `PIECE` is kept out of the buckets.
HOT = 256
#: Most members of a class that one task pairs with as many others.
BLOCK = 512
#: Most hashes sent to every worker; more are joined by a shuffle.
SMALL = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def window_hashes(points: np.ndarray, size: int, seed: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """64-bit hash of every window of `size` code points, by doubling."""
    if len(points) < size:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        level = _mix(points.astype(np.uint64) + np.uint64(seed))
        base, width, out, have = np.uint64(0xD6E8FEB86659FD93), 1, None, 0
        power = base
        n = len(points) - size + 1
        while True:
            if size & width:
                part = level[have : have + n]
                out = part.copy() if out is None else out * power + part
                have += width
            if have == size:
                return _mix(out)
            level = level[:-width] * power + level[width:]
            power = power * power + np.uint64(0x632BE59BD9B4E019)
            width *= 2


def chosen(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of texts laid end to end in `points`."""
    hashes = window_hashes(points, GRAM)
    if len(hashes) < REACH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    best = np.lib.stride_tricks.sliding_window_view(hashes, REACH).argmin(axis=1) + np.arange(len(hashes) - REACH + 1)
    inside = np.zeros(len(points) + 1, np.int64)
    long = lengths >= SPAN
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + lengths[long] - SPAN + 1, -1)
    valid = np.cumsum(inside)[: len(best)] > 0
    at = np.unique(best[valid])
    return at, hashes[at]


def _different(points: np.ndarray, at: np.ndarray, hashes: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which fingerprints to keep: of those with one hash in one text, one for each different surrounding.

    The surrounding reaches as far as a span around the gram can, so what is
    left out shares the same spans as what is kept.
    """
    keep = np.ones(len(at), bool)
    order = np.lexsort((hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(again):
        return keep
    reach = np.arange(-(REACH - 1), SPAN)
    weights = _mix(np.arange(1, len(reach) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    around = np.empty(len(again), np.uint64)
    for i in range(0, len(again), 1 << 16):
        part = again[i : i + (1 << 16)]
        place = at[part][:, None] + reach
        inside = (place >= low[owner[part]][:, None]) & (place < high[owner[part]][:, None])
        letters = np.where(inside, points[np.clip(place, 0, len(points) - 1)].astype(np.uint64) + np.uint64(2), np.uint64(1))
        with np.errstate(over="ignore"):
            around[i : i + len(part)] = (_mix(letters) * weights).sum(axis=1, dtype=np.uint64)
    _, first = np.unique(np.stack([owner[again].astype(np.uint64), hashes[again], around]), axis=1, return_index=True)
    keep[again] = False
    keep[again[first]] = True
    return keep


def fingerprints(texts: DataFrame) -> DataFrame:
    """(h, key, pos, hot) of the fingerprints of `texts`(key, text); hot: the hash fills a good part of its batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pending: list[tuple[object, str, int]] = []
            size = 0
            for key, text in zip(frame["key"], frame["text"]):
                for at in range(0, max(1, len(text) - SPAN + 1), PIECE):
                    piece = text[at : at + PIECE + SPAN - 1]
                    pending.append((key, piece, at))
                    size += len(piece)
                    if size > PIECE:
                        yield _table(pending)
                        pending, size = [], 0
            if pending:
                yield _table(pending)

    return texts.where(F.length("text") >= SPAN).select("key", "text").mapInPandas(run, f"h long, key {dict(texts.dtypes)['key']}, pos int, hot boolean")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _table(pieces: list[tuple[object, str, int]]) -> pd.DataFrame:
    lengths = np.array([len(t) for _, t, _ in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    points = _points("".join(t for _, t, _ in pieces))
    at, hashes = chosen(points, starts, lengths)
    owner = np.searchsorted(starts, at, side="right") - 1
    keep = _different(points, at, hashes, owner, starts, starts + lengths)
    at, hashes, owner = at[keep], hashes[keep], owner[keep]
    _, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    offset = np.array([o for _, _, o in pieces], np.int64)
    hot = counts[which] >= HOT if len(hashes) else np.empty(0, bool)
    return pd.DataFrame({"h": hashes.view(np.int64), "key": [pieces[o][0] for o in owner], "pos": (at - starts[owner] + offset[owner]).astype(np.int32), "hot": hot})


def _spans_over(a: str, b: str, i: int, j: int) -> bool:
    """Whether the common gram at `i` in `a` and `j` in `b` lies in a common span."""
    if a[i : i + GRAM] != b[j : j + GRAM]:
        return False
    left, right = 0, 0
    while left < REACH and i > left and j > left and a[i - left - 1] == b[j - left - 1]:
        left += 1
    e, f = i + GRAM, j + GRAM
    while right < REACH and e + right < len(a) and f + right < len(b) and a[e + right] == b[f + right]:
        right += 1
    return left + right >= SPAN - GRAM


@contextmanager
def _stored_order(spark: SparkSession):
    """Scans of bucketed runs, one sorted file a bucket, keep their order while the plan is made."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    old = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


class Matches:
    """What an appended batch has in common with the index: candidate pairs and crowded fingerprints, both written.

    `pairs`(key_a, key_b, places): places of common grams, as (at_a, at_b).
    `crowd`(key, places): fingerprints of hashes with too many holders to pair.
    """

    def __init__(self, pairs: DataFrame, crowd: DataFrame):
        self.pairs, self.crowd = pairs, crowd

    def __add__(self, other: Matches) -> Matches:
        return Matches(self.pairs.unionByName(other.pairs), self.crowd.unionByName(other.crowd))


class FingerprintIndex:
    """Sorted immutable runs of fingerprints under `path`, a folder all executors share.

    The manifest gives the runs in order; an index made anew at the same path
    goes on where the last one stopped, also in another session.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, most_runs: int = 4, light: int = LIGHT, key_type: str = "bigint"):
        self.spark, self.path, self.most_runs, self.light = spark, path.rstrip("/"), most_runs, light
        self.manifests = Manifests(spark, self.path)
        state = self.manifests.read() or {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "key": key_type, "runs": [], "hot": {}}
        self.buckets, self.key_type, self.runs, self.hot = state["buckets"], state["key"], state["runs"], state["hot"]

    def _commit(self, runs: list[str]) -> None:
        self.runs, self.hot = runs, {r: self.hot[r] for r in runs}
        self.manifests.write({"buckets": self.buckets, "key": self.key_type, "runs": self.runs, "hot": self.hot})

    def _cold(self, run: str) -> DataFrame:
        """The bucketed part of a run; the session's catalogue is told of it when it is first asked for."""
        if not self.spark.catalog.tableExists(run):
            self.spark.sql(f"CREATE TABLE `{run}` (h BIGINT, key {self.key_type}, pos INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(run)

    def _hot(self, run: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{run}-hot") if self.hot[run] else None

    def _hot_hashes(self, run: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{run}-hashes") if self.hot[run] else None

    def _write(self, raw: DataFrame, hashes: DataFrame | None) -> str:
        """A run of the rows `raw`(h, key, pos), those of `hashes` apart."""
        run = f"fingerprints_{uuid.uuid4().hex}"
        n = 0
        if hashes is not None:
            hashes.distinct().write.parquet(f"{self.path}/{run}-hashes")
            own = self.spark.read.parquet(f"{self.path}/{run}-hashes")
            n = own.count()
        cold = raw
        if n:
            raw.join(_sent(own, n), "h", "left_semi").select("h", "key", "pos").write.option("compression", "zstd").parquet(f"{self.path}/{run}-hot")
            cold = raw.join(_sent(own, n), "h", "left_anti")
        (cold.select("h", "key", "pos").repartition(self.buckets, "h").sortWithinPartitions("h", "key", "pos").write.bucketBy(self.buckets, "h").sortBy("h")
            .option("path", f"{self.path}/{run}").option("compression", "zstd").format("parquet").saveAsTable(run))
        self.hot[run] = n
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{run}`")
        for part in (run, f"{run}-hot", f"{run}-hashes"):
            self.manifests.delete(part)

    def append(self, texts: DataFrame) -> Matches:
        """Index `texts`(key, text) whose keys are new, and return what they have in common with the index and each other."""
        raw = f"raw-{uuid.uuid4().hex}"
        fingerprints(texts).write.option("compression", "zstd").parquet(f"{self.path}/{raw}")
        prints = self.spark.read.parquet(f"{self.path}/{raw}")
        hot = prints.where("hot").select("h")
        new = self._write(prints, None if hot.isEmpty() else hot)
        self.manifests.delete(raw)
        self._commit([*self.runs, new])
        found = None
        for run in self.runs:
            part = self._against(new, run)
            found = part if found is None else found + part
        self.compact()
        return found

    def _against(self, new: str, old: str) -> Matches:
        name = uuid.uuid4().hex
        with _stored_order(self.spark):
            counts = lambda run, n: self._cold(run).groupBy("h").agg(F.count("*").alias(n))
            if new == old:
                crowded = counts(new, "n").where(f"n > {self.light}").select("h")
            else:
                crowded = counts(new, "n").join(counts(old, "m").hint("merge"), "h").where(f"n > {self.light} or m > {self.light}").select("h")
            for a, b in {(new, old), (old, new)}:
                if self.hot[a]:
                    apart = _sent(self._hot_hashes(a), self.hot[a])
                    present = apart if a == b else self._cold(b).join(apart, "h", "left_semi").select("h")
                    if a != b and self.hot[b]:
                        present = present.unionByName(self._hot_hashes(b).join(apart, "h", "left_semi"))
                    crowded = crowded.unionByName(present.select("h"))
            crowded.distinct().write.parquet(f"{self.path}/crowded-{name}")
            crowd = self.spark.read.parquet(f"{self.path}/crowded-{name}")
            n = crowd.count()
            rare = lambda run: self._cold(run).join(counts(run, "n").hint("merge"), "h").where(f"n <= {self.light}").select("h", "key", "pos")
            side = lambda run, s: rare(run).select("h", F.col("key").alias(f"key_{s}"), F.col("pos").alias(f"pos_{s}"))
            pairs = side(new, "a").join(side(old, "b").hint("merge"), "h").where("key_a < key_b" if new == old else "key_a != key_b")
            one = lambda x, y: F.when(F.col("key_a") > F.col("key_b"), F.col(y)).otherwise(F.col(x))
            ordered = pairs.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), F.struct(one("pos_a", "pos_b").alias("a"), one("pos_b", "pos_a").alias("b")).alias("place"))
            ordered.groupBy("key_a", "key_b").agg(F.collect_set("place").alias("places")).write.option("compression", "zstd").parquet(f"{self.path}/pairs-{name}")
            found = self.spark.read.parquet(f"{self.path}/pairs-{name}")
            if not n:
                return Matches(found, self.spark.createDataFrame([], f"key {self.key_type}, places array<int>"))
            own = None
            for run in dict.fromkeys((new, old)):
                for part in (self._cold(run), self._hot(run)):
                    if part is not None:
                        rows = part.join(_sent(crowd, n), "h", "left_semi").select("key", "pos")
                        own = rows if own is None else own.unionByName(rows)
            gathered = own.groupBy("key").agg(F.collect_set("pos").alias("places"))
            gathered.write.option("compression", "zstd").parquet(f"{self.path}/crowd-{name}")
        return Matches(found, self.spark.read.parquet(f"{self.path}/crowd-{name}"))

    def compact(self) -> None:
        """Merge all runs into one when there are more than `most_runs`; matches already given stay readable."""
        if len(self.runs) > self.most_runs:
            merged = hashes = None
            for run in self.runs:
                for part in (self._cold(run), self._hot(run)):
                    if part is not None:
                        merged = part if merged is None else merged.unionByName(part)
                if self.hot[run]:
                    own = self._hot_hashes(run)
                    hashes = own if hashes is None else hashes.unionByName(own)
            old = list(self.runs)
            self._commit([self._write(merged, hashes)])
            for run in old:
                self._drop(run)

    def drop(self) -> None:
        """Forget and delete the runs; matches already given stay readable."""
        for run in self.runs:
            self._drop(run)
        self._commit([])


def _sent(hashes: DataFrame, n: int) -> DataFrame:
    """`hashes`, of which there are `n`, sent to every worker if few, else left to a shuffle that AQE splits."""
    return F.broadcast(hashes) if n <= SMALL else hashes.hint("merge")


def verified(matches: Matches, texts: DataFrame) -> DataFrame:
    """(key_a, key_b) of the texts that share a span; key_a < key_b.

    Candidate pairs are compared on the texts themselves; crowded fingerprints
    give classes of equal windows, whose members are paired.
    """
    key_type = dict(texts.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            same = [any(_spans_over(a, b, p["a"], p["b"]) for p in places) for places, a, b in zip(frame["places"], frame["text_a"], frame["text_b"])]
            yield frame.loc[np.array(same, bool), ["key_a", "key_b"]]

    n = matches.pairs.count()  # written, so this reads no more than file footers
    wanted = matches.pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    held = texts.join(_sent(wanted, 2 * n), "key", "left_semi")  # texts in no candidate pair are not shuffled
    side = lambda s: held.select(F.col("key").alias(f"key_{s}"), F.col("text").alias(f"text_{s}"))
    both = matches.pairs.join(side("a"), "key_a").join(side("b"), "key_b").select("key_a", "key_b", "places", "text_a", "text_b")
    same = both.mapInPandas(run, f"key_a {key_type}, key_b {key_type}")
    return same.unionByName(class_pairs(crowd_windows(matches.crowd, texts))).distinct()


def _window_rows(text: str, starts: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first hash, second hash, place) of the windows of `SPAN` code points, all or those at `starts`."""
    points = _points(text)
    for at in range(0, len(points) - SPAN + 1, PIECE):
        part = points[at : at + PIECE + SPAN - 1]
        w, v = window_hashes(part, SPAN), window_hashes(part, SPAN, 0x2545F4914F6CDD1D)
        own = np.arange(len(w)) if starts is None else starts[(starts >= at) & (starts < at + len(w))] - at
        yield w[own].view(np.int64), v[own].view(np.int64), (own + at).astype(np.int32)


def crowd_windows(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """(w, v, key) of the windows of `SPAN` code points that hold one of the places of `crowd`, each once a text."""
    key_type = dict(texts.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, places, text in zip(frame["key"], frame["places"], frame["text"]):
                at = np.asarray(places, np.int64)
                starts = np.unique((at[:, None] - np.arange(REACH)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(text) - SPAN)]
                for w, v, _ in _window_rows(text, starts):
                    if len(w):
                        yield pd.DataFrame({"w": w, "v": v, "key": key}).drop_duplicates()

    together = crowd.select("key", F.explode("places").alias("p")).groupBy("key").agg(F.collect_set("p").alias("places"))
    return together.join(texts.select("key", "text"), "key").mapInPandas(run, f"w long, v long, key {key_type}").distinct()


def class_pairs(windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key_a, key_b) of the members of each class of `windows`(w, v, key), which holds a key once a window.

    Windows with the same members are one class, so a long shared passage is
    paired once.  Members are cut into blocks and every two blocks are a task's
    work; the pairs are the result asked for, so their number is not.
    """
    classes = windows.groupBy("w", "v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(7))).alias("y")).where("n > 1")
    once = classes.groupBy("n", "x", "y").agg(F.min(F.struct("w", "v")).alias("c")).select("c.w", "c.v", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = windows.join(once, ["w", "v"]).withColumn("slot", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")))
    spread = F.explode(F.expr("sequence(0, blocks - 1)"))
    a = members.select("w", "v", F.col("key").alias("key_a"), F.col("slot").cast("int").alias("i"), spread.alias("j"))
    b = members.select("w", "v", F.col("key").alias("key_b"), F.col("slot").cast("int").alias("j"), spread.alias("i"))
    return a.join(b, ["w", "v", "i", "j"]).where("key_a < key_b").select("key_a", "key_b")


def record_pairs(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rec_a, rec_b) of the records of `values`(rec, owner, key, text) behind the text pairs and the exact copies.

    Rows of one owner (table and natural key, nulls equal) are no pair.
    """
    long = values.where(F.length("text") >= SPAN).select("rec", "owner", "key").distinct()
    copies = long.groupBy("key").agg(F.min("rec").alias("low"), F.max("rec").alias("high")).where("low != high").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"))
    side = lambda s: long.select(F.col("key").alias(f"key_{s}"), F.col("rec").alias(f"r_{s}"), F.col("owner").alias(f"o_{s}"))
    joined = pairs.unionByName(copies).join(side("a"), "key_a").join(side("b"), "key_b")
    kept = joined.where("o_a != o_b and r_a != r_b and (key_a != key_b or r_a < r_b)")
    return kept.select(F.least("r_a", "r_b").alias("rec_a"), F.greatest("r_a", "r_b").alias("rec_b")).distinct()


def sharing_keys(values: DataFrame, matches: Matches) -> DataFrame:
    """(key) of the texts with a fingerprint in common with another or with several owners: no other text shares a span."""
    owners = values.groupBy("key").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low != high").select("key")
    own = matches.crowd.select("key").unionByName(matches.pairs.select(F.col("key_a").alias("key"))).unionByName(matches.pairs.select(F.col("key_b").alias("key")))
    return owners.unionByName(own).distinct()


def _windows(values: DataFrame, among: DataFrame | None) -> DataFrame:
    """(w, v, o, owner, key, pos) of every window of the texts of `values`, o being a hash of the owner."""
    texts = values.select("owner", "key", "text").where(F.length("text") >= SPAN).dropDuplicates(["owner", "key"])
    if among is not None:
        texts = texts.join(among, "key", "left_semi")
    key_type = dict(values.dtypes)["key"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for o, key, text in zip(frame["o"], frame["key"], frame["text"]):
                for w, v, pos in _window_rows(text, None):
                    yield pd.DataFrame({"w": w, "v": v, "o": o, "key": key, "pos": pos})

    return texts.select(F.xxhash64("owner").alias("o"), "key", "text").mapInPandas(run, f"w long, v long, o long, key {key_type}, pos int")


def stretches(values: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(o, key, start_at, end_at, key_to, at_to, holders): every maximal stretch of a text that stands elsewhere.

    Windows that are equal are a class; its representative is the least
    (key, place) and is named by every member, so a passage held by a third of
    all texts gives one row a text, never a row a pair.  Windows that follow one
    another in a text and in their representative are one stretch; `holders` is
    the greatest number of (owner, text) members of its windows.  A stretch that
    is its own representative names itself.
    """
    windows = _windows(values, among)
    classes = (
        windows.groupBy("w", "v").agg(F.min("o").alias("low"), F.max("o").alias("high"), F.min(F.struct("key", "pos")).alias("to"), F.count("*").alias("n"))
        .where("low != high").select("w", "v", "to", "n")
    )
    hits = windows.join(classes, ["w", "v"]).select("o", "key", "pos", F.col("to.key").alias("key_to"), (F.col("to.pos") - F.col("pos")).alias("shift"), "n")
    gathered = hits.groupBy("o", "key", "key_to", "shift").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("p"))
    opens = F.expr("filter(transform(p, (x, i) -> struct(x.pos as pos, i as i, i = 0 or x.pos > p[i - 1].pos + 1 as opens)), x -> x.opens)")
    runs = gathered.select("o", "key", "key_to", "shift", "p", opens.alias("q")).select("o", "key", "key_to", "shift", "p", F.explode(F.expr("transform(q, (x, k) -> struct(x.i as i, if(k + 1 < size(q), q[k + 1].i, size(p)) as j))")).alias("r"))
    return runs.select("o", "key", F.expr("p[r.i].pos").alias("start_at"), F.expr(f"p[r.j - 1].pos + {SPAN}").alias("end_at"), "key_to", F.expr("p[r.i].pos + shift").alias("at_to"), F.expr("array_max(transform(slice(p, r.i + 1, r.j - r.i), x -> x.n))").alias("holders"))


def classes(values: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(rec, start_at, end_at, rec_to, at_to, holders): the `stretches` of every record, representatives named by their least record."""
    found = stretches(values, among)
    first = values.where(F.length("text") >= SPAN).groupBy(F.col("key").alias("key_to")).agg(F.min("rec").alias("rec_to"))
    own = values.select("rec", F.xxhash64("owner").alias("o"), "key")
    return own.join(found, ["o", "key"]).join(first, "key_to").select("rec", "start_at", "end_at", "rec_to", "at_to", "holders")


def shares(values: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(rec, chars, shared_chars, share): how much of each record lies in windows of `SPAN` that another owner holds too.

    `among`: the keys `sharing_keys` gives, which leaves the windows of all other texts out of the work.

    Linear in the text: windows are grouped once (map-side least and greatest
    owner), never paired, so a passage held by a third of all records is one
    group of two figures.
    """
    windows = _windows(values, among)
    shared = windows.groupBy("w", "v").agg(F.min("o").alias("low"), F.max("o").alias("high")).where("low != high").select("w", "v")
    hits = windows.join(shared, ["w", "v"], "left_semi").groupBy("o", "key").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    covered = F.expr(f"aggregate(at, struct(0 as n, 0 as seen), (s, p) -> struct(s.n + p + {SPAN} - greatest(s.seen, p) as n, p + {SPAN} as seen)).n")
    by_text = hits.select("o", "key", covered.alias("covered"))
    return (
        values.withColumn("o", F.xxhash64("owner"))
        .join(by_text, ["o", "key"], "left")
        .groupBy("rec")
        .agg(F.sum(F.length("text")).alias("chars"), F.coalesce(F.sum("covered"), F.lit(0)).alias("shared_chars"))
        .withColumn("share", F.round(F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(0.0), 6))
    )
