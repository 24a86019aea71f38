"""Problem 7: evaluation passages that leaked into a corpus.

Containment search over size partitions.  Queries are sets of shingles of five
words: the whole item, which may leak in part, and every run of `RUN` words,
the least passage that counts as a leak.  They are partitioned by size, a power
of two, as a min-hash sketch serves only sets of like size; a run is a
partition of its own.  In the partition of at most `u` shingles the sketch of a
query is the `u - ceil(t·u) + 1` first of its shingles in one order of all
shingles: those few items hold first, then the least hash.  Any text that
contains a share `t` of a query holds one of its sketch, so no leak is missed;
for runs (t = 1) the sketch is one shingle.

Documents are read and cut into words once, whatever the number of items.  A
bit table of a fixed size, made of the items' shingles and runs, lets through
the few shingles worth a row; these are joined with the sketches by hash, and
candidates are verified by exact containment: of the item's shingles for its
share, of the run itself for a passage.  Nothing is bounded by the number of
items: with more of them the bit table lets more rows through to the joins.

Null and short texts hold nothing; a repeated document or item is answered
each by itself.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.spans import window_hashes
from palimpsest.plans.lineage import written

RUN, SHINGLE, SHARE = 13, 5, 0.8
#: log2 of the bits of the table sent to the workers: 16 MB, whatever the number of items.
TABLE_BITS = 27
_HIDDEN = re.compile("[؜᠎​-‏‪-‮⁠-⁯﻿]")
_BROKEN = re.compile(r"(?<=\w)(?:[-‐‑¬⸗=־]|­)[ \t]*\r?\n[ \t]*(?=\w)")
_MARKS = re.compile("[̀-֑ͯ-ׇֽֿׁׂًׅׄ-ٰٟۖ-ۜ­]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits without case, points, accents; words broken at a line's end joined."""
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    text = _BROKEN.sub("", text).casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


class _Hashes(dict):
    """Word to a 64-bit hash that is the same in every process; one digest for each distinct word of a batch."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _hashed(text: str, seen: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(shingle at each word, run at each shingle or 0 where none opens) of a text."""
    own = np.array([seen[w] for w in words(text)], np.uint64)
    shingles, runs = window_hashes(own, SHINGLE), window_hashes(own, RUN)
    return shingles, np.concatenate([runs, np.zeros(len(shingles) - len(runs), np.uint64)])


def item_shingles(items: DataFrame) -> DataFrame:
    """(item_id, at, h, run) of the items' shingles; run is 0 where no run of `RUN` words opens."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = _Hashes()
            for item, text in zip(frame["item_id"], frame["text"]):
                h, runs = _hashed(text, seen)
                if len(h):
                    yield pd.DataFrame({"item_id": item, "at": np.arange(len(h)), "h": h.view(np.int64), "run": runs.view(np.int64)})

    return items.where("text is not null").select("item_id", "text").mapInPandas(run, "item_id long, at long, h long, run long")


def _bits(shingles: DataFrame, column: str) -> np.ndarray:
    """The bit table of the hashes in `column`; at most 2 ** (TABLE_BITS - 6) words come to the driver."""
    slot = F.shiftrightunsigned(F.col(column), 64 - TABLE_BITS)
    rows = shingles.select(slot.alias("s")).select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return table.view(np.uint64)


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - 5 - len(table).bit_length())
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def document_shingles(documents: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, h, run) of the shingles of `documents` that the items may hold, each once a document; run is 0 where the items hold none."""
    shared = documents.sparkSession.sparkContext.broadcast((_bits(shingles, "h"), _bits(shingles.where("run != 0"), "run")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for_shingles, for_runs = shared.value
        for frame in frames:
            seen = _Hashes()
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                h, runs = _hashed(text, seen)
                near = _held(for_shingles, h)
                if near.any():
                    h, runs = h[near], runs[near]
                    runs = np.where(_held(for_runs, runs), runs, np.uint64(0))
                    out.append(pd.DataFrame({"doc_id": doc, "h": h.view(np.int64), "run": runs.view(np.int64)}).drop_duplicates())
            if out:
                yield pd.concat(out)

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, h long, run long")


def queries(shingles: DataFrame, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """((item_id, h, size) of the items' sketches, (h, run) of the runs').

    `shingles` are the items' (item_id, at, h, run).  The partition of an item
    is the power of two its number of different shingles does not pass.
    """
    own = shingles.select("item_id", "h").distinct()
    held = own.groupBy("h").agg(F.count("*").alias("items"))
    ranked = (
        own.join(held, "h").withColumn("size", F.count("*").over(Window.partitionBy("item_id")))
        .withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("items", "h")))
        .withColumn("upper", F.pow(F.lit(2.0), F.ceil(F.log2("size"))))
    )
    whole = ranked.where(F.col("rank") <= F.col("upper") - F.ceil(F.col("upper") * share) + 1).select("item_id", "h", "size")
    window = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, RUN - SHINGLE)
    least = shingles.join(held, "h").withColumn("least", F.min(F.struct("items", "h")).over(window))
    return whole, least.where("run != 0").select(F.col("least.h").alias("h"), "run").distinct()


def prepared(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document shingles, item shingles), both written, as the searches read them more than once."""
    shingles = written(item_shingles(items), "items")
    return written(document_shingles(documents, shingles), "shingles"), shingles


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold at least `RUN` consecutive words of an item."""
    found, shingles = prepared(documents, items)
    _, runs = queries(shingles)
    candidates = found.select("doc_id", "h").distinct().join(runs, "h").select("doc_id", "run").distinct()
    passages = candidates.join(found.where("run != 0").select("doc_id", "run").distinct(), ["doc_id", "run"])
    return passages.join(shingles.where("run != 0").select("run", "item_id").distinct(), "run").select("doc_id", "item_id").distinct()


def contained(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, shingles, held, containment): documents that hold a `share` or more of an item's shingles, in any order."""
    found, shingles = prepared(documents, items)
    whole, _ = queries(shingles, share)
    own = found.select("doc_id", "h").distinct()
    candidates = own.join(whole, "h").groupBy("doc_id", "item_id").agg(F.max("size").alias("shingles"))
    exact = candidates.join(shingles.select("item_id", "h").distinct(), "item_id").join(own, ["doc_id", "h"])
    held = exact.groupBy("doc_id", "item_id", "shingles").agg(F.count("*").alias("held"))
    return held.where(F.col("held") >= F.ceil(F.col("shingles") * share)).withColumn("containment", F.round(F.col("held") / F.col("shingles"), 6))
