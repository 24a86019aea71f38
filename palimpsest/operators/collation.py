"""Collating a page's words with the text they quote."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import normal
from palimpsest.operators.alignment import bare, one_apart

LEAST = 4
#: Most words of a base text sent to every worker.
MOST_WORDS = 5_000_000


class Base:
    """A base text's words, their folded forms, and the places of each pair of neighbours."""

    def __init__(self, words: list[str]):
        self.words, self.folded = words, [bare(w) for w in words]
        self.pairs: dict[tuple[str, str], list[int]] = {}
        for k, pair in enumerate(zip(self.folded, self.folded[1:])):
            self.pairs.setdefault(pair, []).append(k)

    def alike(self, word: str, k: int) -> bool:
        return word == self.folded[k] or one_apart(word, self.folded[k])


def quoted(own: list[str], guided: list[bool], base: Base, least: int = LEAST) -> list[tuple[int, int]]:
    """(place in the page, place in the base) of the words of every quotation, in page order.

    A quotation is seeded by two equal neighbours and goes on while words are
    alike; of the seeds at a place the one that reaches farthest counts, the
    first of equals, if it spans `least` words.  It is then led back over alike
    words up to the one before that is already `guided`.
    """
    taken = list(guided)
    found: list[tuple[int, int]] = []
    place = 0
    while place + 1 < len(own):
        farthest, seed = 0, -1
        for k in base.pairs.get((own[place], own[place + 1]), ()):
            room = min(len(own) - place, len(base.words) - k)
            span = next((n for n in range(2, room) if not base.alike(own[place + n], k + n)), room)
            if span > farthest:
                farthest, seed = span, k
        if farthest < least:
            place += 1
            continue
        led = 0
        while led < min(place, seed) and not taken[place - led - 1] and base.alike(own[place - led - 1], seed - led - 1):
            led += 1
        for n in range(-led, farthest):
            found.append((place + n, seed + n))
            taken[place + n] = True
        place += farthest
    return found


_BASES: dict[str, Base] = {}


def restored(tokens: DataFrame, base: list[str], key: list[str], least: int = LEAST) -> DataFrame:
    """`tokens`(key, at, form, why, sound, alt array<struct<form,witness>>, was) collated with the words `base`.

    Within a quotation every word has the reason `guide`: an equal one is
    printed in the base's form, a sound one stays and the base's form joins
    `alt`, an unsound one is replaced and saved in `was`.  Other tokens come out
    unchanged; null forms quote nothing.  One page is gathered at a time; the
    base text is a fixed witness, refused beyond `MOST_WORDS` words.
    """
    if len(base) > MOST_WORDS:
        raise ValueError(f"the base text holds more than {MOST_WORDS} words")
    shared, name = tokens.sparkSession.sparkContext.broadcast(base), uuid.uuid4().hex
    pages = tokens.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "form", F.coalesce(F.col("why") == "guide", F.lit(False)).alias("guided")))).alias("words"))
    types = dict(tokens.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in [*key, "at"]) + ", base_form string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _BASES:
            _BASES.clear()
            _BASES[name] = Base(shared.value)
        text = _BASES[name]
        for frame in frames:
            out = []
            for *page, words in zip(*(frame[c] for c in key), frame["words"]):
                words = list(words)
                pairs = quoted([bare(w["form"]) for w in words], [w["guided"] for w in words], text, least)
                out += [(*page, words[i]["at"], text.words[k]) for i, k in pairs]
            yield pd.DataFrame(out, columns=[*key, "at", "base_form"])

    quotes = pages.mapInPandas(run, schema)
    joined = tokens.join(quotes, [*key, "at"], "left")
    inside = F.col("base_form").isNotNull()
    same = normal.bare(F.coalesce("form", F.lit(""))) == normal.bare("base_form")
    other = F.array(F.struct(F.col("base_form").alias("form"), F.lit("guide").alias("witness")))
    kept = inside & ~same & F.col("sound")
    columns = {
        "alt": F.when(kept, F.concat(F.coalesce("alt", F.array().cast(types["alt"])), other)).otherwise(F.col("alt")),
        "was": F.when(inside & ~same & ~F.col("sound"), F.col("form")).otherwise(F.col("was")),
        "form": F.when(inside & ~kept, F.col("base_form")).otherwise(F.col("form")),
        "why": F.when(inside, "guide").otherwise(F.col("why")),
        "mended": F.coalesce(inside & ~same & ~F.col("sound"), F.lit(False)),
    }
    return joined.withColumns(columns).drop("base_form")
