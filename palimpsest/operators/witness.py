"""Deciding each word among several readings, with the reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import normal
from palimpsest.operators import alignment, lexicon
from palimpsest.operators.similarity import stroke_only
from palimpsest.plans.lineage import cut

#: Trust in the instruments, the best first (fixed value).
RANK = ("eye", "layer", "tesseract")


def _rank(c: str):
    out = F.lit(len(RANK))
    for k, name in enumerate(RANK):
        out = F.when(F.col(c) == name, k).otherwise(out)
    return out


def votes(readings: DataFrame) -> DataFrame:
    """V1: (token, bare, weight, readings, form, first) of `readings`(token, n, form, witness).

    Readings group by their bare form; a group weighs its distinct instruments.
    """
    grouped = readings.where("form is not null").withColumn("bare", normal.bare("form")).withColumn("place", F.struct(_rank("witness").alias("r"), F.col("n").alias("n")))
    return grouped.groupBy("token", "bare").agg(F.countDistinct("witness").alias("weight"), F.count("*").alias("readings"), F.min_by("form", "place").alias("form"), F.min("place").alias("first"))


def decisions(readings: DataFrame) -> DataFrame:
    """V2: (token, form, why) of `readings`(token, n, form, witness, attested).

    agree: all of several readings are one form; else among the attested ones,
    or all if none is: seen, the eye's word where the vote differs from it by
    strokes alone; most, a form read at least twice; lex, the only attested
    one; keep, the most trusted of several; doubt, the most trusted of none.
    """
    known = readings.where("form is not null").withColumn("bare", normal.bare("form")).withColumn("place", F.struct(_rank("witness").alias("r"), F.col("n").alias("n")))
    per = Window.partitionBy("token")
    known = known.withColumn("good", F.coalesce("attested", F.lit(False))).withColumn("any_good", F.max("good").over(per))
    pool = known.where("good or not any_good")
    groups = pool.groupBy("token", "bare").agg(F.countDistinct("witness").alias("weight"), F.count("*").alias("size"), F.min_by("form", "place").alias("form"), F.min("place").alias("first"))
    order = Window.partitionBy("token").orderBy(F.desc("weight"), "first")
    top = groups.withColumn("k", F.row_number().over(order)).where("k = 1").select("token", F.col("form").alias("top"), F.col("size").alias("top_size"))
    facts = known.groupBy("token").agg(
        F.count("*").alias("all"), F.countDistinct("bare").alias("forms"), F.min_by("form", "n").alias("first_read"), F.min_by("form", "place").alias("trusted"),
        F.sum(F.col("good").cast("int")).alias("goods"), F.min_by("form", F.when(F.col("good"), F.col("place"))).alias("trusted_good"),
        F.min_by("form", F.when(F.col("witness") == "eye", F.col("n"))).alias("eye"), F.min_by("good", F.when(F.col("witness") == "eye", F.col("n"))).alias("eye_good"), F.sum((F.col("witness") == "eye").cast("int")).alias("eyes"),
    )
    joined = facts.join(top, "token")
    agree = (F.col("forms") == 1) & (F.col("all") > 1)
    seen = (F.col("eyes") > 0) & stroke_only(normal.bare("eye"), normal.bare("top")) & (F.col("eye_good") | (F.col("goods") == 0))
    why = F.when(agree, "agree").when(seen, "seen").when(F.col("top_size") > 1, "most").when(F.col("goods") == 1, "lex").when(F.col("goods") > 1, "keep").otherwise("doubt")
    form = F.when(agree, F.col("first_read")).when(seen, F.col("eye")).when(F.col("top_size") > 1, F.col("top")).when(F.col("goods") >= 1, F.col("trusted_good")).otherwise(F.col("trusted"))
    return joined.select("token", form.alias("form"), why.alias("why"))


def losers(readings: DataFrame, decided: DataFrame) -> DataFrame:
    """V3: (token, form, witness) of the forms that lost, each credited to the instrument that read it first."""
    other = readings.where("form is not null").join(decided.select("token", F.col("form").alias("won")), "token").where(normal.bare("form") != normal.bare("won"))
    return other.groupBy("token", "form").agg(F.min_by("witness", "n").alias("witness"))


def arbitrated(pages: DataFrame, lexicon_words: DataFrame, key: list[str]) -> DataFrame:
    """V4: (key, at, part, n, form, why, opens, alt): one reading of each page from several.

    pages(key, backbone array<string>, by, others array<struct<by, words>>,
    opens array<int>): the readings are aligned with the backbone and decided
    place by place (V2, V3); `part` 1.  Words the backbone lacks stand before
    their place, `part` 0: those of the best-ranked reader, also when it has
    none there, the longest and then the first of equals; `most` if another
    reader inserts the same there, else `lex` if it is sound, else `doubt`.
    A page is aligned at a time; everything else is joined by key and place.
    """
    readers = pages.select(*key, "backbone", F.posexplode("others").alias("r", "o")).select(*key, "backbone", "r", F.col("o.by").alias("by"), F.col("o.words").alias("words"))
    named = alignment.spread(readers, [*key, "r"]).select(*key, "r", "by", "words", alignment.aligned("backbone", "words").alias("p")).select(*key, "r", "by", F.expr("transform(p, x -> struct(x.i as i, x.j as j, get(words, x.j) as word))").alias("p"))
    pairs = named.select(*key, "r", "by", F.posexplode("p").alias("n", "p")).select(*key, "r", "by", "n", "p.*")
    placed = cut(alignment.projected(pairs, [*key, "r", "by"]))
    base = pages.select(*key, F.col("by").alias("witness"), "opens", F.posexplode("backbone").alias("at", "form"))
    own = base.select(*key, "at", F.lit(0).alias("n"), "form", "witness")
    other = placed.where("not inserted").select(*key, "at", (F.col("r") + 1).alias("n"), F.col("word").alias("form"), F.col("by").alias("witness"))
    inserted = placed.where("inserted")
    forms = own.select("form").unionByName(inserted.select(F.col("word").alias("form"))).unionByName(other.select("form")).distinct()
    sound = lexicon.token_quality(forms, "form", "form", lexicon_words).select("form", ((F.col("words") > 0) & ~F.col("suspect")).alias("attested"))
    known = cut(own.unionByName(other).withColumn("token", F.struct(*key, "at")).join(sound, "form", "left").select("token", "n", "form", "witness", F.coalesce("attested", F.lit(False)).alias("attested")))
    decided = cut(decisions(known))
    lost = known.where("form is not null").join(decided.select("token", F.col("form").alias("won")), "token").where(normal.bare("form") != normal.bare("won"))
    alt = lost.groupBy("token", "form").agg(F.min(F.struct("n", "witness")).alias("f")).groupBy("token").agg(F.transform(F.array_sort(F.collect_list(F.struct("f.n", "form", "f.witness"))), lambda a: F.struct(a["form"].alias("form"), a["witness"].alias("witness"))).alias("alt"))
    starts = base.select(F.struct(*key, "at").alias("token"), F.coalesce(F.array_contains("opens", F.col("at")), F.lit(False)).alias("opens"))
    spoken = decided.join(starts, "token").join(alt, "token", "left").select("token.*", F.lit(1).alias("part"), F.lit(0).alias("n"), "form", "why", "opens", "alt")

    runs = inserted.groupBy(*key, "at", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda s: s["word"]).alias("run"))
    grid = runs.select(*key, "at").distinct().join(readers.select(*key, "r", "by"), key).join(runs, [*key, "at", "r"], "left")
    size = F.coalesce(F.size("run"), F.lit(0))
    gathered = grid.groupBy(*key, "at").agg(F.min(F.struct(_rank("by").alias("rank"), (-size).alias("less"), F.col("r"))).alias("best"), F.collect_list(F.struct("r", "run")).alias("all"))
    taken = gathered.select(*key, "at", F.expr("filter(all, x -> x.r = best.r)[0].run").alias("run"), F.expr("flatten(transform(filter(all, x -> x.r != best.r and x.run is not null), x -> x.run))").alias("rest"))
    words = taken.select(*key, "at", F.transform("rest", normal.bare).alias("rest"), F.posexplode("run").alias("n", "form")).join(sound, "form", "left")
    why = F.when(F.array_contains("rest", normal.bare("form")), "most").when(F.col("attested"), "lex").otherwise("doubt")
    added = words.select(*key, "at", F.lit(0).alias("part"), "n", "form", why.alias("why"), F.lit(False).alias("opens"), F.lit(None).cast(alt.schema["alt"].dataType).alias("alt"))
    return spoken.unionByName(added)


def reasons(tokens: DataFrame) -> DataFrame:
    """(why, n, share) of all tokens."""
    counts = tokens.groupBy("why").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 4))
