"""Learned letter confusions and the repair of damaged words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import normal
from palimpsest.functions.tokens import is_damaged, words
from palimpsest.operators import lexicon
from palimpsest.plans.lineage import cut

FLOOR, STRONG, DOMINANCE = 2, 10, 8
#: Reasons of a choice that free repair leaves alone.
SURE = ("guide", "agree", "most", "seen", "lex", "keep", "fix")


def confusions(pairs: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(a, b, n): letter a read for b, from `pairs`(read, true) of one length that differ in one place."""
    places = F.filter(F.zip_with(F.split(F.col("read"), ""), F.split(F.col("true"), ""), lambda x, y: F.struct(x.alias("a"), y.alias("b"))), lambda s: s["a"] != s["b"])
    single = pairs.where(F.length("read") == F.length("true")).select(places.alias("d")).where("size(d) = 1").select(F.get("d", F.lit(0)).alias("p"))
    return single.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= floor)


def variants(words: DataFrame, table: DataFrame, depth: int = 1) -> DataFrame:
    """V6: (word, variant) of `words`(word) with up to `depth` letters replaced by what they may stand for."""
    out = words.select("word", F.col("word").alias("variant")).distinct()
    for _ in range(depth):
        places = out.select("word", "variant", F.posexplode(F.split("variant", "")).alias("i", "a")).where("a != ''")
        made = places.join(table.select("a", "b"), "a").select("word", F.expr("concat(substring(variant, 1, i), b, substring(variant, i + 2))").alias("variant"))
        out = out.unionByName(made).distinct()
    return out.where("variant != word")


def gated(words: DataFrame) -> DataFrame:
    """(word, protected) of `words`; without a column of that name nothing is protected."""
    return words.select("word", "protected" if "protected" in words.columns else F.lit(False).alias("protected")).distinct()


def candidates(words: DataFrame, table: DataFrame, attested_forms: DataFrame, depth: int = 2, strong: DataFrame | None = None) -> DataFrame:
    """V6: (word, protected, variant) of the attested variants of `words`(word[, protected]).

    A protected word is read with the strong table (by default the rows of
    `table` witnessed STRONG times) and one letter replaced, any other with the
    full one and up to `depth`.
    """
    own = gated(words)
    strong = table.where(F.col("n") >= STRONG) if strong is None else strong
    free = variants(own.where("not protected"), table, depth).withColumn("protected", F.lit(False))
    sure = variants(own.where("protected"), strong, 1).withColumn("protected", F.lit(True))
    return lexicon.attested(free.unionByName(sure), attested_forms, "variant").where("attested").select("word", "protected", "variant")


def picked(candidates: DataFrame, frequencies: DataFrame) -> DataFrame:
    """V7: (word, fixed, protected) of `candidates`(word, protected, variant), already attested: the only one, or one that dwarfs the rest."""
    counted = candidates.join(frequencies.select(F.col("word").alias("variant"), "n"), "variant", "left").na.fill(0, ["n"])
    per = Window.partitionBy("word", "protected")
    ranked = counted.withColumn("k", F.row_number().over(per.orderBy(F.desc("n"), "variant"))).withColumn("all", F.count("*").over(per)).withColumn("rest", F.sum("n").over(per) - F.col("n"))
    return ranked.where("k = 1").where((F.col("all") == 1) | (F.col("n") >= DOMINANCE * F.greatest(F.lit(1), F.col("rest")))).select("word", F.col("variant").alias("fixed"), "protected")


def splits(words: DataFrame, seams: DataFrame, attested_forms: DataFrame) -> DataFrame:
    """V8: (word, left, right) where just one cut has both parts attested and seen side by side."""
    cuts = words.where("length(word) >= 4").select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("i")).select("word", F.expr("substring(word, 1, i)").alias("left"), F.expr("substring(word, i + 1)").alias("right"))
    seen = cuts.join(seams.select(F.col("a").alias("left"), F.col("b").alias("right")).distinct(), ["left", "right"], "left_semi")
    sound = lexicon.attested(lexicon.attested(seen, attested_forms, "left").where("attested").drop("attested"), attested_forms, "right").where("attested")
    return sound.groupBy("word").agg(F.count("*").alias("n"), F.min("left").alias("left"), F.min("right").alias("right")).where("n = 1").drop("n")


def page_splits(words: DataFrame, seams: DataFrame, attested_forms: DataFrame, key: list[str]) -> DataFrame:
    """V8 by page: (key, word, fixed) of `words`(key, word) with just one cut into two attested words that `seams`(key, a, b) has side by side."""
    cuts = words.where("length(word) >= 4").distinct().select(*key, "word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("i")).select(*key, "word", F.expr("substring(word, 1, i)").alias("a"), F.expr("substring(word, i + 1)").alias("b"))
    seen = cuts.join(seams, [*key, "a", "b"], "left_semi")
    sound = lexicon.attested(lexicon.attested(seen, attested_forms, "a").where("attested").drop("attested"), attested_forms, "b").where("attested")
    return sound.groupBy(*key, "word").agg(F.count("*").alias("n"), F.min(F.concat_ws(" ", "a", "b")).alias("fixed")).where("n = 1").drop("n")


def mended(tokens: DataFrame, seen: DataFrame, seams: DataFrame, attested_forms: DataFrame, frequencies: DataFrame, table: DataFrame, strong: DataFrame, key: list[str]) -> DataFrame:
    """`tokens`(key, at, form, why, opens, alt, was) after one round of repair, with how, word and fixed.

    Words of the base text and sound ones stay.  A damaged word is closed up if
    `seen`(key, bare), the page's other readings, has it so or it is attested,
    else opened if they have all its parts.  A word of one run of letters is
    then joined with the next, not over a line's opening, if both are unsound
    and one word together is attested; the next is used up, so of several in a
    row every other joins.  Else, from three letters on, it is replaced by the
    one variant that stands out, or, if no reader vouches for it, cut where
    `seams`(key, a, b) has the two parts.  A word is protected, that is read
    with the strong table to depth 1 and never cut, if its reason is sure or
    its page's readers have it.  Windows run within a page.
    """
    forms = tokens.select("form").distinct()
    quality = lexicon.token_quality(forms, "form", "form", attested_forms).select("form", ((F.col("words") > 0) & ~F.col("suspect")).alias("sound"))
    parts = words("form")
    base = tokens.join(quality, "form", "left").withColumn("parts", F.coalesce(parts, F.array().cast("array<string>"))).withColumn("open", ~F.coalesce("sound", F.lit(False)) & (F.coalesce("why", F.lit("")) != "guide"))
    damaged = base.where(F.col("open") & is_damaged("form")).select(*key, "at", "parts", F.array_join("parts", "").alias("shut"))
    readings = seen.select(*key, "bare").distinct().withColumn("held", F.lit(True))
    closing = lexicon.attested(damaged.withColumn("bare", normal.bare("shut")).join(readings, [*key, "bare"], "left").withColumn("folded", normal.fold("shut")), attested_forms, "folded")
    pieces = damaged.select(*key, "at", F.explode("parts").alias("p")).withColumn("bare", normal.bare("p")).join(readings, [*key, "bare"], "left").groupBy(*key, "at").agg(F.min(F.coalesce("held", F.lit(False))).alias("apart"))
    cleaned = closing.join(pieces, [*key, "at"]).select(*key, "at", F.when(F.coalesce("held", F.lit(False)) | F.col("attested"), F.col("shut")).when(F.col("apart"), F.array_join("parts", " ")).alias("clean")).where("clean is not null")
    order = Window.partitionBy(*key).orderBy("at")
    single = F.col("open") & F.col("clean").isNull() & (F.size("parts") == 1)
    lone = cut(base.join(cleaned, [*key, "at"], "left")).withColumn("word", F.when(single, normal.fold(F.get("parts", F.lit(0)))))
    ahead = lone.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("form", "open", "opens", "parts", "alt")), F.row_number().over(order).alias("turn"))
    fits = F.col("word").isNotNull() & (F.length("word") >= 2) & F.col("next_open") & ~F.coalesce("next_opens", F.lit(False)) & (F.size("next_parts") == 1)
    ahead = ahead.withColumn("both", F.when(fits, F.concat("word", normal.fold(F.get("next_parts", F.lit(0))))))
    judged = lexicon.attested(cut(ahead), attested_forms, "both").withColumn("fits", F.col("both").isNotNull() & F.col("attested")).drop("attested")
    island = F.col("turn") - F.row_number().over(Window.partitionBy(*key, "fits").orderBy("at"))
    turned = judged.withColumn("island", island)
    nth = F.row_number().over(Window.partitionBy(*key, "fits", "island").orderBy("at"))
    joined = turned.withColumn("joins", F.col("fits") & (nth % 2 == 1))
    used = joined.withColumn("used", F.coalesce(F.lag("joins").over(order), F.lit(False))).where("not used").withColumn("bare", normal.bare("form")).join(readings, [*key, "bare"], "left")
    gated_ = used.withColumn("protected", F.coalesce(F.col("why").isin(*SURE), F.lit(False)) | F.coalesce("held", F.lit(False)))
    todo = F.when(~F.col("joins") & (F.length("word") >= 3), F.col("word"))
    settled = cut(gated_.withColumn("word", todo))
    asked = settled.where("word is not null").select("word", "protected")
    found = cut(picked(candidates(asked, table, attested_forms, 2, strong), frequencies))
    free = settled.where("word is not null and not protected").join(found, ["word", "protected"], "left_anti")
    opened = page_splits(free.select(*key, "word"), seams, attested_forms, key).select(*key, "word", F.lit(False).alias("protected"), F.col("fixed").alias("opened"))
    done = settled.join(found, ["word", "protected"], "left").join(opened, [*key, "word", "protected"], "left")
    how = F.when(F.col("clean").isNotNull(), "closed").when(F.col("joins"), "joined").when(F.col("fixed").isNotNull(), "replaced").when(F.col("opened").isNotNull(), "split")
    repaired = F.coalesce("fixed", "opened")
    spelled = F.array_join(F.transform(F.split(repaired, " "), lambda w: F.concat(F.left(w, F.length(w) - 1), F.translate(F.right(w, F.lit(1)), normal.MEDIALS, normal.FINALS))), " ")
    form = F.when(how == "closed", F.col("clean")).when(how == "joined", F.concat(F.regexp_replace("form", "[־‐-]+$", ""), F.col("next_form"))).when(how.isNotNull(), F.replace(F.col("form"), F.get("parts", F.lit(0)), spelled)).otherwise(F.col("form"))
    before = F.when(how == "joined", F.concat_ws(" ", "form", "next_form")).when(how.isNotNull(), F.coalesce(F.nullif("was", F.lit("")), F.col("form"))).otherwise(F.col("was"))
    none = F.array().cast(dict(tokens.dtypes)["alt"])
    alt = F.when(how == "joined", F.concat(F.coalesce("alt", none), F.coalesce("next_alt", none))).otherwise(F.col("alt"))
    return done.select(*key, "at", form.alias("form"), F.when(how.isNotNull(), "fix").otherwise(F.col("why")).alias("why"), "opens", alt.alias("alt"), before.alias("was"), how.alias("how"), F.when(how == "replaced", F.col("word")).alias("word"), F.when(how == "replaced", F.col("fixed")).alias("fixed"))


def mended_rounds(tokens: DataFrame, seen: DataFrame, seams: DataFrame, attested_forms: DataFrame, frequencies: DataFrame, misread: DataFrame, key: list[str], rounds: int = 2) -> DataFrame:
    """`mended` up to `rounds` times, with the round and the way of each token's last repair.

    The table is learned from `misread`(read, true) and every replacement made
    so far, the strong one once before any repair; a round without a repair is
    the last.  Each round is cut in the shared folder.
    """
    names = [*key, "at", "form", "why", "opens", "alt", "was"]
    evidence = misread.select("read", "true")
    strong = cut(confusions(evidence, STRONG))
    now = tokens.select(*names, F.lit(None).cast("string").alias("how"), F.lit(0).alias("round"))
    for k in range(1, rounds + 1):
        made = cut(mended(now.select(*names), seen, seams, attested_forms, frequencies, confusions(evidence), strong, key))
        earlier = now.select(*key, "at", F.col("how").alias("_how"), F.col("round").alias("_round"))
        now = made.join(earlier, [*key, "at"]).select(*names, F.coalesce("how", "_how").alias("how"), F.when(F.col("how").isNotNull(), k).otherwise(F.col("_round")).alias("round"))
        if made.where("how is not null").isEmpty():
            break
        evidence = evidence.unionByName(made.where("fixed is not null").select(F.col("word").alias("read"), F.col("fixed").alias("true")))
    return now


def fixed_point(words: DataFrame, table: DataFrame, attested_forms: DataFrame, frequencies: DataFrame, rounds: int = 2, depth: int = 2) -> DataFrame:
    """(word, fixed, round, protected): repairs of `words`(word[, protected]), the table learned anew from each round's repairs.

    The strong table of protected words is learned once.  Lineage is cut each
    round in the shared folder; a round without repairs ends it.
    """
    out = None
    left, learned, strong = gated(words), table, cut(table.where(F.col("n") >= STRONG))
    for k in range(1, rounds + 1):
        found = candidates(left, learned, attested_forms, depth, strong)
        done = cut(picked(found, frequencies).select("word", "fixed", F.lit(k).alias("round"), "protected"))
        if done.isEmpty():
            return out if out is not None else done
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(done, ["word", "protected"], "left_anti"))
        fresh = confusions(done.select(F.col("word").alias("read"), F.col("fixed").alias("true")), 1)
        learned = cut(learned.select("a", "b", "n").unionByName(fresh).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= FLOOR))
    return out
