"""Queries of the editing chain: readings to one text, collation, mending, structure, tracing; line quality; sources read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import normal, tokens
from palimpsest.operators import alignment, collation, lexicon, quotation, repair, similarity, structure, windows, witness
from palimpsest.plans import catalogue, duck
from palimpsest.plans.catalogue import register
from palimpsest.plans.lineage import once
from palimpsest.sources.tables import load

PAGE = ["volume", "page"]


def _in_order(column: str, *order: str):
    """Array of `column` of a group's rows in the order of `order`."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, column))), lambda s: s[column])


# --- four readings to one text


def _reading_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the lines' words as backbone, and the tokens and what tesseract has in their place as other readings."""
    lines = load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null and page is not null and volume is not null")
    split = lines.withColumn("words", F.filter(F.split("text", " "), lambda w: w != "")).where("size(words) > 0")
    layer = split.groupBy(*PAGE).agg(_in_order("words", "line_no", "line_id").alias("l"))
    starts = F.expr("transform(sequence(0, size(l) - 1), i -> aggregate(slice(l, 1, i), 0, (a, x) -> a + size(x)))")
    backbone = layer.select(*PAGE, F.flatten("l").alias("backbone"), F.lit("layer").alias("by"), starts.alias("opens"))
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text", "alt").where("text is not null")
    second = F.expr("coalesce(get(filter(alt, a -> a.witness = 'tesseract' and a.form is not null), 0).form, text)")
    read = base.withColumn("second", second).groupBy(*PAGE).agg(_in_order("text", "pos", "token_id").alias("eye"), _in_order("second", "pos", "token_id").alias("tesseract"))
    reading = lambda name: F.struct(F.lit(name).alias("by"), F.col(name).alias("words"))
    return backbone.join(read, PAGE).select(*PAGE, "backbone", "by", "opens", F.array(reading("eye"), reading("tesseract")).alias("others"))


def _arbitrated(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "arbitrated", lambda: witness.arbitrated(_reading_pages(spark, d), catalogue._lexicon(spark, d), PAGE))


@register()
def ref_V4_arbitrated(spark: SparkSession, d: str) -> DataFrame:
    """One reading of each page from its three, with the reason and the losers of every word."""
    return _arbitrated(spark, d).withColumn("alt", F.array_join(F.transform("alt", lambda a: F.concat_ws("=", a["witness"], a["form"])), " "))


def _base_words(spark: SparkSession, d: str) -> list[str]:
    """The words of the base text's Hebrew chapters in order, a fixed witness, refused beyond the operator's bound."""
    chapters = load(spark, d, "corpus", "witness", "kind", "lang", "part_no", "chapter", "para_no", "text").where("kind = 'ch' and lang = 'he' and text is not null")
    rows = chapters.select("part_no", "chapter", "witness", "para_no", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"), F.monotonically_increasing_id().alias("n"))
    found = rows.orderBy("part_no", "chapter", "witness", "para_no", "n").select("w").limit(collation.MOST_WORDS + 1).collect()
    return [r[0] for r in found]


@register()
def ref_J10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The arbitrated pages collated with the base text they quote."""
    own = _arbitrated(spark, d).withColumn("place", F.struct("at", "part", "n"))
    forms = own.select("form").distinct()
    sound = lexicon.token_quality(forms, "form", "form", catalogue._lexicon(spark, d)).select("form", ((F.col("words") > 0) & ~F.col("suspect")).alias("sound"))
    named = own.join(sound, "form", "left").select(*PAGE, F.col("place").alias("at"), "form", "why", F.coalesce("sound", F.lit(False)).alias("sound"), "alt", F.lit(None).cast("string").alias("was"))
    placed = named.withColumn("at", F.row_number().over(Window.partitionBy(*PAGE).orderBy("at")) - 1)
    out = collation.restored(placed, _base_words(spark, d), PAGE)
    return out.select(*PAGE, "at", "form", "why", "was", F.size(F.coalesce("alt", F.array().cast(dict(placed.dtypes)["alt"]))).alias("rivals"), "mended")


def _mending(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(tokens, seen, seams, lexicon, frequencies, misread) of the repair queries."""
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text", "why", "nl", "alt", "was").where("text is not null and volume is not null and page is not null")
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos", "token_id")) - 1
    own = base.select(*PAGE, at.alias("at"), F.col("text").alias("form"), "why", F.coalesce("nl", F.lit(False)).alias("opens"), "alt", "was")
    lines = load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null")
    read = lines.select(*PAGE, "line_no", "line_id", F.posexplode(F.split("text", " ")).alias("k", "x")).withColumn("bare", normal.bare("x")).where("bare != ''")
    others = own.select(*PAGE, F.explode("alt").alias("a")).where("a.form is not null").select(*PAGE, normal.bare("a.form").alias("bare"))
    seen = read.select(*PAGE, "bare").unionByName(others).distinct()
    beside = tokens.neighbours(read, PAGE, ["line_no", "line_id", "k"], "bare", 1).where("word_1 is not null").select(*PAGE, F.col("bare").alias("a"), F.col("word_1").alias("b")).distinct()
    words = catalogue._lexicon(spark, d)
    return own, seen, beside, words, words, catalogue._misreadings(spark, d)


@register()
def ref_V10_mended(spark: SparkSession, d: str) -> DataFrame:
    """Every token after one round of repair, with the way it was repaired."""
    own, seen, seams, words, frequencies, misread = _mending(spark, d)
    table, strong = repair.confusions(misread), repair.confusions(misread, repair.STRONG)
    return repair.mended(own, seen, seams, words, frequencies, table, strong, PAGE).select(*PAGE, "at", "form", "why", "was", "how")


@register()
def ref_V11_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Every token after two rounds, the second with the table learned from the first."""
    return repair.mended_rounds(*_mending(spark, d), PAGE).select(*PAGE, "at", "form", "why", "was", "how", "round")


@register()
def ref_J18_inverse(spark: SparkSession, d: str) -> DataFrame:
    """The place in the lines of every word of the arbitrated text, by aligning the two again."""
    words = _arbitrated(spark, d).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "part", "n", "form"))), lambda s: s["form"]).alias("words"))
    pages = _reading_pages(spark, d).select(*PAGE, "backbone").join(words, PAGE)
    pairs = alignment.spread(pages, PAGE).select(*PAGE, alignment.aligned("words", "backbone").alias("p")).select(*PAGE, F.explode("p").alias("p"))
    return pairs.where("p.i is not null").select(*PAGE, F.col("p.i").alias("at"), F.col("p.j").alias("place"))


# --- quotations, structure


def _base_chapters(spark: SparkSession, d: str) -> DataFrame:
    chapters = load(spark, d, "corpus", "witness", "kind", "lang", "part_no", "chapter", "para_no", "text").where("kind = 'ch' and lang = 'he' and text is not null")
    return chapters.groupBy("part_no", "chapter").agg(F.array_join(_in_order("text", "witness", "para_no"), "\n").alias("base"))


@register()
def ref_J1_own_chapter(spark: SparkSession, d: str) -> DataFrame:
    """Maximal verbatim runs of every unit with the chapter of the base text it comments on."""
    pairs = catalogue._unit_texts(spark, d).join(_base_chapters(spark, d), ["part_no", "chapter"])
    return pairs.select("unit_id", F.explode(quotation.quotations()("text", "base")).alias("r")).select("unit_id", "r.*")


@register()
def ref_J14_bijection(spark: SparkSession, d: str) -> DataFrame:
    """Runs of passage pairs that overlap on neither side, their edges grown to words."""
    pairs = catalogue._passage_pairs(spark, d).withColumn("own", quotation.quotations()("text_a", "text_b"))
    return catalogue._spans_of_passages(pairs.select("ids_a", "ids_b", quotation.bijection("own", "text_a", "text_b").alias("spans")))


@register()
def ref_J8_seams(spark: SparkSession, d: str) -> DataFrame:
    """Where the text of each unit and its follower parts, by what it quotes of the chapters of both."""
    starts = load(spark, d, "units", "unit_id", "volume", "page", "token_at").distinct()
    follower = starts.select("unit_id", F.lead("unit_id").over(Window.partitionBy("volume").orderBy("page", "token_at", "unit_id")).alias("next_id")).where("next_id is not null").dropDuplicates(["unit_id"])
    texts = catalogue._unit_texts(spark, d).join(_base_chapters(spark, d), ["part_no", "chapter"], "left").select("unit_id", "text", "base")
    after = texts.select(F.col("unit_id").alias("next_id"), F.col("text").alias("next_text"), F.col("base").alias("next_base"))
    both = once(spark, d, "seams", lambda: follower.join(texts, "unit_id").join(after, "next_id").select(F.col("unit_id").alias("unit"), F.concat_ws(" ", "text", "next_text").alias("text"), "base", "next_base"))
    spans = lambda base, side: both.select("unit", F.explode(quotation.quotations()("text", base)).alias("r")).select("unit", F.lit(side).alias("side"), F.col("r.c_start").alias("start_at"), F.col("r.c_end").alias("end_at"))
    words = tokens.spans(both, "unit", "text")
    breaks = words.where(F.col("token").rlike("[.•;♦]$")).select("unit", (F.col("end_at") + 1).alias("cut"), F.lit(False).alias("last"))
    cuts = breaks.unionByName(both.select("unit", F.length("text").cast("long").alias("cut"), F.lit(True).alias("last")))
    heads = words.where(F.col("token").rlike(r"^\d+$")).select("unit", F.col("start_at").alias("at"))
    return structure.seams(cuts, spans("base", "a").unionByName(spans("next_base", "b")), heads)


@register()
def ref_J11_trace(spark: SparkSession, d: str) -> DataFrame:
    """The place among a page's tokens of every word of its lines."""
    return catalogue._page_words(spark, d).select(*PAGE, F.posexplode(structure.traced("layer", "read")).alias("i", "place"))


@register()
def ref_J4_located(spark: SparkSession, d: str) -> DataFrame:
    """Where in the tokens of the volumes each gold passage stands, by anchors with agreeing offsets."""
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text").where("text is not null and volume is not null and page is not null").select("token_id", "volume", "page", "pos", normal.bare("text").alias("w")).where("w != ''")
    pages = base.groupBy(*PAGE).agg(_in_order("w", "pos", "token_id").alias("words")).withColumn("n", F.size("words"))
    lined = windows.running_sum(pages.withColumn("slot", F.floor(F.col("page") / 256)), ["volume"], "slot", ["page"], "n", "upto")
    ahead = pages.select("volume", (F.col("page") - 1).alias("page"), F.slice("words", 1, 2).alias("ahead"))
    joined = lined.join(ahead, PAGE, "left").select("volume", (F.col("upto") - F.col("n")).alias("from_at"), "n", F.concat("words", F.coalesce("ahead", F.array().cast("array<string>"))).alias("words"))
    gram = lambda n: F.expr(f"transform(filter(sequence(0, n - 1), i -> i + {n} <= size(words)), i -> struct(from_at + i as at, {n} as n, array_join(slice(words, i + 1, {n}), ' ') as gram))")
    hay = joined.select("volume", F.explode(F.concat(gram(3), gram(2))).alias("g")).select("volume", "g.*")
    passages = load(spark, d, "gold", "gold_id", "text").where("text is not null").select(F.col("gold_id").alias("passage"), F.filter(F.transform(F.split("text", r"\s+"), normal.bare), lambda w: w != "").alias("words"))
    return alignment.located(passages, hay)


ACCEPT = 0.80


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """(volume, unit_id, page, token_at, part_no, chapter, score): E8 of every place a unit may open at and every chapter it may be.

    1.0 for the printed numeral, 1.6 times the share of the chapter's opening
    trigrams that the place's text holds, 0.30 for a heading, 0.25 for a line's
    start.  Pairs meet over a common trigram or the numeral; of any other pair
    the score is below what is accepted.
    """
    places = load(spark, d, "units", "unit_id", "volume", "page", "token_at", "via", "chapter").distinct().withColumnRenamed("chapter", "numeral")
    texts = catalogue._unit_texts(spark, d).groupBy("unit_id").agg(F.min("text").alias("text"))
    opening = lambda c: tokens.grams(F.substring(normal.letters_only(c), 1, 300), 3)
    held = texts.select("unit_id", F.explode(opening("text")).alias("gram"))
    wanted = _base_chapters(spark, d).select("part_no", "chapter", opening("base").alias("g")).where("size(g) > 0").select("part_no", "chapter", F.size("g").alias("n"), F.explode("g").alias("gram"))
    shares = held.join(wanted, "gram").groupBy("unit_id", "part_no", "chapter").agg((F.count("*") / F.first("n")).alias("share"))
    chapters = _base_chapters(spark, d).select("part_no", "chapter")
    by_number = places.where("via = 'numeral'").select("unit_id", F.col("numeral").alias("chapter")).join(chapters, "chapter").select("unit_id", "part_no", "chapter", F.lit(0.0).alias("share"))
    pairs = shares.unionByName(by_number).groupBy("unit_id", "part_no", "chapter").agg(F.max("share").alias("share"))
    flag = lambda c, w: F.when(c, w).otherwise(0.0)
    score = flag((F.col("via") == "numeral") & (F.col("numeral") == F.col("chapter")), 1.0) + 1.6 * F.col("share") + flag(F.col("via") != "front", 0.30) + flag(F.col("token_at") == 0, 0.25)
    return places.join(pairs, "unit_id").select("volume", "unit_id", "page", "token_at", "part_no", "chapter", F.round(score, 6).alias("score"))


@register()
def ref_E8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Combined score of each place a unit opens at and each chapter it may be, and whether it is accepted."""
    return _scored(spark, d).withColumn("accepted", F.col("score") >= ACCEPT)


@register()
def ref_J6_sparse_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Strictly rising chapters for the places of each volume that earn one, none before the part its anchor opens."""
    scored = _scored(spark, d).withColumn("section", F.col("part_no") * 1000 + F.col("chapter"))
    anchors = load(spark, d, "units", "volume", "part_no", "page", "token_at").where("part_no is not null").groupBy("volume", "part_no").agg(F.min(F.struct("page", "token_at")).alias("anchor"))

    def run(key: tuple, places: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
        table = places.pivot_table(index=["page", "token_at", "unit_id"], columns="section", values="score", fill_value=0.0).sort_index()
        sections = table.columns.tolist()
        parts = sorted((a["page"], a["token_at"], p) for a, p in zip(opened["anchor"], opened["part_no"]))
        bounds, reached, at = [], 0, 0
        for page, token_at, _ in table.index:
            while at < len(parts) and parts[at][:2] <= (page, token_at):
                reached = max(reached, next((n for n, s in enumerate(sections) if s >= parts[at][2] * 1000), len(sections)))
                at += 1
            bounds.append(reached)
        pairs = alignment.sparse_assignment(table.values.tolist(), ACCEPT, bounds)
        return pd.DataFrame([(key[0], table.index[i][2], sections[j], float(table.values[i][j])) for i, j in pairs], columns=["volume", "unit_id", "section", "score"])

    return scored.groupBy("volume").cogroup(anchors.groupBy("volume")).applyInPandas(run, "volume string, unit_id string, section int, score double")


@register(f"""WITH t AS (SELECT token_id, text, lag(text) OVER (PARTITION BY volume, page ORDER BY pos, token_id) AS before FROM tokens WHERE text IS NOT NULL),
n AS (SELECT token_id, text, before, substr(text, 1, length(text) - 1) AS w FROM t WHERE regexp_matches(text, '^[א-ת]+\\.$')),
v AS (SELECT *, list_transform(string_split(w, ''), lambda c: CASE WHEN strpos('אבגדהוזחט', c) > 0 THEN strpos('אבגדהוזחט', c) WHEN strpos('יכלמנסעפצ', c) > 0 THEN 10 * strpos('יכלמנסעפצ', c) WHEN strpos('קרשת', c) > 0 THEN 100 * strpos('קרשת', c) ELSE 0 END) AS xs FROM n)
SELECT token_id, text, list_sum(xs)::INT AS numeral FROM v
WHERE NOT list_contains(xs, 0) AND (list_reverse_sort(xs) = xs OR w IN ('טו', 'טז')) AND list_sum(xs) BETWEEN 1 AND 76 AND (before IS NULL OR regexp_matches(before, '[.!?׃]$'))""")
def ref_P9_strict_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Numerals of 1 to 76 that open a sentence, with their value."""
    before = F.lag("text").over(Window.partitionBy("volume", "page").orderBy("pos", "token_id"))
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text").where("text is not null").withColumn("before", before)
    valued = base.where(F.col("text").rlike(r"^[א-ת]+\.$")).withColumn("word", F.expr("substring(text, 1, length(text) - 1)")).withColumn("numeral", normal.gematria("word"))
    return valued.where("numeral between 1 and 76").where(F.col("before").isNull() | F.col("before").rlike("[.!?׃]$")).select("token_id", "text", "numeral")


@register("SELECT line_id, CASE WHEN p > 0 THEN substr(text, 1, p - 1) ELSE '' END AS label, CASE WHEN p > 0 THEN substr(text, p + 3) ELSE text END AS tail FROM (SELECT line_id, text, strpos(text, ' — ') AS p FROM page_lines WHERE text IS NOT NULL)")
def ref_P11_label_split(spark: SparkSession, d: str) -> DataFrame:
    """Lines split at their first dash."""
    base = load(spark, d, "page_lines", "line_id", "text").where("text is not null").withColumn("p", F.locate(" — ", F.col("text")))
    return base.select("line_id", F.expr("if(p > 0, substring(text, 1, p - 1), '')").alias("label"), F.expr("if(p > 0, substring(text, p + 3), text)").alias("tail"))


@register()
def ref_P11_front_split(spark: SparkSession, d: str) -> DataFrame:
    """Front units split at their first dash if what stands behind it quotes the base text of their part."""
    front = load(spark, d, "units", "unit_id", "part_no", "via").where("via = 'front'").distinct()
    texts = catalogue._unit_texts(spark, d).join(front.select("unit_id"), "unit_id", "left_semi")
    parts = _base_chapters(spark, d).groupBy("part_no").agg(F.array_join(_in_order("base", "chapter"), "\n").alias("base"))
    cut = texts.join(parts, "part_no", "left").withColumn("p", F.locate(" — ", F.col("text"))).withColumn("tail", F.expr("if(p > 0, substring(text, p + 3), text)"))
    taken = (F.col("p") > 0) & (F.size(quotation.quotations()("tail", "base")) > 0)
    return cut.select("unit_id", F.when(taken, F.expr("substring(text, 1, p - 1)")).otherwise("").alias("label"), F.when(taken, F.col("tail")).otherwise(F.col("text")).alias("tail"))


# --- line quality


def _line_readings(spark: SparkSession, d: str) -> DataFrame:
    """(line_id, line, tokens): each line's words, and the words of the tokens between its place and the next line's on the page."""
    pairs = catalogue._aligned(spark, d)
    lines = load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null")
    placed = lines.select("line_id", *PAGE, "line_no", F.posexplode(F.split("text", " ")).alias("k", "x"))
    j = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line_no", "line_id", "k")) - 1
    words = placed.select("line_id", *PAGE, j.alias("j"))
    own = pairs.join(words, [*PAGE, "j"], "left").withColumn("line_id", F.coalesce("line_id", F.last("line_id", ignorenulls=True).over(Window.partitionBy(*PAGE).orderBy("n"))))
    texts = own.where("own is not null and line_id is not null").groupBy("line_id").agg(_in_order("own", "n").alias("tokens"))
    return lines.select("line_id", F.split("text", " ").alias("line")).join(texts, "line_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


@register()
def ref_E6_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Sequence ratio of each line's words and the tokens read in its place."""
    return _line_readings(spark, d).select("line_id", F.round(similarity.sequence_ratio("line", "tokens"), 2).alias("agreement"))


@register()
def ref_P7_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose readings agree by less than 0.80, or of whose tokens less than 65 of a hundred are sound."""
    read = _line_readings(spark, d)
    forms = read.select(F.explode("tokens").alias("form")).distinct()
    good = lexicon.token_quality(forms, "form", "form", catalogue._lexicon(spark, d)).select("form", ((F.col("words") > 0) & ~F.col("suspect")).alias("sound"))
    sound = read.select("line_id", F.explode("tokens").alias("form")).join(good, "form", "left").groupBy("line_id").agg(F.round(100 * F.avg(F.coalesce("sound", F.lit(False)).cast("int")), 1).alias("conf"))
    scored = read.select("line_id", F.round(similarity.sequence_ratio("line", "tokens"), 2).alias("agreement")).join(sound, "line_id", "left").withColumn("conf", F.coalesce("conf", F.lit(0.0)))
    return scored.withColumn("flag", (F.col("conf") < 65.0) | (F.col("agreement") < 0.80))


# --- reports


_BROKEN = f"""WITH {duck.LEX}, t AS (SELECT token_id, volume, page, pos, text, why, {duck.words('text')} AS ws FROM tokens WHERE text IS NOT NULL)
SELECT volume, page, count(*) AS broken, string_agg(text, ' ' ORDER BY pos, token_id) AS words FROM t WHERE len(ws) > 1 AND NOT regexp_matches(text, '[־‐‑‒–—-]') GROUP BY volume, page"""


@register(_BROKEN)
def ref_K8_broken_words(spark: SparkSession, d: str) -> DataFrame:
    """The report of broken words, page by page."""
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text").where("text is not null").where(tokens.is_damaged("text"))
    return base.groupBy(*PAGE).agg(F.count("*").alias("broken"), F.array_join(_in_order("text", "pos", "token_id"), " ").alias("words"))


@register("SELECT t.volume, t.why, count(*) AS tokens, count_if(len(t.alt) > 0) AS rivals, count_if(t.was <> '') AS altered, min(t.token_id) AS first_id FROM tokens t WHERE t.why IN ('doubt', 'keep', 'fix') GROUP BY ALL")
def ref_K8_failures(spark: SparkSession, d: str) -> DataFrame:
    """The report of words not settled, by volume and reason."""
    base = load(spark, d, "tokens", "token_id", "volume", "why", "alt", "was").where(F.col("why").isin("doubt", "keep", "fix"))
    return base.groupBy("volume", "why").agg(F.count("*").alias("tokens"), F.count_if(F.size("alt") > 0).alias("rivals"), F.count_if(F.col("was") != "").alias("altered"), F.min("token_id").alias("first_id"))
