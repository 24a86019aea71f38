"""The pN_ queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import canonical, leaks, mixing, mojibake, quality, scans, sentences, spans, termcounts, vocabulary
from palimpsest.plans.lineage import scratch, written
from palimpsest.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def clean_words(spark: SparkSession, d: str) -> list[tuple[str, str, int]]:
    return vocabulary.bounded(vocabulary.words_with_counts(load(spark, d, "corpus", "lang", "text"), load(spark, d, "common_words", "lang", "word")))


def _repaired_gold(spark: SparkSession, d: str) -> DataFrame:
    fields = mojibake.gold_fields(load(spark, d, "gold", "gold_id", "text", "lemma"))
    return mojibake.repair_fields(fields, [w for _, w, _ in clean_words(spark, d)])


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Gold fields that hold a garbled stretch."""
    return _repaired_gold(spark, d).where("garbled").select("gold_id", "field", "elem")


@query
def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled gold field with its restored text."""
    return _repaired_gold(spark, d).where("garbled").select("gold_id", "field", "elem", "text", "repaired")


def _canonical(spark: SparkSession, d: str, garbled: bool) -> DataFrame:
    """Canonical values; `garbled`: whether the gold texts p1 calls garbled are among them, as it restored them."""
    gold = load(spark, d, "gold", "gold_id", "text")
    words = [w for _, w, _ in clean_words(spark, d)]
    read = mojibake.repair_fields(gold, words)
    own = read.select("gold_id", F.when(F.col("garbled"), F.col("repaired")).otherwise(F.col("text")).alias("text")) if garbled else read.where("not garbled").select("gold_id", "text")
    tables = {"gold": own, "tokens": load(spark, d, "tokens", "token_id", "text"), "addenda_munich": load(spark, d, "addenda_munich", "addenda_id", "text")}
    return canonical.normalise(canonical.long_form(tables), "text", ["tbl", "row_id", "elem"])


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Values with a disguised character."""
    return _canonical(spark, d, False).where("disguised").select("tbl", "row_id", "elem")


@query
def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every value in its one consistent form."""
    return _canonical(spark, d, True).select("tbl", "row_id", "elem", "canonical", "disguised")


#: A term is common above these shares of a field's records, rare below this many records.
COMMON, RARE = {"tokens": 1 / 200, "page_lines": 1 / 20}, 3


def _counted(spark: SparkSession, d: str) -> termcounts.CountStore:
    """The store after three batches: what was read in time, with the readings tokens first had; the late rest; the corrections.

    A correction is a changed record: its old version (`was`) removed, its new one added.
    """
    store = termcounts.CountStore(spark, scratch(spark, "terms"))
    tokens, lines = load(spark, d, "tokens", "text", "was", "read_at"), load(spark, d, "page_lines", "text", "read_at")
    late = F.coalesce(F.col("read_at") >= F.to_timestamp(F.lit("2024-01-16 00:00:00")), F.lit(True))
    mended = ~late & F.col("was").isNotNull() & F.col("text").isNotNull()
    first = tokens.where(~late).withColumn("text", F.when(mended, F.col("was")).otherwise(F.col("text")))
    store.apply(termcounts.batches([("tokens", first, termcounts.whole()), ("page_lines", lines.where(~late), termcounts.pieces())]))
    store.apply(termcounts.batches([("tokens", tokens.where(late), termcounts.whole()), ("page_lines", lines.where(late), termcounts.pieces())]))
    changed = tokens.where(mended)
    removed = termcounts.batches([("tokens", changed.select(F.col("was").alias("text")), termcounts.whole())], -1)
    store.apply(removed.unionByName(termcounts.batches([("tokens", changed, termcounts.whole())])))
    return store


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms marked common or rare."""
    return _counted(spark, d).marks(COMMON, RARE).where("mark is not null").select("field", "term", "mark")


@query
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, records and mark of every term."""
    return _counted(spark, d).marks(COMMON, RARE)


_P5 = """
WITH terms AS (
  SELECT 'tokens' AS field, token_id AS id, text AS term FROM tokens WHERE text IS NOT NULL
  UNION ALL
  SELECT 'page_lines', line_id, term FROM (SELECT line_id, unnest(string_split(text, ' ')) AS term FROM page_lines WHERE text IS NOT NULL) WHERE term <> ''),
totals AS (
  SELECT 'tokens' AS field, count(text) / 200.0 AS bound FROM tokens UNION ALL SELECT 'page_lines', count(text) / 20.0 FROM page_lines),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM terms GROUP BY ALL),
marked AS (SELECT field, term, occurrences, records, CASE WHEN records > bound THEN 'common' WHEN records < 3 THEN 'rare' END AS mark FROM counts JOIN totals USING (field))
"""
ORACLES["p5_found"] = _P5 + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL"
ORACLES["p5_counts"] = _P5 + "SELECT field, term, occurrences, records, mark FROM marked"


def _span_values(spark: SparkSession, d: str) -> DataFrame:
    """(rec, owner, key, text) of the sound gold fields and all page lines; written once, as several stages read it."""
    gold = load(spark, d, "gold", "gold_id", "volume", "page", "work", "passage_no", "text", "lemma")
    words = [w for _, w, _ in clean_words(spark, d)]
    sound = mojibake.repair_fields(mojibake.gold_fields(gold), words).where("not garbled").select("gold_id", "text")
    owner = lambda tbl, *cols: F.concat_ws("\x1f", F.lit(tbl), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols))
    named = gold.select("gold_id", owner("gold", "volume", "page", "work", "passage_no").alias("owner"))
    passages = sound.join(named, "gold_id").select(F.concat(F.lit("gold:"), "gold_id").alias("rec"), "owner", "text")
    lines = load(spark, d, "page_lines", "line_id", "volume", "page", "line_no", "text").where("text is not null")
    rows = lines.select(F.concat(F.lit("page_lines:"), "line_id").alias("rec"), owner("page_lines", "volume", "page", "line_no").alias("owner"), "text")
    return written(passages.unionByName(rows).withColumn("key", F.md5("text")), "spans")


def _texts(values: DataFrame) -> DataFrame:
    """(id, key, text, old) of the distinct texts long enough to share a span; written, so the short ids stay."""
    distinct = values.where(F.length("text") >= spans.SPAN).groupBy("key").agg(F.first("text").alias("text"), F.max(F.col("rec").startswith("gold:")).alias("old"))
    return written(distinct.withColumn("id", F.monotonically_increasing_id()), "texts")


def _matches(spark: SparkSession, texts: DataFrame) -> spans.Matches:
    """What the texts have in common: gold is history, page lines the new batch."""
    index = spans.FingerprintIndex(spark, scratch(spark, "index"))
    short = texts.select(F.col("id").alias("key"), "text", "old")
    found = index.append(short.where("old")) + index.append(short.where("not old"))
    index.drop()  # a standing index would be kept
    return found


def _with_ids(values: DataFrame, texts: DataFrame) -> DataFrame:
    """`values` with the texts' short ids for keys."""
    return values.join(texts.select("key", "id"), "key", "left").drop("key").withColumnRenamed("id", "key")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that share a span of at least 50 code points."""
    values = _span_values(spark, d)
    texts = _texts(values)
    pairs = spans.verified(_matches(spark, texts), texts.select(F.col("id").alias("key"), "text"))
    return spans.record_pairs(_with_ids(values.where(F.length("text") >= spans.SPAN), texts), pairs)


@query
def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """For each record, how much of its text also stands elsewhere."""
    values = _span_values(spark, d)
    texts = _texts(values)
    short = _with_ids(values, texts)
    return spans.shares(short, spans.sharing_keys(short.where("key is not null"), _matches(spark, texts)))


@query
def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every maximal stretch of a record that stands elsewhere, with the representative of its class: membership instead of pairs."""
    values = _span_values(spark, d)
    texts = _texts(values)
    short = _with_ids(values.where(F.length("text") >= spans.SPAN), texts)
    return spans.classes(short, spans.sharing_keys(short, _matches(spark, texts)))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "eval_items", "item_id", "text"))


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an evaluation item."""
    return _leaks(spark, d)


@query
def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents it leaked into."""
    counts = _leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = load(spark, d, "eval_items", "item_id", "lang")
    return items.join(counts, "item_id", "left").select("item_id", "lang", F.coalesce("documents", F.lit(0)).alias("documents"))


@query
def p7_contained(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold four fifths or more of an item's shingles, with the exact share held."""
    return leaks.contained(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "eval_items", "item_id", "text"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    targets = load(spark, d, "mix_targets", "source", "target_share", "max_repeats")
    docs = load(spark, d, "documents", "doc_id", "source", "text").join(targets.select("source"), "source", "left_semi")
    sized = docs.select("doc_id", "source", mixing.count_tokens(spark)("text").alias("tokens"))
    return mixing.mixture(written(sized, "sized"), targets)


@query
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The chosen document copies in their queue order."""
    return _mixture(spark, d)


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixing.shares(_mixture(spark, d), load(spark, d, "mix_targets", "source", "target_share", "max_repeats"))


def _function_words(spark: SparkSession, d: str) -> list[str]:
    common = [r[0] for r in load(spark, d, "common_words", "word").where("word is not null").distinct().limit(10_001).collect()]
    if len(common) > 10_000:
        raise ValueError("function word lists are short; this one holds more than 10,000 words")
    return common


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return quality.verdicts(load(spark, d, "documents", "doc_id", "text"), load(spark, d, "doc_labels", "doc_id", "label"), _function_words(spark, d))


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are for more than half no running text."""
    return _verdicts(spark, d).where("verdict != 'prose'").select("doc_id", F.col("verdict").alias("kind"))


@query
def p9_figures(spark: SparkSession, d: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    return _verdicts(spark, d)


def _scan_noise(spark: SparkSession, d: str) -> DataFrame:
    corpus = load(spark, d, "corpus", "lang", "text")
    tokens = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text", "nl")
    lines = load(spark, d, "page_lines", "line_id", "volume", "page", "line_no", "zone", "text")
    addenda = load(spark, d, "addenda_munich", "addenda_id", "text")
    words = [(w, n) for _, w, n in clean_words(spark, d)]
    return scans.scan_noise(tokens, lines, addenda, words, scans.corpus_pairs(corpus), spark)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every text value with each kind of noise in it."""
    return _scan_noise(spark, d).select("tbl", "elem", F.explode("noise").alias("x")).select("tbl", "x.row_id", "elem", "x.kind")


@query
def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    """Reflowed text of every page and every addenda paragraph, without furniture, breaks and misreadings; a word broken over two pages stands whole on the second."""
    path = scratch(spark, "pages")
    _scan_noise(spark, d).drop("noise").write.parquet(path)
    return scans.joined_pages(spark.read.parquet(path)).select("tbl", "volume", "page", "unit", "elem", "text")


def _sentence_words(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    words = [(r[0], r[1]) for r in load(spark, d, "common_words", "lang", "word").where("word is not null").limit(10_001).collect()]
    if len(words) > 10_000:
        raise ValueError("function word lists are short; this one holds more than 10,000 words")
    return words


def _sentence_lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_lines", "line_id", "volume", "page", "line_no", "zone", "text")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence end."""
    return sentences.sentence_ends(load(spark, d, "addenda_munich", "addenda_id", "text"), _sentence_lines(spark, d), _sentence_words(spark, d))


@query
def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units from one end to the next: of every addenda paragraph, and of the page lines over lines and pages (row_id: the line a unit opens in)."""
    words = _sentence_words(spark, d)
    cut = sentences.sentence_ends(load(spark, d, "addenda_munich", "addenda_id", "text"), None, words).groupBy("row_id", "elem").agg(F.array_sort(F.collect_set("end_at")).alias("e"))
    texts = load(spark, d, "addenda_munich", "addenda_id", "text").select(F.col("addenda_id").alias("row_id"), F.posexplode("text").alias("elem", "text")).where("text is not null")
    spans_ = F.expr("transform(e, (x, i) -> trim(both ' \\n' from substring(text, if(i = 0, 0, e[i - 1]) + 1, x - if(i = 0, 0, e[i - 1]))))")
    paragraphs = texts.join(cut, ["row_id", "elem"]).select("row_id", "elem", F.posexplode(spans_).alias("sentence_no", "sentence"))
    path = scratch(spark, "pieces")
    sentences.line_pieces(_sentence_lines(spark, d), words).write.parquet(path)
    lines = sentences.line_sentences(spark.read.parquet(path))
    none = lambda kind: F.lit(None).cast(kind)
    own = paragraphs.select(F.lit("addenda_munich").alias("tbl"), none("string").alias("volume"), none("int").alias("page"), none("string").alias("zone"), "row_id", "elem", F.col("sentence_no").cast("long").alias("sentence_no"), "sentence")
    return own.unionByName(lines.select(F.lit("page_lines").alias("tbl"), "volume", "page", "zone", "row_id", F.lit(0).alias("elem"), "sentence_no", "sentence"))


@query
def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The reported figures of every document, without the verdict."""
    return quality.with_measures(load(spark, d, "documents", "doc_id", "text"), _function_words(spark, d)).select("doc_id", *quality.FIGURES)


ORACLES["p9_statistics"] = r"""
WITH c AS (SELECT DISTINCT word FROM common_words WHERE word IS NOT NULL),
b AS (SELECT doc_id, text, greatest(length(text), 1) AS n,
  list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
h AS (SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(w) AS x FROM b) WHERE lower(x) IN (SELECT word FROM c) GROUP BY doc_id)
SELECT doc_id, len(w)::DOUBLE AS words,
  CASE WHEN text IS NOT NULL THEN round(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1), 6) END AS mean_word_length,
  round(length(regexp_replace(text, '[\p{L}\p{M}\p{N}\s]', '', 'g')) / n, 6) AS symbol_ratio,
  round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…׃。！？؟۔።:;]["''”“’»)\]]*\s*$'))) / greatest(len(l), 1), 6) AS punctuated_lines,
  CASE WHEN text IS NOT NULL THEN round(coalesce(hits, 0) / greatest(len(w), 1), 6) END AS common_words
FROM b LEFT JOIN h USING (doc_id)"""
