"""The registered queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import legacy, normal, tokens
from palimpsest.operators import alignment, lexicon, quotation, repair, search, similarity, spans, structure, windows, witness
from palimpsest.plans import duck
from palimpsest.sources import sinks, transcript
from palimpsest.plans.lineage import once, scratch, written
from palimpsest.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "ref_E4_nearest"


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scalar functions over whole tables: name → (table, key, column, DuckDB expression)

_MARKS = "[׳״''\"’”]"
#: What stands in brackets, in either orientation of the pair.
BRACKETED = r"[(\[][^()\[\]]*[)\]]|[)\]][^()\[\]]*[(\[]"
_UNTAGGED = "regexp_replace(text, '<[^>]*>', ' ', 'g')"
_UNBRACKETED = f"regexp_replace(text, '{BRACKETED}', ' ', 'g')"
SCALARS: dict[str, tuple[str, str, Callable[[], Column], str]] = {
    "ref_N1_fold": ("tokens", "token_id", lambda: normal.fold("text"), duck.fold("text")),
    "ref_N2_points": ("tokens", "token_id", lambda: normal.strip_points("text"), duck.points("text")),
    "ref_N3_letters": ("page_lines", "line_id", lambda: normal.letters_only("text"), duck.letters("text")),
    "ref_N4_bare": ("tokens", "token_id", lambda: normal.bare("text"), duck.bare("text")),
    "ref_N6_markup": ("documents", "doc_id", lambda: normal.without_markup("text"), "trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"),
    "ref_N7_tidy": ("tokens", "token_id", lambda: normal.tidy("text"), "trim(regexp_replace(regexp_replace(text, '[*|\\\\_^~•]', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' .,:;-·')"),
    "ref_N8_escape": ("documents", "doc_id", lambda: normal.escaped("text"), "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"),
    "ref_N9_searchable": ("page_lines", "line_id", lambda: normal.searchable("text"), f"translate(regexp_replace({duck.points(_UNTAGGED)}, '{_MARKS}', '', 'g'), 'ךםןףץ', 'כמנפצ')"),
    "ref_N10_logical": ("page_lines", "line_id", lambda: normal.logical_order("text"), "array_to_string(list_transform(regexp_extract_all(translate(reverse(regexp_replace(text, '[\\x{200E}\\x{200F}\\x{202A}-\\x{202E}]', '', 'g')), '()[]{}<>', ')(][}{><'), '[0-9A-Za-z]+(?:[.,:/-][0-9A-Za-z]+)*|[^0-9A-Za-z]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9A-Za-z]') THEN reverse(p) ELSE p END), '')"),
    "ref_N12_numeral": ("page_lines", "line_id", lambda: normal.numeral("page"), "CASE WHEN page = 15 THEN 'טו' WHEN page = 16 THEN 'טז' WHEN page BETWEEN 1 AND 99 THEN (CASE WHEN page >= 10 THEN substr('יכלמנסעפצ', page // 10, 1) ELSE '' END) || (CASE WHEN page % 10 > 0 THEN substr('אבגדהוזחט', page % 10, 1) ELSE '' END) END"),
    "ref_N16_script_runs": ("page_lines", "line_id", lambda: F.array_join(normal.script_runs("text"), "¦"), "array_to_string(regexp_extract_all(text, '[א-ת][^A-Za-z\\x{C0}-\\x{24F}]*|[A-Za-z\\x{C0}-\\x{24F}][^א-ת]*'), '¦')"),
    "ref_T2_words": ("page_lines", "line_id", lambda: F.array_join(tokens.words("text"), " "), f"array_to_string({duck.words('text')}, ' ')"),
    "ref_T3_damaged": ("tokens", "token_id", lambda: tokens.is_damaged("text"), f"len({duck.words('text')}) > 1 AND NOT regexp_matches(text, '[־‐‑‒–—-]')"),
    "ref_T7_comparable": ("page_lines", "line_id", lambda: F.array_join(F.transform(tokens.words(F.regexp_replace("text", BRACKETED, " ")), normal.fold), " "), f"array_to_string(list_transform({duck.words(_UNBRACKETED)}, lambda z: {duck.fold('z')}), ' ')"),
    "ref_P4_wedged": ("tokens", "token_id", lambda: F.col("text").rlike(r"[א-ת][\\|^_~*•.:;!?][א-ת]"), "regexp_matches(text, '[א-ת][\\\\|^_~*•.:;!?][א-ת]')"),
}


def _scalar(table: str, key: str, column: Callable[[], Column]) -> Query:
    return lambda spark, d: load(spark, d, table).where("text is not null").select(key, column().alias("value"))


for _name, (_table, _key, _column, _sql) in SCALARS.items():
    QUERIES[_name] = _scalar(_table, _key, _column)
    ORACLES[_name] = f"SELECT {_key}, {_sql} AS value FROM {_table} WHERE text IS NOT NULL"


@register("SELECT line_id, value, offsets FROM (SELECT line_id, translate(array_to_string(list_transform(k, lambda i: substr(text, i + 1, 1)), ''), 'ךםןףץ', 'כמנפצ') AS value, array_to_string(k, ' ') AS offsets FROM (SELECT line_id, text, list_filter(generate_series(0, length(text) - 1), lambda i: regexp_matches(substr(text, i + 1, 1), '[א-ת]')) AS k FROM page_lines WHERE text IS NOT NULL))")
def ref_N5_reduced(spark: SparkSession, d: str) -> DataFrame:
    """Letters of each line and where they came from."""
    base = load(spark, d, "page_lines", "line_id", "text").where("text is not null").select("line_id", normal.reduced("text").alias("r"))
    return base.select("line_id", F.col("r.letters").alias("value"), F.array_join(F.transform("r.offsets", lambda i: i.cast("string")), " ").alias("offsets"))


@register(f"SELECT token_id, CASE WHEN regexp_matches({duck.letters('text')}, '^(?:[ק]*[צ]?[א-ת]*)$') THEN v END AS value FROM (SELECT token_id, text, CASE WHEN regexp_matches(text, '^[אבגדהוזחטיכלמנסעפצקךםןףץ]+$') AND list_reverse_sort(l) = l THEN list_sum(l) END AS v FROM (SELECT token_id, text, list_transform(string_split(text, ''), lambda c: CASE WHEN c = 'ק' THEN 100 WHEN strpos('יכלמנסעפצ', translate(c, 'ךםןףץ', 'כמנפצ')) > 0 THEN 10 * strpos('יכלמנסעפצ', translate(c, 'ךםןףץ', 'כמנפצ')) ELSE strpos('אבגדהוזחט', c) END) AS l FROM tokens WHERE text IS NOT NULL))")
def ref_N13_gematria(spark: SparkSession, d: str) -> DataFrame:
    """Value of each token that is a canonical numeral."""
    return load(spark, d, "tokens", "token_id", "text").where("text is not null").select("token_id", normal.gematria("text").alias("value"))


@register("SELECT addenda_id, elem, array_to_string(list_filter(list_transform(string_split(regexp_replace(t, '[\\x{200E}\\x{200F}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS value FROM (SELECT addenda_id, unnest(text) AS t, generate_subscripts(text, 1) - 1 AS elem FROM addenda_munich) WHERE t IS NOT NULL")
def ref_N11_clean_page(spark: SparkSession, d: str) -> DataFrame:
    """Addenda paragraphs without direction controls and empty lines."""
    rows = load(spark, d, "addenda_munich", "addenda_id", "text").select("addenda_id", F.posexplode("text").alias("elem", "t"))
    return rows.where("t is not null").select("addenda_id", "elem", normal.clean_page("t").alias("value"))


@register()
def ref_N14_legacy(spark: SparkSession, d: str) -> DataFrame:
    """Gold passages re-read through the better code page."""
    return load(spark, d, "gold", "gold_id", "text").select("gold_id", legacy.legacy_hebrew("text").alias("value"))


@register(f"WITH {duck.LEX}, w AS (SELECT line_id, unnest(regexp_extract_all(text, '[א-ת]+')) AS x FROM page_lines WHERE text IS NOT NULL) SELECT line_id, sum(CASE WHEN {duck.letters('x')} IN (SELECT word FROM lex) THEN length(x) ELSE 0 END)::BIGINT AS forward, sum(CASE WHEN reverse({duck.letters('x')}) IN (SELECT word FROM lex) THEN length(x) ELSE 0 END)::BIGINT AS backward FROM w GROUP BY line_id")
def ref_N15_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Attested letters of each line read forward and backward."""
    lex = tokens.lexicon(load(spark, d, "corpus", "text").where("text is not null"), "text").select("word")
    w = load(spark, d, "page_lines", "line_id", "text").where("text is not null").select("line_id", F.explode(F.regexp_extract_all("text", F.lit("[א-ת]+"), F.lit(0))).alias("x"))
    both = w.select("line_id", F.length("x").alias("n"), F.explode(F.map_from_arrays(F.array(F.lit("f"), F.lit("b")), F.array(normal.letters_only("x"), F.reverse(normal.letters_only("x"))))).alias("way", "word"))
    hit = both.join(lex.withColumn("hit", F.lit(1)), "word", "left")
    part = lambda way: F.sum(F.when((F.col("way") == way) & F.col("hit").isNotNull(), F.col("n")).otherwise(0))
    return hit.groupBy("line_id").agg(part("f").alias("forward"), part("b").alias("backward"))


@register("SELECT c, n, slot FROM (SELECT c, n, row_number() OVER (ORDER BY n DESC, c) AS slot FROM (SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM gold WHERE text IS NOT NULL) WHERE c <> '' AND unicode(c) > 127 GROUP BY c)) WHERE slot <= 96")
def ref_N17_alphabet(spark: SparkSession, d: str) -> DataFrame:
    """The 96 most frequent non-ASCII characters and the slot each is folded to."""
    chars = load(spark, d, "gold", "text").where("text is not null").select(F.explode(F.split("text", "")).alias("c")).where("c != '' and ascii(c) > 127")
    counts = chars.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c").limit(96)
    return counts.withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "c")))


@register("SELECT token_id, substr(w, 1, length(w) - 1) || translate(substr(w, length(w), 1), 'כמנפצ', 'ךםןףץ') AS value FROM (SELECT token_id, " + duck.bare("text") + " AS w FROM tokens WHERE text IS NOT NULL) WHERE w <> ''")
def ref_N18_spelled(spark: SparkSession, d: str) -> DataFrame:
    """Bare words with their final letter restored."""
    base = load(spark, d, "tokens", "token_id", "text").where("text is not null").select("token_id", normal.bare("text").alias("word")).where("word != ''")
    return base.select("token_id", normal.spelled("word").alias("value"))


@register("SELECT DISTINCT cite_key, CASE kind WHEN 'ch' THEN 'Part ' || part_no || ', chapter ' || chapter ELSE upper(kind) || ' ' || part_no || ':' || chapter END AS label FROM corpus")
def ref_N19_labels(spark: SparkSession, d: str) -> DataFrame:
    """Printed label of each citation key."""
    c = load(spark, d, "corpus", "cite_key", "kind", "part_no", "chapter")
    label = F.when(F.col("kind") == "ch", F.concat(F.lit("Part "), "part_no", F.lit(", chapter "), "chapter")).otherwise(F.concat(F.upper("kind"), F.lit(" "), "part_no", F.lit(":"), "chapter"))
    return c.select("cite_key", label.alias("label")).distinct()


# --- tokens and sets


@register("SELECT line_id, n, token, start_at, start_at + length(token) AS end_at FROM (SELECT line_id, n, token, (sum(length(token) + 1) OVER (PARTITION BY line_id ORDER BY n) - 1 - length(token))::BIGINT AS start_at FROM (SELECT line_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS n FROM page_lines WHERE text IS NOT NULL)) WHERE token <> ''")
def ref_T1_spans(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every line with their offsets."""
    return tokens.spans(load(spark, d, "page_lines", "line_id", "text"), "line_id", "text")


_NORM = "lower(regexp_replace(text, '[^\\p{L}]', '', 'g'))"


def _grams(frame: DataFrame, key: Column, n: int) -> DataFrame:
    letters = F.lower(F.regexp_replace("text", r"[^\p{L}]", ""))
    return frame.where("text is not null").select(key, F.explode(tokens.grams(letters, n)).alias("gram")).distinct()


@register(f"SELECT gram, count(*) AS items FROM (SELECT unnest({duck.grams('x', 4)}) AS gram FROM (SELECT {_NORM} AS x FROM eval_items WHERE text IS NOT NULL)) GROUP BY gram")
def ref_T4_grams(spark: SparkSession, d: str) -> DataFrame:
    """4-grams of the evaluation items and the number of items holding each."""
    return _grams(load(spark, d, "eval_items", "item_id", "text"), F.col("item_id"), 4).groupBy("gram").agg(F.count("*").alias("items"))


@register("SELECT w AS word, w1 AS word_1, w2 AS word_2, count(*) AS n FROM (SELECT text AS w, lead(text, 1) OVER o AS w1, lead(text, 2) OVER o AS w2 FROM tokens WHERE text IS NOT NULL WINDOW o AS (PARTITION BY volume, page ORDER BY pos, token_id)) WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) <= 64")
def ref_T5_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Word trigrams of the tokens' pages, stock ones beyond 64 places left out as the feature has it."""
    base = load(spark, d, "tokens", "volume", "page", "pos", "token_id", "text").where("text is not null")
    grams = tokens.neighbours(base, ["volume", "page"], ["pos", "token_id"], "text", 2).where("word_2 is not null")
    return grams.groupBy(F.col("text").alias("word"), "word_1", "word_2").agg(F.count("*").alias("n")).where("n <= 64")


_SEAMS = f"SELECT DISTINCT a, b FROM (SELECT {duck.bare('text')} AS a, lead({duck.bare('text')}) OVER (PARTITION BY volume, page ORDER BY pos, token_id) AS b FROM tokens WHERE text IS NOT NULL) WHERE a <> '' AND b <> ''"


def _seams(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "tokens", "volume", "page", "pos", "token_id", "text").where("text is not null").withColumn("a", normal.bare("text"))
    return tokens.neighbours(base, ["volume", "page"], ["pos", "token_id"], "a", 1).where("a != '' and word_1 != ''").select("a", F.col("word_1").alias("b")).distinct()


@register(_SEAMS)
def ref_T6_seams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of bare words that stand side by side on a page."""
    return _seams(spark, d)


@register("SELECT token_id, coalesce(max(CASE WHEN stop THEN rn + 1 END) OVER (o ROWS BETWEEN 22 PRECEDING AND 1 PRECEDING), greatest(1, rn - 22)) AS window_from, coalesce(min(CASE WHEN stop THEN rn END) OVER (o ROWS BETWEEN CURRENT ROW AND 22 FOLLOWING), least(size, rn + 22)) AS window_to FROM (SELECT token_id, volume, page, regexp_matches(text, '[.!?׃]$') AS stop, row_number() OVER (PARTITION BY volume, page ORDER BY pos, token_id) AS rn, count(*) OVER (PARTITION BY volume, page) AS size FROM tokens WHERE text IS NOT NULL) WINDOW o AS (PARTITION BY volume, page ORDER BY rn)")
def ref_T8_sentence_window(spark: SparkSession, d: str) -> DataFrame:
    """For each word at most 22 words either way, to the nearest stop."""
    page = Window.partitionBy("volume", "page")
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text").where("text is not null")
    base = base.withColumn("rn", F.row_number().over(page.orderBy("pos", "token_id")).cast("long")).withColumn("size", F.count("*").over(page)).withColumn("stop", F.col("text").rlike("[.!?׃]$"))
    o = page.orderBy("rn")
    left = F.coalesce(F.max(F.when(F.col("stop"), F.col("rn") + 1)).over(o.rowsBetween(-22, -1)), F.greatest(F.lit(1), F.col("rn") - 22))
    right = F.coalesce(F.min(F.when(F.col("stop"), F.col("rn"))).over(o.rowsBetween(0, 22)), F.least("size", F.col("rn") + 22))
    return base.select("token_id", left.alias("window_from"), right.alias("window_to"))


@register(f"SELECT {duck.fold('w')} AS word, count(*) AS n FROM (SELECT unnest({duck.words('text')}) AS w FROM corpus WHERE text IS NOT NULL) GROUP BY ALL")
def ref_T9_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Frequency lexicon of the clean witnesses."""
    return tokens.lexicon(load(spark, d, "corpus", "text").where("text is not null"), "text")


# --- attestation and quality


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """(word, n) of the clean witnesses, written once for all queries of a session."""
    return once(spark, d, "lexicon", lambda: _build_lexicon(spark, d))


def _build_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return tokens.lexicon(load(spark, d, "corpus", "text").where("text is not null"), "text")


_FORMS = f"SELECT {duck.fold('w')} AS word, count(*) AS n FROM (SELECT unnest({duck.words('text')}) AS w FROM tokens WHERE text IS NOT NULL) GROUP BY ALL"


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return tokens.lexicon(load(spark, d, "tokens", "text").where("text is not null"), "text")


@register(f"WITH {duck.LEX}, forms AS ({_FORMS}) SELECT word, n, {duck.attested('word')} AS attested FROM forms")
def ref_P1_attested(spark: SparkSession, d: str) -> DataFrame:
    """Every folded form of the tokens, its frequency, and whether it is attested."""
    return lexicon.attested(_forms(spark, d), _lexicon(spark, d))


_QUALITY = f"""WITH {duck.LEX}, t AS (SELECT token_id, volume, text, regexp_matches(text, '[A-Za-z0-9]') AS odd, {duck.words('text')} AS w FROM tokens WHERE text IS NOT NULL),
x AS (SELECT token_id, {duck.fold('z')} AS word FROM (SELECT token_id, unnest(w) AS z FROM t)), y AS (SELECT DISTINCT word FROM x), z AS (SELECT word, {duck.attested('word')} AS ok FROM y),
b AS (SELECT token_id, count(*) AS words, sum((NOT ok)::INT) AS unattested FROM x JOIN z USING (word) GROUP BY token_id),
q AS (SELECT token_id, volume, coalesce(words, 0) AS words, coalesce(unattested, 0)::BIGINT AS unattested, (odd OR (coalesce(words, 0) > 0 AND ((len(w) > 1 AND NOT regexp_matches(text, '[־‐‑‒–—-]')) OR coalesce(unattested, 0) > 0))) AS suspect FROM t LEFT JOIN b USING (token_id))"""


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.token_quality(load(spark, d, "tokens", "token_id", "text"), "token_id", "text", _lexicon(spark, d))


@register(_QUALITY + " SELECT token_id, words, unattested, suspect FROM q")
def ref_P2_ok(spark: SparkSession, d: str) -> DataFrame:
    """Words, unattested words and suspicion of every token."""
    return _quality(spark, d)


@register("SELECT volume, page, sum(he)::BIGINT AS hebrew, sum(al)::BIGINT AS letters FROM (SELECT volume, page, length(regexp_replace(text, '[^א-ת]', '', 'g')) AS he, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS al, length(replace(text, ' ', '')) AS n FROM page_lines WHERE text IS NOT NULL) GROUP BY ALL HAVING sum(n) >= 200 AND sum(he) >= 0.6 * sum(n)")
def ref_P3_script_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of at least 200 characters of which 60 % are Hebrew."""
    size = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    base = load(spark, d, "page_lines", "volume", "page", "text").where("text is not null").select("volume", "page", size("[^א-ת]").alias("he"), size(r"[^\p{L}]").alias("al"), size(" ").alias("n"))
    return base.groupBy("volume", "page").agg(F.sum("he").alias("hebrew"), F.sum("al").alias("letters"), F.sum("n").alias("n")).where("n >= 200 and hebrew >= 0.6 * n").drop("n")


_READINGS = "SELECT token_id, a.form AS form, a.witness AS witness, text FROM (SELECT token_id, text, unnest(alt) AS a FROM tokens WHERE text IS NOT NULL) WHERE a.form IS NOT NULL"


def _alternatives(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "tokens", "token_id", "text", "alt").where("text is not null")
    return base.select("token_id", "text", F.explode("alt").alias("a")).select("token_id", "text", F.col("a.form").alias("form"), F.col("a.witness").alias("witness")).where("form is not null")


@register(f"SELECT token_id, form, CASE WHEN length(a) = length(b) THEN len(list_filter(generate_series(1, length(a)), lambda i: substr(a, i, 1) <> substr(b, i, 1))) = 1 WHEN abs(length(a) - length(b)) <> 1 THEN false WHEN length(a) > length(b) THEN len(list_filter(generate_series(1, length(a)), lambda i: substr(a, 1, i - 1) || substr(a, i + 1) = b)) > 0 ELSE len(list_filter(generate_series(1, length(b)), lambda i: substr(b, 1, i - 1) || substr(b, i + 1) = a)) > 0 END AS near FROM (SELECT token_id, form, {duck.bare('text')} AS a, {duck.bare('form')} AS b FROM ({_READINGS}))")
def ref_P5_near(spark: SparkSession, d: str) -> DataFrame:
    """Whether each other reading is one letter from the chosen one."""
    return _alternatives(spark, d).select("token_id", "form", similarity.near(normal.bare("text"), normal.bare("form")).alias("near"))


_STROKES = ", ".join(duck.q(p) for x in similarity.STROKES.split() for p in (x, x[::-1]))


@register(f"SELECT token_id, form, length(a) = length(b) AND a <> b AND len(list_filter(generate_series(1, length(a)), lambda i: substr(a, i, 1) <> substr(b, i, 1) AND substr(a, i, 1) || substr(b, i, 1) NOT IN ({_STROKES}))) = 0 AS stroke FROM (SELECT token_id, form, {duck.bare('text')} AS a, {duck.bare('form')} AS b FROM ({_READINGS}))")
def ref_P6_stroke(spark: SparkSession, d: str) -> DataFrame:
    """Whether each other reading differs by strokes alone."""
    return _alternatives(spark, d).select("token_id", "form", similarity.stroke_only(normal.bare("text"), normal.bare("form")).alias("stroke"))


@register("SELECT line_id, start_at FROM (SELECT line_id, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 110)) AS start_at FROM page_lines WHERE text IS NOT NULL) WHERE NOT regexp_matches(text, '(?:פרק|Kap\\.|chap\\.|ch\\.|cap\\.)')")
def ref_P8_blind_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 110 characters over lines without a heading."""
    base = load(spark, d, "page_lines", "line_id", "text").where("text is not null")
    return base.where(~F.col("text").rlike(r"(?:פרק|Kap\.|chap\.|ch\.|cap\.)")).select("line_id", F.explode(F.expr("sequence(0, greatest(length(text) - 1, 0), 110)")).alias("start_at"))


@register("SELECT addenda_id, elem, array_to_string(regexp_extract_all(t, '\\[[^\\[\\]]+\\]'), ' ') AS rubrics, len(regexp_extract_all(t, '\\[[^\\[\\]]+\\]')) AS n FROM (SELECT addenda_id, unnest(text) AS t, generate_subscripts(text, 1) - 1 AS elem FROM addenda_munich) WHERE t IS NOT NULL")
def ref_P12_rubrics(spark: SparkSession, d: str) -> DataFrame:
    """Bracketed rubrics of each addenda paragraph."""
    rows = load(spark, d, "addenda_munich", "addenda_id", "text").select("addenda_id", F.posexplode("text").alias("elem", "t")).where("t is not null")
    found = F.regexp_extract_all("t", F.lit(r"\[[^\[\]]+\]"), F.lit(0))
    return rows.select("addenda_id", "elem", F.array_join(found, " ").alias("rubrics"), F.size(found).alias("n"))


@register(f"SELECT token_id, form, witness FROM ({_READINGS}) WHERE witness = 'guide' OR (length({duck.bare('form')}) >= 2 AND abs(length({duck.bare('form')}) - length({duck.bare('text')})) <= 1)")
def ref_P13_printable(spark: SparkSession, d: str) -> DataFrame:
    """Variants worth printing: of two letters at least and of about the chosen length."""
    size = lambda c: F.length(normal.bare(c))
    return _alternatives(spark, d).where((F.col("witness") == "guide") | ((size("form") >= 2) & (F.abs(size("form") - size("text")) <= 1))).select("token_id", "form", "witness")


@register(f"SELECT token_id FROM (SELECT token_id, why, {duck.bare('text')} AS b, count(*) OVER (PARTITION BY volume, page, {duck.bare('text')}) AS n FROM tokens WHERE text IS NOT NULL) WHERE length(b) >= 2 AND (n = 1 OR why = 'doubt')")
def ref_P14_hedged(spark: SparkSession, d: str) -> DataFrame:
    """Words of two letters at least that are the only ones of their form on the page, or doubted."""
    base = load(spark, d, "tokens", "token_id", "volume", "page", "why", "text").where("text is not null").withColumn("b", normal.bare("text"))
    return base.withColumn("n", F.count("*").over(Window.partitionBy("volume", "page", "b"))).where("length(b) >= 2 and (n = 1 or why = 'doubt')").select("token_id")


# --- similarity


def _sections(spark: SparkSession, d: str) -> DataFrame:
    chapters = load(spark, d, "corpus", "kind", "cite_key", "text").where("kind = 'ch'")
    return _grams(chapters, F.col("cite_key").alias("section"), 4)


_COSINE = f"""WITH s AS (SELECT DISTINCT section, unnest({duck.grams('x', 4)}) AS gram FROM (SELECT cite_key AS section, {_NORM} AS x FROM corpus WHERE kind = 'ch' AND text IS NOT NULL)),
u AS (SELECT item_id AS unit, unnest({duck.grams('x', 4)}) AS gram FROM (SELECT item_id, {_NORM} AS x FROM eval_items WHERE text IS NOT NULL)),
w AS (SELECT gram, ln((SELECT count(DISTINCT section) FROM s)::DOUBLE / count(*)) AS weight FROM s GROUP BY gram),
sn AS (SELECT section, sqrt(sum(weight * weight)) AS sn FROM s JOIN w USING (gram) GROUP BY section), un AS (SELECT unit, sqrt(sum(weight * weight)) AS un FROM u JOIN w USING (gram) WHERE weight > 0 GROUP BY unit),
dots AS (SELECT unit, section, sum(weight * weight) AS dot FROM u JOIN w USING (gram) JOIN s USING (gram) WHERE weight > 0 GROUP BY unit, section),
scored AS (SELECT unit, section, round(dot / (sn * un), 4) AS score FROM dots JOIN sn USING (section) JOIN un USING (unit)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, section DESC) AS rank FROM scored)"""


@register(_COSINE + " SELECT unit, section, score, rank FROM ranked WHERE rank <= 3")
def ref_E4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest chapters of each evaluation item by idf-weighted cosine of 4-grams."""
    units = _grams(load(spark, d, "eval_items", "item_id", "text"), F.col("item_id").alias("unit"), 4)
    return similarity.cosine(units, _sections(spark, d)).where("rank <= 3")


@register(_COSINE + " SELECT gram, round(weight, 6) AS weight FROM w")
def ref_E3_idf(spark: SparkSession, d: str) -> DataFrame:
    """Weight of every 4-gram of the chapters."""
    grams = _sections(spark, d)
    return similarity.idf(grams, grams.select("section").distinct().count()).withColumn("weight", F.round("weight", 6))


@register(f"SELECT gold_id, elem, CASE WHEN len(a) > 0 THEN round(len(list_intersect(a, b)) / len(a), 6) ELSE 0 END AS share FROM (SELECT gold_id, elem, {duck.grams(duck.letters('x'), 3)} AS a, {duck.grams(duck.letters('text'), 3)} AS b FROM (SELECT gold_id, text, unnest(lemma) AS x, generate_subscripts(lemma, 1) - 1 AS elem FROM gold WHERE text IS NOT NULL) WHERE x IS NOT NULL)")
def ref_E1_containment(spark: SparkSession, d: str) -> DataFrame:
    """Share of each lemma's 3-grams that its passage holds."""
    rows = load(spark, d, "gold", "gold_id", "text", "lemma").where("text is not null").select("gold_id", "text", F.posexplode("lemma").alias("elem", "x")).where("x is not null")
    grams = rows.select("gold_id", "elem", tokens.grams(normal.letters_only("x"), 3).alias("a"), tokens.grams(normal.letters_only("text"), 3).alias("b"))
    return grams.select("gold_id", "elem", F.round(similarity.containment(F.col("a"), F.col("b")), 6).alias("share"))


@register()
def ref_E2_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted edit similarity of each other reading with the chosen one."""
    return _alternatives(spark, d).select("token_id", "form", F.round(similarity.numeral_similarity("form", normal.strip_points("text")), 6).alias("score"))


def _page_words(spark: SparkSession, d: str) -> DataFrame:
    """(volume, page, read, layer): the arrays of words of a page's tokens and of its lines."""
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    own = load(spark, d, "tokens", "volume", "page", "pos", "token_id", "text").where("text is not null").groupBy("volume", "page").agg(F.transform(ordered("pos", "token_id", "text"), lambda s: s["text"]).alias("read"))
    lines = load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null").groupBy("volume", "page").agg(F.split(F.array_join(F.transform(ordered("line_no", "line_id", "text"), lambda s: s["text"]), " "), " ").alias("layer"))
    return own.join(lines, ["volume", "page"])


@register()
def ref_E7_presence(spark: SparkSession, d: str) -> DataFrame:
    """How much of each page's tokens one window of its lines holds, order ignored."""
    return _page_words(spark, d).select("volume", "page", F.round(similarity.presence("read", "layer"), 6).alias("present"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """The alignment of each page's tokens with its lines, written once for all queries of a session that use it."""
    return once(spark, d, "aligned", lambda: _align_pages(spark, d))


def _align_pages(spark: SparkSession, d: str) -> DataFrame:
    # the words are taken inside the array, so that no exploded row carries its page's arrays
    pairs = alignment.spread(_page_words(spark, d), ["volume", "page"]).select("volume", "page", "read", "layer", alignment.aligned("read", "layer").alias("p"))
    named = pairs.select("volume", "page", F.expr("transform(p, x -> struct(x.i as i, x.j as j, get(`read`, x.i) as own, get(layer, x.j) as word))").alias("p"))
    return named.select("volume", "page", F.posexplode("p").alias("n", "p")).select("volume", "page", "n", "p.*")


@register()
def ref_J2_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Banded global alignment of each page's tokens with its lines."""
    return _aligned(spark, d)


@register()
def ref_J3_projection(spark: SparkSession, d: str) -> DataFrame:
    """The lines' words at each position of the tokens, insertions before the next."""
    return alignment.projected(_aligned(spark, d), ["volume", "page"])


@register()
def ref_G10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Right words, wanted words, rate and insertions of each page's lines against its tokens."""
    pairs = _aligned(spark, d)
    right = F.coalesce(normal.bare("own") == normal.bare("word"), F.lit(False))
    return pairs.groupBy("volume", "page").agg(F.count_if(right).alias("correct"), F.count("i").alias("wanted"), F.count_if(F.col("i").isNull()).alias("inserted")).withColumn("rate", F.round(F.col("correct") / F.col("wanted"), 4))


@register()
def ref_E5_chain(spark: SparkSession, d: str) -> DataFrame:
    """Longest increasing chain of equal words of each page's tokens and lines."""
    pages = _page_words(spark, d).select(F.concat_ws(":", "volume", "page").alias("unit"), "read", "layer")
    a = pages.select("unit", F.posexplode("read").alias("i", "w"))
    b = pages.select("unit", F.posexplode("layer").alias("h", "w"))
    once = lambda f: f.withColumn("_n", F.count("*").over(Window.partitionBy("unit", "w"))).where("_n = 1").drop("_n")
    return similarity.chains(once(a).join(once(b), ["unit", "w"]).select("unit", F.col("i").cast("long"), F.col("h").cast("long")))


_PAIR = f"WITH s AS (SELECT gold_id, unnest({duck.grams(duck.letters('text'), 12)}) AS seed FROM gold WHERE text IS NOT NULL)"


def _passages(spark: SparkSession, d: str) -> DataFrame:
    """(t, text, ids): every distinct text of gold with the ids that have it in order, written once for all queries of a session that pair texts."""

    def build() -> DataFrame:
        held = load(spark, d, "gold", "gold_id", "text").where("gold_id is not null and text is not null")
        texts = alignment.spread(held, ["text"]).groupBy("text").agg(F.array_sort(F.collect_list("gold_id")).alias("ids"))
        return texts.select(F.monotonically_increasing_id().alias("t"), "text", "ids")

    return once(spark, d, "passages", build)


def _text_pairs(spark: SparkSession, d: str, n: int = 12) -> DataFrame:
    """(x, y, seeds): texts of `_passages` that share n letters, x below y, and those of several passages with themselves.

    Spark takes the exploded seeds to be as small as the file and would send
    them to every worker, so the merge join is asked for.
    """
    texts = _passages(spark, d)
    s = quotation.seeds(texts, "t", "text", n)
    shared = s.select(F.col("t").alias("x"), "seed").hint("merge").join(s.select(F.col("t").alias("y"), "seed"), "seed").where("x < y").groupBy("x", "y").agg(F.count("*").alias("seeds"))
    own = F.size(tokens.grams(normal.letters_only("text"), n)).cast("long")
    copies = texts.where("ids[0] < ids[size(ids) - 1]").select(F.col("t").alias("x"), F.col("t").alias("y"), own.alias("seeds")).where("seeds > 0")
    return shared.unionByName(copies)


def _passage_pairs(spark: SparkSession, d: str, n: int = 12) -> DataFrame:
    """(text_a, text_b, ids_a, ids_b): the pairs of `_text_pairs` in each order in which a passage of the first has a lesser id than one of the second."""
    side = lambda s: _passages(spark, d).select(F.col("t").alias(s), F.struct("text", "ids").alias(f"p{s}")).hint("merge")
    both = _text_pairs(spark, d, n).join(side("x"), "x").join(side("y"), "y")
    way = lambda a, b: F.when(F.get(f"{a}.ids", F.lit(0)) < F.element_at(f"{b}.ids", -1), F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    ways = F.array_compact(F.array(way("px", "py"), F.when(F.col("x") != F.col("y"), way("py", "px"))))
    return both.select(F.explode(ways).alias("w")).select(F.col("w.a.text").alias("text_a"), F.col("w.b.text").alias("text_b"), F.col("w.a.ids").alias("ids_a"), F.col("w.b.ids").alias("ids_b"))


def _spans_of_passages(pairs: DataFrame) -> DataFrame:
    """(a, b, span's columns) of `pairs`(ids_a, ids_b, spans): the spans of two texts for all their passages with a below b."""
    spread = pairs.select(F.explode("ids_a").alias("a"), "ids_b", "spans").select("a", F.explode(F.filter("ids_b", lambda b: b > F.col("a"))).alias("b"), "spans")
    return spread.select("a", "b", F.explode("spans").alias("r")).select("a", "b", "r.*")


@register(_PAIR + " SELECT x.gold_id AS a, y.gold_id AS b, count(*) AS seeds FROM s x JOIN s y USING (seed) WHERE x.gold_id < y.gold_id GROUP BY ALL")
def ref_J1_seed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Passages that share 12 letters, with the number of shared seeds."""
    ids = lambda s: _passages(spark, d).select(F.col("t").alias(s), F.col("ids").alias(f"ids_{s}")).hint("merge")
    pairs = _text_pairs(spark, d).join(ids("x"), "x").join(ids("y"), "y").select("x", "y", F.explode("ids_x").alias("p"), "ids_y", "seeds").select("x", "y", "p", F.explode("ids_y").alias("q"), "seeds")
    # a text's own passages meet in both orders, those of two texts in one
    return pairs.where("p < q or (p > q and x != y)").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("seeds").alias("seeds"))


@register()
def ref_J1_quotations(spark: SparkSession, d: str) -> DataFrame:
    """Maximal verbatim runs of the passages that share a seed."""
    return _spans_of_passages(_passage_pairs(spark, d).select("ids_a", "ids_b", quotation.quotations()("text_a", "text_b").alias("spans")))


@register(f"WITH lines AS (SELECT volume, page, line_no, line_id, text FROM page_lines WHERE text IS NOT NULL), h AS (SELECT volume, page, b AS w, count(*) AS n FROM (SELECT volume, page, {duck.bare('x')} AS b FROM (SELECT volume, page, unnest(string_split(text, ' ')) AS x FROM lines)) WHERE b <> '' GROUP BY ALL HAVING count(*) = 1), t AS (SELECT volume, page, b AS w FROM (SELECT volume, page, {duck.bare('text')} AS b FROM tokens WHERE text IS NOT NULL) WHERE b <> '' GROUP BY ALL HAVING count(*) = 1) SELECT volume, page, count(*) AS anchors FROM h JOIN t USING (volume, page, w) GROUP BY ALL")
def ref_J4_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Words that occur once in a page's tokens and once in its lines."""
    once = lambda f: f.where("w != ''").groupBy("volume", "page", "w").count().where("count = 1").drop("count")
    h = once(load(spark, d, "page_lines", "volume", "page", "text").where("text is not null").select("volume", "page", F.explode(F.split("text", " ")).alias("x")).select("volume", "page", normal.bare("x").alias("w")))
    t = once(load(spark, d, "tokens", "volume", "page", "text").where("text is not null").select("volume", "page", normal.bare("text").alias("w")))
    return h.join(t, ["volume", "page", "w"]).groupBy("volume", "page").agg(F.count("*").alias("anchors"))


_RANGES = "r AS (SELECT volume, page, n, (sum(n) OVER (PARTITION BY volume ORDER BY page) - n)::BIGINT AS start_at FROM (SELECT volume, page, sum(length(text) + 1)::BIGINT AS n FROM page_lines WHERE text IS NOT NULL GROUP BY ALL))"


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    pages = load(spark, d, "page_lines", "volume", "page", "text").where("text is not null").groupBy("volume", "page").agg(F.sum(F.length("text") + 1).alias("n"))
    lined = windows.running_sum(pages.withColumn("slot", F.floor(F.col("page") / 256)), ["volume"], "slot", ["page"], "n", "end_at")
    return lined.select("volume", "page", (F.col("end_at") - F.col("n")).alias("start_at"), "end_at")


@register(f"WITH {_RANGES} SELECT volume, page, start_at, start_at + n AS end_at FROM r")
def ref_S3_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Running character offsets of the pages of each volume."""
    return _ranges(spark, d)


@register(f"WITH {_RANGES}, p AS (SELECT volume, unnest(generate_series(0, m - 1, 997)) AS at FROM (SELECT volume, max(start_at + n) AS m FROM r GROUP BY volume)) SELECT p.volume, p.at, r.page FROM p JOIN r ON p.volume = r.volume AND p.at >= r.start_at AND p.at < r.start_at + r.n")
def ref_J12_position(spark: SparkSession, d: str) -> DataFrame:
    """The page of every 997th character of a volume, by a binned range join."""
    ranges = _ranges(spark, d)
    points = ranges.groupBy("volume").agg(F.max("end_at").alias("m")).select("volume", F.explode(F.expr("sequence(0L, m - 1, 997L)")).alias("at"))
    return windows.point_in_range(points, ranges, ["volume"], "at", "start_at", "end_at", 2048).select("volume", "at", "page")


@register("SELECT u.unit_id, u.volume, u.part_no, u.chapter, v.verdict, v.score, c.paragraphs FROM (SELECT DISTINCT unit_id, volume, part_no, chapter FROM units) u LEFT JOIN verification v USING (unit_id) LEFT JOIN (SELECT part_no, chapter, count(*) AS paragraphs FROM corpus WHERE kind = 'ch' GROUP BY ALL) c USING (part_no, chapter)")
def ref_J15_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Units with their verdicts and the base text's paragraphs, missing ones null."""
    u = load(spark, d, "units", "unit_id", "volume", "part_no", "chapter").distinct()
    v = load(spark, d, "verification", "unit_id", "verdict", "score")
    c = load(spark, d, "corpus", "kind", "part_no", "chapter").where("kind = 'ch'").groupBy("part_no", "chapter").agg(F.count("*").alias("paragraphs"))
    return u.join(v, "unit_id", "left").join(c, ["part_no", "chapter"], "left").select("unit_id", "volume", "part_no", "chapter", "verdict", "score", "paragraphs")


# --- aggregates


@register(_QUALITY + " SELECT volume, count_if(words > 0 OR suspect) AS total, count_if(suspect) AS bad, CASE WHEN count_if(words > 0 OR suspect) = 0 THEN 1.0 ELSE round(1 - count_if(suspect) / count_if(words > 0 OR suspect), 4) END AS quality FROM q GROUP BY volume")
def ref_G1_quality(spark: SparkSession, d: str) -> DataFrame:
    """Share of sound tokens of each volume; tokens without a word don't count."""
    volumes = load(spark, d, "tokens", "token_id", "volume")
    agg = _quality(spark, d).join(volumes, "token_id").groupBy("volume").agg(F.count_if((F.col("words") > 0) | F.col("suspect")).alias("total"), F.count_if("suspect").alias("bad"))
    return agg.withColumn("quality", F.when(F.col("total") == 0, 1.0).otherwise(F.round(1 - F.col("bad") / F.col("total"), 4)))


@register(_QUALITY + ", keep AS (SELECT DISTINCT volume, page FROM tokens SEMI JOIN page_lines USING (volume, page)), p AS (SELECT q.*, t.page FROM q JOIN tokens t USING (token_id)) SELECT count(*) AS tokens, count_if(suspect) AS bad FROM p SEMI JOIN keep ON p.volume = keep.volume AND p.page = keep.page")
def ref_G2_comparable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Suspects on the pages that both the tokens and the lines cover."""
    keep = load(spark, d, "page_lines", "volume", "page").distinct()
    at = load(spark, d, "tokens", "token_id", "volume", "page").join(keep, ["volume", "page"], "left_semi")
    return _quality(spark, d).join(at, "token_id").agg(F.count("*").alias("tokens"), F.count_if("suspect").alias("bad"))


@register(f"""WITH c AS (SELECT witness, {duck.fold('w')} AS word, count(*) AS n FROM (SELECT witness, unnest({duck.words('text')}) AS w FROM corpus WHERE text IS NOT NULL) GROUP BY ALL),
r AS (SELECT witness, word, n, word AS reading FROM c UNION ALL SELECT witness, word, n, substr(word, 2) FROM c WHERE length(word) > 2 AND regexp_matches(word, '^[והבכלמש]') UNION ALL SELECT witness, word, n, substr(word, 3) FROM c WHERE length(word) > 3 AND regexp_matches(word, '^[והבכלמש]{{2}}')),
j AS (SELECT r.witness, r.word, r.n, bool_or(coalesce(c.witness <> r.witness, false) OR regexp_matches(r.word, '^[א-ת]+״[א-ת]$')) AS ok FROM r LEFT JOIN c ON c.word = r.reading GROUP BY ALL)
SELECT witness, sum(n)::BIGINT AS tokens, sum(CASE WHEN ok THEN 0 ELSE n END)::BIGINT AS flagged, round(sum(CASE WHEN ok THEN 0 ELSE n END) / sum(n), 4) AS rate FROM j GROUP BY witness""")
def ref_G3_floor(spark: SparkSession, d: str) -> DataFrame:
    """Flag rate of each clean witness against the lexicon of the others."""
    w = load(spark, d, "corpus", "witness", "text").where("text is not null").select("witness", F.explode(tokens.words("text")).alias("w"))
    return lexicon.held_out_floor(w.select("witness", normal.fold("w").alias("word")))


def _unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """(unit_id, part_no, chapter, text): a unit's tokens, from its first word up to the next unit's.

    Tokens are placed within their page; the unit a page opens in is told from
    the table of pages and units alone, so no volume's tokens are gathered.
    """
    place = Window.partitionBy("volume", "page").orderBy("pos", "token_id")
    words = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text").where("volume is not null and page is not null").withColumn("at", F.row_number().over(place) - 1)
    starts = load(spark, d, "units", "unit_id", "volume", "part_no", "chapter", "page", "token_at").distinct().select("volume", "page", F.col("token_at").alias("at"), F.struct("unit_id", "part_no", "chapter").alias("unit"))
    last = starts.groupBy("volume", "page").agg(F.max_by("unit", F.struct("at", "unit.unit_id")).alias("own"))
    pages = words.select("volume", "page").distinct().join(last, ["volume", "page"], "full")
    earlier = Window.partitionBy("volume").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    opened = pages.select("volume", "page", F.last("own", ignorenulls=True).over(earlier).alias("open"))
    marked = words.select("volume", "page", "at", "token_id", "text", F.lit(None).cast(starts.schema["unit"].dataType).alias("unit")).unionByName(starts.select("volume", "page", "at", F.lit(-1).cast("long").alias("token_id"), F.lit(None).cast("string").alias("text"), "unit"))
    inside = Window.partitionBy("volume", "page").orderBy("at", "token_id", "unit.unit_id").rowsBetween(Window.unboundedPreceding, 0)
    held = marked.withColumn("unit", F.last("unit", ignorenulls=True).over(inside)).where("text is not null").join(opened, ["volume", "page"], "left").withColumn("unit", F.coalesce("unit", "open")).where("unit is not null")
    ordered = F.array_sort(F.collect_list(F.struct("page", "at", "token_id", "text")))
    return held.groupBy("unit").agg(F.concat_ws(" ", F.transform(ordered, lambda w: w["text"])).alias("text")).select("unit.*", "text")


def _null_models(units: DataFrame, chapters: DataFrame) -> DataFrame:
    """(model, text_a, text_b): each of `units`(unit_id, part_no, chapter, text) with its own chapter, one picked by a hash, and its neighbour.

    `chapters`(part_no, chapter, text) is the base text, some hundred rows.  As
    in the reference the neighbour is the chapter ahead, else the one behind.
    """
    ranked = chapters.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part_no", "chapter")) - 1)
    own = units.withColumnRenamed("text", "text_a").join(ranked.withColumnRenamed("text", "text_b"), ["part_no", "chapter"])
    others = F.lit(ranked.count() - 1)
    pick = F.pmod(F.xxhash64("unit_id", "part_no", "chapter"), F.nullif(others, F.lit(0)))
    drawn = own.drop("text_b").withColumn("rank", pick + (pick >= F.col("rank")).cast("int")).join(ranked.select("rank", F.col("text").alias("text_b")), "rank")
    near = lambda step, name: ranked.select("part_no", (F.col("chapter") + step).alias("chapter"), F.col("text").alias(name))
    beside = own.drop("text_b").join(near(-1, "ahead"), ["part_no", "chapter"], "left").join(near(1, "behind"), ["part_no", "chapter"], "left").withColumn("text_b", F.coalesce("ahead", "behind"))
    model = lambda f, name: f.select(F.lit(name).alias("model"), "text_a", "text_b")
    return model(own, "hits").unionByName(model(drawn, "random_null")).unionByName(model(beside, "adjacent_null"))


@register()
def ref_G4_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Verbatim runs of at least 10 to 16 letters of the units with their own, a hash-picked and the adjacent chapter, and of the passages with each other."""
    chapters = load(spark, d, "corpus", "witness", "kind", "lang", "part_no", "chapter", "para_no", "text").where("kind = 'ch' and lang = 'he' and text is not null")
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("witness", "para_no", "text"))), lambda p: p["text"]))
    nulls = _null_models(_unit_texts(spark, d), chapters.groupBy("part_no", "chapter").agg(joined.alias("text")))
    below = F.aggregate("ids_a", F.lit(0).cast("long"), lambda n, a: n + F.size(F.filter("ids_b", lambda b: b > a)))
    passages = _passage_pairs(spark, d, quotation.LENGTHS[0]).select(F.lit("passages").alias("model"), "text_a", "text_b", below.alias("pairs"))
    counts = nulls.withColumn("pairs", F.lit(1).cast("long")).unionByName(passages).select("model", "pairs", F.posexplode(quotation.counts("text_a", "text_b")).alias("i", "n"))
    lengths = F.array(*map(F.lit, quotation.LENGTHS))
    found = counts.groupBy(F.get(lengths, F.col("i")).alias("minlen")).pivot("model", ["hits", "random_null", "adjacent_null", "passages"]).agg(F.sum(F.col("n") * F.col("pairs")))
    return spark.createDataFrame([(n,) for n in quotation.LENGTHS], "minlen int").join(found, "minlen", "left").na.fill(0)


@register("SELECT why, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM tokens GROUP BY why")
def ref_G5_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason decided, and its share."""
    return witness.reasons(load(spark, d, "tokens", "why"))


@register("WITH v AS (SELECT volume, round(count_if(why = 'doubt') / count(*), 6) AS rate FROM tokens GROUP BY volume) SELECT volume, rate, round(1 - rate / nullif(first_value(rate) OVER (ORDER BY volume), 0), 4) AS gain FROM v")
def ref_G6_gain(spark: SparkSession, d: str) -> DataFrame:
    """Doubt rate of each volume and its gain over the first one's."""
    v = load(spark, d, "tokens", "volume", "why").groupBy("volume").agg(F.round(F.count_if(F.col("why") == "doubt") / F.count("*"), 6).alias("rate"))
    base = F.first("rate").over(Window.partitionBy(F.lit(0)).orderBy("volume"))
    return v.withColumn("gain", F.round(1 - F.col("rate") / F.nullif(base, F.lit(0.0)), 4))


_MISREAD = f"WITH {duck.LEX}, m AS (SELECT token_id, {duck.bare('form')} AS read, {duck.bare('text')} AS tru FROM ({_READINGS}) WHERE witness <> 'guide'), w AS (SELECT DISTINCT read AS word FROM m UNION SELECT DISTINCT tru FROM m), k AS (SELECT word, {duck.attested('word')} AS ok FROM w), g AS (SELECT token_id, read, tru FROM m JOIN k a ON a.word = m.read JOIN k b ON b.word = m.tru WHERE NOT a.ok AND b.ok AND read <> '' AND tru <> '')"


def _misreadings(spark: SparkSession, d: str) -> DataFrame:
    """(token_id, read, true), written once for all queries of a session that learn from it."""
    return once(spark, d, "misreadings", lambda: _find_misreadings(spark, d))


def _find_misreadings(spark: SparkSession, d: str) -> DataFrame:
    m = _alternatives(spark, d).where("witness != 'guide'").select("token_id", normal.bare("form").alias("read"), normal.bare("text").alias("true")).where("`read` != '' and `true` != ''")
    lex = _lexicon(spark, d)
    judged = lexicon.attested(lexicon.attested(m, lex, "read").withColumnRenamed("attested", "read_ok"), lex, "true").withColumnRenamed("attested", "true_ok")
    return judged.where("not read_ok and true_ok").select("token_id", "read", "true")


@register(_MISREAD + " SELECT token_id, read, tru AS \"true\" FROM g")
def ref_G7_misreadings(spark: SparkSession, d: str) -> DataFrame:
    """Readings that lost unattested to an attested word."""
    return _misreadings(spark, d)


@register(_MISREAD + ", x AS (SELECT read, tru, list_filter(generate_series(1, length(read)), lambda i: substr(read, i, 1) <> substr(tru, i, 1)) AS p FROM g WHERE length(read) = length(tru)) SELECT substr(read, p[1], 1) AS a, substr(tru, p[1], 1) AS b, count(*) AS n FROM x WHERE len(p) = 1 GROUP BY ALL HAVING count(*) >= 2")
def ref_G8_confusions(spark: SparkSession, d: str) -> DataFrame:
    """Letters read for others at least twice."""
    return repair.confusions(_misreadings(spark, d))


@register("SELECT count_if(verdict <> 'short') AS scored, count_if(verdict = 'agree') AS agree, count_if(rank_no <= 3 AND verdict <> 'short') AS top3, round(count_if(verdict = 'agree') / count_if(verdict <> 'short'), 3) AS agree_rate, count_if(verdict = 'short') AS short FROM verification")
def ref_G9_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the independent verification."""
    v = load(spark, d, "verification", "verdict", "rank_no")
    counts = v.agg(F.count_if(F.col("verdict") != "short").alias("scored"), F.count_if(F.col("verdict") == "agree").alias("agree"), F.count_if((F.col("rank_no") <= 3) & (F.col("verdict") != "short")).alias("top3"), F.count_if(F.col("verdict") == "short").alias("short"))
    return counts.withColumn("agree_rate", F.round(F.col("agree") / F.col("scored"), 3))


@register("SELECT volume, count(DISTINCT struct_pack(p := part_no, c := chapter)) AS matched, round(avg(score), 6) AS mean_score, count(DISTINCT page) AS pages FROM units GROUP BY volume")
def ref_G11_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Chapters matched, pages and mean score of each volume."""
    return load(spark, d, "units").groupBy("volume").agg(F.countDistinct("part_no", "chapter").alias("matched"), F.round(F.avg("score"), 6).alias("mean_score"), F.countDistinct("page").alias("pages"))


@register("SELECT count(*) AS tokens, count(text) AS texts, count_if(was <> '') AS altered, count_if(len(alt) > 0) AS rival, count_if(why = 'doubt') AS doubted, count_if(at_word IS NULL) AS unplaced FROM tokens")
def ref_G12_totals(spark: SparkSession, d: str) -> DataFrame:
    """The edition's totals in one pass."""
    return load(spark, d, "tokens", "text", "was", "alt", "why", "at_word").agg(F.count("*").alias("tokens"), F.count("text").alias("texts"), F.count_if(F.col("was") != "").alias("altered"), F.count_if(F.size("alt") > 0).alias("rival"), F.count_if(F.col("why") == "doubt").alias("doubted"), F.count_if(F.col("at_word").isNull()).alias("unplaced"))


@register("SELECT part_no, chapter FROM (SELECT part_no, unnest(generate_series(1, last)) AS chapter FROM (SELECT part_no, max(chapter) AS last FROM corpus WHERE kind = 'ch' GROUP BY part_no)) EXCEPT SELECT part_no, chapter FROM units")
def ref_G13_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of the base text that no unit was placed at."""
    last = load(spark, d, "corpus", "kind", "part_no", "chapter").where("kind = 'ch'").groupBy("part_no").agg(F.max("chapter").alias("last"))
    return last.select("part_no", F.explode(F.sequence(F.lit(1), "last")).alias("chapter")).join(load(spark, d, "units", "part_no", "chapter"), ["part_no", "chapter"], "left_anti")


@register("SELECT volume, count_if(was <> '') AS altered, count_if(was <> '' AND was IS DISTINCT FROM text) AS reported, count_if(was <> '') = count_if(was <> '' AND was IS DISTINCT FROM text) AS reconciled FROM tokens GROUP BY volume")
def ref_G14_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Words altered and corrections reported, volume by volume."""
    t = load(spark, d, "tokens", "volume", "was", "text")
    agg = t.groupBy("volume").agg(F.count_if(F.col("was") != "").alias("altered"), F.count_if((F.col("was") != "") & ~F.col("was").eqNullSafe(F.col("text"))).alias("reported"))
    return agg.withColumn("reconciled", F.col("altered") == F.col("reported"))


@register("SELECT coalesce(v.verdict, 'none') AS verdict, count(*) AS n FROM (SELECT DISTINCT unit_id FROM units) u LEFT JOIN verification v USING (unit_id) GROUP BY ALL")
def ref_G15_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Units by verdict, those without one counted as none."""
    joined = load(spark, d, "units", "unit_id").distinct().join(load(spark, d, "verification", "unit_id", "verdict"), "unit_id", "left")
    return joined.groupBy(F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@register("SELECT volume, page, zone, band, min(y) AS top, max(y) AS bottom, count(*) AS lines FROM (SELECT volume, page, zone, y, (row_number() OVER (PARTITION BY volume, page, zone ORDER BY line_no, line_id) - 1) // 6 AS band FROM page_lines) GROUP BY ALL")
def ref_G17_bands(spark: SparkSession, d: str) -> DataFrame:
    """Extents of bands of six lines in each zone of a page."""
    order = Window.partitionBy("volume", "page", "zone").orderBy("line_no", "line_id")
    base = load(spark, d, "page_lines", "volume", "page", "zone", "y", "line_no", "line_id").withColumn("band", F.floor((F.row_number().over(order) - 1) / 6))
    return base.groupBy("volume", "page", "zone", "band").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.count("*").alias("lines"))


@register("SELECT witness, count(*) AS paragraphs, sum(length(text))::BIGINT AS characters, sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g')))::BIGINT AS letters FROM corpus GROUP BY witness")
def ref_G18_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, characters and letters of each witness."""
    return load(spark, d, "corpus", "witness", "text").groupBy("witness").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("letters"))


# --- voting and repair

_ALL = f"rd AS (SELECT token_id AS token, 0 AS n, text AS form, 'eye' AS witness FROM tokens WHERE text IS NOT NULL AND len(alt) > 0 UNION ALL SELECT token_id, i, a.form, a.witness FROM (SELECT token_id, unnest(alt) AS a, generate_subscripts(alt, 1) AS i FROM tokens WHERE text IS NOT NULL) WHERE a.form IS NOT NULL), rr AS (SELECT *, {duck.bare('form')} AS bare, CASE witness WHEN 'eye' THEN 0 WHEN 'layer' THEN 1 WHEN 'tesseract' THEN 2 ELSE 3 END AS r FROM rd)"


def _readings(spark: SparkSession, d: str) -> DataFrame:
    base = load(spark, d, "tokens", "token_id", "text", "alt").where("text is not null and size(alt) > 0")
    own = base.select(F.col("token_id").alias("token"), F.lit(0).alias("n"), F.col("text").alias("form"), F.lit("eye").alias("witness"))
    other = base.select("token_id", F.posexplode("alt").alias("n", "a")).select(F.col("token_id").alias("token"), (F.col("n") + 1).alias("n"), F.col("a.form").alias("form"), F.col("a.witness").alias("witness"))
    return own.unionByName(other).where("form is not null")


@register(f"WITH {_ALL} SELECT token, bare, count(DISTINCT witness) AS weight, count(*) AS readings, arg_min(form, r * 1000 + n) AS form FROM rr GROUP BY token, bare")
def ref_V1_votes(spark: SparkSession, d: str) -> DataFrame:
    """Instruments behind each form of a token read in more ways than one."""
    return witness.votes(_readings(spark, d)).drop("first")


_DECIDE = f"""WITH {duck.LEX}, {_ALL}, f AS (SELECT DISTINCT bare AS word FROM rr), k AS (SELECT word, {duck.attested('word')} AS good FROM f),
a AS (SELECT rr.*, good, bool_or(good) OVER (PARTITION BY token) AS any_good FROM rr JOIN k ON k.word = rr.bare),
g AS (SELECT token, bare, count(DISTINCT witness) AS weight, count(*) AS size, arg_min(form, r * 1000 + n) AS form, min(r * 1000 + n) AS fst FROM a WHERE good OR NOT any_good GROUP BY token, bare),
t AS (SELECT token, form AS top, size AS top_size FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY weight DESC, fst) AS k FROM g) WHERE k = 1),
s AS (SELECT token, count(*) AS al, count(DISTINCT bare) AS forms, arg_min(form, n) AS first_read, arg_min(form, r * 1000 + n) AS trusted, count_if(good) AS goods, arg_min(form, r * 1000 + n) FILTER (good) AS trusted_good, arg_min(form, n) FILTER (witness = 'eye') AS eye, arg_min(good, n) FILTER (witness = 'eye') AS eye_good FROM a GROUP BY token),
b AS (SELECT *, {duck.bare('eye')} AS p, {duck.bare('top')} AS q FROM s JOIN t USING (token)),
w AS (SELECT *, CASE WHEN forms = 1 AND al > 1 THEN 'agree' WHEN length(p) = length(q) AND p <> q AND len(list_filter(generate_series(1, length(p)), lambda i: substr(p, i, 1) <> substr(q, i, 1) AND substr(p, i, 1) || substr(q, i, 1) NOT IN ({_STROKES}))) = 0 AND (eye_good OR goods = 0) THEN 'seen' WHEN top_size > 1 THEN 'most' WHEN goods = 1 THEN 'lex' WHEN goods > 1 THEN 'keep' ELSE 'doubt' END AS why FROM b),
dc AS (SELECT token, why, CASE why WHEN 'agree' THEN first_read WHEN 'seen' THEN eye WHEN 'most' THEN top WHEN 'lex' THEN trusted_good WHEN 'keep' THEN trusted_good ELSE trusted END AS form FROM w)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    readings = _readings(spark, d).withColumn("bare", normal.bare("form"))
    return witness.decisions(lexicon.attested(readings, _lexicon(spark, d), "bare").drop("bare"))


@register(_DECIDE + " SELECT token, form, why FROM dc")
def ref_V2_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The word chosen among the readings, and the reason."""
    return _decided(spark, d)


@register(_DECIDE + f" SELECT rr.token, rr.form, arg_min(rr.witness, rr.n) AS witness FROM rr JOIN dc USING (token) WHERE rr.bare <> {duck.bare('dc.form')} GROUP BY rr.token, rr.form")
def ref_V3_losers(spark: SparkSession, d: str) -> DataFrame:
    """Forms that lost, credited to the first instrument."""
    return witness.losers(_readings(spark, d), _decided(spark, d))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    """(word, protected) of the unattested forms of three letters or more.

    An occurrence is protected if its arbitration is sure or another reader of
    its page has the form; a form may occur both ways.
    """
    t = load(spark, d, "tokens", "volume", "page", "text", "why", "alt").where("text is not null")
    forms = t.select("volume", "page", F.coalesce(F.col("why").isin(*repair.SURE), F.lit(False)).alias("sure"), F.explode(tokens.words("text")).alias("w")).select("volume", "page", "sure", normal.fold("w").alias("word"))
    held = lexicon.attested(forms.where("length(word) >= 3").distinct(), _lexicon(spark, d)).where("not attested")
    layer = load(spark, d, "page_lines", "volume", "page", "text").where("text is not null").select("volume", "page", F.explode(F.split("text", " ")).alias("x"))
    others = t.select("volume", "page", F.explode("alt").alias("a")).select("volume", "page", F.col("a.form").alias("x")).where("x is not null")
    seen = layer.unionByName(others).select("volume", "page", normal.bare("x").alias("word")).distinct().withColumn("seen", F.lit(True))
    return held.join(seen, ["volume", "page", "word"], "left").select("word", (F.col("sure") | F.coalesce("seen", F.lit(False))).alias("protected")).distinct()


@register()
def ref_V6_variants(spark: SparkSession, d: str) -> DataFrame:
    """Attested forms up to two learned confusions from each unattested form, one strong confusion where it is protected."""
    return repair.candidates(_broken(spark, d), repair.confusions(_misreadings(spark, d)), _lexicon(spark, d))


@register()
def ref_V7_picked(spark: SparkSession, d: str) -> DataFrame:
    """The one repair of each unattested form, or one that dwarfs the others."""
    return repair.picked(ref_V6_variants(spark, d), _lexicon(spark, d))


_V8 = f"WITH {duck.LEX}, seams AS ({_SEAMS}), forms AS ({_FORMS}), c AS (SELECT word, unnest(generate_series(2, length(word) - 2)) AS i FROM forms WHERE length(word) >= 4), x AS (SELECT word, substr(word, 1, i) AS l, substr(word, i + 1) AS r FROM c), y AS (SELECT x.* FROM x SEMI JOIN seams ON x.l = seams.a AND x.r = seams.b WHERE {duck.attested('l')} AND {duck.attested('r')}) SELECT word, min(l) AS \"left\", min(r) AS \"right\" FROM y GROUP BY word HAVING count(*) = 1"


@register(_V8)
def ref_V8_splits(spark: SparkSession, d: str) -> DataFrame:
    """Forms with just one witnessed cut into two attested words."""
    return repair.splits(_forms(spark, d).select("word"), _seams(spark, d), _lexicon(spark, d))


@register(f"WITH {duck.LEX} SELECT token_id, shut FROM (SELECT token_id, {duck.fold(duck.letters('text'))} AS shut FROM tokens WHERE text IS NOT NULL AND len({duck.words('text')}) > 1 AND NOT regexp_matches(text, '[־‐‑‒–—-]')) WHERE {duck.attested('shut')}")
def ref_V9_closed(spark: SparkSession, d: str) -> DataFrame:
    """Wedged tokens whose letters close up to an attested word."""
    wedged = load(spark, d, "tokens", "token_id", "text").where("text is not null").where(tokens.is_damaged("text")).select("token_id", normal.fold(normal.letters_only("text")).alias("shut"))
    return lexicon.attested(wedged, _lexicon(spark, d), "shut").where("attested").select("token_id", "shut")


@register()
def ref_V11_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    """Two rounds of repair, the confusion table learned anew in between."""
    lex = _lexicon(spark, d)
    return repair.fixed_point(_broken(spark, d), repair.confusions(_misreadings(spark, d)), lex, lex)


# --- spans, windows, ranking, search

_SPANS = "sp AS (SELECT line_id, s.span_start AS start_at, s.span_end AS end_at FROM (SELECT line_id, unnest(display) AS s FROM page_lines) WHERE s IS NOT NULL)"


def _display(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "page_lines", "line_id", "display").select("line_id", F.explode("display").alias("s")).where("s is not null").select("line_id", F.col("s.span_start").alias("start_at"), F.col("s.span_end").alias("end_at"))


@register(f"WITH {_SPANS}, m AS (SELECT *, CASE WHEN start_at > max(end_at) OVER (PARTITION BY line_id ORDER BY start_at, end_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM sp), i AS (SELECT *, sum(new) OVER (PARTITION BY line_id ORDER BY start_at, end_at ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT line_id, min(start_at) AS start_at, max(end_at) AS end_at FROM i GROUP BY line_id, island")
def ref_W1_merged(spark: SparkSession, d: str) -> DataFrame:
    """Unions of touching display spans."""
    return windows.merged_intervals(_display(spark, d), ["line_id"], "start_at", "end_at")


@register()
def ref_W2_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Display spans and abbreviation marks of a line without conflicts."""
    quotes = _display(spark, d).select("line_id", F.col("start_at").cast("long"), F.col("end_at").cast("long"), F.lit("q").alias("kind"), F.lit(0).cast("long").alias("n"))
    marks = tokens.spans(load(spark, d, "page_lines", "line_id", "text"), "line_id", "text").where(F.col("token").rlike("[״׳\"]")).select("line_id", F.col("start_at").cast("long"), F.col("end_at").cast("long"), F.lit("note").alias("kind"), F.col("n").cast("long"))
    return spans.resolve(quotes.unionByName(marks), "line_id")


@register(f"WITH {_SPANS} SELECT p.volume, p.page, sp.line_id, start_at, end_at, row_number() OVER (PARTITION BY p.volume, p.page ORDER BY p.line_no, sp.line_id, start_at) AS note_no FROM sp JOIN page_lines p USING (line_id)")
def ref_W4_notes(spark: SparkSession, d: str) -> DataFrame:
    """Spans numbered from 1 on each page."""
    at = load(spark, d, "page_lines", "line_id", "volume", "page", "line_no")
    joined = _display(spark, d).join(at, "line_id").withColumn("place", F.struct("line_no", "line_id", "start_at"))
    return spans.numbered(joined, ["volume", "page"], "place").select("volume", "page", "line_id", "start_at", "end_at", "note_no")


@register("SELECT unit_id, volume, page, token_at, lead(page) OVER o AS next_page, lead(token_at) OVER o AS next_token FROM (SELECT DISTINCT unit_id, volume, page, token_at FROM units) WINDOW o AS (PARTITION BY volume ORDER BY page, token_at, unit_id)")
def ref_W5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Where each unit ends: at the next one's start."""
    order = Window.partitionBy("volume").orderBy("page", "token_at", "unit_id")
    u = load(spark, d, "units", "unit_id", "volume", "page", "token_at").distinct()
    return u.withColumn("next_page", F.lead("page").over(order)).withColumn("next_token", F.lead("token_at").over(order))


@register("SELECT volume, page, rn - 1 AS opens_at FROM (SELECT volume, page, nl, row_number() OVER (PARTITION BY volume, page ORDER BY pos, token_id) AS rn FROM tokens) WHERE nl")
def ref_W7_line_starts(spark: SparkSession, d: str) -> DataFrame:
    """Index of the word that opens each line of a page."""
    order = Window.partitionBy("volume", "page").orderBy("pos", "token_id")
    return load(spark, d, "tokens", "volume", "page", "pos", "token_id", "nl").withColumn("rn", F.row_number().over(order)).where("nl").select("volume", "page", (F.col("rn") - 1).alias("opens_at"))


@register("SELECT token_id, at_word, first_value(at_word IGNORE NULLS) OVER (PARTITION BY volume, page ORDER BY pos, token_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_at FROM tokens")
def ref_W8_next_placed(spark: SparkSession, d: str) -> DataFrame:
    """The next placed word behind each one."""
    ahead = Window.partitionBy("volume", "page").orderBy("pos", "token_id").rowsBetween(1, Window.unboundedFollowing)
    return load(spark, d, "tokens", "token_id", "volume", "page", "pos", "at_word").select("token_id", "at_word", F.first("at_word", ignorenulls=True).over(ahead).alias("next_at"))


@register("SELECT unit_id, score, chars FROM verification WHERE score IS NOT NULL ORDER BY score, chars DESC, unit_id LIMIT 40")
def ref_W9_worklist(spark: SparkSession, d: str) -> DataFrame:
    """The forty worst units."""
    return load(spark, d, "verification", "unit_id", "score", "chars").where("score is not null").orderBy("score", F.desc("chars"), "unit_id").limit(40)


@register("WITH f AS (SELECT token_id, text FROM (SELECT token_id, text, row_number() OVER (PARTITION BY text ORDER BY token_id) AS k FROM tokens WHERE text IS NOT NULL) WHERE k = 1), r AS (SELECT *, row_number() OVER (ORDER BY token_id) AS rank, count(*) OVER () AS total FROM f) SELECT token_id, text FROM r WHERE total <= 300 OR rank = 1 OR floor((rank - 1) * 300 / total) > floor((rank - 2) * 300 / total)")
def ref_W10_stride(spark: SparkSession, d: str) -> DataFrame:
    """An even stride of 300 first occurrences."""
    return spans.first_stride(load(spark, d, "tokens", "token_id", "text").where("text is not null"), "text", ["token_id"], 300)


@register("SELECT unit_id, argmax, distance FROM verification WHERE verdict = 'disagree' ORDER BY distance DESC, unit_id LIMIT 12")
def ref_W11_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """The twelve farthest disagreements."""
    return load(spark, d, "verification", "unit_id", "argmax", "distance", "verdict").where("verdict = 'disagree'").orderBy(F.desc("distance"), "unit_id").limit(12).drop("verdict")


@register()
def ref_Q1_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a folded word with their context, the first 400."""
    return search.occurrences(load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null"), ["volume", "page", "line_no", "line_id"], "text", "אשר")


@register("SELECT volume, count_if(contains(text, 'אשר')) AS hits, count(*) AS paragraphs FROM page_lines GROUP BY volume")
def ref_Q2_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each volume that hold a word."""
    return search.filtered(load(spark, d, "page_lines", "volume", "text"), "volume", "text", "אשר")


@register("SELECT unit_id, volume, lag(unit_id) OVER o AS previous, lead(unit_id) OVER o AS following FROM (SELECT DISTINCT unit_id, volume, page FROM units) WINDOW o AS (PARTITION BY volume ORDER BY page, unit_id)")
def ref_Q3_navigation(spark: SparkSession, d: str) -> DataFrame:
    """The units before and after each one."""
    return search.navigation(load(spark, d, "units", "unit_id", "volume", "page").distinct(), "volume", ["page", "unit_id"], "unit_id").drop("page")


# --- sources and sinks

_PAGES = "pg AS (SELECT volume, page, '===== PDF3 page ' || page || ' =====' || chr(10) || string_agg(text, chr(10) ORDER BY line_no, text) AS value FROM page_lines WHERE text IS NOT NULL GROUP BY volume, page)"


@register(f"WITH {_PAGES} SELECT volume, page, value FROM pg")
def ref_K2_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Pages under their banners, with the lines as printed."""
    return sinks.transcript_pages(load(spark, d, "page_lines", "volume", "page", "line_no", "text"))


@register(f"WITH {_PAGES} SELECT volume, page, length(value) - length('===== PDF3 page ' || page || ' =====') - 1 AS size FROM pg")
def ref_S3_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts read back page by page."""
    pages = sinks.transcript_pages(load(spark, d, "page_lines", "volume", "page", "line_no", "text"))
    return transcript.transcript(pages.select("volume", "value"), "value", keep=("volume",)).select("volume", "page", F.length("body").alias("size"))


@register("WITH u AS (SELECT part_no, chapter, string_agg(unit_id, ' ' ORDER BY unit_id) AS text FROM (SELECT DISTINCT part_no, chapter, unit_id FROM units) GROUP BY ALL), s AS (SELECT part_no, unnest(generate_series(1, m)) AS chapter FROM (SELECT part_no, max(chapter) AS m FROM corpus WHERE kind = 'ch' GROUP BY ALL)) SELECT part_no, chapter, coalesce(text, '[absent]') AS text FROM s LEFT JOIN u USING (part_no, chapter)")
def ref_K4_study_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter with its units, absences stated."""
    units = load(spark, d, "units", "part_no", "chapter", "unit_id").distinct().groupBy("part_no", "chapter").agg(F.array_join(F.array_sort(F.collect_list("unit_id")), " ").alias("text"))
    last = load(spark, d, "corpus", "kind", "part_no", "chapter").where("kind = 'ch'").groupBy("part_no").agg(F.max("chapter").alias("last"))
    return sinks.chapter_pack(last, units)


@register("SELECT part_no, count(*) AS n, string_agg(chapter || '=' || size, ' ' ORDER BY chapter) AS chapters FROM (SELECT part_no, chapter, sum(length(text)) AS size FROM corpus WHERE kind = 'ch' GROUP BY ALL) GROUP BY part_no")
def ref_K5_package(spark: SparkSession, d: str) -> DataFrame:
    """Chapter sizes of each part, packed in one map."""
    sized = load(spark, d, "corpus", "kind", "part_no", "chapter", "text").where("kind = 'ch'").groupBy("part_no", "chapter").agg(F.sum(F.length("text")).alias("size"))
    packed = sinks.library_package(sized.withColumn("text", F.concat(F.col("chapter").cast("string"), F.lit("="), F.col("size").cast("string"))))
    return packed.select("part_no", "n", F.array_join(F.map_values("chapters"), " ").alias("chapters"))


# --- structure: candidates, anchors, scores, assignment


@register("SELECT volume, part_no, min(page * 100000 + token_at) AS anchor FROM units GROUP BY volume, part_no")
def ref_P10_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Where each part begins in each volume."""
    return load(spark, d, "units", "volume", "part_no", "page", "token_at").groupBy("volume", "part_no").agg(F.min(F.col("page").cast("long") * 100000 + F.col("token_at")).alias("anchor"))


def _page_scores(spark: SparkSession, d: str) -> DataFrame:
    """(volume, page, section, score): containment of each page's 4-grams in each chapter sharing any."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text")))
    words = load(spark, d, "page_lines", "volume", "page", "line_no", "line_id", "text").where("text is not null").groupBy("volume", "page").agg(F.concat_ws("", F.transform(ordered, lambda s: s["text"])).alias("text"))
    pages = words.select("volume", "page", tokens.grams(normal.letters_only("text"), 4).alias("g")).where("size(g) > 0")
    chapters = load(spark, d, "corpus", "kind", "lang", "part_no", "chapter", "text").where("kind = 'ch' and lang = 'he'")
    held = chapters.select((F.col("part_no") * 1000 + F.col("chapter")).alias("section"), F.explode(tokens.grams(normal.letters_only("text"), 4)).alias("gram")).distinct()
    hits = pages.select("volume", "page", F.size("g").alias("n"), F.explode("g").alias("gram")).join(held, "gram").groupBy("volume", "page", "section").agg((F.count("*") / F.first("n")).alias("score"))
    return hits


def _by_volume(frame: DataFrame, solve: Callable[[list, list, list], list], names: str) -> DataFrame:
    """`solve` on the page × chapter matrix of each volume, an outline of pages and at most some hundred chapters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="page", columns="section", values="score", fill_value=0.0).sort_index()
        pages, sections = table.index.tolist(), table.columns.tolist()
        rows = [(pdf["volume"].iloc[0], pages[i], sections[j]) for i, j in solve(table.values.tolist(), pages, sections)]
        return pd.DataFrame(rows, columns=names.split())

    return frame.groupBy("volume").applyInPandas(run, "volume string, page int, section int")


@register()
def ref_J5_monotone_pages(spark: SparkSession, d: str) -> DataFrame:
    """A chapter for each page, never falling back within a volume."""
    return _by_volume(_page_scores(spark, d), lambda scores, pages, sections: list(enumerate(alignment.monotone_pages(scores))), "volume page section")


@register()
def ref_J7_numbered_chain(spark: SparkSession, d: str) -> DataFrame:
    """The best chain of the units' chapter numbers in each volume."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page", "token_at", "unit_id"]).reset_index(drop=True)
        chain = alignment.numbered_chain(pdf["chapter"].tolist(), {1: 76, 2: 48, 3: 54})
        return pd.DataFrame([(pdf["volume"][i], pdf["unit_id"][i], part) for i, part in chain], columns=["volume", "unit_id", "part"])

    units = load(spark, d, "units", "volume", "unit_id", "page", "token_at", "chapter").where("chapter > 0").distinct()
    return units.groupBy("volume").applyInPandas(run, "volume string, unit_id string, part int")


@register(f"WITH {_RANGES} SELECT volume, w * 2000 AS from_at, count(*) AS pages, min(page) AS first_page FROM (SELECT volume, page, unnest(generate_series(start_at // 2000, (start_at + n - 1) // 2000)) AS w FROM r) GROUP BY volume, w")
def ref_J13_window_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that each window of 2,000 characters touches."""
    held = _ranges(spark, d).select("volume", "page", F.explode(F.expr("sequence(start_at div 2000, (end_at - 1) div 2000)")).alias("w"))
    return held.groupBy("volume", (F.col("w") * 2000).alias("from_at")).agg(F.count("*").alias("pages"), F.min("page").alias("first_page"))


@register()
def ref_J17_elisions(spark: SparkSession, d: str) -> DataFrame:
    """Substitutions where only one side is an etcetera, and the two pairs behind each as its debris."""
    order = Window.partitionBy("volume", "page").orderBy("n")
    mark = r"^(?:וכו|וגו|וג|etc|usw)[׳'.]*$"
    pairs = _aligned(spark, d).withColumn("elided", F.coalesce(F.col("own").rlike(mark) & ~F.col("word").rlike(mark), F.lit(False)))
    debris = F.coalesce(F.lag("elided", 1).over(order), F.lit(False)) | F.coalesce(F.lag("elided", 2).over(order), F.lit(False))
    return pairs.withColumn("debris", debris).where("elided or debris").select("volume", "page", "n", "own", "word", "elided", "debris")


@register()
def ref_V4_insertions(spark: SparkSession, d: str) -> DataFrame:
    """Words of the lines that the tokens lack, as runs before the word they come in front of."""
    inserted = alignment.projected(_aligned(spark, d), ["volume", "page"]).where("inserted")
    return inserted.groupBy("volume", "page", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "word"))), lambda s: s["word"]), " ").alias("words"))


_LAYER = f"ly AS (SELECT DISTINCT volume, page, {duck.bare('x')} AS w FROM (SELECT volume, page, unnest(string_split(text, ' ')) AS x FROM page_lines WHERE text IS NOT NULL))"


@register(f"WITH {_LAYER}, f AS (SELECT token_id, volume, page, w, lead(w) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM (SELECT token_id, volume, page, pos, {duck.bare('text')} AS w FROM tokens WHERE text IS NOT NULL) WINDOW o AS (PARTITION BY volume, page ORDER BY pos, token_id)), c AS (SELECT token_id, volume, page, 2 AS n, w || w1 AS whole FROM f WHERE w <> '' AND w1 <> '' UNION ALL SELECT token_id, volume, page, 3, w || w1 || w2 FROM f WHERE w <> '' AND w1 <> '' AND w2 <> '') SELECT token_id, max(n) AS fragments FROM c JOIN ly ON c.volume = ly.volume AND c.page = ly.page AND c.whole = ly.w GROUP BY token_id")
def ref_V5_welds(spark: SparkSession, d: str) -> DataFrame:
    """Two or three fragments whose joined form the lines of the page have whole, the longest run for each first fragment."""
    layer = load(spark, d, "page_lines", "volume", "page", "text").where("text is not null").select("volume", "page", F.explode(F.split("text", " ")).alias("x")).select("volume", "page", normal.bare("x").alias("whole")).distinct()
    base = load(spark, d, "tokens", "token_id", "volume", "page", "pos", "text").where("text is not null").withColumn("w", normal.bare("text"))
    ahead = tokens.neighbours(base, ["volume", "page"], ["pos", "token_id"], "w", 2).where("w != '' and word_1 != ''")
    runs = F.array(F.struct(F.lit(2).alias("n"), F.concat("w", "word_1").alias("whole")), F.when(F.col("word_2") != "", F.struct(F.lit(3).alias("n"), F.concat("w", "word_1", "word_2").alias("whole"))))
    parts = ahead.select("token_id", "volume", "page", F.explode(runs).alias("r")).where("r is not null").select("token_id", "volume", "page", "r.n", "r.whole")
    return parts.join(layer, ["volume", "page", "whole"], "left_semi").groupBy("token_id").agg(F.max("n").alias("fragments"))


@register()
def ref_W3_snapped(spark: SparkSession, d: str) -> DataFrame:
    """Display spans moved out to whole words."""
    lines = load(spark, d, "page_lines", "line_id", "text").where("text is not null")
    return spans.snapped(_display(spark, d).join(lines, "line_id"), "text").select("line_id", "start_at", "end_at")


@register("SELECT line_id, replace(text, ' ', '') AS joined FROM page_lines WHERE regexp_matches(text, '^(?:[^ ] ){2,}[^ ]$')")
def ref_W6_spaced_runs(spark: SparkSession, d: str) -> DataFrame:
    """Lines set in single spaced letters, closed up."""
    base = load(spark, d, "page_lines", "line_id", "text").where(F.col("text").rlike("^(?:[^ ] ){2,}[^ ]$"))
    return base.select("line_id", F.regexp_replace("text", " ", "").alias("joined"))


@register()
def ref_G16_order(spark: SparkSession, d: str) -> DataFrame:
    """Upper median over pages of the share of words in the longest increasing chain."""
    chain = ref_E5_chain(spark, d).groupBy("unit").agg(F.count("*").alias("kept"))
    size = ref_J4_anchors(spark, d).select(F.concat_ws(":", "volume", "page").alias("unit"), "anchors").where("anchors >= 2")
    ratios = written(chain.join(size, "unit").select(F.round(F.least(F.lit(1.0), F.col("kept") / F.col("anchors")), 4).alias("r")), "ratios")
    n = ratios.count()
    return ratios.orderBy("r").offset(n // 2).limit(1).select(F.lit(n).alias("pages"), F.col("r").alias("median"))


@register("SELECT DISTINCT unit_id, volume, page, score FROM units")
def ref_K1_json(spark: SparkSession, d: str) -> DataFrame:
    """Units written as JSON and read back."""
    path = scratch(spark, "json")
    sinks.write_json(load(spark, d, "units", "unit_id", "volume", "page", "score").distinct(), path)
    return spark.read.schema("unit_id string, volume string, page int, score double").json(path)


