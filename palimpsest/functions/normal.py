"""Scalar normalisation of Hebrew and mixed text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Final letters and their medial forms; quote glyphs read as geresh and gershayim; points and accents (fixed values).
FINALS, MEDIALS = "ךםןףץ", "כמנפצ"
MARKS, PLAIN_MARKS = "'’\"”", "׳׳״״"
POINTS = "[֑-ׇ]"
GERESH = "׳״'\"’”"
MAQAF = "־‐‑‒–—-"
#: A word: letters, perhaps with a mark before exactly one last letter.
WORD = f"[א-ת]+(?:[{GERESH}][א-ת](?![א-ת]))?"
ONES, TENS = "אבגדהוזחט", "יכלמנסעפצ"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_points(c: Column | str) -> Column:
    """Without vowel points and accents."""
    return F.regexp_replace(_col(c), POINTS, "")


def fold(c: Column | str) -> Column:
    """Medial letters for finals, one glyph a mark, a geresh between letters read as gershayim."""
    return F.regexp_replace(F.translate(_col(c), FINALS + MARKS, MEDIALS + PLAIN_MARKS), "(?<=[א-ת])׳(?=[א-ת])", "״")


def letters_only(c: Column | str, alphabet: str = "א-ת") -> Column:
    """Folded letters of `alphabet`, nothing else."""
    return F.regexp_replace(F.translate(_col(c), FINALS, MEDIALS), f"[^{alphabet}]", "")


def bare(c: Column | str) -> Column:
    """The letters of the folded, unpointed word."""
    return letters_only(strip_points(c))


def reduced(c: Column | str) -> Column:
    """Struct of the folded letters and the offset each came from."""
    chars = F.split(_col(c), "")
    kept = F.filter(F.transform(chars, lambda x, i: F.struct(x.alias("c"), i.alias("i"))), lambda s: s["c"].rlike("^[א-ת]$"))
    return F.struct(
        F.translate(F.array_join(F.transform(kept, lambda s: s["c"]), ""), FINALS, MEDIALS).alias("letters"),
        F.transform(kept, lambda s: s["i"]).alias("offsets"),
    )


def without_markup(c: Column | str) -> Column:
    """Tags out, white space collapsed; null gives the empty string."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(_col(c), F.lit("")), "<[^>]*>", " "), "[ \\t\\n\\r\\f]+", " "))


def tidy(c: Column | str) -> Column:
    """printer's dirt to spaces, collapsed, edges trimmed of stops."""
    return F.btrim(F.regexp_replace(F.regexp_replace(_col(c), "[*|\\\\_^~•]", " "), "[ \\t\\n\\r\\f]+", " "), F.lit(" .,:;-·"))


def escaped(c: Column | str) -> Column:
    """The three characters HTML gives a meaning to."""
    return F.replace(F.replace(F.replace(_col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def searchable(c: Column | str) -> Column:
    """Tags to spaces, points and quotes out, finals folded."""
    return F.translate(F.regexp_replace(strip_points(F.regexp_replace(_col(c), "<[^>]*>", " ")), f"[{GERESH}]", ""), FINALS, MEDIALS)


def logical_order(c: Column | str) -> Column:
    """A line stored in visual order: reversed, brackets mirrored, digit and Latin runs turned back."""
    turned = F.translate(F.reverse(F.regexp_replace(_col(c), "[‎‏‪-‮]", "")), "()[]{}<>", ")(][}{><")
    pieces = F.regexp_extract_all(turned, F.lit("[0-9A-Za-z]+(?:[.,:/-][0-9A-Za-z]+)*|[^0-9A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[0-9A-Za-z]"), F.reverse(p)).otherwise(p)), "")


def clean_page(c: Column | str) -> Column:
    """Direction controls out, blanks collapsed, empty lines dropped."""
    lines = F.split(F.regexp_replace(_col(c), "[‎‏‪-‮⁦-⁩]", ""), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " "))), lambda x: x != ""), "\n")


def numeral(c: Column | str) -> Column:
    """1..99 as Hebrew letters, 15 and 16 by the custom; null outside."""
    n = _col(c).cast("int")
    plain = F.concat(F.when(n >= 10, F.substring(F.lit(TENS), F.floor(n / 10).cast("int"), F.lit(1))).otherwise(""), F.when(n % 10 > 0, F.substring(F.lit(ONES), n % 10, F.lit(1))).otherwise(""))
    return F.when(n == 15, "טו").when(n == 16, "טז").when((n >= 1) & (n <= 99), plain)


def gematria(c: Column | str) -> Column:
    """Value of letters in non-increasing order, null for any other string."""
    table = {x: i + 1 for i, x in enumerate(ONES)} | {x: 10 * (i + 1) for i, x in enumerate(TENS)} | {"ק": 100, "ך": 20, "ם": 40, "ן": 50, "ף": 80, "ץ": 90}
    lookup = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    values = F.transform(F.split(_col(c), ""), lambda x: F.element_at(lookup, x))
    sound = _col(c).rlike("^[אבגדהוזחטיכלמנסעפצקךםןףץ]+$")
    ordered = F.reverse(F.array_sort(values)) == values
    return F.when(sound & ordered, F.aggregate(values, F.lit(0), lambda a, b: a + b))


def spelled(c: Column | str) -> Column:
    """The final form restored at a word's end."""
    return F.concat(F.expr("substring({0}, 1, length({0}) - 1)".format(c if isinstance(c, str) else "word")), F.translate(F.substring(_col(c), -1, 1), MEDIALS, FINALS))


def script_runs(c: Column | str) -> Column:
    """Maximal runs of one script, neutral characters going with the run before them."""
    return F.regexp_extract_all(_col(c), F.lit("[א-ת][^A-Za-zÀ-ɏ]*|[A-Za-zÀ-ɏ][^א-ת]*"), F.lit(0))
