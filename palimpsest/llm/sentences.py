"""Problem 6: sentence ends across languages and scripts.

Ordered tables of (break or not, expression before, expression after) decide
each stop; the tables of the stop's language, then of its script, then the
common ones are tried, and the first match decides.  Lines of the scanned page
are read on past furniture, notes and page ends, so a closing mark may open the
next line or page; ends are reported at offsets of the value they stand in.

Null and empty texts have no end; repeated rows get the ends of their own text
in the same surroundings; paragraphs and lines are read whole.  Lines without
volume or page stand alone.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scans import furniture
from palimpsest.operators import windows

INVISIBLE = "​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
_HIDDEN = re.compile(f"[{INVISIBLE}]")
STOPS = ".!?…׃。！？؟۔።፧．｡"
CLOSERS = "\"”“»’'」』）)\\]"
#: A stop, perhaps after a space, with what closes the sentence, perhaps on the next line.
_CANDIDATE = re.compile(
    rf"(?P<stop>[{STOPS}](?:[{INVISIBLE}]*[{STOPS}])*)[{INVISIBLE}]*"
    rf"(?P<close>(?:[{CLOSERS}][{INVISIBLE}]*)*(?:\s[{INVISIBLE}]*[\"”“»’)\]]+[{INVISIBLE}]*(?=\s|$))?)"
)
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Tischri|Cheschwan|Marcheschwan|Kislew|Tewet|Tebet|Schewat|Schebat|Adar|Nissan|Nisan|Ijar|Ijjar|Siwan|Sivan|Tammus|Aw|Ab|Elul"
_CLOSED = r"[\"”“»’'」』）)\]]"

Rule = tuple[bool, str, str]
#: First match decides.  Expressions are searched in the text up to the stop and matched from behind it.
TABLES: dict[str, list[Rule]] = {
    "first": [
        (False, r"", rf"\s*{_CLOSED}+\s*[—–-]"),
        (False, r"(?:\.\s*\.|…)$", rf"{_CLOSED}*\s*\S"),
        (True, r"[׃。！？؟۔።፧!?．｡]$", r""),
        (False, r"", r"[^\s\"”“»«’'」』）)\]]"),
        (False, r"\d\.$", rf"{_CLOSED}*\d"),
    ],
    "he": [
        (True, r"(?<!\w)(?:עמ|סי|כת|מהד|הע|פ)\.\s+[א-ת]\.$", r""),
        (False, r"(?<!\w)(?:עמ|סי|כת|מהד|הע|פ|ר|עי|וכו|וגו)\.$", r"\s*\S"),
        (False, r"(?<![\w\"״׳'])[א-ת]\.$", r"\s*\S"),
    ],
    "de": [
        (False, rf"(?<![\d.,])\d{{1,2}}\.$", rf"\s+(?:{_MONTHS})\b"),
        (False, r"(?<!\w)(?:Nr|Kap|Bd|Bde|S|vgl|Vgl|Dr|Prof|Hrsg|hrsg|bzw|ca|Abb|Anm|geb|gest|Jh|St|Sp|Abt)\.$", r"\s*\S"),
        (False, r"(?<!\w)[a-z]\.(?:\s*[A-Za-z]\.)?$", r"\s*\S"),
    ],
    "en": [
        (False, r"(?<!\w)(?:Dr|Mr|Mrs|Prof|St|Rev|viz|i\.e|e\.g|cf|vs)\.$", r"\s*\S"),
        (False, r"(?<!\w)(?:vol|vols|ch|chap|no|nos|p|pp|fol|ed|sc|art|ca)\.$", r"\s+[\dIVXLC(a-z]"),
    ],
    "fr": [
        (False, r"(?<!\w)(?:vol|ch|chap|no|cf|p|pp|fol|éd|t|tom|Dr|M|Mme|Mlle|MM|St|art|sc|c\.-à-d|p\. ex)\.$", r"\s*\S"),
    ],
    "la": [
        (False, r"(?<!\w)(?:cf|fol|cap|lib|sc|viz|tom|p|vol|ed|art|Dr|D|M)\.$", r"\s*\S"),
    ],
    "Arabic": [(False, r"(?<!\w)\w\.$", r"\s*\S")],
    "Ethiopic": [(False, r"\.$", r"\s*\S")],
    "Han": [(False, r"\.$", r"\s*\S")],
    "Latin": [
        (False, r"(?<![\w.])[A-ZÀ-Þ]\.$", r"\s*\S"),
        (False, r"(?<!\w)(?:vol|ch|chap|no|cf|fol|éd|tom|lib|cap|Nr|Kap|Bd)\.$", r"\s+\d"),
        (False, r"\.$", rf"{_CLOSED}*\s+[a-zß-ÿœ]"),
    ],
    "last": [(True, r"", r"")],
}
_COMPILED = {name: [(b, re.compile(before), re.compile(after)) for b, before, after in rules] for name, rules in TABLES.items()}
_SCRIPTS = (("he", "֐", "׿"), ("Arabic", "؀", "ۿ"), ("Ethiopic", "ሀ", "፿"), ("Han", "぀", "鿿"))


def script_of(text: str, at: int) -> str:
    """Script of the last letter of `text` before `at`."""
    while at > 0:
        at -= 1
        c = text[at]
        if c.isalpha():
            return next((name for name, low, high in _SCRIPTS if low <= c <= high), "Latin")
    return "Latin"


class Languages:
    """Tells the languages of the Latin script by their function words."""

    def __init__(self, words: list[tuple[str, str]]):
        self.of: dict[str, list[str]] = {}
        for lang, word in words:
            self.of.setdefault(word.lower(), []).append(lang)

    def vote(self, text: str) -> str:
        votes: Counter[str] = Counter()
        for word in re.findall(r"[^\W\d_]+", text):
            own = self.of.get(word.lower(), ())
            for lang in own:
                if lang in ("de", "en", "fr", "la"):
                    votes[lang] += 1 / len(own)
        return max(sorted(votes), key=votes.__getitem__) if votes else "en"


#: Visible code points a rule may look at on either side of a stop, above the longest expression of the tables.
REACH = 40


def _beside(text: str, at: int, step: int) -> str:
    """The text before (`step` -1) or behind `at`, without hidden characters, spaces run together, to `REACH` code points or its edge."""
    width = REACH
    while True:
        raw = text[max(0, at - width) : at] if step < 0 else text[at : at + width]
        seen = re.sub(r"\s+", " ", _HIDDEN.sub("", raw))
        if len(seen) >= REACH or len(raw) < width:
            return seen
        width *= 2


def ends(text: str, latin: str) -> list[int]:
    """Offsets just behind each sentence of `text`; `latin` is the language of its Latin words."""
    out = []
    for m in _CANDIDATE.finditer(text):
        before, after = _beside(text, m.end("stop"), -1), _beside(text, m.end("stop"), 1)
        script = script_of(text, m.start())
        names = ("first", script, "last") if script != "Latin" else ("first", latin, "Latin", "last")
        for name in names:
            verdict = next((b for b, x, y in _COMPILED.get(name, ()) if x.search(before) and y.match(after)), None)
            if verdict is not None:
                if verdict:
                    out.append(m.end())
                break
    return out


def paragraph_ends(text: str, languages: Languages) -> list[int]:
    """Ends of an addenda paragraph; its own end always is one, lines of furniture have none."""
    lines = text.split("\n")
    shown = [(i, t) for i, t in enumerate(lines) if t.strip()]
    kinds = furniture([t.strip() for _, t in shown], edge_only=False) if len(shown) > 2 else [""] * len(shown)
    # a short line of one word may be the rest of a broken word
    kept = {i for (i, t), k in zip(shown, kinds) if not k or (k == "header" and i and " " not in t.strip() and lines[i - 1].rstrip()[-1:] in "-=־‐⸗¬­")}
    at, joined, offsets = 0, [], []
    for i, line in enumerate(lines):
        if i in kept:
            joined.append(line + "\n")
            offsets += range(at, at + len(line) + 1)
        at += len(line) + 1
    flowed = "".join(joined)
    found = {offsets[e - 1] + 1 for e in ends(flowed, languages.vote(flowed)) if flowed[e - 1] != "\n"}
    body = flowed.rstrip()
    if body:
        found.add(offsets[len(body) - 1] + 1)
    return sorted(found)


def line_ends(own: list[tuple[int, str]], before: str, after: str, languages: Languages) -> list[tuple[int, int]]:
    """(row, end) in the lines of one zone of a page, read with the line before and the line after."""
    pieces, where = [], []
    for row, text in ((None, before), *own, (None, after)):
        if text:
            pieces.append(text + "\n")
            where += [(row, i) for i in range(len(text) + 1)]
    flowed = "".join(pieces)
    out = []
    for end in ends(flowed, languages.vote(flowed)):
        row, offset = where[end - 1]
        if row is not None and flowed[end - 1] != "\n":
            out.append((row, offset + 1))
    return out


def page_ends(rows: list[dict], before: str, after: str, languages: Languages) -> list[tuple[int, int]]:
    """(row id, end) of a page's lines; `before` and `after`: the nearest body lines of the pages beside it, past their furniture."""
    first, seen, again = [], {}, []
    for r in rows:
        if r["at"] is not None and r["at"] in seen:
            again.append(r)
        else:
            seen[r["at"]] = r
            first.append(r)
    out = _read(first, before, after, languages)
    for r in again:
        if r["text"] == seen[r["at"]]["text"]:
            out += [(r["row_id"], e) for i, e in out if i == seen[r["at"]]["row_id"]]
        else:
            out += [(i, e) for i, e in _read([r if x["at"] == r["at"] else x for x in first], before, after, languages) if i == r["row_id"]]
    return out


def _read(rows: list[dict], before: str, after: str, languages: Languages) -> list[tuple[int, int]]:
    kinds = _kinds(rows)
    out = []
    for notes in (False, True):
        own = [(r["row_id"], r["text"]) for r, k in zip(rows, kinds) if not k and r["notes"] == notes]
        out += line_ends(own, "" if notes else before, "" if notes else after, languages)
    return out


def _kinds(rows: list[dict]) -> list[str]:
    return furniture([r["text"] for r in rows], foot=max((i for i, r in enumerate(rows) if not r["notes"]), default=None))


_LANGUAGES: dict[str, Languages] = {}


def _languages(shared: tuple) -> Languages:
    if shared[0] not in _LANGUAGES:
        _LANGUAGES.clear()
        _LANGUAGES[shared[0]] = Languages(shared[1].value)
    return _LANGUAGES[shared[0]]


def _gathered(lines: DataFrame) -> DataFrame:
    """(volume, page, alone, rows, before, after): the lines of each page and the nearest body lines of the pages beside it.

    A page is a physical unit of bounded size.  Each lends its first and its
    last line that is neither furniture nor a note; these join the lines of the
    pages beside it before they are gathered, so no page is joined.
    """
    rows = lines.where("text is not null").select(F.col("line_id").alias("row_id"), "volume", "page", F.col("line_no").alias("at"), "text", F.coalesce(F.col("zone") == "notes", F.lit(False)).alias("notes"))
    row = F.struct("at", "row_id", "text", "notes")

    def edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for volume, page, own in zip(frame["volume"], frame["page"], frame["rows"]):
                own = list(own)
                body = [r["text"] for r, k in zip(own, _kinds(own)) if not k and not r["notes"]]
                if body:
                    out += [(volume, page + 1, body[-1], -1), (volume, page - 1, body[0], 1)]
            yield pd.DataFrame(out, columns=["volume", "page", "text", "lent"])

    paged = rows.where("volume is not null and page is not null").groupBy("volume", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lent = paged.mapInPandas(edges, "volume string, page int, text string, lent int")
    alone = F.when(F.col("volume").isNull() | F.col("page").isNull(), F.col("row_id"))
    together = rows.withColumn("lent", F.lit(0)).unionByName(lent, allowMissingColumns=True).groupBy("volume", "page", alone.alias("alone"))
    neighbour = lambda side: F.coalesce(F.max(F.when(F.col("lent") == side, F.col("text"))), F.lit(""))
    gathered = together.agg(F.array_sort(F.collect_list(F.when(F.col("lent") == 0, row))).alias("rows"), neighbour(-1).alias("before"), neighbour(1).alias("after"))
    return gathered.where("size(rows) > 0")


def page_pieces(rows: list[dict], before: str, after: str, languages: Languages) -> list[tuple[bool, int, str, bool]]:
    """(notes, row id, piece, whether a sentence ends with it) of a page's lines in reading order, each place once, without furniture."""
    seen, first = set(), []
    for r in rows:
        if r["at"] is None or r["at"] not in seen:
            first.append(r)
        seen.add(r["at"])
    cuts: dict[int, list[int]] = {}
    for row, end in sorted(set(_read(first, before, after, languages))):
        cuts.setdefault(row, []).append(end)
    out = []
    for r in (r for r, k in zip(first, _kinds(first)) if not k):
        at = 0
        for end in (*cuts.get(r["row_id"], ()), len(r["text"])):
            if piece := r["text"][at:end].strip(" \n"):
                out.append((bool(r["notes"]), r["row_id"], piece, end in cuts.get(r["row_id"], ())))
            at = end
    return out


_PIECES = "volume string, page int, alone long, notes boolean, k int, row_id long, piece string, closes int"


def line_pieces(lines: DataFrame, words: list[tuple[str, str]]) -> DataFrame:
    """The pieces between sentence ends of all lines; k is their order in the page."""
    shared = uuid.uuid4().hex, lines.sparkSession.sparkContext.broadcast(words)

    def of_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages = _languages(shared)
        for frame in frames:
            out = []
            for volume, page, alone, own, past, come in zip(*(frame[c].astype(object) for c in ("volume", "page", "alone", "rows", "before", "after"))):
                found = page_pieces(list(own), past, come, languages)
                key = [None if pd.isna(x) else x for x in (volume, page, alone)]
                out += [(*key, notes, k, row, piece, int(closes)) for k, (notes, row, piece, closes) in enumerate(found)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ")]).astype({"page": "Int32", "alone": "Int64"})

    return _gathered(lines).mapInPandas(of_pages, _PIECES)


def line_sentences(pieces: DataFrame) -> DataFrame:
    """(volume, page, zone, row_id, sentence_no, sentence) of `pieces`, which several stages read.

    An open sentence of the body goes on over lines and pages to its end in
    the volume; numbers run through the volume, summed in buckets of pages.
    Notes and lines without a page end with their page.
    """
    body = pieces.where("not notes and alone is null").withColumn("slot", F.floor(F.col("page") / 64))
    running = windows.running_sum(body, ["volume"], "slot", ["page", "k"], "closes", "upto").withColumn("part", F.lit(None).cast("int"))
    inside = Window.partitionBy("volume", "page", "alone", "notes").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    others = pieces.where("notes or alone is not null").withColumn("upto", F.sum("closes").over(inside)).withColumn("part", F.col("page"))
    names = ["volume", "part", "alone", "notes", "page", "k", "row_id", "piece", (F.col("upto") - F.col("closes")).alias("sentence_no")]
    gathered = running.select(*names).unionByName(others.select(*names)).groupBy("volume", "part", "alone", "notes", "sentence_no").agg(F.array_sort(F.collect_list(F.struct("page", "k", "row_id", "piece"))).alias("p"))
    return gathered.select("volume", F.expr("p[0].page").alias("page"), F.when(F.col("notes"), "notes").otherwise("body").alias("zone"), F.expr("p[0].row_id").alias("row_id"), "sentence_no", F.expr("array_join(transform(p, x -> x.piece), '\n')").alias("sentence"))


_OUT = "tbl string, row_id long, elem int, end_at int"


def sentence_ends(addenda: DataFrame | None, lines: DataFrame | None, words: list[tuple[str, str]]) -> DataFrame:
    """(tbl, row_id, elem, end_at) of every sentence end; `words`: (language, function word), a short list.

    Lines are gathered by page, a physical unit, never by volume; the pages
    beside it lend their nearest body line.
    """
    spark = (addenda if addenda is not None else lines).sparkSession
    shared = uuid.uuid4().hex, spark.sparkContext.broadcast(words)
    parts = []
    if addenda is not None:
        texts = addenda.select("addenda_id", F.posexplode("text").alias("elem", "text")).where("text is not null")

        def of_paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            languages = _languages(shared)
            for frame in frames:
                rows = [("addenda_munich", key, elem, e) for key, elem, text in zip(frame["addenda_id"], frame["elem"], frame["text"]) for e in paragraph_ends(text, languages)]
                yield pd.DataFrame(rows, columns=["tbl", "row_id", "elem", "end_at"])

        parts.append(texts.mapInPandas(of_paragraphs, _OUT))
    if lines is not None:
        joined = _gathered(lines).select("rows", "before", "after")

        def of_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            languages = _languages(shared)
            for frame in frames:
                out = []
                for own, past, come in zip(frame["rows"], frame["before"], frame["after"]):
                    found = page_ends(list(own), past, come, languages)
                    out += [("page_lines", i, 0, e) for i, e in sorted(set(found))]
                yield pd.DataFrame(out, columns=["tbl", "row_id", "elem", "end_at"])

        parts.append(joined.mapInPandas(of_pages, _OUT))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
