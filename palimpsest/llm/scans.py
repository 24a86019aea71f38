"""Problem 2: noise in text from scanned pages.

Pages (and addenda paragraphs) are taken as units of lines.  Page furniture is
told by geometry: a short first line is a running head, a line of nothing but a
number and ornament a page number.  A word broken at a line's end carries a
break mark and is whole again with the next line's first word.  Any other word
that the vocabulary lacks is looked up by a Levenshtein automaton over the
vocabulary trie, which gives every candidate within the bound, general edits
too; they are ranked by cost, then by their neighbours in the clean corpus,
then by frequency.  A candidate by shape confusions makes the word a
misreading, one by a general edit only if its neighbours attest it, so that
proper names stay.

Null texts hold no noise and no words; empty lines are kept out of the reflowed
text; repeated rows (same natural key) are each judged by themselves in the
same surroundings; rows without volume or page are pages of their own; a word
of any length is looked at whole.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from statistics import median

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.automaton import OTHER, SHAPE, Trie

BREAKS = "-=־‐‑⸗¬­"
SHORT = 0.62
SHAPE_BOUND, MARK_BOUND = 4, 5
_BREAK = re.compile(rf"(?<=[^\W\d_])[{BREAKS}]\s*$")
_NUMBER = re.compile(r"[\W_]*[0-9OolIS|]{0,3}[0-9][0-9OolIS|]{0,3}[\W_]*")
_LETTER_NUMBER = re.compile(r"[\W_]*([א-ת]{1,2}[\"״']?[א-ת]{0,2}|[ivxlc]{1,7})[\W_]*")
_DECORATED = re.compile(r"(?:[-–—*]+ |\[|\()([א-ת]{1,2}[\"״']?[א-ת]{0,2}|[ivxlc]{1,7})(?: [-–—*]+|\]|\))")
_EDGES = ".,:;!?…\"“”„«»‹›()[]{}׃—–،؟۔"
_STRAY = re.compile(r"(?<=[^\W\d_])[\\|^_•~*](?=[^\W\d_])|^[\\|^_~](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[\\|^_~]$")
_LETTERS = re.compile(r"[^\W\d_]+")
_VALUES = {c: step * (i + 1) for step, cs in ((1, "אבגדהוזחט"), (10, "יכלמנסעפצ"), (100, "קרשת")) for i, c in enumerate(cs)}
_LOOKALIKE = str.maketrans("аеорсухѕіјοαρυνι", "aeopcyxsijoapuvi")


def numeral(word: str) -> int | None:
    """Value of a canonical Hebrew numeral, None for any other string."""
    letters = re.sub("[\"״']", "", word)
    values = [_VALUES.get(c, 0) for c in letters]
    if not values or 0 in values or (values != sorted(values, reverse=True) and letters not in ("טו", "טז")):
        return None
    return sum(values)


def plain(word: str) -> str:
    """Compatibility forms, points, invisible characters and look-alikes removed."""
    if word.isascii():
        return word
    if re.search("[װ-ײ]", word):
        word = word.replace("װ", "וו").replace("ױ", "וי").replace("ײ", "יי")
    folded = unicodedata.normalize("NFKD", word)
    kept = "".join(c for c in folded if unicodedata.category(c) not in ("Mn", "Cf"))
    if "Ͱ" <= max(kept, default="") and re.search("[Ͱ-ӿ]", kept) and re.search("[A-Za-z]", kept):
        kept = kept.translate(_LOOKALIKE)
    if any(c in "äöüéèêàçùâîôûÄÖÜÉÈ" for c in unicodedata.normalize("NFC", word)):
        marks = "".join(c for c in folded if unicodedata.category(c) != "Cf")
        return unicodedata.normalize("NFC", marks.translate(_LOOKALIKE) if re.search("[Ͱ-ӿ]", marks) else marks)
    return kept


class Reader:
    """Vocabulary, its trie, and the pairs of neighbouring words of the clean corpus, in flat arrays."""

    def __init__(self, words: list[tuple[str, int]], pairs: list[tuple[str, str]]):
        self.trie = Trie(words + [(w.lower(), n) for w, n in words if w != w.lower()])
        self.pairs = np.unique(np.array([_pair(a, b) for a, b in pairs], np.uint64))
        self._cache()

    def _cache(self) -> None:
        self.judged = lru_cache(maxsize=200_000)(self._judged)

    def __getstate__(self) -> tuple:
        return self.trie, self.pairs

    def __setstate__(self, state: tuple) -> None:
        self.trie, self.pairs = state
        self._cache()

    def knows(self, word: str) -> bool:
        return word in self.trie or word.lower() in self.trie

    def attests(self, a: str, b: str) -> bool:
        """Whether `b` follows `a` somewhere in the clean corpus."""
        h = np.uint64(_pair(a, b))
        i = int(np.searchsorted(self.pairs, h))
        return i < len(self.pairs) and bool(self.pairs[i] == h)

    def candidates(self, word: str) -> list[tuple[int, int, str]]:
        """Every vocabulary word within the bound of the word's length: a general edit from four letters on, a shape more from nine."""
        letters = sum(c.isalpha() for c in word)
        bound = (SHAPE_BOUND if word.isalpha() else MARK_BOUND) if letters < 4 else OTHER if letters < 9 else OTHER + SHAPE
        found = list(self.trie.near(word, bound))
        if word != word.lower():
            found += [(c, n, w[:1].upper() + w[1:]) for c, n, w in self.trie.near(word.lower(), bound)]
        return sorted(set(found))

    def misread(self, word: str, before: str = "", after: str = "") -> str | None:
        """The word stripped and folded if it is a misreading, else None.

        Confusions of shape, digits and marks judge by themselves.  A word that
        only a general edit takes to the vocabulary may be a name: it is a
        misreading only if the clean corpus has the candidate between its very
        neighbours.
        """
        core, sure = self.judged(word)
        if core is None or sure:
            return core
        held = any(self.attests(before, w) and self.attests(w, after) for _, _, w in self.candidates(core))
        return core if held else None

    def _judged(self, word: str) -> tuple[str | None, bool]:
        """(core, whether it is a misreading whatever stands beside it); no core for a word that is none."""
        core = word.strip(_EDGES + " ")
        if not core or core in self.trie:
            return None, True
        core = plain(core).strip(_EDGES + " ")
        if " " in core:
            return next((c for c in map(self.judged, core.split()) if c[0] and c[1]), (None, True))
        if _STRAY.search(core) and len(_LETTERS.sub("", core)) <= 3:
            return core, True
        letters = sum(c.isalpha() for c in core)
        if letters < 2 or self.knows(core) or re.fullmatch(r"[\d.,:/–-]*\d[a-zA-Z]{1,2}", core) or re.search("[א-ת][\"״][א-ת]$", core):
            return None, True
        if core[-1] in "'׳’" and letters <= 3 or any(not ("א" <= c <= "ת" or c < "ʰ") for c in core if c.isalpha()):
            return None, True
        joints = rf"[{BREAKS}–—/״\"().,:;]" if re.search("[א-ת]", core) else rf"[{BREAKS}–—/'’\"().,:;]"
        parts = [p for p in re.split(joints, core) if p]
        if len(parts) > 1 and all(self.knows(p) or p.isdigit() or len(p) < 2 for p in parts):
            return None, True
        if core.isalpha() and (letters <= 3 and numeral(core) or len(core) < 3):
            return None, True
        found = self.candidates(core)
        if not found:
            return None, True
        sure = found[0][0] <= (SHAPE_BOUND if core.isalpha() else MARK_BOUND)
        return (core, sure) if sure or core.isalpha() and not core[0].isupper() else (None, True)

    def best(self, core: str, before: str, after: str) -> str:
        """The candidate of least cost, then with an attested neighbour, then of highest frequency."""
        ranked = self.candidates(core)
        if not ranked:
            bare = re.sub(r"[\\|^_•~*]", "", core)
            return bare or core
        around = lambda w: -self.attests(before, w) - self.attests(w, after)
        return min(ranked, key=lambda r: (r[0], around(r[2]), r[1], r[2]))[2]


def _pair(a: str, b: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{a}\0{b}")


Line = list[tuple[int, str]]  # (index of the row, word)


def furniture(texts: list[str], edge_only: bool = True, foot: int | None = None) -> list[str]:
    """`header`, `page_no` or `` for each line of a page (`edge_only`) or of a paragraph that keeps the page's lines.

    `foot`: the last line above the notes, which may be the page number's place.
    """
    kinds = [""] * len(texts)
    last = len(texts) - 1
    usual = median([len(t) for t in texts[1:]]) if last > 1 else 0
    # a head and a number may stand on two lines
    for i, text in enumerate(texts):
        top = i == 0 or i == 1 and bool(kinds[0])
        edge = top or i in (last, foot)
        if not edge_only and (last < 2 or i in (0, last)):
            continue
        if _NUMBER.fullmatch(text) and any(c.isdigit() for c in text):
            kinds[i] = "page_no"
        elif (m := _DECORATED.fullmatch(text)) and (m[1].isascii() or numeral(m[1])):
            kinds[i] = "page_no"
        elif (edge or not edge_only) and (m := _LETTER_NUMBER.fullmatch(text)) and (m[1].isascii() or numeral(m[1])) and not text.rstrip().endswith((".", ",", "?", "!")):
            kinds[i] = "page_no"
        elif (top if edge_only else True) and len(text) <= SHORT * usual and not re.search(r"[.,;!?׃]\s*[\"”“»]?\s*$", re.sub(r"[\W_]*\d+[\W_]*$", "", text)):
            kinds[i] = "header"
    return kinds


def read_unit(lines: list[Line], kinds: list[str], reader: Reader, carry: str = "") -> tuple[list[tuple[int, str]], str, str | None]:
    """((row, kind) of the noise, reflowed text, the word left open at its end) of lines whose furniture is known.

    `carry`: the first part of a word that the page before left broken.
    """
    noise: list[tuple[int, str]] = []
    words: list[list] = []  # row, word, row of the first part or None, length of the first part
    part: tuple[int | None, str] | None = (None, carry) if carry else None
    for line, kind in zip(lines, kinds):
        if kind:
            noise += [(row, kind) for row in dict.fromkeys(row for row, _ in line)]
            continue
        for k, (row, word) in enumerate(line):
            if part is not None:
                first_row, first = part
                part = None
                first = _BREAK.sub("", first)
                whole = first + word
                if reader.knows(plain(whole.strip(_EDGES))) or not (reader.knows(plain(first)) and reader.knows(plain(word.strip(_EDGES)))):
                    if first_row is not None:
                        noise.append((first_row, "hyphen"))
                    words.append([row, whole, first_row, len(first)])
                    if k == len(line) - 1 and _BREAK.search(word):
                        part = (row, words.pop()[1])
                    continue
                words.append([first_row, first, None, 0])
            if k == len(line) - 1 and _BREAK.search(word):
                part = (row, word)
            else:
                words.append([row, word, None, 0])
    if part is not None:
        if part[0] is not None:
            noise.append((part[0], "hyphen"))
        words.append([part[0], part[1], None, -1])
    out = []
    cores = [plain(w.strip(_EDGES)) for _, w, _, _ in words]
    for k, (row, word, first_row, cut) in enumerate(words):
        beside = cores[k - 1] if k else "", cores[k + 1] if k + 1 < len(cores) else ""
        core = reader.misread(word, *beside) if cut >= 0 else None
        if core is None:
            out.append(word)
            continue
        best = reader.best(core, *beside)
        if cut and first_row is not None:
            head, tail = core[:cut], core[cut:]
            hit = [r for r, bad in ((first_row, best[:cut] != head), (row, best[cut:] != tail and best[cut - len(core) :] != tail)) if bad]
            noise += [(r, "misread") for r in hit or [row]]
        elif row is not None and not (cut and best[cut - len(core) :] == core[cut:]):
            noise.append((row, "misread"))
        out.append(word.replace(word.strip(_EDGES), best, 1))
    return sorted(set(noise)), " ".join(out), None if part is None else part[1]


def _whole(first: str, rest: str) -> str:
    return plain((_BREAK.sub("", first) + rest).strip(_EDGES))


def corpus_pairs(corpus: DataFrame, limit: int = 2_000_000) -> list[tuple[str, str]]:
    """Neighbouring word pairs of the clean corpus, refused beyond `limit`."""
    words = F.expr(r"regexp_extract_all(text, '[\\p{L}\\p{M}]+', 0)")
    pairs = corpus.where("text is not null").select(words.alias("w")).select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("a"), F.expr("slice(w, 2, greatest(size(w) - 1, 0))").alias("b"))).alias("p"))
    rows = pairs.select("p.a", "p.b").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the clean corpus holds more than {limit} word pairs")
    return [(r[0], r[1]) for r in rows]


_READERS: dict[str, Reader] = {}


def share_reader(spark: SparkSession, words: list[tuple[str, int]], pairs: list[tuple[str, str]]) -> tuple:
    """A handle under which each worker process keeps its one reader."""
    return uuid.uuid4().hex, spark.sparkContext.broadcast(Reader(words, pairs))


def reader_of(shared: tuple) -> Reader:
    if shared[0] not in _READERS:
        _READERS.clear()
        _READERS[shared[0]] = shared[1].value
    return _READERS[shared[0]]


_OUT = "tbl string, volume string, page int, unit long, elem int, noise array<struct<row_id:long,kind:string>>, text string, shut string, tail string, took string"
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _pages(rows: DataFrame, notes: bool) -> DataFrame:
    """(volume, page, rows, before): rows gathered by page, with the last row of the body of the page before, if any.

    A page is a physical unit of bounded size; volumes, which may hold any
    share of all rows, are never gathered.  Rows without a page stand alone.
    The last row of each page is found by a greatest value, map-side first, and
    joins the rows of the next page before they are gathered, once.  `notes`:
    `fresh` rows are notes and lend nothing.
    """
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    broken = text.rlike(rf"(?U)[^\W\d_][{BREAKS}]\z")
    furnished = text.rlike(rf"(?U)^(?:{_NUMBER.pattern})\z") | ~text.rlike(r"(?U)\w") | (text.rlike(rf"(?U)^(?:{_LETTER_NUMBER.pattern})\z") & ~(F.lit(not notes) & ~F.col("fresh") & broken))
    body = ~F.col("fresh") & ~furnished if notes else ~furnished
    own = rows.where("text is not null").select("volume", "page", "at", "row_id", "text", "fresh")
    row = F.struct("at", "row_id", "text", "fresh")
    lent = own.where("volume is not null and page is not null").groupBy("volume", "page").agg(F.max(F.when(body, row)).alias("r")).where("r is not null").select("volume", (F.col("page") + 1).alias("page"), "r.*", F.lit(True).alias("lent"))
    alone = F.when(F.col("volume").isNull() | F.col("page").isNull(), F.col("row_id"))
    together = own.withColumn("lent", F.lit(False)).unionByName(lent).groupBy("volume", "page", alone.alias("alone"))
    gathered = together.agg(F.array_sort(F.collect_list(F.when(~F.col("lent"), row))).alias("rows"), F.collect_list(F.when(F.col("lent"), row)).alias("before"))
    return gathered.where("size(rows) > 0").select("volume", "page", "rows", "before")


def scan_noise(tokens: DataFrame | None, lines: DataFrame | None, addenda: DataFrame | None, words: list[tuple[str, int]], pairs: list[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """One row per page or paragraph: the noise found in its rows and its reflowed text."""
    shared = share_reader(spark, words, pairs)
    parts = []
    if tokens is not None:
        rows = tokens.select(F.col("token_id").alias("row_id"), "volume", "page", F.col("pos").alias("at"), "text", F.coalesce("nl", F.lit(False)).alias("fresh"))
        parts.append(_pages(rows, False).mapInPandas(lambda frames: _run_pages(frames, shared, "tokens"), _OUT))
    if lines is not None:
        rows = lines.select(F.col("line_id").alias("row_id"), "volume", "page", F.col("line_no").alias("at"), "text", F.coalesce(F.col("zone") == "notes", F.lit(False)).alias("fresh"))
        parts.append(_pages(rows, True).mapInPandas(lambda frames: _run_pages(frames, shared, "page_lines"), _OUT))
    if addenda is not None:
        rows = addenda.select("addenda_id", F.posexplode("text").alias("elem", "text")).where("text is not null")
        parts.append(rows.mapInPandas(lambda frames: _run_addenda(frames, shared), _OUT))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def token_lines(rows: list[dict]) -> list[list[dict]]:
    lines: list[list[dict]] = []
    for r in rows:
        if r["fresh"] or not lines:
            lines.append([])
        lines[-1].append(r)
    return lines


def _once(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """(one row for each place, the repeated rows)."""
    seen, first, again = set(), [], []
    for r in rows:
        (again if r["at"] in seen and r["at"] is not None else first).append(r)
        seen.add(r["at"])
    return first, again


def _carry(before: list[dict] | None, tbl: str) -> str:
    """First part of a word left broken by the page before, past its furniture and notes."""
    if before is None:
        return ""
    for r in reversed([x for x in before if not (tbl == "page_lines" and x["fresh"])]):
        text = r["text"].strip()
        # a short first part looks like a letter number, but does not stand alone on its line
        open_word = tbl == "tokens" and not r["fresh"] and _BREAK.search(text)
        if _NUMBER.fullmatch(text) or not re.search(r"\w", text) or _LETTER_NUMBER.fullmatch(text) and not open_word:
            continue
        return text.split(" ")[-1] if _BREAK.search(text) else ""
    return ""


def page_noise(rows: list[dict], before: list[dict] | None, reader: Reader, tbl: str) -> tuple[list[tuple[int, str]], str]:
    """(row id, kind) and reflowed text of one page of tokens or lines."""
    return whole_page(rows, before, reader, tbl)[:2]


def whole_page(rows: list[dict], before: list[dict] | None, reader: Reader, tbl: str) -> tuple[list[tuple[int, str]], str, str | None, str | None, str | None]:
    """`page_reading` of a page whose rows may be repeated."""
    first, again = _once(rows)
    noise, *read = page_reading(first, before, reader, tbl)
    by_place = {r["at"]: r for r in first}
    for r in again:
        if r["text"] == by_place[r["at"]]["text"]:
            noise += [(r["row_id"], k) for i, k in noise if i == by_place[r["at"]]["row_id"]]
        else:
            swapped = [r if x["at"] == r["at"] else x for x in first]
            noise += [(i, k) for i, k in page_reading(swapped, before, reader, tbl)[0] if i == r["row_id"]]
    return noise, *read


def page_reading(rows: list[dict], before: list[dict] | None, reader: Reader, tbl: str) -> tuple[list[tuple[int, str]], str, str | None, str | None, str | None]:
    """(noise, text, text without its open last word, that word, the open word taken over from the page before).

    A page of nothing but furniture takes no word over.
    """
    if tbl == "tokens":
        body = [[(r["row_id"], r["text"]) for r in line] for line in token_lines(rows)]
        kinds = furniture([" ".join(w for _, w in line) for line in body])
        notes, note_kinds = [], []
    else:
        found = furniture([r["text"] for r in rows], foot=max((i for i, r in enumerate(rows) if not r["fresh"]), default=None))
        zone = lambda own: [([(r["row_id"], w) for w in r["text"].split(" ") if w], k) for r, k in zip(rows, found) if r["fresh"] == own]
        body, kinds = [x for x, _ in zone(False)], [k for _, k in zone(False)]
        notes, note_kinds = [x for x, _ in zone(True)], [k for _, k in zone(True)]
    carry = _carry(before, tbl) if any(line and not kind for line, kind in zip(body, kinds)) else ""
    noise, flowed, tail = read_unit(body, kinds, reader, carry)
    below, noted, _ = read_unit(notes, note_kinds, reader)
    shut = None if tail is None else "\n".join(t for t in (flowed[: len(flowed) - len(tail)].rstrip(" "), noted) if t)
    return noise + below, "\n".join(t for t in (flowed, noted) if t), shut, tail, carry or None


def joined_pages(readings: DataFrame) -> DataFrame:
    """`readings`, which are looked at twice, with the open last word dropped from the text of a page whose next page took it over."""
    took = readings.where("took is not null").select("tbl", "volume", (F.col("page") - 1).alias("page"), F.col("took").alias("_next"))
    return readings.join(took, ["tbl", "volume", "page"], "left").withColumn("text", F.when(F.col("_next") == F.col("tail"), F.col("shut")).otherwise(F.col("text"))).drop("_next")


def _run_pages(frames: Iterator[pd.DataFrame], shared, tbl: str) -> Iterator[pd.DataFrame]:
    reader = reader_of(shared)
    for frame in frames:
        out = []
        for volume, page, rows, before in zip(frame["volume"], frame["page"], frame["rows"], frame["before"]):
            noise, *read = whole_page(list(rows), None if before is None else list(before), reader, tbl)
            out.append((tbl, volume, page, None, 0, [{"row_id": i, "kind": k} for i, k in sorted(set(noise))], *read))
        yield pd.DataFrame(out, columns=_NAMES)


def paragraph_noise(text: str, reader: Reader) -> tuple[set[str], str]:
    """Kinds of noise in a paragraph that may keep the lines of the scan, and its reflowed text."""
    lines = [[(i, w) for w in line.split(" ") if w] for i, line in enumerate(text.split("\n")) if line.strip()]
    texts = [" ".join(w for _, w in line) for line in lines]
    kinds = furniture(texts, edge_only=False)
    for i in range(1, len(lines)):
        # a short line may be the rest of the word that the line before broke
        if kinds[i] == "header" and len(lines[i]) == 1 and _BREAK.search(texts[i - 1]) and reader.knows(_whole(lines[i - 1][-1][1], lines[i][0][1])):
            kinds[i] = ""
    noise, flowed, _ = read_unit(lines, kinds, reader)
    return {k for _, k in noise}, flowed


def _run_addenda(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    reader = reader_of(shared)
    for frame in frames:
        out = []
        for key, elem, text in zip(frame["addenda_id"], frame["elem"], frame["text"]):
            kinds, flowed = paragraph_noise(text, reader)
            out.append(("addenda_munich", None, None, key, elem, [{"row_id": key, "kind": k} for k in sorted(kinds)], flowed, None, None, None))
        yield pd.DataFrame(out, columns=_NAMES)
