"""Problem 1: text decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy code page, a byte-structure
automaton finds the maximal well-formed multibyte spans among those bytes, and
only those spans are decoded again.  Spans of one-byte Hebrew code pages have
no multibyte structure; for them the same byte mapping is used and a span of
whole words counts as garbled if its letters all fall on Hebrew letter bytes
and the decoded words are attested in the clean vocabulary.

Nulls give no row, empty texts are never garbled, repeated rows are answered
each by itself, and a field is judged whole whatever its length.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages that UTF-8 bytes are known to have been read in.
MULTIBYTE_VIEWS = ("cp1252", "latin-1", "cp1251", "mac_roman", "koi8_r", "cp437", "cp850", "cp866", "cp1255", "cp1253", "cp1250", "cp1254", "iso8859_8", "cp862")
#: Code pages that one-byte Hebrew was read in, and where Hebrew letters lie in its own.
SINGLE_VIEWS = ("cp1252", "cp1251", "cp1253", "mac_roman", "koi8_r", "cp437", "cp850", "cp866", "cp1250", "cp1254", "cp1256", "cp1257", "iso8859_2", "iso8859_5", "iso8859_7", "mac_cyrillic", "mac_greek")
HEBREW_PAGES = {"cp1255": (0xE0, 0xFA), "cp862": (0x80, 0x9A)}
LOST = "�"
FINALS = "ךםןףץ"


def _table(codec: str) -> dict[str, int]:
    """Character to byte of a code page; bytes it leaves undefined pass as C1 controls."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        if b not in out.values():
            out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def _to_bytes(codec: str) -> dict[int, str]:
    """str.translate table into a string of bytes; what the page lacks becomes U+0100, a lost byte NUL."""

    class Table(dict):
        def __missing__(self, point: int) -> str:
            value = self[point] = chr(point) if point < 0x80 else "Ā"
            return value

    table = Table({ord(c): chr(b) for c, b in _table(codec).items()})
    table[0] = "Ā"
    table[ord(LOST)] = "\x00"
    return table


#: The byte-structure automaton: well-formed sequences of two to four bytes, and
#: such as have lost one byte (NUL, or a lead byte whose second byte is gone).
_TAIL = "[\x80-\xbf]"
_WHOLE = f"(?:[\xc2-\xdf]{_TAIL}|\xe0[\xa0-\xbf]{_TAIL}|[\xe1-\xec\xee\xef]{_TAIL}{_TAIL}|\xed[\x80-\x9f]{_TAIL}|\xf0[\x90-\xbf]{_TAIL}{_TAIL}|[\xf1-\xf3]{_TAIL}{_TAIL}{_TAIL})"
_MAIMED = f"(?:[\xc2-\xdf]\x00|\xd7(?=[\xd7\x00\\s]|$)|\x00{_TAIL}|\xe2(?:\x00{_TAIL}|{_TAIL}\x00|\x00\x00))"
AUTOMATON = re.compile(f"(?:{_WHOLE}|{_MAIMED}|(?<={_TAIL}){_TAIL}(?=\xd7))+")
_UNIT = re.compile(f"{_WHOLE}|{_MAIMED}|.", re.S)
_GOOD = re.compile(_WHOLE)
_PLAIN = re.compile("[֐-ײ״\x00-\x7f–—“”„«»…‘’‎‏]*")
_WORDLIKE = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=None)
def _suspect(codec: str) -> re.Pattern:
    """A character of a lead byte before one of a following byte, in a code page's own characters."""
    table = _table(codec)
    lead = "".join(re.escape(c) for c, b in table.items() if 0xC2 <= b <= 0xF3)
    tail = "".join(re.escape(c) for c, b in table.items() if b < 0xC0)
    return re.compile(f"[{lead}][{tail}]")


def _decode_span(span: str) -> str:
    out = []
    for unit in _UNIT.findall(span):
        try:
            out.append(unit.encode("latin-1").decode("utf-8") if _GOOD.fullmatch(unit) else LOST)
        except UnicodeDecodeError:
            out.append(LOST)
    return "".join(out)


def _plausible(c: str, codec: str, good: int) -> bool:
    """Characters an original of these collections, or an inner layer of damage, can hold."""
    if "\u0590" <= c <= "\u05f4" or "\xa0" <= c <= "\u017f" or c in "–—‘’‚“”„†‡•…‰‹›ˆ˜™€ƒ−":
        return True
    return codec in ("cp1252", "latin-1") and (c in "\u200e\u200f" or good > 1 and ("\u0370" <= c <= "\u04ff" or "\x80" <= c < "\xa0"))


def _trusted(text: str, start: int, end: int, span: str, decoded: str, codec: str) -> int:
    """0: a chance neighbourhood of rightful characters; 1: damage if the text shows this code page elsewhere; 2: damage."""
    good = len(_GOOD.findall(span))
    kept = decoded.replace(LOST, "")
    if not good or not all(_plausible(c, codec, good) for c in kept):
        return 0
    if not any(c.isalpha() or c in "–—“”„«»…‘’׳״־×Ãâ" or unicode_mark(c) for c in kept):
        return 0
    if codec in ("cp1252", "latin-1") or good >= 3:
        return 2
    if good == 2 and not all(_WORDLIKE.match(c) for c in text[start:end]):
        return 2
    lead = text[start]
    beside = text[start - 1 : start] + text[end : end + 1]
    if not _WORDLIKE.match(lead) and lead != "׳":
        return 2 if decoded[0].isalpha() else 1
    if any("a" <= c.lower() <= "z" for c in beside) and not "a" <= lead.lower() <= "z":
        return 2
    return 1 if all("\u05d0" <= c <= "\u05ea" for c in kept) else 0


def unicode_mark(c: str) -> bool:
    return "֑" <= c <= "ׇ" or "̀" <= c <= "ͯ"


def undo_multibyte(text: str, vocabulary: frozenset[str] = frozenset()) -> tuple[str, bool]:
    """`text` with every span of misread UTF-8 decoded, to the innermost layer; each layer shortens the text, so it ends."""
    found = False
    while True:
        best: tuple[int, list[tuple[int, int, str]]] = (0, [])
        for codec in MULTIBYTE_VIEWS:
            if not _suspect(codec).search(text):
                continue
            as_bytes = text.translate(_to_bytes(codec))
            if len(as_bytes) != len(text):
                continue
            spans, sure = [], 0
            for m in AUTOMATON.finditer(as_bytes):
                decoded = _decode_span(m[0])
                if trust := _trusted(text, m.start(), m.end(), m[0], decoded, codec):
                    spans.append((m.start(), m.end(), decoded))
                    sure = max(sure, 2 if decoded in vocabulary else trust)
            if sure < 2:
                continue
            covered = sum(b - a - d.count(LOST) for a, b, d in spans)
            if covered > best[0]:
                best = (covered, spans)
        if not best[1]:
            return text, found
        found, out, at = True, [], 0
        for a, b, decoded in best[1]:
            out += [text[at:a], decoded]
            at = b
        text = "".join(out) + text[at:]


@lru_cache(maxsize=None)
def _single_pages() -> list[tuple[str, str, dict[str, str], re.Pattern]]:
    """(Hebrew page, view, view character → true character, a word of Hebrew letters under it)."""
    out = []
    for page, (low, high) in HEBREW_PAGES.items():
        for view in SINGLE_VIEWS:
            back, letters = {}, []
            for c, b in _table(view).items():
                try:
                    true = bytes([b]).decode(page)
                except UnicodeDecodeError:
                    continue
                if low <= b <= high:
                    letters.append(c)
                    back[c] = true
                elif page == "cp1255" and (0xC0 <= b <= 0xD3 or b in (0xD7, 0xD8)):
                    back[c] = true
            if len(letters) < 20:
                continue
            own = "".join(map(re.escape, letters))
            extra = "".join(re.escape(c) for c in back if c not in letters)
            out.append((page, view, back, re.compile(f"[{own}](?:[{own}{extra}{LOST}\"'-]*[{own}{extra}{LOST}])?")))
    return out


def _hebrew_order(span: str, vocabulary: frozenset[str]) -> str:
    """Logical order of a span that may have been stored in visual order."""
    def score(s: str) -> int:
        words = re.findall("[א-ת]+", re.sub("[֑-ׇ]", "", s))
        return sum(len(w) for w in words if w in vocabulary) + sum((w[-1] in FINALS) - (w[0] in FINALS) for w in words)

    turned = re.sub(r"\d[\d.,]*\d", lambda m: m[0][::-1], span[::-1])
    return turned if score(turned) > score(span) else span


def undo_single_byte(text: str, vocabulary: frozenset[str]) -> tuple[str, bool]:
    """`text` with every stretch of misread one-byte Hebrew decoded, `vocabulary` being the judge.

    Each round turns letters of other scripts into Hebrew and none back, so it ends.
    """
    found = False
    while True:
        best: tuple[int, list[tuple[int, int, str]]] = (0, [])
        for page, view, back, word in _single_pages():
            hits = [m for m in word.finditer(text) if _alone(text, m.start(), m.end())]
            if not hits:
                continue
            groups: list[list[re.Match]] = []
            for m in hits:
                if groups and not any(c.isalpha() for c in text[groups[-1][-1].end() : m.start()]):
                    groups[-1].append(m)
                else:
                    groups.append([m])
            spans, gain = [], 0
            for group in groups:
                plain = [re.sub(f"[֑-ׇ{LOST}\"'-]", "", "".join(back.get(c, c) for c in m[0])) for m in group]
                long = [w for w in plain if len(w) > 1]
                known = [w for w in long if w in vocabulary or w[::-1] in vocabulary]
                strange = [w for m, w in zip(group, plain) if len(w) > 2 and view in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1254")]
                if long and (2 * len(known) >= len(long) and known or page == "cp1255" and len(strange) == len(long) and len(strange) > 0):
                    a, b = group[0].start(), group[-1].end()
                    spans.append((a, b, "".join(back.get(c, c) for c in text[a:b])))
                    gain += 3 * sum(map(len, known)) + sum(map(len, long))
            if gain > best[0]:
                best = (gain, spans)
        if not best[1]:
            return text, found
        found, out, at = True, [], 0
        for a, b, decoded in best[1]:
            out += [text[at:a], _hebrew_order(decoded, vocabulary)]
            at = b
        text = "".join(out) + text[at:]


def _alone(text: str, a: int, b: int) -> bool:
    """No letter touches the span from outside."""
    return not (a and text[a - 1].isalpha()) and not (b < len(text) and text[b].isalpha())


def repair(text: str | None, vocabulary: frozenset[str]) -> tuple[str | None, bool]:
    """(repaired text, whether any stretch was garbled)."""
    if not text or _PLAIN.fullmatch(text):
        return text, False
    text, multi = undo_multibyte(text, vocabulary)
    if _PLAIN.fullmatch(text):
        return text, multi
    text, single = undo_single_byte(text, vocabulary)
    return text, multi or single or LOST in text


def repair_fields(fields: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """`fields` with `repaired` and `garbled` for `text_col`; null texts give null and false.

    `words`: the clean vocabulary, whose size the caller has checked.  One
    Arrow-batched pass, no shuffle.  A column named like an output is replaced.
    """
    spark = fields.sparkSession
    shared = spark.sparkContext.broadcast(frozenset(w for w in words if "א" <= w[:1] <= "ת"))

    @F.pandas_udf("struct<repaired:string,garbled:boolean>")
    def run(texts: pd.Series) -> pd.DataFrame:
        vocabulary = shared.value
        return pd.DataFrame([repair(t, vocabulary) for t in texts], columns=["repaired", "garbled"])

    kept = [c for c in fields.columns if c not in ("repaired", "garbled", "_fix")]
    return fields.select(*kept, run(F.col(text_col)).alias("_fix")).select(*kept, "_fix.repaired", "_fix.garbled")


def gold_fields(gold: DataFrame) -> DataFrame:
    """(gold_id, field, elem, text) of every text and every lemma element that is not null."""
    text = gold.select("gold_id", F.lit("text").alias("field"), F.lit(0).alias("elem"), "text")
    lemma = gold.select("gold_id", F.lit("lemma").alias("field"), F.posexplode("lemma").alias("elem", "text"))
    return text.unionByName(lemma).where("text is not null")
