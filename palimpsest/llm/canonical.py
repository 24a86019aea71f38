"""Problem 3: visually identical text with different characters.

Every Arrow batch is handed to DuckDB inside the Python worker; one embedded
SQL statement strips invisible characters, translates compatibility forms,
splits letter pairs, composes to NFC, replaces look-alike letters inside words
of another script and unifies spaces.  No shuffle, no state between batches.

Nulls stay null and are no case, empty texts stay empty, repeated rows are
answered each by itself; texts are handled whole whatever their length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges whose members are other widths or presentation forms of ordinary characters.
COMPATIBILITY_RANGES = ((0xFF01, 0xFFEE), (0x1D400, 0x1D7FF), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFE), (0x2135, 0x2138), (0x05F0, 0x05F2), (0x2160, 0x217F), (0x2460, 0x24EA), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x0132, 0x0133), (0x2100, 0x2119), (0x211A, 0x2121), (0x2124, 0x2125), (0x2128, 0x2134))
#: Signs that a compatibility mapping would take apart but that are ordinary here.
ORDINARY = {0x2103, 0x2109, 0x2116}
INVISIBLE = r"\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}"
SPACES = r"\t\x{0B}\x{0C}\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Look-alikes of Latin letters (fixed values: the shape pairs of the two alphabets with Latin).
CYRILLIC = "аеорсухѕіјһԁԛԝкАВЕКМНОРСТУХЅІЈԌ"
CYRILLIC_AS_LATIN = "aeopcyxsijhdqwkABEKMHOPCTYXSIJG"
GREEK = "αοινρυκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲ"
GREEK_AS_LATIN = "aoivpukxABEZHIKMNOPTYXc"
#: Look-alikes of Latin letters in Armenian, Cherokee and Coptic (fixed values).
DISTANT = (
    "\u0585\u057d\u0570\u0581\u0578\u0575\u0555\u054f\u053c\u054d"
    "\u13aa\u13f4\u13df\u13a0\u13ac\u13c0\u13bb\u13ab\u13e6\u13de\u13b7\u13e2\u13d2\u13da\u13a2\u13d9\u13d4\u13c3"
    "\u2c9f\u2ca5\u2ca3\u2c9e\u2ca4\u2ca2\u2c8e\u2c94\u2c98\u2c9a\u2ca6\u2ca8\u2cac"
)
DISTANT_AS_LATIN = "ouhgnjOSLU" "ABCDEGHJKLMPRSTVWZ" "ocpOCPHKMNTYX"
#: Hebrew point-free letters stand for letterlike signs as well; alphabets whose letters never mix within a word.
ALPHABETS = ("Latin", "Cyrillic", "Greek", "Hebrew", "Arabic", "Armenian", "Cherokee", "Coptic")


def _compatibility() -> tuple[str, str, list[tuple[str, str]]]:
    """(single characters, their ordinary forms, (sign, letters) of longer forms), by Unicode's own mapping."""
    single, plain, longer = [], [], []
    for low, high in COMPATIBILITY_RANGES:
        for point in range(low, high + 1):
            c = chr(point)
            form = unicodedata.normalize("NFKC", c)
            if 0x05F0 <= point <= 0x05F2:
                form = ("וו", "וי", "יי")[point - 0x05F0]
            if form == c or point in ORDINARY or unicodedata.category(c) == "Cn":
                continue
            if len(form) == 1 and unicodedata.normalize("NFC", c) == c:
                single.append(c)
                plain.append(form)
            elif unicodedata.normalize("NFC", c) == c:
                longer.append((c, form))
    return "".join(single), "".join(plain), longer


def _wide() -> str:
    """The signs of several letters from U+FBB2 on: ligatures of Arabic and wide forms."""
    return "".join(sign for sign, _ in _compatibility()[2] if ord(sign) >= 0xFBB2)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars: str) -> str:
    return "".join(rf"\x{{{ord(c):X}}}" for c in chars)


def statement(keep: list[str], wide: bool = True) -> str:
    """DuckDB SQL over a view batch(keep…, t): keep, canonical, disguised.

    Without `wide`, for batches free of the signs of `_wide`, which are many and
    rare, the planner is spared their replacements.

    Rows of plain letters skip the work; for the others every stage is one
    projection, so no expression is evaluated twice.
    """
    single, plain_forms, longer = _compatibility()
    strange = _class(single + "".join(s for s, _ in longer))
    split, rare = "t2", _wide()
    for sign, letters in longer:
        if wide or sign not in rare:
            split = f"replace({split}, {_quoted(sign)}, {_quoted(letters)})"
    others = {a: "".join(rf"\p{{{b}}}" for b in ALPHABETS if b != a) for a in ALPHABETS}
    mixed = "|".join(rf"\p{{{a}}}\p{{M}}*[{rest}]" for a, rest in others.items())
    both = "(" + " + ".join(rf"regexp_matches(base, '\p{{{a}}}')::INTEGER" for a in ALPHABETS) + ") >= 2"
    latin = f"translate(w, {_quoted(CYRILLIC + GREEK + DISTANT)}, {_quoted(CYRILLIC_AS_LATIN + GREEK_AS_LATIN + DISTANT_AS_LATIN)})"
    cyrillic = f"translate(w, {_quoted(CYRILLIC_AS_LATIN)}, {_quoted(CYRILLIC)})"
    by_word = (
        rf"nfc_normalize(array_to_string(list_transform(regexp_extract_all(base, '[\p{{L}}\p{{M}}]+|[^\p{{L}}\p{{M}}]+'), "
        f"lambda w: CASE WHEN NOT regexp_matches(w, '{mixed}') THEN w "
        rf"WHEN len(regexp_replace({latin}, '[^\p{{Latin}}]', '', 'g')) >= len(regexp_replace({cyrillic}, '[^\p{{Cyrillic}}]', '', 'g')) THEN {latin} "
        f"ELSE {cyrillic} END), ''))"
    )
    own = "".join(f'"{k}", ' for k in keep)
    plain = r"(t IS NULL OR regexp_matches(t, '^[\x{0A}\x{20}-\x{7E}\x{5D0}-\x{5EA}]*$'))"
    return f"""
    SELECT {own} t AS canonical, false AS disguised FROM batch WHERE {plain}
    UNION ALL
    SELECT {own} CASE WHEN mixed THEN {by_word} ELSE base END, odd OR mixed OR composed <> t
    FROM (SELECT *, CASE WHEN {both} THEN regexp_matches(base, '{mixed}') ELSE false END AS mixed FROM
      (SELECT *, nfc_normalize(CASE WHEN odd THEN {split} ELSE t2 END) AS base, nfc_normalize(t) AS composed FROM
        (SELECT *, CASE WHEN odd THEN translate(t1, {_quoted(single)}, {_quoted(plain_forms)}) ELSE t1 END AS t2 FROM
          (SELECT *, regexp_matches(t, '[{INVISIBLE}{SPACES}{strange}]') AS odd,
             regexp_replace(regexp_replace(t, '[{INVISIBLE}]', '', 'g'), '[{SPACES}]', ' ', 'g') AS t1 FROM batch WHERE NOT {plain}))))
    """


def normalise(frame: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """`keep` columns plus `canonical` (one consistent form) and `disguised` (boolean).

    Columns of the input outside `keep` and `text_col` never reach the workers;
    a kept column named like an output is refused.
    """
    if {"canonical", "disguised"} & set(keep):
        raise ValueError("kept columns clash with the outputs canonical and disguised")
    plain, full = statement(keep, False), statement(keep)
    rare = f"SELECT coalesce(bool_or(regexp_matches(t, '[{_class(_wide())}]')), false) FROM batch"
    source = frame.select(*keep, F.col(text_col).alias("t"))
    schema = ", ".join(f"`{n}` {t}" for n, t in source.dtypes[:-1]) + ", canonical string, disguised boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        try:
            for piece in batches:
                connection.register("batch", pa.Table.from_batches([piece]))
                sql = full if connection.execute(rare).fetchone()[0] else plain
                table = connection.execute(sql).to_arrow_table()
                connection.unregister("batch")
                target = pa.schema([*[f for f in piece.schema if f.name != "t"], pa.field("canonical", pa.string()), pa.field("disguised", pa.bool_())])
                yield from table.cast(target).combine_chunks().to_batches()
        finally:
            connection.close()

    return source.mapInArrow(run, schema)


def long_form(tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, row_id, elem, text) of the non-null texts of gold, tokens and addenda_munich."""
    parts = []
    for tbl, key in (("gold", "gold_id"), ("tokens", "token_id")):
        if tbl in tables:
            parts.append(tables[tbl].select(F.lit(tbl).alias("tbl"), F.col(key).alias("row_id"), F.lit(0).alias("elem"), "text"))
    if "addenda_munich" in tables:
        parts.append(tables["addenda_munich"].select(F.lit("addenda_munich").alias("tbl"), F.col("addenda_id").alias("row_id"), F.posexplode("text").alias("elem", "text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text is not null")
