"""SQL fragments of the scalar functions in DuckDB's dialect, whose expressions know no lookaround."""

from __future__ import annotations

from palimpsest.functions import normal

_G = normal.GERESH.replace("'", "''")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def points(x: str) -> str:
    return f"regexp_replace({x}, '[֑-ׇ]', '', 'g')"


def fold(x: str) -> str:
    t = f"translate({x}, {q(normal.FINALS + normal.MARKS)}, {q(normal.MEDIALS + normal.PLAIN_MARKS)})"
    once = f"regexp_replace({t}, '([א-ת])׳([א-ת])', '\\1״\\2', 'g')"
    return f"regexp_replace({once}, '([א-ת])׳([א-ת])', '\\1״\\2', 'g')"


def letters(x: str) -> str:
    return f"regexp_replace(translate({x}, {q(normal.FINALS)}, {q(normal.MEDIALS)}), '[^א-ת]', '', 'g')"


def bare(x: str) -> str:
    return letters(points(x))


def words(x: str) -> str:
    """Words with an abbreviation's mark: every other character is doubled, so one of a pair can stand for the lookahead."""
    doubled = f"regexp_replace({points(x)}, '([^א-ת])', '\\1\\1', 'g') || '  '"
    return (
        f"list_transform(regexp_extract_all({doubled}, '[א-ת]+(?:[{_G}][{_G}][א-ת][^א-ת])?'), "
        f"lambda w: regexp_replace(regexp_replace(w, '[^א-ת]$', ''), '([{_G}])[{_G}]', '\\1'))"
    )


LEX = f"lex AS (SELECT DISTINCT {fold('w')} AS word FROM (SELECT unnest({words('text')}) AS w FROM corpus WHERE text IS NOT NULL))"


def attested(w: str) -> str:
    p = "והבכלמש"
    return (
        f"({w} IN (SELECT word FROM lex) OR regexp_matches({w}, '^[א-ת]+״[א-ת]$') "
        f"OR (length({w}) > 2 AND regexp_matches({w}, '^[{p}]') AND substr({w}, 2) IN (SELECT word FROM lex)) "
        f"OR (length({w}) > 3 AND regexp_matches({w}, '^[{p}][{p}]') AND substr({w}, 3) IN (SELECT word FROM lex)))"
    )


def grams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({x}) - {n - 1}), lambda i: substr({x}, i, {n})))"
