"""Garbled one-byte readings of Hebrew: detection and the better code page."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = ("mac_roman", "cp1252", "latin-1")


def redecoded(text: str | None) -> str | None:
    """`text` re-read as cp1255 through the page that yields most Hebrew, if it holds at least three foreign characters."""
    if text is None or sum(ord(c) > 127 and not "֐" <= c <= "׿" for c in text) < 3:
        return text

    def through(page: str) -> str:
        out = []
        for c in text:
            try:
                out.append(c.encode(page).decode("cp1255"))
            except UnicodeError:
                out.append(c)
        return "".join(out)

    return max((through(p) for p in PAGES), key=lambda t: sum("א" <= c <= "ת" for c in t))


@F.pandas_udf(T.StringType())
def legacy_hebrew(texts: pd.Series) -> pd.Series:
    """N14 as a column function; nulls stay null."""
    return texts.map(redecoded)
