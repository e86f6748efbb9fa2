"""Texts that look the same brought to one form.

Compatibility-composed form of letters and digits, every kind of blank as one, default-ignorable characters removed,
letters of other scripts that are drawn like Latin ones mapped to these, and (as an option) full case folding. Marks
that merely resemble one another (superscripts, circled or squared forms, punctuation of another width) stay apart.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions.text import IGNORABLE_RE, LOOKALIKE_TABLE

_SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _same_looking(char: str) -> str | None:
    """What a character is shown as in the one form; None if it stays as it is."""
    if IGNORABLE_RE.match(char):
        return ""
    category = unicodedata.category(char)
    if category == "Zs" or char == "\t":
        return " " if char != " " else None
    code = ord(char)
    if code in LOOKALIKE_TABLE:
        return chr(LOOKALIKE_TABLE[code])
    tag = unicodedata.decomposition(char).split(" ")[0]
    if not tag:
        return None
    if tag.startswith("<"):
        if tag not in _SAME_LOOK or not (category[0] in "LNM" or 0x2E80 <= code <= 0x2FDF):
            return None
        form = unicodedata.normalize("NFKC", char)
        return form if form != char and all(unicodedata.category(c)[0] in "LNM" for c in form) else None
    return None


@lru_cache(1)
def _tables() -> tuple[dict[int, str], re.Pattern]:
    """The map of the basic plane, and a pattern that finds any text that may change."""
    mapped = {c: form for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000 and (form := _same_looking(chr(c))) is not None}
    mapped[9] = " "
    odd = set(mapped) | {c for c in range(0x300, 0x10000) if not 0xD800 <= c < 0xE000 and (unicodedata.category(chr(c))[0] == "M" or unicodedata.decomposition(chr(c))[:1].isalnum()) and not 0xAC00 <= c < 0xD7A4}
    odd = sorted(odd)
    spans, start = [], odd[0]
    for a, b in zip(odd, [*odd[1:], -1], strict=True):
        if b != a + 1:
            spans.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = b
    return mapped, re.compile(f"[{''.join(spans)}\U00010000-\U0010ffff]")


def one_form(text: str, casefold: bool = True) -> str:
    """The one consistent form of a text."""
    mapped, changes = _tables()
    if not text.isascii() or "\t" in text:
        if changes.search(text):
            spread = unicodedata.normalize("NFD", text).translate(mapped)
            if not spread.isascii() and max(spread) > "￿":
                spread = "".join(c if c <= "￿" or (f := _same_looking(c)) is None else f for c in spread)
            text = unicodedata.normalize("NFC", spread)
    return unicodedata.normalize("NFC", text.casefold()) if casefold else text


def consistent_form(column: Column | str, casefold: bool = True) -> Column:
    """``one_form`` of a string column; every distinct value of a batch is worked out once. Null stays null."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        forms = pd.Series([one_form(v, casefold) for v in distinct] + [None], dtype=object)
        return forms.take(codes).reset_index(drop=True)

    return form(F.col(column) if isinstance(column, str) else column)


def differing_twins(df: DataFrame, key: str, text_col: str, casefold: bool = False) -> DataFrame:
    """Keys of rows whose text looks the same as, but differs from, the text of another row.

    Only keys and hashes are shuffled: per form (128 bits) the least and greatest hash of the raw text, combined on the
    map side, so a form shared by a third of all rows costs one row per task. Null texts have no twin; repeated rows
    count once; the empty text is a text like any other.
    """
    form = consistent_form(text_col, casefold)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(key).alias("__key"), F.col(text_col).alias("__raw"), form.alias("__form"))
    hashed = rows.select("__key", F.xxhash64("__raw").alias("__r"), F.xxhash64("__form").alias("__f1"), F.xxhash64(F.lit(7), "__form").alias("__f2"))
    mixed = hashed.groupBy("__f1", "__f2").agg(F.min("__r").alias("lo"), F.max("__r").alias("hi")).where("lo != hi")
    return hashed.join(mixed, ["__f1", "__f2"], "left_semi").select(F.col("__key").alias(key)).distinct()


def differing_titles(df: DataFrame, key: str, array_col: str, titles: DataFrame, title_col: str, casefold: bool = False) -> DataFrame:
    """Keys of rows with an array element that looks the same as, but is not equal to, a title of ``titles``."""
    parts = df.select(F.col(key).alias("__key"), F.explode(array_col).alias("__raw")).where("__raw is not null")
    parts = parts.withColumn("__form", consistent_form("__raw", casefold))
    known = titles.select(F.col(title_col).alias("__title")).where("__title is not null").distinct()
    known = known.withColumn("__form", consistent_form("__title", casefold))
    return parts.join(known, "__form").where("__raw != __title").select(F.col("__key").alias(key)).distinct()
