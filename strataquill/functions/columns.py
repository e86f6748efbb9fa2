"""Scalar functions as Column builders: text, periods, decimals, identity. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text ---------------------------------------------------------------------------------------------------------------

_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
WORD = "[0-9]+(?:\\.[0-9]+)?%?|[a-z]+[a-z0-9]*"
TOKEN = "[0-9]+(?:\\.[0-9]+)?%?|[a-z]+[a-z0-9]*|[一-鿿]+"


def fold_width(text: Column) -> Column:
    """Full-width forms and the ideographic blank as half-width ones; the length stays the same."""
    return F.translate(text, _FULL, _HALF)


def fold_blanks(text: Column) -> Column:
    """Runs of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def tokens(text: Column) -> Column:
    """Pairs of neighbouring ideographs, single ones, then lower-case words and numbers. Null gives an empty array.

    Three passes of built-in regular expressions; a lookahead finds the overlapping pairs.
    """
    shown = F.lower(fold_width(F.coalesce(text, F.lit(""))))
    every = lambda pattern, group: F.regexp_extract_all(shown, F.lit(pattern), F.lit(group))
    return F.concat(every("(?=([一-鿿]{2}))", 1), every("(?<![一-鿿])[一-鿿](?![一-鿿])", 0), every(WORD, 0))


def item_text(text: Column) -> Column:
    """An item label without numbering, case, width and marks, for comparison."""
    bare = F.regexp_replace(F.lower(fold_width(text)), "^\\s*(?:[(\\[{【]?\\s*[0-9]+\\s*[)\\]}】]?\\s*[、.:]+|[(\\[{【]\\s*[0-9一二三四五六七八九十百]+\\s*[)\\]}】]|[一二三四五六七八九十百]+\\s*[、.:])\\s*", "")
    return F.regexp_replace(bare, "[^0-9a-z_一-鿿]", "")


def equivalent(a: Column, b: Column, ignore_blanks: bool = False) -> Column:
    """Whether two texts are the same but for width and characters without any extent (and blanks, if asked); no edit is tolerated."""
    bare = lambda c: F.regexp_replace(fold_width(c), "[\\u00ad\\u200b-\\u200f\\u2060\\ufeff" + ("\\s]" if ignore_blanks else "]"), "")
    return bare(a) == bare(b)


def heading_spans(text: Column) -> Column:
    """array<struct(line, start, end, level)> of the lines inside a text that are headings; positions count characters from 0."""
    lines = F.split(text, "\n")
    at = F.transform(lines, lambda x, i: F.struct(i.alias("line"), (F.length(F.array_join(F.slice(lines, F.lit(1), i), "\n")) + F.when(i > 0, 1).otherwise(0)).alias("start"), x.alias("shown")))
    spans = F.transform(at, lambda x: F.struct(x["line"].alias("line"), x["start"].alias("start"), (x["start"] + F.length(x["shown"])).alias("end"), heading_level(x["shown"]).alias("level")))
    return F.filter(spans, lambda x: x["level"].isNotNull())


def char_share(text: Column, klass: str) -> Column:
    """Share of the characters of ``text`` that are in the regular-expression class; null for the empty text."""
    return F.try_divide(F.length(text) - F.length(F.regexp_replace(text, klass, "")), F.length(text))


def bad_char_ratio(text: Column) -> Column:
    """Share of replacement, control, private-use and unassigned characters (tab and line breaks are fine)."""
    return char_share(text, "[\\x{FFFD}\\p{Cc}\\p{Co}\\p{Cs}\\p{Cn}&&[^\\t\\n\\r]]")


def heading_level(text: Column) -> Column:
    """1 chapter or section, 2 ideographic number, 3 bracketed number, 4 decimal number, null for no heading (or > 60 characters)."""
    line = F.trim(text)
    short = (F.length(line) <= 60) & (F.length(line) > 0) & ~line.rlike("[。；;]$")
    level = (
        F.when(line.rlike("^第[一二三四五六七八九十百0-9]+[章节]"), 1)
        .when(line.rlike("^[一二三四五六七八九十]+、"), 2)
        .when(line.rlike("^[（(][一二三四五六七八九十]+[）)]"), 3)
        .when(line.rlike("^[0-9]+(\\.[0-9]+)*[.、 ]\\s*\\D"), 4)
    )
    return F.when(short, level)


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms occurs in the text; false for null."""
    hits = [text.contains(t) for t in terms]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False))


def name_match(declared: Column, detected: Column) -> Column:
    """matched, mismatch, or unverified where nothing was declared or detected; names are compared without blanks and case."""
    norm = lambda c: F.lower(F.regexp_replace(fold_width(c), "[\\s.,，。()]+", ""))
    empty = declared.isNull() | (F.trim(declared) == "") | detected.isNull() | (F.size(detected) == 0)
    return F.when(empty, "unverified").when(F.exists(detected, lambda d: norm(d) == norm(declared)), "matched").otherwise("mismatch")


# Periods ------------------------------------------------------------------------------------------------------------


def parse_period(text: Column) -> Column:
    """End date of YYYY, YYYYQn, YYYYHn, YYYY-MM or YYYY-MM-DD; null for anything else and for impossible dates."""
    t = F.trim(text)
    year, part = F.substring(t, 1, 4), F.regexp_extract(t, "([1-4])$", 1)
    by_parts = F.when(t.rlike("^[0-9]{4}$"), F.concat(t, F.lit("-12-01")))
    by_parts = by_parts.when(t.rlike("^[0-9]{4}-?[Qq][1-4]$"), F.concat(year, F.lit("-"), F.lpad((part.try_cast("int") * 3).cast("string"), 2, "0"), F.lit("-01")))
    by_parts = by_parts.when(t.rlike("^[0-9]{4}-?[Hh][12]$"), F.concat(year, F.lit("-"), F.lpad((part.try_cast("int") * 6).cast("string"), 2, "0"), F.lit("-01")))
    by_parts = by_parts.when(t.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(t, F.lit("-01")))
    exact = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))
    return F.coalesce(exact, F.last_day(by_parts.try_cast("date")))


def period_type(end: Column) -> Column:
    """annual for 31 December, interim for 30 June, else quarterly."""
    day = F.date_format(end, "MM-dd")
    return F.when(day == "12-31", "annual").when(day == "06-30", "interim").when(end.isNotNull(), "quarterly")


def prior_period(end: Column, kind: Column) -> Column:
    """The calendar's period before: a year for annual, a half for interim, a quarter for quarterly ones."""
    months = F.when(kind == "annual", 12).when(kind == "interim", 6).when(kind == "quarterly", 3)
    return F.last_day(F.add_months(end, -months))


def comparison_label(current: Column, prior: Column) -> Column:
    """yoy for adjacent year ends, vs_prior_year_end for a date within a year against the December before, else other."""
    dec = lambda c: F.month(c) == 12
    next_year = F.year(current) == F.year(prior) + 1
    return F.when(dec(current) & dec(prior) & next_year, "yoy").when(F.month(current).isin(3, 6, 9) & dec(prior) & next_year, "vs_prior_year_end").otherwise("other")


# Decimals -----------------------------------------------------------------------------------------------------------

#: Money units and their size in yuan.
YUAN = {"元": 1, "千元": 1000, "万元": 10000, "百万元": 1000000, "亿元": 100000000, "十亿元": 1000000000}


def unit_to_yuan(unit: Column) -> Column:
    """Size of a money unit in yuan; null for an unknown one."""
    table = F.create_map(*(F.lit(x) for pair in YUAN.items() for x in pair))
    return F.try_element_at(table, F.trim(unit))


def parse_decimal(text: Column, kind: str = "decimal(24,4)") -> Column:
    """A written figure: separators dropped, brackets negative; null for percentages and anything else."""
    t = F.regexp_replace(fold_width(F.trim(text)), "[,\\s]", "")
    bare = F.regexp_replace(t, "^\\((.*)\\)$", "-$1")
    return F.when(bare.rlike("^[-+]?[0-9]+(\\.[0-9]+)?$"), bare.try_cast(kind))


def display_increment(text: Column) -> Column:
    """One unit of the last place shown: 1 for a whole number, 0.01 for two decimals."""
    places = F.coalesce(F.length(F.regexp_extract(text, "\\.([0-9]+)", 1)), F.lit(0))
    return F.pow(F.lit(10.0), -places).cast("decimal(24,10)")


def interval(value: Column, increment: Column, unit: Column) -> Column:
    """struct(low, high): the values that round to what is shown."""
    half = increment * unit / 2
    return F.struct((value - half).alias("low"), (value + half).alias("high"))


def round_display(value: Column, percent: bool = False) -> Column:
    """Two places, halves away from zero; a percentage is taken times one hundred first."""
    return F.round((value * 100 if percent else value).cast("decimal(28,8)"), 2)


def growth(current: Column, prior: Column) -> Column:
    """(current - prior) / |prior|; null without a prior value or where it is zero."""
    return F.try_divide(current - prior, F.abs(prior))


# Identity -----------------------------------------------------------------------------------------------------------


def stable_id(*parts: Column, length: int = 32) -> Column:
    """Prefix of the SHA-256 of the parts, which are kept apart by a unit separator; null parts differ from empty ones."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))
    return F.substring(F.sha2(joined, 256), 1, length)


def canonical_json(struct: Column) -> Column:
    """Compact JSON of a struct with its fields in order; nulls are written."""
    return F.to_json(struct, {"ignoreNullFields": "false"})
