"""Periods named in headers, questions and running text. All expressions stay inside the JVM."""

from __future__ import annotations

import datetime as dt
from functools import partial
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataquill.functions.columns import parse_period, period_type

QUARTER_ENDS = {1: "03-31", 2: "06-30", 3: "09-30", 4: "12-31"}
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "1": 1, "2": 2, "3": 3, "4": 4}

# Header wordings in the order they are tried, with the kind of period each gives.
HEADER_PATTERNS = (
    ("([0-9]{4})[年./\\-]([0-9]{1,2})[月./\\-]([0-9]{1,2})[日号]?", "date"),
    ("([0-9]{4})[年./\\-]([0-9]{1,2})[月./\\-]?", "month"),
    ("([0-9]{4})年?第?\\s*([一二三四1-4])\\s*季度", "quarter"),
    ("([0-9]{4})年?([一二三四1-4])季报", "quarter"),
    ("([0-9]{4})[Qq]([1-4])", "quarter"),
    ("([0-9]{4})年?半年?度?", "interim"),
    ("([0-9]{4})年?中报", "interim"),
    ("([0-9]{4})年?年度?", "annual"),
    ("^([0-9]{4})$", "annual"),
)


def _clamped(text: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(text.try_cast("int"), F.lit(low)), F.lit(high))


def header_period(header: Column) -> Column:
    """struct(period, period_type) of a column header; both null where none of nine wordings fits.

    ``period`` is text, as months and days out of range are cut to it (2023年13月 is December) and a month of fewer than 31
    days ends on the 30th, February included.
    """
    text = F.trim(F.regexp_replace(header, "\\s+", " "))
    chain = None
    for pattern, kind in HEADER_PATTERNS:
        group = lambda n, p=pattern: F.regexp_extract(text, p, n)
        year = group(1)
        if kind in ("date", "month"):
            month = _clamped(group(2), 1, 12)
            day = _clamped(group(3), 1, 31) if kind == "date" else F.when(month.isin(1, 3, 5, 7, 8, 10, 12), 31).otherwise(30)
            tail = F.format_string("%02d-%02d", month, day)
            shape = F.when(tail == "12-31", "annual").when(tail == "06-30", "interim").otherwise("quarterly")
        elif kind == "quarter":
            number = F.element_at(F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair)), group(2))
            tail = F.element_at(F.create_map(*(F.lit(x) for pair in QUARTER_ENDS.items() for x in pair)), number)
            shape = F.lit("quarterly")
        else:
            tail, shape = F.lit("06-30" if kind == "interim" else "12-31"), F.lit(kind)
        found = F.struct(F.concat_ws("-", year, tail).alias("period"), shape.alias("period_type"))
        chain = F.when(text.rlike(pattern), found) if chain is None else chain.when(text.rlike(pattern), found)
    return chain.otherwise(F.struct(F.lit(None).cast("string").alias("period"), F.lit(None).cast("string").alias("period_type")))


# Relative headers.
AT_END = ("期末", "期末余额", "期末数", "本期末", "年末", "年末余额")
AT_START = ("期初", "期初余额", "期初数", "年初", "年初余额", "上年末", "上年年末余额")


def resolved_header(header: Column, anchor: Column, anchor_type: Column) -> Column:
    """struct(period, period_type) of a header that may be relative: the end of the anchor period, or the year end before it.

    An absolute wording goes before; a relative one without an anchor, and any other text, gives nulls.
    """
    absolute, text = header_period(header), F.trim(header)
    before = F.concat((F.substring(anchor, 1, 4).try_cast("int") - 1).cast("string"), F.lit("-12-31"))
    period = F.when(absolute["period"].isNotNull(), absolute["period"]).when(text.isin(*AT_END), anchor).when(text.isin(*AT_START), before)
    shape = F.when(absolute["period"].isNotNull(), absolute["period_type"]).when(text.isin(*AT_END), anchor_type).when(text.isin(*AT_START) & anchor.isNotNull(), "annual")
    return F.struct(period.alias("period"), shape.alias("period_type"))


def anchor_period(text: Column) -> Column:
    """The latest full date or named report year in a page's text, as text; null if it names none."""
    named = F.regexp_extract_all(text, F.lit("([0-9]{4}[年./\\-][0-9]{1,2}[月./\\-][0-9]{1,2}[日号]?|[0-9]{4}年?(?:年度|年报|中报|半年报|半年度|季报))"), F.lit(1))
    return F.array_max(F.transform(named, lambda t: header_period(t)["period"]))


BASES = {"balance_sheet": "end", "income_statement": "flow", "cash_flow": "flow"}


def period_expression(period: Column, basis: Column) -> Column:
    """How a period is put in words, by whether it is a point in time (``end``) or a stretch (``flow``); other text stays as it is."""
    year, month = F.substring(period, 1, 4), F.substring(period, 6, 2).try_cast("int")
    quarter = F.element_at(F.create_map(*(F.lit(x) for pair in {3: "一", 9: "三"}.items() for x in pair)), month)
    at_end = F.when(month == 12, F.concat(year, F.lit("年末"))).when(month == 6, F.concat(year, F.lit("年半年末"))).when(month.isin(3, 9), F.concat(year, F.lit("年"), quarter, F.lit("季度末"))).otherwise(F.concat(year, F.lit("年"), month.cast("string"), F.lit("月末")))
    over = F.when(month == 12, F.concat(year, F.lit("年度"))).when(month == 9, F.concat(year, F.lit("年前三季度"))).when(month == 6, F.concat(year, F.lit("年半年度"))).when(month == 3, F.concat(year, F.lit("年一季度"))).otherwise(F.concat(year, F.lit("年1-"), month.cast("string"), F.lit("月")))
    return F.when(~F.coalesce(period.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-[0-9]{2}$"), F.lit(False)), period).when(basis == "end", at_end).when(basis == "flow", over)


# Wordings of explicit periods, longest first; {n} stands for the nth group in what is shown.
EXPLICIT_PATTERNS = (
    ("range", "([0-9]{4})\\s*年\\s*([0-9]{1,2})\\s*月\\s*([0-9]{1,2})\\s*日\\s*(?:至|到|-|—|~)\\s*([0-9]{4})\\s*年\\s*([0-9]{1,2})\\s*月\\s*([0-9]{1,2})\\s*日"),
    ("point", "([0-9]{4})\\s*年\\s*([0-9]{1,2})\\s*月\\s*([0-9]{1,2})\\s*日"),
    ("first_half", "([0-9]{4})\\s*年\\s*(?:上半年|半年度)"),
    ("second_half", "([0-9]{4})\\s*年\\s*下半年"),
    ("quarter", "([0-9]{4})\\s*年\\s*第?\\s*([一二三四1-4])\\s*季度"),
    ("year", "([0-9]{4})\\s*年度"),
    ("month", "([0-9]{4})\\s*年\\s*([0-9]{1,2})\\s*月(?!\\s*[0-9])"),
    ("year", "([0-9]{4})\\s*年(?!\\s*[0-9一二三四])"),
)


def _displayed(kind: str, pattern: str, literal: Column) -> Column:
    """The normal form of one match, null where a part of it is out of range."""
    part = lambda n: F.regexp_extract(literal, pattern, n)
    number = lambda n, low, high: part(n).cast("int").between(low, high)
    date = lambda n: F.format_string("%s-%02d-%02d", part(n), part(n + 1).cast("int"), part(n + 2).cast("int"))
    valid = number(1, 1900, 2199)
    if kind in ("range", "point"):
        valid = valid & number(2, 1, 12) & number(3, 1, 31)
        shown = date(1)
        if kind == "range":
            valid = valid & number(4, 1900, 2199) & number(5, 1, 12) & number(6, 1, 31) & (date(1) <= date(4))
            shown = F.concat(date(1), F.lit(".."), date(4))
    elif kind == "month":
        valid, shown = valid & number(2, 1, 12), F.format_string("%s-%02d", part(1), part(2).cast("int"))
    elif kind == "quarter":
        shown = F.concat(part(1), F.lit("年Q"), F.translate(part(2), "一二三四", "1234"))
    else:
        shown = F.concat(part(1), F.lit({"first_half": "年上半年", "second_half": "年下半年", "year": "年度"}[kind]))
    return F.when(valid, shown)


def explicit_period(text: Column) -> Column:
    """struct(status, period, candidates): the one period a text names.

    Longer wordings are read first and hide the shorter ones inside them. ``extracted`` for one distinct period,
    ``ambiguous`` with all ``candidates`` in order for several, ``absent`` for none; nothing is chosen among several.
    """
    rest, found = F.coalesce(text, F.lit("")), F.array().cast("array<string>")
    for kind, pattern in EXPLICIT_PATTERNS:
        hits = F.regexp_extract_all(rest, F.lit(pattern), F.lit(0))
        found = F.concat(found, F.transform(hits, partial(_displayed, kind, pattern)))
        rest = F.regexp_replace(rest, pattern, "\x01")
    periods = F.array_sort(F.array_distinct(F.array_compact(found)))
    n = F.size(periods)
    return F.struct(F.when(n == 0, "absent").when(n == 1, "extracted").otherwise("ambiguous").alias("status"), F.when(n == 1, F.get(periods, F.lit(0))).alias("period"), F.when(n > 1, F.concat_ws("|", periods)).otherwise("").alias("candidates"))


def scope_is_late(scope: Column, cutoff: Column) -> Column:
    """Whether a time scope ends after the cutoff; false where either cannot be read."""
    return F.coalesce(parse_period(scope) > parse_period(cutoff), F.lit(False))


TREND_WORDS = ("变化", "变动", "增长", "下降", "趋势", "增减", "波动", "上升", "提高")
MULTI_PERIOD = ("近三年", "近3年", "连续三年")


def comparison_periods(question: Column, available: Column) -> Column:
    """The year ends a question compares, out of those available; an empty array where that is not certain.

    A phrase for several years gives the last three, two named years or more the two earliest if both are there, one year
    with a word of change that year and the latest one before it.
    """
    years_ends = F.array_sort(F.array_distinct(F.filter(available, lambda p: p.endswith("-12-31"))))
    named = F.array_sort(F.array_distinct(F.regexp_extract_all(question, F.lit("(20[0-9]{2})\\s*年"), F.lit(1))))
    ends = F.transform(named, lambda y: F.concat(y, F.lit("-12-31")))
    has = lambda words: question.rlike("|".join(words))
    none = F.array().cast("array<string>")
    pair = F.slice(ends, 1, 2)
    before = F.filter(years_ends, lambda p: p < F.get(ends, F.lit(0)))
    single = F.when(F.array_contains(available, F.get(ends, F.lit(0))) & (F.size(before) > 0), F.array(F.element_at(before, -1), F.get(ends, F.lit(0)))).otherwise(none)
    chain = F.when(has(MULTI_PERIOD), F.when(F.size(years_ends) >= 3, F.slice(years_ends, F.size(years_ends) - 2, F.lit(3))).otherwise(none))
    chain = chain.when(F.size(named) >= 2, F.when(F.size(F.array_except(pair, available)) == 0, pair).otherwise(none))
    return F.coalesce(chain.when((F.size(named) == 1) & has(TREND_WORDS), single).otherwise(none), none)


def report_clock(instant: dt.datetime, zone: str) -> dict[str, str]:
    """One instant as the UTC stamp and the local date of a report; an instant without a zone is refused."""
    if instant.tzinfo is None:
        raise ValueError("the instant has no time zone")
    return {"utc": instant.astimezone(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "local_date": instant.astimezone(ZoneInfo(zone)).date().isoformat(), "zone": zone}


__all__ = ["anchor_period", "comparison_periods", "explicit_period", "header_period", "parse_period", "period_expression", "period_type", "report_clock", "resolved_header", "scope_is_late"]
