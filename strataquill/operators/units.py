"""Quantities recorded in different units, brought to one base unit per dimension.

A figure is a number and the unit its record gives for it (a column, a note, the text, or a payload). Two records of the
same figure obey the identity value_a * unit_a = value_b * unit_b. A unit written right beside a number is certain; otherwise
every unit the record names is a candidate, the combination with the smallest residual of logarithms is taken, and a pair
that several combinations fit equally well is flagged. A unit that is named but not known is refused, never read as 1.
``solve_identity_units`` does the same for any product identity among columns, such as mass = density * volume.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions.columns import fold_width
from strataquill.functions.text import plain

# Base units with their dimension and size, and the scale words put before or after them.
BASE_UNITS = {
    "元": ("money", 1.0),
    "千瓦时": ("energy", 1.0), "度": ("energy", 1.0), "兆瓦时": ("energy", 1e3), "吉瓦时": ("energy", 1e6), "瓦时": ("energy", 1e-3),
    "wh": ("energy", 1e-3), "kwh": ("energy", 1.0), "mwh": ("energy", 1e3), "gwh": ("energy", 1e6), "twh": ("energy", 1e9),
    "克": ("mass", 1e-3), "千克": ("mass", 1.0), "公斤": ("mass", 1.0), "吨": ("mass", 1e3),
    "g": ("mass", 1e-3), "kg": ("mass", 1.0), "t": ("mass", 1e3), "kt": ("mass", 1e6), "mt": ("mass", 1e9),
    "平方米": ("area", 1.0), "平方公里": ("area", 1e6), "平方千米": ("area", 1e6), "公顷": ("area", 1e4), "亩": ("area", 10000 / 15),
    "m2": ("area", 1.0), "sqm": ("area", 1.0), "ha": ("area", 1e4), "km2": ("area", 1e6),
}
CHINESE_SCALES = {"十": 1e1, "百": 1e2, "千": 1e3, "万": 1e4, "十万": 1e5, "百万": 1e6, "千万": 1e7, "亿": 1e8, "十亿": 1e9, "百亿": 1e10, "千亿": 1e11, "万亿": 1e12}
ENGLISH_SCALES = {"": 1.0, "'000": 1e3, "thousand": 1e3, "k": 1e3, "mn": 1e6, "m": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}
CURRENCIES = ("人民币", "rmb", "cny")
# Money that is not CNY.
FOREIGN = ("美元", "港元", "港币", "欧元", "日元", "英镑", "澳元", "加元", "韩元", "新加坡元", "瑞士法郎", "卢布", "usd", "us$", "hkd", "hk$", "eur", "jpy", "gbp", "aud", "cad", "krw", "sgd", "chf", "$", "€", "£")


def unit_table() -> dict[str, tuple[str, float]]:
    """Every spelling (lower case, no blanks) -> (dimension, size in the base unit), built from base units and scales."""
    out = dict(BASE_UNITS)
    for name, (dimension, size) in BASE_UNITS.items():
        if not name.isascii():
            out |= {scale + name: (dimension, size * times) for scale, times in CHINESE_SCALES.items() if scale + name not in BASE_UNITS}
    for currency in CURRENCIES:
        out |= {currency + name: x for name, x in list(out.items()) if x[0] == "money" and name.endswith("元") and not name.startswith(CURRENCIES)}
        out |= {currency + scale: ("money", times) for scale, times in ENGLISH_SCALES.items()}
    return out


UNITS = unit_table()
_SPELLED = "|".join(re.escape(u) for u in sorted(UNITS, key=len, reverse=True))
#: A unit that starts after nothing, a mark, or a word that introduces it, and is not part of a longer or compound one.
_UNIT_RE = re.compile(rf"(?<![a-z/])(?<![一-鿿])(?:{_SPELLED})(?![a-z0-9/])(?!每)|(?<=[以为位按])(?:{_SPELLED})(?![a-z0-9/])(?!每)")
_FOREIGN_RE = re.compile("|".join(re.escape(c) for c in FOREIGN))
_OTHER_RE = re.compile(rf"(?:{'|'.join(sorted(CHINESE_SCALES, key=len, reverse=True))})?(?:{_FOREIGN_RE.pattern})")
_NAMED_RE = re.compile(r"单位[:：]?(?P<a>[^,，;；)）]+)|以(?P<b>[^,，;；]{1,12})列示|(?P<c>^[^,，;；]{1,12})口径$|^in(?P<d>[a-z].*)$|元/")
_NUMBER_RE = re.compile(r"(?<![A-Za-z0-9_.,-])(?P<open>\()?\s*(?P<sign>[-−–])?\s*(?P<digits>\d[\d,]*(?:\.\d+)?)(?:[eE](?P<exp>[+-]?\d+))?\s*(?(open)\)|)")


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", "", plain(text)).lower()


def parse_unit(text: str | None) -> tuple[str, str, float] | None:
    """(spelling, dimension, size) of a text that is a unit and nothing else, whatever its case, width and blanks."""
    if not text:
        return None
    name = _squeeze(text)
    return (name, *UNITS[name]) if name in UNITS else None


def find_units(text: str | None) -> list[tuple[str, str, float]]:
    """Every unit named anywhere in a note such as ``单位：亿元`` or ``in RMB bn``, in order; none where the money is not CNY."""
    if not text:
        return []
    whole = parse_unit(text)
    if whole:
        return [whole]
    squeezed = re.sub(r"^in(?=[a-z])", "", _squeeze(text))
    if _FOREIGN_RE.search(squeezed):
        return []
    return [(u, *UNITS[u]) for u in dict.fromkeys(hit.group() for hit in _UNIT_RE.finditer(squeezed))]


def find_unit(text: str | None) -> tuple[str, str, float] | None:
    """The first of ``find_units``."""
    return next(iter(find_units(text)), None)


def names_other_unit(text: str | None) -> bool:
    """Whether a note names a unit that is not one of ours, such as ``单位：万美元`` or ``单位：万桶``."""
    squeezed = _squeeze(text or "")
    return not find_units(text) and bool(_NAMED_RE.search(squeezed) or _FOREIGN_RE.search(squeezed))


def parse_number(text: object) -> float | None:
    """A written figure; one in brackets is negative."""
    if isinstance(text, (int, float)) and not isinstance(text, bool):
        return float(text) if math.isfinite(text) else None
    if not isinstance(text, str):
        return None
    hit = re.fullmatch(_NUMBER_RE.pattern, plain(text).strip())
    return _value(hit) if hit else None


def _value(hit: re.Match) -> float:
    groups = hit.groupdict()
    size = float(groups["digits"].replace(",", "") + (f"e{groups['exp']}" if groups.get("exp") else ""))
    return -size if groups.get("open") or groups["sign"] else size


def payload_figures(payload: str | None) -> tuple[list[tuple[float, tuple | None]], tuple | None]:
    """(figures with the unit that stands nearest, a unit given for the whole payload) of a JSON payload of any shape."""
    if not payload:
        return [], None
    try:
        root = json.loads(payload)
        while isinstance(root, str):
            root = json.loads(root)
    except ValueError:
        return [], None
    figures: list[tuple[float, tuple | None]] = []
    overall = None
    stack: list[tuple[object, tuple | None]] = [(root, None)]
    while stack:
        node, unit = stack.pop()
        if isinstance(node, list):
            stack.extend((x, unit) for x in node)
        elif isinstance(node, dict):
            here = parse_unit(node["unit"]) if isinstance(node.get("unit"), str) else None
            for note in ("caption", "unit_note"):
                if here is None and isinstance(node.get(note), str):
                    here = find_unit(node[note])
            unit = here or unit
            overall = overall or unit
            for name in ("value", "v", "amount"):
                number = parse_number(node.get(name))
                if number is not None:
                    figures.append((number, unit))
            stack.extend((x, unit) for x in node.values() if isinstance(x, (dict, list)))
    return figures, overall


def text_figures(text: str | None) -> tuple[list[tuple[float, tuple | None]], list[tuple]]:
    """(figures with the unit written right after them, units named in brackets elsewhere in the text).

    A figure followed by money that is not CNY is left out. Blanks between a figure and its unit do not count.
    """
    if not text:
        return [], []
    shown = plain(text)
    figures: list[tuple[float, tuple | None]] = []
    hits = list(_NUMBER_RE.finditer(shown))
    for hit, upto in zip(hits, [*(h.start() for h in hits[1:]), len(shown)], strict=False):
        rest = _squeeze(shown[hit.end() : max(upto, hit.end())])
        after = _UNIT_RE.match(rest)
        if after or not _OTHER_RE.match(rest):
            figures.append((_value(hit), (after.group(), *UNITS[after.group()]) if after else None))
    bracketed = re.findall(r"\(([^()]*[^()\d,.\s-][^()]*)\)", shown)
    return figures, list(dict.fromkeys(u for b in bracketed for u in find_units(b)))


def readings(text: str | None, payload: str | None) -> list[tuple[float, str, str, float]]:
    """Distinct (number, unit, dimension, value in the base unit) that a record can be read as."""
    told, named = text_figures(text)
    held, given = payload_figures(payload)
    out = {}
    for number, unit, elsewhere in [*((n, u, named + [g for g in (given,) if g]) for n, u in told), *((n, u, named) for n, u in held)]:
        for choice in [unit] if unit else elsewhere:
            out[number, choice[0]] = (number, choice[0], choice[1], number * choice[2])
    return list(out.values())


_READ_SCHEMA = "key string, company_id string, report_period string, item string, number double, unit string, dimension string, base_value double"


def evidence_quantities(blocks: DataFrame) -> DataFrame:
    """Every reading of every table row: one row per record, number and unit, in the base unit. No shuffle.

    Rows without a number or without any unit give none; repeated records repeat. The text is passed on as ``item``.
    """
    rows = blocks.where("evidence_type = 'table_row' and evidence_id is not null and text is not null").select("evidence_id", "company_id", "report_period", "text", "structured_payload")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for e, c, p, text, payload in frame.itertuples(index=False):
                out.extend((e, c, p, text, *r) for r in readings(text, payload if isinstance(payload, str) else None))
            yield pd.DataFrame(out, columns=["key", "company_id", "report_period", "item", "number", "unit", "dimension", "base_value"])

    return rows.mapInPandas(read, _READ_SCHEMA)


def report_quantities(report: DataFrame) -> DataFrame:
    """Every report figure in the base unit: the unit column, else the units named in the note, else the base unit itself.

    A figure whose unit column or note names a unit that is not known gives no row; ``with_money_unit`` tells the reason.
    """
    rows = report.where("id is not null and amount is not null and item_name_cn is not null").select("id", "company_id", "report_period", "item_name_cn", "amount", "amount_unit", "unit_note")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, c, p, item, amount, unit, note in frame.itertuples(index=False):
                unit, note = (x if isinstance(x, str) and x.strip() else None for x in (unit, note))
                known = find_units(unit) or ([] if unit else find_units(note))
                if not known and (unit or names_other_unit(note)):
                    continue
                for name, dimension, size in known or [(None, None, 1.0)]:
                    out.append((i, c, p, item, float(amount), name, dimension, float(amount) * size))
            yield pd.DataFrame(out, columns=["key", "company_id", "report_period", "item", "number", "unit", "dimension", "base_value"])

    return rows.mapInPandas(read, _READ_SCHEMA)


def with_money_unit(rows: DataFrame, unit: str, note: str) -> DataFrame:
    """``rows`` with ``m``, a struct(unit, dimension, size, reason) of what their figures are given in: by the unit column, else the note, else yuan.

    ``size`` is a decimal, what one unit is in yuan, and null with a reason where the figure is no money of ours:
    UNKNOWN_UNIT for a unit that is named but not known, FOREIGN_CURRENCY, or NON_MONEY_UNIT. Built-in expressions and a
    join with the table of spellings, a few hundred rows.
    """
    squeeze = lambda c: F.replace(F.regexp_replace(F.lower(fold_width(F.col(c))), "\\s+", ""), F.lit("㎡"), F.lit("m2"))
    known = rows.sparkSession.createDataFrame([(n, d, Decimal(size) if d == "money" else None) for n, (d, size) in UNITS.items()], "__name string, __dimension string, __size decimal(20,2)")
    spelled = "|".join(f"\\Q{n}\\E" for n in sorted(UNITS, key=len, reverse=True))
    foreign = "|".join(f"\\Q{c}\\E" for c in FOREIGN)
    column, said = F.col("__column"), F.col("__said")
    held = F.nullif(F.regexp_extract(said, f"(?:(?<![a-z/一-鿿])|(?<=[以为位按]))({spelled})(?![a-z0-9/每])", 1), F.lit(""))
    other = said.rlike(foreign)
    name = F.when(column.isNotNull(), column).when(~other & held.isNotNull(), held).when(~other & ~said.rlike(_NAMED_RE.pattern.replace("?P<", "?<")), F.lit("元"))
    named = rows.withColumn("__column", F.nullif(squeeze(unit), F.lit(""))).withColumn("__said", F.regexp_replace(F.coalesce(squeeze(note), F.lit("")), "^in(?=[a-z])", "")).withColumn("__name", name)
    joined = named.join(known, "__name", "left")
    reason = F.when(F.col("__dimension").isNull(), F.when(F.coalesce(column, said).rlike(foreign), "FOREIGN_CURRENCY").otherwise("UNKNOWN_UNIT")).when(F.col("__dimension") != "money", "NON_MONEY_UNIT")
    made = F.struct(F.col("__name").alias("unit"), F.col("__dimension").alias("dimension"), F.col("__size").alias("size"), reason.alias("reason"))
    return joined.select(*(F.col(c) for c in rows.columns), made.alias("m"))


def match_restated(report: DataFrame, evidence: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(report_id, evidence_id, report_unit, evidence_unit, residual, combinations, unique) of report figures that table rows state again.

    Of all candidate units of both sides the combination of least residual is given; ``combinations`` counts those that
    come within the tolerance, and only one of them makes the choice ``unique``.

    The join key holds company, period, sign and a narrow bucket of the logarithm of the base value, so a company with a
    third of all rows spreads over its values and no pair of merely same-period rows is formed. A reading near the edge
    of a bucket also enters the next one, which makes the bucket exact for any residual up to ``tolerance``. Zeros form
    a bucket of their own. Null companies or periods match nothing.
    """
    width = tolerance * 100

    def keyed(df: DataFrame, spread: bool) -> DataFrame:
        at = F.log(F.abs("base_value")) / F.lit(width)
        low, high = F.floor(at - 0.02), F.floor(at + 0.02)
        bucket = F.when(F.col("base_value") == 0, F.lit(0).cast("long"))
        df = df.withColumn("sign", F.signum("base_value").cast("int")).withColumn("ln", F.log(F.abs("base_value")))
        if not spread:
            return df.withColumn("bucket", F.coalesce(bucket, F.floor(at)))
        return df.withColumn("bucket", F.explode(F.when(bucket.isNotNull(), F.array(bucket)).otherwise(F.array_distinct(F.array(low, high)))))

    a = keyed(report, False).select(F.col("key").alias("report_id"), "company_id", "report_period", F.col("item").alias("item_name"), F.col("unit").alias("ru"), F.col("dimension").alias("rd"), "sign", "bucket", F.col("ln").alias("rl")).distinct()
    b = keyed(evidence, True).select(F.col("key").alias("evidence_id"), "company_id", "report_period", F.col("item").alias("shown"), F.col("unit").alias("eu"), F.col("dimension").alias("ed"), "sign", "bucket", F.col("ln").alias("el"))
    pairs = a.join(b, ["company_id", "report_period", "sign", "bucket"]).where("contains(shown, item_name) and (rd is null or rd = ed)").withColumn("residual", F.coalesce(F.abs(F.col("rl") - F.col("el")), F.lit(0.0))).where(F.col("residual") <= tolerance)
    choice = F.min(F.struct("residual", "ru", "eu"))
    best = pairs.groupBy("report_id", "evidence_id").agg(choice.alias("b"), F.count_distinct(F.coalesce("ru", F.lit("")), "eu").alias("combinations"))
    return best.select("report_id", "evidence_id", F.col("b.ru").alias("report_unit"), F.col("b.eu").alias("evidence_unit"), F.col("b.residual").alias("residual"), "combinations", (F.col("combinations") == 1).alias("unique"))


def solve_identity_units(df: DataFrame, exponents: Mapping[str, float], candidates: Mapping[str, Sequence[tuple[str, float]]], group: Sequence[str], tie: float = 1e-6) -> DataFrame:
    """Per group, the unit of each column under which the identity prod(column ** exponent) = 1 holds best.

    ``candidates`` gives each column's possible (unit, size); all combinations are scored in one aggregation by the mean
    absolute residual of logarithms over the rows whose columns are all positive. Returns the group columns, ``units``
    (column -> unit), ``residual``, ``rows_used`` and ``unique``: false where another combination comes within ``tie``,
    as happens whenever only the product of two sizes is determined. Groups without a usable row get no row out.
    """
    names = list(exponents)
    combos = list(itertools.product(*(candidates[n] for n in names)))
    if len(combos) > 10_000:
        raise ValueError("more than 10,000 unit combinations")
    logs = sum((F.lit(float(exponents[n])) * F.log(F.col(n).cast("double")) for n in names), F.lit(0.0))
    usable = df.where(" and ".join(f"`{n}` > 0" for n in names)).withColumn("__log", logs)
    shifts = [sum(exponents[n] * math.log(u[1]) for n, u in zip(names, combo, strict=True)) for combo in combos]
    scored = usable.groupBy(*group).agg(F.count("*").alias("rows_used"), F.array(*(F.avg(F.abs(F.col("__log") + s)) for s in shifts)).alias("r"))
    labels = F.array(*(F.create_map(*itertools.chain(*((F.lit(n), F.lit(u[0])) for n, u in zip(names, combo, strict=True)))) for combo in combos))
    best = F.array_min("r")
    return scored.select(*group, F.element_at(labels, F.array_position("r", best).cast("int")).alias("units"), best.alias("residual"), "rows_used", (F.size(F.filter("r", lambda x: x <= best + tie)) == 1).alias("unique"))
