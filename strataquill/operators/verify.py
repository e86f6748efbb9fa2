"""Do quoted numbers, directions and sets agree with their sources?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.functions.columns import contains_any, fold_width

AMOUNT = "-?[0-9][0-9,]*(?:\\.[0-9]+)?(?:亿元|百万元|万元|千元|元|%)"


def amounts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, kind, value, shown) of every amount with a unit in a text: money in yuan, percent as written."""
    found = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(fold_width(text), F.lit(AMOUNT), F.lit(0)))).alias("shown"))
    unit = F.regexp_extract("shown", "(亿元|百万元|万元|千元|元|%)$", 1)
    size = F.when(unit == "亿元", 100000000).when(unit == "百万元", 1000000).when(unit == "万元", 10000).when(unit == "千元", 1000).otherwise(1)
    number = F.regexp_replace(F.regexp_extract("shown", "^(-?[0-9][0-9,]*(?:\\.[0-9]+)?)", 1), ",", "").try_cast("decimal(24,4)")
    return found.select(key, F.when(unit == "%", "percent").otherwise("money").alias("kind"), (number * size).cast("decimal(34,4)").alias("value"), "shown")


def presence(claims: DataFrame, claim: str, cited: DataFrame, evidence: str) -> DataFrame:
    """(claim, figures, matched, verdict): how many amounts of a claim stand, with kind and value equal, in what it cites.

    ``claims`` has claim, kind, value; ``cited`` has claim, kind, value of the cited texts. Verdict: matched, partial,
    missing, or no_figures for a claim without amounts.
    """
    own = claims.select(claim, "kind", "value").distinct()
    there = cited.select(claim, "kind", "value").distinct().withColumn("__hit", F.lit(1))
    counted = own.join(there, [claim, "kind", "value"], "left").groupBy(claim).agg(F.count("kind").alias("figures"), F.count("__hit").alias("matched"))
    verdict = F.when(F.col("figures") == 0, "no_figures").when(F.col("matched") == F.col("figures"), "matched").when(F.col("matched") > 0, "partial").otherwise("missing")
    return counted.withColumn("verdict", verdict)


# Words that claim a set to be complete, and words that take the claim back.
COMPLETE = ("全部", "合计", "共计", "所有", "总计", "前", "all of", "in total")
HEDGES = ("等", "包括", "主要", "including", "mainly")
COUNTED = "(?:前|共|共计|合计|全部|总计)([0-9]{1,3}|[一二三四五六七八九十])(?:家|名|项|个|大|位)"
NUMERALS = {n: i + 1 for i, n in enumerate("一二三四五六七八九十")}


def closed_set(sentence: Column) -> Column:
    """Verdict on a sentence that claims to list all of a counted set, by the members it lists.

    NOT_TRIGGERED without a word of completeness or a count; PARTIAL if hedged, without a count, or with fewer members listed than
    counted; SUPPORTED if as many are listed, UNSUPPORTED if more are. Members are the parts of up to 6 characters between
    enumeration commas; a sentence without such a comma lists none.
    """
    said = F.regexp_extract(sentence, COUNTED, 1)
    claimed = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in NUMERALS.items() for x in pair)), said), said.try_cast("int"))
    parts = F.split(F.regexp_replace(sentence, "[，,：:；;（）()]", "、、"), "、")
    listed = F.when(sentence.contains("、"), F.size(F.filter(F.transform(parts, F.trim), lambda x: (F.length(x) > 0) & (F.length(x) <= 6)))).otherwise(0)
    triggered, hedged = contains_any(sentence, list(COMPLETE)) | F.coalesce(said != "", F.lit(False)), contains_any(sentence, list(HEDGES))
    return F.when(~triggered, "NOT_TRIGGERED").when(hedged | claimed.isNull() | (listed < claimed), "PARTIAL").when(listed == claimed, "SUPPORTED").otherwise("UNSUPPORTED")


def claimed_direction(text: Column) -> Column:
    """increased, decreased, unchanged, mixed where the text says several, null where it says none."""
    up, down, same = (contains_any(text, w) for w in (["增长", "上升", "增加", "提高", "rose", "increased"], ["下降", "减少", "降低", "下调", "降至", "fell", "declined"], ["持平", "不变", "unchanged"]))
    said = up.cast("int") + down.cast("int") + same.cast("int")
    return F.when(said > 1, "mixed").when(up, "increased").when(down, "decreased").when(same, "unchanged")


def direction_verdict(claimed: Column, computed: Column) -> Column:
    return F.when(claimed.isNull(), "no_claim").when(computed.isNull(), "not_computable").when(claimed == computed, "agrees").otherwise("contradicts")


def scope_risk(claim: Column, evidence: Column) -> Column:
    """broad_claim_narrow_evidence where a claim speaks of the whole and its evidence of a part."""
    broad = contains_any(claim, ["集团", "合并口径", "整体", "全年", "the group", "consolidated"])
    narrow = contains_any(evidence, ["子公司", "分公司", "母公司", "单季", "subsidiary", "quarter"])
    return F.when(broad & narrow, "broad_claim_narrow_evidence")


def coverage(figures: DataFrame, keys: Sequence[str], hit: Column) -> DataFrame:
    """Share of figures that are backed, per key and over all."""
    return figures.groupBy(*keys).agg(F.count("*").alias("figures"), F.count_if(hit).alias("backed")).withColumn("share", F.round(F.col("backed") / F.col("figures"), 6))


BARE = "(?<![0-9.,A-Za-z-])-?[0-9][0-9,]*(?:\\.[0-9]+)?(?:亿元|千万元|百万元|万元|千元|元|%)?"
SIZES = {"亿元": 100000000, "千万元": 10000000, "百万元": 1000000, "万元": 10000, "千元": 1000, "元": 1}


def amounts_in_context(rows: DataFrame, key: str, text: Column, header_unit: Column, table_unit: Column) -> DataFrame:
    """(key, kind, value, shown, basis) of all numbers of a text: by the unit written after them, else that of their column, else of their table.

    A number without any is ``ambiguous`` and keeps its bare value; an amount is in yuan, a percentage as written.
    """
    found = rows.select(key, header_unit.alias("__h"), table_unit.alias("__t"), F.explode(F.array_distinct(F.regexp_extract_all(fold_width(text), F.lit(f"({BARE})"), F.lit(1)))).alias("shown"))
    own = F.nullif(F.regexp_extract("shown", "(亿元|千万元|百万元|万元|千元|元|%)$", 1), F.lit(""))
    basis = F.when(own.isNotNull(), "inline").when(F.col("__h").isNotNull(), "column").when(F.col("__t").isNotNull(), "table")
    unit = F.coalesce(own, F.col("__h"), F.col("__t"))
    size = F.try_element_at(F.create_map(*(F.lit(x) for pair in SIZES.items() for x in pair)), unit)
    number = F.regexp_replace(F.regexp_extract("shown", "^(-?[0-9][0-9,]*(?:\\.[0-9]+)?)", 1), ",", "").try_cast("decimal(24,4)")
    kind = F.when(unit == "%", "percent").when(size.isNotNull(), "money").otherwise("ambiguous")
    return found.select(key, kind.alias("kind"), (number * F.when(kind == "money", size).otherwise(1)).cast("decimal(34,4)").alias("value"), "shown", F.when(kind == "ambiguous", F.lit(None)).otherwise(basis).alias("basis"))


def scope_drop(period: Column, role: Column, wanted_period: Column, roles: Sequence[str]) -> Column:
    """Why evidence is out of scope for a claim: role_not_allowed, period_unknown or period_mismatch; null if it may be used."""
    return F.when(~F.coalesce(role.isin(*roles), F.lit(False)), "role_not_allowed").when(period.isNull(), "period_unknown").when(period != wanted_period, "period_mismatch")


def value_trace(claimed: DataFrame, stages: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """``claimed`` values with a flag per stage, and ``last_seen``: the last stage in order that still holds the value, none where no stage does."""
    rows = claimed.select(*keys).distinct()
    for name, held in stages.items():
        rows = rows.join(held.select(*keys).distinct().withColumn(name, F.lit(True)), list(keys), "left").na.fill(False, [name])
    last = F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in stages)))
    return rows.withColumn("last_seen", F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit("none")))
