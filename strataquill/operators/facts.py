"""Statement facts: mapping, admission, normalisation, checks, reconciliation, snapshots and screens.

A fact row has company_id, period_end, scope, currency, unit, statement_type, item_code, source and a value. Functions
take and return DataFrames; a refusal is a row with a reason, never an exception or a dropped row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataquill.functions.columns import growth, item_text

DIMENSIONS = ("company_id", "period_end", "scope", "currency", "unit", "statement_type", "item_code", "source")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first in ``order`` (which should be total); extra columns are kept."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def missing_dimensions(dimensions: Sequence[str] = DIMENSIONS) -> Column:
    """Names of the dimensions that are null or empty, in order."""
    return F.array_compact(F.array(*(F.when(F.col(d).isNull() | (F.col(d).cast("string") == ""), F.lit(d)) for d in dimensions)))


def admission_failure(expected: Mapping[str, Column], order: Sequence[str]) -> Column:
    """Name of the first dimension that is not as expected; null where all are."""
    chain = None
    for name in order:
        bad = ~F.col(name).eqNullSafe(expected[name])
        chain = F.when(bad, F.lit(name)) if chain is None else chain.when(bad, F.lit(name))
    return chain


def first_failure(conditions: Mapping[str, Column]) -> Column:
    """Name of the first condition that is false or unknown, in the order given; null where all hold."""
    chain = None
    for name, holds in conditions.items():
        fails = ~F.coalesce(holds, F.lit(False))
        chain = F.when(fails, F.lit(name)) if chain is None else chain.when(fails, F.lit(name))
    return chain


def map_items(candidates: DataFrame, label: str, rules: DataFrame) -> DataFrame:
    """Candidates with ``mapped_code`` and ``mapping_status`` (mapped, ambiguous, unmapped).

    ``rules`` has alias, code and an optional exclude word; an alias is compared in normal form, a label that holds the
    rule's exclude word is vetoed, and two codes for one label are ambiguous. Rows are aggregated per distinct label
    before they are joined back, so frequent labels cost no more than rare ones.
    """
    labels = candidates.select(F.col(label).alias("__label")).distinct().withColumn("__norm", item_text(F.col("__label")))
    known = rules.select(item_text(F.col("alias")).alias("__norm"), "code", "exclude")
    hit = labels.join(known, "__norm", "left").where("exclude is null or not contains(__label, exclude)")
    codes = hit.groupBy("__label").agg(F.count_distinct("code").alias("__codes"), F.min("code").alias("__code"))
    out = candidates.join(codes, F.col(label).eqNullSafe(F.col("__label")), "left")
    status = F.when(F.coalesce("__codes", F.lit(0)) == 0, "unmapped").when(F.col("__codes") == 1, "mapped").otherwise("ambiguous")
    return out.withColumn("mapping_status", status).withColumn("mapped_code", F.when(F.col("__codes") == 1, F.col("__code"))).drop("__label", "__codes", "__code")


def with_confirmations(facts: DataFrame, confirmations: DataFrame, keys: Sequence[str], fill: Sequence[str]) -> DataFrame:
    """Null dimensions filled from confirmations; a value that is there is never overwritten."""
    named = confirmations.select(*keys, *(F.col(c).alias(f"__{c}") for c in fill)).dropDuplicates(list(keys))
    joined = facts.join(named, list(keys), "left")
    for c in fill:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")))
    return joined.drop(*(f"__{c}" for c in fill))


def uniform_or_null(column: str) -> Column:
    """Aggregate: the value all rows agree on, else null (a null among them is no agreement)."""
    return F.when((F.count_distinct(column) == 1) & (F.count(column) == F.count("*")), F.max(column))


def value_index(facts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per key the value, and whether it is missing, ok, or ambiguous because rows disagree."""
    grouped = facts.groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.max(value).alias("__v"))
    status = F.when(F.col("__n") == 0, "missing").when(F.col("__n") == 1, "ok").otherwise("ambiguous")
    return grouped.select(*keys, status.alias("status"), F.when(F.col("__n") == 1, F.col("__v")).alias("value"))


def reconcile(facts: DataFrame, keys: Sequence[str], source: str = "source", value: str = "value", low: str = "low", high: str = "high") -> DataFrame:
    """State of each key over its sources: do the intervals that the shown figures stand for have a point in common?

    One source: SINGLE_SOURCE, or CONFLICT if it gives several values. More: MATCHED if the greatest low is not above
    the least high, else CONFLICT. Rows with a null key never form a group; they come out as INSUFFICIENT_SCOPE, one by
    one counted. Everything is a partial aggregate, so a key with very many rows is combined before the shuffle.
    """
    whole = " and ".join(f"{k} is not null" for k in keys)
    grouped = facts.where(whole).groupBy(*keys).agg(
        F.count_distinct(source).alias("sources"), F.count_distinct(value).alias("values"), F.max(low).alias("common_low"), F.min(high).alias("common_high"), F.count("*").alias("records")
    )
    common = F.col("common_low") <= F.col("common_high")
    state = F.when(F.col("sources") <= 1, F.when(F.col("values") <= 1, "SINGLE_SOURCE").otherwise("CONFLICT")).when(common, "MATCHED").otherwise("CONFLICT")
    states = grouped.select(*keys, "sources", "values", "records", F.when(common, F.col("common_low")).alias("common_low"), F.when(common, F.col("common_high")).alias("common_high"), state.alias("state"))
    rest = facts.where(f"not ({whole})").groupBy(*keys).agg(F.count_distinct(source).alias("sources"), F.count_distinct(value).alias("values"), F.count("*").alias("records"))
    bounds = [F.lit(None).cast(states.schema[c].dataType).alias(c) for c in ("common_low", "common_high")]
    return states.unionByName(rest.select(*keys, "sources", "values", "records", *bounds, F.lit("INSUFFICIENT_SCOPE").alias("state")))


# The checks within one source. A check holds if every total equals the sum of its parts, within half a unit
# for each item that takes part.
CHECKS: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "BALANCE_SHEET_IDENTITY": (("TOTAL_ASSETS", ("TOTAL_LIAB", "TOTAL_EQUITY")),),
    "CASH_BALANCE_RECONCILIATION": (("CASH_END", ("CASH_BEGIN", "NET_CASH_INCREASE")),),
    "NET_INCOME_CASH_START": (("NET_PROFIT", ("CF_NET_PROFIT",)),),
    "REVENUE_COST_BREAKDOWN": (("OPER_REVENUE", ("OPER_REVENUE_NOTES",)), ("OPER_COST", ("OPER_COST_NOTES",))),
}


def source_checks(facts: DataFrame, keys: Sequence[str], checks: Mapping[str, tuple[tuple[str, tuple[str, ...]], ...]] = CHECKS) -> DataFrame:
    """(keys, check, difference, tolerance, result, missing, ambiguous) of every check for every source and period.

    PASS if all differences are within half the display unit times the number of items compared, FAIL if one is not,
    NOT_RUN_MISSING_INPUT if an item is missing or has several values (named in ``missing`` and ``ambiguous``). The unit is
    the one all records of the group share; without one the tolerance is 0. ``facts`` has the keys, item_code, value,
    unit_size.
    """
    codes = sorted({c for parts in checks.values() for total, items in parts for c in (total, *items)})
    at = lambda c: F.when(F.col("item_code") == c, F.col("value"))
    wide = facts.groupBy(*keys).agg(
        F.when(F.count_distinct("unit_size") == 1, F.max("unit_size")).alias("__unit"), *(F.max(at(c)).alias(c) for c in codes), *(F.count_distinct(at(c)).alias(f"__n_{c}") for c in codes)
    )
    rows = []
    for name, parts in checks.items():
        used = [c for total, items in parts for c in (total, *items)]
        lacking = F.array_compact(F.array(*(F.when(F.col(f"__n_{c}") == 0, F.lit(c)) for c in used)))
        several = F.array_compact(F.array(*(F.when(F.col(f"__n_{c}") > 1, F.lit(c)) for c in used)))
        difference = [F.col(total) - sum((F.col(c) for c in items[1:]), F.col(items[0])) for total, items in parts]
        worst = F.greatest(*map(F.abs, difference)) if len(difference) > 1 else F.abs(difference[0])
        allowed = F.coalesce(F.col("__unit") * F.lit(1 + len(parts[0][1])) / 2, F.lit(0)).cast("decimal(28,2)")
        ran = (F.size(lacking) == 0) & (F.size(several) == 0)
        result = F.when(~ran, "NOT_RUN_MISSING_INPUT").when(worst <= allowed, "PASS").otherwise("FAIL")
        rows.append(F.struct(F.lit(name).alias("check"), F.when(ran, difference[0]).cast("decimal(28,2)").alias("difference"), F.when(ran, allowed).alias("tolerance"), result.alias("result"), F.concat_ws(",", lacking).alias("missing"), F.concat_ws(",", several).alias("ambiguous")))
    return wide.select(*keys, F.explode(F.array(*rows)).alias("x")).select(*keys, "x.*")


def failed_inputs(facts: DataFrame, results: DataFrame, keys: Sequence[str], record: str, checks: Mapping[str, tuple[tuple[str, tuple[str, ...]], ...]] = CHECKS) -> DataFrame:
    """(record, check): records that are inputs of a failed check and so are kept out of a snapshot; a check that did not run excludes nothing."""
    inputs = F.create_map(*(x for name, parts in checks.items() for x in (F.lit(name), F.array(*(F.lit(c) for total, items in parts for c in (total, *items))))))
    failed = results.where("result = 'FAIL'").select(*keys, "check", F.explode(F.element_at(inputs, F.col("check"))).alias("item_code"))
    return facts.join(failed, [*keys, "item_code"]).select(record, "check").distinct()


#: Exceptions that always block a report, and those that do only for a critical item.
ALWAYS_BLOCKING = ("QUARANTINED_INPUT", "UNRESOLVED_CONFLICT", "AMBIGUOUS_RESTATEMENT", "STALE_RESOLUTION")
BLOCKING_IF_CRITICAL = ("MISSING_DIMENSION", "NULL_VALUE", "UNCONFIRMED_MAPPING", "CHECK_FAILED", "MISSING_REQUIRED_ITEM")


def report_blocked(exceptions: DataFrame, company: str, critical: Sequence[str]) -> DataFrame:
    """(company, exceptions, blocking, blocked): whether any exception (kind, item_code) of a company blocks its report."""
    stop = F.col("kind").isin(*ALWAYS_BLOCKING) | (F.col("kind").isin(*BLOCKING_IF_CRITICAL) & F.col("item_code").isin(*critical))
    return exceptions.groupBy(company).agg(F.count("*").alias("exceptions"), F.count_if(F.coalesce(stop, F.lit(False))).alias("blocking"), F.coalesce(F.bool_or(stop), F.lit(False)).alias("blocked"))


def unique_value(facts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """One value per key; a key with several distinct values ends the query with an error that names it."""
    shown = F.concat_ws(" ", *(F.col(k).cast("string") for k in keys))
    grouped = facts.groupBy(*keys).agg(F.count_distinct(value).alias("__n"), F.max(value).alias(value))
    return grouped.select(*keys, F.when(F.col("__n") <= 1, F.col(value)).otherwise(F.raise_error(F.concat(F.lit("several values for "), shown)).cast(grouped.schema[value].dataType)).alias(value))


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a counterpart; a null key has none."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def admit(facts: DataFrame, states: DataFrame, keys: Sequence[str], excluded: DataFrame, record: str, scope: str, currency: str) -> DataFrame:
    """Facts with ``decision``: ADMITTED, SKIPPED (other scope or currency, or excluded), or the exception that bars them.

    Exceptions in order: MISSING_DIMENSION, NULL_VALUE, AMBIGUOUS_RESTATEMENT (several values of one source and key),
    UNRESOLVED_CONFLICT (the reconciled state of the key).
    """
    tagged = facts.join(excluded.select(record).distinct().withColumn("__out", F.lit(True)), record, "left")
    several = facts.groupBy(*keys, "source").agg((F.count_distinct("value") > 1).alias("__several"))
    joined = tagged.join(several, [*keys, "source"], "left").join(states.select(*keys, F.col("state").alias("__state")), list(keys), "left")
    lacking = F.exists(F.array(*(F.col(k).isNull() for k in keys)), lambda x: x)
    decision = (
        F.when(F.col("__out") | (F.col("scope") != scope) | (F.col("currency") != currency), "SKIPPED")
        .when(lacking | F.col("source").isNull(), "MISSING_DIMENSION")
        .when(F.col("value").isNull(), "NULL_VALUE")
        .when(F.col("__several"), "AMBIGUOUS_RESTATEMENT")
        .when(F.col("__state") == "CONFLICT", "UNRESOLVED_CONFLICT")
        .otherwise("ADMITTED")
    )
    return joined.withColumn("decision", decision).drop("__out", "__several", "__state")


def changes(facts: DataFrame, keys: Sequence[str], threshold: float = 0.2) -> DataFrame:
    """Change against the last available period of the same item, and whether it reaches the threshold."""
    before = W.partitionBy(*keys).orderBy("period_end")
    rows = facts.withColumn("prior_end", F.lag("period_end").over(before)).withColumn("prior_value", F.lag("value").over(before)).where("prior_end is not null")
    change = growth(F.col("value"), F.col("prior_value"))
    return rows.select(*keys, "period_end", "prior_end", "value", "prior_value", change.alias("change"), F.coalesce(F.abs(change) >= threshold, F.lit(False)).alias("flagged"))


def shares(facts: DataFrame, keys: Sequence[str], sides: Mapping[str, Sequence[str]], threshold: float = 0.15) -> DataFrame:
    """Share of every item in the total item of its side, and whether it reaches the threshold; totals have no row.

    ``sides`` gives the items of each total. Without a total, or with one of zero, the share is null and nothing is flagged.
    """
    side = F.create_map(*(F.lit(x) for total, items in sides.items() for c in items for x in (c, total)))
    rows = facts.withColumn("side", F.try_element_at(side, F.col("item_code"))).where("side is not null")
    totals = facts.where(F.col("item_code").isin(*sides)).select(*keys, F.col("item_code").alias("side"), F.col("value").alias("side_total"))
    share = F.try_divide(F.col("value").cast("double"), F.col("side_total").cast("double"))
    return rows.join(totals, [*keys, "side"], "left").select(*keys, "side", "item_code", "value", "side_total", share.alias("share"), F.coalesce(share >= threshold, F.lit(False)).alias("flagged"))


def trend(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direction over all periods of a key: increased, decreased, unchanged or mixed; else the reason there is none."""
    before = W.partitionBy(*keys).orderBy("period_end")
    step = F.signum(F.col("value") - F.lag("value").over(before))
    rows = facts.withColumn("__step", step).groupBy(*keys).agg(
        F.count("*").alias("periods"), F.count_distinct("unit").alias("__units"), F.count_if(F.col("value").isNull()).alias("__nulls"), F.min("__step").alias("__lo"), F.max("__step").alias("__hi")
    )
    reason = F.when(F.col("periods") < 2, "too_few_periods").when(F.col("__units") > 1, "unit_mismatch").when(F.col("__nulls") > 0, "missing_value")
    direction = F.when(F.col("__lo") > 0, "increased").when(F.col("__hi") < 0, "decreased").when((F.col("__lo") == 0) & (F.col("__hi") == 0), "unchanged").otherwise("mixed")
    return rows.select(*keys, "periods", F.when(reason.isNull(), direction).alias("trend"), reason.alias("reason"))


def annual_delta(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference of the last two year ends if they are adjacent and both given; otherwise a typed refusal."""
    years = facts.where("month(period_end) = 12 and day(period_end) = 31")
    last = years.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("period_end").desc()))).where("__n <= 2")
    pick = lambda n, c: F.max(F.when(F.col("__n") == n, F.col(c)))
    pair = last.groupBy(*keys).agg(F.count("*").alias("ends"), pick(1, "period_end").alias("current_end"), pick(2, "period_end").alias("prior_end"), pick(1, "value").alias("current_value"), pick(2, "value").alias("prior_value"))
    refusal = F.when(F.col("ends") < 2, "fewer_than_two_year_ends").when(F.year("current_end") - F.year("prior_end") != 1, "not_adjacent").when(F.col("current_value").isNull() | F.col("prior_value").isNull(), "missing_value")
    return pair.select(*keys, "current_end", "prior_end", F.when(refusal.isNull(), F.col("current_value") - F.col("prior_value")).alias("delta"), refusal.alias("refusal"))


def number_identity(pairs: DataFrame, dimensions: Sequence[str]) -> Column:
    """SAME, CONFLICT, or DIFFERENT_<first differing dimension> of two readings (columns a_* and b_*); INCOMPARABLE with a null."""
    chain = None
    for d in dimensions:
        a, b = F.col(f"a_{d}"), F.col(f"b_{d}")
        for condition, label in ((a.isNull() | b.isNull(), "INCOMPARABLE"), (a != b, f"DIFFERENT_{d.upper()}")):
            chain = F.when(condition, label) if chain is None else chain.when(condition, label)
    return chain.when(F.col("a_value").isNull() | F.col("b_value").isNull(), "INCOMPARABLE").when(F.col("a_value") == F.col("b_value"), "SAME").otherwise("CONFLICT")


def focus_periods(facts: DataFrame, company: str, years: int = 3, as_of: str | None = None) -> DataFrame:
    """Periods a company is read at: its last ``years`` year ends, its latest interim and quarterly period, and ``as_of``.

    A company without figures at ``as_of`` (YYYY-MM-DD) is read at its last period instead. Each period has one row.
    """
    from strataquill.functions.columns import period_type

    ends = facts.select(company, "period_end").where("period_end is not null").distinct().withColumn("period_type", period_type(F.col("period_end")))
    ranked = ends.withColumn("__n", F.row_number().over(W.partitionBy(company, "period_type").orderBy(F.col("period_end").desc())))
    ranked = ranked.withColumn("__last", F.max("period_end").over(W.partitionBy(company)))
    chosen = (F.col("__n") == 1) | (F.col("period_type") == "annual") & (F.col("__n") <= years)
    if as_of is not None:
        at = F.lit(as_of).cast("date")
        there = F.max(F.when(F.col("period_end") == at, 1)).over(W.partitionBy(company))
        ranked = ranked.withColumn("__at", F.when(there == 1, at).otherwise(F.col("__last")))
        chosen = chosen | (F.col("period_end") == F.col("__at"))
    return ranked.where(chosen).select(company, "period_end", "period_type")
