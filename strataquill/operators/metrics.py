"""A closed registry of formulas over items of a statement, each result with a status and a reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formula:
    """numerator / denominator, each a signed sum of items; ``average`` takes the mean of the denominator with the prior period.

    ``fallback`` names an item and its proxy, ``combined`` the item that stands in for the averaged one if only it is
    given in both periods; one basis in one period and the other in the next is refused.
    """

    name: str
    display: str
    numerator: tuple[tuple[str, int], ...]
    denominator: tuple[tuple[str, int], ...] = ()
    kind: str = "ratio"
    average: bool = False
    fallback: tuple[str, str] | None = None
    combined: str | None = None

    @property
    def items(self) -> list[str]:
        """All items the formula may read."""
        return sorted({c for c, _ in (*self.numerator, *self.denominator)} | ({self.fallback[1]} if self.fallback else set()) | ({self.combined} if self.combined else set()))


def _f(name: str, display: str, top: str, bottom: str = "", kind: str = "ratio", **more) -> Formula:
    signed = lambda s: tuple((w.lstrip("+-"), -1 if w.startswith("-") else 1) for w in s.split())
    return Formula(name, display, signed(top), signed(bottom), kind, **more)


# The registry. A growth formula compares an item with its value a year before.
FORMULAS: dict[str, Formula] = {
    f.name: f
    for f in (
        _f("SOLV_CURRENT_RATIO", "ratio", "CUR_ASSETS", "CUR_LIAB"),
        _f("SOLV_QUICK_RATIO", "ratio", "CUR_ASSETS -INVENTORY -PREPAID", "CUR_LIAB"),
        _f("SOLV_DEBT_RATIO", "percent", "TOTAL_LIAB", "TOTAL_ASSETS"),
        _f("SOLV_INTEREST_COVER", "ratio", "TOTAL_PROFIT INTEREST", "INTEREST", fallback=("INTEREST", "FIN_EXP")),
        _f("SOLV_EQUITY_MULT", "ratio", "TOTAL_ASSETS", "TOTAL_EQUITY"),
        _f("PROF_GROSS_MARGIN", "percent", "TOTAL_REVENUE -OPER_COST", "TOTAL_REVENUE"),
        _f("PROF_NET_MARGIN", "percent", "NET_PROFIT", "TOTAL_REVENUE"),
        _f("PROF_ROE", "percent", "NET_PROFIT", "TOTAL_EQUITY"),
        _f("PROF_ROA", "percent", "NET_PROFIT", "TOTAL_ASSETS"),
        _f("PROF_OPER_MARGIN", "percent", "OPER_PROFIT", "TOTAL_REVENUE"),
        _f("OPER_ASSET_TURNOVER", "ratio", "TOTAL_REVENUE", "TOTAL_ASSETS", average=True),
        _f("OPER_INV_TURNOVER", "ratio", "OPER_COST", "INVENTORY", average=True),
        _f("OPER_AR_TURNOVER", "ratio", "TOTAL_REVENUE", "AR", average=True, combined="AR_COMBINED"),
        _f("CASH_OCF_TO_NP", "ratio", "OCF", "NET_PROFIT"),
        _f("CASH_OCF_TO_ASSET", "ratio", "OCF", "TOTAL_ASSETS"),
        _f("CASH_OCF_TO_REV", "ratio", "OCF", "TOTAL_REVENUE"),
        _f("EXP_PERIOD_RATE", "percent", "SALES_EXP ADMIN_EXP RND FIN_EXP", "TOTAL_REVENUE"),
        *(_f(f"GROWTH_{n}", "percent", c, kind="growth") for n, c in (("REVENUE", "TOTAL_REVENUE"), ("NET_PROFIT", "NET_PROFIT"), ("ASSET", "TOTAL_ASSETS"), ("LIABILITY", "TOTAL_LIAB"), ("EQUITY", "TOTAL_EQUITY"), ("OCF", "OCF"), ("ICF", "ICF"), ("FINANCING_CASH_FLOW", "FCF_FIN"))),
        _f("EBITDA", "yuan", "TOTAL_PROFIT INTEREST DEPRECIATION AMORTISATION", kind="sum"),
        _f("INTEREST_BEARING_DEBT", "yuan", "ST_LOAN CUR_NONCUR_LIAB LT_LOAN BONDS LEASE_LIAB", kind="partial_sum"),
        _f("FREE_CASH_FLOW", "yuan", "OCF -CAPEX", kind="sum"),
    )
}


def _total(parts: Sequence[tuple[str, int]], value) -> Column:
    out = None
    for code, sign in parts:
        term = value(code) * F.lit(sign)
        out = term if out is None else out + term
    return out


#: Values are exact decimals; quotients keep sixteen places.
MONEY, QUOTIENT = "decimal(22,2)", "decimal(38,16)"


def _quotient(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast(MONEY), bottom.cast(MONEY)).cast(QUOTIENT)


def _out(value: Column | None, status: str, reason: str | None = None) -> Column:
    return F.struct((F.lit(None) if value is None else value).cast(QUOTIENT).alias("value"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


def _ratio(top: Column, bottom: Column, status: str = "CALCULATED_EXACT", reason: str | None = None) -> Column:
    return F.when(bottom == 0, _out(None, "ZERO_DENOMINATOR")).otherwise(_out(_quotient(top, bottom), status, reason))


def _averaged(f: Formula, now, prior) -> Column:
    """Over the mean of two periods of the same basis."""
    top = _total(f.numerator, now)
    mean_of = lambda a, b: F.when(a + b == 0, _out(None, "ZERO_DENOMINATOR")).otherwise(_out(_quotient(top * 2, a + b), "CALCULATED_EXACT"))
    a, b = _total(f.denominator, now), _total(f.denominator, prior)
    chain = F.when(top.isNull(), _out(None, "MISSING_INPUT")).when(a.isNotNull() & b.isNotNull(), mean_of(a, b))
    if f.combined:
        c, d = now(f.combined), prior(f.combined)
        chain = chain.when(c.isNotNull() & d.isNotNull(), mean_of(c, d))
        chain = chain.when((a.isNotNull() | b.isNotNull()) & (c.isNotNull() | d.isNotNull()), _out(None, "MISSING_INPUT", "MIXED_RECEIVABLE_BASIS_FORBIDDEN"))
        a = F.coalesce(a, c)
    return chain.when(a.isNull(), _out(None, "MISSING_INPUT")).otherwise(_out(None, "MISSING_PRIOR_PERIOD"))


def _result(f: Formula, now, prior, annual: Column) -> Column:
    """struct(value, status, reason) of one formula; ``now`` and ``prior`` give an item's column."""
    if f.kind == "growth":
        a, b = now(f.numerator[0][0]), prior(f.numerator[0][0])
        return F.when(~annual, _out(None, "NOT_APPLICABLE", "annual_only")).when(a.isNull(), _out(None, "MISSING_INPUT")).when(b.isNull(), _out(None, "MISSING_PRIOR_PERIOD")).otherwise(_ratio(a - b, F.abs(b)))
    if f.kind == "partial_sum":
        codes = [c for c, _ in f.numerator]
        there = sum((now(c).isNotNull().cast("int") for c in codes), F.lit(0))
        return F.when(there == 0, _out(None, "MISSING_INPUT")).when(there < len(codes), _out(None, "PARTIAL_INPUT")).otherwise(_out(_total(f.numerator, now), "CALCULATED_EXACT"))
    if f.average:
        return _averaged(f, now, prior)
    top, bottom = _total(f.numerator, now), _total(f.denominator, now)
    if f.kind == "sum":
        return F.when(top.isNull(), _out(None, "MISSING_INPUT")).otherwise(_out(top, "CALCULATED_EXACT"))
    if f.name == "SOLV_QUICK_RATIO":
        top = top - F.coalesce(F.col("__excluded"), F.lit(0))
    chain = F.when(top.isNotNull() & bottom.isNotNull(), _ratio(top, bottom))
    if f.fallback:
        lacks, uses = f.fallback
        other = lambda c: now(uses) if c == lacks else now(c)
        t, b = _total(f.numerator, other), _total(f.denominator, other)
        chain = chain.when(now(lacks).isNull() & t.isNotNull() & b.isNotNull(), _ratio(t, b, "CALCULATED_PROXY", f"PROXY_{uses}"))
    return chain.otherwise(_out(None, "MISSING_INPUT"))


def policy_exclusions(facts: DataFrame, references: DataFrame, record: str, company: str = "company_id") -> DataFrame:
    """(company, period_end, amount): per company and period the sum of the records a policy refers to, each once.

    ``references`` has company and the ids of records to leave out; an id that is no record of that company counts nothing.
    """
    named = references.select(company, record).where(f"{company} is not null and {record} is not null").distinct()
    return facts.join(named, [company, record], "left_semi").select(company, "period_end", record, "value").distinct().groupBy(company, "period_end").agg(F.sum("value").alias("amount"))


def compute(facts: DataFrame, company: str = "company_id", names: Sequence[str] | None = None, blocked: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """(company, period_end, formula, display, value, status, reason) of every formula at every period of a company.

    ``facts`` has company, period_end, item_code and a value that is unique per key. Items become columns in one
    aggregation, the prior period (a year before for year ends, a half or a quarter otherwise) joins by the calendar, and all
    formulas come out of one row without another shuffle, in exact decimals. ``blocked`` (company, item_code, reason)
    blocks every formula that reads the item, in all periods. ``exclusions`` (company, period_end, amount) is taken off
    the quick assets. An unknown name raises KeyError: nothing outside the registry is evaluated.
    """
    from strataquill.functions.columns import period_type, prior_period

    chosen = [FORMULAS[n] for n in (names or FORMULAS)]
    codes = sorted({c for f in chosen for c in f.items})
    used = facts.where(F.col("item_code").isin(codes) & F.col("period_end").isNotNull())
    wide = used.groupBy(company, "period_end").agg(*(F.max(F.when(F.col("item_code") == c, F.col("value").cast(MONEY))).alias(c) for c in codes))
    wide = wide.withColumn("__prior_end", prior_period(F.col("period_end"), period_type(F.col("period_end"))))
    before = wide.select(company, F.col("period_end").alias("__prior_end"), *(F.col(c).alias(f"__p_{c}") for c in codes))
    both = wide.join(before, [company, "__prior_end"], "left")
    if exclusions is None:
        both = both.withColumn("__excluded", F.lit(None).cast(MONEY))
    else:
        both = both.join(exclusions.select(company, "period_end", F.col("amount").cast(MONEY).alias("__excluded")), [company, "period_end"], "left")
    annual = period_type(F.col("period_end")) == "annual"
    results = F.array(*(F.struct(F.lit(f.name).alias("formula"), F.lit(f.display).alias("display"), F.array(*map(F.lit, f.items)).alias("inputs"), _result(f, F.col, lambda c: F.col(f"__p_{c}"), annual).alias("r")) for f in chosen))
    rows = both.select(company, "period_end", F.explode(results).alias("x")).select(company, "period_end", "x.formula", "x.display", "x.inputs", "x.r.value", "x.r.status", "x.r.reason")
    if blocked is None:
        return rows.drop("inputs")
    bars = blocked.groupBy(company, "item_code").agg(F.min("reason").alias("reason")).groupBy(company).agg(F.map_from_entries(F.collect_list(F.struct("item_code", "reason"))).alias("__bars"))
    joined = rows.join(bars, company, "left").withColumn("__hit", F.array_min(F.filter("inputs", lambda c: F.coalesce(F.map_contains_key("__bars", c), F.lit(False)))))
    stop = F.col("__hit").isNotNull()
    return joined.select(company, "period_end", "formula", "display", F.when(~stop, F.col("value")).alias("value"), F.when(stop, "BLOCKED").otherwise(F.col("status")).alias("status"), F.when(stop, F.try_element_at("__bars", "__hit")).otherwise(F.col("reason")).alias("reason"))
