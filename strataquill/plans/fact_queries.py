"""Queries over report figures: normalisation, checks, reconciliation, screens and metrics."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import columns as C
from strataquill.operators import facts as A
from strataquill.operators import metrics
from strataquill.operators.units import with_money_unit
from strataquill.session import table

KEYS = ["company_id", "period_end", "scope", "item_code"]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report figures once each, money in yuan as a decimal, with the dimensions of a fact.

    ``unit`` and ``unit_size`` are null and ``refusal`` gives the reason where the figure is no money of ours: a unit that
    is not known or not money, or an item that others record in such a unit while this row names none.
    """
    rows = with_money_unit(A.first_per_key(table(spark, sf_dir, "report_meta"), ["id"], "imported_at", "source_file"), "amount_unit", "unit_note")
    physical = rows.where("m.reason = 'NON_MONEY_UNIT'").select("item_code", F.lit(True).alias("physical")).distinct()
    rows = rows.join(physical, "item_code", "left")
    reason = F.coalesce("m.reason", F.when(F.col("physical"), "NON_MONEY_ITEM"))
    size = F.when(reason.isNull(), F.col("m.size"))
    amount = F.col("amount").cast("decimal(30,6)")
    return rows.select(
        "id", "company_id", C.parse_period(F.col("report_period")).alias("period_end"), F.col("statement_scope").alias("scope"), F.lit("CNY").alias("currency"), F.when(reason.isNull(), F.col("m.unit")).alias("unit"), F.col("report_type").alias("statement_type"), "item_code", "item_name_cn",
        F.col("source_file").alias("source"), F.round(amount * size, 2).cast("decimal(28,2)").alias("value"), amount.alias("shown"), size.cast("bigint").alias("unit_size"), reason.alias("refusal"),
    )


def fact_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", "period_end", C.period_type(F.col("period_end")).alias("period_type"), "unit", "unit_size", "value", "refusal")


def missing_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("id", F.concat_ws(",", A.missing_dimensions()).alias("missing"))


def admission_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first dimension that keeps a figure from being normalised."""
    rows = _records(spark, sf_dir)
    known = {"statement_type": F.col("statement_type").isin("annual", "interim", "quarterly"), "period_end": F.col("period_end").isNotNull(), "scope": F.col("scope").isin("consolidated", "parent"), "currency": F.col("currency") == "CNY", "unit": F.col("unit_size").isNotNull()}
    return rows.select("id", A.first_failure(known).alias("failed_dimension"))


def item_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("scope = 'consolidated' and currency = 'CNY' and period_end = date'2023-12-31'").select("id", "item_code", "value")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with the interval of the values that are shown as they are: half a unit of the last place shown, either way."""
    rows = _records(spark, sf_dir).where("value is not null")
    places = F.length(F.regexp_replace(F.regexp_extract(F.col("shown").cast("string"), "\\.([0-9]*)$", 1), "0+$", ""))
    step = F.element_at(F.array(*(F.lit(Decimal(10) ** -k).cast("decimal(7,6)") for k in range(7))), places + 1)
    half = (F.col("unit_size").cast("decimal(14,0)") * step / 2).cast("decimal(28,7)")
    return rows.withColumn("low", (F.col("value") - half).cast("decimal(30,7)")).withColumn("high", (F.col("value") + half).cast("decimal(30,7)"))


def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reconcile(_intervals(spark, sf_dir), KEYS)


def value_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.value_index(_records(spark, sf_dir), KEYS)


def uniform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy("company_id").agg(A.uniform_or_null("unit").alias("unit"), A.uniform_or_null("scope").alias("scope"), F.count("*").alias("records"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unambiguous consolidated values."""
    return A.value_index(_records(spark, sf_dir).where("scope = 'consolidated' and period_end is not null and company_id is not null"), ["company_id", "period_end", "item_code"]).where("status = 'ok'").select("company_id", "period_end", "item_code", F.col("value"))


def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.compute(_facts(spark, sf_dir))
    return out.select("company_id", "period_end", "formula", "display", F.round(F.col("value").cast("double"), 6).alias("value"), "status", "reason")


def metric_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.compute(_facts(spark, sf_dir)).groupBy("formula", "status").agg(F.count("*").alias("n"))


def metrics_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of which an input is in conflict between sources, by formula and outcome."""
    conflicts = reconciliation(spark, sf_dir).where("state = 'CONFLICT' and scope = 'consolidated'").select("company_id", "item_code", F.lit("UNRESOLVED_CONFLICT").alias("reason")).distinct()
    return metrics.compute(_facts(spark, sf_dir), blocked=conflicts).groupBy("formula", "status", "reason").agg(F.count("*").alias("n"))


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with every item of the registry, folded from all order lines: company is the supplier's nation, item goes by part."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2)).alias("period_end"), F.element_at(F.array(*map(F.lit, ITEMS)), (F.col("l_partkey") % len(ITEMS) + 1).cast("int")).alias("item_code"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("company_id"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("company_id", "period_end", "item_code").agg(F.sum("price").cast("decimal(28,2)").alias("value"))


#: The items of the registry in alphabetical order.
ITEMS = sorted({c for f in metrics.FORMULAS.values() for c in f.items})


def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 formulas over a statement in which every item occurs."""
    out = metrics.compute(_line_facts(spark, sf_dir))
    return out.select("company_id", "period_end", "formula", "display", F.round(F.col("value").cast("double"), 6).alias("value"), "status", "reason")


def quick_ratio_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick ratio after a policy takes the receivables of a period off the quick assets."""
    rows = _line_facts(spark, sf_dir).withColumn("record", F.concat_ws("|", "company_id", "period_end", "item_code"))
    excluded = metrics.policy_exclusions(rows, rows.where("item_code = 'AR'").select("company_id", "record"), "record")
    out = metrics.compute(rows, names=["SOLV_QUICK_RATIO"], exclusions=excluded)
    return out.select("company_id", "period_end", F.round(F.col("value").cast("double"), 6).alias("value"), "status")


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where("company_id is not null and period_end is not null and scope is not null and source is not null and value is not null")


def source_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four checks within one source, for every company, period, scope and source."""
    return A.source_checks(_sourced(spark, sf_dir), SOURCE_KEYS)


def _line_checks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order totals against their lines: a check of the form total = part, with a line's rounding as the unit."""
    price = F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(6,2)")) * (1 + F.col("l_tax").cast("decimal(6,2)"))
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.round(F.sum(price), 2).cast("decimal(28,2)").alias("value"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").cast("decimal(28,2)").alias("value"))
    rows = totals.withColumn("item_code", F.lit("NET_PROFIT")).unionByName(sums.withColumn("item_code", F.lit("CF_NET_PROFIT")))
    rows = rows.withColumn("unit_size", F.lit(1)).withColumn("record", F.concat_ws("|", F.col("order_key").cast("string"), "item_code"))
    return rows, A.source_checks(rows, ["order_key"]).where("check = 'NET_INCOME_CASH_START'")


def order_total_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the total of every order equals the sum of its lines."""
    return _line_checks(spark, sf_dir)[1].select("order_key", "difference", "tolerance", "result", "missing")


def check_failed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept out because a check they feed has failed."""
    rows, results = _line_checks(spark, sf_dir)
    return A.failed_inputs(rows, results, ["order_key"], "record")


def report_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the exceptions met when its figures are admitted block a company's report; assets, debts and revenue are critical."""
    rows = _intervals(spark, sf_dir)
    admitted = A.admit(rows, A.reconcile(rows, KEYS), KEYS, rows.where("false").select("id"), "id", "consolidated", "CNY")
    exceptions = admitted.where("decision not in ('ADMITTED', 'SKIPPED') and company_id is not null").select("company_id", F.col("decision").alias("kind"), "item_code")
    return A.report_blocked(exceptions, "company_id", CRITICAL)


CRITICAL = ("TOTAL_ASSETS", "TOTAL_LIAB", "TOTAL_REVENUE")
SOURCE_KEYS = ["company_id", "period_end", "scope", "source"]


def snapshot_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _intervals(spark, sf_dir)
    excluded = rows.where("item_code = 'RND'").select("id")
    return A.admit(rows, A.reconcile(rows, KEYS), KEYS, excluded, "id", "consolidated", "CNY").select("id", "decision")


def change_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.changes(_facts(spark, sf_dir), ["company_id", "item_code"])
    return out.select("company_id", "item_code", "period_end", "prior_end", F.round(F.col("change").cast("double"), 6).alias("change"), "flagged")


# The items of each side of the balance sheet.
SIDES = {
    "TOTAL_ASSETS": ("CASH", "AR", "INVENTORY", "PREPAID", "CUR_ASSETS"),
    "TOTAL_LIAB": ("ST_LOAN", "LT_LOAN", "BONDS", "LEASE_LIAB", "CUR_NONCUR_LIAB", "CUR_LIAB"),
}


def share_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.shares(_facts(spark, sf_dir), ["company_id", "period_end"], SIDES)
    return out.select("company_id", "period_end", "side", "item_code", F.round("share", 6).alias("share"), "flagged")


def structure_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of whole by period, with a typed gap where either is missing or the whole is zero."""
    rows = _facts(spark, sf_dir)
    part = rows.where("item_code = 'CASH'").select("company_id", "period_end", F.col("value").alias("part"))
    whole = rows.where("item_code = 'TOTAL_ASSETS'").select("company_id", "period_end", F.col("value").alias("whole"))
    both = part.join(whole, ["company_id", "period_end"], "full")
    gap = F.when(F.col("part").isNull(), "missing_part").when(F.col("whole").isNull(), "missing_whole").when(F.col("whole") == 0, "zero_whole")
    return both.select("company_id", "period_end", F.round(F.try_divide(F.col("part").cast("double"), F.col("whole").cast("double")), 6).alias("ratio"), gap.alias("gap"))


def trend_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of every item over its periods, in the unit it is shown in; figures in several units have none."""
    rows = _records(spark, sf_dir).where("scope = 'consolidated' and period_end is not null and company_id is not null and unit_size is not null")
    units = rows.groupBy("company_id", "period_end", "item_code").agg(F.max("unit_size").alias("unit"))
    return A.trend(_facts(spark, sf_dir).join(units, ["company_id", "period_end", "item_code"]), ["company_id", "item_code"])


def annual_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.annual_delta(_facts(spark, sf_dir), ["company_id", "item_code"])


def prior_period_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value next to that of the calendar's period before, and what the comparison is called."""
    rows = _facts(spark, sf_dir).withColumn("prior_end", C.prior_period(F.col("period_end"), C.period_type(F.col("period_end"))))
    before = rows.select("company_id", "item_code", F.col("period_end").alias("prior_end"), F.col("value").alias("prior_value"))
    return rows.join(before, ["company_id", "item_code", "prior_end"], "left").select("company_id", "item_code", "period_end", "prior_end", "value", "prior_value", C.comparison_label(F.col("period_end"), F.col("prior_end")).alias("label"))


def focus_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.focus_periods(_facts(spark, sf_dir), "company_id")


def number_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of figures of one company and item from one source: the same reading, a conflict, or about different things."""
    rows = _records(spark, sf_dir).where("company_id is not null and source is not null")
    dims = ("period_end", "scope", "unit")
    a = rows.select("company_id", "item_code", "source", F.col("id").alias("a_id"), F.col("value").alias("a_value"), *(F.col(d).alias(f"a_{d}") for d in dims))
    b = rows.select("company_id", "item_code", "source", F.col("id").alias("b_id"), F.col("value").alias("b_value"), *(F.col(d).alias(f"b_{d}") for d in dims))
    pairs = a.join(b, ["company_id", "item_code", "source"]).where("a_id < b_id")
    return pairs.select("a_id", "b_id", A.number_identity(pairs, dims).alias("relation"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings mapped to the codes of section titles."""
    labels = table(spark, sf_dir, "evidence_blocks").where("evidence_type = 'heading'").select("evidence_id", "text").dropDuplicates(["evidence_id"])
    codes = table(spark, sf_dir, "section_titles").select(F.col("title").alias("alias"), F.concat(F.lit("T"), F.col("title_id")).alias("code"), F.lit(None).cast("string").alias("exclude"))
    return A.map_items(labels, "text", codes).groupBy("mapping_status").agg(F.count("*").alias("n"))


def uncovered_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company periods with a revenue figure and none of net profit."""
    rows = _facts(spark, sf_dir)
    return A.uncovered(rows.where("item_code = 'TOTAL_REVENUE'"), rows.where("item_code = 'NET_PROFIT'"), ["company_id", "period_end"]).select("company_id", "period_end")


def required_input_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas whose inputs are all missing at a company's last year end."""
    rows = _facts(spark, sf_dir)
    last = rows.where("month(period_end) = 12").groupBy("company_id").agg(F.max("period_end").alias("period_end"))
    needs = spark.createDataFrame([(f.name, c) for f in metrics.FORMULAS.values() for c in f.items], "formula string, item_code string")
    wanted = last.crossJoin(F.broadcast(needs))
    there = wanted.join(rows.select("company_id", "period_end", "item_code").withColumn("ok", F.lit(1)), ["company_id", "period_end", "item_code"], "left")
    return there.groupBy("company_id", "period_end", "formula").agg(F.count("ok").alias("given"), F.count("*").alias("needed")).where("given = 0").select("company_id", "period_end", "formula", "needed")


def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per company, a column per metric of the registry at its last year end; a metric without a value is null."""
    facts = _facts(spark, sf_dir)
    last = facts.where("month(period_end) = 12").groupBy("company_id").agg(F.max("period_end").alias("period_end"))
    rows = metrics.compute(facts).join(last, ["company_id", "period_end"], "left_semi")
    return rows.groupBy("company_id", "period_end").pivot("formula", list(metrics.FORMULAS)).agg(F.round(F.first("value").cast("double"), 6))


def supplier_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-table metric lookup over orders: summed items by nation and quarter end, exact decimals."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2)).alias("period_end"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_discount").cast("decimal(6,2)").alias("discount"), "l_quantity")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "period_end").agg(F.sum("price").alias("gross"), F.sum(F.col("price") * F.col("discount")).alias("discounted"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("lines"))


QUERIES = {
    f.__name__: f
    for f in (fact_normalisation, missing_dimensions, admission_predicate, item_filter, reconciliation, value_index, uniform_summary, metric_registry, metric_status_counts, metrics_blocked, line_metrics, quick_ratio_policy, source_checks, order_total_checks, check_failed_records, report_blocked, snapshot_admission, change_screen, share_screen, structure_ratio, trend_relation, annual_delta, prior_period_join, focus_periods, number_identity, mapping, uncovered_periods, required_input_gaps, metric_table, supplier_statement)
}

# Written by hand, apart from the tables of the operators: unit names in lower case without blanks, and their sizes.
_UNITS = """yuan(u, n) AS (VALUES ('元', 1), ('千元', 1000), ('万元', 10000), ('百万元', 1000000), ('千万元', 10000000), ('亿元', 100000000), ('十亿元', 1000000000), ('人民币元', 1), ('人民币万元', 10000), ('rmb''000', 1000), ('cnythousand', 1000), ('rmbmillion', 1000000), ('rmbbn', 1000000000)),
other(u) AS (VALUES ('kwh'), ('mwh'), ('gwh'), ('twh'), ('度'), ('兆瓦时'), ('万千瓦时'), ('亿千瓦时'), ('kg'), ('t'), ('kt'), ('吨'), ('千克'), ('公斤'), ('万吨'), ('百万吨'), ('m2'), ('平方米'), ('万平方米'), ('平方公里'), ('公顷')),
once AS (SELECT *, nullif(replace(lower(regexp_replace(coalesce(amount_unit, ''), '\\s+', '', 'g')), '㎡', 'm2'), '') AS cu, replace(lower(regexp_replace(coalesce(unit_note, ''), '\\s+', '', 'g')), '㎡', 'm2') AS nu FROM report_meta QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at, source_file) = 1),
said AS (SELECT *, coalesce(cu, nullif(regexp_extract(nu, '单位[：为]([^）]+)', 1), ''), nullif(regexp_extract(nu, '以(.+)列示', 1), ''), nullif(regexp_extract(nu, '^(.+)口径$', 1), ''), nullif(regexp_extract(nu, '^in(.+)$', 1), ''), '元') AS u FROM once),
physical AS (SELECT DISTINCT item_code FROM said JOIN other USING (u))"""
_REC = f"""{_UNITS}, rec AS (SELECT id, company_id, try_cast(CASE WHEN regexp_full_match(trim(report_period), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN report_period END AS DATE) AS period_end, statement_scope AS scope, 'CNY' AS currency, CASE WHEN refusal IS NULL THEN u END AS unit, report_type AS statement_type, item_code, item_name_cn, source_file AS source,
  CASE WHEN refusal IS NULL THEN n END::BIGINT AS unit_size, amount::DECIMAL(28,6) AS shown, round(amount::DECIMAL(28,6) * unit_size::DECIMAL(10,0), 2)::DECIMAL(28,2) AS value, refusal
  FROM (SELECT s.*, y.n, CASE WHEN y.n IS NULL AND o.u IS NULL THEN 'UNKNOWN_UNIT' WHEN o.u IS NOT NULL THEN 'NON_MONEY_UNIT' WHEN p.item_code IS NOT NULL THEN 'NON_MONEY_ITEM' END AS refusal FROM said s LEFT JOIN yuan y ON s.u = y.u LEFT JOIN other o ON s.u = o.u LEFT JOIN physical p ON s.item_code = p.item_code))"""
_PT = "CASE WHEN strftime({0}, '%m-%d') = '12-31' THEN 'annual' WHEN strftime({0}, '%m-%d') = '06-30' THEN 'interim' WHEN {0} IS NOT NULL THEN 'quarterly' END"
_INT = f"{_REC}, iv AS (SELECT *, (value - half)::DECIMAL(30,7) AS low, (value + half)::DECIMAL(30,7) AS high FROM (SELECT *, (unit_size::DECIMAL(11,0) * (5 * power(10, -1 - length(rtrim(split_part(shown::VARCHAR, '.', 2), '0'))))::DECIMAL(8,7))::DECIMAL(28,7) AS half FROM rec WHERE value IS NOT NULL))"
_STATE = """st AS (SELECT company_id, period_end, scope, item_code, count(DISTINCT source) AS sources, count(DISTINCT value) AS "values", count(*) AS records, CASE WHEN max(low) <= min(high) AND w THEN max(low) END AS common_low, CASE WHEN max(low) <= min(high) AND w THEN min(high) END AS common_high,
  CASE WHEN NOT w THEN 'INSUFFICIENT_SCOPE' WHEN count(DISTINCT source) <= 1 THEN CASE WHEN count(DISTINCT value) <= 1 THEN 'SINGLE_SOURCE' ELSE 'CONFLICT' END WHEN max(low) <= min(high) THEN 'MATCHED' ELSE 'CONFLICT' END AS state
  FROM (SELECT *, company_id IS NOT NULL AND period_end IS NOT NULL AND scope IS NOT NULL AND item_code IS NOT NULL AS w FROM iv) GROUP BY company_id, period_end, scope, item_code, w)"""
_FACTS = "facts AS (SELECT company_id, period_end, item_code, max(value) AS value FROM rec WHERE scope = 'consolidated' AND period_end IS NOT NULL AND company_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) = 1)"
_PRIOR = "last_day((period_end - CASE pt WHEN 'annual' THEN INTERVAL 12 MONTH WHEN 'interim' THEN INTERVAL 6 MONTH ELSE INTERVAL 3 MONTH END)::DATE)"


# The 28 definitions once more, by hand: display, value, and the inputs without which it is missing. p_ is the prior period.
_BY_HAND = """SOLV_CURRENT_RATIO;ratio;CUR_ASSETS / CUR_LIAB
SOLV_QUICK_RATIO;ratio;(CUR_ASSETS - INVENTORY - PREPAID) / CUR_LIAB
SOLV_DEBT_RATIO;percent;TOTAL_LIAB / TOTAL_ASSETS
SOLV_EQUITY_MULT;ratio;TOTAL_ASSETS / TOTAL_EQUITY
PROF_GROSS_MARGIN;percent;(TOTAL_REVENUE - OPER_COST) / TOTAL_REVENUE
PROF_NET_MARGIN;percent;NET_PROFIT / TOTAL_REVENUE
PROF_ROE;percent;NET_PROFIT / TOTAL_EQUITY
PROF_ROA;percent;NET_PROFIT / TOTAL_ASSETS
PROF_OPER_MARGIN;percent;OPER_PROFIT / TOTAL_REVENUE
CASH_OCF_TO_NP;ratio;OCF / NET_PROFIT
CASH_OCF_TO_ASSET;ratio;OCF / TOTAL_ASSETS
CASH_OCF_TO_REV;ratio;OCF / TOTAL_REVENUE
EXP_PERIOD_RATE;percent;(SALES_EXP + ADMIN_EXP + RND + FIN_EXP) / TOTAL_REVENUE"""
_GROWTH = {"GROWTH_REVENUE": "TOTAL_REVENUE", "GROWTH_NET_PROFIT": "NET_PROFIT", "GROWTH_ASSET": "TOTAL_ASSETS", "GROWTH_LIABILITY": "TOTAL_LIAB", "GROWTH_EQUITY": "TOTAL_EQUITY", "GROWTH_OCF": "OCF", "GROWTH_ICF": "ICF", "GROWTH_FINANCING_CASH_FLOW": "FCF_FIN"}
_COLUMNS = "ADMIN_EXP AMORTISATION AR AR_COMBINED BONDS CAPEX CUR_ASSETS CUR_LIAB CUR_NONCUR_LIAB DEPRECIATION FCF_FIN FIN_EXP ICF INTEREST INVENTORY LEASE_LIAB LT_LOAN NET_PROFIT OCF OPER_COST OPER_PROFIT PREPAID RND SALES_EXP ST_LOAN TOTAL_ASSETS TOTAL_EQUITY TOTAL_LIAB TOTAL_PROFIT TOTAL_REVENUE".split()
# Items each formula reads, by hand, for what blocks it.
_READS = """SOLV_CURRENT_RATIO CUR_ASSETS CUR_LIAB;SOLV_QUICK_RATIO CUR_ASSETS INVENTORY PREPAID CUR_LIAB;SOLV_DEBT_RATIO TOTAL_LIAB TOTAL_ASSETS;SOLV_INTEREST_COVER TOTAL_PROFIT INTEREST FIN_EXP;SOLV_EQUITY_MULT TOTAL_ASSETS TOTAL_EQUITY;PROF_GROSS_MARGIN TOTAL_REVENUE OPER_COST;PROF_NET_MARGIN NET_PROFIT TOTAL_REVENUE;PROF_ROE NET_PROFIT TOTAL_EQUITY;PROF_ROA NET_PROFIT TOTAL_ASSETS;PROF_OPER_MARGIN OPER_PROFIT TOTAL_REVENUE;OPER_ASSET_TURNOVER TOTAL_REVENUE TOTAL_ASSETS;OPER_INV_TURNOVER OPER_COST INVENTORY;OPER_AR_TURNOVER TOTAL_REVENUE AR AR_COMBINED;CASH_OCF_TO_NP OCF NET_PROFIT;CASH_OCF_TO_ASSET OCF TOTAL_ASSETS;CASH_OCF_TO_REV OCF TOTAL_REVENUE;EXP_PERIOD_RATE SALES_EXP ADMIN_EXP RND FIN_EXP TOTAL_REVENUE;GROWTH_REVENUE TOTAL_REVENUE;GROWTH_NET_PROFIT NET_PROFIT;GROWTH_ASSET TOTAL_ASSETS;GROWTH_LIABILITY TOTAL_LIAB;GROWTH_EQUITY TOTAL_EQUITY;GROWTH_OCF OCF;GROWTH_ICF ICF;GROWTH_FINANCING_CASH_FLOW FCF_FIN;EBITDA TOTAL_PROFIT INTEREST DEPRECIATION AMORTISATION;INTEREST_BEARING_DEBT ST_LOAN CUR_NONCUR_LIAB LT_LOAN BONDS LEASE_LIAB;FREE_CASH_FLOW OCF CAPEX"""
_NEED = "need(formula, item_code) AS (VALUES " + ", ".join(f"('{line.split()[0]}', '{c}')" for line in _READS.split(";") for c in line.split()[1:]) + ")"


def _formula_sql() -> str:
    """Every formula as a query over pairs of periods."""
    head = "SELECT company_id, period_end, '{0}' AS formula, '{1}' AS display, {2} AS value, {3} AS status, {4}::VARCHAR AS reason FROM pairs"
    rows = []
    for line in _BY_HAND.splitlines():
        name, display, ratio = line.split(";")
        top, bottom = ratio.split(" / ")
        rows.append(head.format(name, display, f"CASE WHEN {bottom} <> 0 THEN ({top})::DOUBLE / ({bottom})::DOUBLE END", f"CASE WHEN {top} + {bottom} IS NULL THEN 'MISSING_INPUT' WHEN {bottom} = 0 THEN 'ZERO_DENOMINATOR' ELSE 'CALCULATED_EXACT' END", "NULL"))
    for name, c in _GROWTH.items():
        status = f"CASE WHEN pt <> 'annual' THEN 'NOT_APPLICABLE' WHEN {c} IS NULL THEN 'MISSING_INPUT' WHEN p_{c} IS NULL THEN 'MISSING_PRIOR_PERIOD' WHEN p_{c} = 0 THEN 'ZERO_DENOMINATOR' ELSE 'CALCULATED_EXACT' END"
        rows.append(head.format(name, "percent", f"CASE WHEN pt = 'annual' AND p_{c} <> 0 THEN ({c} - p_{c})::DOUBLE / abs(p_{c})::DOUBLE END", status, "CASE WHEN pt <> 'annual' THEN 'annual_only' END"))
    for name, top, c in (("OPER_ASSET_TURNOVER", "TOTAL_REVENUE", "TOTAL_ASSETS"), ("OPER_INV_TURNOVER", "OPER_COST", "INVENTORY")):
        status = f"CASE WHEN {top} IS NULL OR {c} IS NULL AND p_{c} IS NULL OR {c} IS NULL THEN 'MISSING_INPUT' WHEN p_{c} IS NULL THEN 'MISSING_PRIOR_PERIOD' WHEN {c} + p_{c} = 0 THEN 'ZERO_DENOMINATOR' ELSE 'CALCULATED_EXACT' END"
        rows.append(head.format(name, "ratio", f"CASE WHEN {c} + p_{c} <> 0 THEN {top}::DOUBLE / (({c} + p_{c}) / 2)::DOUBLE END", status, "NULL"))
    one, two = "AR IS NOT NULL AND p_AR IS NOT NULL", "AR_COMBINED IS NOT NULL AND p_AR_COMBINED IS NOT NULL"
    mixed = "(AR IS NOT NULL OR p_AR IS NOT NULL) AND (AR_COMBINED IS NOT NULL OR p_AR_COMBINED IS NOT NULL)"
    total = f"CASE WHEN {one} THEN AR + p_AR WHEN {two} THEN AR_COMBINED + p_AR_COMBINED END"
    rows.append(head.format("OPER_AR_TURNOVER", "ratio", f"CASE WHEN ({total}) <> 0 THEN TOTAL_REVENUE::DOUBLE / (({total}) / 2)::DOUBLE END", f"CASE WHEN TOTAL_REVENUE IS NULL THEN 'MISSING_INPUT' WHEN ({total}) = 0 THEN 'ZERO_DENOMINATOR' WHEN ({total}) IS NOT NULL THEN 'CALCULATED_EXACT' WHEN {mixed} OR coalesce(AR, AR_COMBINED) IS NULL THEN 'MISSING_INPUT' ELSE 'MISSING_PRIOR_PERIOD' END", f"CASE WHEN TOTAL_REVENUE IS NOT NULL AND ({total}) IS NULL AND {mixed} THEN 'MIXED_RECEIVABLE_BASIS_FORBIDDEN' END"))
    basis = "coalesce(INTEREST, FIN_EXP)"
    rows.append(head.format("SOLV_INTEREST_COVER", "ratio", f"CASE WHEN {basis} <> 0 THEN (TOTAL_PROFIT + {basis})::DOUBLE / {basis}::DOUBLE END", f"CASE WHEN TOTAL_PROFIT + {basis} IS NULL THEN 'MISSING_INPUT' WHEN {basis} = 0 THEN 'ZERO_DENOMINATOR' WHEN INTEREST IS NULL THEN 'CALCULATED_PROXY' ELSE 'CALCULATED_EXACT' END", "CASE WHEN INTEREST IS NULL AND TOTAL_PROFIT IS NOT NULL AND FIN_EXP <> 0 THEN 'PROXY_FIN_EXP' END"))
    for name, sum_ in (("EBITDA", "TOTAL_PROFIT + INTEREST + DEPRECIATION + AMORTISATION"), ("FREE_CASH_FLOW", "OCF - CAPEX")):
        rows.append(head.format(name, "yuan", f"({sum_})::DOUBLE", f"CASE WHEN {sum_} IS NULL THEN 'MISSING_INPUT' ELSE 'CALCULATED_EXACT' END", "NULL"))
    debt = ("ST_LOAN", "CUR_NONCUR_LIAB", "LT_LOAN", "BONDS", "LEASE_LIAB")
    rows.append(head.format("INTEREST_BEARING_DEBT", "yuan", f"({' + '.join(debt)})::DOUBLE", f"CASE WHEN coalesce({', '.join(debt)}) IS NULL THEN 'MISSING_INPUT' WHEN {' + '.join(debt)} IS NULL THEN 'PARTIAL_INPUT' ELSE 'CALCULATED_EXACT' END", "NULL"))
    wide = ", ".join(f"max(CASE WHEN item_code = '{c}' THEN value END) AS {c}" for c in _COLUMNS)
    before, listed = ", ".join(f"b.{c} AS p_{c}" for c in _COLUMNS), ", ".join(f"'{c}'" for c in _COLUMNS)
    return f"wide AS (SELECT company_id, period_end, {_PT.format('period_end')} AS pt, {wide} FROM facts WHERE item_code IN ({listed}) GROUP BY company_id, period_end), pairs AS (SELECT a.*, {before} FROM (SELECT *, {_PRIOR} AS prior_end FROM wide) a LEFT JOIN wide b ON a.company_id = b.company_id AND a.prior_end = b.period_end), res AS ({' UNION ALL '.join(rows)})"


_LINES = f"facts AS (SELECT n_name AS company_id, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS period_end, ({_COLUMNS})[(l_partkey % {len(_COLUMNS)}) + 1] AS item_code, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)"
_CHECKED = """sums AS (SELECT l_orderkey AS k, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(6,2)) * (1 + l_tax::DECIMAL(6,2))), 2)::DECIMAL(28,2) AS v FROM lineitem GROUP BY 1), tot AS (SELECT o_orderkey AS k, max(o_totalprice)::DECIMAL(28,2) AS v FROM orders GROUP BY 1),
res AS (SELECT coalesce(t.k, s.k) AS order_key, t.v - s.v AS difference, CASE WHEN t.v - s.v IS NOT NULL THEN 1.00::DECIMAL(28,2) END AS tolerance, CASE WHEN t.v - s.v IS NULL THEN 'NOT_RUN_MISSING_INPUT' WHEN abs(t.v - s.v) <= 1 THEN 'PASS' ELSE 'FAIL' END AS result, concat_ws(',', CASE WHEN t.v IS NULL THEN 'NET_PROFIT' END, CASE WHEN s.v IS NULL THEN 'CF_NET_PROFIT' END) AS missing FROM tot t FULL JOIN sums s ON t.k = s.k)"""
_RES = f"WITH {_REC}, {_FACTS}, {_formula_sql()}"
SQL = {
    "fact_normalisation": f"WITH {_REC} SELECT id, period_end, {_PT.format('period_end')} AS period_type, unit, unit_size, value, refusal FROM rec",
    "missing_dimensions": f"WITH {_REC} SELECT id, concat_ws(',', {', '.join(f'''CASE WHEN {d} IS NULL OR {d}::VARCHAR = '' THEN '{d}' END''' for d in A.DIMENSIONS)}) AS missing FROM rec",
    "admission_predicate": f"WITH {_REC} SELECT id, CASE WHEN statement_type IS NULL OR statement_type NOT IN ('annual', 'interim', 'quarterly') THEN 'statement_type' WHEN period_end IS NULL THEN 'period_end' WHEN scope IS NULL OR scope NOT IN ('consolidated', 'parent') THEN 'scope' WHEN unit_size IS NULL THEN 'unit' END AS failed_dimension FROM rec",
    "item_filter": f"WITH {_REC} SELECT id, item_code, value FROM rec WHERE scope = 'consolidated' AND period_end = DATE '2023-12-31'",
    "reconciliation": f'WITH {_INT}, {_STATE} SELECT company_id, period_end, scope, item_code, sources, "values", records, common_low, common_high, state FROM st',
    "value_index": f"WITH {_REC} SELECT company_id, period_end, scope, item_code, CASE count(DISTINCT value) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT value) = 1 THEN max(value) END AS value FROM rec GROUP BY company_id, period_end, scope, item_code",
    "uniform_summary": f"WITH {_REC} SELECT company_id, CASE WHEN count(DISTINCT unit) = 1 AND count(unit) = count(*) THEN max(unit) END AS unit, CASE WHEN count(DISTINCT scope) = 1 AND count(scope) = count(*) THEN max(scope) END AS scope, count(*) AS records FROM rec GROUP BY company_id",
    "metric_registry": f"{_RES} SELECT company_id, period_end, formula, display, round(value, 6) AS value, status, reason FROM res",
    "metric_status_counts": f"{_RES} SELECT formula, status, count(*) AS n FROM res GROUP BY ALL",
    "metrics_blocked": f"""{_RES}, {_INT.split('), iv AS', 1)[1].join(['iv AS', ''])}, {_STATE}, bad AS (SELECT DISTINCT company_id, item_code FROM st WHERE state = 'CONFLICT' AND scope = 'consolidated'), {_NEED}, stop AS (SELECT DISTINCT company_id, formula FROM bad JOIN need USING (item_code))
SELECT formula, CASE WHEN s.formula IS NOT NULL THEN 'BLOCKED' ELSE status END AS status, CASE WHEN s.formula IS NOT NULL THEN 'UNRESOLVED_CONFLICT' ELSE reason END AS reason, count(*) AS n FROM res LEFT JOIN stop s USING (company_id, formula) GROUP BY 1, 2, 3""",
    "line_metrics": f"WITH {_LINES}, {_formula_sql()} SELECT company_id, period_end, formula, display, round(value, 6) AS value, status, reason FROM res",
    "quick_ratio_policy": f"WITH {_LINES}, w AS (SELECT company_id, period_end, max(CASE WHEN item_code = 'CUR_ASSETS' THEN value END) AS a, max(CASE WHEN item_code = 'INVENTORY' THEN value END) AS i, max(CASE WHEN item_code = 'PREPAID' THEN value END) AS p, max(CASE WHEN item_code = 'CUR_LIAB' THEN value END) AS l, coalesce(max(CASE WHEN item_code = 'AR' THEN value END), 0) AS x, count(*) FILTER (item_code IN ('CUR_ASSETS', 'INVENTORY', 'PREPAID', 'CUR_LIAB')) AS n FROM facts GROUP BY 1, 2) SELECT company_id, period_end, round(CASE WHEN l <> 0 THEN (a - i - p - x)::DOUBLE / l::DOUBLE END, 6) AS value, CASE WHEN a + i + p + l IS NULL THEN 'MISSING_INPUT' WHEN l = 0 THEN 'ZERO_DENOMINATOR' ELSE 'CALCULATED_EXACT' END AS status FROM w WHERE n > 0",
    "source_checks": f"""WITH {_REC}, g AS (SELECT company_id, period_end, scope, source, item_code, count(DISTINCT value) AS n, max(value) AS v FROM rec WHERE company_id IS NOT NULL AND period_end IS NOT NULL AND scope IS NOT NULL AND source IS NOT NULL AND value IS NOT NULL GROUP BY ALL), c(ck, item_code) AS (VALUES ('BALANCE_SHEET_IDENTITY', 'TOTAL_ASSETS'), ('BALANCE_SHEET_IDENTITY', 'TOTAL_LIAB'), ('BALANCE_SHEET_IDENTITY', 'TOTAL_EQUITY'), ('CASH_BALANCE_RECONCILIATION', 'CASH_END'), ('CASH_BALANCE_RECONCILIATION', 'CASH_BEGIN'), ('CASH_BALANCE_RECONCILIATION', 'NET_CASH_INCREASE'), ('NET_INCOME_CASH_START', 'NET_PROFIT'), ('NET_INCOME_CASH_START', 'CF_NET_PROFIT'), ('REVENUE_COST_BREAKDOWN', 'OPER_REVENUE'), ('REVENUE_COST_BREAKDOWN', 'OPER_REVENUE_NOTES'), ('REVENUE_COST_BREAKDOWN', 'OPER_COST'), ('REVENUE_COST_BREAKDOWN', 'OPER_COST_NOTES')),
k AS (SELECT DISTINCT company_id, period_end, scope, source FROM g), o AS (SELECT *, row_number() OVER () AS pos FROM c), x AS (SELECT k.*, o.ck, o.pos, o.item_code, coalesce(g.n, 0) AS n FROM k CROSS JOIN o LEFT JOIN g USING (company_id, period_end, scope, source, item_code))
SELECT company_id, period_end, scope, source, ck AS "check", NULL::DECIMAL(28,2) AS difference, NULL::DECIMAL(28,2) AS tolerance, CASE WHEN bool_and(n = 1) THEN 'RUN' ELSE 'NOT_RUN_MISSING_INPUT' END AS result, coalesce(string_agg(item_code, ',' ORDER BY pos) FILTER (n = 0), '') AS missing, coalesce(string_agg(item_code, ',' ORDER BY pos) FILTER (n > 1), '') AS ambiguous FROM x GROUP BY ALL""",
    "order_total_checks": f"WITH {_CHECKED} SELECT * FROM res",
    "check_failed_records": f"WITH {_CHECKED} SELECT order_key || '|' || i AS record, 'NET_INCOME_CASH_START' AS \"check\" FROM res, (VALUES ('NET_PROFIT'), ('CF_NET_PROFIT')) v(i) WHERE result = 'FAIL'",
    "report_blocked": f"""WITH {_INT}, {_STATE}, sev AS (SELECT company_id, period_end, scope, item_code, source FROM iv WHERE company_id IS NOT NULL AND period_end IS NOT NULL AND scope IS NOT NULL AND item_code IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1), x AS (SELECT company_id, item_code, CASE WHEN scope <> 'consolidated' THEN NULL WHEN period_end IS NULL OR scope IS NULL OR item_code IS NULL OR source IS NULL THEN 'MISSING_DIMENSION'
 WHEN (company_id, period_end, scope, item_code, source) IN (SELECT (company_id, period_end, scope, item_code, source) FROM sev) THEN 'AMBIGUOUS_RESTATEMENT' WHEN (company_id, period_end, scope, item_code) IN (SELECT (company_id, period_end, scope, item_code) FROM st WHERE state = 'CONFLICT') THEN 'UNRESOLVED_CONFLICT' END AS kind FROM iv WHERE company_id IS NOT NULL),
y AS (SELECT company_id, kind <> 'MISSING_DIMENSION' OR coalesce(item_code IN ('TOTAL_ASSETS', 'TOTAL_LIAB', 'TOTAL_REVENUE'), false) AS b FROM x WHERE kind IS NOT NULL) SELECT company_id, count(*) AS exceptions, count(*) FILTER (b) AS blocking, bool_or(b) AS blocked FROM y GROUP BY 1""",
    "snapshot_admission": f"""WITH {_INT}, {_STATE}, sev AS (SELECT company_id, period_end, scope, item_code, source FROM iv WHERE company_id IS NOT NULL AND period_end IS NOT NULL AND scope IS NOT NULL AND item_code IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1)
SELECT id, CASE WHEN item_code = 'RND' OR scope <> 'consolidated' THEN 'SKIPPED' WHEN company_id IS NULL OR period_end IS NULL OR scope IS NULL OR item_code IS NULL OR source IS NULL THEN 'MISSING_DIMENSION'
 WHEN (company_id, period_end, scope, item_code, source) IN (SELECT (company_id, period_end, scope, item_code, source) FROM sev) THEN 'AMBIGUOUS_RESTATEMENT' WHEN (company_id, period_end, scope, item_code) IN (SELECT (company_id, period_end, scope, item_code) FROM st WHERE state = 'CONFLICT') THEN 'UNRESOLVED_CONFLICT' ELSE 'ADMITTED' END AS decision FROM iv""",
    "change_screen": f"WITH {_REC}, {_FACTS}, l AS (SELECT *, lag(period_end) OVER w AS prior_end, lag(value) OVER w AS pv FROM facts WINDOW w AS (PARTITION BY company_id, item_code ORDER BY period_end)) SELECT company_id, item_code, period_end, prior_end, round(((value - pv)::DOUBLE / nullif(abs(pv), 0)::DOUBLE), 6) AS change, coalesce(abs((value - pv)::DOUBLE / nullif(abs(pv), 0)::DOUBLE) >= 0.2, false) AS flagged FROM l WHERE prior_end IS NOT NULL",
    "share_screen": f"WITH {_REC}, {_FACTS}, m(item_code, side) AS (VALUES ('CASH', 'TOTAL_ASSETS'), ('AR', 'TOTAL_ASSETS'), ('INVENTORY', 'TOTAL_ASSETS'), ('PREPAID', 'TOTAL_ASSETS'), ('CUR_ASSETS', 'TOTAL_ASSETS'), ('ST_LOAN', 'TOTAL_LIAB'), ('LT_LOAN', 'TOTAL_LIAB'), ('BONDS', 'TOTAL_LIAB'), ('LEASE_LIAB', 'TOTAL_LIAB'), ('CUR_NONCUR_LIAB', 'TOTAL_LIAB'), ('CUR_LIAB', 'TOTAL_LIAB')), s AS (SELECT f.*, m.side, f.value::DOUBLE / nullif(t.value, 0)::DOUBLE AS share FROM facts f JOIN m USING (item_code) LEFT JOIN facts t ON t.company_id = f.company_id AND t.period_end = f.period_end AND t.item_code = m.side) SELECT company_id, period_end, side, item_code, round(share, 6) AS share, coalesce(share >= 0.15, false) AS flagged FROM s",
    "structure_ratio": f"WITH {_REC}, {_FACTS}, p AS (SELECT company_id, period_end, value AS part FROM facts WHERE item_code = 'CASH'), w AS (SELECT company_id, period_end, value AS whole FROM facts WHERE item_code = 'TOTAL_ASSETS') SELECT company_id, period_end, round(part::DOUBLE / nullif(whole, 0)::DOUBLE, 6) AS ratio, CASE WHEN part IS NULL THEN 'missing_part' WHEN whole IS NULL THEN 'missing_whole' WHEN whole = 0 THEN 'zero_whole' END AS gap FROM p FULL JOIN w USING (company_id, period_end)",
    "trend_relation": f"WITH {_REC}, {_FACTS}, u AS (SELECT company_id, period_end, item_code, max(unit_size) AS unit FROM rec WHERE scope = 'consolidated' AND period_end IS NOT NULL AND company_id IS NOT NULL AND unit_size IS NOT NULL GROUP BY ALL), l AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY company_id, item_code ORDER BY period_end)) AS s FROM facts JOIN u USING (company_id, period_end, item_code)), g AS (SELECT company_id, item_code, count(*) AS periods, count(DISTINCT unit) AS units, min(s) AS lo, max(s) AS hi FROM l GROUP BY 1, 2), r AS (SELECT *, CASE WHEN periods < 2 THEN 'too_few_periods' WHEN units > 1 THEN 'unit_mismatch' END AS reason FROM g) SELECT company_id, item_code, periods, CASE WHEN reason IS NOT NULL THEN NULL WHEN lo > 0 THEN 'increased' WHEN hi < 0 THEN 'decreased' WHEN lo = 0 AND hi = 0 THEN 'unchanged' ELSE 'mixed' END AS trend, reason FROM r",
    "annual_delta": f"WITH {_REC}, {_FACTS}, y AS (SELECT *, row_number() OVER (PARTITION BY company_id, item_code ORDER BY period_end DESC) AS n FROM facts WHERE strftime(period_end, '%m-%d') = '12-31'), p AS (SELECT company_id, item_code, count(*) AS ends, max(CASE WHEN n = 1 THEN period_end END) AS current_end, max(CASE WHEN n = 2 THEN period_end END) AS prior_end, max(CASE WHEN n = 1 THEN value END) AS cv, max(CASE WHEN n = 2 THEN value END) AS pv FROM y WHERE n <= 2 GROUP BY 1, 2), r AS (SELECT *, CASE WHEN ends < 2 THEN 'fewer_than_two_year_ends' WHEN year(current_end) - year(prior_end) <> 1 THEN 'not_adjacent' END AS refusal FROM p) SELECT company_id, item_code, current_end, prior_end, CASE WHEN refusal IS NULL THEN cv - pv END AS delta, refusal FROM r",
    "prior_period_join": f"WITH {_REC}, {_FACTS}, f AS (SELECT *, {_PT.format('period_end')} AS pt FROM facts), g AS (SELECT *, {_PRIOR} AS prior_end FROM f) SELECT g.company_id, g.item_code, g.period_end, g.prior_end, g.value, b.value AS prior_value, CASE WHEN month(g.period_end) = 12 AND month(g.prior_end) = 12 AND year(g.period_end) = year(g.prior_end) + 1 THEN 'yoy' WHEN month(g.period_end) IN (3, 6, 9) AND month(g.prior_end) = 12 AND year(g.period_end) = year(g.prior_end) + 1 THEN 'vs_prior_year_end' ELSE 'other' END AS label FROM g LEFT JOIN facts b ON g.company_id = b.company_id AND g.item_code = b.item_code AND g.prior_end = b.period_end",
    "focus_periods": f"WITH {_REC}, {_FACTS}, e AS (SELECT DISTINCT company_id, period_end, {_PT.format('period_end')} AS period_type FROM facts), n AS (SELECT *, row_number() OVER (PARTITION BY company_id, period_type ORDER BY period_end DESC) AS n FROM e) SELECT company_id, period_end, period_type FROM n WHERE n = 1 OR (period_type = 'annual' AND n <= 3)",
    "number_identity": f"WITH {_REC} SELECT a.id AS a_id, b.id AS b_id, CASE WHEN a.period_end IS NULL OR b.period_end IS NULL THEN 'INCOMPARABLE' WHEN a.period_end <> b.period_end THEN 'DIFFERENT_PERIOD_END' WHEN a.scope IS NULL OR b.scope IS NULL THEN 'INCOMPARABLE' WHEN a.scope <> b.scope THEN 'DIFFERENT_SCOPE' WHEN a.unit IS NULL OR b.unit IS NULL THEN 'INCOMPARABLE' WHEN a.unit <> b.unit THEN 'DIFFERENT_UNIT' WHEN a.value IS NULL OR b.value IS NULL THEN 'INCOMPARABLE' WHEN a.value = b.value THEN 'SAME' ELSE 'CONFLICT' END AS relation FROM rec a JOIN rec b ON a.company_id = b.company_id AND a.item_code = b.item_code AND a.source = b.source AND a.id < b.id",
    "uncovered_periods": f"WITH {_REC}, {_FACTS} SELECT company_id, period_end FROM facts WHERE item_code = 'TOTAL_REVENUE' AND (company_id, period_end) NOT IN (SELECT (company_id, period_end) FROM facts WHERE item_code = 'NET_PROFIT')",
    "required_input_gaps": f"WITH {_REC}, {_FACTS}, l AS (SELECT company_id, max(period_end) AS period_end FROM facts WHERE month(period_end) = 12 GROUP BY 1), {_NEED}, x AS (SELECT * FROM l CROSS JOIN need) SELECT x.company_id, x.period_end, formula, count(*) AS needed FROM x LEFT JOIN facts f ON x.company_id = f.company_id AND x.period_end = f.period_end AND x.item_code = f.item_code GROUP BY 1, 2, 3 HAVING count(f.value) = 0",
    "metric_table": f"{_RES}, l AS (SELECT company_id, max(period_end) AS period_end FROM facts WHERE month(period_end) = 12 GROUP BY 1) SELECT company_id, period_end, {', '.join(f'''round(max(CASE WHEN formula = '{n}' THEN value END), 6) AS {n}''' for n in (line.split()[0] for line in _READS.split(';')))} FROM res JOIN l USING (company_id, period_end) GROUP BY 1, 2",
    "supplier_statement": "SELECT n_name, last_day((date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH)::DATE) AS period_end, sum(l_extendedprice::DECIMAL(18,2)) AS gross, sum(l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(6,2)) AS discounted, sum(l_quantity) AS quantity, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2",
}
