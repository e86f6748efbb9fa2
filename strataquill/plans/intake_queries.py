"""Queries over sources, versions, periods and targets of questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import columns as C
from strataquill.functions import periods as P
from strataquill.functions.columns import item_text
from strataquill.operators import facts as A
from strataquill.operators import governance as G
from strataquill.operators import intake as I
from strataquill.operators import intervals as N
from strataquill.operators import metrics
from strataquill.operators import retrieval as R
from strataquill.operators import structure as S
from strataquill.operators import verify as V
from strataquill.plans import evidence_queries
from strataquill.plans import fact_queries as Q
from strataquill.session import table

VERSION = ["company_id", "document_id", "document_version"]
# Names that questions use for metrics and fields, without blanks and in lower case, and detail words that veto a total.
METRIC_ALIASES = {"资产负债率": "SOLV_DEBT_RATIO", "流动比率": "SOLV_CURRENT_RATIO", "速动比率": "SOLV_QUICK_RATIO", "净利率": "PROF_NET_MARGIN", "毛利率": "PROF_GROSS_MARGIN", "净资产收益率": "PROF_ROE", "总资产周转率": "OPER_ASSET_TURNOVER", "存货周转率": "OPER_INV_TURNOVER", "自由现金流": "FREE_CASH_FLOW"}
FIELD_ALIASES = {"货币资金": "CASH", "应收账款": "AR", "存货": "INVENTORY", "营业总收入": "TOTAL_REVENUE", "净利润": "NET_PROFIT", "资产总计": "TOTAL_ASSETS", "负债合计": "TOTAL_LIAB", "短期借款": "ST_LOAN", "应付债券": "BONDS", "研发费用": "RND", "负债": "TOTAL_LIAB", "利润": "NET_PROFIT"}
BLOCKERS = {"CASH": ("受限",), "INVENTORY": ("跌价", "原材料"), "AR": ("坏账", "账龄")}


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_versions")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_blocks")


def source_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of every source address, each put under one of five sites by its page, as the table only has local addresses."""
    sites = F.array(*map(F.lit, ("https://www.csrc.gov.cn:443/", "http://user@static.cninfo.com.cn/", "https://finance.sina.com.cn/", "https://notgov.cn/", "")))
    rows = _blocks(spark, sf_dir).select("evidence_id", F.concat(F.element_at(sites, (F.col("page_number") % 5 + 1).cast("int")), F.coalesce("source_uri", F.lit(""))).alias("url")).distinct()
    return rows.select("evidence_id", "url", I.host_of(F.col("url")).alias("host"), I.source_grade(F.col("url")).alias("grade"))


def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("source_name", I.source_type(F.col("source_name")).alias("inferred_type")).distinct()


def registered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.register_sources(_versions(spark, sf_dir))


def quarantined_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.integrity_failures(_blocks(spark, sf_dir), _versions(spark, sf_dir), VERSION)


def released_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks per version outside quarantine; null keys are in no quarantine."""
    blocks = _blocks(spark, sf_dir)
    return I.without_quarantined(blocks, I.integrity_failures(blocks, _versions(spark, sf_dir), VERSION), VERSION).groupBy(*VERSION).agg(F.count("*").alias("blocks"))


def inventory_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded versions against the versions that have blocks."""
    return I.inventory_difference(_versions(spark, sf_dir), _blocks(spark, sf_dir), VERSION)


def version_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions known from either side, each once."""
    return _versions(spark, sf_dir).select(*VERSION).union(_blocks(spark, sf_dir).select(*VERSION)).distinct()


def version_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, pages and kinds per version; versions are never merged."""
    rows = _blocks(spark, sf_dir).select(*VERSION, "evidence_id", "page_number", "evidence_type").distinct()
    return rows.groupBy(*VERSION).agg(F.count("*").alias("blocks"), F.count_distinct("page_number").alias("pages"), F.concat_ws(",", F.array_sort(F.collect_set("evidence_type"))).alias("kinds"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.first_per_key(table(spark, sf_dir, "run_manifest"), ["run_id"], "created_at", "manifest_json")
    at = lambda name: F.get_json_object("manifest_json", f"$.{name}").alias(name)
    return rows.select("run_id", "created_at", *(at(n) for n in ("company_id", "dataset_sha256", "contract_version", "router_fingerprint", "report_as_of"))).where("company_id is not null")


def resume_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each run may go on from the company's run before it."""
    return I.resume_check(_manifests(spark, sf_dir), "company_id", "created_at", ["dataset_sha256"], ["contract_version", "router_fingerprint"]).select("run_id", "outcome")


def as_of_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the exact date a run is as of; a date without figures is not replaced by an earlier one."""
    counts = Q._facts(spark, sf_dir).groupBy("company_id", F.col("period_end").cast("string").alias("report_as_of")).agg(F.count("*").alias("figures"))
    joined = _manifests(spark, sf_dir).join(counts, ["company_id", "report_as_of"], "left")
    return joined.select("run_id", "report_as_of", F.coalesce("figures", F.lit(0)).alias("figures"), F.when(F.col("report_as_of").isNull(), "NO_AS_OF").when(F.col("figures").isNull(), "NO_SNAPSHOT").otherwise("OK").alias("outcome"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the evaluation cases, and one for every reported figure and for every second metric name beside it."""
    cases = table(spark, sf_dir, "retrieval_eval_case").where("question is not null").select(F.col("case_id").alias("question_id"), "company_id", "question")
    names = F.array(*map(F.lit, METRIC_ALIASES))
    figures = table(spark, sf_dir, "report_meta").where("item_name_cn is not null and id is not null").select("id", "company_id", "report_period", "item_name_cn").distinct()
    year = F.substring("report_period", 1, 4)
    asked = figures.select(F.concat(F.lit("f-"), F.col("id")).alias("question_id"), "company_id", F.concat_ws("", year, F.lit("年"), F.col("item_name_cn"), F.when(F.length("item_name_cn") % 2 == 0, F.lit("是多少")).otherwise(F.lit("受限部分是多少"))).alias("question"))
    ratios = figures.select(F.concat(F.lit("m-"), F.col("id")).alias("question_id"), "company_id", F.concat_ws("", year, F.lit("年"), F.element_at(names, (F.length("item_name_cn") % len(METRIC_ALIASES) + 1).cast("int")), F.lit("如何，"), F.when(year.cast("int") % 2 == 0, F.lit("毛利率呢"))).alias("question"))
    return cases.unionByName(asked).unionByName(ratios).dropDuplicates(["question_id"])


def question_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = I.question_target(F.col("question"), METRIC_ALIASES, FIELD_ALIASES, BLOCKERS)
    return _questions(spark, sf_dir).withColumn("t", target).select("question_id", "company_id", "t.target_type", "t.code", "t.reason", I.question_period(F.col("question")).alias("period"))


def structured_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the questions ask for, looked up in the figures and metrics of their companies."""
    rows = Q._records(spark, sf_dir).where("scope = 'consolidated' and period_end is not null and company_id is not null")
    fields = A.value_index(rows, ["company_id", "period_end", "item_code"])
    requests = question_targets(spark, sf_dir).select(F.col("question_id").alias("request_id"), "company_id", "target_type", "code", F.col("period").try_cast("date").alias("period_end"))
    out = R.structured_lookup(requests, fields, metrics.compute(Q._facts(spark, sf_dir)))
    return out.select("request_id", "target_type", "code", F.round("value", 6).alias("value"), "outcome")


def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of a company at its last two year ends: change and direction, or what is missing."""
    rows = metrics.compute(Q._line_facts(spark, sf_dir)).where("month(period_end) = 12")
    ends = rows.groupBy("company_id").agg(F.array_sort(F.collect_set("period_end")).alias("e")).select("company_id", F.try_element_at("e", F.lit(-2)).alias("period_a"), F.try_element_at("e", F.lit(-1)).alias("period_b"))
    usable = rows.where("status in ('CALCULATED_EXACT', 'CALCULATED_PROXY')")
    side = lambda s: usable.select("company_id", "formula", F.col("period_end").alias(f"period_{s}"), F.col("value").alias(f"value_{s}"))
    wanted = ends.crossJoin(spark.createDataFrame([(n,) for n in metrics.FORMULAS], "formula string"))
    both = wanted.join(side("a"), ["company_id", "formula", "period_a"], "left").join(side("b"), ["company_id", "formula", "period_b"], "left")
    change = F.col("value_b") - F.col("value_a")
    lacking = F.when(F.col("value_a").isNull() & F.col("value_b").isNull(), "unavailable").when(F.col("value_a").isNull() | F.col("value_b").isNull(), "missing_period")
    relation = F.coalesce(lacking, F.when(change > 0, "increased").when(change < 0, "decreased").otherwise("unchanged"))
    return both.select("company_id", "formula", "period_a", "period_b", F.round(change.cast("double"), 5).alias("change"), relation.alias("relation"))


def anchor_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date each page of a document version names."""
    rows = _blocks(spark, sf_dir).select("document_id", "document_version", "page_number", P.anchor_period(F.col("text")).alias("p"))
    return rows.groupBy("document_id", "document_version", "page_number").agg(F.max("p").alias("anchor")).where("anchor is not null")


def header_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of publication and periods of reports, read as column headers."""
    rows = _blocks(spark, sf_dir).select(F.explode(F.array("published_at", "report_period", "document_version")).alias("header")).where("header is not null").distinct()
    return rows.withColumn("h", P.header_period(F.col("header"))).select("header", "h.period", "h.period_type")


def relative_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative headers resolved against the period of every report."""
    words = spark.createDataFrame([("期末余额",), ("年初余额",), ("2021年中报",), ("项目",)], "header string")
    anchors = table(spark, sf_dir, "report_meta").select("report_period", "report_type").distinct()
    rows = anchors.crossJoin(F.broadcast(words)).withColumn("h", P.resolved_header(F.col("header"), F.col("report_period"), F.col("report_type")))
    return rows.select("report_period", "report_type", "header", "h.period", "h.period_type")


def period_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of reports put in words, as points in time and as stretches."""
    rows = table(spark, sf_dir, "report_meta").select("report_period").where("report_period is not null").distinct()
    return rows.select("report_period", P.period_expression(F.col("report_period"), F.lit("end")).alias("at_end"), P.period_expression(F.col("report_period"), F.lit("flow")).alias("over"))


def explicit_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one period each paragraph names, if it is one."""
    rows = _blocks(spark, sf_dir).where("evidence_type = 'paragraph'").select("evidence_id", "text").distinct()
    return rows.withColumn("p", P.explicit_period(F.col("text"))).select("evidence_id", "p.status", "p.period", "p.candidates")


def compared_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year ends that questions compare, out of those of their companies."""
    available = Q._facts(spark, sf_dir).groupBy("company_id").agg(F.collect_set(F.col("period_end").cast("string")).alias("available"))
    words = spark.createDataFrame([("a", "近三年收入如何"), ("b", "2022年至2024年收入"), ("c", "2023年净利润有何变化"), ("d", "2023年净利润"), ("e", "收入趋势")], "question_id string, question string")
    rows = available.crossJoin(F.broadcast(words))
    return rows.select("company_id", "question_id", F.concat_ws(",", P.comparison_periods(F.col("question"), F.col("available"))).alias("periods"))


def late_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of a later period than the given cutoff."""
    return table(spark, sf_dir, "report_meta").select("id", P.scope_is_late(F.col("report_period"), F.lit("2023Q3")).alias("late")).distinct()


def blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the state of every answered question blocks."""
    rows = table(spark, sf_dir, "question_outcome").select("run_id", "question_id", "status", "success").distinct()
    state = F.when(F.col("status") == "COMPLETED", "SATISFIED").when(F.col("status") == "BLOCKED", "CONFLICT").otherwise(F.col("status"))
    policy = F.when(F.col("success") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("JOB_BLOCKED"), F.lit("REPORT_BLOCKED")))
    return rows.select("run_id", "question_id", "status", "success", F.concat_ws(",", I.blocking_levels(state, policy)).alias("levels"))


def revenue_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by code, and titles of sections by their words."""
    items = table(spark, sf_dir, "report_meta").select("item_code", F.lit(None).cast("string").alias("title"))
    titles = table(spark, sf_dir, "section_titles").select(F.lit(None).cast("string").alias("item_code"), "title")
    labels = _blocks(spark, sf_dir).where("evidence_type = 'table_row'").select(F.lit(None).cast("string").alias("item_code"), F.col("text").alias("title"))
    rows = items.union(titles).union(labels).distinct()
    return rows.select("item_code", "title", I.revenue_cost_class(F.col("item_code"), F.col("title")).alias("category"))


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of blocks as text, and read back."""
    rows = _blocks(spark, sf_dir).select("evidence_id", "page_number", "block_index").distinct()
    coded = rows.withColumn("locator", I.encode_locator(F.lit("page"), page=F.col("page_number"), block=F.col("block_index"))).withColumn("d", I.decode_locator(F.col("locator")))
    return coded.select("evidence_id", "locator", F.col("d.page").alias("page"), F.col("d.block").alias("block"))


def pending_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings whose title maps to none or several codes and has no decision: those of level 1 are decided."""
    titles = table(spark, sf_dir, "section_titles")
    rules = titles.select(F.col("title").alias("alias"), F.concat(F.lit("T"), F.col("level").cast("string")).alias("code"), F.lit(None).cast("string").alias("exclude"))
    labels = _blocks(spark, sf_dir).where("evidence_type = 'heading' and text is not null").select("evidence_id", "text").distinct()
    mapped = A.map_items(labels, "text", rules)
    decided = titles.where("level = 1").select(item_text(F.col("title")).alias("label")).distinct()
    return mapped.where("mapping_status != 'mapped'").withColumn("label", item_text(F.col("text"))).join(decided, "label", "left_anti").select("evidence_id", "label", "mapping_status")


def context_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows every table, up to 5 blocks, 2 pages and 2,000 characters, before the next heading."""
    blocks = _blocks(spark, sf_dir).dropDuplicates(["evidence_id"])
    anchors = blocks.where("evidence_type = 'table'").select("document_id", "document_version", F.col("evidence_id").alias("anchor_id"), "page_number", "block_index")
    return R.expand(blocks, anchors, ["document_id", "document_version"], 5, 2, 2000)


def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of one label; the filter goes before the ranking."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.nearest(R.filtered(vectors, label=3), "vec_id", "embedding", asked, "query_id", "q", 10)


def equivalent_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that are a section title but for width and invisible characters."""
    heads = _blocks(spark, sf_dir).where("evidence_type = 'heading' and text is not null").select("evidence_id", "text").distinct()
    titles = table(spark, sf_dir, "section_titles").select("title_id", "title")
    return heads.join(F.broadcast(titles), C.equivalent(F.col("text"), F.col("title"), True)).select("evidence_id", "title_id")


def inner_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within paragraphs that are headings."""
    rows = _blocks(spark, sf_dir).where("evidence_type = 'paragraph' and text is not null").select("evidence_id", "text").distinct()
    return rows.select("evidence_id", F.explode(C.heading_spans(F.col("text"))).alias("h")).select("evidence_id", "h.*")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to tables and other places in paragraphs."""
    rows = _blocks(spark, sf_dir).where("evidence_type = 'paragraph'").select("evidence_id", "text").distinct()
    return S.reference_occurrences(rows, "evidence_id", "text")


def toc_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that the paths of a document announce against its headings: matched, toc_only or body_only."""
    label = lambda c: item_text(F.col(c))
    toc = _blocks(spark, sf_dir).where("document_id is not null").select("document_id", F.explode("section_path").alias("t")).select("document_id", label("t").alias("title")).where("title != ''").distinct()
    body = _blocks(spark, sf_dir).where("evidence_type = 'heading' and document_id is not null").select("document_id", label("text").alias("title")).where("title != ''").distinct()
    both = toc.withColumn("a", F.lit(1)).join(body.withColumn("b", F.lit(1)), ["document_id", "title"], "full")
    return both.select("document_id", "title", F.when(F.col("a").isNull(), "body_only").when(F.col("b").isNull(), "toc_only").otherwise("matched").alias("state"))


def span_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the line stretches of each group account for every order number once."""
    return N.conservation(*evidence_queries._spans(spark, sf_dir), ["g"])


def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on report headers, counted by verdict."""
    c = F.col
    rules = {
        "period_given": (F.lit(True), c("report_period").isNotNull()), "annual_at_year_end": (c("report_type") == "annual", c("report_period").endswith("-12-31")),
        "unit_in_one_place": (c("amount_unit").isNotNull(), c("unit_note").isNull()), "amount_not_zero": (c("amount").isNotNull(), c("amount") != 0),
    }
    return G.evaluate_rules(table(spark, sf_dir, "report_meta").dropDuplicates(["id"]), ["id"], rules).groupBy("rule", "verdict").agg(F.count("*").alias("n"))


def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every company is cited from enough sources of some grade."""
    rows = source_grades(spark, sf_dir).select(F.col("url").alias("source"), "grade", "evidence_id").join(_blocks(spark, sf_dir).select("evidence_id", "company_id").distinct(), "evidence_id")
    return G.source_policy(rows.where("company_id is not null"), ["company_id"], "grade", {"A": 3, "B": 5, "C": 8, "D": 20})


def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of the snapshot of every company: its admitted figures under the rules of this version."""
    rows = Q._intervals(spark, sf_dir)
    admitted = A.admit(rows, A.reconcile(rows, Q.KEYS), Q.KEYS, rows.where("false").select("id"), "id", "consolidated", "CNY").where("decision = 'ADMITTED'")
    return G.snapshots(admitted, ["company_id"], "id", "rules-1")


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the share of their pages with hardly any text."""
    pages = _blocks(spark, sf_dir).select("document_id", "document_version", "page_number", "block_index", "text").distinct().groupBy("document_id", "document_version", "page_number").agg(F.sum(F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s", ""))).alias("n"))
    return G.page_quality(pages.withColumn("text", F.repeat(F.lit("x"), F.least("n", F.lit(100)).cast("int"))), ["document_id", "document_version"], "text")


def document_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of all numbered headings."""
    heads = _blocks(spark, sf_dir).where("evidence_type = 'heading' and document_id is not null").dropDuplicates(["evidence_id"]).withColumn("level", C.heading_level(F.col("text")))
    return S.outline(heads, ["document_id", "document_version"], ["page_number", "block_index", "evidence_id"], "evidence_id", "level")


def contents_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lines that the titles and the first pages they stand on would make, read back."""
    pages = _blocks(spark, sf_dir).where("evidence_type = 'heading' and document_id is not null and text is not null").groupBy("document_id", "text").agg(F.min("page_number").alias("p"))
    lines = pages.select("document_id", F.concat_ws("\n", F.lit("目录"), F.concat("text", F.lit(" ...... "), F.col("p").cast("string")), F.concat("text", F.lit("     "), F.col("p").cast("string"))).alias("text"))
    return S.toc_entries(lines, ["document_id"], "text").distinct()


def note_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.note_cells(_blocks(spark, sf_dir).where("evidence_type = 'table_row'").select("evidence_id", "text").distinct(), "evidence_id", "text")


def table_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables with the title of their table."""
    rows = _blocks(spark, sf_dir).dropDuplicates(["evidence_id"])
    return S.with_table_context(rows, ["document_id", "document_version"], ["page_number", "block_index", "evidence_id"]).select("evidence_id", "table_id", "table_title")


def amounts_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of table rows, by their own unit or that of the figures reported for the company and period."""
    rows = _blocks(spark, sf_dir).where("evidence_type = 'table_row' and text is not null").select("evidence_id", "text", "company_id", "report_period").distinct()
    header = F.when(F.col("company_id") == "CX000001", F.lit("万元"))
    return V.amounts_in_context(rows, "evidence_id", F.col("text"), header, F.when(F.col("report_period").endswith("-12-31"), F.lit("千元")))


def scope_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that may not back a claim about the end of 2023 from annual reports and circulars, by reason."""
    reason = V.scope_drop(F.col("report_period"), F.col("source_type"), F.lit("2023-12-31"), ("annual_report", "debt_circular"))
    return _blocks(spark, sf_dir).select("evidence_id", reason.alias("reason")).distinct().groupBy("reason").agg(F.count("*").alias("n"))


def value_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money amounts of the first paragraph of documents: still in the rest of the document, and in the figures of the company?"""
    docs = table(spark, sf_dir, "documents").where("company_id is not null").select("doc_id", "company_id", F.split("text", "\n\n").alias("p"))
    keys = ["doc_id", "company_id", "value"]
    held = lambda text: V.amounts(docs.withColumn("__t", text), "doc_id", F.col("__t")).where("kind = 'money'").join(docs.select("doc_id", "company_id"), "doc_id").select(*keys)
    claimed = held(F.get("p", F.lit(0)))
    figures = Q._records(spark, sf_dir).where("value is not null and company_id is not null").select("company_id", F.col("value").cast("decimal(34,4)").alias("value")).distinct()
    return V.value_trace(claimed, {"in_rest": held(F.array_join(F.slice("p", F.lit(2), F.size("p")), "\n\n")), "in_figures": claimed.join(figures, ["company_id", "value"])}, keys)


QUERIES = {
    f.__name__: f
    for f in (document_outline, contents_entries, note_cells, table_context, amounts_in_context, scope_drops, value_trace, equivalent_titles, inner_headings, references, toc_reconciliation, span_conservation, rule_verdicts, source_policy, snapshot_ids, page_quality, source_grades, source_types, registered_sources, quarantined_versions, released_blocks, inventory_difference, version_union, version_rollup, resume_outcomes, as_of_selection, question_targets, structured_lookup, period_comparison, anchor_dates, header_periods, relative_headers, period_words, explicit_periods, compared_periods, late_scopes, blocking, revenue_cost, locators, pending_mappings, context_expansion, dense_filtered)
}

_V = "company_id, document_id, document_version"
_NORM = lambda c: f"lower(regexp_replace(translate({c}, '{_WIDE}', '{_SLIM}'), '[\\s.,，。()]+', '', 'g'))"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_SLIM = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")
_LABEL = lambda c: f"regexp_replace(regexp_replace(lower(translate({c}, '{_WIDE}', '{_SLIM}')), '^\\s*([(\\[{{【]?\\s*[0-9]+\\s*[)\\]}}】]?\\s*[、.:]+|[(\\[{{【]\\s*[0-9一二三四五六七八九十百]+\\s*[)\\]}}】]|[一二三四五六七八九十百]+\\s*[、.:])\\s*', ''), '[^0-9a-z_一-鿿]', '', 'g')"
_BAD = f"""bad AS (SELECT {_V}, 'HASH_CONFLICT' AS reason FROM evidence_blocks GROUP BY {_V}, evidence_id HAVING count(DISTINCT content_hash) > 1
 UNION ALL SELECT b.company_id, b.document_id, b.document_version, unnest(list_filter([CASE WHEN hi > page_count OR lo < 1 THEN 'PAGE_OUT_OF_RANGE' END, CASE WHEN v.n IS NULL THEN 'NO_VERSION' END], lambda x: x IS NOT NULL)) FROM (SELECT {_V}, max(page_number) AS hi, min(page_number) AS lo FROM evidence_blocks GROUP BY ALL) b LEFT JOIN (SELECT {_V}, max(page_count) AS page_count, count(*) AS n FROM document_versions GROUP BY ALL) v ON b.company_id = v.company_id AND b.document_id = v.document_id AND b.document_version = v.document_version),
q AS (SELECT {_V}, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM bad GROUP BY ALL)"""
_MAN = """man AS (SELECT run_id, created_at, manifest_json->>'$.company_id' AS company_id, manifest_json->>'$.dataset_sha256' AS d, manifest_json->>'$.contract_version' AS c, manifest_json->>'$.router_fingerprint' AS r, manifest_json->>'$.report_as_of' AS report_as_of FROM (SELECT run_id, created_at, CASE WHEN json_valid(manifest_json) THEN manifest_json::JSON END AS manifest_json FROM (SELECT * FROM run_manifest QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, manifest_json) = 1)) WHERE company_id IS NOT NULL)"""


def _header_sql(c: str) -> str:
    """The nine wordings in DuckDB, in their order."""
    text = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    g = lambda p, n: f"regexp_extract({text}, '{p}', {n})"
    cut = lambda x, hi: f"least(greatest(try_cast({x} AS INT), 1), {hi})"
    two = lambda x: f"lpad(({x})::VARCHAR, 2, '0')"
    date, month = "([0-9]{4})[年./\\-]([0-9]{1,2})[月./\\-]([0-9]{1,2})[日号]?", "([0-9]{4})[年./\\-]([0-9]{1,2})[月./\\-]?"
    m = cut(g(month, 2), 12)
    last = f"CASE WHEN {m} IN (1, 3, 5, 7, 8, 10, 12) THEN 31 ELSE 30 END"
    quarters = ["([0-9]{4})年?第?\\s*([一二三四1-4])\\s*季度", "([0-9]{4})年?([一二三四1-4])季报", "([0-9]{4})[Qq]([1-4])"]
    ends = "[' ', '03-31', '06-30', '09-30', '12-31']"
    out = f"CASE WHEN regexp_matches({text}, '{date}') THEN {g(date, 1)} || '-' || {two(cut(g(date, 2), 12))} || '-' || {two(cut(g(date, 3), 31))} WHEN regexp_matches({text}, '{month}') THEN {g(month, 1)} || '-' || {two(m)} || '-' || {two(last)}"
    for p in quarters:
        out += f" WHEN regexp_matches({text}, '{p}') THEN {g(p, 1)} || '-' || {ends}[try_cast(translate({g(p, 2)}, '一二三四', '1234') AS INT) + 1]"
    for p, end in (("([0-9]{4})年?半年?度?", "06-30"), ("([0-9]{4})年?中报", "06-30"), ("([0-9]{4})年?年度?", "12-31"), ("^([0-9]{4})$", "12-31")):
        out += f" WHEN regexp_matches({text}, '{p}') THEN {g(p, 1)} || '-{end}'"
    return out + " END"


_KIND = lambda h, p: f"CASE WHEN {p} IS NULL THEN NULL WHEN regexp_matches({h}, '季度|季报|[0-9][Qq][1-4]') AND NOT regexp_matches({h}, '[0-9]{{4}}[年./-][0-9]') THEN 'quarterly' WHEN {p} LIKE '%-12-31' THEN 'annual' WHEN {p} LIKE '%-06-30' THEN 'interim' ELSE 'quarterly' END"
_WORDS = lambda c, s: f"CASE WHEN NOT regexp_full_match({c}, '[0-9]{{4}}-(0[1-9]|1[0-2])-[0-9]{{2}}') THEN {c} ELSE {c}[1:4] || CASE {c}[6:7] {s} END END"
_ALIASES = lambda name, d: f"{name}(alias, code) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in d.items()) + ")"
_TARGETS = f"""{_ALIASES('ma', METRIC_ALIASES)}, {_ALIASES('fa', FIELD_ALIASES)}, fig AS (SELECT DISTINCT id, company_id, report_period, item_name_cn FROM report_meta WHERE item_name_cn IS NOT NULL AND id IS NOT NULL),
asked AS (SELECT case_id AS question_id, company_id, question FROM retrieval_eval_case WHERE question IS NOT NULL UNION ALL SELECT 'f-' || id, company_id, concat(report_period[1:4], '年', item_name_cn, CASE WHEN length(item_name_cn) % 2 = 0 THEN '是多少' ELSE '受限部分是多少' END) FROM fig
 UNION ALL SELECT 'm-' || id, company_id, concat(report_period[1:4], '年', ({list(METRIC_ALIASES)})[length(item_name_cn) % {len(METRIC_ALIASES)} + 1], '如何，', CASE WHEN report_period[1:4]::INT % 2 = 0 THEN '毛利率呢' END) FROM fig), qs AS (SELECT *, lower(regexp_replace(translate(question, '{_WIDE}', '{_SLIM}'), '\\s+', '', 'g')) AS t FROM asked),
al AS (SELECT 'm' AS k, * FROM ma UNION ALL SELECT 'f', * FROM fa), sp AS (SELECT question_id, k, code, i AS a, i + length(alias) AS b FROM (SELECT qs.question_id, qs.t, al.*, unnest(range(1, length(t) + 1)) AS i FROM qs JOIN al ON contains(qs.t, al.alias)) WHERE substr(t, i, length(alias)) = alias),
mx AS (SELECT * FROM sp s WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.question_id = s.question_id AND o.k = s.k AND (o.a, o.b, o.code) <> (s.a, s.b, s.code) AND o.a <= s.a AND s.b <= o.b)), cd AS (SELECT question_id, count(DISTINCT code) FILTER (k = 'm') AS mn, max(code) FILTER (k = 'm') AS mc, count(DISTINCT code) FILTER (k = 'f') AS fn, max(code) FILTER (k = 'f') AS fc FROM mx GROUP BY 1),
tg AS (SELECT question_id, company_id, CASE WHEN mn = 1 THEN 'metric' WHEN coalesce(mn, 0) = 0 AND fn = 1 AND NOT veto THEN 'field' END AS target_type, CASE WHEN mn = 1 THEN mc WHEN coalesce(mn, 0) = 0 AND fn = 1 AND NOT veto THEN fc END AS code, CASE WHEN mn > 1 THEN 'ambiguous_metric' WHEN mn = 1 THEN NULL WHEN coalesce(fn, 0) = 0 THEN 'no_target' WHEN fn > 1 THEN 'ambiguous_field' WHEN veto THEN 'sub_item' END AS reason,
 CASE WHEN len(list_distinct(ys)) = 1 THEN ys[1] || '-12-31' END AS period FROM (SELECT qs.*, cd.*, regexp_extract_all(question, '(?:19|20)[0-9]{{2}}') AS ys, coalesce((fc = 'CASH' AND regexp_matches(t, '受限')) OR (fc = 'INVENTORY' AND regexp_matches(t, '跌价|原材料')) OR (fc = 'AR' AND regexp_matches(t, '坏账|账龄')), false) AS veto FROM qs LEFT JOIN cd USING (question_id)))"""
_BARE = lambda c: f"regexp_replace(translate({c}, '{_WIDE}', '{_SLIM}'), '[\u00ad\u200b-\u200f\u2060\ufeff\\s]', '', 'g')"
_GRADED = """u AS (SELECT DISTINCT evidence_id, company_id, ['https://www.csrc.gov.cn:443/', 'http://user@static.cninfo.com.cn/', 'https://finance.sina.com.cn/', 'https://notgov.cn/', ''][page_number % 5 + 1] || coalesce(source_uri, '') AS url, ['A', 'B', 'C', 'D', 'D'][page_number % 5 + 1] AS grade FROM evidence_blocks)"""
_LAST_TWO = f"WITH {Q._LINES}, {Q._formula_sql()}, ye AS (SELECT company_id, list_sort(list(DISTINCT period_end)) AS e FROM res WHERE month(period_end) = 12 GROUP BY 1), w AS (SELECT company_id, formula, e[len(e) - 1] AS period_a, e[len(e)] AS period_b FROM ye, (SELECT DISTINCT formula FROM res)), u AS (SELECT * FROM res WHERE status IN ('CALCULATED_EXACT', 'CALCULATED_PROXY'))"

_ADMITTED = f"""{Q._INT}, {Q._STATE}, sev AS (SELECT company_id, period_end, scope, item_code, source FROM iv WHERE company_id IS NOT NULL AND period_end IS NOT NULL AND scope IS NOT NULL AND item_code IS NOT NULL AND source IS NOT NULL GROUP BY ALL HAVING count(DISTINCT value) > 1),
adm AS (SELECT DISTINCT company_id, id, value FROM iv WHERE scope = 'consolidated' AND company_id IS NOT NULL AND period_end IS NOT NULL AND item_code IS NOT NULL AND source IS NOT NULL AND (company_id, period_end, scope, item_code, source) NOT IN (SELECT (company_id, period_end, scope, item_code, source) FROM sev) AND (company_id, period_end, scope, item_code) NOT IN (SELECT (company_id, period_end, scope, item_code) FROM st WHERE state = 'CONFLICT'))"""

_LV = lambda n: f"max(CASE WHEN level = {n} THEN struct_pack(a := page_number, b := block_index, c := evidence_id) END) OVER w"
SQL = {
    "document_outline": f"WITH h AS (SELECT *, {evidence_queries._LEVEL('text')} AS level FROM (SELECT DISTINCT ON (evidence_id) * FROM evidence_blocks WHERE evidence_type = 'heading' AND document_id IS NOT NULL)), l AS (SELECT document_id, document_version, evidence_id, level, {_LV(1)} AS x1, {_LV(2)} AS x2, {_LV(3)} AS x3 FROM h WHERE level IS NOT NULL WINDOW w AS (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT document_id, document_version, evidence_id, level, list_max(list_filter([CASE WHEN level > 1 THEN x1 END, CASE WHEN level > 2 THEN x2 END, CASE WHEN level > 3 THEN x3 END], lambda x: x IS NOT NULL)).c AS parent FROM l",
    "contents_entries": "WITH p AS (SELECT document_id, text, min(page_number) AS page FROM evidence_blocks WHERE evidence_type = 'heading' AND document_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2), l AS (SELECT document_id, page, string_split(text, chr(10)) AS s FROM p) SELECT DISTINCT document_id, unnest([len(s), len(s) + len(s)])::INT AS line, trim(s[-1], chr(32) || chr(9) || chr(13)) AS title, page FROM l WHERE trim(s[-1]) <> '' AND page BETWEEN 0 AND 9999",
    "note_cells": "WITH r AS (SELECT DISTINCT evidence_id, text FROM evidence_blocks WHERE evidence_type = 'table_row'), c AS (SELECT evidence_id, regexp_extract(text, '^\\s*(\\S+)', 1) AS label, regexp_extract_all(' ' || regexp_replace(text, '([0-9]) ', '\\1  ', 'g') || ' ', '[^0-9.,](-?[0-9][0-9,]*\\.[0-9]+)[^0-9,]', 1) AS v FROM r) SELECT evidence_id, label, unnest(range(len(v)))::INT AS cell, replace(unnest(v), ',', '')::DECIMAL(24,4) AS value FROM c",
    "table_context": "WITH b AS (SELECT DISTINCT ON (evidence_id) * FROM evidence_blocks), t AS (SELECT *, last_value(CASE WHEN evidence_type = 'table' THEN struct_pack(i := evidence_id, t := text, p := page_number) END IGNORE NULLS) OVER (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM b WHERE evidence_type IN ('table', 'table_row')) SELECT evidence_id, CASE WHEN page_number - x.p <= 1 THEN x.i END AS table_id, CASE WHEN page_number - x.p <= 1 THEN x.t END AS table_title FROM t WHERE evidence_type = 'table_row'",
    "scope_drops": "SELECT reason, count(*) AS n FROM (SELECT DISTINCT evidence_id, CASE WHEN source_type IS NULL OR source_type NOT IN ('annual_report', 'debt_circular') THEN 'role_not_allowed' WHEN report_period IS NULL THEN 'period_unknown' WHEN report_period <> '2023-12-31' THEN 'period_mismatch' END AS reason FROM evidence_blocks) GROUP BY 1",
    "value_trace": f"WITH {Q._REC}, a AS (SELECT DISTINCT doc_id, value FROM (" + evidence_queries._amounts("split_part(text, chr(10) || chr(10), 1)", "company_id IS NOT NULL") + ") WHERE kind = 'money'), z AS (SELECT DISTINCT doc_id, value FROM (" + evidence_queries._amounts("array_to_string(string_split(text, chr(10) || chr(10))[2:], chr(10) || chr(10))", "company_id IS NOT NULL") + ") WHERE kind = 'money'), c AS (SELECT doc_id, company_id, value FROM a JOIN documents USING (doc_id)), f AS (SELECT DISTINCT company_id, value::DECIMAL(34,4) AS value FROM rec WHERE value IS NOT NULL AND company_id IS NOT NULL), m AS (SELECT c.*, (doc_id, value) IN (SELECT (doc_id, value) FROM z) AS in_rest, (company_id, value) IN (SELECT (company_id, value) FROM f) AS in_figures FROM c) SELECT *, CASE WHEN in_figures THEN 'in_figures' WHEN in_rest THEN 'in_rest' ELSE 'none' END AS last_seen FROM m",
    "item_labels": f"SELECT DISTINCT evidence_id, {_LABEL('text')} AS label, {evidence_queries._LEVEL('text')} AS level FROM evidence_blocks WHERE evidence_type = 'heading'",
    "mapping": f"WITH t AS (SELECT {_LABEL('title')} AS label, count(DISTINCT title_id) AS n FROM section_titles GROUP BY 1), h AS (SELECT evidence_id, {_LABEL('text')} AS label FROM (SELECT DISTINCT ON (evidence_id) * FROM evidence_blocks WHERE evidence_type = 'heading')) SELECT CASE WHEN t.n IS NULL THEN 'unmapped' WHEN t.n = 1 THEN 'mapped' ELSE 'ambiguous' END AS mapping_status, count(*) AS n FROM h LEFT JOIN t USING (label) GROUP BY 1",
    "equivalent_titles": f"SELECT DISTINCT evidence_id, title_id FROM evidence_blocks JOIN section_titles ON {_BARE('text')} = {_BARE('title')} WHERE evidence_type = 'heading'",
    "inner_headings": """WITH p AS (SELECT DISTINCT evidence_id, text FROM evidence_blocks WHERE evidence_type = 'paragraph' AND text IS NOT NULL), l AS (SELECT evidence_id, string_split(text, chr(10)) AS ls, unnest(range(len(string_split(text, chr(10))))) AS line FROM p), x AS (SELECT evidence_id, line, ls[line + 1] AS s, length(array_to_string(ls[1:line], chr(10))) + (line > 0)::INT AS start FROM l),
h AS (SELECT *, CASE WHEN length(trim(s)) > 60 OR trim(s) = '' OR regexp_matches(trim(s), '[。；;]$') THEN NULL WHEN regexp_matches(trim(s), '^第[一二三四五六七八九十百0-9]+[章节]') THEN 1 WHEN regexp_matches(trim(s), '^[一二三四五六七八九十]+、') THEN 2 WHEN regexp_matches(trim(s), '^[（(][一二三四五六七八九十]+[）)]') THEN 3 WHEN regexp_matches(trim(s), '^[0-9]+(\\.[0-9]+)*[.、 ]\\s*[^0-9]') THEN 4 END AS level FROM x) SELECT evidence_id, line, start, start + length(s) AS "end", level FROM h WHERE level IS NOT NULL""",
    "toc_reconciliation": f"WITH t AS (SELECT DISTINCT document_id, {_LABEL('p')} AS title FROM (SELECT document_id, unnest(section_path) AS p FROM evidence_blocks WHERE document_id IS NOT NULL)), b AS (SELECT DISTINCT document_id, {_LABEL('text')} AS title FROM evidence_blocks WHERE evidence_type = 'heading' AND document_id IS NOT NULL) SELECT document_id, title, CASE WHEN count(DISTINCT k) = 2 THEN 'matched' WHEN max(k) = 'b' THEN 'body_only' ELSE 'toc_only' END AS state FROM (SELECT *, 'a' AS k FROM t UNION ALL SELECT *, 'b' FROM b) WHERE title <> '' GROUP BY 1, 2",
    "span_conservation": f"WITH {evidence_queries._SPAN}, i AS (SELECT sp.g, greatest(lo, 0) AS lo, least(hi, size) AS hi, size FROM sp JOIN bd ON sp.g = bd.g WHERE greatest(lo, 0) < least(hi, size)), n AS (SELECT g, sum(hi - lo)::BIGINT AS total FROM i GROUP BY 1), c AS (SELECT g, count(*) AS covered FROM (SELECT DISTINCT g, unnest(range(lo, hi)) AS p FROM i) GROUP BY 1) SELECT bd.g, size, coalesce(total, 0) AS total, coalesce(covered, 0) AS covered, coalesce(total, 0) - coalesce(covered, 0) AS repeated, size - coalesce(covered, 0) AS uncovered, coalesce(covered, 0) = size AND coalesce(total, 0) = size AS conserved FROM bd LEFT JOIN n ON bd.g = n.g LEFT JOIN c ON bd.g = c.g",
    "rule_verdicts": "WITH o AS (SELECT * FROM report_meta QUALIFY row_number() OVER (PARTITION BY id ORDER BY imported_at) = 1), r AS (SELECT 'period_given' AS rule, CASE WHEN report_period IS NOT NULL THEN 'PASS' ELSE 'FAIL' END AS verdict FROM o UNION ALL SELECT 'annual_at_year_end', CASE WHEN report_type IS DISTINCT FROM 'annual' THEN 'NOT_APPLICABLE' WHEN report_period LIKE '%-12-31' THEN 'PASS' ELSE 'FAIL' END FROM o UNION ALL SELECT 'unit_in_one_place', CASE WHEN amount_unit IS NULL THEN 'NOT_APPLICABLE' WHEN unit_note IS NULL THEN 'PASS' ELSE 'FAIL' END FROM o UNION ALL SELECT 'amount_not_zero', CASE WHEN amount IS NULL THEN 'NOT_APPLICABLE' WHEN amount <> 0 THEN 'PASS' ELSE 'FAIL' END FROM o) SELECT rule, verdict, count(*) AS n FROM r GROUP BY 1, 2",
    "source_policy": f"WITH {_GRADED}, g AS (SELECT company_id, count(DISTINCT url) FILTER (grade = 'A') AS A, count(DISTINCT url) FILTER (grade = 'B') AS B, count(DISTINCT url) FILTER (grade = 'C') AS C, count(DISTINCT url) FILTER (grade = 'D') AS D FROM u WHERE company_id IS NOT NULL GROUP BY 1) SELECT *, CASE WHEN A >= 3 THEN 'A' WHEN A + B >= 5 THEN 'B' WHEN A + B + C >= 8 THEN 'C' WHEN A + B + C + D >= 20 THEN 'D' ELSE 'insufficient' END AS verdict FROM g",
    "snapshot_ids": f"WITH {_ADMITTED}, s AS (SELECT company_id, count(*) AS items, sum(('0x' || md5(id || ':' || value::VARCHAR)[1:15])::BIGINT::HUGEINT) AS d FROM adm GROUP BY 1) SELECT company_id, items, sha256('rules-1|' || company_id || '|' || items || '|' || d)[1:24] AS snapshot_id FROM s",
    "page_quality": "WITH p AS (SELECT document_id, document_version, page_number, sum(length(regexp_replace(coalesce(text, ''), '\\s', '', 'g'))) AS n FROM (SELECT DISTINCT document_id, document_version, page_number, block_index, text FROM evidence_blocks) GROUP BY ALL), c AS (SELECT document_id, document_version, count(*) AS pages, count(*) FILTER (n < 100) AS low_pages FROM p GROUP BY ALL) SELECT *, round(low_pages / pages, 6) AS low_share, CASE WHEN low_pages / pages > 0.3 THEN 'refuse' WHEN low_pages / pages >= 0.1 THEN 'warn' ELSE 'ok' END AS verdict FROM c",
    "source_grades": """WITH u AS (SELECT DISTINCT evidence_id, ['https://www.csrc.gov.cn:443/', 'http://user@static.cninfo.com.cn/', 'https://finance.sina.com.cn/', 'https://notgov.cn/', ''][page_number % 5 + 1] || coalesce(source_uri, '') AS url FROM evidence_blocks), h AS (SELECT *, lower(regexp_replace(regexp_replace(split_part(regexp_replace(url, '^[^/?#]*://', ''), '/', 1), '^.*@', ''), ':[^:]*$', '')) AS host FROM u)
SELECT *, CASE WHEN regexp_matches(host, '(^|\\.)(gov\\.cn|sse\\.com\\.cn|szse\\.cn|bse\\.cn)$') THEN 'A' WHEN regexp_matches(host, '(^|\\.)cninfo\\.com\\.cn$') THEN 'B' WHEN regexp_matches(host, '(^|\\.)sina\\.com\\.cn$') THEN 'C' ELSE 'D' END AS grade FROM h""",
    "source_types": "SELECT DISTINCT source_name, CASE WHEN regexp_matches(lower(coalesce(source_name, '')), 'kcz|债|募集|发行公告|bond|offering') THEN 'debt_circular' WHEN regexp_matches(lower(coalesce(source_name, '')), 'year|年报|年度报告|annual|20|19') THEN 'annual_report' ELSE 'other' END AS inferred_type FROM document_versions",
    "registered_sources": f"""WITH s AS (SELECT *, CASE WHEN declared_company_name IS NULL OR trim(declared_company_name) = '' OR detected_company_names IS NULL OR len(detected_company_names) = 0 THEN 'unverified' WHEN len(list_filter(detected_company_names, lambda d: {_NORM('d')} = {_NORM('declared_company_name')})) > 0 THEN 'matched' ELSE 'mismatch' END AS st FROM document_versions WHERE company_id IS NOT NULL AND file_sha256 IS NOT NULL),
o AS (SELECT company_id, source_name, file_sha256, min(created_at) AS seen, min_by(st, (created_at, st)) AS subject_status FROM s GROUP BY 1, 2, 3) SELECT sha256(company_id || chr(31) || file_sha256)[1:24] AS source_id, company_id, source_name, file_sha256, row_number() OVER (PARTITION BY company_id, source_name ORDER BY seen NULLS LAST, file_sha256) AS content_version, subject_status FROM o""",
    "quarantined_versions": f"WITH {_BAD} SELECT * FROM q",
    "released_blocks": f"WITH {_BAD} SELECT b.company_id, b.document_id, b.document_version, count(*) AS blocks FROM evidence_blocks b WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.company_id = b.company_id AND q.document_id = b.document_id AND q.document_version = b.document_version) GROUP BY 1, 2, 3",
    "inventory_difference": f"WITH a AS (SELECT {_V}, count(*) AS expected FROM document_versions GROUP BY ALL), b AS (SELECT {_V}, count(*) AS actual FROM evidence_blocks GROUP BY ALL), k AS (SELECT {_V} FROM a UNION SELECT {_V} FROM b) SELECT k.*, coalesce(expected, 0) AS expected, coalesce(actual, 0) AS actual, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'matched' END AS status FROM k LEFT JOIN a ON k.company_id IS NOT DISTINCT FROM a.company_id AND k.document_id IS NOT DISTINCT FROM a.document_id AND k.document_version IS NOT DISTINCT FROM a.document_version LEFT JOIN b ON k.company_id IS NOT DISTINCT FROM b.company_id AND k.document_id IS NOT DISTINCT FROM b.document_id AND k.document_version IS NOT DISTINCT FROM b.document_version",
    "version_union": f"SELECT {_V} FROM document_versions UNION SELECT {_V} FROM evidence_blocks",
    "version_rollup": f"SELECT {_V}, count(*) AS blocks, count(DISTINCT page_number) AS pages, string_agg(DISTINCT evidence_type, ',' ORDER BY evidence_type) AS kinds FROM (SELECT DISTINCT {_V}, evidence_id, page_number, evidence_type FROM evidence_blocks) GROUP BY ALL",
    "resume_outcomes": f"WITH {_MAN} SELECT run_id, CASE WHEN row_number() OVER w = 1 THEN 'NO_CHECKPOINT' WHEN d IS DISTINCT FROM lag(d) OVER w THEN 'INPUT_CHANGED' WHEN c IS DISTINCT FROM lag(c) OVER w OR r IS DISTINCT FROM lag(r) OVER w THEN 'DEPENDENCY_CHANGED' ELSE 'RESUMABLE' END AS outcome FROM man WINDOW w AS (PARTITION BY company_id ORDER BY created_at, run_id)",
    "as_of_selection": f"WITH {_MAN}, {Q._REC}, {Q._FACTS}, n AS (SELECT company_id, period_end::VARCHAR AS report_as_of, count(*) AS figures FROM facts GROUP BY 1, 2) SELECT run_id, m.report_as_of, coalesce(figures, 0) AS figures, CASE WHEN m.report_as_of IS NULL THEN 'NO_AS_OF' WHEN figures IS NULL THEN 'NO_SNAPSHOT' ELSE 'OK' END AS outcome FROM man m LEFT JOIN n ON m.company_id = n.company_id AND m.report_as_of = n.report_as_of",
    "question_targets": f"WITH {_TARGETS} SELECT question_id, company_id, target_type, code, reason, period FROM tg",
    "structured_lookup": f"""{Q._RES}, {_TARGETS}, ix AS (SELECT company_id, period_end, item_code, count(DISTINCT value) AS n, max(value) AS v FROM rec WHERE scope = 'consolidated' AND period_end IS NOT NULL AND company_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT t.question_id AS request_id, t.target_type, t.code, CASE WHEN t.target_type = 'field' AND i.n = 1 THEN i.v::DOUBLE WHEN t.target_type = 'metric' AND r.value IS NOT NULL THEN round(r.value, 6) END AS value,
 CASE WHEN t.code IS NULL THEN 'NO_TARGET' WHEN t.company_id IS NULL OR t.company_id NOT IN (SELECT company_id FROM ix) THEN 'NO_SNAPSHOT' WHEN t.period IS NULL OR (t.company_id, t.period) NOT IN (SELECT (company_id, period_end::VARCHAR) FROM ix) THEN 'PERIOD_NOT_AVAILABLE' WHEN t.target_type = 'field' AND i.n > 1 THEN 'AMBIGUOUS_VALUE' WHEN t.target_type = 'field' AND coalesce(i.n, 0) = 0 THEN 'FIELD_NOT_FOUND' WHEN t.target_type = 'metric' AND r.status IS NULL THEN 'METRIC_NOT_FOUND' WHEN t.target_type = 'metric' AND r.value IS NULL THEN 'METRIC_' || r.status ELSE 'OK' END AS outcome
FROM tg t LEFT JOIN ix i ON t.target_type = 'field' AND i.company_id = t.company_id AND i.period_end::VARCHAR = t.period AND i.item_code = t.code LEFT JOIN res r ON t.target_type = 'metric' AND r.company_id = t.company_id AND r.period_end::VARCHAR = t.period AND r.formula = t.code""",
    "period_comparison": f"{_LAST_TWO} SELECT w.company_id, w.formula, period_a, period_b, round(b.value - a.value, 5) AS change, CASE WHEN a.value IS NULL AND b.value IS NULL THEN 'unavailable' WHEN a.value IS NULL OR b.value IS NULL THEN 'missing_period' WHEN b.value > a.value THEN 'increased' WHEN b.value < a.value THEN 'decreased' ELSE 'unchanged' END AS relation FROM w LEFT JOIN u a ON a.company_id = w.company_id AND a.formula = w.formula AND a.period_end = period_a LEFT JOIN u b ON b.company_id = w.company_id AND b.formula = w.formula AND b.period_end = period_b",
    "anchor_dates": f"WITH t AS (SELECT document_id, document_version, page_number, unnest(regexp_extract_all(text, '[0-9]{{4}}[年./\\-][0-9]{{1,2}}[月./\\-][0-9]{{1,2}}[日号]?|[0-9]{{4}}年?(?:年度|年报|中报|半年报|半年度|季报)')) AS h FROM evidence_blocks), p AS (SELECT *, {_header_sql('h')} AS p FROM t) SELECT document_id, document_version, page_number, max(p) AS anchor FROM p GROUP BY 1, 2, 3 HAVING max(p) IS NOT NULL",
    "header_periods": f"WITH h AS (SELECT DISTINCT header FROM (SELECT unnest([published_at, report_period, document_version]) AS header FROM evidence_blocks) WHERE header IS NOT NULL), p AS (SELECT header, {_header_sql('header')} AS period FROM h) SELECT header, period, {_KIND('header', 'period')} AS period_type FROM p",
    "relative_headers": "WITH a AS (SELECT DISTINCT report_period, report_type FROM report_meta), w(header) AS (VALUES ('期末余额'), ('年初余额'), ('2021年中报'), ('项目')) SELECT report_period, report_type, header, CASE header WHEN '2021年中报' THEN '2021-06-30' WHEN '期末余额' THEN report_period WHEN '年初余额' THEN (report_period[1:4]::INT - 1)::VARCHAR || '-12-31' END AS period, CASE WHEN header = '2021年中报' THEN 'interim' WHEN header = '期末余额' THEN report_type WHEN header = '年初余额' AND report_period IS NOT NULL THEN 'annual' END AS period_type FROM a, w",
    "period_words": f"WITH p AS (SELECT DISTINCT report_period AS p FROM report_meta WHERE report_period IS NOT NULL) SELECT p AS report_period, {_WORDS('p', '''WHEN '12' THEN '年末' WHEN '06' THEN '年半年末' WHEN '03' THEN '年一季度末' WHEN '09' THEN '年三季度末' ELSE '年' || p[6:7]::INT || '月末' ''')} AS at_end, {_WORDS('p', '''WHEN '12' THEN '年度' WHEN '06' THEN '年半年度' WHEN '03' THEN '年一季度' WHEN '09' THEN '年前三季度' ELSE '年1-' || p[6:7]::INT || '月' ''')} AS over FROM p",
    "compared_periods": f"WITH {Q._REC}, {Q._FACTS}, c AS (SELECT company_id, list_sort(list(DISTINCT period_end::VARCHAR) FILTER (month(period_end) = 12)) AS e FROM facts GROUP BY 1) SELECT company_id, question_id, CASE question_id WHEN 'a' THEN CASE WHEN len(e) >= 3 THEN array_to_string(e[len(e) - 2:], ',') ELSE '' END WHEN 'b' THEN CASE WHEN list_contains(e, '2022-12-31') AND list_contains(e, '2024-12-31') THEN '2022-12-31,2024-12-31' ELSE '' END WHEN 'c' THEN CASE WHEN list_contains(e, '2023-12-31') AND e[1] < '2023-12-31' THEN list_max(list_filter(e, lambda x: x < '2023-12-31')) || ',2023-12-31' ELSE '' END ELSE '' END AS periods FROM c, (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) q(question_id)",
    "late_scopes": "SELECT DISTINCT id, coalesce(try_cast(CASE WHEN regexp_full_match(trim(report_period), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN report_period END AS DATE) > DATE '2023-09-30', false) AS late FROM report_meta",
    "blocking": "SELECT DISTINCT run_id, question_id, status, success, CASE WHEN status = 'COMPLETED' THEN '' WHEN status IN ('BLOCKED', 'WAITING_HUMAN') THEN CASE WHEN success = 1 THEN '' ELSE 'JOB_BLOCKED,REPORT_BLOCKED' END ELSE 'REPORT_BLOCKED' END AS levels FROM question_outcome",
    "revenue_cost": "SELECT item_code, title, CASE WHEN item_code IN ('TOTAL_REVENUE', 'OPER_REVENUE') THEN 'revenue' WHEN item_code IN ('OPER_COST', 'TOTAL_COST') THEN 'cost' WHEN item_code <> '' THEN 'other' WHEN regexp_matches(title, '收入|营收') AND NOT regexp_matches(title, '成本|费用') THEN 'revenue' WHEN regexp_matches(title, '成本|费用') AND NOT regexp_matches(title, '收入|营收') THEN 'cost' END AS category FROM (SELECT item_code, NULL::VARCHAR AS title FROM report_meta UNION SELECT NULL, title FROM section_titles UNION SELECT NULL, text FROM evidence_blocks WHERE evidence_type = 'table_row')",
    "locators": """SELECT DISTINCT evidence_id, '{"kind":"page"' || CASE WHEN page_number IS NULL THEN '' ELSE ',"page":' || page_number END || CASE WHEN block_index IS NULL THEN '' ELSE ',"block":' || block_index END || '}' AS locator, page_number AS page, block_index AS block FROM evidence_blocks""",
    "pending_mappings": f"WITH t AS (SELECT {_LABEL('title')} AS label, level FROM section_titles), n AS (SELECT label, count(DISTINCT level) AS n FROM t GROUP BY 1), h AS (SELECT DISTINCT evidence_id, text, {_LABEL('text')} AS label FROM evidence_blocks WHERE evidence_type = 'heading' AND text IS NOT NULL) SELECT evidence_id, h.label, CASE WHEN n.n IS NULL THEN 'unmapped' ELSE 'ambiguous' END AS mapping_status FROM h LEFT JOIN n USING (label) WHERE coalesce(n.n, 0) <> 1 AND h.label NOT IN (SELECT label FROM t WHERE level = 1)",
    "context_expansion": """WITH b AS (SELECT * FROM evidence_blocks QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY created_at) = 1), o AS (SELECT *, row_number() OVER (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id) AS place, length(coalesce(text, '')) AS n FROM b),
x AS (SELECT a.evidence_id AS anchor_id, a.page_number AS ap, g.k AS "offset", c.* FROM o a CROSS JOIN range(1, 7) g(k) LEFT JOIN o c ON c.document_id = a.document_id AND c.document_version = a.document_version AND c.place = a.place + g.k WHERE a.evidence_type = 'table'), y AS (SELECT *, sum(n) OVER (PARTITION BY anchor_id ORDER BY "offset") AS t FROM x),
z AS (SELECT *, CASE WHEN evidence_id IS NULL THEN 'document' WHEN evidence_type = 'heading' THEN 'heading' WHEN page_number > ap + 2 THEN 'pages' WHEN t > 2000 THEN 'chars' WHEN "offset" > 5 THEN 'blocks' END AS stop FROM y), s AS (SELECT anchor_id, min("offset") AS until FROM z WHERE stop IS NOT NULL GROUP BY 1)
SELECT anchor_id, evidence_id, "offset", t::BIGINT AS chars_so_far, CASE WHEN "offset" = until - 1 THEN (SELECT stop FROM z q WHERE q.anchor_id = z.anchor_id AND q."offset" = until) END AS end_reason FROM z JOIN s USING (anchor_id) WHERE "offset" < until""",
    "dense_filtered": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(q.e, d.e), 10) AS c FROM v q JOIN v d ON d.label = 3 WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(c, 6) AS score, rank FROM r WHERE rank <= 10""",
}
