"""Sources on their way in: registration, grading, integrity, inventories, checkpoints and targets of questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataquill.functions.columns import fold_width, name_match, stable_id

# Domains of authorities and exchanges (A), of the statutory disclosure platform (B) and of business media (C).
DOMAINS = {
    "A": ("gov.cn", "sse.com.cn", "szse.cn", "bse.cn"),
    "B": ("cninfo.com.cn",),
    "C": ("eastmoney.com", "10jqka.com.cn", "sina.com.cn", "163.com", "thepaper.cn", "yicai.com", "cls.cn", "stcn.com", "caixin.com", "hexun.com", "xueqiu.com", "cnstock.com"),
}
# Words in file names; the year prefixes stand for annual reports.
NAME_WORDS = {"debt_circular": ("kcz", "债", "募集", "发行公告", "bond", "offering"), "annual_report": ("year", "年报", "年度报告", "annual", "20", "19")}


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port, path; the empty text for null."""
    bare = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "^[^/?#]*://", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^([^/?#]*)", 1), "^.*@", "")
    return F.lower(F.when(host.startswith("["), F.regexp_replace(host, "^\\[|\\].*$", "")).otherwise(F.regexp_replace(host, ":[^:]*$", "")))


def source_grade(url: Column) -> Column:
    """A, B or C where the host is one of the grade's domains or below one, else D."""
    host, chain = host_of(url), None
    for grade, domains in DOMAINS.items():
        hit = host.rlike("(^|\\.)(" + "|".join(d.replace(".", "\\.") for d in domains) + ")$")
        chain = F.when(hit, grade) if chain is None else chain.when(hit, grade)
    return chain.otherwise("D")


def source_type(name: Column) -> Column:
    """Kind of document by the words of its file name, debt before annual; other where none occurs."""
    lower, chain = F.lower(F.coalesce(name, F.lit(""))), None
    for kind, words in NAME_WORDS.items():
        hit = lower.rlike("|".join(words))
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return chain.otherwise("other")


def register_sources(files: DataFrame) -> DataFrame:
    """(source_id, company_id, source_name, file_sha256, content_version, subject_status) of every delivered content.

    The id belongs to company and content; versions count the contents of one company and name in order of first
    delivery. Needs company_id, source_name, file_sha256, created_at, declared_company_name, detected_company_names. Rows
    without company or hash are left out; repeated deliveries of a content are one source.
    """
    rows = files.where("company_id is not null and file_sha256 is not null").withColumn("__status", name_match(F.col("declared_company_name"), F.col("detected_company_names")))
    once = rows.groupBy("company_id", "source_name", "file_sha256").agg(F.min("created_at").alias("first_seen"), F.min_by("__status", F.struct("created_at", "__status")).alias("subject_status"))
    version = F.row_number().over(W.partitionBy("company_id", "source_name").orderBy(F.col("first_seen").asc_nulls_last(), "file_sha256"))
    return once.select(stable_id(F.col("company_id"), F.col("file_sha256"), length=24).alias("source_id"), "company_id", "source_name", "file_sha256", version.alias("content_version"), "subject_status")


def integrity_failures(blocks: DataFrame, versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, reasons) of document versions whose stored blocks contradict one another or their version's record.

    HASH_CONFLICT: a block id with several contents; PAGE_OUT_OF_RANGE: a page beyond the page count or below one;
    NO_VERSION: blocks of a version that is not recorded. Everything is combined before the shuffle.
    """
    ids = blocks.groupBy(*keys, "evidence_id").agg(F.count_distinct("content_hash").alias("h"))
    clash = ids.where("h > 1").select(*keys, F.lit("HASH_CONFLICT").alias("reason"))
    pages = versions.groupBy(*keys).agg(F.max("page_count").alias("page_count"))
    extent = blocks.groupBy(*keys).agg(F.max("page_number").alias("hi"), F.min("page_number").alias("lo")).join(pages.withColumn("__v", F.lit(True)), list(keys), "left")
    wrong = extent.select(*keys, F.explode(F.array_compact(F.array(F.when((F.col("hi") > F.col("page_count")) | (F.col("lo") < 1), "PAGE_OUT_OF_RANGE"), F.when(F.col("__v").isNull(), "NO_VERSION")))).alias("reason"))
    return clash.unionByName(wrong).groupBy(*keys).agg(F.concat_ws(",", F.array_sort(F.collect_set("reason"))).alias("reasons"))


def without_quarantined(rows: DataFrame, failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of sets that are not in quarantine; the others are kept where they are, for diagnosis."""
    return rows.join(failures.select(*keys).distinct(), list(keys), "left_anti")


def inventory_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, expected, actual, status) of two inventories: matched, missing, or extra; null keys are told apart by null-safe equality."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    a, b = count(expected, "expected").alias("a"), count(actual, "actual").alias("b")
    on = None
    for k in keys:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    both = a.join(b, on, "full")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("matched")
    return both.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys), F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"), status.alias("status"))


def resume_check(runs: DataFrame, key: str, order: str, inputs: Sequence[str], dependencies: Sequence[str]) -> DataFrame:
    """Every run with ``outcome``: whether it may resume from the run of the same key before it.

    NO_CHECKPOINT for the first, INPUT_CHANGED or DEPENDENCY_CHANGED where a column differs (null equals null), else
    RESUMABLE.
    """
    by = W.partitionBy(key).orderBy(order, "run_id")
    differs = lambda columns: ~F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(by))
    first = F.row_number().over(by) == 1
    return runs.withColumn("outcome", F.when(first, "NO_CHECKPOINT").when(differs(inputs), "INPUT_CHANGED").when(differs(dependencies), "DEPENDENCY_CHANGED").otherwise("RESUMABLE"))


def alias_spans(text: Column, aliases: Mapping[str, str]) -> Column:
    """array<struct(start, end, code)> of all places where an alias stands and no longer alias encloses it; empty for null."""

    def places(alias: str, code: str) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.lit(len(alias))) == alias)
        return F.transform(at, lambda i: F.struct(i.alias("start"), (i + len(alias)).alias("end"), F.lit(code).alias("code")))

    spans = F.flatten(F.array(*(places(a, c) for a, c in aliases.items())))
    inside = lambda s, o: (o != s) & (o["start"] <= s["start"]) & (s["end"] <= o["end"])
    return F.filter(spans, lambda s: ~F.exists(spans, lambda o: inside(s, o)))


def question_target(question: Column, metrics: Mapping[str, str], fields: Mapping[str, str], blockers: Mapping[str, Sequence[str]]) -> Column:
    """struct(target_type, code, reason): the metric or field a question asks for.

    Metrics go first, and a question that names several never falls back to a field. A detail word vetoes the total it
    belongs to. ``reason`` is ambiguous_metric, ambiguous_field, sub_item or no_target where there is none.
    """
    text = F.lower(F.regexp_replace(fold_width(F.coalesce(question, F.lit(""))), "\\s+", ""))
    codes = lambda aliases: F.array_distinct(F.transform(alias_spans(text, aliases), lambda s: s["code"]))
    m, f = codes(metrics), codes(fields)
    veto = F.lit(False)
    for code, words in blockers.items():
        veto = veto | ((F.get(f, F.lit(0)) == code) & text.rlike("|".join(words)))
    none = F.lit(None).cast("string")
    out = lambda kind, code, reason: F.struct((F.lit(kind) if kind else none).alias("target_type"), code.alias("code"), (F.lit(reason) if reason else none).alias("reason"))
    chain = F.when(F.size(m) == 1, out("metric", F.get(m, F.lit(0)), None)).when(F.size(m) > 1, out(None, none, "ambiguous_metric"))
    chain = chain.when(F.size(f) == 0, out(None, none, "no_target")).when(F.size(f) > 1, out(None, none, "ambiguous_field"))
    return chain.when(veto, out(None, none, "sub_item")).otherwise(out("field", F.get(f, F.lit(0)), None))


def question_period(question: Column) -> Column:
    """The year end a question names if it names exactly one year, else null."""
    years = F.array_distinct(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit("((?:19|20)[0-9]{2})"), F.lit(1)))
    return F.when(F.size(years) == 1, F.concat(F.get(years, F.lit(0)), F.lit("-12-31")))


def blocking_levels(state: Column, policy: Column) -> Column:
    """What an answer's state blocks: nothing once it is settled, the question's own policy while open, the report if the state is unknown."""
    none = F.array().cast("array<string>")
    return F.when(state.isin("SATISFIED", "NOT_APPLICABLE"), none).when(state.isin("CONFLICT", "NOT_PROVIDED", "NOT_FOUND_AFTER_SEARCH", "WAITING_HUMAN"), F.coalesce(policy, none)).otherwise(F.array(F.lit("REPORT_BLOCKED")))


def revenue_cost_class(item_code: Column, title: Column) -> Column:
    """revenue, cost or other by the code; without one by the title; null where that names both or neither."""
    code = F.nullif(item_code, F.lit(""))
    by_code = F.when(code.isin("TOTAL_REVENUE", "OPER_REVENUE"), "revenue").when(code.isin("OPER_COST", "TOTAL_COST"), "cost").otherwise("other")
    revenue, cost = title.rlike("收入|营收"), title.rlike("成本|费用")
    return F.when(code.isNotNull(), by_code).when(revenue & ~cost, "revenue").when(cost & ~revenue, "cost")


def encode_locator(kind: Column, **fields: Column) -> Column:
    """A place in a source as compact JSON: its kind and the fields that are set."""
    return F.to_json(F.struct(kind.alias("kind"), *(c.alias(n) for n, c in fields.items())))


def decode_locator(text: Column) -> Column:
    """The place written by ``encode_locator``; null for text that is none or has no kind."""
    place = F.from_json(text, "kind string, page int, block int, sheet string, cell string, url string")
    return F.when(place["kind"].isNotNull(), place)
