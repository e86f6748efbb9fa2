"""Core operators on small hand-computed tables."""

import datetime as dt
import itertools
import sqlite3
import zipfile
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquill.functions import columns as C
from strataquill.functions import periods as P
from strataquill.operators import evaluation as E
from strataquill.operators import facts as A
from strataquill.operators import governance as G
from strataquill.operators import intake as K
from strataquill.operators import intervals as I
from strataquill.operators import metrics as M
from strataquill.operators import retrieval as R
from strataquill.operators import structure as S
from strataquill.operators import verify as V
from strataquill.operators import versions as X
from strataquill.sources import readers, sinks
from strataquill.streaming import validity


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_periods(spark):
    got = values(spark, C.parse_period, ["2023", "2023Q1", "2023-H1", "2024-02", "2023-02-30", "2023-13", "x", None, " 2023-12-31 "])
    d = dt.date
    assert got == [d(2023, 12, 31), d(2023, 3, 31), d(2023, 6, 30), d(2024, 2, 29), None, None, None, None, d(2023, 12, 31)]


def test_decimals(spark):
    got = values(spark, C.parse_decimal, ["1,234.5", "(7)", "１２", "5%", "", None, "-3.25", "abc"])
    assert got == [Decimal("1234.5"), Decimal(-7), Decimal(12), None, None, None, Decimal("-3.25"), None]
    assert values(spark, lambda x: C.round_display(x.cast("decimal(20,6)")), ["2.345", "-2.345", "0.005"]) == [Decimal("2.35"), Decimal("-2.35"), Decimal("0.01")]
    assert [float(x) for x in values(spark, C.display_increment, ["12", "1.25"])] == [1.0, 0.01]


def test_tokens_and_labels(spark):
    assert values(spark, C.tokens, ["净利润 ABC12 3.5%", "元", None, ""]) == [["净利", "利润", "abc12", "3.5%"], ["元"], [], []]
    assert values(spark, C.item_text, ["（一）营业收入：", "1、 Net Profit"]) == ["营业收入", "netprofit"]
    assert values(spark, C.heading_level, ["第一节 释义", "一、概况", "（二）产能", "2.1 行业", "正文。", None]) == [1, 2, 3, 4, None, None]


def test_rrf(spark):
    rows = [("q", "a", "d1", 1), ("q", "a", "d2", 2), ("q", "b", "d1", 2), ("q", "b", "d1", 5), ("q", "b", "d3", 1)]
    out = R.fuse(spark.createDataFrame(rows, "q string, channel string, d string, rank int"), "q", "d").orderBy("rank").collect()
    assert [(r.d, r.score) for r in out] == [("d1", round(1 / 61 + 1 / 62, 8)), ("d3", round(1 / 61, 8)), ("d2", round(1 / 62, 8))]


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None), (98, [1.0])], "k long, v array<double>")
    q = df.where("k % 20 = 0").select(F.col("k").alias("q"), F.col("v").alias("qv"))
    got = {(r.q, r.k): r.rank for r in R.nearest(df, "k", "v", q, "q", "qv", 5, block=2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in (0, 20, 40):
        order = sorted(range(60), key=lambda j: (-round(float(u[i] @ u[j]), 10), j))[:5]
        assert [k for (qq, k), _ in sorted(((x, r) for x, r in got.items() if x[0] == i), key=lambda z: z[1])] == order


def test_reconcile(spark):
    rows = [("k", "s1", 1000, 995, 1005), ("k", "s2", 1003, 1002, 1004), ("m", "s1", 1, 0, 2), ("m", "s2", 9, 8, 10), ("n", "s1", 1, 0, 2), (None, "s1", 1, 0, 2), ("p", "s1", 1, 0, 2), ("p", "s1", 2, 1, 3)]
    df = spark.createDataFrame(rows, "key string, source string, value int, low int, high int")
    got = {r.key: (r.state, r.common_low, r.common_high) for r in A.reconcile(df, ["key"]).collect()}
    assert got == {"k": ("MATCHED", 1002, 1004), "m": ("CONFLICT", None, None), "n": ("SINGLE_SOURCE", 0, 2), None: ("INSUFFICIENT_SCOPE", None, None), "p": ("CONFLICT", 1, 2)}


def test_formulas(spark):
    d = dt.date
    rows = [("c", d(2023, 12, 31), "TOTAL_ASSETS", 200.0), ("c", d(2022, 12, 31), "TOTAL_ASSETS", 100.0), ("c", d(2023, 12, 31), "TOTAL_LIAB", 50.0), ("c", d(2023, 12, 31), "TOTAL_REVENUE", 0.0), ("c", d(2023, 12, 31), "NET_PROFIT", 5.0), ("c", d(2023, 12, 31), "TOTAL_PROFIT", 6.0), ("c", d(2023, 12, 31), "FIN_EXP", 2.0), ("c", d(2023, 12, 31), "BONDS", 1.0), ("c", d(2023, 6, 30), "TOTAL_ASSETS", 1.0)]
    facts = spark.createDataFrame(rows, "company_id string, period_end date, item_code string, value double")
    got = {(r.period_end.month, r.period_end.year, r.formula): (r.value, r.status, r.reason) for r in M.compute(facts).collect()}
    assert len(M.FORMULAS) == 28
    year = lambda f: got[12, 2023, f]
    assert year("SOLV_DEBT_RATIO") == (0.25, "CALCULATED_EXACT", None)
    assert year("PROF_NET_MARGIN")[1] == "ZERO_DENOMINATOR"
    assert year("OPER_ASSET_TURNOVER") == (0.0, "CALCULATED_EXACT", None)
    assert year("SOLV_INTEREST_COVER") == (4.0, "CALCULATED_PROXY", "PROXY_FIN_EXP")
    assert year("GROWTH_ASSET") == (1.0, "CALCULATED_EXACT", None)
    assert year("GROWTH_LIABILITY")[1] == "MISSING_PRIOR_PERIOD"
    assert year("INTEREST_BEARING_DEBT")[1] == "PARTIAL_INPUT"
    assert year("SOLV_CURRENT_RATIO")[1] == "MISSING_INPUT"
    assert got[6, 2023, "GROWTH_ASSET"][1] == "NOT_APPLICABLE"
    blocked = spark.createDataFrame([("c", "TOTAL_LIAB", "UNRESOLVED_CONFLICT")], "company_id string, item_code string, reason string")
    out = {r.formula: r.status for r in M.compute(facts, names=["SOLV_DEBT_RATIO", "PROF_ROA"], blocked=blocked).where("year(period_end) = 2023 and month(period_end) = 12").collect()}
    assert out == {"SOLV_DEBT_RATIO": "BLOCKED", "PROF_ROA": "CALCULATED_EXACT"}
    with pytest.raises(KeyError):
        M.compute(facts, names=["__import__"])


def test_receivable_basis_and_exclusions(spark):
    d = dt.date
    now, ago = d(2023, 12, 31), d(2022, 12, 31)
    rows = [(c, now, "TOTAL_REVENUE", 100) for c in "abcdef"] + [("a", now, "AR", 10), ("a", ago, "AR", 30), ("b", now, "AR", 10), ("b", ago, "AR_COMBINED", 30), ("c", now, "AR_COMBINED", 10), ("c", ago, "AR_COMBINED", 30), ("c", now, "AR", 1), ("d", now, "AR", 10), ("e", ago, "AR", 10), ("f", now, "AR", 5), ("f", ago, "AR", -5)]
    facts = spark.createDataFrame(rows, "company_id string, period_end date, item_code string, value int")
    got = {r.company_id: (r.value and float(r.value), r.status, r.reason) for r in M.compute(facts, names=["OPER_AR_TURNOVER"]).where("year(period_end) = 2023").collect()}
    assert got == {"a": (5.0, "CALCULATED_EXACT", None), "b": (None, "MISSING_INPUT", "MIXED_RECEIVABLE_BASIS_FORBIDDEN"), "c": (5.0, "CALCULATED_EXACT", None), "d": (None, "MISSING_PRIOR_PERIOD", None), "e": (None, "MISSING_INPUT", None), "f": (None, "ZERO_DENOMINATOR", None)}
    rows = [("a", now, "CUR_ASSETS", 100, "r1"), ("a", now, "INVENTORY", 10, "r2"), ("a", now, "PREPAID", 10, "r3"), ("a", now, "CUR_LIAB", 10, "r4"), ("a", now, "OTHER", 30, "r5"), ("b", now, "OTHER", 30, "r6")]
    facts = spark.createDataFrame(rows, "company_id string, period_end date, item_code string, value int, record string")
    references = spark.createDataFrame([("a", "r5"), ("a", "r5"), ("a", "r6"), ("a", None)], "company_id string, record string")
    out = M.compute(facts, names=["SOLV_QUICK_RATIO"], exclusions=M.policy_exclusions(facts, references, "record")).collect()
    assert [(r.company_id, float(r.value)) for r in out] == [("a", 5.0)]


def test_source_checks(spark):
    items = {"BALANCE": {"TOTAL_ASSETS": 100, "TOTAL_LIAB": 60, "TOTAL_EQUITY": 41}, "CASH": {"CASH_END": 10, "CASH_BEGIN": 4, "NET_CASH_INCREASE": 3}}
    rows = [(c, i, v, u) for c, u in (("fine", 10), ("tight", 1)) for part in items.values() for i, v in part.items()] + [("fine", "NET_PROFIT", 5, 10), ("twice", "NET_PROFIT", 5, 1), ("twice", "NET_PROFIT", 6, 1), ("twice", "CF_NET_PROFIT", 6, 1)]
    rows += [("notes", i, v, 2) for i, v in (("OPER_REVENUE", 10), ("OPER_REVENUE_NOTES", 9), ("OPER_COST", 5), ("OPER_COST_NOTES", 9))] + [("mixed", "TOTAL_ASSETS", 2, 1), ("mixed", "TOTAL_LIAB", 1, 10), ("mixed", "TOTAL_EQUITY", 1, 10)]
    facts = spark.createDataFrame([(*r, f"{i}") for i, r in enumerate(rows)], "c string, item_code string, value int, unit_size int, record string")
    out = A.source_checks(facts, ["c"])
    got = {(r.c, r.check): (r.result, r.missing, r.ambiguous) for r in out.collect()}
    assert got["fine", "BALANCE_SHEET_IDENTITY"][0] == got["fine", "CASH_BALANCE_RECONCILIATION"][0] == "PASS"
    assert got["tight", "BALANCE_SHEET_IDENTITY"][0] == "PASS" and got["tight", "CASH_BALANCE_RECONCILIATION"][0] == "FAIL"
    assert got["fine", "NET_INCOME_CASH_START"] == ("NOT_RUN_MISSING_INPUT", "CF_NET_PROFIT", "") and got["twice", "NET_INCOME_CASH_START"] == ("NOT_RUN_MISSING_INPUT", "", "NET_PROFIT")
    assert got["notes", "REVENUE_COST_BREAKDOWN"][0] == "FAIL" and got["mixed", "BALANCE_SHEET_IDENTITY"][0] == "PASS"
    names = {r.record: (r.c, r.item_code) for r in facts.collect()}
    failed = {names[r.record] for r in A.failed_inputs(facts, out, ["c"], "record").collect()}
    assert failed == {("tight", i) for i in items["CASH"]} | {("notes", i) for i in ("OPER_REVENUE", "OPER_REVENUE_NOTES", "OPER_COST", "OPER_COST_NOTES")}
    exceptions = spark.createDataFrame([("a", "UNRESOLVED_CONFLICT", "X"), ("b", "NULL_VALUE", "X"), ("b", "NULL_VALUE", "T"), ("c", "NULL_VALUE", "X"), ("c", "OTHER", None)], "c string, kind string, item_code string")
    assert {r.c: (r.exceptions, r.blocking, r.blocked) for r in A.report_blocked(exceptions, "c", ["T"]).collect()} == {"a": (1, 1, True), "b": (2, 1, True), "c": (2, 0, False)}
    assert A.unique_value(spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "k string, value int"), ["k"]).count() == 2
    with pytest.raises(Exception, match="several values for a"):
        A.unique_value(spark.createDataFrame([("a", 1), ("a", 2)], "k string, value int"), ["k"]).collect()


def test_transitions_and_pointers(spark):
    rows = [("a", 1, "draft"), ("a", 2, "final"), ("a", 3, "draft"), ("a", 4, "final"), ("b", 1, "final"), ("b", 2, "odd")]
    df = spark.createDataFrame(rows, "k string, t int, s string")
    got = [r.verdict for r in X.transitions(df, ["k"], "s", {"draft": 0, "final": 1}, "t").orderBy("k", "t").collect()]
    assert got == ["initial", "forward", "backward", "repeat", "bad_initial", "unknown"]
    assert {(r.k, r.s) for r in X.latest(df, ["k"], "t").collect()} == {("a", "final"), ("b", "odd")}


def test_case_scores(spark):
    ranked = spark.createDataFrame([("c", "x", 2), ("c", "y", 7), ("c", "z", 1)], "case string, t string, rank int")
    gold = spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "x")], "case string, t string")
    got = {(r.case, r.k): (r.hit, r.all_hit, r.coverage, r.precision, r.rr10) for r in E.case_scores(ranked, gold, "case", ["t"]).collect()}
    assert got["c", 1] == (0, 0, 0.0, 0.0, 0.5) and got["c", 5] == (1, 0, 0.5, 0.5, 0.5) and got["c", 10] == (1, 1, 1.0, 0.666667, 0.5) and got["d", 10] == (0, 0, 0.0, 0.0, 0.0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 400)), max_size=12), st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 400)), max_size=12))
def test_interval_algebra(spark, a, b):
    frame = lambda xs: spark.createDataFrame([("k", lo, lo + n) for lo, n in xs], "g string, lo long, hi long")
    points = lambda df: {p for r in df.collect() for p in range(r.lo, r.hi)}
    pa, pb = ({p for lo, n in xs for p in range(lo, lo + n)} for xs in (a, b))
    bounds = spark.createDataFrame([("k", 3400)], "g string, size long")
    fa, fb = frame(a), frame(b)
    assert points(I.merge(fa, ["g"])) == pa
    assert points(I.intersect(fa, fb, ["g"])) == pa & pb
    assert points(I.complement(fa, bounds, ["g"])) == set(range(3400)) - pa
    assert points(I.subtract(fa, fb, bounds, ["g"])) == pa - pb


def test_partition_problems(spark):
    bounds = spark.createDataFrame([("ok", 10), ("gap", 10), ("lap", 10), ("end", 10), ("none", 10)], "g string, size long")
    rows = [("ok", 0, 4), ("ok", 4, 10), ("gap", 0, 4), ("gap", 5, 10), ("lap", 0, 6), ("lap", 5, 10), ("end", 0, 9)]
    got = {(r.g, r.problem) for r in I.partition_problems(spark.createDataFrame(rows, "g string, lo long, hi long"), bounds, ["g"]).collect()}
    assert got == {("gap", "gap"), ("lap", "overlap"), ("end", "bad_end"), ("none", "gap")}


def test_chunks_cover_text(spark):
    text = "\n\n".join(["甲" * 30, "乙" * 95, "丙" * 10])
    (got,) = values(spark, lambda x: S.chunks(x, 50, 10), [text])
    assert all(len(c) <= 50 for c in got) and got[0] == "甲" * 30 and got[1:3] == ["乙" * 50, "乙" * 50] and got[-1].endswith("丙" * 10)


def test_structure_helpers(spark):
    assert values(spark, S.split_glued, ["42,370,183.3100.0", "12.34", "10.0012.5%", None]) == [["42,370,183.31", "00.0"], None, ["10.00", "12.5%".rstrip("%")], None]
    df = spark.createDataFrame([("abcdef", "xxabcyydef"), ("", "a"), (None, "a")], "a string, b string")
    assert [r.c for r in df.select(S.match_coverage("a", "b").alias("c")).collect()][:2] == [1.0, 0.0]
    assert [r.c for r in df.select(S.common_substring_length("a", "b").alias("c")).collect()] == [3, 0, None]
    pages = spark.createDataFrame([("d", i, f"年度报告 第{i}页\n正文{'长' * 20}{i}\n尾") for i in range(1, 6)], "d string, p int, t string")
    found = S.furniture(pages, "d", "p", "t")
    assert {(r.edge, r.template, r.on_pages) for r in found.collect()} == {("first", "年度报告 第#页", 5), ("last", "尾", 5)}
    kept = S.without_furniture(pages, "d", "p", "t", found).orderBy("p").first().kept_text
    assert kept == f"正文{'长' * 20}1"


def test_verification(spark):
    df = spark.createDataFrame([("c", "收入1,000万元，增长5%")], "k string, t string")
    got = {(r.kind, float(r.value)) for r in V.amounts(df, "k", F.col("t")).collect()}
    assert got == {("money", 1e7), ("percent", 5.0)}
    cited = spark.createDataFrame([("c", "money", Decimal(10000000))], "k string, kind string, value decimal(34,4)")
    assert V.presence(V.amounts(df, "k", F.col("t")), "k", cited, "k").first().verdict == "partial"
    assert values(spark, V.claimed_direction, ["收入增长", "收入增长、成本下降", "持平", "无", None]) == ["increased", "mixed", "unchanged", None, None]


def test_integrity_and_inventory(spark):
    blocks = spark.createDataFrame([("d", "1", "e", "h", 1), ("d", "1", "e", "g", 1), ("d", "2", "f", "h", 9), ("d", "3", "g", "h", 1), ("x", "1", "i", "h", 1), (None, "1", "j", "h", 1)], "doc string, ver string, evidence_id string, content_hash string, page_number int")
    versions = spark.createDataFrame([("d", "1", 3), ("d", "2", 3), ("d", "3", 3), ("d", "4", 3), (None, "1", 1)], "doc string, ver string, page_count int")
    bad = K.integrity_failures(blocks, versions, ["doc", "ver"])
    assert {(r.doc, r.ver): r.reasons for r in bad.collect()} == {("d", "1"): "HASH_CONFLICT", ("d", "2"): "PAGE_OUT_OF_RANGE", ("x", "1"): "NO_VERSION", (None, "1"): "NO_VERSION"}
    assert {r.evidence_id for r in K.without_quarantined(blocks, bad, ["doc", "ver"]).collect()} == {"g", "j"}
    got = {(r.doc, r.ver): (r.expected, r.actual, r.status) for r in K.inventory_difference(versions, blocks, ["doc", "ver"]).collect()}
    assert got == {("d", "1"): (1, 2, "matched"), ("d", "2"): (1, 1, "matched"), ("d", "3"): (1, 1, "matched"), ("d", "4"): (1, 0, "missing"), ("x", "1"): (0, 1, "extra"), (None, "1"): (1, 1, "matched")}
    assert K.integrity_failures(blocks.limit(0), versions.limit(0), ["doc", "ver"]).count() == 0


def test_neighbours(spark):
    blocks = spark.createDataFrame([("d", f"e{i}", i // 3, i % 3) for i in range(8)], "doc string, evidence_id string, page_number int, block_index int")
    anchors = spark.createDataFrame([("d", "e4", 1, 1)], "doc string, anchor_id string, page_number int, block_index int")
    assert {(r.evidence_id, r.offset) for r in R.neighbours(blocks, anchors, ["doc"], 2, 1).collect()} == {("e2", -2), ("e3", -1), ("e5", 1)}


def test_percentiles_of_small_and_large_groups(spark):
    rng = np.random.default_rng(3)
    sets = {"big": rng.normal(size=30_000).round(3), "ties": np.repeat([1.0, 2.0, 3.0], 7000), "one": np.array([5.0]), "few": np.arange(10.0), None: np.array([1.0, 2.0])}
    rows = [(k, float(x)) for k, v in sets.items() for x in v] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r.k: r for r in E.percentiles(df, ["k"], "x", [0.5, 0.95]).collect()}
    for k, v in sets.items():
        v = np.sort(v)
        for name, p in (("p50", 0.5), ("p95", 0.95)):
            assert got[k].n == len(v) and got[k][f"{name}_linear"] == pytest.approx(np.quantile(v, p)) and got[k][f"{name}_nearest"] == v[max(0, int(np.ceil(round(p * len(v), 9))) - 1)]
    assert got["none"].n == 0 and got["none"].p95_linear is None


def test_rules_policies_and_tools(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", -1)], "k string, x int")
    out = {(r.k, r.rule): r.verdict for r in G.evaluate_rules(df, ["k"], {"given": (F.lit(True), F.col("x").isNotNull()), "positive": (F.col("x").isNotNull(), F.col("x") > 0)}).collect()}
    assert out == {("a", "given"): "PASS", ("b", "given"): "FAIL", ("c", "given"): "PASS", ("a", "positive"): "PASS", ("b", "positive"): "NOT_APPLICABLE", ("c", "positive"): "FAIL"}
    cited = spark.createDataFrame([("s", "u1", "A"), ("s", "u1", "A"), ("s", "u2", "B"), ("t", "u3", "B"), ("v", "u4", "C")], "subject string, source string, grade string")
    assert {r.subject: r.verdict for r in G.source_policy(cited, ["subject"], "grade", {"A": 2, "B": 2}).collect()} == {"s": "B", "t": "insufficient", "v": "insufficient"}
    admitted = spark.createDataFrame([("c", "r1", 1), ("c", "r2", 2), ("d", "r1", 1)], "company string, record string, value int")
    ids = lambda df, rules="1": {r.company: r.snapshot_id for r in G.snapshots(df, ["company"], "record", rules).collect()}
    assert ids(admitted) == ids(admitted.union(admitted).repartition(3)) and ids(admitted)["c"] != ids(admitted.where("record = 'r1'"))["c"] and ids(admitted) != ids(admitted, "2")
    pages = spark.createDataFrame([("d", "x" * 200)] * 8 + [("d", None), ("e", "x" * 200), ("e", " " * 300)], "doc string, text string")
    assert {r.doc: (r.low_pages, r.verdict) for r in G.page_quality(pages, ["doc"], "text").collect()} == {"d": (1, "warn"), "e": (1, "refuse")}
    box, calls = G.Toolbox(failures_allowed=2), []

    def look(term, k=1):
        calls.append(term)
        if term == "bad":
            raise ValueError("no luck")
        return term * k

    box.register(G.Tool("look", look, ("direct",), {"term": str, "k?": int}, retries=1))
    with pytest.raises(ValueError):
        box.register(box.tools["look"])
    assert box.execute("look", "direct", term="x", k=2) == ("OK", "xx")
    assert [box.execute(*a, **k)[0] for a, k in ((("other", "direct"), {}), (("look", "deep"), {"term": "x"}), (("look", "direct"), {}), (("look", "direct"), {"term": 1}), (("look", "direct"), {"term": "x", "k": True}), (("look", "direct"), {"term": "x", "z": 1}))] == ["UNKNOWN_TOOL", "ROUTE_NOT_ALLOWED", *["BAD_ARGUMENTS"] * 4]
    assert box.execute("look", "direct", term="bad") == ("FAILED", "no luck") and calls[-2:] == ["bad", "bad"]
    assert box.execute("look", "direct", term="bad")[0] == "FAILED" and box.execute("look", "direct", term="x")[0] == "CIRCUIT_OPEN"
    providers = G.Providers()
    with pytest.raises(LookupError):
        providers("x")
    providers.register("a", str.upper)
    providers.register("b", str.lower)
    assert providers("Xy") == "XY"
    providers.use("b")
    assert providers("Xy") == "xy"
    with pytest.raises(KeyError):
        providers.use("c")


def test_gold_pages_and_eligibility(spark):
    aliases = {"年报": "ar", "募集说明书": "pr"}
    read = lambda spec: E.page_targets(spec, aliases)
    assert read("年报P3-5/P7+募集说明书 P12（见/附注）") == ([("ar", 3), ("ar", 4), ("ar", 5), ("ar", 7), ("pr", 12)], False, [])
    assert read("外部网页 / 年报P5-4/年报P4") == ([("ar", 4), ("ar", 5)], True, [])
    assert read("P3/年报募集章节") == ([("ar", None)], False, ["P3", "年报募集章节"]) and read(None) == ([], False, [])
    targets = [("ok", "local", "ar", 3), ("far", "local", "ar", 99), ("odd", "local", "zz", 1), ("none", "local", "ar", None), ("gone", "local", "pr", 1), ("web", "external", None, None), ("db", "structured_db", None, None), ("mix", "external", None, None), ("mix", "structured_db", None, None), ("x", None, None, None)]
    docs = spark.createDataFrame([("ar", 10), ("pr", 5)], "document_id string, page_count int")
    got = E.eligibility(spark.createDataFrame(targets, "case_id string, channel string, document_id string, page int"), docs, "case_id", docs.where("document_id = 'ar'"))
    assert {r.case_id: r.eligibility for r in got.collect()} == {"ok": "ELIGIBLE_LOCAL", "far": "INVALID_GOLD_MAPPING", "odd": "INVALID_GOLD_MAPPING", "none": "INVALID_GOLD_MAPPING", "gone": "MISSING_CORPUS_DOCUMENT", "web": "EXTERNAL_ONLY", "db": "STRUCTURED_DB_ONLY", "mix": "NON_LOCAL_MIXED", "x": "INVALID_GOLD_MAPPING"}


def test_reference_occurrences(spark):
    texts = ["如下表所示，详见第三节“财务”。参见下表", "详见下表；上表与下表", "详见。", "", None]
    got = [(r.id, r.occurrence, r.kind, r.marker, r.start, r.end, r.target) for r in S.reference_occurrences(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").orderBy("id", "occurrence").collect()]
    assert got == [(0, 0, "table", "如下表所示", 0, 5, None), (0, 1, "named", "详见", 6, 8, "第三节“财务"), (0, 2, "table", "下表", 18, 20, None), (1, 0, "table", "下表", 2, 4, None), (1, 1, "table", "上表", 5, 7, None), (1, 2, "table", "下表", 8, 10, None)]
    spans = values(spark, C.heading_spans, ["第一节 概况\n正文。\n（二）财务", "正文", "", None])
    assert [None if s is None else [(x.line, x.start, x.end, x.level) for x in s] for s in spans] == [[(0, 0, 6, 1), (2, 11, 16, 3)], [], [], None]
    assert values(spark, lambda x: C.equivalent(x, F.lit("A b"), True), ["Ａ b", "A\u200bb", "a b", None]) == [True, True, False, None]


def test_contents_outline_and_tables(spark):
    pages = spark.createDataFrame([("d", "目录\n第一节 概况 ...... 3\n二、风险     12\n正文 5 页\n\n"), ("e", None), ("f", "")], "doc string, text string")
    assert [(r.doc, r.line, r.title, r.page) for r in S.toc_entries(pages, ["doc"], "text").orderBy("line").collect()] == [("d", 1, "第一节 概况", 3), ("d", 2, "二、风险", 12)]
    levels = [1, 2, 3, 2, 4, 1, None, 3]
    heads = spark.createDataFrame([("d", i, f"h{i}", v) for i, v in enumerate(levels)], "doc string, place int, node string, level int")
    assert {r.node: r.parent for r in S.outline(heads, ["doc"], ["place"], "node", "level").collect()} == {"h0": None, "h1": "h0", "h2": "h1", "h3": "h0", "h4": "h3", "h5": None, "h7": "h5"}
    rows = spark.createDataFrame([("a", "其他应付款 DB-2023-1908437 33,310.57 -48,081.82"), ("b", "无"), ("c", None), ("d", "1.2.3 x")], "k string, text string")
    assert [(r.k, r.label, r.cell, float(r.value)) for r in S.note_cells(rows, "k", "text").orderBy("k", "cell").collect()] == [("a", "其他应付款", 0, 33310.57), ("a", "其他应付款", 1, -48081.82)]
    amounts = V.amounts_in_context(spark.createDataFrame([("a", "收入 1,234.5万元 12% 7", None, None), ("b", "7", "千元", "元"), ("c", "7", None, "亿元"), ("d", None, None, None), ("e", "7", "桶", None)], "k string, t string, h string, u string"), "k", F.col("t"), F.col("h"), F.col("u"))
    assert {(r.k, r.kind, float(r.value), r.basis) for r in amounts.collect()} == {("a", "money", 12345000.0, "inline"), ("a", "percent", 12.0, "inline"), ("a", "ambiguous", 7.0, None), ("b", "money", 7000.0, "column"), ("c", "money", 7e8, "table"), ("e", "ambiguous", 7.0, None)}
    closed = ["前三名供应商为甲、乙、丙。", "共2家：甲、乙、丙", "前五名为甲、乙", "前三名主要为甲、乙、丙", "合计增长", "甲、乙", None]
    assert values(spark, V.closed_set, closed) == ["PARTIAL", "UNSUPPORTED", "PARTIAL", "PARTIAL", "PARTIAL", "NOT_TRIGGERED", "NOT_TRIGGERED"]


def test_focus_as_of(spark):
    ends = [dt.date(y, 12, 31) for y in (2019, 2020, 2021, 2022)] + [dt.date(2020, 6, 30), dt.date(2022, 6, 30), dt.date(2023, 3, 31), dt.date(2021, 3, 31)]
    facts = spark.createDataFrame([("c", e) for e in ends] + [("z", dt.date(2020, 3, 31)), ("z", None)], "c string, period_end date")
    read = lambda **k: sorted((r.c, str(r.period_end)) for r in A.focus_periods(facts, "c", **k).collect())
    base = [("c", "2020-12-31"), ("c", "2021-12-31"), ("c", "2022-06-30"), ("c", "2022-12-31"), ("c", "2023-03-31"), ("z", "2020-03-31")]
    assert read() == base and read(as_of="2021-03-31") == sorted([*base, ("c", "2021-03-31")]) and read(as_of="1999-01-01") == base


def test_contracts_and_versions(spark):
    from strataquill.operators import nested

    doc = '{"sections": [{"section_id": "s", "topics": [{"topic_id": "t", "questions": [{"question_id": "q", "text": "x", "aspects": {"a1": {"w": 1}}}]}]}]}'
    rows = nested.contract_tables(spark.createDataFrame([("v1", doc), ("v2", "no json"), ("v3", None)], "version string, body string"), "version", "body").collect()
    assert {(r.record_key, r.table_tag, r.parent_id, r.child_id) for r in rows} == {("v1", "section", "v1", "s"), ("v1", "topic", "s", "t"), ("v1", "question", "t", "q"), ("v1", "aspect", "q", "a1")}
    assert len({r.fingerprint for r in rows}) == 1 and len(rows[0].fingerprint) == 64


def test_expansion_budgets(spark):
    kinds = ["table", "paragraph", "paragraph", "paragraph", "heading", "paragraph", "table", "paragraph", "paragraph"]
    rows = [("d", f"e{i}", i // 4, i % 4, k, "x" * 100) for i, k in enumerate(kinds)] + [("e", "f0", 1, 0, "table", None), ("e", "f1", 1, 1, "paragraph", "y" * 300), ("e", "f2", 9, 0, "paragraph", "y")]
    blocks = spark.createDataFrame(rows, "doc string, evidence_id string, page_number int, block_index int, evidence_type string, text string")
    anchors = blocks.where("evidence_type = 'table'").selectExpr("doc", "evidence_id as anchor_id", "page_number", "block_index")
    read = lambda **b: {r.evidence_id: r.end_reason for r in R.expand(blocks, anchors, ["doc"], **b).collect()}
    assert read(after=5, pages=9, chars=10**6) == {"e1": None, "e2": None, "e3": "heading", "e7": None, "e8": "document", "f1": None, "f2": "document"}
    assert read(after=5, pages=2, chars=250) == {"e1": None, "e2": "chars", "e7": None, "e8": "document"}
    assert read(after=1, pages=2, chars=10**6) == {"e1": "blocks", "e7": "blocks", "f1": "pages"}
    assert R.expand(blocks.limit(0), anchors, ["doc"], 2, 2, 10).count() == 0


def test_stored_index(spark):
    docs = spark.createDataFrame([(1, "现金流量 cash"), (2, "现金 cash cash"), (3, None), (4, ""), (5, "其他")], "doc_id long, text string")
    first = R.SearchIndex.of(docs, "doc_id", "text")
    version = R.SearchIndex.version(docs, "doc_id", "text")
    assert version == R.SearchIndex.version(docs.repartition(3), "doc_id", "text") != R.SearchIndex.version(docs.where("doc_id < 5"), "doc_id", "text")
    assert {(r.term, r.df, r.cf) for r in first.terms.collect()} == {("现金", 2, 2), ("金流", 1, 1), ("流量", 1, 1), ("cash", 2, 3), ("其他", 1, 1)}
    assert first.size.first() == (5, 8 / 5)
    built = first.postings.inputFiles()
    assert R.SearchIndex.of(docs.repartition(2), "doc_id", "text").postings.inputFiles() == built
    asked = spark.createDataFrame([("q", "cash 现金"), ("none", "。"), ("null", None)], "q string, text string")
    assert [(r.q, r.doc_id, r["rank"]) for r in first.search("doc_id", asked, "q", F.col("text")).orderBy("rank").collect()] == [("q", 2, 1), ("q", 1, 2)]
    with pytest.raises(ValueError):
        R.filtered(docs, owner="x")


def test_mixed_vector_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0])] + [(i, [2.0, 2.0, 2.0]) for i in range(210, 10, -1)], "k long, v array<double>")
    asked = spark.createDataFrame([("two", [1.0, 0.0]), ("three", [1.0, 1.0, 1.0]), ("four", [1.0] * 4)], "q string, qv array<double>")
    got = {(r.q, r["rank"]): r.k for r in R.nearest(df, "k", "v", asked, "q", "qv", 10).collect()}
    assert got == {("two", 1): 1, ("two", 2): 2} | {("three", i): i + 10 for i in range(1, 11)}


def test_structured_lookup_outcomes(spark):
    d = dt.date(2023, 12, 31)
    fields = spark.createDataFrame([("c", d, "CASH", "ok", 5.0), ("c", d, "AR", "ambiguous", None)], "company_id string, period_end date, item_code string, status string, value double")
    results = spark.createDataFrame([("c", d, "PROF_ROE", "CALCULATED_EXACT", 0.5), ("c", d, "EBITDA", "MISSING_INPUT", None)], "company_id string, period_end date, formula string, status string, value double")
    rows = [("1", "c", "field", "CASH", d), ("2", "c", "field", "AR", d), ("3", "c", "field", "BONDS", d), ("4", "c", "metric", "PROF_ROE", d), ("5", "c", "metric", "EBITDA", d), ("6", "c", "metric", "X", d), ("7", "c", "field", "CASH", dt.date(2022, 12, 31)), ("8", "z", "field", "CASH", d), ("9", "c", None, None, d), ("10", "c", "field", "CASH", None)]
    out = R.structured_lookup(spark.createDataFrame(rows, "request_id string, company_id string, target_type string, code string, period_end date"), fields, results)
    got = {r.request_id: (r.value, r.outcome) for r in out.collect()}
    assert got == {"1": (5.0, "OK"), "2": (None, "AMBIGUOUS_VALUE"), "3": (None, "FIELD_NOT_FOUND"), "4": (0.5, "OK"), "5": (None, "METRIC_MISSING_INPUT"), "6": (None, "METRIC_NOT_FOUND"), "7": (None, "PERIOD_NOT_AVAILABLE"), "8": (None, "NO_SNAPSHOT"), "9": (None, "NO_TARGET"), "10": (None, "PERIOD_NOT_AVAILABLE")}


def test_period_wordings(spark):
    heads = {"2024年6月30日": ("2024-06-30", "interim"), "2023-13-45": ("2023-12-31", "annual"), "2023年2月": ("2023-02-30", "quarterly"), "2024年第三季度": ("2024-09-30", "quarterly"), "2024一季报": ("2024-03-31", "quarterly"), "2024Q4": ("2024-12-31", "quarterly"), "2024半年度": ("2024-06-30", "interim"), "2024年中报": ("2024-06-30", "interim"), "2024年度": ("2024-12-31", "annual"), "2024": ("2024-12-31", "annual"), "项目": (None, None), "": (None, None)}
    assert [tuple(x) for x in values(spark, P.header_period, list(heads))] == list(heads.values())
    texts = {"2024年1月1日至2024年6月30日收入": ("extracted", "2024-01-01..2024-06-30"), "2023年度与2023年": ("extracted", "2023年度"), "2022年和2023年上半年": ("ambiguous", None), "无": ("absent", None), "2023年13月": ("absent", None), "2023年第2季度": ("extracted", "2023年Q2"), "2023年5月": ("extracted", "2023-05"), None: ("absent", None)}
    assert [(x.status, x.period) for x in values(spark, P.explicit_period, list(texts))] == list(texts.values())
    assert values(spark, lambda x: P.period_expression(x, F.lit("end")), ["2025-12-31", "2025-09-30", "2025-05-31", "x", None]) == ["2025年末", "2025年三季度末", "2025年5月末", "x", None]
    assert values(spark, lambda x: P.period_expression(x, F.lit("flow")), ["2025-09-30", "2025-05-31"]) == ["2025年前三季度", "2025年1-5月"]
    assert values(spark, lambda x: P.scope_is_late(x, F.lit("2023")), ["2024Q1", "2023", "x", None]) == [True, False, False, False]
    assert P.report_clock(dt.datetime(2024, 1, 1, 20, tzinfo=dt.UTC), "Asia/Shanghai") == {"utc": "2024-01-01T20:00:00Z", "local_date": "2024-01-02", "zone": "Asia/Shanghai"}
    with pytest.raises(ValueError):
        P.report_clock(dt.datetime(2024, 1, 1), "Asia/Shanghai")
    available = F.array(*map(F.lit, ("2021-12-31", "2022-12-31", "2023-12-31", "2023-06-30")))
    assert values(spark, lambda x: P.comparison_periods(x, available), ["近三年", "2021年至2023年", "2023年变化", "2023年", "2019年与2020年", None]) == [["2021-12-31", "2022-12-31", "2023-12-31"], ["2021-12-31", "2023-12-31"], ["2022-12-31", "2023-12-31"], [], [], []]


def test_targets_and_spans(spark):
    aliases = {"净利润": "NP", "归母净利润": "PNP", "利润": "P"}
    got = values(spark, lambda x: K.alias_spans(x, aliases), ["归母净利润与利润", "净利润净利润", "", None])
    assert [sorted((s.start, s.end, s.code) for s in g) for g in got] == [[(1, 6, "PNP"), (7, 9, "P")], [(1, 4, "NP"), (4, 7, "NP")], [], []]
    target = lambda x: K.question_target(x, {"流动比率": "CR", "速动比率": "QR"}, {"货币资金": "CASH", "负债": "TL"}, {"CASH": ("受限",)})
    out = [tuple(t) for t in values(spark, target, ["流动比率是多少", "流动比率、速动比率和负债", "货 币资金", "受限货币资金", "货币资金与负债", "其他", None])]
    assert out == [("metric", "CR", None), (None, None, "ambiguous_metric"), ("field", "CASH", None), (None, None, "sub_item"), (None, None, "ambiguous_field"), (None, None, "no_target"), (None, None, "no_target")]
    assert values(spark, K.source_grade, ["https://www.csrc.gov.cn/a", "cninfo.com.cn", "http://a@b.sina.com.cn:80/x", "https://notgov.cn", "", None]) == ["A", "B", "C", "D", "D", "D"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n\n{"a": 2}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    (tmp_path / "p.txt").write_text("one\ftwo")
    assert [(r.page_number, r.text) for r in readers.page_texts(spark, str(tmp_path / "p.txt")).orderBy("page_number").collect()] == [(1, "one"), (2, "two")]
    assert values(spark, readers.html_text, ["<head><title>x</title></head><p>a &amp; b</p><script>1</script><div>c</div>", None]) == ["a & b\nc", None]
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("create table t (a int, b text)")
        db.executemany("insert into t values (?, ?)", [(i, str(i)) for i in range(10)])
    assert readers.sqlite_table(spark, str(tmp_path / "s.db"), "t", "a long, b string", 3).agg(F.sum("a")).first()[0] == 45
    path = str(tmp_path / "store")
    rows = spark.range(3)
    assert sinks.commit_version(rows, path, "v1", str(tmp_path / "ptr"), ["k"], 3) and not sinks.commit_version(rows, path, "v1", str(tmp_path / "ptr"), ["k"], 3)
    with pytest.raises(ValueError):
        sinks.commit_version(rows, path, "v2", str(tmp_path / "ptr"), ["k"], 4)
    assert spark.read.parquet(str(tmp_path / "ptr")).count() == 2
    sinks.trace(rows, str(tmp_path / "trace"))
    assert spark.read.json(str(tmp_path / "trace")).count() == 3


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="资产" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>货币资金</t></si><si><t>2023-12-31</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><f>1+1</f><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>')
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    cells = readers.xlsx_cells(spark, str(tmp_path / "*.xlsx"))
    got = {(r.row, r.col): (r.value, r.formula, r.merged_from) for r in cells.collect()}
    assert got == {(1, 2): ("2023-12-31", None, None), (2, 1): ("货币资金", None, None), (2, 2): ("2", "1+1", None), (3, 1): ("货币资金", None, "A2")}
    (row,) = readers.statement_candidates(cells).collect()
    assert (row.label, row.header, row.raw_value) == ("货币资金", "2023-12-31", "2")


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, 0), "k" + str(i % 3), ["draft", "final"][i % 2], float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, key string, status string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = validity.event_stream(spark, str(tmp_path / "ev"), "*.parquet")
    got = validity.run_to_end(validity.windowed_counts(stream, "ts", "status", late="1 day"), "w", "complete")
    assert sorted(got.collect()) == sorted(validity.windowed_counts(df, "ts", "status").collect())
    steps = validity.run_to_end(validity.accepted_transitions(stream, "key", "status", "ts", {"draft": 0, "final": 1}), "steps")
    assert {(r.key, r.status) for r in steps.collect()} <= set(itertools.product(["k0", "k1", "k2"], ["draft", "final"]))
    assert steps.where("status = 'final'").count() == 3


def test_empty_tables(spark):
    facts = spark.createDataFrame([], "company_id string, period_end date, item_code string, value double, source string, low double, high double, unit string")
    assert M.compute(facts).count() == 0 and A.reconcile(facts, ["company_id", "item_code"]).count() == 0 and A.trend(facts, ["company_id"]).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.bm25(docs, "doc_id", "text", docs.select(F.col("doc_id").alias("q"), "text"), "q", F.col("text")).count() == 0
