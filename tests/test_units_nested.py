"""Units and nested records: hand-made cases, brute force, nulls, empties, repeats, clashing columns."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strataquill.operators import nested, units

BLOCKS = "evidence_id string, company_id string, report_period string, evidence_type string, text string, structured_payload string, unit string, key string"
REPORT = "id string, company_id string, report_period string, item_name_cn string, amount double, amount_unit string, unit_note string, sign int"


def block(i, text, payload=None, company="C1", period="2023-12-31", kind="table_row"):
    return (i, company, period, kind, text, payload, "clash", "clash")


def figure(i, amount, unit=None, note=None, item="存货", company="C1", period="2023-12-31"):
    return (i, company, period, item, amount, unit, note, 9)


def found(spark, blocks, report):
    m = units.match_restated(units.report_quantities(spark.createDataFrame(report, REPORT)), units.evidence_quantities(spark.createDataFrame(blocks, BLOCKS)))
    return {(r.report_id, r.evidence_id) for r in m.collect()}


def test_restated_in_other_units(spark):
    blocks = [
        block("a", "其中：存货 1,234.5 万元"),
        block("a", "其中：存货 1,234.5 万元"),
        block("b", "存货（RMB'000）：１２,３４５"),
        block("c", "存货", '{"caption": "单位：亿元", "unit": null, "row": {"values": [{"v": "0.12345"}]}}'),
        block("d", "存货为(1234.5)万元"),
        block("e", "存货 1,234.5 千元"),
        block("f", "存货 1,234.5 万元", period=None),
        block("g", "货币资金 1,234.5 万元"),
        block("h", "存货 1,234.5 万元", kind="paragraph"),
        block("i", None),
        block("j", "存货"),
        block("k", "存货12345000", json.dumps({"value": "12345000", "unit": "人民币元"})),
        block("l", "存货12345000", json.dumps(json.dumps({"value": "12345000", "unit": "元"}))),
        block("m", "存货12345000 ", '{"value": "12345000", "uni'),
    ]
    report = [figure("r", 12345.0, " RMB'000"), figure("n", -0.12345, None, "除特别注明外，以亿元列示"), figure("z", None, "元"), figure("q", 12345000.0)]
    got = found(spark, blocks, report)
    assert got == {(r, e) for r in ("r", "q") for e in "abckl"} | {("n", "d")}


def test_zero_and_empty(spark):
    assert found(spark, [block("a", "存货 0 元")], [figure("r", 0.0)]) == {("r", "a")}
    assert found(spark, [], [figure("r", 1.0)]) == set()
    assert found(spark, [block("a", "存货 0 元")], []) == set()


def test_unit_spellings():
    sizes = {"亿千瓦时": 1e8, "TWH": 1e9, "㎡": 1, "公顷": 1e4, "kt": 1e6, "百万吨": 1e9, "RMB bn": 1e9, "人民币万元": 1e4, "CNY thousand": 1e3, "度 ": 1, "万平方米": 1e4}
    assert {u: units.parse_unit(u)[2] for u in sizes} == sizes
    assert units.find_unit("（金额单位：CNY thousand）")[2] == 1e3
    assert units.find_unit("in kg")[1] == "mass" and units.find_unit("经审计") is None


def test_unknown_units_are_refused(spark):
    for note in ("万美元", "单位：万港元", "以亿日元列示", "in USD mn", "元/吨", "2023年度报告", "见附注五"):
        assert units.find_unit(note) is None
    cases = {"万美元": True, "单位：万桶": True, "in USD mn": True, "经审计": False, "合并报表": False, "2023年度报告": False, None: False}
    assert {n: units.names_other_unit(n) for n in cases} == cases
    rows = [(" 万元 ", None, 1e4, None), (None, "单位：千万元", 1e7, None), ("", "RMB'000", 1e3, None), (None, "经审计", 1, None), (None, None, 1, None), ("ＲＭＢ bn", "x", 1e9, None), (None, "除特别注明外，以CNY thousand列示", 1e3, None), (None, "亿元口径", 1e8, None),
            ("万美元", None, None, "FOREIGN_CURRENCY"), (None, "单位：万港元", None, "FOREIGN_CURRENCY"), ("桶", "元", None, "UNKNOWN_UNIT"), (None, "单位：万桶", None, "UNKNOWN_UNIT"), ("kWh", None, None, "NON_MONEY_UNIT"), (None, "in kg", None, "NON_MONEY_UNIT"), (None, "2023年度报告", 1, None)]
    df = units.with_money_unit(spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, u string, n string"), "u", "n").orderBy("i").collect()
    assert [(None if r.m["size"] is None else float(r.m["size"]), r.m.reason) for r in df] == [r[2:] for r in rows]
    report = [figure("a", 12345.0, "万美元"), figure("b", 12345.0, None, "单位：万桶"), figure("c", 123450000.0)]
    assert found(spark, [block("x", "存货 12345 万元"), block("y", "存货 12345 万美元")], report) == {("c", "x")}


def test_candidate_units_compete_by_residual(spark):
    """Neither number has a unit beside it; of the units the record names, the one that fits is taken."""
    blocks = [block("a", "存货（万元）（经审计，千元口径）12345"), block("b", "存货 12345", '{"unit": "万元", "value": "1"}')]
    m = units.match_restated(units.report_quantities(spark.createDataFrame([figure("r", 123450000.0)], REPORT)), units.evidence_quantities(spark.createDataFrame(blocks, BLOCKS)))
    assert sorted((r.evidence_id, r.evidence_unit, r.unique) for r in m.collect()) == [("a", "万元", True), ("b", "万元", True)]


def test_identity_units(spark):
    rows = [("s", 7.8 * v, 7800.0, v * 1e-3) for v in (1.0, 2.5, 4.0)] + [("s", None, 1.0, 1.0), ("t", None, None, None)]
    df = spark.createDataFrame(rows, "source string, mass double, density double, volume double")
    out = units.solve_identity_units(df, {"mass": 1, "density": -1, "volume": -1}, {"mass": [("kg", 1.0), ("t", 1000.0)], "density": [("kg/m3", 1.0), ("g/cm3", 1000.0)], "volume": [("m3", 1.0)]}, ["source"]).collect()
    assert len(out) == 1 and out[0].rows_used == 3 and out[0].residual < 1e-9
    # mass in t with density in g/cm3 fits as well as kg with kg/m3
    assert not out[0].unique


def links(spark, docs, key="k"):
    df = spark.createDataFrame(docs, f"{key} string, j string, child_id string")
    return sorted((r.record_key, r.parent_id, r.child_id) for r in nested.emit_nested(df, key, "j", "t").collect())


def test_nested_shapes(spark):
    doc = {"rows": [{"row_id": "r1", "cells": {"cell_id": "c1", "footnote": {"note_id": "n1"}}, "children": {"r2": {"label": "x", "cells": [{"cell_id": "c2"}]}, "r3": {}}}], "unit": None}
    want = [("k", "c1", "n1"), ("k", "k", "r1"), ("k", "r1", "c1"), ("k", "r1", "r2"), ("k", "r1", "r3"), ("k", "r2", "c2")]
    text = json.dumps(doc)
    assert links(spark, [("k", text, "x")]) == want
    assert links(spark, [("k", json.dumps(text), "x")]) == want
    assert links(spark, [("k", json.dumps({"v": 2, "body": {"grid": {**doc, "rows": json.dumps(doc["rows"])}}}), "x")]) == want


def test_nested_bad_input(spark):
    rows = [("a", None, "x"), ("b", "", "x"), ("c", '{"rows": [{"row_id": "r1"}', "x"), ("d", '{"rows": [{"row_id": NaN}]}', "x"), (None, '{"row_id": "r"}', "x"), ("e", "[]", "x"), ("f", '"text"', "x")]
    assert links(spark, rows) == []
    assert links(spark, []) == []
    deep = '{"children": [' * 3000 + '{"row_id": "r"}' + "]}" * 3000
    assert links(spark, [("k", deep, "x")]) == [("k", "k", "r")]


def test_nested_to_any_depth(spark):
    """Deep documents, also in what becomes a payload, are read and written without recursion."""
    n = 50_000
    deep = '{"children": [' * n + '{"row_id": "r", "x": ' + '{"y": [' * n + "1" + "]}" * n + "}" + "]}" * n
    rows = nested.emit_nested(spark.createDataFrame([("k", deep)], "k string, j string"), "k", "j", "t").collect()
    assert [(r.parent_id, r.child_id) for r in rows] == [("k", "r")]
    assert rows[0].payload == '{"row_id": "r", "x": ' + '{"y": [' * n + "1" + "]}" * n + "}"


def test_deep_decoder_is_that_of_json():
    good = ['{}', '[]', ' { "a" : [ 1 , -2.5e3 , true , false , null , "\\u00e9\\n" , { } , [ ] ] , "b":{"c":[[1],[2]]}} ', '"x"', "0", "[0.5]"]
    bad = ["", "{", "[1,]", '{"a":}', '{"a" 1}', "[1 2]", "01", "nul", '{"a":1,}', "[]]", "{]", '"x', "[NaN]", "{1:2}"]
    for t in good:
        assert nested.decode_deep(t) == json.loads(t) and json.loads(nested.encode_deep(json.loads(t))) == json.loads(t)
    for t in bad:
        with pytest.raises(ValueError):
            nested.decode_deep(t)


def test_payload_keeps_all_fields(spark):
    doc = {"claims": [{"claim_id": "c", "tags": ["a", "b"], "meta": {"n": 1, "more": {"z": []}}, "empty": {}, "none": None, "enc": json.dumps({"q": [1]}), "box": {"gap": {"gap_id": "g", "reason": "x"}, "kept": True}, "only": [{"note_id": "n1"}]}]}
    rows = nested.emit_nested(spark.createDataFrame([("k", json.dumps(doc))], "k string, j string"), "k", "j", "t").collect()
    got = {r.child_id: json.loads(r.payload) for r in rows}
    assert got == {"c": {"claim_id": "c", "tags": ["a", "b"], "meta": {"n": 1, "more": {"z": []}}, "empty": {}, "none": None, "enc": {"q": [1]}, "box": {"kept": True}}, "g": {"gap_id": "g", "reason": "x"}, "n1": {"note_id": "n1"}}


def brute(node, parent):
    """Recursive reading of the same rules for plain lists."""
    out = []
    if isinstance(node, list):
        return [x for n in node for x in brute(n, parent)]
    if isinstance(node, dict):
        own = next((node[f"{k}_id"] for k in nested.EVIDENCE_KINDS if f"{k}_id" in node), None)
        out = [(parent, own)] if own else []
        for v in node.values():
            out += brute(v, own or parent)
    return out


def test_nested_against_recursion(spark):
    rng = random.Random(4)
    count = iter(range(10**6))

    def make(depth):
        node = {"x": rng.random()}
        if rng.random() < 0.7:
            node[rng.choice(["row_id", "cell_id", "claim_id"])] = f"i{next(count)}"
        if depth:
            for name in rng.sample(["p", "q", "s"], rng.randrange(3)):
                node[name] = [make(depth - 1) for _ in range(rng.randrange(3))]
        return node

    docs = [(f"k{i}", make(5)) for i in range(60)]
    got = links(spark, [(k, json.dumps(d), "x") for k, d in docs])
    assert got == sorted((k, *x) for k, d in docs for x in brute(d, k))


def test_tagged_tables(spark, tmp_path):
    df = spark.createDataFrame([("k", '{"stages": [{"stage_id": "s1", "status": "ok", "tasks": [{"task_id": "t1", "n": 3}]}]}')], "k string, j string")
    path = str(tmp_path / "tagged")
    nested.write_tagged(nested.emit_nested(df, "k", "j", "t"), path)
    assert nested.read_tagged(spark, path, "task", "n int").collect() == [("t", "k", "s1", "t1", 3)]
    with pytest.raises(Exception):
        nested.write_tagged(nested.emit_nested(df, "k", "j", "t"), path)


def test_no_shuffle(spark):
    df = spark.createDataFrame([("k", "{}")], "k string, j string").select("k", "j", F.lit(1).alias("payload"))
    plan = nested.emit_nested(df, "k", "j", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
