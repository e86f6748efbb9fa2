"""Queries and operators do the whole job where the test tables cannot show it."""

from pyspark.sql import functions as F

from strataquill.operators import retrieval as R
from strataquill.plans import evidence_queries


def test_value_presence_in_a_late_paragraph(spark, tmp_path):
    text = "\n\n".join(["收入为5,000万元", *["段落"] * 1500, "收入为0.5亿元"])
    rows = [(1, text, "C1"), (2, "收入为5,000万元", "C1"), (3, None, "C1"), (4, text, None)]
    spark.createDataFrame(rows, "doc_id long, text string, company_id string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.figures, r.matched, r.verdict) for r in evidence_queries.value_presence(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 1, "matched"), 2: (1, 0, "missing")}


def test_nearest_takes_the_smaller_of_many_tied_keys(spark):
    for kind, name in (("long", int), ("string", lambda i: f"{i:03d}")):
        rows = [(name(i), [1.0, 0.0] if i < 100 else [0.0, 1.0]) for i in reversed(range(150))]
        df = spark.createDataFrame(rows, f"k {kind}, v array<double>").coalesce(1)
        asked = spark.createDataFrame([("q", [2.0, 0.0])], "q string, qv array<double>")
        got = R.nearest(df, "k", "v", asked, "q", "qv", 10).orderBy("rank").select(F.col("k")).collect()
        assert [r.k for r in got] == [name(i) for i in range(10)]
