"""Queries of the general data problems: units (p5) and nested records (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.operators import nested, units
from strataquill.session import new_path, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report figures stated again by table rows in other units."""
    matched = units.match_restated(units.report_quantities(table(spark, sf_dir, "report_meta")), units.evidence_quantities(table(spark, sf_dir, "evidence_blocks")))
    return matched.select("report_id", "evidence_id").distinct()


def p5_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p5_found, with the residual and whether one combination of units alone explains the pair."""
    return units.match_restated(units.report_quantities(table(spark, sf_dir, "report_meta")), units.evidence_quantities(table(spark, sf_dir, "evidence_blocks")))


def p5_base_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of table rows and report headers in base units."""
    a = units.evidence_quantities(table(spark, sf_dir, "evidence_blocks")).withColumn("source_table", F.lit("evidence_blocks"))
    b = units.report_quantities(table(spark, sf_dir, "report_meta")).withColumn("source_table", F.lit("report_meta"))
    return a.unionByName(b).select("source_table", "key", "number", "unit", "dimension", "base_value").distinct()


def _tables(spark: SparkSession, sf_dir: str) -> nested.TaggedTables:
    emitted = nested.emit_evidence(table(spark, sf_dir, "evidence_blocks"), table(spark, sf_dir, "run_manifest"), table(spark, sf_dir, "question_outcome"))
    return nested.TaggedTables(emitted, new_path(spark, "nested"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of nested objects to the nearest enclosing object with an id, from the tables written by tag."""
    return _tables(spark, sf_dir).links().select("source_table", "record_key", "parent_id", "child_id").distinct()


def p6_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and kind: objects, those right below the record, those below another object, and those without a parent row."""
    links = _tables(spark, sf_dir).links()
    keys = links.select("source_table", "record_key", F.col("child_id").alias("parent_id"), F.lit(True).alias("found")).distinct()
    joined = links.join(keys, ["source_table", "record_key", "parent_id"], "left")
    top = F.col("parent_id") == F.col("record_key")
    return joined.groupBy("source_table", "table_tag").agg(F.count("*").alias("objects"), F.count_if(top).alias("at_top"), F.count_if(F.col("found") & ~top).alias("below_another"), F.count_if(F.col("found").isNull() & ~top).alias("orphans"))


def _child(tag: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tables(spark, sf_dir).child(tag)

    query.__doc__ = f"The flat table of the nested objects of kind {tag}, with the keys of their records and parents."
    return query


QUERIES = {"p5_found": p5_found, "p5_restated": p5_restated, "p5_base_values": p5_base_values, "p6_found": p6_found, "p6_orphans": p6_orphans, **{f"p6_table_{tag}": _child(tag) for tag in nested.EVIDENCE_SCHEMAS}}
SQL: dict[str, str] = {}
