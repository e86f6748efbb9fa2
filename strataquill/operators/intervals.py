"""Half-open character intervals [lo, hi): merge, complement, intersection, difference, partition check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping and touching intervals of a key as one; empty and reversed ones are left out."""
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = intervals.where("lo < hi").withColumn("reach", F.max("hi").over(before))
    rows = rows.withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("lo") > F.col("reach")), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*keys, "lo", "hi")


def complement(intervals: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the intervals leave of each [0, size) in ``bounds`` (keys, size), keys without intervals included."""
    merged = merge(intervals, keys)
    clipped = merged.join(bounds, list(keys)).select(*keys, F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", "size").alias("hi"))
    edges = clipped.unionByName(bounds.select(*keys, F.col("size").alias("lo"), F.col("size").alias("hi")))
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    return edges.withColumn("from", F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where("from < lo").select(*keys, F.col("from").alias("lo"), F.col("lo").alias("hi"))


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], cell: int = 1024) -> DataFrame:
    """Pieces that lie in both sets, merged. Intervals are cut into cells of fixed length so that the join is by key and cell, not by range."""
    cells = lambda df: merge(df, keys).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))))
    left, right = cells(a), cells(b).select(*keys, "cell", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    start, end = F.greatest("lo", "lo2", F.col("cell") * cell), F.least("hi", "hi2", (F.col("cell") + 1) * cell)
    pieces = left.join(right, [*keys, "cell"]).select(*keys, start.alias("lo"), end.alias("hi"))
    return merge(pieces, keys)


def subtract(a: DataFrame, b: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces of ``a`` that are not in ``b``, within [0, size)."""
    return intersect(a, complement(b, bounds, keys), keys)


def partition_problems(intervals: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Why intervals are no partition of [0, size): gap, overlap, empty, or bad_end; a sound partition gives no rows."""
    order = W.partitionBy(*keys).orderBy("lo", "hi")
    rows = intervals.join(bounds, list(keys), "right").withColumn("reach", F.coalesce(F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    problem = F.when(F.col("lo").isNull(), F.when(F.col("size") > 0, "gap")).when(F.col("lo") >= F.col("hi"), "empty").when(F.col("lo") > F.col("reach"), "gap").when(F.col("lo") < F.col("reach"), "overlap")
    inner = rows.withColumn("problem", problem).where("problem is not null").select(*keys, F.coalesce("lo", F.lit(0)).alias("at"), "problem")
    ends = intervals.groupBy(*keys).agg(F.max("hi").alias("end")).join(bounds, list(keys)).where("end != size").select(*keys, F.col("end").alias("at"), F.lit("bad_end").alias("problem"))
    return inner.unionByName(ends)


def conservation(intervals: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, size, total, covered, repeated, uncovered, conserved): whether the intervals of a key account for each position once.

    ``total`` sums their lengths, ``covered`` counts positions in any of them, ``repeated`` what lies in several.
    """
    inside = intervals.join(bounds, list(keys)).select(*keys, F.greatest("lo", F.lit(0)).alias("lo"), F.least("hi", "size").alias("hi")).where("lo < hi")
    total = inside.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("total"))
    covered = merge(inside, keys).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    both = bounds.join(total, list(keys), "left").join(covered, list(keys), "left").na.fill(0, ["total", "covered"])
    return both.select(*keys, "size", "total", "covered", (F.col("total") - F.col("covered")).alias("repeated"), (F.col("size") - F.col("covered")).alias("uncovered"), ((F.col("covered") == F.col("size")) & (F.col("total") == F.col("size"))).alias("conserved"))
