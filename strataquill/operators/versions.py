"""Versions and validity over append-only logs: latest state, transitions, pointers, content versions, commits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataquill.session import written


def latest(log: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The last row of each key by the ``order`` columns; a partial aggregate of one struct, no sort of whole groups."""
    rest = [c for c in log.columns if c not in keys and c not in order]
    top = log.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*keys, *(F.col(f"__top.{c}").alias(c) for c in (*order, *rest)))


def transitions(log: DataFrame, keys: Sequence[str], status: str, ranks: Mapping[str, int], *order: str) -> DataFrame:
    """Every event with a verdict: initial, bad_initial, unknown, repeat (no-op), forward, or backward (rejected).

    The state an event meets is the highest rank seen before it among known states, so a rejected event changes nothing.
    """
    table = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    rank = F.try_element_at(table, F.col(status))
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = log.withColumn("rank", rank).withColumn("met", F.max("rank").over(before))
    verdict = (
        F.when(F.col("rank").isNull(), "unknown")
        .when(F.col("met").isNull(), F.when(F.col("rank") == min(ranks.values()), "initial").otherwise("bad_initial"))
        .when(F.col("rank") == F.col("met"), "repeat")
        .when(F.col("rank") > F.col("met"), "forward")
        .otherwise("backward")
    )
    return rows.withColumn("verdict", verdict)


def current_pointers(switches: DataFrame, keys: Sequence[str], target: str, at: str) -> DataFrame:
    """The target each key points to now and how often it was switched."""
    return switches.groupBy(*keys).agg(F.max_by(target, F.struct(at, target)).alias(target), F.max(at).alias("switched_at"), F.count("*").alias("switches"))


def content_versions(fetches: DataFrame, key: str, digest: str, at: str) -> DataFrame:
    """A version number per distinct content of a key, by first sight."""
    seen = fetches.groupBy(key, digest).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("fetches"))
    return seen.withColumn("content_version", F.row_number().over(W.partitionBy(key).orderBy("first_seen", digest)))


def plan_commits(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], digest: str, status: str) -> DataFrame:
    """What committing each incoming version does: fresh, reuse (same content is current), reactivate (same content is retired), conflict (another content under the key)."""
    known = stored.select(*keys, F.col(digest).alias("__digest"), F.col(status).alias("__status")).groupBy(*keys).agg(F.max(F.struct("__digest", "__status")).alias("__s"))
    joined = incoming.join(known, list(keys), "left")
    path = F.when(F.col("__s").isNull(), "fresh").when(F.col("__s.__digest") != F.col(digest), "conflict").when(F.col("__s.__status") == "current", "reuse").otherwise("reactivate")
    return joined.withColumn("commit_path", path).drop("__s")


def new_only(incoming: DataFrame, stored: DataFrame, digest: str) -> DataFrame:
    """Incoming rows of unseen content, one per digest (the least by all other columns)."""
    fresh = incoming.join(stored.select(digest).distinct(), digest, "left_anti")
    rest = [c for c in fresh.columns if c != digest]
    return fresh.groupBy(digest).agg(F.min(F.struct(*rest)).alias("__r")).select(digest, "__r.*")


def delete_guard(documents: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Whether each document may be deleted: only if nothing refers to it. Nothing is deleted here."""
    held = references.groupBy(key).agg(F.count("*").alias("__n"))
    joined = documents.join(held, key, "left")
    return joined.withColumn("reference_count", F.coalesce("__n", F.lit(0))).withColumn("deletable", F.col("reference_count") == 0).drop("__n")


def set_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are missing, extra, or there several times, with both counts; equal sets give no rows."""
    left = expected.groupBy(*keys).agg(F.count("*").alias("expected_count"))
    right = actual.groupBy(*keys).agg(F.count("*").alias("actual_count"))
    both = left.join(right, list(keys), "full").na.fill(0, ["expected_count", "actual_count"])
    state = F.when(F.col("actual_count") == 0, "missing").when(F.col("expected_count") == 0, "extra").when(F.col("actual_count") > F.col("expected_count"), "duplicate").when(F.col("actual_count") < F.col("expected_count"), "short")
    return both.withColumn("state", state).where("state is not null")


def ordered_sources(versions: DataFrame, series: Sequence[str], at: str, current: Column) -> DataFrame:
    """Role of each version in its series: current (the newest that may be), history (older), topic (newer or none current)."""
    order = W.partitionBy(*series).orderBy(F.when(current, 0).otherwise(1), F.col(at).desc(), F.col("document_version"))
    placed = versions.withColumn("__n", F.row_number().over(order)).withColumn("__c", current)
    anchor = placed.where("__n = 1 and __c").select(*series, F.col(at).alias("__anchor_at"), F.col("document_version").alias("__anchor"))
    joined = placed.join(anchor, list(series), "left")
    role = F.when(F.col("__anchor").isNull(), "topic").when(F.col("document_version") == F.col("__anchor"), "current").when(F.col(at) <= F.col("__anchor_at"), "history").otherwise("topic")
    return joined.withColumn("role", role).drop("__n", "__c", "__anchor_at", "__anchor")


def strict_insert(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Incoming rows with ``outcome``: insert (new key), same (equal in all fields), conflict (key there with other fields)."""
    held = stored.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields)).withColumn("__there", F.lit(True)).dropDuplicates(list(keys))
    joined = incoming.join(held, list(keys), "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    outcome = F.when(F.col("__there").isNull(), "insert").when(same, "same").otherwise("conflict")
    return joined.withColumn("outcome", outcome).select(*incoming.columns, "outcome")


def invalidated(snapshots: DataFrame, inputs: str, changed: DataFrame, key: str) -> DataFrame:
    """Snapshots that depend on a changed input, and on how many."""
    touched = snapshots.select(*[c for c in snapshots.columns if c != inputs], F.explode(inputs).alias(key)).join(changed.select(key).distinct(), key, "left_semi")
    return touched.groupBy(*[c for c in snapshots.columns if c != inputs]).agg(F.count_distinct(key).alias("changed_inputs"))


def append_checked(df: DataFrame, path: str, expected: int) -> DataFrame:
    """Append a batch after checking that the written copy has the expected number of rows; raises ValueError otherwise."""
    copy = written(df, "append")
    count = copy.count()
    if count != expected:
        raise ValueError(f"batch has {count} rows, expected {expected}")
    copy.write.mode("append").parquet(path)
    return copy
