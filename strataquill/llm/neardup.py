"""Near-duplicate texts by tensored minhash banding.

A text is the set of its k-character sequences. A few small collections of minhashes are computed; every pair of
collections gives one table key, so m collections serve m * (m - 1) / 2 tables. Two texts meet in some table whenever
two of their collections agree; a 64-bit sketch carried along drops most chance meetings, and the exact Jaccard
similarity decides. Texts that are equal but for blanks form one class, compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm.arrays import U64, chunks, code_points, kept, kgrams, mix
from strataquill.session import written

BLANKS = "\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\u001c-\\u001f"
SPACES = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def squeezed(text: Column | str) -> Column:
    """The text without any blanks."""
    return F.regexp_replace(text, f"[{BLANKS}]+", "")


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-character sequences in a row, start of each text); blanks are left out, short texts have none."""
    codes, starts = code_points(texts)
    codes, starts = kept(codes, starts, ~np.isin(codes, SPACES))
    hashed = kgrams(mix(codes), k)
    lengths = np.maximum(0, np.diff(starts) - k + 1)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts[:-1] - begin[:-1], lengths) + np.arange(int(begin[-1]))
    return mix(hashed[at]), begin


def signatures(texts: list[str], k: int, collections: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the texts that have sequences, their table keys, their sketches of 64 one-bit minhashes)."""
    hashed, begin = shingles(texts, k)
    has = np.flatnonzero(np.diff(begin) > 0)
    if not len(has):
        return has, np.zeros((0, 0), U64), np.zeros(0, U64)
    first = begin[:-1][has]
    seeds = mix(np.arange(1, collections * rows + 65, dtype=U64)) | U64(1)
    least = lambda s: np.minimum.reduceat(hashed * s, first)
    parts = []
    for c in range(collections):
        value = np.full(len(has), c + 1, U64)
        for r in range(rows):
            value = mix(value * U64(0x9E3779B97F4A7C15) + least(seeds[c * rows + r]))
        parts.append(value)
    keys = [mix(parts[i] * U64(3) + parts[j] * U64(5) + U64(i * collections + j)) for i in range(collections) for j in range(i + 1, collections)]
    sketch = np.zeros(len(has), U64)
    for b in range(64):
        sketch |= (mix(least(seeds[collections * rows + b])) & U64(1)) << U64(b)
    return has, np.stack(keys, axis=1), sketch


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def similar_classes(docs: DataFrame, key: str, text_col: str, k: int = 5, threshold: float = 0.7, collections: int = 10, rows: int = 2, slack: float = 3.3) -> tuple[DataFrame, DataFrame]:
    """(members: key and class of every text; links: class pairs with class_a < class_b and their similarity).

    Candidates share a table key and have sketches within ``slack`` standard deviations of what ``threshold`` gives; at a
    similarity of 0.70 the default ten collections of two meet with probability 0.987, at 0.75 with 0.996, and the
    sketch keeps 0.9995 of them. Copies are one class; classes are made distinct before their keys are worked out, so a
    group of copies with a third of all rows costs one row per task in that shuffle and one row per table after it. Null
    texts and keys are left out; texts too short for a single sequence are members of a class without links; repeated
    rows count once.
    """
    rows_in = docs.where(F.col(key).isNotNull() & F.col(text_col).isNotNull()).select(F.col(key).alias("__key"), squeezed(text_col).alias("__text"))
    classed = rows_in.withColumn("__class", F.xxhash64("__text"))
    members = classed.select(F.col("__key").alias(key), F.col("__class").alias("class_id")).distinct()
    texts = written(classed.select("__class", "__text").distinct(), "neardup-classes")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shown = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo, hi in chunks(shown, 500_000):
                has, keys, sketch = signatures(shown[lo:hi], k, collections, rows)
                if len(has):
                    n = keys.shape[1]
                    columns = (keys.ravel(), np.repeat(ids[lo:hi][has], n), np.repeat(sketch, n))
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["t", "c", "s"])

    tables = texts.mapInArrow(emit, "t long, c long, s long")
    agree = 64 * (1 + threshold) / 2
    least = int(agree - slack * np.sqrt(agree * (1 - threshold) / 2))
    a, b = tables.alias("a"), tables.alias("b")
    met = a.join(b, F.expr(f"a.t = b.t and a.c < b.c and bit_count(a.s ^ b.s) <= {64 - least}"))
    pairs = written(met.select(F.col("a.c").alias("class_a"), F.col("b.c").alias("class_b")).distinct(), "neardup-pairs")

    sided = pairs.join(texts.select(F.col("__class").alias("class_a"), F.col("__text").alias("ta")), "class_a").join(texts.select(F.col("__class").alias("class_b"), F.col("__text").alias("tb")), "class_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            scores = []
            sides = batch.column(2).to_pylist() + batch.column(3).to_pylist()
            seen: dict[str, np.ndarray] = {}
            fresh = list(dict.fromkeys(sides))
            for lo, hi in chunks(fresh, 500_000):
                hashed, begin = shingles(fresh[lo:hi], k)
                for i in range(lo, hi):
                    seen[fresh[i]] = np.unique(hashed[begin[i - lo] : begin[i - lo + 1]])
            for i in range(n):
                scores.append(jaccard(seen[sides[i]], seen[sides[n + i]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["class_a", "class_b", "similarity"])

    links = sided.select("class_a", "class_b", "ta", "tb").mapInArrow(verify, "class_a long, class_b long, similarity double").where(F.col("similarity") >= threshold)
    return members, links


def similar_pairs(docs: DataFrame, key: str, text_col: str, **settings) -> DataFrame:
    """All pairs of keys, smaller first in string order, whose texts are similar or equal but for blanks."""
    members, links = similar_classes(docs, key, text_col, **settings)
    members = written(members, "neardup-members")
    x = members.select(F.col(key).alias("x"), F.col("class_id").alias("class_a"))
    y = members.select(F.col(key).alias("y"), F.col("class_id").alias("class_b"))
    across = links.join(x, "class_a").join(y, "class_b").select("x", "y")
    within = x.join(y, (F.col("class_a") == F.col("class_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, class_id, group_id, links): the group of every text, joined by links directly or by way of others.

    Alternating large-star and small-star steps over the class links, each written to the shared folder; the least
    class of a group is its id, and a class without links is its own group. The steps go on until they change nothing,
    which takes about the square of the logarithm of the longest chain. ``links`` counts the classes linked to each.
    """
    links = written(links.select("class_a", "class_b"), "neardup-links")
    both = links.unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    degree = both.groupBy("class_a").agg(F.count("*").alias("links")).withColumnRenamed("class_a", "class_id")
    edges = links.select(F.greatest("class_a", "class_b").alias("u"), F.least("class_a", "class_b").alias("v")).distinct()
    state = None
    while True:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "neardup-stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("group_id")).withColumnRenamed("u", "class_id")
    return members.join(roots, "class_id", "left").join(degree, "class_id", "left").select(key, "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
