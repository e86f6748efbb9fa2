"""Retrieval: BM25, vector similarity, rank fusion, channel status, bounded reading and navigation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataquill.functions.columns import tokens
from strataquill.session import exists, shared_dir


#: Rows of query terms (some 50 bytes each) that a search may send to every task.
BROADCAST_TERMS = 200_000


class SearchIndex:
    """A stored index of terms: postings in the order of their terms, term statistics, and the size of the collection.

    It is written once per version to the shared folder. The version is derived from all keys and texts, so ``of`` opens
    a stored index only if it was built from exactly these rows, and builds it otherwise; a build that was broken off has
    no manifest and is not opened.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.postings = spark.read.parquet(f"{path}/postings")
        self.terms = spark.read.parquet(f"{path}/terms")
        self.size = spark.read.parquet(f"{path}/size")

    @staticmethod
    def version(docs: DataFrame, key: str, text: str) -> str:
        """Of the rows as they are: their number and the sum of their hashes, which no order or partition changes."""
        rows = docs.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), F.col(key), F.col(text)).cast("decimal(38,0)")) for seed in (1, 2))).first()
        return hashlib.sha256(json.dumps(["bm25", 1, key, *map(str, rows)]).encode()).hexdigest()[:32]

    @classmethod
    def of(cls, docs: DataFrame, key: str, text: str) -> SearchIndex:
        spark = docs.sparkSession
        path = f"{shared_dir(spark)}/bm25-{cls.version(docs, key, text)}"
        if not exists(spark, f"{path}/manifest/_SUCCESS"):
            cls.build(docs, key, text, path)
        return cls(spark, path)

    @staticmethod
    def build(docs: DataFrame, key: str, text: str, path: str) -> None:
        """One tokenising pass writes the postings; statistics are summed from what is written."""
        spark = docs.sparkSession
        listed = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("__t"))
        counted = listed.select("key", F.size("__t").alias("dl"), F.explode_outer("__t").alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))
        counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
        written = spark.read.parquet(f"{path}/postings")
        written.where("term is not null").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.mode("overwrite").parquet(f"{path}/terms")
        lengths = written.agg(F.sum(F.when(F.col("term").isNotNull(), F.col("tf")).otherwise(0)).alias("tokens"))
        lengths.crossJoin(docs.agg(F.count("*").alias("n"))).select("n", F.try_divide("tokens", "n").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/size")
        spark.createDataFrame([(key, path)], "key string, path string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")

    def search(self, key: str, queries: DataFrame, query_key: str, query_text: Column, k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query key, key, score, rank): the ``k`` best texts of each query.

        A query term counts as often as it occurs; the score is rounded to 10 places for ranking, ties go to the smaller
        key. The query terms are counted first: up to ``BROADCAST_TERMS`` are sent to the postings, which then need no shuffle
        before their scores are summed; more are joined by term, and adaptive execution splits a term that is in very many
        texts. Queries without terms and texts without a common term give no rows.
        """
        asked = queries.select(query_key, F.explode(tokens(query_text)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
        idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(self.terms, "term").crossJoin(F.broadcast(self.size)).select(query_key, "term", "avgdl", (F.col("qtf") * idf).alias("w"))
        part = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        if asked.count() <= BROADCAST_TERMS:
            weighted = F.broadcast(weighted)
        scored = self.postings.join(weighted, "term").groupBy(query_key, "key").agg(F.sum(part).alias("raw"))
        best = W.partitionBy(query_key).orderBy(F.round("raw", 10).desc(), F.col("key"))
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_key, F.col("key").alias(key), F.round("raw", 6).alias("score"), "rank")


def term_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, cf): in how many texts a term occurs and how often, from the stored index."""
    return SearchIndex.of(docs, key, text).terms


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: Column, k: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``SearchIndex.search`` in the stored index of ``docs``."""
    return SearchIndex.of(docs, key, text).search(key, queries, query_key, query_text, k, k1, b)


# Keys a search may be narrowed by.
FILTERS = ("company_id", "source", "lang", "label", "document_id", "evidence_type")


def filtered(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows that equal all given values, before any ranking; a key that is no filter key raises ValueError."""
    unknown = sorted(set(wanted) - set(FILTERS))
    if unknown:
        raise ValueError(f"unknown filter keys: {unknown}")
    for name, value in wanted.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 20, block: int = 4096) -> DataFrame:
    """(query key, key, score, rank): the ``k`` vectors of greatest cosine similarity for each query, exactly.

    Queries are taken in blocks of a bounded size; each block is broadcast and met by every vector in one matrix product
    per batch, of which only the best ``k`` per query and batch are passed on. Blocks hold queries of one length, and only
    vectors of that length are compared with them; null vectors are left out and a zero vector scores 0. Ties go to the
    smaller key.
    """
    kind = dict(vectors.dtypes)[key]
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(query_vector).alias("v"))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    context = vectors.sparkSession.sparkContext
    parts: list[DataFrame] = []
    pending: dict[int, list] = {}

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def launch(width: int) -> None:
        kept = pending.pop(width)
        shared = context.broadcast(([r.q for r in kept], unit(np.array([list(r.v) for r in kept], np.float64))))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for batch in batches:
                lists = batch.column(1)
                fits = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == width)
                if not len(fits):
                    continue
                taken = batch.take(pa.array(fits))
                # In key order, a stable sort by similarity gives ties to the smaller key, so the best k are exact.
                taken = taken.take(pc.sort_indices(taken.column(0), null_placement="at_start"))
                sims = np.round(matrix @ unit(taken.column(1).flatten().to_numpy().reshape(-1, width)).T, 10)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                at = top.ravel()
                chosen = taken.column(0).take(pa.array(at))
                asked_for = pa.array([names[i] for i in np.repeat(np.arange(len(names)), top.shape[1])])
                yield pa.RecordBatch.from_arrays([asked_for, chosen, pa.array(np.take_along_axis(sims, top, axis=1).ravel())], names=["q", "k", "s"])

        query_kind = dict(asked.dtypes)["q"]
        parts.append(rows.mapInArrow(score, f"q {query_kind}, k {kind}, s double"))

    for row in asked.toLocalIterator():
        pending.setdefault(len(row.v), []).append(row)
        if len(pending[len(row.v)]) == block:
            launch(len(row.v))
    for width in list(pending):
        launch(width)
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"{query_key} {dict(asked.dtypes)['q']}, {key} {kind}, score double, rank int")
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    best = W.partitionBy("q").orderBy(F.col("s").desc(), F.col("k"))
    ranked = together.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("k").alias(key), F.round("s", 6).alias("score"), "rank")


def fuse(channels: DataFrame, query_key: str, key: str, k: int = 20, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query key, channel, key, rank): the first place in each channel counts 1 / (constant + rank)."""
    first = channels.groupBy(query_key, "channel", key).agg(F.min("rank").alias("rank"))
    summed = first.groupBy(query_key, key).agg(F.sum(1.0 / (constant + F.col("rank"))).alias("raw"), F.array_sort(F.collect_set("channel")).alias("channels"))
    best = W.partitionBy(query_key).orderBy(F.round("raw", 10).desc(), F.col(key))
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_key, key, F.round("raw", 8).alias("score"), "rank", F.concat_ws("+", "channels").alias("channels"))


def channel_status(sparse_ok: Column, dense_ok: Column, hits: Column) -> Column:
    """FAILED if both channels failed, PARTIAL if one did, EMPTY without hits, else COMPLETED."""
    return F.when(~sparse_ok & ~dense_ok, "FAILED").when(~sparse_ok | ~dense_ok, "PARTIAL").when(hits == 0, "EMPTY").otherwise("COMPLETED")


def boosted(hits: DataFrame, query_key: str, key: str, kind: str, boosts: Mapping[str, float], k: int) -> DataFrame:
    """Scores times the boost of their kind (1 where none is given), ranked anew and cut at ``k``."""
    table = F.create_map(*(F.lit(x) for pair in boosts.items() for x in pair))
    raised = hits.withColumn("score", F.round(F.col("score") * F.coalesce(F.try_element_at(table, F.col(kind)), F.lit(1.0)), 8))
    return raised.withColumn("rank", F.row_number().over(W.partitionBy(query_key).orderBy(F.col("score").desc(), key))).where(F.col("rank") <= k)


def merged(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """Hits of several queries as one list: queries in order, each key at its first place, cut at ``limit``."""
    first = hits.groupBy(key).agg(F.min(F.struct("query_order", "rank")).alias("at"))
    return first.select(key, F.col("at.query_order").alias("query_order"), F.col("at.rank").alias("rank")).orderBy("query_order", "rank", key).limit(limit)


def _placed(blocks: DataFrame, anchors: DataFrame, scope: list[str], where: str) -> tuple[DataFrame, DataFrame]:
    """(blocks that pass ``where`` with their place in reading order, anchors with the number of such blocks up to them)."""
    order = W.partitionBy(*scope).orderBy("page_number", "block_index", "evidence_id", "__anchor")
    rows = blocks.withColumn("__pass", F.expr(where)).withColumn("__anchor", F.lit(0))
    spots = anchors.select(*scope, F.col("anchor_id").alias("evidence_id"), "page_number", "block_index", F.lit(False).alias("__pass"), F.lit(1).alias("__anchor"))
    both = rows.unionByName(spots, allowMissingColumns=True).withColumn("place", F.sum(F.coalesce("__pass", F.lit(False)).cast("long")).over(order))
    return both.where("__pass and __anchor = 0"), both.where("__anchor = 1").select(*scope, F.col("evidence_id").alias("anchor_id"), F.col("page_number").alias("anchor_page"), F.col("place").alias("anchor_place"))


def neighbours(blocks: DataFrame, anchors: DataFrame, scope: list[str], before: int, after: int, where: str = "true") -> DataFrame:
    """Blocks read around anchors: up to ``before`` and ``after`` places in reading order within the same ``scope``.

    ``anchors`` has the scope columns, anchor_id, page_number and block_index. Order is (page_number, block_index,
    evidence_id); the anchor itself is not returned. Distance is counted among blocks that pass ``where``. Each anchor
    asks for its places by number, so a document costs as many rows as it has blocks and anchors, not their product.
    """
    placed, at = _placed(blocks.select(*scope, "evidence_id", "page_number", "block_index", *(c for c in blocks.columns if c not in (*scope, "evidence_id", "page_number", "block_index"))), anchors, scope, where)
    asked = at.select(*scope, "anchor_id", "anchor_place", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset")).withColumn("place", F.col("anchor_place") + F.col("offset"))
    near = asked.join(placed.select(*scope, "place", "evidence_id"), [*scope, "place"])
    return near.where("evidence_id != anchor_id").select("anchor_id", "evidence_id", F.col("offset").cast("long").alias("offset"))


def expand(blocks: DataFrame, anchors: DataFrame, scope: list[str], after: int, pages: int, chars: int) -> DataFrame:
    """(anchor_id, evidence_id, offset, chars_so_far, end_reason): the blocks that follow an anchor, within budgets.

    Reading stops before the first heading, at a page more than ``pages`` after the anchor's, before the block with which
    the text would exceed ``chars`` characters, and after ``after`` blocks. ``end_reason`` tells on the last block read
    what ended it, the first that applies of document, heading, pages, chars and blocks.
    """
    placed, at = _placed(blocks.select(*scope, "evidence_id", "page_number", "block_index", "evidence_type", F.length(F.coalesce("text", F.lit(""))).alias("n")), anchors, scope, "true")
    asked = at.select(*scope, "anchor_id", "anchor_page", "anchor_place", F.explode(F.sequence(F.lit(1), F.lit(after + 1))).alias("offset")).withColumn("place", F.col("anchor_place") + F.col("offset"))
    met = asked.join(placed.select(*scope, "place", "evidence_id", "page_number", "evidence_type", "n"), [*scope, "place"], "left")
    on = W.partitionBy(*scope, "anchor_id").orderBy("offset")
    total = F.sum("n").over(on)
    stop = F.when(F.col("evidence_id").isNull(), "document").when(F.col("evidence_type") == "heading", "heading").when(F.col("page_number") > F.col("anchor_page") + pages, "pages").when(total > chars, "chars").when(F.col("offset") > after, "blocks")
    seen = met.withColumn("chars_so_far", total).withColumn("__stop", stop).withColumn("__ended", F.first("__stop", ignorenulls=True).over(on)).withColumn("__next", F.lead("__stop").over(on))
    return seen.where("__ended is null").select("anchor_id", "evidence_id", "offset", "chars_so_far", F.col("__next").alias("end_reason"))


def section_lookup(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """(ref_id, evidence_id, hits, outcome) of section references: a number opens the text or a title of the path, a title is in the path.

    ``references`` has ref_id, document_id, number, title. ``outcome`` is dangling for no hit, unique, or ambiguous.
    """
    rows = blocks.select("document_id", "evidence_id", "text", "section_path").dropDuplicates(["evidence_id"])
    joined = references.join(rows, "document_id", "left")
    by_number = F.col("number").isNotNull() & (F.col("text").startswith(F.col("number")) | F.exists("section_path", lambda p: p.startswith(F.col("number"))))
    by_title = F.col("title").isNotNull() & F.exists("section_path", lambda p: p.contains(F.col("title")))
    hit = joined.withColumn("hit", F.when(by_number | by_title, F.col("evidence_id")))
    counted = hit.groupBy("ref_id").agg(F.count("hit").alias("hits"), F.min("hit").alias("evidence_id"))
    return counted.withColumn("outcome", F.when(F.col("hits") == 0, "dangling").when(F.col("hits") == 1, "unique").otherwise("ambiguous"))


def navigate(nodes: DataFrame, wanted: DataFrame, weights: Mapping[str, float], band: float = 0.5) -> DataFrame:
    """Nodes scored by weighted hits of keys in their fields; per question those within ``band`` of the best, or all if none hits.

    ``nodes`` has node_id and the text fields named in ``weights``; ``wanted`` has question_id and term. Terms and fields
    meet by the first two characters of the term, which every field that contains it has too; so no pair of a node and a
    term without anything in common is formed. Empty terms hit nothing; terms of one character meet by that one.
    """
    terms = wanted.where("length(term) > 0").select("question_id", "term", F.substring("term", 1, 2).alias("__pair"))

    def openings(field: str) -> Column:
        cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(field)), lambda i: F.substring(F.col(field), i, F.lit(n)))
        return F.array_union(cut(2), cut(1))

    parts = []
    for field, weight in weights.items():
        pairs = openings(field)
        held = nodes.where(F.length(field) > 0).select("node_id", F.col(field).alias("__text"), F.explode(pairs).alias("__pair"))
        parts.append(held.join(terms, "__pair").where(F.col("__text").contains(F.col("term"))).select("question_id", "node_id", "term", F.lit(float(weight)).alias("w")).distinct())
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    scored = hits.groupBy("question_id", "node_id").agg(F.round(F.sum("w"), 6).alias("score"))
    top = W.partitionBy("question_id")
    return scored.withColumn("best", F.max("score").over(top)).where(F.col("score") >= F.col("best") - band).select("question_id", "node_id", "score")


def read_order(nodes: DataFrame, group: str) -> DataFrame:
    """Order in which nodes are read: by substance (length of body in three tiers), length, relevance, place in the document."""
    tier = F.when(F.col("body_chars") >= 400, 0).when(F.col("body_chars") >= 80, 1).otherwise(2)
    by = W.partitionBy(group).orderBy(tier, F.col("body_chars").desc(), F.col("hits").desc(), "place", "node_id")
    return nodes.withColumn("tier", tier).withColumn("read_rank", F.row_number().over(by))


def inventory_fingerprint(rows: DataFrame, group: list[str], key: str, digest: str) -> DataFrame:
    """SHA-256 over the sorted key:digest lines of each group, the version an index is checked against."""
    lines = rows.select(*group, F.concat_ws(":", key, digest).alias("line")).distinct()
    return lines.groupBy(*group).agg(F.count("*").alias("members"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("fingerprint"))


def structured_lookup(requests: DataFrame, fields: DataFrame, results: DataFrame) -> DataFrame:
    """(request columns, value, outcome) of requests for a metric or a field of a company at a period.

    ``requests`` has request_id, company_id, target_type (metric or field), code, period_end; ``fields`` company_id,
    period_end, item_code, status, value as of a value index; ``results`` company_id, period_end, formula, status, value.
    Where there is no value the outcome tells why: NO_TARGET, NO_SNAPSHOT (nothing of the company), PERIOD_NOT_AVAILABLE,
    FIELD_NOT_FOUND, AMBIGUOUS_VALUE, METRIC_NOT_FOUND, or METRIC_ and the status of the metric.
    """
    companies = fields.select("company_id").distinct().withColumn("__c", F.lit(True))
    periods = fields.select("company_id", "period_end").distinct().withColumn("__p", F.lit(True))
    held = fields.select("company_id", "period_end", F.lit("field").alias("target_type"), F.col("item_code").alias("code"), F.col("status").alias("__s"), F.col("value").cast("double").alias("__v"))
    held = held.unionByName(results.select("company_id", "period_end", F.lit("metric").alias("target_type"), F.col("formula").alias("code"), F.col("status").alias("__s"), F.col("value").cast("double").alias("__v")))
    joined = requests.join(companies, "company_id", "left").join(periods, ["company_id", "period_end"], "left").join(held, ["company_id", "period_end", "target_type", "code"], "left")
    field = F.col("target_type") == "field"
    outcome = (
        F.when(F.col("code").isNull() | F.col("target_type").isNull(), "NO_TARGET").when(F.col("__c").isNull(), "NO_SNAPSHOT").when(F.col("__p").isNull(), "PERIOD_NOT_AVAILABLE")
        .when(field & F.coalesce(F.col("__s") == "ambiguous", F.lit(False)), "AMBIGUOUS_VALUE").when(field & F.col("__v").isNull(), "FIELD_NOT_FOUND")
        .when(F.col("__s").isNull(), "METRIC_NOT_FOUND").when(F.col("__v").isNull(), F.concat(F.lit("METRIC_"), F.col("__s"))).otherwise("OK")
    )
    return joined.select("request_id", "company_id", "period_end", "target_type", "code", F.when(outcome == "OK", F.col("__v")).alias("value"), outcome.alias("outcome"))
