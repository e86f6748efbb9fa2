"""Queries over documents, evidence blocks and embeddings: retrieval and reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import columns as C
from strataquill.operators import retrieval as R
from strataquill.session import table

BOOSTS = {"debt_circular": 1.25, "annual_report": 1.05, "rating_comment": 0.95}
TERMS = {"debt": ["债", "贷款", "借款"], "cash": ["现金"], "growth": ["增长", "增幅"]}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "retrieval_eval_case").where("question is not null")


def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.term_statistics(_docs(spark, sf_dir), "doc_id", "text")


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25(_docs(spark, sf_dir), "doc_id", "text", _cases(spark, sf_dir), "case_id", F.col("question"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return R.nearest(vectors, "vec_id", "embedding", vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id", "q", 10)


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


def dense_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits that are no longer current drop out after ranking, so ranks keep their gaps."""
    current = table(spark, sf_dir, "embeddings").where("label % 2 = 0").select("vec_id")
    return _dense(spark, sf_dir).join(current, "vec_id", "left_semi")


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_question = bm25_search(spark, sf_dir).select("case_id", "doc_id", "rank").withColumn("channel", F.lit("question"))
    by_passage = R.bm25(_docs(spark, sf_dir), "doc_id", "text", _cases(spark, sf_dir), "case_id", F.col("notes")).select("case_id", "doc_id", "rank").withColumn("channel", F.lit("notes"))
    return by_question.unionByName(by_passage)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fuse(_channels(spark, sf_dir), "case_id", "doc_id", 10)


def hybrid_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each case from what its channels returned; a case without notes has a failed second channel."""
    hits = rrf_fusion(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("hits"))
    cases = _cases(spark, sf_dir).select("case_id", F.col("question").isNotNull().alias("s"), F.col("notes").isNotNull().alias("d"))
    joined = cases.join(hits, "case_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return joined.select("case_id", "hits", R.channel_status(F.col("s"), F.col("d"), F.col("hits")).alias("status"))


def priority_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = bm25_search(spark, sf_dir).join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    return R.boosted(hits, "case_id", "doc_id", "source", BOOSTS, 5).select("case_id", "doc_id", "score", "rank")


def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merged(bm25_search(spark, sf_dir).withColumnRenamed("case_id", "query_order"), "doc_id", 30)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_blocks").dropDuplicates(["evidence_id"])


def bounded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    anchors = blocks.where("evidence_type = 'table'").select("document_id", "document_version", F.col("evidence_id").alias("anchor_id"), "page_number", "block_index")
    return R.neighbours(blocks, anchors, ["document_id", "document_version"], 2, 2, "evidence_type in ('paragraph', 'table')")


def section_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles, and the numbers they begin with, looked up in every document that has blocks."""
    blocks = table(spark, sf_dir, "evidence_blocks")
    number = F.nullif(F.regexp_extract("title", NUMBERED, 1), F.lit(""))
    titles = table(spark, sf_dir, "section_titles").where("title is not null").select("title", number.alias("number"))
    refs = blocks.select("document_id").distinct().crossJoin(F.broadcast(titles)).select(F.concat_ws("|", "document_id", "title").alias("ref_id"), "document_id", "number", "title")
    return R.section_lookup(blocks, refs)


NUMBERED = "^(第[一二三四五六七八九十百0-9]+[章节]|[一二三四五六七八九十]+、|[(（][一二三四五六七八九十]+[)）]|[0-9]+(?:[.][0-9]+)*)"


def keyword_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", *(C.contains_any(text, words).alias(name) for name, words in TERMS.items()))


def route_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching route of each question and why."""
    q = F.col("question")
    year = F.regexp_extract(q, "([12][0-9]{3})年", 1)
    route = F.when(F.col("priority").isNull(), "audit").when(year == "", "unparseable_time").when(q.contains("如何"), "deep").when(F.length(q) < 12, "direct").otherwise("standard")
    return _cases(spark, sf_dir).select("case_id", route.alias("route"), F.when(year != "", year).alias("year"))


def outline_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that each section title leads to, by the words of the title without its number."""
    nodes = _blocks(spark, sf_dir).where("evidence_type = 'heading'").select(F.col("evidence_id").alias("node_id"), F.col("text").alias("title"), F.array_join("section_path", "/").alias("path"))
    wanted = table(spark, sf_dir, "section_titles").select(F.col("title_id").alias("question_id"), F.trim(F.regexp_replace("title", NUMBERED, "")).alias("term"))
    return R.navigate(nodes, wanted, {"title": 3.0, "path": 1.0})


def read_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which the blocks of a document are read; relevance is the number of topic words they hold."""
    words = [w for terms in TERMS.values() for w in terms]
    hits = sum((F.coalesce(F.col("text").contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))
    nodes = _blocks(spark, sf_dir).select("document_id", F.col("evidence_id").alias("node_id"), F.length("text").alias("body_chars"), hits.alias("hits"), (F.col("page_number") * 1000 + F.col("block_index")).alias("place"))
    return R.read_order(nodes, "document_id").select("document_id", "node_id", "tier", "read_rank")


def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inventory_fingerprint(table(spark, sf_dir, "evidence_blocks").where("document_id is not null"), ["document_id"], "evidence_id", "content_hash")


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id", F.length(C.fold_blanks(t)).alias("folded_chars"), F.round(C.char_share(t, "[0-9]"), 6).alias("digit_share"), F.round(C.char_share(t, "[一-鿿]"), 6).alias("cjk_share"), F.size(C.tokens(t)).alias("n_tokens")
    )


def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_blocks").where("evidence_type = 'heading'").select("evidence_id", C.item_text(F.col("text")).alias("label"), C.heading_level(F.col("text")).alias("level")).distinct()


QUERIES = {
    f.__name__: f
    for f in (term_statistics, bm25_search, dense_search, dense_guarded, rrf_fusion, hybrid_status, priority_boost, multi_query_merge, bounded_neighbours, section_references, keyword_signals, route_classifier, outline_navigation, read_plan, index_freshness, text_measures, item_labels)
}

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")


def _tokens(text: str) -> str:
    runs = f"regexp_extract_all(lower(translate(coalesce({text}, ''), '{_FULL}', '{_HALF}')), '{C.TOKEN}')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[一-鿿]{{2}}') THEN list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) ELSE [r] END))"


def _bm25_cte(name: str, field: str, k: int = 20) -> str:
    return f"""
q_{name} AS (SELECT case_id, term, count(*) AS qtf FROM (SELECT case_id, unnest({_tokens(field)}) AS term FROM retrieval_eval_case WHERE question IS NOT NULL) GROUP BY ALL),
w_{name} AS (SELECT q.case_id, q.term, q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) AS w, s.avgdl FROM q_{name} q JOIN df d USING (term), stats s),
s_{name} AS (SELECT w.case_id, p.doc_id, sum(w.w * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / w.avgdl))) AS raw FROM w_{name} w JOIN post p USING (term) GROUP BY ALL),
r_{name} AS (SELECT case_id, doc_id, round(raw, 6) AS score, row_number() OVER (PARTITION BY case_id ORDER BY round(raw, 10) DESC, doc_id) AS rank FROM s_{name} QUALIFY rank <= {k})"""


_POST = f"""tok AS (SELECT doc_id, {_tokens('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(length(t)) AS avgdl FROM tok),
post AS (SELECT doc_id, length(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM tok) GROUP BY doc_id, length(t), term),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY term)"""
_BM25 = f"WITH {_POST}, {_bm25_cte('a', 'question')}"
_FUSED = f"""WITH {_POST}, {_bm25_cte('a', 'question')}, {_bm25_cte('b', 'notes')},
ch AS (SELECT case_id, doc_id, rank, 'question' AS channel FROM r_a UNION ALL SELECT case_id, doc_id, rank, 'notes' FROM r_b),
fused AS (SELECT case_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS raw, string_agg(channel, '+' ORDER BY channel) AS channels FROM ch GROUP BY case_id, doc_id),
top AS (SELECT case_id, doc_id, round(raw, 8) AS score, row_number() OVER (PARTITION BY case_id ORDER BY round(raw, 10) DESC, doc_id) AS rank, channels FROM fused QUALIFY rank <= 10)"""
_NEAR = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 10) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
t AS (SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s QUALIFY rank <= 10)"""
_BLOCKS = "b AS (SELECT DISTINCT ON (evidence_id) * FROM evidence_blocks)"

SQL = {
    "term_statistics": f"WITH {_POST} SELECT term, df, cf FROM df",
    "bm25_search": f"{_BM25} SELECT case_id, doc_id, score, rank FROM r_a",
    "dense_search": f"{_NEAR} SELECT query_id, vec_id, score, rank FROM t",
    "dense_guarded": f"{_NEAR} SELECT query_id, vec_id, score, rank FROM t WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)",
    "rrf_fusion": f"{_FUSED} SELECT case_id, doc_id, score, rank, channels FROM top",
    "hybrid_status": f"{_FUSED} SELECT case_id, coalesce(hits, 0) AS hits, CASE WHEN notes IS NULL THEN 'PARTIAL' WHEN coalesce(hits, 0) = 0 THEN 'EMPTY' ELSE 'COMPLETED' END AS status FROM (SELECT case_id, notes FROM retrieval_eval_case WHERE question IS NOT NULL) LEFT JOIN (SELECT case_id, count(*) AS hits FROM top GROUP BY 1) USING (case_id)",
    "priority_boost": f"{_BM25}, x AS (SELECT case_id, doc_id, round(score * CASE source WHEN 'debt_circular' THEN 1.25 WHEN 'annual_report' THEN 1.05 WHEN 'rating_comment' THEN 0.95 ELSE 1.0 END::DOUBLE, 8) AS score FROM r_a JOIN (SELECT doc_id, source FROM documents) USING (doc_id)) SELECT case_id, doc_id, score, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 5",
    "multi_query_merge": f"{_BM25}, f AS (SELECT DISTINCT ON (doc_id) doc_id, case_id AS query_order, rank FROM r_a ORDER BY doc_id, case_id, rank) SELECT doc_id, query_order, rank FROM f ORDER BY query_order, rank, doc_id LIMIT 30",
    "bounded_neighbours": f"""WITH {_BLOCKS}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id) AS place FROM b WHERE evidence_type IN ('paragraph', 'table'))
SELECT a.evidence_id AS anchor_id, p.evidence_id, p.place - a.place AS "offset" FROM p JOIN p a ON a.document_id = p.document_id AND a.document_version = p.document_version AND a.evidence_type = 'table' AND a.evidence_id <> p.evidence_id AND p.place - a.place BETWEEN -2 AND 2""",
    "section_references": f"""WITH {_BLOCKS}, refs AS (SELECT document_id || '|' || title AS ref_id, document_id, title, nullif(regexp_extract(title, '{NUMBERED}', 1), '') AS number FROM (SELECT DISTINCT document_id FROM evidence_blocks), section_titles WHERE title IS NOT NULL),
h AS (SELECT ref_id, CASE WHEN starts_with(text, number) OR len(list_filter(section_path, lambda p: contains(p, title) OR coalesce(starts_with(p, number), false))) > 0 THEN evidence_id END AS hit FROM refs LEFT JOIN b USING (document_id))
SELECT ref_id, count(hit) AS hits, min(hit) AS evidence_id, CASE WHEN count(hit) = 0 THEN 'dangling' WHEN count(hit) = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome FROM h GROUP BY ref_id""",
    "keyword_signals": "SELECT doc_id, coalesce(contains(text, '债') OR contains(text, '贷款') OR contains(text, '借款'), false) AS debt, coalesce(contains(text, '现金'), false) AS cash, coalesce(contains(text, '增长') OR contains(text, '增幅'), false) AS growth FROM documents",
    "route_classifier": "SELECT case_id, CASE WHEN priority IS NULL THEN 'audit' WHEN y = '' THEN 'unparseable_time' WHEN contains(question, '如何') THEN 'deep' WHEN length(question) < 12 THEN 'direct' ELSE 'standard' END AS route, nullif(y, '') AS year FROM (SELECT *, regexp_extract(question, '([12][0-9]{3})年', 1) AS y FROM retrieval_eval_case WHERE question IS NOT NULL)",
    "outline_navigation": f"""WITH {_BLOCKS}, n AS (SELECT evidence_id AS node_id, text AS title, array_to_string(section_path, '/') AS path FROM b WHERE evidence_type = 'heading'), t AS (SELECT title_id, trim(regexp_replace(title, '{NUMBERED}', '')) AS term FROM section_titles),
s AS (SELECT title_id AS question_id, node_id, round(CASE WHEN contains(n.title, term) THEN 3.0 ELSE 0.0 END::DOUBLE + CASE WHEN contains(path, term) THEN 1.0 ELSE 0.0 END::DOUBLE, 6) AS score FROM n JOIN t ON term <> '' AND (contains(n.title, term) OR contains(path, term)))
SELECT question_id, node_id, score FROM s QUALIFY score >= max(score) OVER (PARTITION BY question_id) - 0.5""",
    "read_plan": f"""WITH {_BLOCKS}, n AS (SELECT document_id, evidence_id AS node_id, length(text) AS c, {' + '.join(f'''coalesce(contains(text, '{w}'), false)::INT''' for terms in TERMS.values() for w in terms)} AS hits, page_number * 1000 + block_index AS place FROM b),
t AS (SELECT *, CASE WHEN c >= 400 THEN 0 WHEN c >= 80 THEN 1 ELSE 2 END AS tier FROM n)
SELECT document_id, node_id, tier, row_number() OVER (PARTITION BY document_id ORDER BY tier, c DESC NULLS LAST, hits DESC, place, node_id) AS read_rank FROM t""",
    "index_freshness": "SELECT document_id, count(*) AS members, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM (SELECT DISTINCT document_id, concat_ws(':', evidence_id, content_hash) AS line FROM evidence_blocks WHERE document_id IS NOT NULL) GROUP BY 1",
    "text_measures": f"SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded_chars, round((length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / nullif(length(text), 0), 6) AS digit_share, round((length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / nullif(length(text), 0), 6) AS cjk_share, length({_tokens('text')}) AS n_tokens FROM documents",
}
