"""Queries of the text-corpus problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.llm import leakage, mixing, neardup, residue, sentences, spans, splitting, textform
from strataquill.operators import evaluation
from strataquill.plans import retrieval_queries
from strataquill.session import table

#: Vocabulary file that tokens are counted by, unless ``strataquill.tokenizer`` is set in the session.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records longer than the limit, by way of their pieces."""
    return splitting.split_oversized(table(spark, sf_dir, "evidence_blocks"), ["evidence_id"], "text").select("evidence_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pieces of oversized blocks."""
    keys = ["evidence_id", "document_id", "page_number", "block_index"]
    blocks = table(spark, sf_dir, "evidence_blocks").where("length(text) > 1200").select(*keys, "text").dropDuplicates(["evidence_id"])
    return splitting.split_oversized(blocks, keys, "text")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_blocks").where("evidence_type = 'paragraph' and length(text) >= 150").select("evidence_id", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of paragraphs of similar content."""
    return neardup.similar_pairs(_paragraphs(spark, sf_dir), "evidence_id", "text")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, class and number of links of every paragraph."""
    return neardup.groups(*neardup.similar_classes(_paragraphs(spark, sf_dir), "evidence_id", "text"), "evidence_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of the sentences of every paragraph."""
    rows = table(spark, sf_dir, "evidence_blocks").where("evidence_type = 'paragraph'")
    return sentences.split_sentences(rows, ["evidence_id"], "text", with_text=False).select("evidence_id", "end_pos").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and the other documents that share a run of 120 or more characters with them."""
    return spans.shared_with(table(spark, sf_dir, "evidence_blocks"), "evidence_id", "document_id", "text")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every record lies in runs of 120 or more characters that a record of another document holds too."""
    out = spans.shared_shares(table(spark, sf_dir, "evidence_blocks"), "evidence_id", "document_id", "text")
    return out.select("evidence_id", "chars", "shared_chars", F.round("share", 9).alias("share"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and section titles that look the same as others but differ in their characters."""
    blocks = table(spark, sf_dir, "evidence_blocks")
    texts = textform.differing_twins(blocks, "evidence_id", "text").select(F.lit("text").alias("field"), "evidence_id")
    paths = textform.differing_titles(blocks, "evidence_id", "section_path", table(spark, sf_dir, "section_titles"), "title")
    return texts.unionByName(paths.select(F.lit("section_path").alias("field"), "evidence_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a held-out passage in runs of 40 or more characters."""
    hits = leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "retrieval_eval_case"), "case_id", "gold_passage")
    return hits.where("share >= 0.5").select("doc_id", "case_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and passage with a shared run, and the share of the passage it covers."""
    return leakage.leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "retrieval_eval_case"), "case_id", "gold_passage")


def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the search by question against the documents that hold the gold passage, for every case that has any.

    Only the first 10 ranks count in the scores, and the search gives more; a document beyond them is a miss.
    """
    return evaluation.case_scores(retrieval_queries.bm25_search(spark, sf_dir), p8_found(spark, sf_dir), "case_id", ["doc_id"])


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the search scores over cases, in total and by section."""
    sections = table(spark, sf_dir, "retrieval_eval_case").select("case_id", "section_id")
    return evaluation.macro_means(search_scores(spark, sf_dir).join(sections, "case_id"), ["section_id"], ["hit", "coverage", "rr10"])


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = spark.conf.get("strataquill.tokenizer", TOKENIZER)
    return mixing.mixture(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "source_mix"), path)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that miss their share though every document of theirs is used as often as allowed."""
    return _mixture(spark, sf_dir)[1].where("not reachable").select("source")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source in the mix that is used, in whole repeats."""
    used, report = _mixture(spark, sf_dir)
    sums = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"))
    total = sums.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = sums.crossJoin(F.broadcast(total)).select("source", "mixed_tokens", "most_repeats", (F.col("mixed_tokens") / F.col("all_tokens")).alias("mixed_share"))
    return report.join(shares, "source", "left")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its rate, and how often the mix uses it."""
    return _mixture(spark, sf_dir)[0]


def p9_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the posteriors of the texts alone tell the source, on all labelled documents outside the fit."""
    names = sorted(r.source for r in table(spark, sf_dir, "source_mix").select("source").where("source is not null").distinct().collect())
    return mixing.domain_quality(table(spark, sf_dir, "documents"), "doc_id", "text", "source", names)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are template residue."""
    return residue.find_residue(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


def p10_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the segment models and of the verdict on all texts of held-out companies."""
    return residue.validate(table(spark, sf_dir, "documents"), "doc_id", "text", "company_id")


def p10_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of wordings never seen in the fit are found."""
    return residue.validate_families(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p4_found": p4_found, "p4_shares": p4_shares, "p7_found": p7_found, "p8_found": p8_found, "p8_shares": p8_shares, "search_scores": search_scores, "search_metrics": search_metrics, "p9_found": p9_found, "p9_shares": p9_shares, "p9_mix": p9_mix, "p9_validation": p9_validation, "p10_found": p10_found, "p10_validation": p10_validation, "p10_families": p10_families}
_WIDE = "".join(map(chr, (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))))
_NARROW = "".join(map(chr, (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))))


def _looks(column: str) -> str:
    """The one form of a text in SQL, from the table of characters that look the same."""
    mapped = textform._tables()[0]
    single = sorted((chr(c), form) for c, form in mapped.items() if len(form) == 1 and form != "'")
    dropped = "".join(chr(c) for c, form in mapped.items() if form == "")
    return f"nfc_normalize(translate(translate({column}, '{''.join(a for a, _ in single)}', '{''.join(b for _, b in single)}'), '{dropped}', ''))"


SQL = {
    "p1_found": "SELECT DISTINCT evidence_id FROM evidence_blocks WHERE length(text) > 1200",
    "p2_found": """WITH p AS (SELECT DISTINCT evidence_id, regexp_replace(text, '\\s+', '', 'g') AS s FROM evidence_blocks WHERE evidence_type = 'paragraph' AND length(text) >= 150),
g AS (SELECT DISTINCT evidence_id, substr(s, i, 5) AS g FROM (SELECT evidence_id, s, unnest(range(1, length(s) - 3)) AS i FROM p)), n AS (SELECT evidence_id, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT a.evidence_id AS x, b.evidence_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.evidence_id < b.evidence_id GROUP BY 1, 2)
SELECT x AS evidence_id_a, y AS evidence_id_b FROM b JOIN n nx ON nx.evidence_id = x JOIN n ny ON ny.evidence_id = y WHERE c / (nx.n + ny.n - c) >= 0.7""",
    "p4_found": """WITH w AS (SELECT DISTINCT evidence_id, document_id, substr(text, i, 120) AS s FROM (SELECT evidence_id, document_id, text, unnest(range(1, length(text) - 118)) AS i FROM evidence_blocks WHERE length(text) >= 120))
SELECT DISTINCT a.evidence_id, b.document_id AS other_document_id FROM w a JOIN w b ON a.s = b.s AND a.document_id <> b.document_id""",
    "p4_shares": """WITH r AS (SELECT DISTINCT evidence_id, document_id, text FROM evidence_blocks WHERE text IS NOT NULL), w AS (SELECT evidence_id, document_id, text, i, substr(text, i, 120) AS s FROM (SELECT *, unnest(range(1, length(text) - 118)) AS i FROM r WHERE length(text) >= 120)),
m AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT document_id) > 1), h AS (SELECT evidence_id, text, i, lead(i) OVER (PARTITION BY evidence_id, document_id, text ORDER BY i) AS j FROM w WHERE s IN (SELECT s FROM m)), c AS (SELECT evidence_id, text, sum(least(120, coalesce(j - i, 120))) AS n FROM h GROUP BY 1, 2)
SELECT evidence_id, length(text) AS chars, coalesce(n, 0)::BIGINT AS shared_chars, round(coalesce(n / length(text), 0), 9) AS share FROM (SELECT DISTINCT evidence_id, text FROM r) LEFT JOIN c USING (evidence_id, text)""",
    "p7_found": f"""WITH t AS (SELECT DISTINCT evidence_id, text, {_looks('text')} AS f FROM evidence_blocks WHERE text IS NOT NULL), m AS (SELECT f FROM t GROUP BY f HAVING count(DISTINCT text) > 1),
s AS (SELECT DISTINCT evidence_id, e, {_looks('e')} AS f FROM (SELECT evidence_id, unnest(section_path) AS e FROM evidence_blocks))
SELECT 'text' AS field, evidence_id FROM t WHERE f IN (SELECT f FROM m) UNION SELECT 'section_path', evidence_id FROM s JOIN section_titles ON s.f = {_looks('title')} AND e <> title""",
    "p8_found": f"""WITH d AS (SELECT doc_id, regexp_replace(lower(translate(text, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS r FROM documents), c AS (SELECT case_id, regexp_replace(lower(translate(gold_passage, '{_WIDE}', '{_NARROW}')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS r FROM retrieval_eval_case),
cw AS (SELECT case_id, length(r) AS n, i, substr(r, i, 40) AS s FROM (SELECT case_id, r, unnest(range(1, length(r) - 38)) AS i FROM c WHERE length(r) >= 40)), dw AS (SELECT DISTINCT doc_id, substr(r, i, 40) AS s FROM (SELECT doc_id, r, unnest(range(1, length(r) - 38)) AS i FROM d WHERE length(r) >= 40)),
h AS (SELECT doc_id, case_id, n, i, lead(i) OVER (PARTITION BY doc_id, case_id ORDER BY i) AS j FROM cw JOIN dw USING (s))
SELECT doc_id, case_id FROM h GROUP BY doc_id, case_id, n HAVING sum(CASE WHEN j IS NULL THEN 40 ELSE least(40, j - i) END) >= 0.5 * n""",
}
_SEARCH = f"""{retrieval_queries._BM25}, gold AS ({SQL['p8_found']}), f AS (SELECT g.case_id, r.rank FROM gold g LEFT JOIN r_a r USING (case_id, doc_id)), ks(k) AS (VALUES (1), (5), (10)), w AS (SELECT case_id, count(*) AS wanted, min(rank) AS first FROM f GROUP BY 1),
sc AS (SELECT w.case_id, k, wanted, first, (SELECT count(*) FROM f WHERE f.case_id = w.case_id AND f.rank <= k) AS h, (SELECT count(*) FROM r_a r WHERE r.case_id = w.case_id AND r.rank <= k) AS n FROM w, ks),
scores AS (SELECT case_id, k, (h > 0)::INT AS hit, (h = wanted)::INT AS all_hit, round(h / wanted, 6) AS coverage, round(CASE WHEN n = 0 THEN 0 ELSE h / n END, 6) AS "precision", round(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END, 6) AS rr10 FROM sc)"""
SQL["search_scores"] = f'{_SEARCH} SELECT case_id, k, hit, all_hit, coverage, "precision", rr10 FROM scores'
SQL["search_metrics"] = f"{_SEARCH} SELECT CASE WHEN grouping(section_id) = 1 THEN 'all' ELSE section_id END AS section_id, k, count(*) AS cases, round(avg(hit), 6) AS hit, round(avg(coverage), 6) AS coverage, round(avg(rr10), 6) AS rr10 FROM scores JOIN (SELECT case_id, section_id FROM retrieval_eval_case) USING (case_id) GROUP BY GROUPING SETS ((k), (section_id, k))"
