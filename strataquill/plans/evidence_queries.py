"""Queries over versions, events, evaluation cases, intervals, document structure and quoted figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions import columns as C
from strataquill.operators import evaluation as E
from strataquill.operators import intervals as I
from strataquill.operators import structure as S
from strataquill.operators import verify as V
from strataquill.operators import versions as X
from strataquill.plans import retrieval_queries
from strataquill.plans.retrieval_queries import bm25_search
from strataquill.session import table
from strataquill.streaming import validity

RANKS = {"view": 0, "click": 1, "purchase": 2, "error": 3}
DOC = ["document_id", "document_version"]


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document_versions")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_blocks").dropDuplicates(["evidence_id"])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


# Versions -----------------------------------------------------------------------------------------------------------


def latest_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.latest(_events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id")


def validity_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.transitions(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts"), ["user_id"], "event_type", RANKS, "ts", "event_id")
    return out.groupBy("event_type", "verdict").agg(F.count("*").alias("n"))


def current_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    switches = _versions(spark, sf_dir).where("status = 'current'")
    return X.current_pointers(switches, ["company_id", "document_id"], "document_version", "created_at")


def current_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents that are current, in their current version."""
    now = current_pointer(spark, sf_dir).select("company_id", "document_id", "document_version")
    return _blocks(spark, sf_dir).join(now, ["company_id", *DOC]).groupBy("company_id", *DOC).agg(F.count("*").alias("blocks"), F.max("page_number").alias("last_page"))


def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.content_versions(_versions(spark, sf_dir).where("source_name is not null"), "source_name", "file_sha256", "created_at")


def commit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What committing all delivered versions does where those of annual reports are stored already, as they came first."""
    rows = _versions(spark, sf_dir).select("document_id", "document_version", "file_sha256", "status", "source_type", "created_at").distinct()
    first = rows.where("source_type = 'annual_report'").groupBy("document_id", "document_version").agg(F.min(F.struct("created_at", "file_sha256", "status")).alias("x")).select("document_id", "document_version", "x.file_sha256", "x.status")
    incoming = rows.select("document_id", "document_version", "file_sha256").distinct()
    return X.plan_commits(incoming, first, ["document_id", "document_version"], "file_sha256", "status").groupBy("commit_path").agg(F.count("*").alias("n"))


def new_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that no superseded version has had before."""
    v = _versions(spark, sf_dir)
    return X.new_only(v.select("file_sha256", "document_id", "document_version"), v.where("status = 'superseded'"), "file_sha256")


def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _versions(spark, sf_dir).select("document_id").distinct()
    return X.delete_guard(docs, _blocks(spark, sf_dir).where("evidence_type = 'table'").select("document_id"), "document_id")


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of versions against the versions that have blocks: missing, extra and repeated ones."""
    keys = ["document_id", "document_version"]
    return X.set_difference(_blocks(spark, sf_dir).select(*keys).distinct(), _versions(spark, sf_dir).select(*keys), keys)


def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _versions(spark, sf_dir).select("company_id", "source_type", "document_version", "created_at", "status").distinct()
    once = X.latest(v, ["company_id", "source_type", "document_version"], "created_at", "status")
    return X.ordered_sources(once, ["company_id", "source_type"], "created_at", F.col("status") == "current").select("company_id", "source_type", "document_version", "role")


def version_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with the number of their blocks, those without kept."""
    counts = _blocks(spark, sf_dir).groupBy("company_id", *DOC).agg(F.count("*").alias("n"))
    v = _versions(spark, sf_dir).select("company_id", *DOC).distinct()
    return v.join(counts, ["company_id", *DOC], "left").select("company_id", *DOC, F.coalesce("n", F.lit(0)).alias("blocks"))


def strict_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deliveries of report figures put into a store that holds the first delivery of each annual and interim one."""
    rows = table(spark, sf_dir, "report_meta").select("id", "imported_at", "amount", "amount_unit", "report_type")
    stored = rows.where("report_type in ('annual', 'interim')").groupBy("id").agg(F.min(F.struct("imported_at", "amount", "amount_unit")).alias("x")).select("id", "x.amount", "x.amount_unit")
    incoming = rows.select("id", "amount", "amount_unit").distinct()
    return X.strict_insert(incoming, stored, ["id"], ["amount", "amount_unit"]).groupBy("outcome").agg(F.count("*").alias("n"))


def name_match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).select("company_id", *DOC, C.name_match(F.col("declared_company_name"), F.col("detected_company_names")).alias("match_status")).distinct()


def event_json_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors whose properties give a key above 50."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return _events(spark, sf_dir).where((F.col("event_type") == "error") & (k > 50)).select("event_id", k.alias("k"))


def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.windowed_counts(_events(spark, sf_dir), "ts", "event_type")


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows, by a stream over the file."""
    stream = validity.windowed_counts(validity.event_stream(spark, sf_dir, "events.parquet"), "ts", "event_type", late="3650 days")
    return validity.run_to_end(stream, "streamed_events", "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# Evaluation ---------------------------------------------------------------------------------------------------------


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the gold passage of a case word for word; the cases are a fixed table of 160 rows."""
    cases = table(spark, sf_dir, "retrieval_eval_case").where("length(gold_passage) > 0").select("case_id", "gold_passage")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(cases), F.col("text").contains(F.col("gold_passage"))).select("case_id", "doc_id")


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the search by question against the documents with the gold passage."""
    return E.case_scores(bm25_search(spark, sf_dir), _gold(spark, sf_dir), "case_id", ["doc_id"])


def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of these scores over cases, in total, by section and by priority."""
    kinds = table(spark, sf_dir, "retrieval_eval_case").select("case_id", "section_id", F.coalesce("priority", F.lit("none")).alias("priority"))
    return E.macro_means(retrieval_scores(spark, sf_dir).join(kinds, "case_id"), ["section_id", "priority"], ["hit", "coverage", "rr10"])


def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "question_outcome")
    reason = E.first_failure([("budget", F.col("stop_reason") == "budget"), ("blocked", F.col("status") == "BLOCKED"), ("failed", F.col("status") == "FAILED"), ("no_answer", F.col("success") == 0)])
    return o.select("run_id", "question_id", reason.alias("failure")).distinct().groupBy("failure").agg(F.count("*").alias("n"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "retrieval_eval_case").select("case_id", "section_id")
    return E.stratified(cases, ["section_id"], "case_id", 40)


def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.percentiles(_events(spark, sf_dir), ["event_type"], "value", [0.5, 0.95])


def latency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.latency_gate(_events(spark, sf_dir), "value", "event_type", "error", "click")


def run_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "question_outcome").select("run_id", "question_id", "status", "success").distinct()
    return o.groupBy("run_id").agg(F.count_distinct("question_id").alias("questions"), F.count_if(F.col("success") == 1).alias("succeeded"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"))


# Intervals ----------------------------------------------------------------------------------------------------------


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stretches of lines by quantity, and the number range of their orders."""
    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(200)).alias("g"), F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint")).alias("hi"))
    bounds = table(spark, sf_dir, "orders").agg((F.max("o_orderkey") + 60).alias("size"))
    return lines, lines.select("g").distinct().crossJoin(F.broadcast(bounds))


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.merge(_spans(spark, sf_dir)[0], ["g"])


def interval_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.complement(*_spans(spark, sf_dir), ["g"])


def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, _ = _spans(spark, sf_dir)
    return I.intersect(lines.where("g < 100"), lines.where("g >= 100").withColumn("g", F.col("g") - 100), ["g"]).groupBy("g").agg(F.count("*").alias("pieces"), F.sum(F.col("hi") - F.col("lo")).alias("covered"))


def interval_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.partition_problems(*_spans(spark, sf_dir), ["g"]).groupBy("g", "problem").agg(F.count("*").alias("n"))


# Structure ----------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as pages: the section path on top, as page layout repeats it."""
    return _blocks(spark, sf_dir).where("text is not null").select("document_id", F.col("evidence_id").alias("page"), F.concat_ws("\n", F.array_join("section_path", " "), "text").alias("text"))


def furniture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.furniture(_pages(spark, sf_dir), "document_id", "page", "text", 0.1)


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.carried_sections(_blocks(spark, sf_dir).where("evidence_type in ('heading', 'paragraph')"), DOC, ["page_number", "block_index", "evidence_id"], F.when(F.col("evidence_type") == "heading", F.col("text")))
    return out.select("evidence_id", "section", "section_level")


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.chunks(F.col("text"), 400, 50)).alias("chunk_index", "chunk")).select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _blocks(spark, sf_dir).where("evidence_type = 'table'")
    return S.table_runs(tables, DOC, "page_number", F.get_json_object("structured_payload", "$.unit")).groupBy(*DOC, "run").agg(F.count("*").alias("tables"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"))


def synopsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).where("evidence_type = 'paragraph'").select("evidence_id", S.snippet(F.col("text")).alias("snippet"))


def source_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each cited passage of an evaluation case is found in its question."""
    rows = table(spark, sf_dir, "retrieval_eval_case")
    return rows.select("case_id", F.round(S.match_coverage("question", "gold_passage"), 6).alias("coverage"), S.common_substring_length("question", "gold_passage").alias("longest"))


# Quoted figures -----------------------------------------------------------------------------------------------------


def amount_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.amounts(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def value_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of each document's first paragraph that stand in the rest of the same document as well; other documents are not searched."""
    docs = table(spark, sf_dir, "documents").where("company_id is not null")
    parts = F.split("text", "\n\n")
    claims = V.amounts(docs.select("doc_id", F.element_at(parts, 1).alias("head")), "doc_id", F.col("head"))
    rest = V.amounts(docs.select("doc_id", F.array_join(F.slice(parts, 2, F.size(parts)), "\n\n").alias("body")), "doc_id", F.col("body"))
    return V.presence(claims, "doc_id", rest, "doc_id")


def claim_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", V.claimed_direction(F.col("text")).alias("direction"))


def closed_set_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents that claim completeness, by verdict."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "[。！？\\n]")).alias("s"))
    return rows.select("doc_id", V.closed_set(F.col("s")).alias("verdict")).where("verdict != 'NOT_TRIGGERED'").groupBy("doc_id", "verdict").agg(F.count("*").alias("sentences"))


def scope_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", "\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", V.scope_risk(F.element_at(parts, 1), F.element_at(parts, -1)).alias("risk"))


QUERIES = {
    f.__name__: f
    for f in (latest_validity, validity_transitions, current_pointer, current_inventory, content_versions, commit_plan, new_content, delete_guard, set_difference, ordered_sources, version_left_join, strict_insert, name_match_status, event_json_audit, windowed_events, streamed_events, retrieval_scores, macro_metrics, failure_class, stratified_split, percentile_report, latency_gate, run_roll_up, interval_merge, interval_complement, interval_intersect, interval_partition_check, furniture_lines, section_carry_forward, paragraph_chunks, table_runs, synopsis, source_alignment, amount_extraction, value_presence, claim_direction, closed_set_guard, scope_risk)
}

_B = "b AS (SELECT DISTINCT ON (evidence_id) * FROM evidence_blocks)"
_RANK = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items())
_CUR = "cur AS (SELECT company_id, document_id, arg_max(document_version, struct_pack(a := created_at, b := document_version)) AS document_version, max(created_at) AS switched_at, count(*) AS switches FROM document_versions WHERE status = 'current' GROUP BY 1, 2)"
_SCORES = f"""{retrieval_queries._BM25}, gold AS (SELECT case_id, doc_id FROM documents JOIN retrieval_eval_case ON length(gold_passage) > 0 AND contains(text, gold_passage)), f AS (SELECT g.case_id, r.rank FROM gold g LEFT JOIN r_a r USING (case_id, doc_id)), ks(k) AS (VALUES (1), (5), (10)), w AS (SELECT case_id, count(*) AS wanted, min(rank) AS first FROM f GROUP BY 1),
sc AS (SELECT w.case_id, k, wanted, first, (SELECT count(*) FROM f WHERE f.case_id = w.case_id AND f.rank <= k) AS h, (SELECT count(*) FROM r_a r WHERE r.case_id = w.case_id AND r.rank <= k) AS n FROM w, ks),
scores AS (SELECT case_id, k, (h > 0)::INT AS hit, (h = wanted)::INT AS all_hit, round(h / wanted, 6) AS coverage, round(CASE WHEN n = 0 THEN 0 ELSE h / n END, 6) AS "precision", round(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END, 6) AS rr10 FROM sc)"""
_SPAN = "sp AS (SELECT l_partkey % 200 AS g, l_orderkey AS lo, l_orderkey + l_quantity::BIGINT AS hi FROM lineitem), bd AS (SELECT DISTINCT g, (SELECT max(o_orderkey) + 60 FROM orders) AS size FROM sp)"
_MERGE = "{1} AS (SELECT g, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0} WHERE lo < hi)) GROUP BY g, island)"
_WIDE = "translate({0}, '" + "".join(map(chr, range(0xFF01, 0xFF5F))) + "　', '" + "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + " ')"


def _amounts(text: str, where: str = "true") -> str:
    """Distinct amounts of a text expression per document."""
    shown = f"SELECT doc_id, unnest(list_distinct(regexp_extract_all({_WIDE.replace('{0}', text)}, '{V.AMOUNT}'))) AS shown FROM documents WHERE {where}"
    size = "CASE u WHEN '亿元' THEN 100000000 WHEN '百万元' THEN 1000000 WHEN '万元' THEN 10000 WHEN '千元' THEN 1000 ELSE 1 END::DECIMAL(10,0)"
    parts = f"SELECT *, regexp_extract(shown, '(亿元|百万元|万元|千元|元|%)$', 1) AS u, replace(regexp_extract(shown, '^(-?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '')::DECIMAL(24,4) AS n FROM ({shown})"
    return f"SELECT DISTINCT doc_id, CASE WHEN u = '%' THEN 'percent' ELSE 'money' END AS kind, (n * {size})::DECIMAL(34,4) AS value, shown FROM ({parts})"


_ANY = lambda ws: "(" + " OR ".join(f"contains(text, '{w}')" for w in ws) + ")"
_UP, _DOWN, _SAME = (_ANY(w) for w in (["增长", "上升", "增加", "提高", "rose", "increased"], ["下降", "减少", "降低", "下调", "降至", "fell", "declined"], ["持平", "不变", "unchanged"]))

_LEVEL = lambda c: f"CASE WHEN {c} IS NULL OR length(trim({c})) > 60 OR trim({c}) = '' OR regexp_matches(trim({c}), '[。；;]$') THEN NULL WHEN regexp_matches(trim({c}), '^第[一二三四五六七八九十百0-9]+[章节]') THEN 1 WHEN regexp_matches(trim({c}), '^[一二三四五六七八九十]+、') THEN 2 WHEN regexp_matches(trim({c}), '^[（(][一二三四五六七八九十]+[）)]') THEN 3 WHEN regexp_matches(trim({c}), '^[0-9]+(\\.[0-9]+)*[.、 ]\\s*[^0-9]') THEN 4 END"
_NAME = lambda c: f"lower(regexp_replace({_WIDE.replace('{0}', c)}, '[\\s.,，。()]+', '', 'g'))"
_HAS = lambda c, ws: "coalesce(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ", false)"

SQL = {
    "latest_validity": "SELECT user_id, max(ts) AS ts, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS event_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS event_type FROM events GROUP BY 1",
    "validity_transitions": f"WITH r AS (SELECT *, CASE event_type {_RANK} END AS rk FROM events), m AS (SELECT *, max(rk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS met FROM r) SELECT event_type, CASE WHEN rk IS NULL THEN 'unknown' WHEN met IS NULL THEN CASE WHEN rk = 0 THEN 'initial' ELSE 'bad_initial' END WHEN rk = met THEN 'repeat' WHEN rk > met THEN 'forward' ELSE 'backward' END AS verdict, count(*) AS n FROM m GROUP BY 1, 2",
    "current_pointer": f"WITH {_CUR} SELECT company_id, document_id, document_version, switched_at, switches FROM cur",
    "current_inventory": f"WITH {_B}, {_CUR} SELECT company_id, document_id, document_version, count(*) AS blocks, max(page_number) AS last_page FROM b JOIN cur USING (company_id, document_id, document_version) GROUP BY 1, 2, 3",
    "content_versions": "SELECT source_name, file_sha256, first_seen, last_seen, fetches, row_number() OVER (PARTITION BY source_name ORDER BY first_seen, file_sha256) AS content_version FROM (SELECT source_name, file_sha256, min(created_at) AS first_seen, max(created_at) AS last_seen, count(*) AS fetches FROM document_versions WHERE source_name IS NOT NULL GROUP BY 1, 2)",
    "commit_plan": "WITH s AS (SELECT document_id, document_version, min(struct_pack(c := created_at, d := file_sha256, s := status)) AS x FROM document_versions WHERE source_type = 'annual_report' GROUP BY 1, 2), v AS (SELECT DISTINCT document_id, document_version, file_sha256 FROM document_versions) SELECT CASE WHEN x IS NULL THEN 'fresh' WHEN x.d <> file_sha256 THEN 'conflict' WHEN x.s = 'current' THEN 'reuse' ELSE 'reactivate' END AS commit_path, count(*) AS n FROM v LEFT JOIN s USING (document_id, document_version) GROUP BY 1",
    "new_content": "SELECT file_sha256, min(struct_pack(a := document_id, b := document_version)).a AS document_id, min(struct_pack(a := document_id, b := document_version)).b AS document_version FROM document_versions WHERE file_sha256 IS NULL OR file_sha256 NOT IN (SELECT file_sha256 FROM document_versions WHERE file_sha256 IS NOT NULL AND status = 'superseded') GROUP BY 1",
    "delete_guard": f"WITH {_B} SELECT document_id, coalesce(n, 0) AS reference_count, coalesce(n, 0) = 0 AS deletable FROM (SELECT DISTINCT document_id FROM document_versions) LEFT JOIN (SELECT document_id, count(*) AS n FROM b WHERE evidence_type = 'table' GROUP BY 1) USING (document_id)",
    "set_difference": "WITH e AS (SELECT DISTINCT document_id, document_version FROM evidence_blocks), a AS (SELECT document_id, document_version, count(*) AS n FROM document_versions GROUP BY 1, 2) SELECT coalesce(e.document_id, a.document_id) AS document_id, coalesce(e.document_version, a.document_version) AS document_version, (e.document_id IS NOT NULL)::INT AS expected_count, coalesce(n, 0) AS actual_count, CASE WHEN n IS NULL THEN 'missing' WHEN e.document_id IS NULL THEN 'extra' ELSE 'duplicate' END AS state FROM e FULL JOIN a ON e.document_id = a.document_id AND e.document_version = a.document_version WHERE n IS NULL OR e.document_id IS NULL OR n > 1",
    "ordered_sources": """WITH v AS (SELECT company_id, source_type, document_version, max(struct_pack(a := created_at, b := status)) AS x FROM document_versions GROUP BY 1, 2, 3), w AS (SELECT company_id, source_type, document_version, x.a AS made, x.b AS status FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY company_id, source_type ORDER BY CASE WHEN status = 'current' THEN 0 ELSE 1 END, made DESC, document_version) AS k FROM w), a AS (SELECT company_id, source_type, made AS aat, document_version AS adv FROM n WHERE k = 1 AND status = 'current')
SELECT n.company_id, n.source_type, document_version, CASE WHEN adv IS NULL THEN 'topic' WHEN document_version = adv THEN 'current' WHEN made <= aat THEN 'history' ELSE 'topic' END AS role FROM n LEFT JOIN a ON n.company_id = a.company_id AND n.source_type = a.source_type""",
    "version_left_join": f"WITH {_B} SELECT v.company_id, v.document_id, v.document_version, count(b.evidence_id) AS blocks FROM (SELECT DISTINCT company_id, document_id, document_version FROM document_versions) v LEFT JOIN b ON v.company_id = b.company_id AND v.document_id = b.document_id AND v.document_version = b.document_version GROUP BY 1, 2, 3",
    "strict_insert": "WITH s AS (SELECT id, min(struct_pack(i := imported_at, a := amount, u := amount_unit)) AS x FROM report_meta WHERE report_type IN ('annual', 'interim') GROUP BY 1), i AS (SELECT DISTINCT id, amount, amount_unit FROM report_meta) SELECT CASE WHEN s.id IS NULL THEN 'insert' WHEN amount IS NOT DISTINCT FROM x.a AND amount_unit IS NOT DISTINCT FROM x.u THEN 'same' ELSE 'conflict' END AS outcome, count(*) AS n FROM i LEFT JOIN s USING (id) GROUP BY 1",
    "event_json_audit": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'error' AND try_cast(json_extract_string(props, '$.k') AS INT) > 50",
    "windowed_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,4)) AS total FROM events GROUP BY 1, 2",
    "streamed_events": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,4)) AS total FROM events GROUP BY 1, 2",
    "retrieval_scores": f'{_SCORES} SELECT case_id, k, hit, all_hit, coverage, "precision", rr10 FROM scores',
    "macro_metrics": f"{_SCORES}, kd AS (SELECT case_id, section_id, coalesce(priority, 'none') AS priority FROM retrieval_eval_case) SELECT CASE WHEN grouping(section_id) = 1 THEN 'all' ELSE section_id END AS section_id, CASE WHEN grouping(priority) = 1 THEN 'all' ELSE priority END AS priority, k, count(*) AS cases, round(avg(hit), 6) AS hit, round(avg(coverage), 6) AS coverage, round(avg(rr10), 6) AS rr10 FROM scores JOIN kd USING (case_id) GROUP BY GROUPING SETS ((k), (section_id, k), (priority, k))",
    "failure_class": "SELECT failure, count(*) AS n FROM (SELECT DISTINCT run_id, question_id, CASE WHEN stop_reason = 'budget' THEN 'budget' WHEN status = 'BLOCKED' THEN 'blocked' WHEN status = 'FAILED' THEN 'failed' WHEN success = 0 THEN 'no_answer' END AS failure FROM question_outcome) GROUP BY 1",
    "stratified_split": """WITH s AS (SELECT section_id, count(*) AS size FROM retrieval_eval_case GROUP BY 1), q AS (SELECT *, size * 40 / (SELECT count(*) FROM retrieval_eval_case) AS quota FROM s), b AS (SELECT *, floor(quota) AS base, 40 - sum(floor(quota)) OVER () AS spare FROM q),
t AS (SELECT section_id, base + CASE WHEN row_number() OVER (ORDER BY quota - base DESC, md5(section_id)) <= spare THEN 1 ELSE 0 END AS seats FROM b)
SELECT case_id, section_id FROM (SELECT case_id, section_id, row_number() OVER (PARTITION BY section_id ORDER BY md5(case_id), case_id) AS place FROM retrieval_eval_case) JOIN t USING (section_id) WHERE place <= seats""",
    "percentile_report": "SELECT event_type, count(value) AS n, quantile_cont(value, 0.5) AS p50_linear, quantile_disc(value, 0.5) AS p50_nearest, quantile_cont(value, 0.95) AS p95_linear, quantile_disc(value, 0.95) AS p95_nearest FROM events GROUP BY 1",
    "latency_gate": "SELECT s AS slow_p95, f AS fast_p95, round(s / f, 6) AS ratio, s <= 2.0 * f AS passed FROM (SELECT quantile_disc(value, 0.95) FILTER (event_type = 'error') AS s, quantile_disc(value, 0.95) FILTER (event_type = 'click') AS f FROM events)",
    "run_roll_up": "SELECT run_id, count(DISTINCT question_id) AS questions, count(*) FILTER (success = 1) AS succeeded, count(*) FILTER (status = 'BLOCKED') AS blocked FROM (SELECT DISTINCT run_id, question_id, status, success FROM question_outcome) GROUP BY 1",
    "interval_merge": f"WITH {_SPAN}, {_MERGE.format('sp', 'm')} SELECT g, lo, hi FROM m",
    "interval_complement": f"WITH {_SPAN}, {_MERGE.format('sp', 'm')}, e AS (SELECT m.g, greatest(lo, 0) AS lo, least(hi, size) AS hi FROM m JOIN bd ON m.g = bd.g UNION ALL SELECT g, size, size FROM bd), c AS (SELECT g, coalesce(max(hi) OVER (PARTITION BY g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, lo AS hi FROM e) SELECT g, lo, hi FROM c WHERE lo < hi",
    "interval_intersect": f"WITH {_SPAN}, a0 AS (SELECT * FROM sp WHERE g < 100), b0 AS (SELECT g - 100 AS g, lo, hi FROM sp WHERE g >= 100), {_MERGE.format('a0', 'a')}, {_MERGE.format('b0', 'bb')}, x AS (SELECT a.g, greatest(a.lo, bb.lo) AS lo, least(a.hi, bb.hi) AS hi FROM a JOIN bb ON a.g = bb.g AND a.lo < bb.hi AND bb.lo < a.hi), {_MERGE.format('x', 'y')} SELECT g, count(*) AS pieces, sum(hi - lo) AS covered FROM y GROUP BY 1",
    "interval_partition_check": f"""WITH {_SPAN}, r AS (SELECT sp.g, lo, hi, coalesce(max(hi) OVER (PARTITION BY sp.g ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM sp), p AS (SELECT g, CASE WHEN lo >= hi THEN 'empty' WHEN lo > reach THEN 'gap' WHEN lo < reach THEN 'overlap' END AS problem FROM r UNION ALL SELECT sp.g, 'bad_end' FROM sp JOIN bd ON sp.g = bd.g GROUP BY sp.g, size HAVING max(hi) <> size)
SELECT g, problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1, 2""",
    "synopsis": f"WITH {_B}, h AS (SELECT evidence_id, text, regexp_extract(text, '^((?s:.){{19,119}}[。！？.!?])', 1) AS head FROM b WHERE evidence_type = 'paragraph') SELECT evidence_id, CASE WHEN head <> '' THEN head WHEN length(text) BETWEEN 20 AND 120 THEN text END AS snippet FROM h",
    "table_runs": f"""WITH {_B}, t AS (SELECT document_id, document_version, page_number, block_index, evidence_id, CASE WHEN json_valid(structured_payload) THEN json_extract_string(structured_payload, '$.unit') END AS sig FROM b WHERE evidence_type = 'table'),
l AS (SELECT *, CASE WHEN page_number - lag(page_number) OVER w <= 1 AND sig = lag(sig) OVER w THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id ROWS UNBOUNDED PRECEDING) AS run FROM l) SELECT document_id, document_version, run, count(*) AS tables, min(page_number) AS first_page, max(page_number) AS last_page FROM r GROUP BY 1, 2, 3""",
    "amount_extraction": _amounts("text"),
    "value_presence": "WITH c AS (SELECT DISTINCT doc_id, kind, value FROM (" + _amounts("split_part(text, chr(10) || chr(10), 1)", "company_id IS NOT NULL") + ")), e AS (SELECT DISTINCT doc_id, kind, value FROM (" + _amounts("array_to_string(string_split(text, chr(10) || chr(10))[2:], chr(10) || chr(10))", "company_id IS NOT NULL") + ")) SELECT doc_id, count(*) AS figures, count(e.value) AS matched, CASE WHEN count(e.value) = count(*) THEN 'matched' WHEN count(e.value) > 0 THEN 'partial' ELSE 'missing' END AS verdict FROM c LEFT JOIN e USING (doc_id, kind, value) GROUP BY 1",
    "name_match_status": f"SELECT DISTINCT company_id, document_id, document_version, CASE WHEN declared_company_name IS NULL OR trim(declared_company_name) = '' OR detected_company_names IS NULL OR len(detected_company_names) = 0 THEN 'unverified' WHEN len(list_filter(detected_company_names, lambda d: {_NAME('d')} = {_NAME('declared_company_name')})) > 0 THEN 'matched' ELSE 'mismatch' END AS match_status FROM document_versions",
    "section_carry_forward": f"WITH {_B}, r AS (SELECT *, CASE WHEN evidence_type = 'heading' THEN {_LEVEL('text')} END AS lv FROM b WHERE evidence_type IN ('heading', 'paragraph')) SELECT evidence_id, last_value(CASE WHEN lv IS NOT NULL THEN trim(text)[1:50] END IGNORE NULLS) OVER w AS section, last_value(lv IGNORE NULLS) OVER w AS section_level FROM r WINDOW w AS (PARTITION BY document_id, document_version ORDER BY page_number, block_index, evidence_id ROWS UNBOUNDED PRECEDING)",
    "closed_set_guard": f"""WITH s AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[。！？\\n]')) AS s FROM documents), x AS (SELECT doc_id, regexp_extract(s, '{V.COUNTED}', 1) AS said, {_HAS('s', V.COMPLETE)} AS hit, {_HAS('s', V.HEDGES)} AS hedged, CASE WHEN contains(s, '、') THEN len(list_filter(string_split(regexp_replace(s, '[，,：:；;（）()]', '、、', 'g'), '、'), lambda p: length(trim(p)) > 0 AND length(trim(p)) <= 6)) ELSE 0 END AS listed FROM s),
y AS (SELECT *, CASE WHEN said = '' THEN NULL WHEN instr('一二三四五六七八九十', said) > 0 THEN instr('一二三四五六七八九十', said) ELSE try_cast(said AS INT) END AS claimed FROM x WHERE hit OR said <> '') SELECT doc_id, CASE WHEN hedged OR claimed IS NULL OR listed < claimed THEN 'PARTIAL' WHEN listed = claimed THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict, count(*) AS sentences FROM y GROUP BY 1, 2""",
    "scope_risk": f"SELECT doc_id, CASE WHEN {_HAS('p[1]', ('集团', '合并口径', '整体', '全年', 'the group', 'consolidated'))} AND {_HAS('p[-1]', ('子公司', '分公司', '母公司', '单季', 'subsidiary', 'quarter'))} THEN 'broad_claim_narrow_evidence' END AS risk FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents)",
    "claim_direction": f"SELECT doc_id, CASE WHEN {_UP}::INT + {_DOWN}::INT + {_SAME}::INT > 1 THEN 'mixed' WHEN {_UP} THEN 'increased' WHEN {_DOWN} THEN 'decreased' WHEN {_SAME} THEN 'unchanged' END AS direction FROM documents",
}
