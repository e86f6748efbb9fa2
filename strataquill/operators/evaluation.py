"""Retrieval quality and run figures: hits at k, reciprocal rank, slices, splits, percentiles, gates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def case_scores(ranked: DataFrame, gold: DataFrame, case: str, target: Sequence[str], ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """(case, k, hit, all_hit, coverage, precision, rr10) of every case with gold targets, retrieved or not.

    ``ranked`` has case, target columns and rank; ``gold`` has case and target columns. A target counts once.
    """
    gold = gold.select(case, *target).distinct()
    wanted = gold.groupBy(case).agg(F.count("*").alias("wanted"))
    found = gold.join(ranked.groupBy(case, *target).agg(F.min("rank").alias("rank")), [case, *target])
    places = ranked.groupBy(case).agg(*(F.count_if(F.col("rank") <= k).alias(f"n{k}") for k in ks))
    hits = found.groupBy(case).agg(*(F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks), F.min("rank").alias("first"))
    joined = wanted.join(hits, case, "left").join(places, case, "left")
    rr = F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)
    rows = F.array(*(F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("h"), F.coalesce(f"n{k}", F.lit(0)).alias("n")) for k in ks))
    out = joined.select(case, "wanted", rr.alias("rr10"), F.explode(rows).alias("x"))
    return out.select(case, "x.k", (F.col("x.h") > 0).cast("int").alias("hit"), (F.col("x.h") == F.col("wanted")).cast("int").alias("all_hit"), F.round(F.col("x.h") / F.col("wanted"), 6).alias("coverage"), F.round(F.coalesce(F.try_divide(F.col("x.h"), F.col("x.n")), F.lit(0.0)), 6).alias("precision"), F.round("rr10", 6).alias("rr10"))


def macro_means(scores: DataFrame, slices: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unweighted means over cases in total and by each slice alone, by grouping sets; a slice that is not grouped by reads 'all'."""
    listed = ", ".join(f"({s}, k)" for s in slices)
    view = scores.select("k", *slices, *metrics)
    means = ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics)
    names = ", ".join(f"if(grouping({s}) = 1, 'all', {s}) as {s}" for s in slices)
    return view.sparkSession.sql(f"select {names}, k, count(*) as cases, {means} from {{view}} group by grouping sets ((k), {listed})", view=view)


def recall_status(hit: Column, wanted: Column) -> Column:
    """zero, partial or full."""
    return F.when(hit == 0, "zero").when(hit < wanted, "partial").otherwise("full")


def adjacent_hits(ranked: DataFrame, gold: DataFrame, case: str, near: int = 1) -> DataFrame:
    """Cases with a hit within ``near`` pages of a gold page of the same file."""
    g = gold.select(case, "document_id", F.col("page_number").alias("gold_page")).distinct()
    return ranked.join(g, [case, "document_id"]).where(F.abs(F.col("page_number") - F.col("gold_page")) <= near).groupBy(case).agg(F.min("rank").alias("first_rank"))


def first_failure(flags: Sequence[tuple[str, Column]]) -> Column:
    """The first reason, in order of priority, whose condition holds; null if none does."""
    chain = None
    for name, condition in flags:
        chain = F.when(condition, F.lit(name)) if chain is None else chain.when(condition, F.lit(name))
    return chain


def stratified(cases: DataFrame, strata: Sequence[str], key: str, total: int) -> DataFrame:
    """``total`` cases shared out over strata by largest remainder, in each those of the least hash of their key."""
    sizes = cases.groupBy(*strata).agg(F.count("*").alias("size"))
    whole = sizes.agg(F.sum("size").alias("all_cases"))
    quota = sizes.crossJoin(F.broadcast(whole)).withColumn("quota", F.col("size") * total / F.col("all_cases")).withColumn("base", F.floor("quota"))
    # The number of strata is that of the design, a handful, so one ordered pass over them is small.
    left = quota.withColumn("spare", total - F.sum("base").over(W.partitionBy()))
    place = F.row_number().over(W.partitionBy().orderBy((F.col("quota") - F.col("base")).desc(), F.md5(F.concat_ws("|", *strata))))
    seats = left.withColumn("seats", F.col("base") + F.when(place <= F.col("spare"), 1).otherwise(0)).select(*strata, "seats")
    order = F.row_number().over(W.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key))
    return cases.withColumn("place", order).join(F.broadcast(seats), list(strata)).where("place <= seats").select(*cases.columns)


#: Groups of fewer values are ranked whole; of larger ones only the values near the wanted rank.
SMALL, NEAR = 10_000, 0.001


def percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """(keys, n, p<P>_linear, p<P>_nearest): linear-interpolated and nearest-rank percentiles per group, exactly.

    A sketch with a rank error of a ten-thousandth of the group gives bounds around each percentile; values below them are
    counted, and only the distinct values between them, a five-hundredth of a large group, are ranked. Null values do
    not count; a group without any value has null percentiles.
    """
    wanted = [w for p in ps for w in (max(0.0, p - NEAR), min(1.0, p + NEAR))]
    bounds = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(value, F.array(*map(F.lit, wanted)), 10_000).alias("__b"))
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.get("__b", F.lit(2 * i)).alias("lo"), F.get("__b", F.lit(2 * i + 1)).alias("hi"), ((F.col("n") - 1) * p).alias("at"), (F.ceil(F.round(F.col("n") * p, 9)) - 1).alias("near")) for i, p in enumerate(ps)))
    asked = bounds.select(*keys, "n", F.explode(each).alias("x")).select(*keys, "n", "x.*")
    on = None
    for k in keys:
        same = F.col(f"v.{k}").eqNullSafe(F.col(f"a.{k}"))
        on = same if on is None else on & same
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    met = counted.alias("v").join(F.broadcast(asked.alias("a")) if not keys else asked.alias("a"), F.lit(True) if on is None else on).select(*(F.col(f"a.{k}").alias(k) for k in keys), "i", "n", "at", "near", "v", "c", ((F.col("n") < SMALL) | F.col("v").between(F.col("lo"), F.col("hi"))).alias("__in"), (F.col("v") < F.col("lo")).alias("__below"))
    below = met.groupBy(*keys, "i").agg(F.coalesce(F.sum(F.when(F.col("__below") & ~F.col("__in"), F.col("c"))), F.lit(0)).alias("below"))
    same = None
    for k in [*keys, "i"]:
        equal = F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = equal if same is None else same & equal
    ranked = met.where("__in").alias("m").join(below.alias("b"), same).select("m.*", "below")
    upto = F.col("below") + F.sum("c").over(W.partitionBy(*keys, "i").orderBy("v"))
    placed = ranked.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("c"))
    holds = lambda rank: (F.col("__from") <= rank) & (rank < F.col("__to"))
    pick = lambda rank: F.max(F.when(holds(rank), F.col("v")))
    low, high, part = pick(F.floor("at")), pick(F.ceil("at")), F.max("at") - F.floor(F.max("at"))
    found = placed.groupBy(*keys, "i").agg((low + (high - low) * part).alias("linear"), pick(F.greatest("near", F.lit(0))).alias("nearest"))
    at = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    names = [f"p{round(p * 100)}" for p in ps]
    wide = found.groupBy(*keys).agg(*(at(i, c).alias(f"{name}_{c}") for i, name in enumerate(names) for c in ("linear", "nearest")))
    both = None
    for k in keys:
        equal = F.col(f"n.{k}").eqNullSafe(F.col(f"w.{k}"))
        both = equal if both is None else both & equal
    joined = bounds.alias("n").join(wide.alias("w"), F.lit(True) if both is None else both, "left")
    return joined.select(*(F.col(f"n.{k}").alias(k) for k in keys), "n", *(f"{name}_{c}" for name in names for c in ("linear", "nearest")))


def latency_gate(runs: DataFrame, value: str, channel: str, slow: str, fast: str, ratio: float = 2.0) -> DataFrame:
    """One row: the 95th nearest-rank percentiles of two channels, their ratio, and whether it is within the gate."""
    each = percentiles(runs.where(F.col(channel).isin(slow, fast)), [channel], value, [0.95])
    at = lambda name: F.max(F.when(F.col(channel) == name, F.col("p95_nearest")))
    row = each.agg(at(slow).alias("slow_p95"), at(fast).alias("fast_p95"))
    return row.withColumn("ratio", F.round(F.try_divide("slow_p95", "fast_p95"), 6)).withColumn("passed", F.coalesce(F.col("slow_p95") <= ratio * F.col("fast_p95"), F.lit(False)))


_SPEC = re.compile(r"P\s*(\d+)\s*(?:[-–—~至]\s*(\d+))?")


def page_targets(spec: str | None, aliases: Mapping[str, str], outside: Sequence[str] = ("外部", "网页", "http")) -> tuple[list[tuple[str, int | None]], bool, list[str]]:
    """((document, page) of a gold page field, whether it also names something outside, clauses that cannot be read).

    Clauses are parted by / or + outside brackets; one without a document goes on with the one before it. A range such as
    P3-5 gives each of its pages; a document without a page gives None. Each target is given once, in order.
    """
    clauses, depth, part = [], 0, ""
    for c in spec or "":
        depth = depth + 1 if c in "（(" else max(0, depth - 1) if c in "）)" else depth
        if depth == 0 and c in "/+":
            clauses.append(part)
            part = ""
        else:
            part += c
    targets, unread, external, document = [], [], False, None
    for clause in filter(None, (c.strip() for c in [*clauses, part])):
        if clause.startswith(tuple(outside)):
            external = True
            continue
        alias = next((a for a in sorted(aliases, key=len, reverse=True) if clause.startswith(a)), None)
        document = aliases[alias] if alias else document
        if document is None:
            unread.append(clause)
            continue
        hit = _SPEC.search(clause)
        if not hit:
            targets.append((document, None))
            unread.append(clause)
            continue
        first, last = sorted((int(hit.group(1)), int(hit.group(2) or hit.group(1))))
        targets.extend((document, p) for p in range(first, last + 1))
    return list(dict.fromkeys(targets)), external, unread


def eligibility(targets: DataFrame, documents: DataFrame, case: str, indexed: DataFrame | None = None) -> DataFrame:
    """(case, eligibility) of evaluation cases by their gold targets.

    ``targets`` has case, channel (local, external, structured_db), document_id, page; ``documents`` has document_id and
    page_count. Without local targets: NON_LOCAL_MIXED, EXTERNAL_ONLY, STRUCTURED_DB_ONLY or INVALID_GOLD_MAPPING. With
    them: INVALID_GOLD_MAPPING for an unknown document or a page that is missing or out of range,
    MISSING_CORPUS_DOCUMENT for one that is not indexed, else ELIGIBLE_LOCAL.
    """
    known = documents.groupBy("document_id").agg(F.max("page_count").alias("__pages"))
    held = documents.select("document_id") if indexed is None else indexed.select("document_id")
    joined = targets.join(known, "document_id", "left").join(held.distinct().withColumn("__in", F.lit(True)), "document_id", "left")
    local = F.col("channel") == "local"
    bad = local & (F.col("__pages").isNull() | F.col("page").isNull() | ~F.coalesce(F.col("page").between(1, F.col("__pages")), F.lit(False)))
    seen = joined.groupBy(case).agg(*(F.coalesce(F.bool_or(x), F.lit(False)).alias(n) for n, x in (("l", local), ("e", F.col("channel") == "external"), ("d", F.col("channel") == "structured_db"), ("b", bad), ("m", local & F.col("__in").isNull()))))
    verdict = F.when(F.col("l"), F.when(F.col("b"), "INVALID_GOLD_MAPPING").when(F.col("m"), "MISSING_CORPUS_DOCUMENT").otherwise("ELIGIBLE_LOCAL"))
    verdict = verdict.when(F.col("e") & F.col("d"), "NON_LOCAL_MIXED").when(F.col("e"), "EXTERNAL_ONLY").when(F.col("d"), "STRUCTURED_DB_ONLY").otherwise("INVALID_GOLD_MAPPING")
    return seen.select(case, verdict.alias("eligibility"))
