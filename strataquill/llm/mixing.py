"""Sources mixed to target shares of the total size in tokens.

A classifier fitted on the labelled table gives every document its posteriors over the domains, and a label counts as
evidence that is right with a given probability; together they are the document's soft membership. Nonnegative rates
are then fitted by projected gradient steps of least squares so that the expected tokens of each domain meet its target.
Steps are projected lazily: the rate of a document is always its start plus the sum of all steps so far, cut to its
bounds, so that one number per domain is the whole state and each step is one aggregation.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquill.llm.arrays import chunks, code_points, hash_threshold, kgrams, mix, owners
from strataquill.session import written

BITS = 16
# Fixed value: the published pattern that splits text before the merges of byte-level rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def tokenizer(path: str):
    """A function from texts to token counts, by the kind of vocabulary file (.json, .tiktoken or .model)."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]


class Domains:
    """Softmax regression from hashed character 3-grams to domains, tempered towards the shares of the domains."""

    def __init__(self, names: Sequence[str], weights: np.ndarray, prior: np.ndarray, heat: float = 1.0) -> None:
        self.names, self.weights, self.prior, self.heat = list(names), weights, prior, heat

    @staticmethod
    def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, bucket) of every 3-gram, in the order of the texts."""
        codes, starts = code_points(texts)
        owner, hashed = owners(starts), kgrams(mix(codes), 3)
        inside = np.flatnonzero(owner[: len(hashed)] == owner[2:]) if len(hashed) else np.zeros(0, np.int64)
        return owner[inside], (hashed[inside] >> np.uint64(64 - BITS)).astype(np.int32)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], names: Sequence[str], rounds: int = 30, rate: float = 0.05, decay: float = 1e-5) -> Domains:
        """Weights from four fifths of the texts; the heat is the one that suits the last fifth best."""
        n, place = len(names), {name: i for i, name in enumerate(names)}
        truth = np.array([place[x] for x in labels], np.int64)
        prior = (np.bincount(truth, minlength=n) + 1.0) / (len(truth) + n)
        out = cls(names, np.zeros((1 << BITS, n), np.float32), prior)
        seen = len(texts) - len(texts) // 5
        owner, bucket = cls.grams(texts[:seen])
        cell, count = np.unique(owner.astype(np.int64) << BITS | bucket, return_counts=True)
        owner, (used, column) = cell >> BITS, np.unique(cell & ((1 << BITS) - 1), return_inverse=True)
        size = np.bincount(owner, weights=count, minlength=seen)
        value = (count / np.sqrt(np.maximum(size, 1))[owner]).astype(np.float32)
        goal = np.eye(n, dtype=np.float32)[truth[:seen]]
        weights = np.zeros((len(used), n), np.float32)
        first, second = np.zeros_like(weights), np.zeros_like(weights)
        for step in range(1, rounds + 1 if seen else 1):
            z = np.stack([np.bincount(owner, weights=weights[column, k] * value, minlength=seen) for k in range(n)], axis=1)
            slope = ((_softmax(z + np.log(prior)) - goal) / seen).astype(np.float32)
            grad = np.stack([np.bincount(column, weights=slope[owner, k] * value, minlength=len(used)) for k in range(n)], axis=1).astype(np.float32) + decay * weights
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
            weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        out.weights[used] = weights
        if seen < len(texts):
            z, held = out.scores(texts[seen:]), truth[seen:]
            loss = lambda heat: -np.log(_softmax(z / heat + np.log(prior))[np.arange(len(held)), held]).sum()
            out.heat = min((2.0**e for e in range(0, 13)), key=loss)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """The evidence of each text for each domain, apart from the prior."""
        out = np.zeros((len(texts), len(self.names)))
        owner, bucket = self.grams(texts)
        if len(owner):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(head, len(owner)))
            out[owner[head]] = np.add.reduceat(self.weights[bucket], head, axis=0) / np.sqrt(size)[:, None]
        return out

    def posterior(self, texts: list[str], labels: Sequence[str | None] = (), trust: float = 0.98) -> np.ndarray:
        """Membership of each text in each domain; a label of ours is right with probability ``trust``.

        A label already tells how common its domain is, so the prior counts for texts without one only.
        """
        evidence = self.scores(texts) / self.heat
        n, place = len(self.names), {name: i for i, name in enumerate(self.names)}
        at = np.array([place.get(x, -1) for x in labels] if labels else [-1] * len(texts), np.int64)
        told = np.full((len(texts), n), (1 - trust) / max(1, n - 1))
        told[np.flatnonzero(at >= 0), at[at >= 0]] = trust
        return _softmax(evidence + np.where((at >= 0)[:, None], np.log(np.maximum(told, 1e-300)), np.log(self.prior)))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_domains(docs: DataFrame, key: str, text_col: str, source_col: str, names: Sequence[str], pool: int = 2400, longest: int = 20_000) -> Domains:
    """The classifier, fitted on about ``pool`` labelled texts (but no more than half of them) of at most ``longest`` characters each, picked by a threshold on the hash of the key."""
    names = list(names)
    texts = _sampled(docs, key, text_col, source_col, names, pool, longest)[0].collect()
    texts.sort(key=lambda r: (r.h, r.t))
    return Domains.fit([r.t for r in texts], [r.s for r in texts], names)


def _sampled(docs: DataFrame, key: str, text_col: str, source_col: str, names: list[str], pool: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(texts the classifier is fitted on, all other labelled texts)"""
    rows = docs.select(F.xxhash64(F.lit(5), key).alias("h"), F.col(source_col).cast("string").alias("s"), F.col(text_col).alias("t"))
    known = rows.where(F.col("s").isin(names) & F.col("t").isNotNull())
    limit = hash_threshold(min(0.5, pool / max(1, docs.where(F.col(source_col).isin(names)).count())))
    chosen = (F.col("h") <= limit) & (F.length("t") <= longest)
    return known.where(chosen), known.where(~chosen)


def domain_quality(docs: DataFrame, key: str, text_col: str, source_col: str, names: Sequence[str], pool: int = 2400, longest: int = 20_000) -> DataFrame:
    """(source, texts, accuracy, log_loss, prior_log_loss) of the text posteriors on all labelled texts outside the fit.

    Where ``log_loss`` is not below ``prior_log_loss``, the texts do not tell the sources apart and labels decide.
    """
    names = list(names)
    shared = docs.sparkSession.sparkContext.broadcast(fit_domains(docs, key, text_col, source_col, names, pool, longest))
    held = _sampled(docs, key, text_col, source_col, names, pool, longest)[1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {n: i for i, n in enumerate(names)}
        for batch in batches:
            texts, labels = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                p, at = model.posterior(texts[lo:hi]), np.array([place[s] for s in labels[lo:hi]])
                rows = np.arange(hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(labels[lo:hi]), pa.array(p.argmax(1) == at), pa.array(-np.log(np.maximum(p[rows, at], 1e-300))), pa.array(-np.log(model.prior[at]))], names=["s", "hit", "a", "b"])

    scored = held.select("s", "t").mapInArrow(score, "s string, hit boolean, a double, b double")
    return scored.groupBy(F.col("s").alias("source")).agg(F.count("*").alias("texts"), F.avg(F.col("hit").cast("int")).alias("accuracy"), F.avg("a").alias("log_loss"), F.avg("b").alias("prior_log_loss"))


def measured(docs: DataFrame, key: str, text_col: str, source_col: str, names: Sequence[str], path: str, model: Domains | None = None, trust: float = 0.98, grain: int = 20) -> DataFrame:
    """(key, source, tokens, member) of every document, ``member`` being its share in each domain of ``names``.

    Shares are whole ``grain``-ths, rounded at random by the hash of the key so that expected sums stay exact; this
    bounds the number of different memberships (888,030 for 8 domains and twentieths) whatever the size of the corpus.
    One pass, no shuffle. Null texts have no tokens.
    """
    names = list(names)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_domains(docs, key, text_col, source_col, names))
    rows = docs.select(F.col(key).alias("k"), F.col(source_col).cast("string").alias("s"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), (F.pmod(F.xxhash64(F.lit(29), key), F.lit(1 << 30)) / float(1 << 30)).alias("u"))
    schema = T.StructType([T.StructField(key, rows.schema["k"].dataType), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("member", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = tokenizer(path), len(names)
        for batch in batches:
            sources, texts, tokens, parts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), [], [np.zeros((0, n))]
            for lo, hi in chunks(texts):
                tokens.extend(count(texts[lo:hi]))
                parts.append(shared.value.posterior(texts[lo:hi], sources[lo:hi], trust))
            edges = np.floor(np.cumsum(np.concatenate(parts), axis=1) * grain + batch.column(3).to_numpy()[:, None] + 1e-9)
            member = np.diff(np.concatenate([np.zeros((len(edges), 1)), edges], axis=1), axis=1) / grain
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * n, pa.int32()), pa.array(member.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), lists], names=schema.names)

    return rows.mapInArrow(measure, schema)


def _dot(values: Sequence[float]) -> str:
    """Sum over the domains of membership times value, in SQL."""
    return "(" + " + ".join(f"member[{i}] * {float(v)!r}D" for i, v in enumerate(values)) + ")"


def _cap(names: Sequence[str], caps: Sequence[float]) -> Column:
    """How often a document may be used: the cap of its source, or what its membership gives where that is none of ours."""
    own = None
    for name, cap in zip(names, caps, strict=True):
        own = F.when(F.col("source") == name, float(cap)) if own is None else own.when(F.col("source") == name, float(cap))
    return own.otherwise(F.floor(F.expr(_dot(caps))).cast("double"))


def _rate(pushed: Sequence[float], cap: Column) -> Column:
    """The rate of a document after steps that sum to ``pushed``: 1 at first, and always between 0 and its cap."""
    return F.greatest(F.lit(0.0), F.least(cap, F.expr(f"1.0D + {_dot(pushed)}")))


def fit_rates(sized: DataFrame, names: Sequence[str], shares: Sequence[float], caps: Sequence[float], size: float | None = None, tolerance: float = 1e-5, steps: int = 500) -> tuple[Column, DataFrame]:
    """(rate of a document as a column over ``sized``, a row per domain with what the rates reach).

    Documents of the same source and membership move together and are first summed to a cell. A step is an aggregation
    of the cells to one number per domain, scaled by the domain's own tokens, which keeps it below the inverse of the
    steepest curvature. Steps end when no domain moves by more than ``tolerance`` of the mix; if ``steps`` do not suffice,
    RuntimeError tells how far they moved. ``size`` is the size of the mix in tokens, by default that of all documents.
    """
    cells = written(sized.where("tokens > 0").groupBy("source", "member").agg(F.sum("tokens").cast("double").alias("tokens")).withColumn("cap", _cap(names, caps)), "mixing-cells").coalesce(4)
    sums = [F.expr(f"sum(used * member[{i}])").alias(str(i)) for i in range(len(names))]

    def totals(rate: Column) -> np.ndarray:
        row = cells.select("member", (rate * F.col("tokens")).alias("used")).agg(*sums).first()
        return np.array([x or 0.0 for x in row])

    own = totals(F.lit(1.0))
    size = float(own.sum()) if size is None else size
    target = np.array(shares) * size
    pushed = np.zeros(len(names))
    reached = totals(_rate(pushed, F.col("cap")))
    for _ in range(steps):
        pushed = pushed + (target - reached) / np.maximum(own, 1.0)
        before, reached = reached, totals(_rate(pushed, F.col("cap")))
        moved = float(np.abs(reached - before).max())
        if moved <= tolerance * max(1.0, size):
            break
    else:
        raise RuntimeError(f"rates still moved by {moved} tokens after {steps} steps")
    total = float(reached.sum()) or 1.0
    rows = [(n, float(s), float(r / total), float(o), float(t), float(r), bool(r >= t * (1 - 1e-4))) for n, s, r, o, t, r in zip(names, shares, reached, own, target, reached, strict=True)]
    report = sized.sparkSession.createDataFrame(rows, "source string, target_share double, reached_share double, own_tokens double, target_tokens double, reached_tokens double, reachable boolean")
    return _rate(pushed, _cap(names, caps)), report


def mixture(docs: DataFrame, key: str, text_col: str, source_col: str, mix_table: DataFrame, path: str, size: float | None = None, trust: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(documents with their ``rate`` and ``repeats``, the times each is used; report per source with the shares reached).

    ``mix_table`` has source, target_share and max_repeats; a handful of rows, read on the driver. ``path`` is the
    tokenizer's vocabulary file. Whole numbers of repeats come from the rates by a hash of the key, so they are the same
    on every run and never exceed the cap. Documents without tokens are used zero times. Rows are kept as delivered:
    repeated keys count as documents.
    """
    plan = sorted(mix_table.where("source is not null").select("source", "target_share", "max_repeats").distinct().collect())
    names, shares, caps = ([r[i] for r in plan] for i in range(3))
    sized = written(measured(docs, key, text_col, source_col, names, path, trust=trust), "mixing-sizes")
    rate, report = fit_rates(sized, names, [float(s) for s in shares], [float(c) for c in caps], size)
    uniform = F.pmod(F.xxhash64(F.lit(23), key), F.lit(1 << 30)) / float(1 << 30)
    used = sized.withColumn("rate", F.when(F.col("tokens") > 0, rate).otherwise(F.lit(0.0)))
    repeats = (F.floor("rate") + (uniform < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return used.select(key, "source", "tokens", "rate", repeats.alias("repeats")), report
