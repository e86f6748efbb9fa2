"""Evaluation passages inside a training corpus, found by winnowing.

Texts are reduced to letters and digits in lower case and one width. Of every window of consecutive k-gram hashes the
least is kept as a fingerprint, so any two texts that share a run of ``run`` characters share a fingerprint. Fingerprints
of corpus and test items are joined, and each hit is extended to the exact share of the passage that lies in such runs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataquill.llm.arrays import chunks, code_points, kept, kgrams, mix, owners, window_min

_SLOW = np.uint32(0xFFFFFFFF)


def reduce_text(text: str) -> str:
    """Letters and digits only, lower case, one width."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


@lru_cache(1)
def _reduction() -> np.ndarray:
    """Code point -> reduced code point, 0 if dropped, _SLOW where it depends on its neighbours or gives several."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        char = chr(c)
        if 0xD800 <= c < 0xE000:
            continue
        if 0x300 <= c < 0x370 or 0x3099 <= c < 0x309B or 0x1100 <= c < 0x1200 or 0xFF9E <= c < 0xFFA0 or c == 0x3A3:
            table[c] = _SLOW
            continue
        form = reduce_text(char)
        table[c] = 0 if not form else ord(form) if len(form) == 1 else _SLOW
    return table


def reduced(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Reduced code points of all texts in a row, and the start of each."""
    codes, starts = code_points(texts)
    table = _reduction()
    mapped = table[np.minimum(codes, 0xFFFF)]
    mapped[codes > 0xFFFF] = _SLOW
    slow = np.flatnonzero(mapped == _SLOW)
    if len(slow):
        whole = sorted(set((np.searchsorted(starts, slow, side="right") - 1).tolist()))
        texts = list(texts)
        for i in whole:
            texts[i] = reduce_text(texts[i])
        codes, starts = code_points(texts)
        done = np.zeros(len(texts), bool)
        done[whole] = True
        mapped = np.where(done[owners(starts)], codes, table[np.minimum(codes, 0xFFFF)]) if len(codes) else codes
    return kept(mapped, starts, mapped != 0)


def fingerprints(codes: np.ndarray, starts: np.ndarray, run: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint), winnowed so that every shared run of ``run`` symbols shares one."""
    least = window_min(mix(kgrams(codes, k)), run - k + 1)
    owner = owners(starts)
    if not len(least):
        return owner[:0], least
    inside = owner[: len(least)] == owner[run - 1 :]
    least, owner = least[inside], owner[: len(inside)][inside]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    return owner[change], least[change]


def covered(passage: np.ndarray, text: np.ndarray, run: int) -> int:
    """How many symbols of ``passage`` lie in runs of ``run`` or more that also occur in ``text``."""
    hit = np.isin(kgrams(passage, run), kgrams(text, run))
    edge = np.zeros(len(passage) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + run, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Probes:
    """The test passages, ready to be looked up."""

    def __init__(self, items: list[tuple[str, str]], run: int, k: int) -> None:
        self.run, self.k = run, k
        self.ids = [i for i, _ in items]
        codes, starts = reduced([t for _, t in items])
        self.size = np.diff(starts)
        self.prints = np.unique(fingerprints(codes, starts, run, k)[1])
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.prints >> np.uint64(44)).astype(np.int64)] = True
        owner, at, hashed = self._runs(codes, starts)
        order = np.argsort(hashed, kind="stable")
        self.runs, first = np.unique(hashed[order], return_index=True)
        self.first = np.append(first, len(order))
        self.item, self.at = owner[order], at[order]

    def _runs(self, codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, position in it, hash) of all windows of ``run`` symbols."""
        hashed, owner = kgrams(codes, self.run), owners(starts)
        inside = np.flatnonzero(owner[: len(hashed)] == owner[self.run - 1 :]) if len(hashed) else np.zeros(0, np.int64)
        return owner[inside], inside - starts[owner[inside]], hashed[inside]

    def find(self, texts: list[str]) -> Iterator[tuple[int, str, float]]:
        """(text number, item id, covered share) of every text and item with a shared run."""
        codes, starts = reduced(texts)
        owner, prints = fingerprints(codes, starts, self.run, self.k)
        maybe = self.near[(prints >> np.uint64(44)).astype(np.int64)]
        owner, prints = owner[maybe], prints[maybe]
        hit = np.unique(owner[np.isin(prints, self.prints)])
        if not len(hit) or not len(self.runs):
            return
        parts = [codes[starts[o] : starts[o + 1]] for o in hit]
        which, _, hashed = self._runs(np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
        place = np.minimum(np.searchsorted(self.runs, hashed), len(self.runs) - 1)
        same = self.runs[place] == hashed
        seen = np.unique(which[same].astype(np.int64) * len(self.runs) + place[same])
        which, place = seen // len(self.runs), seen % len(self.runs)
        times = self.first[place + 1] - self.first[place]
        entry = np.repeat(self.first[place] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
        which = np.repeat(which, times)
        order = np.lexsort((self.at[entry], self.item[entry], which))
        which, item, at = which[order], self.item[entry][order], self.at[entry][order]
        last = np.append((which[1:] != which[:-1]) | (item[1:] != item[:-1]), True)
        step = np.where(last, self.run, np.minimum(self.run, np.append(at[1:], 0) - at))
        ends = np.flatnonzero(last)
        covered_chars = np.add.reduceat(step, np.concatenate([[0], ends[:-1] + 1])) if len(ends) else ends
        for w, i, c in zip(which[ends].tolist(), item[ends].tolist(), covered_chars.tolist(), strict=True):
            yield int(hit[w]), self.ids[i], c / int(self.size[i])


def leaked(docs: DataFrame, doc_key: str, text_col: str, items: DataFrame, item_key: str, item_col: str, run: int = 40, k: int = 20, broadcast_chars: int = 8_000_000) -> DataFrame:
    """(document key, item key, share) of documents that hold part of a test item in runs of ``run`` or more characters.

    The size of the test set is measured first. Up to ``broadcast_chars`` characters it is sent to every task and the
    corpus is read once, without a shuffle; a larger set is joined by fingerprint, and only matching documents and items
    are brought together for the exact share. Null or blank texts, and items of fewer than ``run`` letters and digits,
    give no rows; repeated rows count once. ``share`` is over the letters and digits of the item.
    """
    items = items.select(F.col(item_key).cast("string").alias("i"), F.col(item_col).alias("t")).where("i is not null and t is not null").distinct()
    docs = docs.select(F.col(doc_key).alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    schema = T.StructType([T.StructField(doc_key, docs.schema["d"].dataType), T.StructField(item_key, T.StringType()), T.StructField("share", T.DoubleType())])
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    if size <= broadcast_chars:
        probes = Probes([(r.i, r.t) for r in items.collect()], run, k)
        shared = docs.sparkSession.sparkContext.broadcast(probes)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                rows = [(lo + r[0], *r[1:]) for lo, hi in chunks(texts) for r in shared.value.find(texts[lo:hi])]
                keys = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=schema.names)

        return docs.mapInArrow(look, schema).distinct()

    def prints(key_type: T.DataType, df: DataFrame, key: str) -> DataFrame:
        out = T.StructType([T.StructField(key, key_type), T.StructField("p", T.LongType())])

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in chunks(texts):
                    owner, fp = fingerprints(*reduced(texts[lo:hi]), run, k)
                    keys = batch.column(0).take(pa.array(owner + lo, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(fp.view(np.int64), pa.int64())], names=[key, "p"])

        return df.mapInArrow(emit, out).distinct()

    pairs = prints(docs.schema["d"].dataType, docs, "d").join(prints(T.StringType(), items, "i"), "p").select("d", "i").distinct()
    both = pairs.join(docs.distinct().withColumnRenamed("t", "dt"), "d").join(items.withColumnRenamed("t", "it"), "i").select("d", "i", "dt", "it")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = []
            for dt, it in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                codes, starts = reduced([it, dt])
                shares.append(covered(codes[: starts[1]], codes[starts[1] :], run) / max(1, int(starts[1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=schema.names)

    return both.mapInArrow(measure, schema).where("share > 0").distinct()
