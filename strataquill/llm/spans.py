"""Long exact spans shared between records, by recompression.

Rounds rename the symbols of a text: equal neighbours become one run symbol, then pairs of a "left" and a "right" symbol
become one. A name is a hash of what it stands for and the side of a symbol a bit of its name, so all texts of all
partitions are renamed alike without exchanging a dictionary. Only symbols up to a length that grows with the round are
renamed. A last round names phrases of consecutive symbols; these high-level symbols are the keys that are joined.

With every symbol goes the stretch of characters that it depends on: any text that holds the same stretch has the same
symbol in the same place. So it is known for each window of ``run`` characters which phrases lie inside it with all that
they depend on, and the one of least name is the window's key. Whether there is any hangs on the window's own characters
only; a window without one is keyed by the least of its k-gram hashes instead. Equal windows therefore have equal keys:
nothing is left to chance. Shared keys reveal the windows worth a look; 128-bit hashes of the windows themselves verify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataquill.llm.arrays import U64, chunks, code_points, kgrams, mix, owners, window_min
from strataquill.session import written

#: A dependency on what lies beyond the end of a text.
FAR = np.int64(1 << 40)


@dataclass
class Symbols:
    """Symbols of all texts in a row: name, first character, text number, and the stretch of characters it depends on."""

    name: np.ndarray
    at: np.ndarray
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def taken(self, which: np.ndarray) -> Symbols:
        return Symbols(self.name[which], self.at[which], self.owner[which], self.low[which], self.high[which])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each symbol is the first, and the last, of its text."""
        first = np.ones(len(self.at), bool)
        first[1:] = self.owner[1:] != self.owner[:-1]
        return first, np.append(first[1:], True)


def _shift(values: np.ndarray, by: int, fill) -> np.ndarray:
    """Values of the neighbour before (1) or after (-1), ``fill`` where there is none."""
    return np.concatenate([[fill], values[:-1]]) if by == 1 else np.concatenate([values[1:], [fill]])


def _runs(s: Symbols, codes: np.ndarray, limit: float) -> Symbols:
    """Equal neighbours joined. A symbol also depends on what shows that its neighbours differ: one character, as a rule."""
    end = _shift(s.at, -1, len(codes))
    small = end - s.at <= limit
    first, _ = s.edges()
    joins = small & ~first
    joins[1:] &= s.name[1:] == s.name[:-1]
    head = np.flatnonzero(~joins)
    tail = np.append(head[1:], len(joins)) - 1
    out = s.taken(head)
    if len(head) < len(joins):
        count = (tail - head + 1).astype(U64)
        out.name = np.where(count > 1, mix(out.name ^ mix(count + U64(1 << 40))), out.name)
        out.low, out.high = np.minimum.reduceat(s.low, head), np.maximum.reduceat(s.high, head)
    first, last = out.edges()
    small, end = small[head], end[tail]
    before, after = codes[np.maximum(out.at - 1, 0)], codes[np.minimum(end, len(codes) - 1)]
    alike_before, alike_after = before == codes[end - 1], after == codes[out.at]
    low, high = np.where(first, -FAR, out.at - 1), np.where(last, FAR, end + 1)
    low, high = np.minimum(out.low, np.where(small, low, FAR)), np.maximum(out.high, np.where(small, high, -FAR))
    for alike, step in ((small & alike_before & ~first, 1), (small & alike_after & ~last, -1)):
        if alike.any():
            low = np.where(alike, np.minimum(low, _shift(out.low, step, FAR)), low)
            high = np.where(alike, np.maximum(high, _shift(out.high, step, -FAR)), high)
    out.low, out.high = low, high
    return out


def _pairs(s: Symbols, size: int, limit: float, r: int) -> Symbols:
    """A left symbol takes the right symbol after it; one that stays single depends on the neighbour it might have met."""
    small = _shift(s.at, -1, size) - s.at <= limit
    first, last = s.edges()
    right = (mix(s.name + U64(r + 1)) & U64(1)).astype(bool)
    second = small & right & ~first & _shift(small & ~right, 1, False)
    lead = _shift(second, -1, False)
    to_next, to_last = small & ~right, small & right & ~second
    low = np.minimum(s.low, np.where(to_next & ~last, _shift(s.low, -1, FAR), np.where(to_last, np.where(first, -FAR, _shift(s.low, 1, FAR)), FAR)))
    high = np.maximum(s.high, np.where(to_next, np.where(last, FAR, _shift(s.high, -1, -FAR)), np.where(to_last & ~first, _shift(s.high, 1, -FAR), -FAR)))
    name = np.where(lead, mix(s.name * U64(0x9E3779B97F4A7C15) + _shift(s.name, -1, U64(0)) + U64(r)), s.name)
    return Symbols(name, s.at, s.owner, low, high).taken(np.flatnonzero(~second))


def recompress(codes: np.ndarray, starts: np.ndarray, rounds: int, longest: int) -> Symbols:
    """The symbols left after ``rounds`` rounds over all texts in a row.

    In the last round symbols of up to ``longest`` characters take part, in the ones before an eighth less each.
    """
    at = np.arange(len(codes), dtype=np.int64)
    out = Symbols(mix(codes), at, owners(starts), at, at + 1)
    for r in range(rounds):
        if len(out.at) < 2:
            break
        limit = max(2.0, longest * (7 / 8) ** (rounds - 1 - r))
        out = _pairs(_runs(out, codes, limit), len(codes), limit, r)
    return out


def phrases(s: Symbols, size: int, least: int) -> Symbols:
    """At every symbol, the phrase of consecutive symbols from it on that has ``least`` characters or more."""
    end = _shift(s.at, -1, size)
    upto = np.searchsorted(end, s.at + least)
    fits = upto < len(end)
    fits[fits] &= s.owner[upto[fits]] == s.owner[fits]
    begin, upto = np.flatnonzero(fits), upto[fits]
    out = s.taken(begin)
    step = 1
    while len(more := np.flatnonzero(begin + step <= upto)):
        at = begin[more] + step
        out.name[more] = mix(out.name[more] * U64(0x9E3779B97F4A7C15) + s.name[at])
        out.low[more] = np.minimum(out.low[more], s.low[at])
        out.high[more] = np.maximum(out.high[more], s.high[at])
        step += 1
    return out


def keyed_windows(texts: list[str], run: int, least: int, rounds: int, longest: int) -> tuple[np.ndarray, ...]:
    """(text number, key, first window, last window): ranges of windows of ``run`` characters, by their first character, with their key.

    The key of a window is the least name of the phrases that lie in it with all they depend on. If there is none, it is
    the least hash of its k-grams. Every window has one key, and equal windows have equal keys.
    """
    codes, starts = code_points(texts)
    none = np.zeros(0, np.int64)
    if len(codes) < run:
        return none, none.view(U64), none, none
    s = phrases(recompress(codes, starts, rounds, longest), len(codes), least)
    begin, over = starts[:-1][s.owner], starts[1:][s.owner]
    inside = np.flatnonzero((s.low >= begin) & (s.high <= over) & (s.high - s.low <= run) & (over - begin >= run))
    first, last = np.maximum(s.high[inside] - run, begin[inside]), np.minimum(s.low[inside], over[inside] - run)
    key = np.full(len(codes) - run + 1, np.iinfo(U64).max, U64)
    width = last - first + 1
    at = np.repeat(first - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(int(width.sum())) if len(width) else none
    np.minimum.at(key, at, np.repeat(s.name[inside], width))
    owner = owners(starts)
    whole = owner[: len(key)] == owner[run - 1 :]
    bare = np.flatnonzero(whole & (key == np.iinfo(U64).max))
    if len(bare):
        key[bare] = mix(window_min(mix(kgrams(mix(codes), least)), run - least + 1)[bare])
    at = np.flatnonzero(whole)
    if not len(at):
        return none, none.view(U64), none, none
    head = np.flatnonzero(np.concatenate([[True], (key[at[1:]] != key[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])]))
    tail = np.append(head[1:], len(at)) - 1
    of = owner[at[head]]
    return of, key[at[head]], at[head] - starts[of], at[tail] - starts[of]


class Shared:
    """Runs of ``run`` or more characters that records of different owners have in common.

    Equal texts are one class, worked on once. ``members`` has key, owner and class of every record, ``windows`` the
    places of all windows under a shared key, ``sets`` the shared windows with a fingerprint of the set of classes that
    hold them, and ``runs`` the classes of each such set, once per set: a passage of a thousand characters in the same
    hundred texts is one set. No pair of texts is formed anywhere; groups are only counted and summed, combined on the
    map side. Records with a null key, owner or text have no part in it, shorter ones share nothing, and repeated rows
    count once.
    """

    def __init__(self, records: DataFrame, key: str, owner_col: str, text_col: str, run: int = 120, least: int = 64, rounds: int = 6, longest: int = 12) -> None:
        self.key, self.owner_col, self.run = key, owner_col, run
        rows = records.where(F.col(key).isNotNull() & F.col(owner_col).isNotNull() & F.col(text_col).isNotNull())
        rows = rows.select(F.col(key).alias("__key"), F.col(owner_col).alias("__owner"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("c"))
        self.members = written(rows.select("__key", "__owner", "c", F.length("__text").alias("n")).distinct(), "spans-members")
        texts = written(rows.where(F.length("__text") >= run).select("c", "__text").distinct(), "spans-texts")

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shown = batch.column(1).to_pylist()
                for lo, hi in chunks(shown, 200_000):
                    which, keys, first, last = keyed_windows(shown[lo:hi], run, least, rounds, longest)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0).take(pa.array(which + lo)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["k", "c", "a", "b"])

        points = written(texts.mapInArrow(emit, "k long, c long, a int, b int"), "spans-points")
        common = points.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("k")
        ranges = points.join(common, "k", "left_semi").groupBy("c").agg(F.collect_list(F.struct("a", "b")).alias("r"))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shown, ranged = batch.column(1).to_pylist(), batch.column(2)
                offsets, flat = ranged.offsets.to_numpy() - ranged.offsets[0].as_py(), ranged.flatten()
                a, b = (flat.field(i).to_numpy() for i in range(2))
                for lo, hi in chunks(shown, 200_000):
                    codes, starts = code_points(shown[lo:hi])
                    edge = np.zeros(len(codes) + 1, np.int64)
                    begin = np.repeat(starts[:-1], np.diff(offsets[lo : hi + 1]))
                    np.add.at(edge, begin + a[offsets[lo] : offsets[hi]], 1)
                    np.add.at(edge, begin + b[offsets[lo] : offsets[hi]] + 1, -1)
                    at = np.flatnonzero(np.cumsum(edge[:-1]))
                    of = owners(starts)[at]
                    one, two = kgrams(mix(codes), run)[at], kgrams(mix(codes + np.uint32(1 << 24)), run)[at]
                    once = np.zeros(len(at), bool)
                    order = np.lexsort((at, one, of))
                    if len(at):
                        once[order] = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (one[order][1:] != one[order][:-1])])
                    yield pa.RecordBatch.from_arrays([pa.array(mix(one).view(np.int64)), pa.array(mix(two).view(np.int64)), batch.column(0).take(pa.array(of + lo)), pa.array((at - starts[of]).astype(np.int32)), pa.array(once)], names=["h", "g", "c", "p", "f"])

        self.windows = written(texts.join(ranges, "c").select("c", "__text", "r").mapInArrow(look, "h long, g long, c long, p int, f boolean"), "spans-windows")
        held = self.windows.where("f").groupBy("h", "g").agg(F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(s), "c").cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)))
        self.sets = written(held.where("n > 1").select("h", "g", F.xxhash64("n", "s1").alias("s"), F.xxhash64("s2", "n").alias("t")), "spans-sets")
        chosen = self.sets.groupBy("s", "t").agg(F.min(F.struct("h", "g")).alias("x")).select("s", "t", "x.h", "x.g")
        self.runs = written(chosen.join(self.windows.where("f"), ["h", "g"]).select("s", "t", "c"), "spans-runs")

    def owned(self) -> DataFrame:
        """The owners of each class of ``run`` characters or more."""
        return self.members.where(F.col("n") >= self.run).select("c", "__owner").distinct()

    def with_others(self) -> DataFrame:
        """(key, other owner): every record and each other owner one of whose records shares a run with it."""
        reached = self.runs.join(self.owned(), "c").select("s", "t", "__owner").distinct()
        reach = self.runs.join(reached, ["s", "t"]).select("c", F.col("__owner").alias("__other"))
        reach = reach.unionByName(self.owned().select("c", F.col("__owner").alias("__other"))).distinct()
        out = self.members.join(reach, "c").where("__owner != __other")
        return out.select(F.col("__key").alias(self.key), F.col("__other").alias(f"other_{self.owner_col}")).distinct()

    def shares(self) -> DataFrame:
        """(key, chars, shared_chars, share): how much of each record lies in runs that a record of another owner holds.

        Every record has a row; the share of an empty text is 0. A key with several texts has a row for each.
        """
        mixed = lambda df, *by: df.groupBy(*by).agg(F.min("__owner").alias("lo"), F.max("__owner").alias("hi")).where("lo != hi").select(*by)
        shared = self.sets.join(mixed(self.runs.join(self.owned(), "c"), "s", "t"), ["s", "t"], "left_semi").select("h", "g")
        places = self.windows.join(shared, ["h", "g"], "left_semi").select("c", "p")
        gap = F.lead("p").over(W.partitionBy("c").orderBy("p")) - F.col("p")
        part = places.withColumn("w", F.least(F.coalesce(gap, F.lit(self.run)), F.lit(self.run))).groupBy("c").agg(F.sum("w").alias("w"))
        copied = mixed(self.owned(), "c").withColumn("whole", F.lit(True))
        rows = self.members.join(part, "c", "left").join(copied, "c", "left")
        chars: Column = F.when(F.col("whole"), F.col("n")).otherwise(F.coalesce("w", F.lit(0))).cast("long")
        return rows.select(F.col("__key").alias(self.key), F.col("n").alias("chars"), chars.alias("shared_chars"), F.coalesce(F.try_divide(chars, F.col("n")), F.lit(0.0)).alias("share")).distinct()


def shared_with(records: DataFrame, key: str, owner_col: str, text_col: str, **settings) -> DataFrame:
    """(key, other owner): every record and each other owner one of whose records shares a long run with it."""
    return Shared(records, key, owner_col, text_col, **settings).with_others()


def shared_shares(records: DataFrame, key: str, owner_col: str, text_col: str, **settings) -> DataFrame:
    """(key, chars, shared_chars, share) of every record: how much of it is shared with other owners."""
    return Shared(records, key, owner_col, text_col, **settings).shares()
