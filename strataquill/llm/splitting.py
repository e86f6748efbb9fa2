"""Oversized texts cut into overlapping pieces at natural boundaries.

Dynamic programming over the boundary positions of a text: a set of cuts costs the penalty of each cut (a blank line
costs least, a cut inside a word most) plus the squared imbalance of the piece sizes; every piece stays within the limit
and starts exactly ``overlap`` characters before the end of the one before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cut penalties by the kind of boundary before the position.
BOUNDARIES: tuple[tuple[str, float], ...] = (
    (r"\n[^\S\n]*\n\s*", 0.0),
    (r"[。！？｡।॥]+[”’»」』）)\]】]*\s*|[.!?…]+[\"”’»)\]]*\s+|……+", 1.0),
    (r"\n", 1.5),
    (r"[；;]\s*", 3.0),
    (r"[，,、：:|\t]\s*(?!\d)", 4.0),
    (r"\s+", 6.0),
)
HARD = 12.0
BALANCE = 8.0


def boundary_positions(text: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, ascending, with penalties; gaps without any get hard positions."""
    penalty: dict[int, float] = {}
    for pattern, cost in reversed(BOUNDARIES):
        for hit in re.finditer(pattern, text):
            penalty[hit.end()] = cost
    penalty.pop(0, None)
    penalty[len(text)] = 0.0
    step, last = max(1, longest // 44), 0
    for at in sorted(penalty):
        if at - last > longest // 4:
            for hard in range(last + step, at, step):
                # Not before a combining mark, unless the whole step consists of them.
                near = (p for p in range(hard, max(last, hard - step), -1) if unicodedata.category(text[p])[0] != "M")
                penalty.setdefault(next(near, hard), HARD)
        last = at
    positions = np.array(sorted(penalty), dtype=np.int64)
    return positions, np.array([penalty[p] for p in positions.tolist()])


def cut_positions(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces, the last being len(text), at least total cost."""
    n, longest = len(text), limit - overlap
    if n <= limit:
        return [n]
    positions, penalty = boundary_positions(text, longest)
    positions, penalty = np.concatenate([[0], positions]), np.concatenate([[0.0], penalty])
    pieces = -(-(n - overlap) // longest)
    target = (n - overlap) / pieces
    best = np.full(len(positions), np.inf)
    back = np.zeros(len(positions), dtype=np.int64)
    best[0] = 0.0
    first = np.searchsorted(positions, positions - longest, side="left")
    usable = int(np.searchsorted(positions, overlap, side="right"))
    for i in range(1, len(positions)):
        low = max(int(first[i]), usable)
        cost = best[low:i] + BALANCE * ((positions[i] - positions[low:i] - target) / target) ** 2
        if len(cost):
            k = int(cost.argmin())
            best[i], back[i] = cost[k], low + k
        if positions[i] <= limit:
            alone = BALANCE * ((positions[i] - overlap - target) / target) ** 2
            if alone <= best[i]:
                best[i], back[i] = alone, 0
        best[i] += penalty[i]
    ends, i = [], len(positions) - 1
    while i > 0:
        ends.append(int(positions[i]))
        i = int(back[i])
    return ends[::-1]


def split_oversized(df: DataFrame, keys: Sequence[str], text_col: str, limit: int = 1200, overlap: int = 100) -> DataFrame:
    """Pieces of every text longer than ``limit``: the key columns, piece_index, start_pos, end_pos, piece_text.

    The length test runs in the scan stage, so only oversized texts reach Python; no shuffle. Shorter, empty and null
    texts give no rows, repeated rows repeat, other columns are not read. Without its first ``overlap`` characters each
    piece follows on the one before it. A key named like an output column raises ValueError.
    """
    clash = {"piece_index", "start_pos", "end_pos", "piece_text"} & set(keys)
    if clash or not 0 <= overlap < limit:
        raise ValueError(f"key columns named like output columns {sorted(clash)}, or overlap not below limit")
    long = df.select(*keys, F.col(text_col).alias("__text")).where(F.length("__text") > limit)
    added = [T.StructField("piece_index", T.IntegerType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("piece_text", T.StringType())]
    schema = T.StructType([*(long.schema[k] for k in keys), *added])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, rows = [], ([], [], [], [])
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                start = 0
                for piece, end in enumerate(cut_positions(text, limit, overlap)):
                    source.append(k)
                    for column, value in zip(rows, (piece, start, end, text[start:end]), strict=True):
                        column.append(value)
                    start = end - overlap
            taken = batch.take(pa.array(source, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
            arrays = [taken.column(i) for i in range(len(keys))] + [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *(f.name for f in added)])

    return long.mapInArrow(cut, schema)
