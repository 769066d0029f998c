"""Exact quantiles by radix selection on the ordered 64-bit image of a double.

A pass counts the next ``BITS`` bits of the values that share the bits known so far of a wanted rank,
for all columns and ranks of a group together: no row is copied, and a task holds a count array for
each open prefix. The counts say where each rank lies, so the next pass looks at fewer values. A prefix
with at most ``FEW`` values is read out whole, distinct value by distinct value. At most five passes
fix all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 13
FIRST_BITS = 12  # so that five passes make 64
FEW = 4096
# count arrays of a task, and columns times ranks looked for together
ARRAYS = 256
_SIGN = np.uint64(1 << 63)
_REST = np.int64((1 << 63) - 1)


def image(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; both zeros are one, NaN comes last as in Spark."""
    bits = (np.where(np.isnan(values), np.nan, values) + 0.0).view(np.int64)
    return (bits ^ ((bits >> np.int64(63)) & _REST)).view(np.uint64) ^ _SIGN


def value_of(image_: int) -> float:
    bits = np.array([image_], np.uint64) ^ _SIGN
    signed = bits.view(np.int64)
    return float((signed ^ ((signed >> np.int64(63)) & _REST)).view(np.float64)[0])


@dataclass(frozen=True)
class Slot:
    """Values of a column whose upper ``known`` bits are ``prefix``."""

    column: int
    known: int
    prefix: int
    whole: bool  # few enough to be read out

    @property
    def step(self) -> int:
        return BITS if self.known else FIRST_BITS


@dataclass
class Rank:
    """A wanted place: ``left`` is its rank among the values of its slot."""

    column: int
    rank: int
    slot: Slot
    left: int
    image: int | None = None


def _counts(df: DataFrame, columns: Sequence[str], slots: list[Slot]) -> pd.DataFrame:
    """(slot, key, n): per slot the counts of its next bits, or of its values."""
    asked: dict[int, list[int]] = {}
    for i, s in enumerate(slots):
        asked.setdefault(s.column, []).append(i)
    order = sorted(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {i: np.zeros(1 << s.step, np.int64) for i, s in enumerate(slots) if not s.whole}
        values: dict[int, list[np.ndarray]] = {i: [] for i, s in enumerate(slots) if s.whole}
        for batch in batches:
            for at, column in enumerate(order):
                images = image(batch.column(at).drop_null().to_numpy(zero_copy_only=False).astype(np.float64))
                for i in asked[column]:
                    s = slots[i]
                    mine = images if not s.known else images[(images >> np.uint64(64 - s.known)) == np.uint64(s.prefix)]
                    if s.whole:
                        values[i].append(mine)
                    else:
                        digits = (mine >> np.uint64(64 - s.known - s.step)) & np.uint64((1 << s.step) - 1)
                        counts[i] += np.bincount(digits.astype(np.int64), minlength=1 << s.step)
        found = [(i, np.flatnonzero(c).astype(np.uint64), c[np.flatnonzero(c)]) for i, c in counts.items()]
        found += [(i, *np.unique(np.concatenate(v), return_counts=True)) for i, v in values.items() if v]
        for i, keys, n in found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), i), pa.int32()), pa.array(keys.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["slot", "key", "n"])

    read = df.select(*[F.col(columns[c]).cast("double").alias(f"c{c}") for c in order])
    return read.mapInArrow(run, "slot int, key long, n long").groupBy("slot", "key").agg(F.sum("n").alias("n")).toPandas()


def _narrow(slot: Slot, ranks: list[Rank], keys: np.ndarray, n: np.ndarray) -> None:
    """Move each rank to the part of its slot that holds it."""
    order = np.argsort(keys, kind="stable")
    keys, ends = keys[order], np.cumsum(n[order])
    for r in ranks:
        at = int(np.searchsorted(ends, r.left, side="right"))
        size = int(n[order[at]])
        if slot.whole:
            r.image = int(keys[at])
            continue
        r.left -= int(ends[at]) - size
        prefix, known = (slot.prefix << slot.step) | int(keys[at]), slot.known + slot.step
        if known == 64:
            r.image = prefix
        r.slot = Slot(slot.column, known, prefix, size <= FEW)


def _at_ranks(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[int, int], float]:
    """Interpolated values by (column, quantile) of columns that have values."""
    first = [Slot(i, 0, 0, False) for i in range(len(columns))]
    found = _counts(df, columns, first)
    groups = {i: (g["key"].to_numpy().view(np.uint64), g["n"].to_numpy()) for i, g in found.groupby("slot")}
    wanted: dict[tuple[int, int], Rank] = {}
    places = {}
    for i, (_, n) in groups.items():
        for q, p in enumerate(probs):
            at = (int(n.sum()) - 1) * p
            low, high = int(at), min(int(at) + 1, int(n.sum()) - 1)
            places[i, q] = (low, high, at - int(at))
            for r in (low, high):
                wanted.setdefault((i, r), Rank(i, r, first[i], r))
    for i, (keys, n) in groups.items():
        _narrow(first[i], [r for r in wanted.values() if r.column == i], keys, n)
    while open_ := [r for r in wanted.values() if r.image is None]:
        slots = sorted({r.slot for r in open_}, key=lambda s: (s.column, s.prefix))
        for i, g in _counts(df, columns, slots).groupby("slot"):
            _narrow(slots[i], [r for r in open_ if r.slot == slots[i]], g["key"].to_numpy().view(np.uint64), g["n"].to_numpy())
    out = {}
    for (i, q), (low, high, part) in places.items():
        a, b = (value_of(wanted[i, r].image) for r in (low, high))
        out[i, q] = a if low == high or a == b else a + (b - a) * part
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, q, value)`` with linear interpolation between neighbouring ranks; missing ignored.

    The columns are read up to five times, so ``df`` should be a table or a written view. A column
    without values gets NULLs. The answer is computed at once: a few numbers per column.
    """
    columns, values = list(columns), {}
    at_once = max(1, ARRAYS // max(1, 2 * len(probs)))
    for start in range(0, len(columns), at_once):
        for (i, q), v in _at_ranks(df, columns[start:start + at_once], probs).items():
            values[start + i, q] = v
    rows = [(c, float(p), values.get((i, q))) for i, c in enumerate(columns) for q, p in enumerate(probs)]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def quartiles_wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column with ``q1``, ``median``, ``q3``."""
    long = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("q") == p, F.col("value")))
    return long.groupBy("column").agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"))
