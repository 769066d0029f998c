"""Interval binning with either closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cut(
    col: str | Column,
    edges: Sequence[float],
    labels: Sequence[str],
    closed: str = "right",
    include_end: bool = True,
) -> Column:
    """Label of the interval a value falls in, NULL outside the edges.

    ``include_end`` closes the outermost open edge: the lowest for right-closed intervals, the
    highest for left-closed ones.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per interval")
    c = F.col(col) if isinstance(col, str) else col
    last = len(labels) - 1
    expr = None
    for i, label in enumerate(labels):
        lo, hi = F.lit(edges[i]), F.lit(edges[i + 1])
        if closed == "right":
            above = (c >= lo) if include_end and i == 0 else (c > lo)
            inside = above & (c <= hi)
        else:
            below = (c <= hi) if include_end and i == last else (c < hi)
            inside = (c >= lo) & below
        expr = F.when(inside, F.lit(label)) if expr is None else expr.when(inside, F.lit(label))
    return expr


def decade_label(col: str | Column, start: int = 20, width: int = 10) -> Column:
    """``20-29`` style label of right-closed groups: ``start`` itself and ``start+width`` share the first."""
    c = F.col(col) if isinstance(col, str) else col
    step = F.greatest(F.ceil((c - start) / F.lit(float(width))) - 1, F.lit(0))
    low = (F.lit(start) + step * width).cast("int")
    label = F.concat(low.cast("string"), F.lit("-"), (low + (width - 1)).cast("string"))
    return F.when(c >= start, label)


def step_bin(col: str | Column, start: float, step: float, bins: int) -> Column:
    """Index of a left-closed bin whose edges are ``start + i*step``; the last bin is closed.

    The quotient only proposes an index; the comparison with the edges decides, so values on an
    edge land where the edge comparison puts them. NULL outside the edges.
    """
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    guess = F.floor((c - F.lit(float(start))) / F.lit(float(step)))

    def edge(i: Column) -> Column:
        return F.lit(float(start)) + i.cast("double") * F.lit(float(step))

    index = F.when(c < edge(guess), guess - 1).when(c >= edge(guess + 1), guess + 1).otherwise(guess)
    end = F.lit(float(start)) + F.lit(float(bins)) * F.lit(float(step))
    return F.when((c >= start) & (c <= end), F.least(index, F.lit(bins - 1))).cast("int")
