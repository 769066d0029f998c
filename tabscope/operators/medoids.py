"""k-medoids with exact medoids in few passes.

A medoid minimises the summed distance to its cluster. Evaluating every row is quadratic, but an
evaluated row e bounds all others from below: by the triangle inequality the sum at x is at least
``|sum(e) - n*d(x, e)|``, and because the sum is convex it is at least its tangent at e,
``sum(e) + gradient(e)·(x - e)``. Each round evaluates the rows with the smallest bounds (one
aggregate pass for sums and gradients) and drops every row whose bound exceeds the best sum; it
ends when no row is left, so the result is exact. Evaluated rows with their sums are the only
state, and no pair of rows is ever written. Equal vectors are one row with a weight, so copies of the
best row are evaluated once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.operators.leaves import matrix
from tabscope.scratch import materialize

BATCH = 128
MAX_ITER = 300
# relative slack when dropping rows, far above the rounding of a sum
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        total += gap * gap
    return np.sqrt(total)


def _groups(x: np.ndarray, centers: np.ndarray | None) -> np.ndarray:
    """Nearest centre, ties to the first; a single group without centres."""
    return np.zeros(len(x), dtype=np.int64) if centers is None else np.argmin(_distances(x, centers), axis=1)


def _group_means(points: DataFrame, centers: np.ndarray | None, width: int) -> dict[int, tuple[int, np.ndarray]]:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, w = matrix(batch["x"], width), batch["n"].to_numpy()
            g = _groups(x, centers)
            for group in np.unique(g):
                at = g == group
                yield pd.DataFrame({"g": [group], "n": [w[at].sum()], "s": [w[at] @ x[at]]})

    sums = points.mapInPandas(partial, "g bigint, n bigint, s array<double>").groupBy("g").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)]
    )
    return {r["g"]: (r["n"], np.array([r[f"s{j}"] for j in range(width)]) / r["n"]) for r in sums.collect()}


def _candidates(points: DataFrame, centers: np.ndarray | None, width: int, known: dict, best: dict, means: dict) -> dict:
    """Per group, the rows with the smallest lower bounds that may still win (at most BATCH each)."""

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, ids = matrix(batch["x"], width), batch["id"].to_numpy()
            g = _groups(x, centers)
            for group in np.unique(g):
                mine, mine_ids = x[g == group], ids[g == group]
                n, mean = means[group]
                if group not in known:
                    low = _distances(mine, mean[None, :])[:, 0]
                    open_ = np.ones(len(mine), dtype=bool)
                else:
                    done_ids, done_x, sums, slopes = known[group]
                    reach = np.abs(sums[None, :] - n * _distances(mine, done_x)).max(axis=1)
                    tangent = (mine @ slopes.T + (sums - (slopes * done_x).sum(axis=1))[None, :]).max(axis=1)
                    low = np.maximum(reach, tangent)
                    open_ = (low <= best[group] * (1 + SLACK)) & ~np.isin(mine_ids, done_ids)
                at = np.flatnonzero(open_)
                at = at[np.lexsort((mine_ids[at], low[at]))][:BATCH]
                if len(at):
                    yield pd.DataFrame({"g": group, "low": low[at], "id": mine_ids[at], "x": list(mine[at])})

    found = points.mapInPandas(bounds, "g bigint, low double, id bigint, x array<double>")
    rank = F.row_number().over(Window.partitionBy("g").orderBy("low", "id"))
    out: dict = {}
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= BATCH).orderBy("g", "rank").collect():
        out.setdefault(r["g"], []).append((r["id"], r["x"]))
    return {g: (np.array([i for i, _ in rows]), np.array([v for _, v in rows])) for g, rows in out.items()}


def _sums(
    points: DataFrame, centers: np.ndarray | None, width: int, chosen: dict
) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Summed distance from every chosen row to its group and its gradient, one pass for all groups."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {g: np.zeros((len(ids), width + 1)) for g, (ids, _) in chosen.items()}
        for batch in batches:
            x, w = matrix(batch["x"], width), batch["n"].to_numpy(dtype=np.float64)
            g = _groups(x, centers)
            for group, total in totals.items():
                mine, weight, at = x[g == group], w[g == group][:, None], chosen[group][1]
                d = _distances(mine, at)
                total[:, 0] += (d * weight).sum(axis=0)
                inverse = np.divide(weight, d, out=np.zeros_like(d), where=d > 0)
                total[:, 1:] += at * inverse.sum(axis=0)[:, None] - inverse.T @ mine
        for group, total in totals.items():
            yield pd.DataFrame({"g": group, "at": np.arange(len(total)), "s": list(total)})

    rows = points.mapInPandas(partial, "g bigint, at bigint, s array<double>").groupBy("g", "at").agg(
        *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width + 1)]
    )
    out = {g: (np.zeros(len(ids)), np.zeros((len(ids), width))) for g, (ids, _) in chosen.items()}
    for r in rows.collect():
        sums, slopes = out[r["g"]]
        sums[r["at"]] = r["s0"]
        slopes[r["at"]] = [r[f"s{j}"] for j in range(1, width + 1)]
    return out


def _lowest(points: DataFrame, centers: np.ndarray | None, width: int, winners: int, start: dict | None = None) -> dict:
    """Per group, the ``winners`` rows with the smallest summed distance, exactly: [(sum, id, x)]."""
    means = _group_means(points, centers, width)
    known: dict = {}
    best = {g: np.inf for g in means}
    first = {g: v for g, v in (start or {}).items() if g in means}
    while True:
        chosen = _candidates(points, centers, width, known, best, means)
        for g, (ids, x) in first.items():
            if g in chosen and ids[0] not in chosen[g][0]:
                chosen[g] = (np.append(chosen[g][0], ids), np.vstack([chosen[g][1], x]))
        first = {}
        if not chosen:
            break
        sums = _sums(points, centers, width, chosen)
        for g, (ids, x) in chosen.items():
            old = known.get(g, (np.zeros(0, dtype=np.int64), np.zeros((0, width)), np.zeros(0), np.zeros((0, width))))
            known[g] = (
                np.append(old[0], ids), np.vstack([old[1], x]), np.append(old[2], sums[g][0]), np.vstack([old[3], sums[g][1]])
            )
            ordered = np.sort(known[g][2])
            best[g] = ordered[winners - 1] if len(ordered) >= winners else np.inf
    out = {}
    for g, (ids, x, s, _) in known.items():
        order = np.lexsort((ids, s))[:winners]
        out[g] = [(float(s[i]), int(ids[i]), x[i]) for i in order], dict(zip(ids.tolist(), s.tolist()))
    return out


def nearest_center(features: Sequence[str], centers: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre as a column expression, ties to the first."""
    d2 = []
    for c in centers:
        total = F.lit(0.0)
        for f, v in zip(features, c):
            total = total + (F.col(f) - float(v)) * (F.col(f) - float(v))
        d2.append(total)
    every = F.array(*d2)
    return (F.array_position(every, F.array_min(every)) - 1).cast("int")


def _first_medoids(rows: DataFrame, points: DataFrame, width: int, k: int) -> list[tuple[int, np.ndarray]]:
    """The k rows with the smallest summed distance to the whole table; copies count as rows of their own."""
    vectors, _ = _lowest(points, None, width, k)[0]
    found = []
    for total, _, x in vectors:
        same = rows.filter(F.col("x") == F.array(*[F.lit(float(v)) for v in x]))
        found += [(total, r["id"], x) for r in same.select("id").orderBy("id").limit(k).collect()]
    found.sort(key=lambda f: f[:2])
    return [(i, x) for _, i, x in found[:k]]


def fit_medoids(
    df: DataFrame, features: Sequence[str], key: str, k: int = 3, max_iter: int = MAX_ITER
) -> list[tuple[int, np.ndarray]]:
    """Medoid rows as ``[(key, vector)]``.

    Starts from the k rows with the smallest summed distance to the whole table, then alternates
    assigning rows and replacing each medoid by a strictly better row of its cluster.
    """
    width = len(features)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    points = materialize(rows.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("n")), "medoids")
    medoids = _first_medoids(rows, points, width, k)
    for _ in range(max_iter):
        centers = np.array([x for _, x in medoids])
        held = {g: (np.array([i]), x[None, :]) for g, (i, x) in enumerate(medoids)}
        lowest = _lowest(points, centers, width, 1, held)
        changed = False
        for g, (i, _) in enumerate(list(medoids)):
            if g not in lowest:
                continue
            [(total, new, x)], sums = lowest[g]
            if new != i and total < sums.get(i, np.inf):
                medoids[g], changed = (new, x), True
        if not changed:
            break
    return medoids


def medoid_labels(df: DataFrame, features: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """The rows with their ``cluster`` and the key of its ``medoid``."""
    medoids = fit_medoids(df, features, key, k)
    cluster = nearest_center(features, [x for _, x in medoids])
    keys = F.array(*[F.lit(i).cast("bigint") for i, _ in medoids])
    return df.withColumn("cluster", cluster).withColumn("medoid", F.element_at(keys, F.col("cluster") + 1))
