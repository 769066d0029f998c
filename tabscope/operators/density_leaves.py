"""Exact density-based clustering (eps, min_samples) in many dimensions, by leaves.

Equal rows become one point with a weight. Points are cut into leaves of similar size; a leaf whose
box has a diagonal of eps at most is not cut further, whatever it holds, because its points are
neighbours of each other by construction. Points are first counted inside their leaf, which settles most where rows are dense. Leaves that
come within eps meet pairwise, twice:

* once to count, for the points that their leaf leaves open: a pair returns one number per such point;
* once to link, when core points are known: the groups of core points that are connected inside a
  leaf's chunk meet, by their boxes first, until two points within eps are found, unless a task knows them to be
  connected already; and for a point that is not core, a pair returns the groups it touches, fewer than ``min_samples`` of them.

So no pair of points leaves a task, and what is written grows with the points and leaves that
meet, not with the neighbours. One side of the pairs is broadcast block by block, see ``pairwise.beside``.
Clusters are the components of the graph of groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.operators import leaves as L
from tabscope.operators.components import connected_components
from tabscope.operators.pairwise import beside, steps, within
from tabscope.operators.ranks import value_codes
from tabscope.scratch import remove, written

# points of a leaf, and of a part of a leaf that is not cut because its points are close
LEAF_POINTS = 2500
# arrays or links a task gathers before it hands them on
HELD = 4096
HELD_LINKS = 200_000
# chunks sent to all tasks at a time, and pairs a task puts side by side
CELL_CHUNKS = 128
PAIRS_AT_ONCE = 64
# groups of a chunk that are compared with a group of another one by one
GROUPS_ALONE = 16

_CHUNK = "chunk bigint, leaf bigint, sure boolean, top bigint, first binary, w binary, x binary"


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _matrix(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(-1, width)


def _chunks(leaves: L.Leaves, boxes: DataFrame, eps2: float, min_samples: int) -> DataFrame:
    """Points of a leaf side by side, a bounded number per row. ``sure``: all core, all in one group, named ``top``."""
    diagonal2 = F.aggregate(F.zip_with("low", "high", lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda a, v: a + v)
    # a hair under eps on the diagonal, so rounding cannot put a farther pair into one group
    tight = boxes.select("leaf", (diagonal2 <= eps2 * (1 - 1e-9)).alias("tight"))
    sizes = leaves.rows.groupBy("leaf").agg(F.count("*").alias("m"), F.sum("w").alias("weight"), F.min("first").alias("top"))
    sizes = sizes.join(tight, "leaf").withColumn("sure", F.col("tight") & (F.col("weight") >= min_samples))
    keyed, width = leaves.rows.join(sizes.select("leaf", "m", "top", "sure"), "leaf"), leaves.width
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("first"), F.ceil(F.col("m") / F.lit(2 * LEAF_POINTS))).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        top = group.iloc[:1]
        return pd.DataFrame({
            "leaf": top["leaf"], "sure": top["sure"], "top": top["top"], "first": [group["first"].to_numpy(np.int64).tobytes()],
            "w": [group["w"].to_numpy(np.int64).tobytes()], "x": [L.matrix(group["x"], width).tobytes()],
        })

    packed = keyed.groupBy("leaf", "part").applyInPandas(pack, _CHUNK.removeprefix("chunk bigint, "))
    return packed.select(F.monotonically_increasing_id().alias("chunk"), "*")


def _meetings(leaves: L.Leaves, boxes: DataFrame, chunks: DataFrame, eps2: float) -> DataFrame:
    """(chunk, chunk_r): chunks of leaves within eps of each other, each pair once, without the inside of sure leaves."""
    asking = boxes.select(F.col("leaf").alias("home"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.lit(eps2 * (1 + 1e-9)).alias("reach2"))
    near = L.visits(asking, "lo", "hi", leaves, boxes, "density").select("home", "leaf")
    names = chunks.select("chunk", "leaf", "sure")
    return (
        near.filter("home <= leaf").join(names.select(F.col("leaf").alias("home"), "chunk", F.col("sure").alias("sure_l")), "home")
        .join(names.select("leaf", F.col("chunk").alias("chunk_r"), F.col("sure").alias("sure_r")), "leaf")
        .filter("home < leaf or (chunk <= chunk_r and not sure_l)")
        .select("chunk", "chunk_r")
    )


def _beside(
    pairs: DataFrame, chunks: DataFrame, columns: Sequence[str], compare: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str,
    paths: list[str] | None = None,
) -> DataFrame:
    """What ``compare`` makes of the pairs with the content of both chunks; ``paths`` gets the place where it lies."""
    blocks = max(1, math.ceil(chunks.count() / CELL_CHUNKS))
    found, path = beside(pairs, chunks, columns, compare, schema, blocks, PAIRS_AT_ONCE, "density")
    if paths is not None:
        paths.append(path)
    return found


def _gap2(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of points, or of boxes given as a pair, to a box or to each of some boxes."""
    ends = x if isinstance(x, tuple) else (x, x)
    gap = np.maximum(0.0, np.maximum(low - ends[1], ends[0] - high))
    return np.square(gap, out=gap).sum(axis=-1)


def _facing(a: np.ndarray, b: np.ndarray, eps2: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the points of ``a`` and ``b`` that may be within eps of one on the other side."""
    none = np.zeros(0, int)
    if not (len(a) and len(b)):
        return none, none
    limit = eps2 * (1 + 1e-9)
    i = np.flatnonzero(_gap2(a, b.min(axis=0), b.max(axis=0)) <= limit)
    if not len(i):
        return none, none
    return i, np.flatnonzero(_gap2(b, a[i].min(axis=0), a[i].max(axis=0)) <= limit)


def _counted_inside(chunks: DataFrame, width: int, eps2: float, min_samples: int) -> DataFrame:
    """``chunks`` with ``near``, weights of each point's neighbours in its chunk, and ``open``, how many points may be core only with others' help."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near, open_ = [], []
            for r in batch.itertuples(index=False):
                x, w = _matrix(r.x, width), _ints(r.w).astype(np.float64)
                # a chunk of a sure leaf may be a part of it, and has all it needs there
                total = np.full(len(x), float(min_samples)) if r.sure else np.concatenate([within(x[part], x, eps2) @ w for part in steps(len(x), len(x))])
                near.append(total.tobytes())
                open_.append(int((total < min_samples).sum()))
            yield batch.assign(near=near, open=open_)

    return chunks.mapInPandas(count, f"{_CHUNK}, near binary, open bigint")


def _counted(pairs: DataFrame, chunks: DataFrame, width: int, eps2: float, min_samples: int, paths: list[str] | None = None) -> DataFrame:
    """(chunk, more): weights of the neighbours in other chunks, of those points that their own chunk leaves open."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"chunk": list(held), "more": [v.tobytes() for v in held.values()]})
            held.clear()
            return frame

        for batch in batches:
            for r in batch.itertuples(index=False):
                a, b = _matrix(r.x, width), _matrix(r.x_r, width)
                for chunk, near, x, others, w in ((r.chunk, r.near, a, b, r.w_r), (r.chunk_r, r.near_r, b, a, r.w)):
                    asking = x[np.frombuffer(near, np.float64) < min_samples]
                    i, j = _facing(asking, others, eps2)
                    if not (len(i) and len(j)):
                        continue
                    total, near_w = held.setdefault(chunk, np.zeros(len(asking))), _ints(w)[j].astype(np.float64)
                    for part in steps(len(i), len(j)):
                        total[i[part]] += within(asking[i[part]], others[j], eps2) @ near_w
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(n, np.float64) for n in group["more"])
        return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "more": [total.tobytes()]})

    open_ = chunks.filter("open > 0").select("chunk")
    some = pairs.filter("chunk <> chunk_r")
    some = some.join(open_, "chunk", "left_semi").union(some.join(open_.withColumnRenamed("chunk", "chunk_r"), "chunk_r", "left_semi").select("chunk", "chunk_r")).distinct()
    found = _beside(some, chunks, ["near", "w", "x"], count, "chunk bigint, more binary", paths)
    return found.groupBy("chunk").applyInPandas(add, "chunk bigint, more binary")


def _inside(x: np.ndarray, first: np.ndarray, eps2: float) -> np.ndarray:
    """Name of the group of each point: the least ``first`` among the points reached within eps from point to point."""
    near = np.zeros((len(x), len(x)), bool)
    for part in steps(len(x), len(x)):
        near[part] = within(x[part], x, eps2)
    names, left = np.empty(len(x), np.int64), np.ones(len(x), bool)
    while left.any():
        group = np.zeros(len(x), bool)
        front = np.flatnonzero(left)[:1]
        while len(front):
            group[front] = True
            reached = near[front].any(axis=0)
            front = np.flatnonzero(reached & ~group)
        names[group] = first[group].min()
        left &= ~group
    return names


def _grouped(chunks: DataFrame, counted: DataFrame, width: int, eps2: float, min_samples: int) -> DataFrame:
    """``chunks`` with ``core`` and, for core points, the name of their group."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            core, group = [], []
            for r in batch.itertuples(index=False):
                first, x = _ints(r.first), _matrix(r.x, width)
                if r.sure:
                    is_core, name = np.ones(len(first), bool), np.full(len(first), r.top, np.int64)
                else:
                    near = np.frombuffer(r.near, np.float64).copy()
                    if r.more is not None:
                        near[near < min_samples] += np.frombuffer(r.more, np.float64)
                    is_core = near >= min_samples
                    name = np.full(len(first), -1, np.int64)
                    name[is_core] = _inside(x[is_core], first[is_core], eps2)
                core.append(is_core.tobytes())
                group.append(name.tobytes())
            yield batch.drop(columns=["near", "open", "more"]).assign(core=core, group=group)

    return chunks.join(counted, "chunk", "left").mapInPandas(judge, f"{_CHUNK}, core binary, group binary")


@dataclass
class _Core:
    """The core points of a chunk by group, with the groups' boxes, and the others."""

    x: np.ndarray  # of core points, group by group
    group: np.ndarray
    starts: np.ndarray
    names: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rest: np.ndarray
    rest_first: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, core: np.ndarray, group: np.ndarray, first: np.ndarray) -> _Core:
        order = np.flatnonzero(core)[np.argsort(group[core], kind="stable")]
        names, starts = np.unique(group[order], return_index=True)
        mine, ends = x[order], [np.zeros((0, x.shape[1]))] * 2
        if len(order):
            ends = [f.reduceat(mine, starts, axis=0) for f in (np.minimum, np.maximum)]
        return cls(mine, group[order], np.append(starts, len(order)), names, *ends, x[~core], first[~core])

    def of_group(self, i: int) -> np.ndarray:
        return self.x[self.starts[i]:self.starts[i + 1]]


def _touch(a: np.ndarray, b: np.ndarray, eps2: float) -> bool:
    """Whether two points are within eps; ever more of them are compared."""
    i, j = _facing(a, b, eps2)
    if not (len(i) and len(j)):
        return False
    b, at, size = b[j], 0, 16
    while at < len(i):
        part = a[i[at:at + size]]
        if any(within(part, b[some], eps2).any() for some in steps(len(b), len(part), 64 * 1024)):
            return True
        at, size = at + size, min(4 * size, 1024)
    return False


def _linked(pairs: DataFrame, chunks: DataFrame, width: int, eps2: float, paths: list[str] | None = None) -> DataFrame:
    """(kind, u, v): links between groups (kind 0), and points that are not core beside a group they touch (kind 1).

    Groups that a task has found connected, over whichever others, are not compared again.
    """

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: set[tuple[int, int, int]] = set()
        above: dict[int, int] = {}
        # the right sides come again with each left one
        right: dict[int, _Core] = {}
        left: tuple[int | None, _Core | None] = (None, None)

        def root(u: int) -> int:
            while (v := above.get(u, u)) != u:
                above[u] = above.get(v, v)
                u = v
            return u

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(sorted(held), columns=["kind", "u", "v"])
            held.clear()
            return frame

        def join(u: int, v: int) -> None:
            if root(u) != root(v):
                above[root(u)] = root(v)
                held.add((0, u, v))

        def border(rest: np.ndarray, first: np.ndarray, of: _Core) -> None:
            i, j = _facing(rest, of.x, eps2)
            for part in steps(len(i), len(j)) if len(j) else ():
                p, q = np.nonzero(within(rest[i[part]], of.x[j], eps2))
                held.update(zip([1] * len(p), first[i[part]][p].tolist(), of.group[j][q].tolist()))

        def core_of(x: bytes, core: bytes, group: bytes, first: bytes) -> _Core:
            return _Core.of(_matrix(x, width), np.frombuffer(core, bool), _ints(group), _ints(first))

        for batch in batches:
            for r in batch.itertuples(index=False):
                if left[0] != r.chunk:
                    left = (r.chunk, core_of(r.x, r.core, r.group, r.first))
                a = left[1]
                if r.chunk == r.chunk_r:
                    border(a.rest, a.rest_first, a)  # groups of one chunk do not touch
                    continue
                if r.chunk_r not in right:
                    right[r.chunk_r] = core_of(r.x_r, r.core_r, r.group_r, r.first_r)
                b = right[r.chunk_r]
                border(a.rest, a.rest_first, b)
                border(b.rest, b.rest_first, a)
                for i, u in enumerate(a.names.tolist()):
                    near = np.flatnonzero(_gap2((a.low[i], a.high[i]), b.low, b.high) <= eps2 * (1 + 1e-9))
                    apart = [j for j in near.tolist() if root(u) != root(int(b.names[j]))]
                    if len(apart) > GROUPS_ALONE:
                        # many small groups are met together
                        mine, theirs = a.of_group(i), np.concatenate([np.arange(b.starts[j], b.starts[j + 1]) for j in apart])
                        for part in steps(len(mine), len(theirs), 1_000_000):
                            for v in np.unique(b.group[theirs[within(mine[part], b.x[theirs], eps2).any(axis=0)]]).tolist():
                                join(u, v)
                        continue
                    for j in apart:
                        v = int(b.names[j])
                        if root(u) != root(v) and _touch(a.of_group(i), b.of_group(j), eps2):
                            join(u, v)
                if len(held) >= HELD_LINKS:
                    yield out()
        if held:
            yield out()

    return _beside(pairs, chunks, ["first", "x", "core", "group"], link, "kind int, u bigint, v bigint", paths)


def dbscan_by_leaves(df: DataFrame, features: Sequence[str], key: str, eps: float, min_samples: int) -> DataFrame:
    """``(key, cluster)`` as ``density.dbscan`` returns it; a missing feature is refused."""
    width, eps2, spark = len(features), eps * eps, df.sparkSession
    paths = []

    def kept(made: DataFrame, tag: str) -> DataFrame:
        found, path = written(made, f"density-{tag}")
        paths.append(path)
        return found

    rows = kept(df.select(F.col(key).cast("bigint").alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")), "rows")
    points = kept(rows.groupBy("x").agg(F.min("id").alias("first"), F.count("*").alias("w")), "points")
    leaves = L.split(points, "x", width, LEAF_POINTS, "density-leaves", tight2=eps2 * (1 - 1e-6))
    boxes = kept(leaves.boxes("x", "x"), "boxes")
    chunks = kept(_counted_inside(kept(_chunks(leaves, boxes, eps2, min_samples), "chunks"), width, eps2, min_samples), "inside")
    pairs = kept(_meetings(leaves, boxes, chunks, eps2), "pairs")
    counted = kept(_counted(pairs, chunks, width, eps2, min_samples, paths), "counts")
    grouped = kept(_grouped(chunks, counted, width, eps2, min_samples), "groups")
    links = kept(_linked(pairs, grouped, width, eps2, paths).distinct(), "links")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                core = np.frombuffer(r.core, bool)
                yield pd.DataFrame({"first": _ints(r.first)[core], "v": _ints(r.group)[core]})

    core = kept(grouped.select("first", "core", "group").mapInPandas(members, "first bigint, v bigint"), "core")
    merged = connected_components(links.filter("kind = 0").select("u", "v"), "u", "v")
    names = kept(
        core.select("v").distinct().join(merged, F.col("v") == F.col("node"), "left").select("v", F.coalesce("component", "v").alias("component")), "names")
    touched = core.union(links.filter("kind = 1").select("u", "v")).join(names, "v").groupBy("first").agg(F.min("component").alias("component"))
    numbers = value_codes(names, ["component"]).select(F.col("value").alias("component"), F.col("code").alias("cluster"))
    labels = touched.join(numbers, "component").select("first", "cluster")
    # a point's copies have its vector; points of one row are found by its key
    copies = points.filter("w > 1").select("x", "first")
    homes = rows.join(copies, "x", "left").select("id", F.coalesce("first", "id").alias("first")) if not copies.isEmpty() else rows.select("id", F.col("id").alias("first"))
    found, path = written(homes.join(labels, "first", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")), "density-labels")
    for p in paths:
        remove(spark, p)
    return found
