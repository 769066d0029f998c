"""Exact density-based clustering (eps, min_samples) by cells; by leaves in many dimensions.

Cells have a diagonal of eps, so the rows of one cell are neighbours of each other: a cell with
``min_samples`` rows consists of core rows, however many it holds, and none of its pairs are ever
compared. Rows are compared only

* from a sparse cell (fewer than ``min_samples`` rows) to the cells within reach, and
* between two dense cells whose sub-boxes leave their distance undecided.

Clusters are then the connected components of the graph of cells, which is far smaller than the
table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.operators.components import connected_components
from tabscope.operators.density_leaves import dbscan_by_leaves
from tabscope.operators.ranks import value_codes
from tabscope.scratch import materialize

# how often a dense cell is split per dimension when two dense cells are compared
SPLITS = {1: 8, 2: 4, 3: 2}
# up to here a cell has a bounded number of neighbouring cells, which equal keys can find; beyond it, see density_leaves
GRID_DIMS = 3
# rows of a dense cell in one chunk
CELL_CHUNK = 20_000


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _distance2(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return _total([(a - b) * (a - b) for a, b in zip(left, right)])


def _gap2(low_a, high_a, low_b, high_b) -> Column:
    """Squared distance between two boxes (a point is a box without extent)."""
    gaps = [F.greatest(F.lit(0.0), lb - ha, la - hb) for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b)]
    return _total([g * g for g in gaps])


def _cols(prefix: str, p: int, side: str = "") -> list[Column]:
    return [F.col(f"{side}{prefix}{i}") for i in range(p)]


def _renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def _pairs_by_grid(cells: DataFrame, p: int, eps: float) -> DataFrame:
    """Ordered pairs of different cells whose boxes come within eps of each other, by equal keys.

    Two such cells differ by at most one coarse step, so each cell is offered to its neighbouring
    coarse keys.
    """
    key = [F.floor(F.col(f"lo{d}") / F.lit(2 * eps)).alias(f"k{d}") for d in range(p)]
    keyed = cells.select("*", *key)
    steps = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in step]) for step in product((-1, 0, 1), repeat=p)])
    offered = keyed.withColumn("step", F.explode(steps))
    offered = offered.withColumns({f"k{d}": F.col(f"k{d}") + F.col("step")[d] for d in range(p)}).drop("step")
    right = _renamed(keyed, "_r").withColumnsRenamed({f"k{d}_r": f"k{d}" for d in range(p)})
    near = _gap2(
        _cols("lo", p), _cols("hi", p), [F.col(f"lo{i}_r") for i in range(p)], [F.col(f"hi{i}_r") for i in range(p)]
    ) <= eps * eps
    return (
        offered.join(right, [f"k{d}" for d in range(p)])
        .filter((F.col("cell") != F.col("cell_r")) & near)
        .select("cell", F.col("cell_r").alias("other"), "dense", F.col("dense_r").alias("other_dense"))
    )


def _dense_links(dense_rows: DataFrame, pairs: DataFrame, p: int, eps: float) -> DataFrame:
    """Pairs ``(cell, other)`` of dense cells that hold two rows within eps of each other."""
    eps2 = eps * eps
    splits, side = SPLITS.get(p, 1), eps / sqrt(p)
    sub = F.array(*[F.floor(F.col(f"x{i}") / F.lit(side / splits)) for i in range(p)])
    marked = dense_rows.withColumn("sub", sub)
    # the outermost rows of a box in each direction: if two of them are close, the cells are linked
    point = F.array(*_cols("x", p))
    boxes = materialize(
        marked.groupBy("cell", "sub").agg(
            *[F.min(f"x{i}").alias(f"lo{i}") for i in range(p)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(p)],
            F.array(*[by(point, F.col(f"x{i}")) for i in range(p) for by in (F.min_by, F.max_by)]).alias("reps"),
        ),
        "sub-boxes",
    )
    left, right = _renamed(boxes, "_a"), _renamed(boxes, "_b")
    both = (
        pairs.join(left, F.col("cell") == F.col("cell_a")).join(right, F.col("other") == F.col("cell_b"))
        .withColumn("gap2", _gap2(*[[F.col(f"{n}{i}_{s}") for i in range(p)] for s in "ab" for n in ("lo", "hi")]))
        .withColumn("linked", F.exists("reps_a", lambda a: F.exists(
            "reps_b", lambda b: _distance2([a[i] for i in range(p)], [b[i] for i in range(p)]) <= eps2)))
        .filter(F.col("gap2") <= eps2)
    )
    judged = materialize(
        both.groupBy("cell", "other").agg(F.max("linked").alias("sure"),
                                          F.collect_set(F.struct("sub_a", "sub_b")).alias("subs")),
        "sub-pairs",
    )
    sure = judged.filter("sure").select("cell", "other")
    # what the sub-boxes leave open is decided on the rows: those near the opposite sub-box only
    open_ = judged.filter("not sure").select("cell", "other", F.explode("subs").alias("s")).select(
        "cell", "other", F.col("s.sub_a").alias("sub_a"), F.col("s.sub_b").alias("sub_b")
    )
    rows_a = marked.select(F.col("cell"), F.col("sub").alias("sub_a"), *[F.col(f"x{i}").alias(f"a{i}") for i in range(p)])
    rows_b = marked.select(F.col("cell").alias("other"), F.col("sub").alias("sub_b"), *[F.col(f"x{i}").alias(f"b{i}") for i in range(p)])
    box_a = _renamed(boxes.drop("reps"), "_a").withColumnsRenamed({"cell_a": "cell"})
    box_b = _renamed(boxes.drop("reps"), "_b").withColumnsRenamed({"cell_b": "other"})
    a, b = _cols("a", p), _cols("b", p)
    near_a = (
        open_.join(box_b, ["other", "sub_b"]).join(rows_a, ["cell", "sub_a"])
        .filter(_gap2(a, a, [F.col(f"lo{i}_b") for i in range(p)], [F.col(f"hi{i}_b") for i in range(p)]) <= eps2)
        .select("cell", "other", "sub_a", "sub_b", *a)
    )
    near_b = (
        open_.join(box_a, ["cell", "sub_a"]).join(rows_b, ["other", "sub_b"])
        .filter(_gap2(b, b, [F.col(f"lo{i}_a") for i in range(p)], [F.col(f"hi{i}_a") for i in range(p)]) <= eps2)
        .select("cell", "other", "sub_a", "sub_b", *b)
    )
    decided = near_a.join(near_b, ["cell", "other", "sub_a", "sub_b"]).filter(_distance2(a, b) <= eps2)
    return sure.union(decided.select("cell", "other").distinct())


def dbscan(
    df: DataFrame, features: Sequence[str], key: str, eps: float = 0.5, min_samples: int = 5
) -> DataFrame:
    """``(key, cluster)``: clusters numbered from 0 by their smallest core key, noise is -1.

    A row is core when at least ``min_samples`` rows, itself included, lie within eps. A row near
    several clusters without being core joins the one with the smallest core key.
    """
    p, eps2 = len(features), eps * eps
    if p > GRID_DIMS:
        return dbscan_by_leaves(df, features, key, eps, min_samples)
    # a hair under eps on the diagonal, so rounding cannot put a farther pair into one cell
    side = eps / sqrt(p) * (1 - 1e-9)
    x = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    placed = df.select(F.col(key).cast("bigint").alias("id"), *x)
    rows = placed.withColumn("cell", F.array(*[F.floor(F.col(f"x{i}") / F.lit(side)) for i in range(p)]))
    rows = materialize(rows, "cells-rows")

    cells = rows.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("id").alias("first"),
        *[F.min(f"x{i}").alias(f"lo{i}") for i in range(p)], *[F.max(f"x{i}").alias(f"hi{i}") for i in range(p)],
    ).withColumn("dense", F.col("n") >= min_samples)
    cells = materialize(cells, "cells")
    pairs = materialize(_pairs_by_grid(cells, p, eps), "cell-pairs")

    marked = rows.join(cells.select("cell", "dense", "n"), "cell")
    sparse = materialize(marked.filter(~F.col("dense")).drop("dense"), "sparse-rows")
    dense = materialize(marked.filter("dense").drop("dense", "n"), "dense-rows")

    # neighbours of the rows of sparse cells; towards a dense cell only their number matters
    asking = sparse.join(pairs.filter(~F.col("dense")).select("cell", "other", "other_dense"), "cell")
    mine = _cols("x", p)
    theirs = [F.col(f"y{i}") for i in range(p)]

    def others(source: DataFrame) -> DataFrame:
        return source.select(F.col("cell").alias("other"), F.col("id").alias("oid"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(p)])

    # a dense cell is met in chunks of its rows, each beside all askers: no task holds a hot cell
    chunks = F.ceil(F.col("n") / F.lit(CELL_CHUNK)).cast("int")
    times = cells.filter("dense").select(F.col("cell").alias("other"), chunks.alias("chunks"))
    many = asking.filter("other_dense").join(times, "other").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    parts = others(dense).join(times, "other").withColumn("chunk", F.pmod(F.xxhash64("oid"), "chunks").cast("int")).drop("chunks")
    near_dense = materialize(
        many.join(parts, ["other", "chunk"]).filter(_distance2(mine, theirs) <= eps2)
        .groupBy("id", "cell", "other").agg(F.count("*").alias("near")),
        "near-dense",
    )
    near_sparse = materialize(
        asking.filter(~F.col("other_dense")).join(others(sparse), "other").filter(_distance2(mine, theirs) <= eps2)
        .select("id", "cell", "oid", "other"),
        "near-sparse",
    )
    found = near_dense.select("id", "near").union(near_sparse.groupBy("id").agg(F.count("*").alias("near")))
    reached = found.groupBy("id").agg(F.sum("near").alias("near"))
    sparse_core = materialize(
        sparse.join(reached, "id", "left").filter(F.col("n") + F.coalesce("near", F.lit(0)) >= min_samples).select("id", "cell"),
        "sparse-core",
    )

    # a vertex per cell with core rows, named by the smallest of them
    vertices = cells.filter("dense").select("cell", F.col("first").alias("v")).union(
        sparse_core.groupBy("cell").agg(F.min("id").alias("v"))
    )
    vertices = materialize(vertices, "vertices")
    core = sparse_core.select("id")
    links = [
        _dense_links(dense, pairs.filter("dense and other_dense and cell < other").select("cell", "other"), p, eps),
        near_dense.join(core, "id", "left_semi").select("cell", "other"),
        near_sparse.join(core, "id", "left_semi")
        .join(core.withColumnRenamed("id", "oid"), "oid", "left_semi").select("cell", "other"),
    ]
    named = (
        reduce(lambda l, r: l.union(r), links).distinct()
        .join(vertices, "cell").join(vertices.select(F.col("cell").alias("other"), F.col("v").alias("w")), "other")
        .select("v", "w")
    )
    merged = connected_components(named, "v", "w")
    cell_label = materialize(
        vertices.join(merged, F.col("v") == F.col("node"), "left")
        .select("cell", F.coalesce("component", "v").alias("component")),
        "cell-labels",
    )

    other_label = cell_label.select(F.col("cell").alias("other"), "component")
    sparse_labels = (
        sparse_core.join(cell_label, "cell").select("id", "component")
        .union(
            near_dense.join(core, "id", "left_anti").join(other_label, "other").select("id", "component")
        )
        .union(
            near_sparse.join(core.withColumnRenamed("id", "oid"), "oid", "left_semi").join(core, "id", "left_anti")
            .join(other_label, "other").select("id", "component")
        )
        # a core row may share the sparse cell of a row that is not core
        .union(
            sparse.join(core, "id", "left_anti").join(cell_label, "cell").select("id", "component")
        )
        .groupBy("id").agg(F.min("component").alias("component"))
    )
    labelled = dense.join(cell_label, "cell").select("id", "component").union(
        sparse.select("id").join(sparse_labels, "id", "left").select("id", "component")
    )
    numbers = value_codes(cell_label, ["component"]).select(F.col("value").alias("component"), F.col("code").alias("cluster"))
    return labelled.join(numbers, "component", "left").select(
        F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")
    )
