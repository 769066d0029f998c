"""Vector code compression: product codes of integer vectors, codebooks learned over Hilbert-sorted blocks.

A component x becomes floor(``SCALE`` * x). Vectors are cut into ``PARTS`` equal parts, each with a
codebook of up to ``ENTRIES`` entries, first the parts of the smallest ids. The parts of a run of
rows (``RUN_ROWS`` at most) are sorted along a Hilbert curve and laid into flat blocks of ``BLOCK``
with the least and greatest components and the sums of the block. In a round, distances from a
block's box to the entries form its shortlist: the entry of the least greatest distance is compared
with each other one at the corner of the box where that one does best, and what loses even there is
nearest to none of the block. A block with one entry left adds its sums; the others are evaluated by
an integer kernel over their shortlist. Blocks are written once and read in
each round; only sums per entry reach the driver, one number for each component of the codebooks.
The last assignment runs the same blocks over the rows themselves, so no row is shuffled.

Edge cases: rows whose vector is null or holds null or non-finite components go; null ids have codes but
start no entry, of one id repeated the least vector does; fewer than ``ENTRIES`` ids make a smaller
codebook, and without any id codes and errors are zero; equal rows stay rows; empty vectors have code zero; an empty table gives no rows; other columns
are not read. Vectors of several lengths, of one that ``PARTS`` does not divide, or with components so
large that a squared distance leaves 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabscope.scratch import materialize, remove, written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
BLOCK = 64  # parts of a block
RUN_ROWS = 1 << 15  # rows that are sorted together
RUN_NUMBERS = 1 << 22  # and the components they hold at most, for long vectors

Codebooks = list[list[list[int]]]  # by part, entry, place


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def integers(column: pa.Array) -> np.ndarray:
    """Rows of integers from an Arrow list column without nulls."""
    lengths = np.unique(np.diff(np.asarray(column.offsets)))
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {lengths.tolist()}")
    n = int(lengths[0]) if len(lengths) else 0
    if n % PARTS:
        raise ValueError(f"vectors of {n} components cannot be cut into {PARTS} equal parts")
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    # two parts differ by twice the largest component at most; their squares are added up, and such sums
    if scaled.size and n // PARTS * (2 * np.abs(scaled).max()) ** 2 >= 2.0**61:
        raise ValueError("components too large: a squared distance would leave 64 bits")
    return scaled.astype(np.int64).reshape(len(column), n)


def hilbert_order(points: np.ndarray) -> np.ndarray:
    """Order of points along a Hilbert curve through a grid of their box.

    The grid has as many bits for each component as fit into 62, one at least: components beyond
    the 63rd do not count. Points of one cell keep their order.
    """
    points = points[:, :63]
    n, d = points.shape
    if not n or not d:
        return np.arange(n)
    bits = max(1, 62 // d)
    low = points.min(0)
    span = np.maximum(points.max(0) - low, 1).astype(np.float64)
    axes = np.minimum((points - low) / span * (1 << bits), (1 << bits) - 1).astype(np.int64)
    # to the curve's transposed form: undo the rotations from the highest bit down, then take the Gray code
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(d):
            high = (axes[:, k] & q) != 0
            swap = np.where(high, 0, (axes[:, 0] ^ axes[:, k]) & p)
            axes[:, 0] = np.where(high, axes[:, 0] ^ p, axes[:, 0] ^ swap)
            axes[:, k] ^= swap
        q >>= 1
    for k in range(1, d):
        axes[:, k] ^= axes[:, k - 1]
    flip = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((axes[:, d - 1] & q) != 0, q - 1, 0)
        q >>= 1
    axes ^= flip[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for k in range(d):
            key = key << 1 | (axes[:, k] >> b & 1)
    return np.argsort(key, kind="stable")


class Blocks:
    """Parts of one position, flat in Hilbert order, with the boxes and sums of their blocks."""

    def __init__(self, points: np.ndarray):
        self.order = hilbert_order(points)
        self.points = np.ascontiguousarray(points[self.order])
        self.starts = np.arange(0, len(points), BLOCK)
        self.low, self.high = (f.reduceat(self.points, self.starts) for f in (np.minimum, np.maximum))
        self.sums = np.add.reduceat(self.points, self.starts)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """By block and entry, whether the entry may be nearest (or as near) to a point of the block's box.

    The rival of all entries is the one whose farthest point of the box is nearest. How much farther
    than the rival an entry is changes linearly over the box, so its least value is at a corner.
    """
    low, high, e = low[:, None], high[:, None], entries[None]
    far = np.maximum(np.abs(e - low), np.abs(high - e))
    rival = (far * far).sum(2).argmin(1)
    squares = (entries * entries).sum(1)
    gap = e - entries[rival][:, None]
    corner = np.where(gap > 0, high, low)
    return squares[None] - squares[rival][:, None] <= 2 * (corner * gap).sum(2)


def kernel(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the nearest entry of each point, the first of equals."""
    gaps = points[:, None] - entries[None]
    distances = np.einsum("ijk,ijk->ij", gaps, gaps)
    best = distances.argmin(1)
    return best, distances[np.arange(len(points)), best]


def assign(blocks: Blocks, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) by row."""
    codes = np.empty(len(blocks.points), np.int64)
    errors = np.empty(len(blocks.points), np.int64)
    for start, open_ in zip(blocks.starts, shortlists(blocks.low, blocks.high, entries)):
        few = np.flatnonzero(open_)
        best, distance = kernel(blocks.points[start : start + BLOCK], entries[few])
        at = blocks.order[start : start + BLOCK]
        codes[at], errors[at] = few[best], distance
    return codes, errors


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined to runs of a bounded number of rows and components."""
    held, rows, numbers = [], 0, 0
    for batch in batches:
        # a batch may itself be long: cut it where a run is full
        width = max(1, len(batch.column(batch.num_columns - 1).flatten()) // max(1, batch.num_rows))
        step = max(1, min(RUN_ROWS, RUN_NUMBERS // width))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            if held and (rows + piece.num_rows > RUN_ROWS or numbers + piece.num_rows * width > RUN_NUMBERS):
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows, numbers = [], 0, 0
            held.append(piece)
            rows, numbers = rows + piece.num_rows, numbers + piece.num_rows * width
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name).combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def _parts(vectors: np.ndarray) -> list[np.ndarray]:
    width = vectors.shape[1] // PARTS
    return [vectors[:, p * width : (p + 1) * width] for p in range(PARTS)]


_BLOCK = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("low", "high", "sums", "points"))])
_SUM = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("total", T.LongType())])


def _blocks(kept: DataFrame) -> DataFrame:
    """All blocks of all rows: part, low, high, sums, points (64-bit integers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            for part, points in enumerate(_parts(integers(_column(rows, "vector")))):
                b = Blocks(points)
                flat = [b.points[s : s + BLOCK].tobytes() for s in b.starts]
                columns = [pa.array([part] * len(flat), pa.int32()), *(pa.array([x.tobytes() for x in m], pa.binary()) for m in (b.low, b.high, b.sums)), pa.array(flat, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=_BLOCK.names)

    return kept.select("vector").mapInArrow(run, _BLOCK)


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), width)


def _sums(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, place, total): sums of the components nearest to each entry; place -1 counts the parts."""
    width = len(books[0][0])
    tables = [np.array(b, np.int64).reshape(len(b), width) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((PARTS, len(tables[0]), width + 1), np.int64)
        for batch in batches:
            part_of = batch.column(0).to_numpy()
            low, high, total = (_numbers(batch.column(k), width) for k in (1, 2, 3))
            points = batch.column(4)
            for part in np.unique(part_of):
                mine = np.flatnonzero(part_of == part)
                open_ = shortlists(low[mine], high[mine], tables[part])
                for i, few in zip(mine, map(np.flatnonzero, open_)):
                    flat = np.frombuffer(points[int(i)].as_buffer(), np.int64).reshape(-1, width)
                    if len(few) == 1:
                        sums[part, few[0], :-1] += total[i]
                        sums[part, few[0], -1] += len(flat)
                        continue
                    best, _ = kernel(flat, tables[part][few])
                    picked = (best[None] == np.arange(len(few))[:, None]).astype(np.int64)
                    sums[part, few, :-1] += picked @ flat
                    sums[part, few, -1] += picked.sum(1)
        p, e, k = (x.ravel() for x in np.indices(sums.shape))
        columns = [pa.array(c, pa.int32()) for c in (p, e, np.where(k == width, -1, k))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sums.ravel(), pa.int64())], names=_SUM.names)

    return blocks.mapInArrow(run, _SUM)


def _first_entries(kept: DataFrame, id_type: T.DataType) -> Codebooks:
    """The parts of the smallest distinct ids, found task by task."""
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("ints", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in batches:
            ids = batch.column(0)
            limit = max(least) if len(least) == ENTRIES else None
            near = [i for i, v in enumerate(ids.to_pylist()) if v is not None and (limit is None or v <= limit)]
            found: dict = {}
            for i in near:
                found.setdefault(ids[i].as_py(), []).append(i)
            for v in sorted(found)[:ENTRIES]:
                rows = integers(batch.column(1).take(pa.array(found[v], pa.int64()))).tolist()
                least[v] = min([*rows, *([least[v]] if v in least else [])])
            least = {v: least[v] for v in sorted(least)[:ENTRIES]}
        yield pa.RecordBatch.from_arrays([pa.array(list(least), to_arrow_type(id_type)), pa.array(list(least.values()), pa.list_(pa.int64()))], names=schema.names)

    some = kept.select("vec_id", "vector").mapInArrow(run, schema)
    first = some.groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy("vec_id").limit(ENTRIES).collect()
    return [[list(r["ints"][p * (len(r["ints"]) // PARTS) : (p + 1) * (len(r["ints"]) // PARTS)]) for r in first] for p in range(PARTS)]


def codebooks(kept: DataFrame, id_type: T.DataType, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of rows (vec_id, vector) after ``rounds`` rounds."""
    books = _first_entries(kept, id_type)
    if not books[0] or not books[0][0]:
        return books
    blocks, path = written(_blocks(kept), "codes-blocks")
    for _ in range(rounds):
        found = _sums(blocks, books).groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
        total = {(r["part"], r["entry"], r["place"]): int(r["total"]) for r in found}
        books = [
            [[total[p, e, k] // total[p, e, -1] for k in range(len(old))] if total.get((p, e, -1)) else old for e, old in enumerate(book)]
            for p, book in enumerate(books)]
    remove(kept.sparkSession, path)
    return books


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """``kept`` with code (bytes, one per part) and error in place of the vector."""
    tables = [np.array(b, np.int64) for b in books]
    rest = [f for f in kept.schema.fields if f.name != "vector"]
    schema = T.StructType([*rest, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            codes = np.zeros((rows.num_rows, PARTS), np.uint8)
            errors = np.zeros(rows.num_rows, np.int64)
            vectors = integers(_column(rows, "vector"))
            for part, points in enumerate(_parts(vectors) if vectors.shape[1] and len(tables[0]) else []):
                codes[:, part], error = assign(Blocks(points), tables[part])
                errors += error
            columns = [*(_column(rows, f.name) for f in rest), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.select(*[f.name for f in rest], "vector").mapInArrow(run, schema)


def compressed(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(rows of vec_id, label, code, error; codebooks) of the usable vectors."""
    kept = vectors.select(F.col(id_column).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(usable(F.col("vector")))
    books = codebooks(kept, vectors.schema[id_column].dataType, rounds)
    return encode(kept, books), books


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex digits, error, the errors summed by label, and a digest of the codebooks."""
    found, books = compressed(vectors)
    rows = materialize(found, "codes")
    # a written table of sums has a measured size: Spark sends it to the rows if it is small
    sums = materialize(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error")), "codes-labels")
    joined = rows.join(sums.withColumnRenamed("label", "__label"), F.col("label").eqNullSafe(F.col("__label")))
    digits = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(PARTS)), lambda i: F.lower(F.lpad(F.hex(F.substr("code", i, F.lit(1))), 2, "0"))))
    return joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
