"""Arrow batches in, Arrow batches out: the shape of every Python task of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SHARD_BYTES = 1 << 20  # texts worked on together in a task; a longer text is worked on alone


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names (in any case), which an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in taken])


def with_columns_from(df: DataFrame, column: str, fields: T.StructType, fn: Callable[[list[bytes | None]], dict]) -> DataFrame:
    """Add the columns ``fields`` that ``fn`` computes from the bytes of one text column.

    ``fn`` gets a shard of texts (UTF-8, None for null) and returns a list or array per field. Shards
    hold whole texts; columns of the same names are replaced. Rows keep all other columns.
    """
    base = without(df, *fields.names)
    schema = T.StructType(base.schema.fields + fields.fields)
    types = {f.name: to_arrow_type(f.dataType) for f in fields}

    # texts among the columns are read there; other types, and names in another case, are handed over besides
    alike = [i for i, c in enumerate(base.columns) if c.lower() == column.lower()]
    stays = len(alike) == 1 and base.columns[alike[0]] == column and isinstance(base.schema[alike[0]].dataType, (T.StringType, T.BinaryType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select(range(batch.num_columns - (not stays)))
            texts = batch.column(alike[0] if stays else batch.num_columns - 1)
            for start, stop in ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                # only one shard of texts at a time leaves Arrow's memory
                made = fn(texts.slice(start, stop - start).cast(pa.binary()).to_pylist())
                columns = [rest.column(i).slice(start, stop - start) for i in range(rest.num_columns)]
                columns += [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], types[n]) for n in fields.names]
                yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, *fields.names])
                del made, columns
            del batch, rest, texts  # before the next batch is read
        pa.default_memory_pool().release_unused()

    carried = base if stays else base.withColumn("__utf8", F.col(f"`{column}`").cast("binary"))
    return carried.mapInArrow(run, schema)


def shards(texts: list[bytes | None], limit: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; one longer text is a range of its own."""
    return ranges([len(t or b"") for t in texts], limit)


def ranges(sizes: list[int], limit: int = SHARD_BYTES) -> Iterator[tuple[int, int]]:
    """Like ``shards``, of texts of these sizes."""
    start, size = 0, 0
    for i, more in enumerate(sizes):
        if i > start and size + more > limit:
            yield start, i
            start, size = i, 0
        size += more
    if start < len(sizes):
        yield start, len(sizes)
