"""Held-out documents and bounded training samples, both decided by a document's id alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == fold


PIECES = 20  # a text takes at most this part of its label's bound


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 64).cast("long").alias("size")  # 64: a row is never free


def bounded_sample(rows: DataFrame, label: str, text: str, bytes_per_label: int, key: str = "doc_id") -> DataFrame:
    """Pieces of ``rows`` picked by hash: about ``bytes_per_label`` bytes of text for each label.

    A text counts with its first ``bytes_per_label`` / ``PIECES`` characters, so a few very long ones
    neither hide their label nor starve its short ones. Besides, the row of the lowest hash of every
    label is taken whatever its place, so no label is without text. Labels of any number are sampled.
    """
    most = max(1, bytes_per_label // PIECES)
    pieces = rows.filter(F.col(label).isNotNull()).withColumn(text, F.substring(F.col(text), 1, most))
    sums = pieces.select(label, _place(key).alias("place"), _size(text)).groupBy(label).agg(F.sum("size").alias("size"), F.min("place").alias("least"))
    shares = sums.select(label, F.greatest(F.lit(bytes_per_label) / F.greatest("size", F.lit(1)), F.col("least")).alias("__share"))
    return pieces.join(F.broadcast(shares), label).filter(_place(key) <= F.col("__share")).drop("__share").select(*rows.columns)


def labelled_sample(docs: DataFrame, marks: DataFrame, label: str, text: str, bytes_per_label: int, max_labels: int, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(sample, sized): like ``bounded_sample`` when the labels are a table of (key, label), of the ``max_labels`` most frequent ones.

    Only keys and sizes meet the labels in a shuffle (``sized``). The picked keys, at most one for
    64 bytes of the bound, go out to the documents, so no text is moved but that of the sample.
    """
    most = max(1, bytes_per_label // PIECES)
    pieces = docs.withColumn(text, F.substring(F.col(text), 1, most))
    marks = marks.select(key, label).filter(F.col(label).isNotNull()).distinct()
    sized = pieces.select(key, _size(text)).join(marks, key)
    sums = sized.groupBy(label).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min(_place(key)).alias("least"))
    wanted = F.lit(-1.0)
    for row in sums.orderBy(F.desc("n"), label).limit(max_labels).collect():
        share = max(bytes_per_label / max(row["size"], 1), row["least"])
        wanted = F.when(F.col(label) == F.lit(row[label]), F.lit(share)).otherwise(wanted)
    return pieces.join(F.broadcast(marks.filter(_place(key) <= wanted)), key), sized
