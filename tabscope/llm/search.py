"""Ranked lexical search: an Aho-Corasick automaton of the items' terms reads the documents' texts.

No index of the documents is kept. The automaton holds every item term between two blanks; texts are
lower-cased (A-Z), every other separator becomes a blank, and a blank stands at both ends, so a
pattern matches whole terms only. One pass over all texts counts N, L and the terms' document
frequencies, a second one counts the terms of each text again and scores it for the items that hold
them. A task keeps the ``TOP`` best documents of each item; these are ranked twice, by slot and then by
item, so the last step reads a bounded number of rows from each slot.

The items go out in blocks of about ``BLOCK_BYTES`` of text, chosen by a hash of their id; each block
is an automaton that is broadcast, used for the two passes, and destroyed when its rows are written.

Edge cases: null and empty texts have no terms, and neither they nor items without terms get rows;
items of one id (null included) are one item with the terms of all; repeated documents stay rows, and
of equal scores the smaller doc_id comes first, a null one last; very long texts are read whole; empty
tables give no rows; other columns are not read. An item's distinct terms must fit into a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabscope.scratch import materialize

TOP = 50
BLOCK_BYTES = 1 << 20  # text of the items of one automaton
SLOTS = 64  # groups in which the candidates of an item are ranked first
CELLS = 1 << 20  # scores of texts by items that a task holds at once

_BLANKED = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def blanked(text: bytes) -> bytes:
    """Terms in lower case between single bytes of blank, one at both ends."""
    return b" " + text.translate(_BLANKED) + b" "


def n_terms(text: bytes) -> int:
    """Number of terms of a blanked text."""
    inside = np.frombuffer(text, np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class Block:
    """Items and their terms: the automaton, and for each term the items that hold it."""

    def __init__(self, items: dict):
        self.ids = list(items)
        numbers: dict[bytes, int] = {}
        pairs = []
        for k, terms in enumerate(items.values()):
            for term in sorted(terms):
                pairs.append((numbers.setdefault(term, len(numbers)), k))
        self.n_terms = len(numbers)
        pairs.sort()
        terms, self.items = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        self.starts = np.searchsorted(terms, np.arange(len(numbers) + 1))
        self.automaton = ahocorasick.Automaton()
        for term, number in numbers.items():
            self.automaton.add_word(f" {term.decode('latin-1')} ", number)
        self.automaton.make_automaton()

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(terms, occurrences) in a blanked text. A byte is a character of the automaton."""
        found = Counter(map(itemgetter(1), self.automaton.iter(text.decode("latin-1"))))
        return np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
    """(doc_id, blanked text) of the texts that have a term."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for i in range(batch.num_rows):
            if texts[i].is_valid:
                text = blanked(texts[i].as_py())
                if text.strip():
                    yield ids[i].as_py(), text


def _counted(docs: DataFrame, block, whole: bool) -> DataFrame:
    """(term, n) of all documents: documents holding the term; for term -1 and -2, N and L if ``whole``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, df, n_docs, length = block.value, None, 0, 0
        df = np.zeros(search.n_terms, np.int64)
        for _, text in _texts(batches):
            df[search.counts(text)[0]] += 1
            if whole:
                n_docs, length = n_docs + 1, length + n_terms(text)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*held.tolist(), -1, -2], pa.int64()), pa.array([*df[held].tolist(), n_docs, length], pa.int64())], names=["term", "n"])

    return docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Best:
    """The ``top`` best (score, document) of each item, of a task."""

    def __init__(self, n_items: int, top: int):
        self.top, self.parts, self.held = top, [], 0
        self.ids: list = []  # of the texts, by number
        self.least = np.zeros(n_items, np.int64)  # a score below it is out

    def add(self, scores: np.ndarray) -> None:
        """``scores`` of the last texts of ``ids`` by items."""
        rows, items = np.nonzero((scores > 0) & (scores >= self.least))
        self.parts.append((items, scores[rows, items], rows + len(self.ids) - len(scores)))
        self.held += len(rows)
        if self.held > 4 * self.top * len(self.least) + CELLS:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, scores, texts): keep the best of each item, the smaller id first among equal scores, a null one last."""
        empty = np.zeros(0, np.int64)
        items, scores, rows = (np.concatenate(c) for c in zip((empty, empty, empty), *self.parts))
        held, places = np.unique(rows, return_inverse=True)
        by_id = sorted(range(len(held)), key=lambda i: (self.ids[held[i]] is None, self.ids[held[i]] or 0))
        ranks = np.empty(len(held), np.int64)
        ranks[by_id] = np.arange(len(held))
        order = np.lexsort((ranks[places], -scores, items))
        items, scores, rows = items[order], scores[order], rows[order]
        keep = np.arange(len(items)) - np.searchsorted(items, items) < self.top
        items, scores, rows = items[keep], scores[keep], rows[keep]
        starts = np.searchsorted(items, np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(starts) == self.top)
        self.least[full] = scores[starts[full] + self.top - 1]
        self.parts, self.held = [(items, scores, rows)], len(rows)
        return self.parts[0]


def _scored(docs: DataFrame, block, weights, n_docs: int, length: int, top: int, id_type: T.DataType) -> DataFrame:
    """(item, doc_id, score): the best of each task. ``item`` is the place in the block's ids."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, w = block.value, weights.value
        n_items = len(search.ids)
        best = Best(n_items, top)
        scores = np.zeros((max(1, CELLS // max(1, n_items)), n_items), np.int64)
        used = 0
        for doc_id, text in _texts(batches):
            terms, tf = search.counts(text)
            m = 50 + (50 * n_terms(text) * n_docs) // length
            parts = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            n = search.starts[terms + 1] - search.starts[terms]
            places = np.repeat(search.starts[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())
            np.add.at(scores[used], search.items[places], np.repeat(parts, n))
            best.ids.append(doc_id)
            used += 1
            if used == len(scores):
                best.add(scores)
                scores[:] = 0
                used = 0
        best.add(scores[:used])
        items, found, rows = best.cut()
        columns = [pa.array(items, pa.int64()), pa.array([best.ids[i] for i in rows], to_arrow_type(id_type)), pa.array(found, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))


def _first(rows: DataFrame, top: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item, best first."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    given = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    total = given.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    found, n_docs, length = [], 0, 0
    for k in range(blocks):
        terms: dict = {}
        for r in given.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toLocalIterator():
            terms.setdefault(r["item_id"], set()).update(blanked(bytes(r["text"] or b"")).split())
        terms = {i: t for i, t in terms.items() if t}
        if not terms:
            continue
        mine = Block(terms)
        block = spark.sparkContext.broadcast(mine)
        counted = {r["term"]: r["n"] for r in _counted(texts, block, not found).collect()}
        if not found:
            n_docs, length = counted.get(-1, 0), counted.get(-2, 0)
        df = np.array([counted.get(t, 0) for t in range(mine.n_terms)])
        weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64))
        best = _first(_first(_scored(texts, block, weights, n_docs, max(1, length), top, id_type), top, "item", "slot").drop("rank"), top, "item")
        names = spark.createDataFrame(list(enumerate(mine.ids)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
        found.append(materialize(best.join(names, "item").select("item_id", "rank", "doc_id", "score"), "search"))
        block.destroy()
        weights.destroy()
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.unionByName, found)
