"""Language-model scores: exact add-one unigrams, and a bigram model in a log-frequency Bloom filter.

One pass turns every shard of texts into one row: its numbered words, its list of distinct words and
their training counts, packed. From these rows come, by block of hash values, the shards' word lists
(summed over the shards and sent back as counts by word number) and the shards' bigrams (training
counts summed, quantised, and set into the block's filter, which is probed for the same lists; the
levels found go back to the shards). No filter leaves its block, so every training bigram has an entry
at any size of the corpus. Tokens themselves are never shuffled one by one, and a frequent word or
bigram is one entry per shard.

Edge cases: null and empty texts are the end token alone; without training documents every score is
log10(1) = 0; a null doc_id counts as the empty id and is training; repeated rows count as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.llm.folds import held_out
from tabscope.llm.rows import shards
from tabscope.llm.words import NOT_SPACE, Words, mixed
from tabscope.scratch import materialize

SHARD = 4 << 20  # bytes of text that share one word list
BLOCK_WORDS = 1 << 19  # words of text for each block of hash values
BITS_PER_ENTRY = 8
PRIOR = 40.0  # weight of the unigram probability against the counts after a word
_END = 0x2545F4914F6CDD1D  # stands for the hash of the end token, also before the first word
_PROBES = 5



def bigram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + word)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


class LogBloom:
    """Sets of (n-gram, level): an n-gram of quantised count q is in it at the levels 1 to q."""

    def __init__(self, first_bits: np.ndarray, sizes: np.ndarray, bits: np.ndarray):
        self.first_bits, self.sizes, self.bits = first_bits, sizes, bits

    @staticmethod
    def places(rests: np.ndarray, level: int, probe: int, sizes: np.ndarray) -> np.ndarray:
        mix = mixed(rests.astype(np.uint64) ^ np.uint64((level << 40) + (probe + 1 << 32)))
        return (mix % sizes.astype(np.uint64)).astype(np.int64)

    @classmethod
    def block(cls, rests: np.ndarray, counts: np.ndarray, most: int | None = None) -> tuple[int, bytes]:
        """Bits of one block from its n-grams: (number of bits, bytes), ``BITS_PER_ENTRY`` for each entry.

        With ``most``, which ``scores`` never gives, the rarest counts stay out of a filter of more bits.
        """
        q = levels(counts)
        if most is not None:
            of_count = np.bincount(counts, weights=q)
            fits = np.flatnonzero(np.cumsum(of_count[::-1])[::-1] * BITS_PER_ENTRY <= most)
            kept = counts >= (fits[0] if len(fits) else len(of_count))
            rests, q = rests[kept], q[kept]
        size = max(64, int(q.sum() * BITS_PER_ENTRY))
        size += -size % 8
        held = np.zeros(size, np.uint8)
        sizes = np.array([size])
        for level in range(1, int(q.max(initial=0)) + 1):
            mine = rests[q >= level]
            for probe in range(_PROBES):
                held[cls.places(mine, level, probe, sizes)] = 1
        return size, np.packbits(held, bitorder="little").tobytes()

    @classmethod
    def of(cls, rows: list[tuple[int, int, bytes]], blocks: int) -> LogBloom:
        sizes = np.zeros(blocks, np.int64)
        parts: list[bytes] = [b""] * blocks
        for block, size, data in rows:
            sizes[block], parts[block] = size, data
        return cls(np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(parts), np.uint8))

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts: the middle of the last level held."""
        return middle(self.held(hashes))

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Levels held (0: none): probe level after level until one fails."""
        last = np.zeros(len(hashes), np.uint8)
        active = np.arange(len(hashes))
        blocks = block_of(hashes, len(self.sizes))
        rests = rest_of(hashes, len(self.sizes))
        active = active[self.sizes[blocks] > 0]
        level = 1
        while len(active):
            for probe in range(_PROBES):
                block = blocks[active]
                at = self.first_bits[block] + self.places(rests[active], level, probe, self.sizes[block])
                active = active[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            last[active] = level
            level += 1
        return last


def middle(held: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level, 0 for none."""
    return np.where(held > 0, (2.0 ** (held.astype(float) - 1) + 2.0 ** held.astype(float) - 1) / 2, 0.0)


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are equal ranges of hash values; ``blocks`` is a power of two."""
    return (hashes >> np.uint64(65 - blocks.bit_length())).astype(np.int64) if blocks > 1 else np.zeros(len(hashes), np.int64)


def packed(values: np.ndarray) -> bytes:
    """An integer array as bytes: equal bytes of all values together, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return _squeezed(planes.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_whole(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(data, asbytes=True) if data else b"")


def _whole(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd", 1).decompress(data[8:], size, asbytes=True) if size else b""


def rest_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The 32 bits of a hash after those that name its block."""
    return ((hashes << np.uint64(blocks.bit_length() - 1)) >> np.uint64(32)).astype(np.uint32)


def numbered(docs: DataFrame) -> DataFrame:
    """One row per shard from doc_id, held_out, text: ids, folds, text sizes, word numbers, words, training counts."""
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("folds", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("numbers", T.BinaryType()), T.StructField("names", T.BinaryType()), T.StructField("counts", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, folds = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for start, stop in shards(texts, SHARD):
                known: dict[bytes, int] = {}
                ids = [[known.setdefault(w, len(known)) for w in (t or b"").lower().split()] for t in texts[start:stop]]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                stream = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
                training = np.repeat(~np.array(folds[start:stop], bool), sizes)
                counts = np.bincount(stream[training], minlength=len(known)).astype(np.uint32)
                one = pa.array([0, stop - start], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard], pa.int64()), pa.ListArray.from_arrays(one, batch.column(0).slice(start, stop - start)),
                    pa.array([folds[start:stop]], arrow.field("folds").type), pa.array([sizes], arrow.field("sizes").type),
                    pa.array([packed(stream)], pa.binary()), pa.array([_squeezed(b" ".join(known))], pa.binary()), pa.array([packed(counts)], pa.binary()),
                ], schema=arrow)
                shard += 1

    rows = docs.select("doc_id", "held_out", F.col("text").cast("binary")).mapInArrow(run, schema)
    return materialize(rows, "lm-numbered")


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for i in range(table.num_rows):
        yield {n: table.column(k)[i].as_py() for k, n in enumerate(table.schema.names)}


def _by_block(blocks_of: np.ndarray, blocks: int) -> list[tuple[int, slice]]:
    """(block, places) of an array sorted by block."""
    edge = np.searchsorted(blocks_of, np.arange(blocks + 1))
    return [(b, slice(edge[b], edge[b + 1])) for b in np.flatnonzero(edge[1:] > edge[:-1])]


def word_counts(texts: DataFrame, blocks: int) -> DataFrame:
    """(words_of, numbers, counts, fresh): a shard's training counts over all shards, by word number.

    Words meet by block of their hash. ``fresh`` is the number of distinct training words of a block,
    told once.
    """
    sent = "block int, words_of long, names binary, numbers binary, counts binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                names = _whole(row["names"]).split()
                counts = unpacked(row["counts"], np.uint32)
                of = block_of(word_hashes(names)[:-1], blocks)
                order = np.argsort(of, kind="stable").astype(np.uint32)
                parts = _by_block(of[order], blocks)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in parts], pa.int32()), pa.array([row["shard"]] * len(parts), pa.int64()),
                    pa.array([_squeezed(b" ".join([names[i] for i in order[at]])) for _, at in parts], pa.binary()),
                    pa.array([packed(order[at]) for _, at in parts], pa.binary()), pa.array([packed(counts[order[at]]) for _, at in parts], pa.binary()),
                ], names=["block", "words_of", "names", "numbers", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        places = []
        for row in _rows(table.select(["names", "counts"])):
            names = _whole(row["names"]).split()
            for name, n in zip(names, unpacked(row["counts"], np.uint32).tolist()):
                total[name] = total.get(name, 0) + n
            places.append(names)
        back = [packed(np.fromiter((total[n] for n in names), np.int64, len(names))) for names in places]
        fresh = [sum(n > 0 for n in total.values())] + [0] * (len(back) - 1)
        return pa.table({"words_of": table["words_of"], "numbers": table["numbers"], "counts": pa.array(back, pa.binary()), "fresh": pa.array(fresh, pa.int64())})

    rows = texts.select("shard", "names", "counts").mapInArrow(send, sent)
    return materialize(rows.groupBy("block").applyInArrow(add, "words_of long, numbers binary, counts binary, fresh long"), "lm-counts")


def shard_bigrams(texts: DataFrame, blocks: int) -> DataFrame:
    """(block, levels_of, data, counts): distinct bigrams of a shard by block, as the steps between the
    32-bit rests of their hashes in order, and their training counts, zero for held-out texts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                arrays = np.split(unpacked(row["numbers"], np.uint32), np.cumsum(row["sizes"])[:-1])
                grams, at = np.unique(bigrams(arrays, word_hashes(_whole(row["names"]).split())), return_inverse=True)
                training = np.repeat(~np.array(row["folds"], bool), np.array(row["sizes"], np.int64) + 1)
                n = np.bincount(at[training], minlength=len(grams)).astype(np.uint32)
                parts = _by_block(block_of(grams, blocks), blocks)
                rests = rest_of(grams, blocks)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _ in parts], pa.int32()), pa.array([row["shard"]] * len(parts), pa.int64()),
                    pa.array([packed(np.diff(rests[at], prepend=np.uint32(0))) for _, at in parts], pa.binary()), pa.array([packed(n[at]) for _, at in parts], pa.binary()),
                ], names=["block", "levels_of", "data", "counts"])

    return texts.select("shard", "folds", "sizes", "numbers", "names").mapInArrow(run, "block int, levels_of long, data binary, counts binary")


def word_hashes(names: list[bytes]) -> np.ndarray:
    """Hashes by word number; one more at the end for the end token."""
    return np.append(Words([b" ".join(names)], NOT_SPACE).hashes(), np.uint64(_END))


def with_ends(texts: list[np.ndarray], end: int) -> np.ndarray:
    """All texts in a row, an end token after each."""
    tail = np.array([end], np.int64)
    return np.concatenate([x for t in texts for x in (t, tail)]).astype(np.int64) if texts else np.empty(0, np.int64)


def bigrams(texts: list[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """A bigram hash per token; before the first word of a text stands the end token."""
    tokens = with_ends(texts, len(hashes) - 1)
    return bigram(hashes[np.concatenate(([len(hashes) - 1], tokens[:-1]))], hashes[tokens])


def bigram_levels(grams: DataFrame) -> DataFrame:
    """(levels_of, block, levels): the levels a block's filter holds of the bigrams of each shard, in their order.

    The training counts of a block are summed over the shards and set into its filter, all of them.
    Blocks are equal ranges of hash values and grow in number with the text, so none of them grows.
    """

    def run(table: pa.Table) -> pa.Table:
        rests = [np.cumsum(unpacked(x.as_py(), np.uint32), dtype=np.uint32) for x in table["data"]]
        counts = np.concatenate([unpacked(x.as_py(), np.uint32) for x in table["counts"]])
        grams, at = np.unique(np.concatenate(rests), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        size, bits = LogBloom.block(grams[total > 0], total[total > 0])
        held = LogBloom.of([(0, size, bits)], 1).held(grams.astype(np.uint64) << np.uint64(32))[at]
        back = [packed(x) for x in np.split(held, np.cumsum([len(r) for r in rests])[:-1])]
        return pa.table({"levels_of": table["levels_of"], "block": table["block"], "levels": pa.array(back, pa.binary())})

    return grams.groupBy("block").applyInArrow(run, "levels_of long, block int, levels binary")


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id, 7, 2).alias("held_out"), F.col(text).alias("text"))
    texts = numbered(rows)
    facts = texts.agg(
        F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("words"),
        F.sum(F.aggregate(F.zip_with("folds", "sizes", lambda h, n: F.when(h, F.lit(0).cast("long")).otherwise(n)), F.lit(0).cast("long"), lambda s, x: s + x)).alias("training"),
        F.sum(F.size(F.filter("folds", lambda h: ~h))).alias("ends"),
    ).first()
    blocks = 1 << max(0, (int(facts["words"] or 0) // BLOCK_WORDS).bit_length())
    ends = int(facts["ends"] or 0)
    tokens = int(facts["training"] or 0) + ends
    known = word_counts(texts, blocks)
    kinds = int(known.agg(F.sum("fresh")).first()[0] or 0) + (ends > 0)
    levelled = bigram_levels(shard_bigrams(texts, blocks)).withColumnRenamed("levels_of", "words_of")
    replies = known.select("words_of", "numbers", "counts").unionByName(levelled, allowMissingColumns=True)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in _rows(left.select(["sizes", "numbers", "names"])):
            names = _whole(row["names"]).split()
            counts = np.zeros(len(names) + 1)
            counts[-1] = ends
            held = []
            for back in _rows(right.select(["numbers", "counts", "block", "levels"])):
                if back["levels"] is None:
                    counts[unpacked(back["numbers"], np.uint32)] = unpacked(back["counts"], np.int64)
                else:
                    held.append((back["block"], unpacked(back["levels"], np.uint8)))
            seen = middle(np.concatenate([x for _, x in sorted(held, key=lambda x: x[0])]))  # in the order of the hashes
            arrays = np.split(unpacked(row["numbers"], np.uint32), np.cumsum(row["sizes"])[:-1])
            parts.append(score_texts(arrays, names, counts, tokens, kinds, seen))
        made = pd.concat(parts)
        ids, folds = pa.chunked_array([c.flatten() for c in left["ids"].chunks]), pa.chunked_array([c.flatten() for c in left["folds"].chunks])
        columns = [ids, folds, made["n_tokens"], made["n_known"], np.full(len(made), tokens, np.int64), made["base"], made["score"]]
        return pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in columns], schema=arrow)

    return texts.groupBy("shard").cogroup(replies.groupBy("words_of")).applyInArrow(run, schema)


def score_texts(texts: list[np.ndarray], names: list[bytes], counts: np.ndarray, tokens: int, kinds: int, seen: np.ndarray) -> pd.DataFrame:
    """Scores of numbered texts; ``counts`` by word number, the end token's at the end; ``seen`` by distinct bigram in the order of the hashes."""
    if not texts:
        return pd.DataFrame({"n_tokens": [], "n_known": [], "base": [], "score": []})
    end = len(counts) - 1
    stream = with_ends(texts, end)
    before = np.concatenate(([end], stream[:-1]))
    unigram = (counts + 1) / (tokens + kinds + 1)
    _, at = np.unique(bigrams(texts, word_hashes(names)), return_inverse=True)
    seen = np.minimum(seen[at], counts[before])
    smoothed = (seen + PRIOR * unigram[stream]) / (counts[before] + PRIOR)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    return pd.DataFrame({
        "n_tokens": sizes, "n_known": np.add.reduceat((counts > 0).astype(np.int64)[stream], first),
        "base": np.add.reduceat(np.log10(unigram)[stream], first), "score": np.add.reduceat(np.log10(smoothed), first),
    })
