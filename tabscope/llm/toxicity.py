"""Toxicity: a convolutional text classifier trained in numpy, thresholds calibrated by language.

A word is the sum of three hashed embeddings: the word and its first four and five bytes, so that
inflected forms share what they have learned. Filters of one to three words, rectified and pooled by
their maximum over the whole text, feed one logit. A hashed bag of words guesses the language, whose
own threshold and slope turn the logit into the score; lang itself is only a training label.

Every labelled text outside the held-out fold is learned from, whole. They are dealt by id to shards of a
bounded size. In each epoch every shard is gone through on its own, from the net of the epoch before, and the
nets are averaged: a word's embedding over the shards that have the word, all else over all shards. One shard
is plain gradient descent. Language counts and the logits that set the thresholds come from all shards as well.

Edge cases: null and empty texts score what no evidence scores; without labelled rows of both classes
the score is 0 (or 1) throughout; documents with several label rows are learned once per row; columns
of the output's names are replaced.
"""

from __future__ import annotations

import copy
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.folds import held_out
from tabscope.llm.rows import ranges, shards, with_columns_from
from tabscope.llm.words import ALNUM, Words
from tabscope.scratch import remove, written

BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (None, 4, 5)
SHARD_BYTES = 24 << 20  # text of the documents that a training shard is picked from
EPOCHS = 6
MIN_STEPS = 300  # a small table is gone through more often
MOST_LOGITS = 100_000  # logits of texts kept apart that the driver holds; more are sorted and summed in tasks
BATCH = 64
LEAST_OF_LANGUAGE = 10  # texts of each label that a language's own threshold needs
CLEAN_WEIGHT = 20.0  # misses that a clean text called toxic counts for
NEWTON_STEPS = 50
STEEPEST = 8.0  # slope where no text lies on the wrong side
_LANG_BUCKETS = 1 << 13
_SHARD = 1 << 20
SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("logit", T.DoubleType())])


@dataclass
class Texts:
    """Word buckets of some texts; each text is followed by empty words, as many as the widest filter looks ahead."""

    ids: np.ndarray  # place, kind of embedding
    first: np.ndarray  # place of each text's first word
    words: np.ndarray  # words of each text

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Texts:
        """Read the texts shard by shard."""
        parts = [cls._of_shard(texts[a:b]) for a, b in shards(texts, _SHARD)]
        sizes = np.concatenate([p.words for p in parts]) + max(WIDTHS) - 1
        return cls(np.concatenate([p.ids for p in parts]), np.cumsum(sizes) - sizes, np.concatenate([p.words for p in parts]))

    @classmethod
    def _of_shard(cls, texts: list[bytes | None]) -> Texts:
        shard = Words(texts, ALNUM)
        gap = max(WIDTHS) - 1
        ids = np.full((len(shard.starts) + gap * len(texts), len(PREFIXES)), BUCKETS, np.int32)
        place = np.arange(len(shard.starts)) + gap * shard.text_of
        for k, longest in enumerate(PREFIXES):
            salted = shard.hashes(longest) + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
            ids[place, k] = (salted >> np.uint64(7)) % np.uint64(BUCKETS)
        sizes = shard.counts + gap
        return cls(ids, np.cumsum(sizes) - sizes, shard.counts)

    def take(self, rows: np.ndarray) -> Texts:
        gap = max(WIDTHS) - 1
        sizes = self.words[rows] + gap
        place = np.concatenate([np.arange(self.first[r], self.first[r] + self.words[r] + gap) for r in rows])
        return Texts(self.ids[place], np.cumsum(sizes) - sizes, self.words[rows])

    def languages(self, table: np.ndarray) -> np.ndarray:
        """Sum of each text's rows of a table by word bucket (the last row is the empty word's)."""
        return np.add.reduceat(table[np.where(self.ids[:, 0] == BUCKETS, _LANG_BUCKETS, self.ids[:, 0] % _LANG_BUCKETS)], self.first)


class Net:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
        self.embed[BUCKETS] = 0
        self.filters = [rng.normal(0, 0.4, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = np.abs(rng.normal(0, 0.5, FILTERS * len(WIDTHS))).astype(np.float32) * np.tile([1, 1, 1, -1], FILTERS * len(WIDTHS) // 4).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.squares = np.full(BUCKETS + 1, 1e-3, np.float32)
        self.first = [np.zeros_like(p) for p in (*self.filters, *self.bias, self.out)]
        self.second = [np.zeros_like(p) for p in self.first]

    def maps(self, texts: Texts) -> tuple[np.ndarray, list[np.ndarray]]:
        """Word vectors, and the rectified outputs of every filter width at every place."""
        x = self.embed[texts.ids[:, 0]] + self.embed[texts.ids[:, 1]] + self.embed[texts.ids[:, 2]]
        gap = max(WIDTHS) - 1
        last = (texts.first + texts.words)[:, None] + np.arange(gap)
        made = []
        for kernel, bias in zip(self.filters, self.bias):
            z = x @ kernel[0]
            for j in range(1, len(kernel)):
                z[:-j] += x[j:] @ kernel[j]
            z += bias
            np.maximum(z, 0, out=z)
            z[last.ravel()] = 0  # a filter starts at a word
            made.append(z)
        return x, made

    def logits(self, texts: Texts) -> np.ndarray:
        made = []
        group = (texts.first // (_SHARD // 8)).tolist()
        cuts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
        for a, b in zip(cuts[:-1], cuts[1:]):  # about as many words at a time as a shard has
            part = texts.take(np.arange(a, b))
            _, maps = self.maps(part)
            pooled = np.concatenate([np.maximum.reduceat(z, part.first) for z in maps], axis=1)
            made.append((pooled @ self.out + self.shift).astype(np.float64))
        return np.concatenate(made)

    def epoch(self, texts: Texts, labels: np.ndarray, use: np.ndarray, share: float, epoch: int, epochs: int, seed: int = 11) -> np.ndarray:
        """Learn the texts at the places ``use`` once; returns which embeddings have moved. ``share``: that of label 1 in all shards."""
        rng = np.random.default_rng(seed)
        self.touched = np.zeros(BUCKETS + 1, bool)
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        step = epoch * -(-len(use) // BATCH)
        rate = 0.02 * (1 - epoch / epochs) + 0.002
        for _ in range(epoch + 1):
            order = rng.permutation(use)
        for at in range(0, len(order), BATCH):
            step += 1
            rows = order[at : at + BATCH]
            self._step(texts.take(rows), labels[rows], weights[rows], rate, step)
        return self.touched

    @property
    def dense(self) -> list[np.ndarray]:
        """What every text moves, and the running moments of it."""
        return [*self.filters, *self.bias, self.out, *self.first, *self.second, self.shift]

    def _step(self, texts: Texts, labels, weights, rate, step) -> None:
        x, maps = self.maps(texts)
        n, gap = len(labels), max(WIDTHS) - 1
        ends = texts.first + texts.words + gap
        peak = [np.stack([s + z[s:e].argmax(axis=0) for s, e in zip(texts.first, ends)]) for z in maps]
        columns = np.arange(FILTERS)
        pooled = [z[p, columns] for z, p in zip(maps, peak)]
        joined = np.concatenate(pooled, axis=1)
        logit = joined @ self.out + self.shift
        slope = ((1 / (1 + np.exp(-logit)) - labels) * weights / n).astype(np.float32)
        back = slope[:, None] * self.out * (joined > 0)
        grads, rows_hit, rows_grad = [], [], []
        for k, (kernel, p) in enumerate(zip(self.filters, peak)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            span = np.minimum(p[..., None] + np.arange(len(kernel)), len(x) - 1)
            grads.append(np.einsum("bfjd,bf->jdf", x[span], g, optimize=True))
            spread = np.einsum("jdf,bf->bfjd", kernel, g, optimize=True).reshape(-1, DIM)
            rows_hit.append(texts.ids[span].reshape(-1, len(PREFIXES)))
            rows_grad.append(spread)
        grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
        grads.append(slope @ joined)
        for param, grad, m, v in zip((*self.filters, *self.bias, self.out), grads, self.first, self.second):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        self.shift -= np.float32(rate * 5 * slope.sum())
        hit, grad = np.concatenate(rows_hit), np.concatenate(rows_grad)
        for k in range(len(PREFIXES)):
            row, back_to = np.unique(hit[:, k], return_inverse=True)
            total = np.zeros((len(row), DIM), np.float32)
            np.add.at(total, back_to, grad)
            self.squares[row] += (total**2).mean(axis=1)
            self.embed[row] -= rate * 5 * total / np.sqrt(self.squares[row])[:, None]
            self.touched[row] = True
        self.embed[BUCKETS] = 0


@dataclass
class Model:
    net: Net | None
    constant: float
    languages: np.ndarray  # log-probabilities by word bucket and language
    thresholds: np.ndarray
    slopes: np.ndarray


def calibrated_by_language(counts: pd.DataFrame, n: int) -> np.ndarray:
    """(threshold, slope) of each of ``n`` languages, from counts by guess, toxic and logit."""
    def of(part: pd.DataFrame) -> tuple[float, float]:
        every = part.groupby(["logit", "toxic"], as_index=False)["n"].sum()
        return calibrated(every["logit"].to_numpy(np.float64), every["toxic"].to_numpy(np.int64), every["n"].to_numpy(np.float64))

    every, limits = of(counts), []
    for k in range(n):
        mine = counts[counts["guess"] == k]
        enough = all(mine.loc[mine["toxic"] == y, "n"].sum() >= LEAST_OF_LANGUAGE for y in (0, 1))
        limits.append(of(mine) if enough else every)
    return np.array(limits)


def calibrated_in_chunks(counts: DataFrame, n: int) -> np.ndarray:
    """``calibrated_by_language`` of any number of logits, none of them rounded: they stay in sorted chunks, and the driver gets sums of each chunk."""
    sizes = {(r["guess"], r["toxic"]): r["n"] for r in counts.groupBy("guess", "toxic").agg(F.sum("n").alias("n")).collect()}
    enough = [k for k in range(n) if all(sizes.get((k, y), 0) >= LEAST_OF_LANGUAGE for y in (0, 1))]
    # group -1 is that of all texts, for the languages without enough of their own
    own, all_ = F.when(F.col("guess").isin(enough), F.col("guess")), F.when(F.lit(len(enough) < n), F.lit(-1))
    keyed = counts.select(F.explode(F.array_compact(F.array(own, all_))).alias("group"), "logit", "toxic", "n")
    order = ["group", "logit", "toxic"]
    rows = keyed.groupBy(*order).agg(F.sum("n").alias("n"))
    rows = rows.repartitionByRange(max(1, -(-2 * sum(sizes.values()) // MOST_LOGITS)), *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, part in batch.groupby("group"):
                yield pd.DataFrame({"group": [group], **{to: [part[c].to_numpy(np.float64).tobytes()] for to, c in (("z", "logit"), ("y", "toxic"), ("w", "n"))}})

    packed = rows.mapInPandas(pack, "group int, z binary, y binary, w binary")
    chunks, path = written(packed.select(F.monotonically_increasing_id().alias("chunk"), "*"), "toxicity-logits")

    def of_chunks(fn: Callable[..., tuple[float, ...]], k: int) -> pd.DataFrame:
        """``fn`` of (chunk, z, y, w) for every chunk, in the order of group and logit."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                made = [fn(r.chunk, *(np.frombuffer(v, np.float64) for v in (r.z, r.y, r.w))) for r in batch.itertuples(index=False)]
                yield pd.DataFrame(made, columns=[f"v{i}" for i in range(k)], dtype=np.float64).assign(chunk=batch["chunk"].to_numpy(), group=batch["group"].to_numpy())

        schema = ", ".join([*(f"v{i} double" for i in range(k)), "chunk bigint", "group int"])
        return chunks.mapInPandas(run, schema).toPandas().sort_values("chunk", ignore_index=True)

    held = of_chunks(lambda chunk, z, y, w: (z[0], z[-1], (w * y).sum(), (w * (1 - y)).sum()), 4)
    by = held.groupby("group")
    toxic, clean = (by[c].sum().clip(lower=1).to_dict() for c in ("v2", "v3"))
    before = {r.chunk: (r.group, r.t, r.c, r.last) for r in held.assign(t=by["v2"].cumsum() - held["v2"], c=by["v3"].cumsum() - held["v3"], last=by["v1"].shift()).itertuples()}

    def cost(chunk: int, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """That of a threshold before each of the chunk's logits."""
        group, t, c, _ = before[chunk]
        missed = (t + np.cumsum(w * y) - w * y) / toxic[group]
        return missed + CLEAN_WEIGHT * (clean[group] - (c + np.cumsum(w * (1 - y)) - w * (1 - y))) / clean[group]

    # beyond the last logit all is called clean
    every = {g: by["v2"].sum()[g] / toxic[g] + CLEAN_WEIGHT * (clean[g] - by["v3"].sum()[g]) / clean[g] for g in toxic}
    least = {g: min(v, every[g]) for g, v in of_chunks(lambda chunk, z, y, w: (cost(chunk, y, w).min(),), 1).groupby("group")["v0"].min().items()}

    def widest(chunk: int, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
        """(gap, threshold) of the first of the widest gaps with the least cost; -1 without one."""
        group, *_, last = before[chunk]
        under = np.concatenate(([z[0] if np.isnan(last) else last], z[:-1]))
        cuts = np.where(np.arange(len(z)) == 0, z - 1, (z + under) / 2) if np.isnan(last) else (z + under) / 2
        gap = np.where(np.isclose(cost(chunk, y, w), least[group]), z - under, -1.0)
        return gap.max(), cuts[gap.argmax()]

    limits = {}
    for g, found in of_chunks(widest, 2).groupby("group"):
        best = found["v0"].argmax()
        limits[g] = found["v1"].iloc[best] if found["v0"].iloc[best] >= 0 else by["v1"].last()[g] + 1
    slopes, moving = dict.fromkeys(limits, 1.0), set(limits)
    for _ in range(NEWTON_STEPS):
        if not moving:
            break

        def pull(chunk: int, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
            g = before[chunk][0]
            return _pull(slopes[g], z - limits[g], y, w * np.where(y == 1, 0.5 / toxic[g], 0.5 / clean[g])) if g in moving else (0.0, 0.0)

        for g, part in of_chunks(pull, 2).groupby("group"):
            if g in moving:
                moved = _moved(slopes[g], math.fsum(part["v0"]), math.fsum(part["v1"]))
                if abs(moved - slopes[g]) < 1e-6:
                    moving.discard(g)
                else:
                    slopes[g] = moved
    remove(counts.sparkSession, path)
    return np.array([(limits[g], slopes[g]) for g in (k if k in set(enough) else -1 for k in range(n))])


def _pull(slope: float, z: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """First and second derivative of the log-loss, downhill."""
    p = 1 / (1 + np.exp(-np.clip(slope * z, -30, 30)))
    return (weight * (labels - p) * z).sum(), (weight * p * (1 - p) * z * z).sum()


def _moved(slope: float, downhill: float, bend: float) -> float:
    """The slope after one of Newton's steps, with a weak pull to 1."""
    return float(np.clip(slope + (downhill - 0.01 * (slope - 1)) / (bend + 0.01), 0.1, STEEPEST))


def calibrated(logits: np.ndarray, labels: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """(threshold, slope): the score is the logistic of slope times distance from the threshold.

    The slope has the least log-loss on the texts kept apart, both labels weighing alike, with a
    weak pull to 1; Newton's steps stay between a tenth and ``STEEPEST``. It does not move the threshold.
    ``n``: how many texts each logit stands for.
    """
    n = np.ones(len(labels)) if n is None else n
    limit = threshold(logits, labels, n=n)
    z = logits - limit
    weight = n * np.where(labels == 1, 0.5 / max((n * labels).sum(), 1), 0.5 / max((n * (1 - labels)).sum(), 1))
    slope = 1.0
    for _ in range(NEWTON_STEPS):
        moved = _moved(slope, *_pull(slope, z, labels, weight))
        if abs(moved - slope) < 1e-6:
            break
        slope = moved
    return limit, slope


def threshold(logits: np.ndarray, labels: np.ndarray, clean_weight: float = CLEAN_WEIGHT, n: np.ndarray | None = None) -> float:
    """Fewest errors, a clean text called toxic counting ``clean_weight`` misses."""
    order = np.argsort(logits)
    z, y = logits[order], labels[order]
    w = np.ones(len(y)) if n is None else n[order]
    toxic, clean = max((w * y).sum(), 1), max((w * (1 - y)).sum(), 1)
    missed = np.concatenate(([0], np.cumsum(w * y))) / toxic
    accused = (clean - np.concatenate(([0], np.cumsum(w * (1 - y))))) / clean
    cost = missed + clean_weight * accused
    best = np.flatnonzero(np.isclose(cost, cost.min()))
    cuts = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    gap = np.concatenate(([0], z[1:] - z[:-1], [0]))
    return float(cuts[best[np.argmax(gap[best])]])


def _language_counts(texts: Texts, language: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(_LANG_BUCKETS * n, np.int64)
    ends = texts.first + texts.words + max(WIDTHS) - 1
    for a, b in ranges((ends - texts.first).tolist(), _SHARD // 8):
        ids = texts.ids[texts.first[a] : ends[b - 1], 0]
        spoken, some = np.repeat(language[a:b], ends[a:b] - texts.first[a:b]), ids < BUCKETS
        total += np.bincount(ids[some] % _LANG_BUCKETS * n + spoken[some], minlength=len(total))
    return total


def _language_table(counts: np.ndarray) -> np.ndarray:
    p = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * _LANG_BUCKETS)
    return np.vstack([np.log(p), np.zeros(counts.shape[1])])


def score(model: Model, texts: list[bytes | None]) -> dict:
    """Columns of ``SCORED`` for some texts."""
    made, logits = [], []
    for start, stop in shards(texts, _SHARD):
        if model.net is None:
            made.append(np.full(stop - start, model.constant))
            logits.append(np.zeros(stop - start))
            continue
        part = Texts.of(texts[start:stop])
        z = model.net.logits(part)
        k = part.languages(model.languages).argmax(axis=1)
        made.append(1 / (1 + np.exp(-np.clip(model.slopes[k] * (z - model.thresholds[k]), -30, 30))))
        logits.append(z)
    joined = np.concatenate([*made, np.empty(0)])
    return {"score": joined, "predicted": (joined >= 0.5).astype(np.int32), "logit": np.concatenate([*logits, np.empty(0)])}


_PACKED = "shard int, toxic array<int>, lang array<string>, words binary, ids binary"
_PACKED_ARROW = pa.schema([("shard", pa.int32()), ("toxic", pa.list_(pa.int32())), ("lang", pa.list_(pa.string())), ("words", pa.binary()), ("ids", pa.binary())])
# every fourth text of a shard is kept apart to set the thresholds
_APART = 4


def _training_shards(docs: DataFrame, labels: DataFrame, shard_bytes: int) -> tuple[DataFrame, str]:
    """All labelled documents that are not held out, as words' buckets: one row per shard, in an order that their ids give."""
    key = F.col("doc_id").cast("string").alias("doc_id")
    rows = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    count = max(1, -(-size // shard_bytes))
    shard = F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(count)).cast("int").alias("shard")
    texts = rows.select(
        key, F.xxhash64("doc_id").alias("place"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("binary").alias("text")
    ).withColumn("shard", shard)
    marks = labels.select(key, F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").distinct().withColumn("shard", shard)

    def pack(mine: pa.Table, marked: pa.Table) -> pa.Table:
        # only labelled texts leave Arrow's memory
        toxic: dict[str, list[int]] = {}
        for name, y in zip(marked.column("doc_id").to_pylist(), marked.column("toxic").to_pylist()):
            toxic.setdefault(name, []).append(y)
        place, text, lang = (mine.column(c) for c in ("place", "text", "lang"))
        keyed = sorted((place[i].as_py(), y, i) for i, name in enumerate(mine.column("doc_id").to_pylist()) if name in toxic for y in toxic[name])
        found: list[tuple[int, int]] = []  # label and row; equal ids in the order of their texts
        for (_, y), same in itertools.groupby(keyed, lambda m: m[:2]):
            rows = [i for *_, i in same]
            if len(rows) > 1:
                rows.sort(key=lambda i: (text[i].as_py() or b"", lang[i].as_py()))
            found += [(y, i) for i in rows]
        sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        words, ids = bytearray(), bytearray()
        for a, b in ranges([sizes[i] for _, i in found], _SHARD):
            part = Texts.of([text[i].as_py() or b"" for _, i in found[a:b]])
            words += part.words.astype(np.int64).tobytes()
            # an empty word's bucket is one beyond the largest number; its places follow from the words' counts
            ids += part.ids[part.ids[:, 0] < BUCKETS].astype(np.uint16).tobytes()
        shard, toxics, langs = mine.column("shard").to_pylist()[:1], [[y for y, _ in found]], [[lang[i].as_py() for _, i in found]]
        columns = [pa.array(v if found else [], _PACKED_ARROW.field(k).type) for k, v in enumerate((shard, toxics, langs))]
        columns += [_one_binary(b) if found else pa.array([], pa.binary()) for b in (words, ids)]
        pa.default_memory_pool().release_unused()
        return pa.table(columns, schema=_PACKED_ARROW)

    packed = texts.repartition(count, "shard").groupBy("shard").cogroup(marks.repartition(count, "shard").groupBy("shard")).applyInArrow(pack, _PACKED)
    return written(packed, "toxicity-shards")


def _one_binary(data: bytearray) -> pa.Array:
    """An array of one value, which is not copied."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int32)), pa.py_buffer(data)])


def _unpacked(words: pa.Buffer, ids: pa.Buffer) -> Texts:
    gap = max(WIDTHS) - 1
    counts = np.frombuffer(words, np.int64)
    sizes = counts + gap
    some = np.frombuffer(ids, np.uint16).reshape(-1, len(PREFIXES))
    out = np.full((len(some) + gap * len(counts), len(PREFIXES)), BUCKETS, np.int32)
    first = np.cumsum(sizes) - sizes
    full = np.ones(len(out), bool)
    full[((first + counts)[:, None] + np.arange(gap)).ravel()] = False
    out[full] = some
    return Texts(out, first, counts)


def _by_shard(packed: DataFrame, schema: str, fn: Callable[..., dict]) -> DataFrame:
    """``fn`` of (texts, labels, languages, shard) for every shard, as rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1) for i in range(batch.num_rows)):
                words, ids = (r.column(c)[0].as_buffer() for c in ("words", "ids"))
                made = fn(_unpacked(words, ids), np.array(r.column("toxic")[0].as_py(), np.int64), r.column("lang")[0].as_py(), r.column("shard")[0].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(made[n]) for n in names], names=names)
        pa.default_memory_pool().release_unused()

    return packed.mapInArrow(run, schema)


def _averaged(packed: DataFrame, net: Net, share: float, now: range, epochs: int, keep_apart: bool, count: int) -> Net:
    """The mean of the nets that the shards make of ``net`` in the epochs ``now``. It is summed in parts, as many as there are shards."""
    shared, parts = packed.sparkSession.sparkContext.broadcast(net), max(16, count)

    def learned(texts: Texts, labels: np.ndarray, languages: list[str], shard: int) -> dict:
        mine = copy.deepcopy(shared.value)
        use = np.flatnonzero(~_apart(len(labels), keep_apart))
        moved = np.logical_or.reduce([mine.epoch(texts, labels, use, share, epoch, epochs) for epoch in now])
        made = {"part": [-1], "shard": [shard], "at": [b""], "value": [np.concatenate([p.ravel() for p in mine.dense]).tobytes()]}
        rows = np.flatnonzero(moved)
        for part in range(parts):
            at = rows[rows % parts == part].astype(np.int32)
            for name, value in (("part", part), ("shard", shard), ("at", at.tobytes()), ("value", np.column_stack([mine.embed[at], mine.squares[at]]).tobytes())):
                made[name].append(value)
        return made | {"part": np.array(made["part"], np.int32), "shard": np.array(made["shard"], np.int32)}

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        group, part = group.sort_values("shard"), int(group["part"].iloc[0])
        if part < 0:
            total, at = np.mean([np.frombuffer(v, np.float32) for v in group["value"]], axis=0, dtype=np.float64), np.zeros(0, np.int32)
        else:
            at, back = np.unique(np.concatenate([np.frombuffer(a, np.int32) for a in group["at"]]), return_inverse=True)
            total = np.zeros((len(at), DIM + 1))
            np.add.at(total, back, np.concatenate([np.frombuffer(v, np.float32).reshape(-1, DIM + 1) for v in group["value"]]))
            total /= np.bincount(back, minlength=len(at))[:, None]
        return pd.DataFrame({"part": [part], "at": [at.tobytes()], "value": [total.astype(np.float32).tobytes()]})

    means = _by_shard(packed, "part int, shard int, at binary, value binary", learned).groupBy("part").applyInPandas(mean, "part int, at binary, value binary")
    out = copy.deepcopy(net)
    for r in means.collect():
        value = np.frombuffer(bytes(r["value"]), np.float32)
        if r["part"] < 0:
            ends = np.cumsum([p.size for p in out.dense])
            for p, a, b in zip(out.dense, ends - [p.size for p in out.dense], ends):
                p[...] = value[a:b].reshape(p.shape)
        else:
            at, value = np.frombuffer(bytes(r["at"]), np.int32), value.reshape(-1, DIM + 1)
            out.embed[at], out.squares[at] = value[:, :DIM], value[:, DIM]
    shared.destroy()
    return out


def _apart(n: int, keep_apart: bool) -> np.ndarray:
    return (np.arange(n) % _APART == _APART - 1) & keep_apart


def fit(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES) -> Model:
    """Learn from every labelled text, none of it held out."""
    packed, path = _training_shards(docs, labels, shard_bytes)
    model = _fit(packed)
    remove(docs.sparkSession, path)
    return model


def _fit(packed: DataFrame) -> Model:
    sc = packed.sparkSession.sparkContext
    one = packed.select("shard", F.posexplode(F.arrays_zip("toxic", "lang")).alias("at", "r")).select(
        "shard", F.col("r.toxic").alias("toxic"), F.col("r.lang").alias("lang"), (F.col("at") % _APART == _APART - 1).alias("apart"))
    seen = {(r["toxic"], r["apart"]): r["n"] for r in one.groupBy("toxic", "apart").agg(F.count("*").alias("n")).collect()}
    found = {y for y, _ in seen}
    if len(found) < 2:
        return Model(None, float(found.pop()) if found else 0.0, np.zeros((1, 1)), np.zeros(1), np.ones(1))
    # a rarer language could not have a threshold of its own
    often = one.groupBy("lang").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    often = often.withColumn("known", F.least("toxic", "clean") >= LEAST_OF_LANGUAGE)
    names = sorted({r["lang"] for r in often.filter("known").select("lang").collect()} | ({""} if often.filter("not known").limit(1).count() else set()))
    number = {name: k for k, name in enumerate(names)}

    keep_apart = len(seen) == 4
    used = {y: sum(n for (label, apart), n in seen.items() if label == y and not (apart and keep_apart)) for y in (0, 1)}
    size, count = sum(used.values()), packed.count()
    epochs = max(EPOCHS, -(-MIN_STEPS * BATCH * count // size))
    net = Net()
    # a single shard has nothing to be averaged with
    for now in [range(epochs)] if count == 1 else [range(e, e + 1) for e in range(epochs)]:
        net = _averaged(packed, net, used[1] / size, now, epochs, keep_apart, count)

    def spoken(texts: Texts, labels: np.ndarray, languages: list[str], shard: int) -> dict:
        counts = _language_counts(texts, np.array([number.get(name, number.get("")) for name in languages]), len(names)).reshape(_LANG_BUCKETS, -1)
        return {"name": np.arange(len(names), dtype=np.int32), "counts": [c.astype(np.int64).tobytes() for c in counts.T]}

    def added(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": group["name"].iloc[:1], "counts": [np.sum([np.frombuffer(c, np.int64) for c in group["counts"]], axis=0).tobytes()]})

    counted = _by_shard(packed, "name int, counts binary", spoken).groupBy("name").applyInPandas(added, "name int, counts binary").orderBy("name").collect()
    table = _language_table(np.column_stack([np.frombuffer(bytes(r["counts"]), np.int64) for r in counted]).astype(np.float64))
    shared, kept = sc.broadcast((net, table)), sum(n for (_, apart), n in seen.items() if apart or not keep_apart)

    def judged(texts: Texts, labels: np.ndarray, languages: list[str], shard: int) -> dict:
        apart = np.flatnonzero(_apart(len(labels), True) if keep_apart else np.ones(len(labels), bool))
        if not len(apart):
            return {"guess": pa.array([], pa.int32()), "toxic": pa.array([], pa.int32()), "logit": pa.array([], pa.float64())}
        mine, (net, table) = texts.take(apart), shared.value
        guess = np.concatenate([mine.take(p).languages(table).argmax(axis=1) for p in np.array_split(np.arange(len(apart)), max(1, len(apart) // 500))])
        return {"guess": guess.astype(np.int32), "toxic": labels[apart].astype(np.int32), "logit": net.logits(mine)}

    logits, path = written(_by_shard(packed, "guess int, toxic int, logit double", judged), "toxicity-judged")
    counts = logits.groupBy("guess", "toxic", "logit").agg(F.count("*").alias("n"))
    limits = calibrated_by_language(counts.toPandas(), len(names)) if kept <= MOST_LOGITS else calibrated_in_chunks(counts, len(names))
    remove(packed.sparkSession, path)
    shared.destroy()
    return Model(net, 0.0, table, limits[:, 0], limits[:, 1])


def with_scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted and logit, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns_from(docs, text, SCORED, lambda texts: score(shared.value, texts))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return with_scores(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted toxic; all columns stay."""
    columns = docs.columns
    model = fit(docs, labels)
    plain = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(columns)})
    kept = with_scores(plain, model, f"c{columns.index('text')}").filter("predicted = 0")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
