"""Benchmark decontamination: suffix arrays over the training words, searched for benchmark suffixes.

A shard of documents becomes one array of word numbers. Its suffix array holds the places where a
match of two words can begin (the word and its follower occur in that order in the benchmark, or the
word is an item of its own), sorted by the next ``WINDOW`` words. Every distinct benchmark window is
binary-searched in it; equal diagonals of neighbouring windows join to the longest verbatim matches.

Edge cases: null texts have no words; items without words match nothing; an item of fewer words than
a window is one window; repeated items count once by id; items without an id hit words but are not
listed; repeated documents stay rows; an empty benchmark leaves all documents clean.

Only matches of a whole window are found: a shorter match with an item of 13 or more words is none, and
``longest_match`` is 0 there.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.rows import with_columns_from
from tabscope.llm.words import ALNUM, Words, hash_of

WINDOW = 13
BLOCK_CHARS = 4 << 20  # benchmark text searched for in one pass; more text makes more passes
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MATCH = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()),
    T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType()),
])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("matches", T.ArrayType(_MATCH)),
])


class Block:
    """Windows of some benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.ids: list[str | None] = []
        texts = []
        for item_id, text in items:
            if words := _WORD.findall((text or b"").lower()):
                self.ids.append(item_id)
                texts.append(words)
        names = sorted({w for words in texts for w in words})
        hashes = np.array([hash_of(w) for w in names], np.uint64)
        order = np.argsort(hashes)
        self.words = [b"", *(names[i] for i in order)]  # by number; zero is any other word
        self.hashes = hashes[order]
        number = {w: i for i, w in enumerate(self.words)}
        windows: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, words in enumerate(texts):
            row = [number[w] for w in words]
            size = min(WINDOW, len(row))
            for at in range(len(row) - size + 1):
                windows.setdefault(tuple(row[at : at + size]), []).append((item, at))
        self.keys = np.zeros((len(windows), WINDOW), np.int64)
        self.sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        for i, window in enumerate(windows):
            self.keys[i, : len(window)] = window
        self.places = np.array([p for places in windows.values() for p in places], np.int64).reshape(-1, 2)
        self.place_ends = np.cumsum([len(p) for p in windows.values()], dtype=np.int64)
        pairs = self.keys[:, 0] * len(self.words) + self.keys[:, 1]
        self.pairs = np.unique(pairs[self.sizes > 1])
        self.singles = np.unique(self.keys[self.sizes == 1, 0])

    def search(self, shard: Words) -> pd.DataFrame:
        """Longest verbatim matches: text, item, doc_word, item_word, n_words (of the shard's texts)."""
        empty = pd.DataFrame(columns=["text", "item", "doc_word", "item_word", "n_words"], dtype=np.int64)
        if not len(self.sizes) or not len(shard.starts):
            return empty
        numbers = self._numbers(shard)
        at = self._suffixes(numbers)
        order = np.argsort(prefixes(numbers, at), kind="stable")
        at = at[order]
        sorted_prefixes = prefixes(numbers, at)
        below, above = self._bounds()
        lo = np.searchsorted(sorted_prefixes, below, side="left")
        hi = np.searchsorted(sorted_prefixes, above, side="right")
        window, slot = ranges(lo, hi)
        place = at[slot]
        same = self._verified(shard, numbers, place, window)
        place, window = place[same], window[same]
        if not len(place):
            return empty
        pick, row = ranges(np.concatenate(([0], self.place_ends[:-1]))[window], self.place_ends[window])
        word = place[pick] - self._text(shard, place[pick])
        text = shard.text_of[word]
        found = pd.DataFrame({
            "text": text, "item": self.places[row, 0], "item_word": self.places[row, 1],
            "doc_word": word - (np.cumsum(shard.counts) - shard.counts)[text], "n_words": self.sizes[window[pick]],
        })
        return longest(found)

    def _numbers(self, shard: Words) -> np.ndarray:
        """Word numbers of the shard, a zero after each text and ``WINDOW`` zeros at the end."""
        hashes = shard.hashes()
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        numbers = np.zeros(len(hashes) + len(shard.counts) + WINDOW, np.int64)
        numbers[np.arange(len(hashes)) + shard.text_of] = np.where(self.hashes[slot] == hashes, slot + 1, 0)
        return numbers

    def _text(self, shard: Words, place: np.ndarray) -> np.ndarray:
        """The text that a place of the word numbers belongs to; as many separators stand before it."""
        return np.searchsorted(np.cumsum(shard.counts + 1), place, side="right")

    def _suffixes(self, numbers: np.ndarray) -> np.ndarray:
        known = np.flatnonzero(numbers[:-1])
        pair = numbers[known] * len(self.words) + numbers[known + 1]
        start = _among(pair, self.pairs)
        if len(self.singles):
            start |= _among(numbers[known], self.singles)
        return known[start]

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        top = np.where(np.arange(WINDOW) < self.sizes[:, None], self.keys, 0xFFFFFFFF)
        return packed(self.keys), packed(top)

    def _verified(self, shard: Words, numbers: np.ndarray, place: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether the words themselves are equal, not only their hashes."""
        first = place - self._text(shard, place)
        return np.fromiter((
            all(shard.word(p + k) == self.words[number] for k, number in enumerate(self.keys[w, : self.sizes[w]]))
            for p, w in zip(first, window)
        ), bool, len(first))


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort alike."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * WINDOW}").ravel()


def prefixes(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
    return packed(numbers[at[:, None] + np.arange(WINDOW)])


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all i, (i, j) for each j in lo[i]:hi[i]."""
    n = hi - lo
    owner = np.repeat(np.arange(len(lo)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def longest(found: pd.DataFrame) -> pd.DataFrame:
    """Join windows on one diagonal whose words follow each other."""
    found = found.assign(diagonal=found.doc_word - found.item_word)
    found = found.sort_values(["text", "item", "diagonal", "doc_word"], ignore_index=True)
    keys = found[["text", "item", "diagonal"]]
    follows = (keys == keys.shift()).all(axis=1) & (found.doc_word <= found.doc_word.shift() + 1)
    run = (~follows).cumsum()
    joined = found.assign(end=found.doc_word + found.n_words).groupby(run, sort=False).agg(
        text=("text", "first"), item=("item", "first"), doc_word=("doc_word", "first"),
        item_word=("item_word", "first"), end=("end", "max"),
    )
    return joined.assign(n_words=joined.end - joined.doc_word).drop(columns="end")


def union(spans: list) -> list[list[int]]:
    """Sorted spans [start, end) without overlaps."""
    out: list[list[int]] = []
    for start, end in sorted(tuple(s) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def with_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, hits (spans of words inside a window) and matches (longest verbatim ones).

    The benchmark goes out in blocks of about ``BLOCK_CHARS`` characters, each a pass over the
    documents inside the same tasks; a pass adds what it finds to the columns of the pass before.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    found = docs
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(Block([(r["id"], bytes(r["text"] or b"")) for r in mine.collect()]))
        found = _pass(found, block, text, k)
    return found


def _pass(docs: DataFrame, block, text: str, number: int) -> DataFrame:
    fields = T.StructType([f for f in FOUND.fields]) if number == 0 else T.StructType(
        [T.StructField(f"{f.name}__{number}", f.dataType) for f in FOUND.fields])

    def run(texts: list[bytes | None]) -> dict:
        search = block.value
        shard = Words(texts, ALNUM)
        found = search.search(shard)
        hits = [[] for _ in texts]
        matches = [[] for _ in texts]
        for t, item, doc_word, item_word, n in found[["text", "item", "doc_word", "item_word", "n_words"]].itertuples(index=False, name=None):
            hits[t].append((doc_word, doc_word + n))
            matches[t].append({"item_id": search.ids[item], "doc_word": doc_word, "item_word": item_word, "n_words": n})
        hits = [union(h) for h in hits]
        return dict(zip(fields.names, (shard.counts, [sum(e - s for s, e in h) for h in hits], hits, matches)))

    made = with_columns_from(docs, text, fields, run)
    if number == 0:
        return made
    later = {f.name: F.col(f"{f.name}__{number}") for f in FOUND.fields}
    merged = made.withColumns({"hits": merged_spans("hits", later["hits"]), "matches": F.concat("matches", later["matches"])})
    merged = merged.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]))
    return merged.drop(*fields.names)


def merged_spans(name: str, other) -> Column:
    """Union of two arrays of spans; adjacent and overlapping ones join."""
    both = F.array_sort(F.concat(name, other))
    none = F.array().cast("array<array<bigint>>")

    def add(out, span):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when((F.size(out) > 0) & (span[0] <= F.try_element_at(out, F.lit(-1))[1]), joined).otherwise(F.concat(out, F.array(span)))

    return F.aggregate(both, none, add)


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match, per document."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["n_words"])), F.lit(0).cast("long")).alias("longest_match"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; all columns stay."""
    columns = docs.columns
    plain = docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(columns)})
    found = with_matches(plain, benchmark, f"c{columns.index('text')}")
    return found.filter(~is_contaminated()).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
