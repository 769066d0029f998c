"""Language identification: interpolated Kneser-Ney character models, the lowest cross-entropy wins.

The models of all languages share sorted arrays of n-gram hashes, one per order, with a column of
log-probabilities per language, so one binary search serves every language. Texts are lower-cased,
runs of anything but letters are one space.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without any labelled
training row every text is ``und``; equal cross-entropies go to the first language by name; rows
without lang are never learned from; columns of the output's names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.folds import bounded_sample, held_out
from tabscope.llm.rows import shards, with_columns_from
from tabscope.llm.words import mixed

ORDER = 4
TRAIN_BYTES = 1 << 20  # text learned from, for each language
UNKNOWN = "und"
REJECT_QUANTILE = 0.995
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHARD = 1 << 20
_LETTERS = None
PREDICTED = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


class Stream:
    """The characters of some texts in a row, ``ORDER`` - 1 spaces before each and a space at its end."""

    def __init__(self, texts: list[str]):
        joined = (" " * (ORDER - 1)).join(["", *(t.lower() + "\n" for t in texts)])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter((len(t.lower()) + ORDER for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        is_letter = letters()[codes]
        codes = np.where(is_letter, codes, 0x20)
        text_of = np.repeat(np.arange(len(texts)), sizes)
        pad = np.zeros(len(codes), bool)
        pad[((ends - sizes)[:, None] + np.arange(ORDER - 1)).ravel()] = True
        again = ~is_letter & np.concatenate(([False], ~is_letter[:-1])) & ~pad
        self.letters = np.bincount(text_of[is_letter], minlength=len(texts))
        keep = ~again
        keep[(ends - 1)[self.letters == 0]] = True
        self.codes, self.text_of, self.pad = codes[keep].astype(np.uint64), text_of[keep], pad[keep]
        self.scored = np.flatnonzero(~self.pad)

    def hashes(self, order: int) -> np.ndarray:
        """Hash of the last ``order`` characters at each place (the first places wrap around)."""
        h = np.zeros(len(self.codes), np.uint64)
        for back in range(order - 1, -1, -1):
            h = h * _STEP + np.roll(self.codes, back) + np.uint64(1)
        return mixed(h + np.uint64(order))


@dataclass
class Order:
    keys: np.ndarray
    logp: np.ndarray  # by key and language
    contexts: np.ndarray
    backoff: np.ndarray  # log weight of the lower order, by context and language


@dataclass
class Model:
    languages: list[str]
    orders: list[Order] = field(default_factory=list)
    unseen: np.ndarray = None  # log-probability of a character never seen
    limits: np.ndarray = None  # cross-entropy beyond which a prediction is rejected


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, found) of each wanted value in a sorted array."""
    slot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return slot, keys[slot] == wanted


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit from (language, text). Every fifth text of a language sets its limit and is not counted."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    model = Model(sorted(by))
    if not by:
        return model
    counted = {lang: [t for i, t in enumerate(by[lang]) if i % 5] or by[lang] for lang in model.languages}
    streams = [Stream(counted[lang]) for lang in model.languages]
    grams = [_grams(s) for s in streams]
    _fit(model, grams)
    model.limits = np.full(len(model.languages), np.inf)
    for k, lang in enumerate(model.languages):
        apart = by[lang][::5]
        losses, n = cross_entropies(model, Stream(apart))
        mine = losses[n > 20, k]
        if len(mine) >= 20:
            model.limits[k] = np.quantile(mine, REJECT_QUANTILE) * 1.25
    return model


def _grams(stream: Stream) -> list[dict]:
    """Per order 1..ORDER: distinct n-grams, the hashes of their context and of their suffix, counts."""
    at = stream.scored
    hashes = [None, *(stream.hashes(n) for n in range(1, ORDER + 1))]
    made: list[dict] = []
    for n in range(ORDER, 0, -1):
        if n == ORDER:
            keys, first, counts = np.unique(hashes[n][at], return_index=True, return_counts=True)
        else:  # in how many ways an n-gram continues on its left
            keys, first, counts = np.unique(made[0]["suffix"], return_index=True, return_counts=True)
            first = made[0]["first"][first]
        place = at[first]
        empty = np.zeros(len(keys), np.uint64)
        made.insert(0, {
            "keys": keys, "counts": counts.astype(float), "first": first,
            "context": hashes[n - 1][place - 1] if n > 1 else empty, "suffix": hashes[n - 1][place] if n > 1 else empty,
        })
    return made


def _fit(model: Model, grams: list[list[dict]]) -> None:
    languages = len(grams)
    symbols = [len(g[0]["keys"]) for g in grams]
    model.unseen = -np.log(np.array(symbols) + 1.0)
    lower_keys, lower = None, None
    for n in range(ORDER):
        every = np.concatenate([g[n]["keys"] for g in grams])
        keys, first = np.unique(every, return_index=True)
        context = np.concatenate([g[n]["context"] for g in grams])[first]
        suffix = np.concatenate([g[n]["suffix"] for g in grams])[first]
        contexts = np.unique(context)
        if n == 0:
            below = np.broadcast_to(np.exp(model.unseen), (len(keys), languages))
        else:
            below = lower[np.searchsorted(lower_keys, suffix)]
        weight = np.ones((len(contexts), languages))
        seen = np.zeros((len(keys), languages))
        for k, g in enumerate(grams):
            c = g[n]["counts"]
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.75
            slot = np.searchsorted(contexts, g[n]["context"])
            total = np.bincount(slot, weights=c, minlength=len(contexts))
            kinds = np.bincount(slot, minlength=len(contexts))
            weight[:, k] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            seen[np.searchsorted(keys, g[n]["keys"]), k] = np.maximum(c - discount, 0) / total[slot]
        p = seen + weight[np.searchsorted(contexts, context)] * below
        model.orders.append(Order(keys, np.log(p), contexts, np.log(weight)))
        lower_keys, lower = keys, p


def cross_entropies(model: Model, stream: Stream) -> tuple[np.ndarray, np.ndarray]:
    """(nats per character by text and language, characters by text)."""
    at = stream.scored
    logp = np.zeros((len(at), len(model.languages)))
    left = np.arange(len(at))
    hashes = stream.hashes(ORDER)
    for n in range(ORDER, 0, -1):
        order = model.orders[n - 1]
        slot, found = find(order.keys, hashes[at[left]])
        logp[left[found]] += order.logp[slot[found]]
        left = left[~found]
        if not len(left):
            break
        if n > 1:
            hashes = stream.hashes(n - 1)
            slot, known = find(order.contexts, hashes[at[left] - 1])
        else:
            slot, known = np.zeros(len(left), int), np.ones(len(left), bool)
            logp[left] += model.unseen
        logp[left[known]] += order.backoff[slot[known]]
    first = np.flatnonzero(np.diff(stream.text_of[at], prepend=-1))
    counts = np.bincount(stream.text_of[at], minlength=len(stream.letters))
    return -np.add.reduceat(logp, first) / counts[:, None], counts


def predict(model: Model, texts: list[bytes | None]) -> dict:
    """Columns of ``PREDICTED`` for some texts."""
    lang, score, loss, rejected = [], [], [], []
    for start, stop in shards(texts, _SHARD):
        stream = Stream([(t or b"").decode("utf-8", "replace") for t in texts[start:stop]])
        if not model.languages:
            n = stop - start
            lang += [UNKNOWN] * n
            score += [0.0] * n
            loss += [None] * n
            rejected += [True] * n
            continue
        losses, n = cross_entropies(model, stream)
        best = losses.argmin(axis=1)
        rows = np.arange(len(best))
        apart = (losses[rows, best][:, None] - losses) * np.minimum(n, 30)[:, None]
        sure = 1 / np.exp(apart).sum(axis=1)
        for i, k in enumerate(best):
            some = stream.letters[i] > 0
            lang.append(model.languages[k] if some else UNKNOWN)
            score.append(float(sure[i]) if some else 0.0)
            loss.append(float(losses[i, k]) if some else None)
            rejected.append(bool(not some or losses[i, k] > model.limits[k]))
    return {"lang_pred": lang, "score": score, "cross_entropy": loss, "rejected": rejected}


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", train_bytes: int = TRAIN_BYTES) -> Model:
    """Learn from about ``train_bytes`` bytes of each language's documents that are not held out."""
    rows = docs.select(doc_id, F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(~held_out(doc_id) & F.col("text").rlike(r"\p{L}"))
    picked = bounded_sample(rows, "lang", "text", train_bytes, doc_id)
    return train(sorted((r["lang"], r["text"]) for r in picked.select("lang", "text").collect()))


def with_languages(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected, from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns_from(docs, text, PREDICTED, lambda texts: predict(shared.value, texts))


def report(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_languages(rows, model).drop("text")
