"""Quality rules with host verdicts: a document fails by its own text or by the record of its source.

Edge cases: a null text has no words and fails; a null source is a host of its own; repeated rows
count as rows; an empty table gives no hosts; columns of the output's names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.rows import with_columns_from
from tabscope.scratch import materialize

MIN_WORDS = 50
WINDOW = 3
MAX_HOST_RATE = 0.5
FACTS = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
_BLANK = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))


def text_facts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows of a text."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return (
        len(words), len(text.translate(None, _BLANK + _CONTINUATION)), len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside a window of ``size`` words that occurs twice or more in the text."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    keys = ids[: len(ids) - size + 1]
    for k in range(1, size):  # number pairs of (window so far, next word), so keys stay exact
        keys = np.unique(keys * len(number) + ids[k : len(ids) - size + 1 + k], return_inverse=True)[1]
    twice = np.bincount(keys)[keys] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def with_facts(docs: DataFrame, text: str = "text") -> DataFrame:
    def run(texts: list[bytes | None]) -> dict:
        return dict(zip(FACTS.names, np.array([text_facts(t) for t in texts], np.int64).T))

    return with_columns_from(docs, text, FACTS, run)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_verdicts(checked: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per host: n_docs, n_failed, shrunken failure rate and whether the host is rejected.

    Hosts are first summed to (n, failed); the beta prior is fitted to the hosts' rates by moments,
    each host weighing its documents. m is the overall rate, v the variance of the rates beyond that
    of the draws; the prior has strength m(1-m)/v - 1, at least 1, and none beyond 10,000.
    """
    hosts = checked.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = materialize(hosts, "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    fitted = hosts.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"),
        F.sum(F.col("n_failed") * rate).alias("s"),
    ).first()
    strength, mean = beta_prior(fitted["n"] or 0, fitted["f"] or 0, fitted["k"], fitted["s"] or 0.0)
    shrunk = (F.col("n_failed") + F.lit(strength * mean)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > max_rate)


def beta_prior(n: int, failed: int, hosts: int, squares: float) -> tuple[float, float]:
    """(strength, mean). ``squares``: sum over hosts of documents times squared rate."""
    if not n:
        return 1.0, 0.0
    mean = failed / n
    drawn = mean * (1 - mean)
    spread = squares / n - mean * mean - drawn * hosts / n
    strength = drawn / spread - 1 if spread > 0 else 1e4
    return min(max(strength, 1.0), 1e4), mean


def judged(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without its text, with the facts, base_failed, host_rate, host_rejected and kept."""
    facts = with_facts(docs, text)
    made = facts.drop(text).withColumn("base_failed", base_failed())
    made = materialize(made, "quality")
    hosts = host_verdicts(made.select(F.col(host), F.col("base_failed").alias("failed")), host)
    hosts = hosts.select(F.col(host).alias("__host"), "host_rate", "host_rejected")
    joined = made.join(hosts, F.col(host).eqNullSafe(F.col("__host"))).drop("__host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def report(docs: DataFrame) -> DataFrame:
    found = judged(docs.select("doc_id", "source", "text"))
    return found.select("doc_id", *FACTS.names, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"), "host_rejected")
