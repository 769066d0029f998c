"""Word weights over a text column, with adjacent pairs as terms on request."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscope.scratch import materialize

# A word is a letter, digit or underscore followed by at least one more of those or an
# apostrophe; pair threshold and number of terms are the usual word-cloud ones.
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"
PAIR_THRESHOLD = 30.0
MAX_WORDS = 100


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: str | Column, strip_possessive: bool = False, drop_numbers: bool = False) -> Column:
    """Lower-case words of a text in order."""
    words = F.regexp_extract_all(F.lower(F.col(text) if isinstance(text, str) else text), F.lit(WORD), F.lit(0))
    if strip_possessive:
        words = F.transform(words, lambda w: F.regexp_replace(w, "'s$", ""))
    if drop_numbers:
        words = F.filter(words, lambda w: ~w.rlike(r"^\p{N}+$"))
    return words


def word_counts(
    df: DataFrame,
    text: str,
    stop_words: Sequence[str] | None = None,
    fold_plurals: bool = False,
    **token_options: bool,
) -> DataFrame:
    """``(word, n)`` over the whole column, stop words left out."""
    stop = default_stop_words() if stop_words is None else list(stop_words)
    words = df.select(F.explode(tokens(text, **token_options)).alias("word"))
    if stop:
        words = words.filter(~F.col("word").isin(stop))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return _fold_plurals(counts) if fold_plurals else counts


def _plural(word: str) -> Column:
    return F.col(word).endswith("s") & ~F.col(word).endswith("ss")


def _stem(word: str) -> Column:
    """The word without a last single s."""
    return F.when(_plural(word), F.substring(F.col(word), F.lit(1), F.length(word) - 1)).otherwise(F.col(word))


def _standard_forms(counts: DataFrame) -> DataFrame:
    """``standard``: the word, without a last single s where the table has that word too."""
    singular = counts.select(F.col("word").alias("base"), F.lit(True).alias("known"))
    based = counts.withColumn("base", F.when(_plural("word"), _stem("word")))
    joined = based.join(singular, "base", "left")
    return joined.withColumn("standard", F.when(F.col("known"), F.col("base")).otherwise(F.col("word"))).drop("base", "known")


def _fold_plurals(counts: DataFrame) -> DataFrame:
    """Add the count of ``words`` to ``word`` where both occur (not for words ending in ``ss``)."""
    return _standard_forms(counts).groupBy("standard").agg(F.sum("n").alias("n")).withColumnRenamed("standard", "word")


def _weights(counts: DataFrame, term: str, top: int) -> DataFrame:
    """The ``top`` most frequent terms (ties in term order) with weight = count / largest count."""
    best = counts.orderBy(F.col("n").desc(), term).limit(top)
    # the largest count is among the kept terms, so the window sees ``top`` rows at most
    return best.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))


def word_weights(df: DataFrame, text: str, top: int = MAX_WORDS, **options) -> DataFrame:
    """Top words with their weights; the column is never joined into one text."""
    return _weights(word_counts(df, text, **options), "word", top)


def _log_likelihood(k: Column, n: Column, p: Column) -> Column:
    tiny = F.lit(1e-10)
    return k * F.log(F.greatest(p, tiny)) + (n - k) * F.log(F.greatest(F.lit(1.0) - p, tiny))


def pair_score(both: Column, first: Column, second: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of a pair; 0 when one word makes up the whole text."""
    apart, other = second - both, total - first
    p = second / total
    p1, p2 = both / first, F.try_divide(apart, other)
    ratio = (
        _log_likelihood(both, first, p) + _log_likelihood(apart, other, p)
        - _log_likelihood(both, first, p1) - _log_likelihood(apart, other, p2)
    )
    return F.when((total <= first) | (total <= second), F.lit(0.0)).otherwise(ratio * -2.0)


def term_weights(
    df: DataFrame,
    text: str,
    stop_words: Sequence[str] | None = None,
    threshold: float = PAIR_THRESHOLD,
    top: int = MAX_WORDS,
    fold_plurals: bool = False,
    **token_options: bool,
) -> DataFrame:
    """Word weights where strongly associated neighbours count as one term.

    Pairs are neighbours in the full word sequence of a document, neither being a stop word. A pair
    scoring over the threshold becomes a term, and its count is taken off both of its words.
    ``fold_plurals`` counts ``words`` as ``word``, and pairs ending in it likewise, where both occur.
    """
    stop = default_stop_words() if stop_words is None else list(stop_words)
    words = df.select(tokens(text, **token_options).alias("t"))
    # every word with its right neighbour; a pair that cannot become a term keeps its first word
    # only, so most rows collapse before the shuffle
    following = F.slice("t", F.lit(2), F.size("t"))
    runs = words.select(F.inline(F.arrays_zip(F.col("t").alias("a"), following.alias("b"))))
    if stop:
        runs = runs.filter(~F.col("a").isin(stop)).withColumn("b", F.when(~F.col("b").isin(stop), F.col("b")))
    # written, because words, pairs and the total all come from it: the texts are read once
    if fold_plurals:
        # a plural and its singular meet in one row, so pairs are folded where they are counted
        made = F.count("*").cast("double").alias("n"), F.count_if(_plural("b")).cast("double").alias("plural")
        together = materialize(runs.groupBy("a", _stem("b").alias("stem")).agg(*made), "pairs")
    else:
        together = materialize(runs.groupBy("a", "b").agg(F.count("*").cast("double").alias("n")), "pairs")
    counts = together.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))
    if fold_plurals:
        forms = materialize(_standard_forms(counts), "forms")
        counts = materialize(forms.groupBy("standard").agg(F.sum("n").alias("n")), "words")
        lookup = materialize(forms.select("word", "standard").join(counts, "standard").select("word", "standard", "n"), "lookup")
        counts = counts.withColumnRenamed("standard", "word")
        alone = F.col("plural") == F.col("n")
        pairs = together.filter(F.col("stem").isNotNull()).select("a", F.when(alone, F.concat("stem", F.lit("s"))).otherwise(F.col("stem")).alias("b"), "n")
    else:
        counts = materialize(counts, "words")
        lookup = counts.select("word", F.col("word").alias("standard"), "n")
        pairs = together.filter(F.col("b").isNotNull())
    total = F.lit(float(counts.agg(F.sum("n").alias("t")).first()["t"] or 0.0))

    # one row a word, dealt evenly: each task holds its words, and the pairs, many times more, are not sorted to meet them
    scored = materialize(
        pairs.join(lookup.toDF("a", "wa", "na").hint("shuffle_hash"), "a")
        .join(lookup.toDF("b", "wb", "nb").hint("shuffle_hash"), "b")
        .withColumn("score", pair_score(F.col("n"), F.col("na"), F.col("nb"), total))
        .filter(F.col("score") > threshold)
        .select("a", "b", "wa", "wb", "n"),
        "scored",
    )
    taken = (
        scored.select(F.explode(F.array("wa", "wb")).alias("word"), "n")
        .groupBy("word").agg(F.sum("n").alias("taken"))
    )
    left = counts.join(taken, "word", "left").select(
        F.col("word").alias("term"), (F.col("n") - F.coalesce("taken", F.lit(0.0))).alias("n")
    )
    terms = left.unionByName(scored.select(F.concat_ws(" ", "a", "b").alias("term"), "n")).filter(F.col("n") > 0)
    return _weights(terms.select("term", F.col("n").cast("bigint").alias("n")), "term", top)
