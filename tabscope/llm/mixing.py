"""Mixing to target weights: soft domain membership, rates by projected-gradient least squares.

DataFrame expressions only. A hashed-word naive Bayes classifier, counted from a bounded sample of
the labelled documents, gives each document posteriors p over the domains. Its rate w >= 0 says how
often it is to be drawn. With t tokens in the document, S_k = sum of w t p_k is the expected size of
domain k and T_k its target; the rates minimise the sum of (S_k - T_k)^2 / D_k, where D_k is the sum
of t p_k. In the metric of tokens the gradient at a document is a sum of p_k times numbers that all
documents share, so a step is one pass that adds up S, and a document's rate is a chain of projected
steps over the numbers of the passes before. The gradient is scaled by the inverse of the sums of
t p_j p_k over the documents whose rate is above 0: without the projection one step would reach the
best fit, and with it a dozen do. Nothing but K + K x K numbers moves. Posteriors are stated in parts
of ``GRAIN``, and documents of equal posteriors have equal rates, so they are added up once: the passes
read a table of at most half a million rows (three domains), however many documents there are.

Edge cases: null and empty texts have no tokens, prior posteriors, and the rate the steps give them;
without labels the posteriors are uniform; a domain nobody belongs to is left out of the fit; rates
are never negative; a text of any length is read whole; repeated rows stay rows; an empty table gives no rows; columns of the output's names are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.folds import labelled_sample
from tabscope.llm.rows import without
from tabscope.scratch import materialize

DOMAINS = ("good", "plain", "toxic")  # quality 1 and not toxic; quality 0 and not toxic; toxic
TARGETS = {"good": 0.90, "plain": 0.09, "toxic": 0.01}
BUDGET = 0.5  # tokens to draw, as a share of the tokens there are
TRAIN_BYTES = 4 << 20  # text learned from, for each domain
BUCKETS = 1 << 12
EVIDENCE = 40.0  # words that a document's evidence counts as, at most
TOLERANCE = 1e-4  # miss of a target that counts as met, as a share of all wanted tokens
STILL = 1e-6  # tokens that a step moves where the best fit misses a target, as a share of all wanted tokens
WRITE_AFTER = 30  # steps, then the rates are written and the next steps start from them
MOST_STEPS = 2000  # a fit that still moves after so many is an error, never a result
GRAIN = 1000  # a posterior is a whole number of parts of this size
DIGITS = 6


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    return F.when(F.col(toxic) == 1, "toxic").when(F.col(quality) == 1, "good").when(F.col(quality) == 0, "plain")


def words(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\r\x0b\x0c", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int") + 1


def learn(docs: DataFrame, labels: DataFrame, train_bytes: int = TRAIN_BYTES) -> tuple[list[float], list[list[float]]]:
    """(log prior by domain, log-probability by domain and bucket), counted in Spark; BUCKETS x domains numbers come back."""
    marks = labels.select("doc_id", domain_of().alias("domain")).filter("domain is not null")
    picked, sized = labelled_sample(docs.select("doc_id", "text"), marks, "domain", "text", train_bytes, len(DOMAINS))
    priors = {r["domain"]: r["count"] for r in sized.groupBy("domain").count().collect()}
    counts = picked.select("domain", F.explode(words(F.col("text"))).alias("word")).groupBy("domain", bucket(F.col("word")).alias("b")).count().collect()
    table = [[0.5] * BUCKETS for _ in DOMAINS]
    for r in counts:
        table[DOMAINS.index(r["domain"])][r["b"] - 1] += r["count"]
    logs = [[math.log(c / total) for c in row] for row in table for total in [sum(row)]]
    total = sum(priors.values()) + len(DOMAINS)
    return [math.log((priors.get(d, 0) + 1) / total) for d in DOMAINS], logs


def _summed(held: Column) -> Column:
    return F.aggregate("__b", F.lit(0.0), lambda s, b: s + F.element_at(held, b))


def with_posteriors(docs: DataFrame, model: tuple[list[float], list[list[float]]], text: str = "text") -> DataFrame:
    """``docs`` with n_tokens and p (posteriors in the order of ``DOMAINS``, in whole parts of ``GRAIN``)."""
    prior, logs = model
    tokens = without(docs, "n_tokens", "p", "__b", "__l").withColumn("__b", F.transform(words(F.col(text)), bucket))
    tokens = tokens.withColumn("n_tokens", F.size("__b").cast("long"))
    share = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.greatest(F.col("n_tokens"), F.lit(1)))
    odds = [F.lit(0.0)]
    for k in range(1, len(DOMAINS)):  # relative to the first domain
        weights = ",".join(f"{a - b:.6g}" for a, b in zip(logs[k], logs[0]))
        held = F.split(F.lit(weights), ",").cast("array<double>")  # one constant after folding
        odds.append(share * _summed(held) + F.lit(prior[k] - prior[0]))
    tokens = tokens.withColumn("__l", F.array(*odds)).withColumn("__l", F.transform("__l", lambda x: F.exp(x - F.array_max("__l"))))
    total = F.aggregate("__l", F.lit(0.0), lambda s, x: s + x)
    tokens = tokens.withColumn("__l", F.transform("__l", lambda x: F.round(x / total * GRAIN)))
    parts, left = [], F.lit(float(GRAIN))
    for k in range(1, len(DOMAINS)):
        parts.append(F.least(F.col("__l")[k], left))
        left = left - parts[-1]
    return tokens.withColumn("p", F.transform(F.array(left, *parts), lambda x: x / GRAIN)).drop("__b", "__l")


def grouped(members: DataFrame) -> DataFrame:
    """Tokens of the documents of equal posteriors: all that the fit needs to know."""
    return materialize(members.groupBy("p").agg(F.sum("n_tokens").alias("n_tokens")), "mixing-groups")


def rate(history: list[list[float]], start: float) -> Column:
    """A document's rate after the steps of ``history``, each what a document of a domain alone loses.

    The steps are one constant array, so the expression is as small after many steps as after one.
    """
    return _rates(history, _both(F.lit(start), F.lit(start)))["now"]


def _both(now: Column, before: Column) -> Column:
    return F.struct(now.alias("now"), before.alias("before"))


def _rates(history: list[list[float]], start: Column) -> Column:
    """The rate after the last step and the one before it."""
    if not history:
        return start
    listed = F.lit(";".join(",".join(repr(r) for r in row) for row in history))
    steps = F.transform(F.split(listed, ";"), lambda r: F.split(r, ",").cast("array<double>"))

    def step(w: Column, row: Column) -> Column:
        slope = sum((F.col("p")[k] * row[k] for k in range(len(DOMAINS))), F.lit(0.0))
        return _both(F.greatest(F.lit(0.0), w["now"] - slope), w["now"])

    return F.aggregate(steps, start, step)


def _sizes(members: DataFrame, rates: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """(expected tokens by domain, tokens by pair of domains of the documents of a rate above 0, tokens that the last step moved)."""
    kinds = range(len(DOMAINS))
    drawn = members.select(rates.alias("w"), "n_tokens", "p")
    sums = [F.sum(F.col("w")["now"] * F.col("n_tokens") * F.col("p")[k]) for k in kinds]
    pairs = [F.sum(F.when(F.col("w")["now"] > 0, F.col("n_tokens") * F.col("p")[k] * F.col("p")[j])) for k in kinds for j in kinds]
    row = np.array([float(x or 0.0) for x in drawn.agg(*sums, *pairs, F.sum(F.abs(F.col("w")["now"] - F.col("w")["before"]) * F.col("n_tokens"))).first()])
    return row[: len(DOMAINS)], row[len(DOMAINS) : -1].reshape(len(DOMAINS), len(DOMAINS)), float(row[-1])


def wanted_tokens(members: DataFrame, targets: dict[str, float], budget: float) -> tuple[list[float], list[float]]:
    """(tokens there are, tokens wanted), by domain."""
    there = _sizes(members, _both(F.lit(1.0), F.lit(1.0)))[0].tolist()
    return there, [budget * sum(there) * targets[d] / sum(targets.values()) for d in DOMAINS]


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> tuple[list[list[float]], float]:
    """(history, start) for ``rate`` from a written table of n_tokens and p, see ``grouped``.

    The fit ends when every target is met, or when a step moves next to nothing: then the rates are the
    best ones although domains that cannot be told apart, or have too few tokens, miss their targets.
    """
    there, wanted = map(np.array, wanted_tokens(members, targets, budget))
    whole, used = max(wanted.sum(), 1.0), there > 0
    scale = np.where(used, 1 / np.sqrt(np.where(used, there, 1.0)), 0.0)
    history: list[list[float]] = []
    held, start, since = members, _both(F.lit(budget), F.lit(budget)), 0
    while len(history) < MOST_STEPS:
        now, between, moved = _sizes(held, _rates(history[since:], start))
        miss = np.where(used, now - wanted, 0.0)
        if np.abs(miss).max() <= TOLERANCE * whole or (history and moved <= STILL * whole):
            return history, budget
        if len(history) - since == WRITE_AFTER:
            held = materialize(held.select("n_tokens", "p", _rates(history[since:], start).alias("w")), "mixing-rates")
            start, since = F.col("w"), len(history)
        history.append((np.linalg.pinv(scale[:, None] * between, rcond=1e-9) @ (scale * miss)).tolist())
    raise RuntimeError(f"the rates still move after {MOST_STEPS} steps")


def totals(members: DataFrame, history: list[list[float]], start: float, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """domain, there, wanted, reached: tokens, with the rates of ``history``."""
    there, wanted = wanted_tokens(members, targets, budget)
    reached = _sizes(members, _rates(history, _both(F.lit(start), F.lit(start))))[0].tolist()
    return members.sparkSession.createDataFrame(list(zip(DOMAINS, there, wanted, reached)), "domain string, there double, wanted double, reached double")


def mix(docs: DataFrame, labels: DataFrame, text: str = "text", targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """``docs`` without its text, with n_tokens, p, domain (the likeliest) and rate."""
    scored = with_posteriors(docs, learn(docs.withColumnRenamed(text, "text"), labels), text).drop(text)
    members = materialize(scored, "mixing")
    history, start = fit_rates(grouped(members), targets, budget)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    likeliest = F.element_at(names, F.array_position("p", F.array_max("p")).cast("int"))
    return without(members, "domain", "rate").withColumn("domain", likeliest).withColumn("rate", F.round(rate(history, start), DIGITS))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = mix(docs.select("doc_id", "text"), labels)
    posteriors = [F.round(F.col("p")[k], DIGITS).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return found.select("doc_id", "n_tokens", *posteriors, "domain", "rate")


def apply_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the column ``rate``; documents of rate zero go. A column ``rate`` is replaced."""
    model = learn(docs, labels)
    columns = [c for c in docs.columns if c.lower() != "rate"]
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    scored = materialize(with_posteriors(plain, model, f"c{columns.index('text')}"), "mixing-rows")
    history, start = fit_rates(grouped(scored))
    kept = scored.withColumn("rate", F.round(rate(history, start), DIGITS)).filter("rate > 0")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "rate")
