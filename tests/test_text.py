import re
from collections import Counter
from math import log

from tabscope.operators import text

DOCS = [
    "The Big Data is big. Big data, BIG DATA! a I x", "it's the organization's data and data's", "", None,
    "Éleère naïve café 42 café_1 3.14 'quoted' words word", "big data big data the big data",
]


def frame(spark):
    return spark.createDataFrame([(d,) for d in DOCS], "text string")


def words(doc):
    return re.findall(r"\w[\w']+", (doc or "").lower())


def test_tokens_and_switches(spark):
    row = frame(spark).select(text.tokens("text").alias("t")).collect()
    assert [r.t for r in row if r.t is not None] == [words(d) for d in DOCS if d is not None]
    stripped = frame(spark).select(text.tokens("text", strip_possessive=True, drop_numbers=True).alias("t")).collect()
    assert stripped[1].t == ["it", "the", "organization", "data", "and", "data"] and "42" not in stripped[4].t


def test_word_weights(spark):
    stop = ["the", "is", "and"]
    want = Counter(w for d in DOCS for w in words(d) if w not in stop)
    got = [tuple(r) for r in text.word_weights(frame(spark), "text", top=5, stop_words=stop).collect()]
    best = sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert got == [(w, n, n / best[0][1]) for w, n in best]
    assert "the" not in {r.word for r in text.word_counts(frame(spark), "text").collect()}


def test_plurals_fold_into_known_singulars(spark):
    df = spark.createDataFrame([("word words words bus glass class",)], "text string")
    got = {r.word: r.n for r in text.word_counts(df, "text", stop_words=[], fold_plurals=True).collect()}
    assert got == {"word": 3, "bus": 1, "glass": 1, "class": 1}


def likelihood(k, n, p):
    return log(max(p, 1e-10)) * k + log(max(1 - p, 1e-10)) * (n - k)


def test_terms_against_a_direct_count(spark):
    docs = ["big data tools", "the big data of big data", "data big", "small tools and tools"] * 30 + ["new york new york"] * 20 + ["big cat", "york data"]
    stop = {"the", "of", "and"}
    single, pair = Counter(), Counter()
    for d in docs:
        t = words(d)
        single.update(w for w in t if w not in stop)
        pair.update((a, b) for a, b in zip(t, t[1:]) if a not in stop and b not in stop)
    total, left = sum(single.values()), Counter(single)
    for (a, b), c12 in pair.items():
        c1, c2 = single[a], single[b]
        p, p1, p2 = c2 / total, c12 / c1, (c2 - c12) / (total - c1)
        score = -2 * (likelihood(c12, c1, p) + likelihood(c2 - c12, total - c1, p) - likelihood(c12, c1, p1) - likelihood(c2 - c12, total - c1, p2))
        if score > 30:
            left[a] -= c12
            left[b] -= c12
            left[f"{a} {b}"] = c12
    df = spark.createDataFrame([(d,) for d in docs], "text string").repartition(5)
    got = {r.term: r.n for r in text.term_weights(df, "text", stop_words=sorted(stop)).collect()}
    assert got == {t: n for t, n in left.items() if n > 0} and "big data" in got and "new york" in got


def test_a_single_repeated_word_has_no_pair_score(spark):
    df = spark.createDataFrame([("spam spam spam",)], "text string")
    assert [(r.term, r.n) for r in text.term_weights(df, "text").collect()] == [("spam", 3)]
    assert text.term_weights(df.limit(0), "text").isEmpty()


def test_terms_with_folded_plurals(spark):
    lines = ["red cars", "red car", "red cars", "glass", "glas", "dog's 12 bus", "bu"] * 40
    df = spark.createDataFrame([(t,) for t in lines], "text string")
    got = {r["term"]: r["n"] for r in text.term_weights(
        df, "text", stop_words=[], fold_plurals=True, strip_possessive=True, drop_numbers=True).collect()}
    # "cars" counts as "car", "glass" keeps its double s, the pair takes both words away
    assert got["red car"] == 120 and "red" not in got and "car" not in got and "cars" not in got
    assert got["glass"] == 40 and got["glas"] == 40


def test_pairs_are_folded_where_they_are_counted(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(text, "materialize", lambda df, tag, write=text.materialize: made.setdefault(tag, write(df, tag)))
    lines = ["red cars", "red car", "blue cars", "red glass", "red glas", "big bus", "big bu", "tall s_", "red"]
    df = spark.createDataFrame([(t,) for t in lines * 20], "text string")
    got = {r["term"]: r["n"] for r in text.term_weights(df, "text", stop_words=[], fold_plurals=True, threshold=-1.0).collect()}
    # a plural and its singular after the same word are one row; only a plural that is alone keeps its s
    assert made["pairs"].filter("a = 'red' and stem = 'car'").count() == 1
    assert {t: n for t, n in got.items() if " " in t} == {"red car": 40, "blue cars": 20, "red glass": 20, "red glas": 20, "big bu": 40, "tall s_": 20}


def test_pairs_meet_their_words_without_being_sorted(spark, monkeypatch):
    made, write = {}, text.materialize
    monkeypatch.setattr(text, "materialize", lambda df, tag: write(made.setdefault(tag, df), tag))
    docs = spark.createDataFrame([("calm rivers run deep",), ("calm rivers run on",), (None,)], "s string")
    terms = {r["term"]: r["n"] for r in text.term_weights(docs, "s", stop_words=["on"], threshold=1.0).collect()}
    plan = made["scored"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in plan
    assert terms["calm rivers"] == terms["rivers run"] == 2
