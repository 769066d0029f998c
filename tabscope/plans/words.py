"""Word and term weights over the text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.operators import text
from tabscope.plans import Catalog
from tabscope.plans.views import rounded, table, with_ctes

catalog = Catalog()
query = catalog.query

# Stop words of the registered queries, so that the SQL can name them too.
STOP_WORDS = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "is", "it", "that", "this", "for", "with", "as", "are", "be", "by", "at"]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(table_name: str, column: str) -> str:
    return f"docs AS (SELECT regexp_extract_all(lower({column}), '{text.WORD.replace(chr(39), chr(39) * 2)}') AS t FROM {table_name})"


COUNTS = f"""counts AS (SELECT word, count(*) AS n FROM (SELECT unnest(t) AS word FROM docs) WHERE word NOT IN ({_STOP}) GROUP BY word)"""
TOP = """SELECT word, n, round(n / (SELECT max(n) FROM counts), 6) AS weight FROM counts ORDER BY n DESC, word LIMIT 100"""


@query("t1_word_weights", with_ctes(TOP, _tokens("documents", "text"), COUNTS))
def word_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(text.word_weights(table(spark, folder, "documents"), "text", stop_words=STOP_WORDS))


_SCORED = """probs AS (SELECT *, c2 / total AS p, c12 / c1 AS p1, (c2 - c12) / nullif(total - c1, 0) AS p2 FROM base),
scored AS (SELECT * EXCLUDE (c12, c1, c2), c12 AS n FROM probs WHERE CASE WHEN total <= c1 OR total <= c2 THEN 0 ELSE -2 * (
    ln(greatest(p, 1e-10)) * c12 + ln(greatest(1 - p, 1e-10)) * (c1 - c12)
  + ln(greatest(p, 1e-10)) * (c2 - c12) + ln(greatest(1 - p, 1e-10)) * (total - c1 - (c2 - c12))
  - ln(greatest(p1, 1e-10)) * c12 - ln(greatest(1 - p1, 1e-10)) * (c1 - c12)
  - ln(greatest(p2, 1e-10)) * (c2 - c12) - ln(greatest(1 - p2, 1e-10)) * (total - c1 - (c2 - c12))) END > 30)"""
_LEFT_TERMS = """terms AS (SELECT s.word AS term, CAST(s.n - coalesce(t.n, 0) AS BIGINT) AS n FROM singles s LEFT JOIN taken t USING (word) WHERE s.n - coalesce(t.n, 0) > 0
  UNION ALL SELECT a || ' ' || b, CAST(n AS BIGINT) FROM scored)"""
TERMS = f"""singles AS (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(t) AS word FROM docs) WHERE word NOT IN ({_STOP}) GROUP BY word),
pairs AS (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT unnest(t[1:len(t)-1]) AS a, unnest(t[2:]) AS b FROM docs WHERE len(t) > 1)
  WHERE a NOT IN ({_STOP}) AND b NOT IN ({_STOP}) GROUP BY a, b),
base AS (SELECT a, b, p.n AS c12, x.n AS c1, y.n AS c2, (SELECT sum(n) FROM singles) AS total
  FROM pairs p JOIN singles x ON x.word = a JOIN singles y ON y.word = b),
{_SCORED},
taken AS (SELECT word, sum(n) AS n FROM (SELECT a AS word, n FROM scored UNION ALL SELECT b, n FROM scored) GROUP BY word),
{_LEFT_TERMS}"""


@query("t2_term_weights", with_ctes(
    "SELECT term, n, round(n / (SELECT max(n) FROM terms), 6) AS weight FROM terms ORDER BY n DESC, term LIMIT 100",
    _tokens("documents", "text"), TERMS))
def term_weights(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(text.term_weights(table(spark, folder, "documents"), "text", stop_words=STOP_WORDS))


# the terms of a word cloud's own defaults: no possessive ending, no numbers, plurals folded
_CLEAN = r"""docs AS (SELECT list_filter(list_transform(t, lambda w: regexp_replace(w, '''s$', '')),
  lambda w: NOT regexp_matches(w, '^[\p{N}]+$')) AS t FROM every)"""
_SINGULAR = "{w} LIKE '%s' AND {w} NOT LIKE '%ss' AND {base} IS NOT NULL"
FOLDED = f"""raw AS (SELECT word, count(*)::DOUBLE AS n FROM (SELECT unnest(t) AS word FROM docs) WHERE word NOT IN ({_STOP}) GROUP BY word),
forms AS (SELECT r.word, r.n, CASE WHEN {_SINGULAR.format(w='r.word', base='s.word')} THEN s.word ELSE r.word END AS standard
  FROM raw r LEFT JOIN raw s ON s.word = left(r.word, length(r.word) - 1)),
singles AS (SELECT standard AS word, sum(n) AS n FROM forms GROUP BY standard),
raw_pairs AS (SELECT a, b, count(*)::DOUBLE AS n FROM (SELECT unnest(t[1:len(t)-1]) AS a, unnest(t[2:]) AS b FROM docs WHERE len(t) > 1)
  WHERE a NOT IN ({_STOP}) AND b NOT IN ({_STOP}) GROUP BY a, b),
pairs AS (SELECT r.a, CASE WHEN {_SINGULAR.format(w='r.b', base='s.b')} THEN s.b ELSE r.b END AS b, sum(r.n) AS n
  FROM raw_pairs r LEFT JOIN raw_pairs s ON s.a = r.a AND s.b = left(r.b, length(r.b) - 1) GROUP BY ALL),
base AS (SELECT p.a, p.b, fa.standard AS wa, fb.standard AS wb, p.n AS c12, x.n AS c1, y.n AS c2, (SELECT sum(n) FROM singles) AS total
  FROM pairs p JOIN forms fa ON fa.word = p.a JOIN forms fb ON fb.word = p.b JOIN singles x ON x.word = fa.standard JOIN singles y ON y.word = fb.standard),
{_SCORED},
taken AS (SELECT word, sum(n) AS n FROM (SELECT wa AS word, n FROM scored UNION ALL SELECT wb, n FROM scored) GROUP BY word),
{_LEFT_TERMS}"""


@query("t2_cloud_terms", with_ctes(
    "SELECT term, n, round(n / (SELECT max(n) FROM terms), 6) AS weight FROM terms ORDER BY n DESC, term LIMIT 100",
    _tokens("documents", "text").replace("docs AS", "every AS", 1), _CLEAN, FOLDED))
def cloud_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms with every switch on."""
    terms = text.term_weights(
        table(spark, folder, "documents"), "text", stop_words=STOP_WORDS, fold_plurals=True, strip_possessive=True, drop_numbers=True
    )
    return rounded(terms)


@query("t3_title_words", with_ctes(TOP, _tokens("part", "p_name"), COUNTS))
def title_words(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(text.word_weights(table(spark, folder, "part"), "p_name", stop_words=STOP_WORDS))
