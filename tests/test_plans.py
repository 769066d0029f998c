"""The registered queries: contract, plans, and agreement with their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tabscope.operators import report
from tabscope.plans import all_queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check import TABLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries().queries, all_queries().sql

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")

# Queries without SQL, see the model tests: a mixture of seven features.
WITHOUT_SQL = {"m13_mixture"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_contract(spark):
    assert set(SQL) <= set(QUERIES) and set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = con.execute(SQL[name])
    theirs = aligned([c[0] for c in cursor.description], cursor.fetchall())
    mine = aligned(df.columns, [tuple(r) for r in df.collect()])
    assert mine[0] == theirs[0] and len(mine[1]) == len(theirs[1])
    for left, right in zip(mine[1], theirs[1]):
        for a, b in zip(left, right):
            # both sides are rounded to six digits: a sum next to a tie may fall either way
            assert a == (pytest.approx(b, abs=1.5e-6) if isinstance(b, float) else b)


def aligned(columns, rows):
    """Columns by name, rows in an order that ignores the last digits of floats."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(r[i] for i in order) for r in rows]
    # rows that agree in three digits are told apart by five, then by all of them
    table.sort(key=lambda r: [[(v is None, f"{v:.{d}f}" if isinstance(v, float) else str(v)) for v in r] for d in (3, 5, 9)])
    return [columns[i] for i in order], table


JVM_ONLY = [n for n in sorted(QUERIES) if n[0] in "scpajlt" and n != "p12_without_noise"]


@pytest.mark.parametrize("name", JVM_ONLY)
def test_plans_have_no_python_and_no_cross_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_unused_columns_are_not_read(spark):
    plan = QUERIES["p7_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_tax" not in plan
    plan = QUERIES["a2_income_by_tier"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderdate" not in plan


def test_comparison_facts_have_every_model(spark):
    lines = QUERIES["m16_comparison_facts"](spark, FOLDER).orderBy("ord").collect()
    assert [(r["model"], r["metric"]) for r in lines] == list(report.MODELS)
    # no tier is binary here, and the smallest table may be noise or a single group to the density clustering
    assert all(r["in_range"] for r in lines) and {r["ord"] for r in lines if r["score"] is None} <= {2, 8}
