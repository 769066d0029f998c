"""The registered queries of this folder against their SQL."""

import duckdb
import pytest

from tabscope.llm.registry import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    theirs = [dict(zip([c[0] for c in cursor.description], r)) for r in cursor.fetchall()]
    mine = [r.asDict() for r in queries()[name](spark, FOLDER).collect()]
    assert sorted(mine[0]) == columns
    assert sorted(str([r[c] for c in columns]) for r in mine) == sorted(str([r[c] for c in columns]) for r in theirs)


@pytest.mark.parametrize("name", ["op2_secrets", "op4_mixing", "op13_chat"])
def test_native_queries_have_no_python(spark, name):
    plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
