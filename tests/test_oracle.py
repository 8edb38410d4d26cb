"""Registered queries: all have an oracle, plans stay in the JVM, and some are compared at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.checks import registry
from factloom.checks.bindings import TABLES
from factloom.checks.compare import rows_of

SF = "/root/testdata/sf0.001"
QUICK = (
    "same_word_pairs", "concept_catalog", "ranked_concepts", "name_duplicates", "duplicate_logic", "route_matches", "resolved_imports", "scan_set",
    "history_digest", "as_of_state", "query_audit", "extract_symbols", "extract_declarations", "compose_services", "changed_files", "goal_terms",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", QUICK)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("name", ("ranked_concepts", "name_duplicates", "duplicate_logic", "route_matches", "as_of_state", "extract_symbols", "usage_attached"))
def test_plans_have_no_python_and_no_cross_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"))
