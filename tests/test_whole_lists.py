"""Lists without a cap are whole, in the operators and in the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.checks.bindings import TABLES
from factloom.checks.compare import rows_of
from factloom.operators import catalog, history, summary
from helpers import concepts, decls, files, pairs

SF = "/root/testdata/sf0.001"
NAMES = [f"Name{k:02d}" for k in range(40)]


def test_counts_list_every_name(spark):
    c = concepts(spark, decls(spark, *[(n, "class") for n in NAMES]))
    assert pairs(summary.status_list(files(spark, a="x"), c), "files", "unused", "name") == [(1, 40, n) for n in NAMES]
    assert pairs(summary.verdict_list(c), "verdict", "concepts", "name") == [("DECLARED_ONLY", 40, n) for n in NAMES]
    [status] = summary.status_counts(files(spark, a="x"), c, 3).collect()
    [bucket] = summary.verdict_buckets(c, 3).collect()
    assert status.unused_names == bucket.names == ", ".join(NAMES[:3]) and (status.unused, bucket.concepts) == (40, 40)


def test_digest_lists_every_name(spark):
    rows = [("r", f"e{k}", 1000 - k, "concept_appeared", n) for k, n in enumerate(NAMES)]
    events = spark.createDataFrame(rows, "repo string, id string, ts_ms long, kind string, concept string")
    assert pairs(history.history_list(events), "position", "events", "concept") == [(k + 1, 40, n) for k, n in enumerate(NAMES)]
    [got] = history.history_digest(events, cap=2).collect()
    assert got.sentence == f"40 concepts appeared: {NAMES[0]}, {NAMES[1]} (+38 more)"


@pytest.mark.parametrize("name", ("goal_terms", "top_concepts_whole", "status_counts_whole", "verdict_buckets_whole", "history_digest_whole"))
def test_whole_queries(spark, name):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, cur = entry.queries()[name](spark, SF), con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_goal_terms_go_on_after_the_eighth(spark):
    assert entry.queries()["goal_terms"](spark, SF).where("position > 8").count() > 0


def test_a_large_concept_is_numbered_in_many_tasks(spark):
    rows = [("r", "Big", "Class", f"n{k % 700:03d}", f"p{k}", 1) for k in range(2000)] + [("r", "Small", "Class", "n", "p", k) for k in range(3)]
    linked = spark.createDataFrame(rows, "repo string, linked_concept string, kind string, name string, path string, line int")
    found = catalog.symbols_of_concepts(linked)
    got = {(r.concept, r.name, r.path, r.line): r.position for r in found.collect()}
    big = sorted(r[1:] for r in rows if r[1] == "Big")
    assert got == {(c, n, p, i): k + 1 for k, (c, _, n, p, i) in enumerate(big)} | {("Small", "n", "p", k): k + 1 for k in range(3)}
    numbering = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Window [row_number" in x]
    assert numbering and all("_part" in x for x in numbering)


def test_files_and_facts_are_dealt_by_their_rows(spark, monkeypatch):
    """Equal paths are few bytes; as many tasks meet files and facts as their rows need."""
    monkeypatch.setattr(catalog, "TASK_ROWS", 10)
    known = spark.range(60).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("path"), (F.col("id") < 20).alias("declares"))
    facts = known.where("declares").select("repo", "path", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("name"), F.lit("concept").alias("what"))
    got = catalog.file_counts(known, facts)
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.declares, r.what): (r.files, r.names) for r in got.collect()} == {(True, "concept"): (20, 40), (False, None): (40, 0)}
    assert "hashpartitioning(repo" in got._jdf.queryExecution().executedPlan().toString() and ", 6)" in got._jdf.queryExecution().executedPlan().toString()
