"""Streams: the same rows in any number of files give the same result."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import governance
from factloom.plans import questions
from factloom.streaming import jobs
from helpers import concepts, decls, pairs

FILE = "repo string, path string, size bigint, mtime_ms bigint, content string"


def diff(spark, root, batches, parts):
    for rows in batches:
        spark.createDataFrame(rows, jobs.SNAPSHOT).repartition(parts).write.mode("append").parquet(f"{root}/in")
        jobs.continuous_diff(jobs.file_stream(spark, f"{root}/in", jobs.SNAPSHOT, per_trigger=1), f"{root}/log", f"{root}/state", f"{root}/cp").awaitTermination()
    out = spark.read.parquet(f"{root}/log/diff").unionByName(spark.read.parquet(f"{root}/log/version"))
    return pairs(out, "snap", "kind", "concept", "related")


def snap(n, *names, total=None):
    return [("r", n, total or len(names), x, f"t_{x.lower()}", []) for x in names]


@pytest.mark.parametrize("parts", (1, 4))
def test_a_snapshot_in_parts_is_one_snapshot(spark, tmp_path, parts):
    got = diff(spark, str(tmp_path), [snap(1, "Apple", "Bench", "Cloud", "Delta"), snap(2, "Apple", "Bench", "Cloud"), snap(3, "Apple", "Bench", "Cloud", "Eagle")], parts)
    assert [g for g in got if g[0] > 1] == [(2, "architecture_version", "2", None), (2, "concept_lost_storage", "Delta", None), (3, "architecture_version", "3", None), (3, "concept_appeared", "Eagle", None)]


def test_an_unfinished_snapshot_waits(spark, tmp_path):
    got = diff(spark, str(tmp_path), [snap(1, "Apple", "Bench") + snap(2, "Apple", total=2), snap(2, "Cloud", total=2)], 1)
    assert [g for g in got if g[0] == 2] == [(2, "architecture_version", "2", None), (2, "concept_appeared", "Cloud", None), (2, "concept_lost_storage", "Bench", None)]


def test_rows_that_come_too_late_are_listed(spark, tmp_path):
    d = str(tmp_path)
    diff(spark, d, [snap(2, "Apple", "Bench"), snap(1, "Apple", "Cloud"), snap(2, "Apple") + snap(3, "Apple")], 1)
    late = pairs(jobs.stored(spark, f"{d}/log/late", jobs.SNAPSHOT), "snap", "name")
    assert late == [(1, "Apple"), (1, "Cloud")]


def test_facts_follow_a_revert_a_deletion_and_the_signature(spark, tmp_path):
    d = str(tmp_path)
    extract = lambda df: df.select("repo", "path", F.col("content").alias("fact"))
    read = lambda sig="": pairs(jobs.current_facts(spark, f"{d}/out", f"{d}/keys", "repo string, path string, fact string", sig), "path", "fact")

    def step(*rows, sig=""):
        spark.createDataFrame(rows, FILE).coalesce(1).write.mode("append").parquet(f"{d}/in")
        jobs.incremental_facts(jobs.file_stream(spark, f"{d}/in", FILE, per_trigger=1), extract, f"{d}/out", f"{d}/keys", f"{d}/cp", signature=sig).awaitTermination()

    step(("r", "a", 1, 1, "v1"), ("r", "b", 1, 1, "b1"))
    step(("r", "a", 2, 2, "v2"))
    assert read() == [("a", "v2"), ("b", "b1")]
    step(("r", "a", 1, 1, "v1"), ("r", "b", 0, 3, None))
    assert read() == [("a", "v1")]
    step(("r", "a", 1, 1, "v1"), sig="new concepts")
    assert read() == [] and read("new concepts") == [("a", "v1")]


def test_extracted_facts_are_counted_after_they_left_the_store(spark, tmp_path):
    d = str(tmp_path)
    extract = lambda df: df.select("repo", "path", F.explode(F.split("content", " ")).alias("fact"))
    for k, (path, text) in enumerate((("a", "one two"), ("a", "three"), ("a", "four five six"), ("b", "seven"))):
        spark.createDataFrame([("r", path, k, k, text)], FILE).coalesce(1).write.mode("append").parquet(f"{d}/in")
        jobs.incremental_facts(jobs.file_stream(spark, f"{d}/in", FILE, per_trigger=1), extract, f"{d}/out", f"{d}/keys", f"{d}/cp", superseded=0, extracted=f"{d}/extracted").awaitTermination()
    assert spark.read.parquet(f"{d}/extracted").agg(F.sum("facts")).first()[0] == 7


def test_superseded_facts_leave_the_store(spark, tmp_path):
    """Rounds on one file of three leave one generation, and a file that is never touched keeps its facts."""
    d = str(tmp_path)
    extract = lambda df: df.select("repo", "path", F.explode(F.split("content", " ")).alias("fact"))
    for k in range(12):
        rows = [("r", "a", k, k, f"a{k} more")] + ([("r", "b", 1, 1, "b here"), ("r", "c", 1, 1, "c here")] if k == 0 else [])
        spark.createDataFrame(rows, FILE).coalesce(1).write.mode("append").parquet(f"{d}/in")
        jobs.incremental_facts(jobs.file_stream(spark, f"{d}/in", FILE, per_trigger=1), extract, f"{d}/out", f"{d}/keys", f"{d}/cp").awaitTermination()
        # one generation, and until the next batch what it came from
        assert spark.read.parquet(f"{d}/out").select("repo", "path", "batch").distinct().count() <= 3 * (2 + jobs.SUPERSEDED) + 1
    got = pairs(jobs.current_facts(spark, f"{d}/out", f"{d}/keys", "repo string, path string, fact string"), "path", "fact")
    assert got == [("a", "a11"), ("a", "more"), ("b", "b"), ("b", "here"), ("c", "c"), ("c", "here")]
    assert len(jobs._batches(spark, f"{d}/out")) <= 4


def test_fan_out_reaches_symbols(spark):
    c = concepts(spark, decls(spark, ("Order", "prisma", "Order")))
    repos = spark.createDataFrame([("r",), ("s",)], "repo string")
    terms = spark.createDataFrame([("Invoice",)], "term string")
    symbols = spark.createDataFrame([("s", "a.py", "Invoice", "Class", 3)], "repo string, path string, name string, kind string, line int")
    got = {(r.repo, r.verdict, r.repos) for r in questions.fan_out_terms(terms, repos, c, symbols=symbols).collect()}
    assert got == {("s", "STRUCTURAL", 1), (None, "ELSEWHERE_ABSENT", 1)}


def test_an_alias_with_two_targets_is_an_error(spark):
    a = spark.createDataFrame([("r", "a", "e"), ("r", "a", "f"), ("r", "b", "a"), ("r", "c", "d")], "repo string, alias string, target string")
    assert pairs(governance.canonical_aliases(a).where("alias <> 'b'").fillna("-"), "alias", "root", "error") == [("a", "-", "several alias targets"), ("c", "d", "-")]
