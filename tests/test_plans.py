"""Plans at size: sides that grow with the input are not gathered in the driver, however small their files are."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ("resolved_imports", "file_imports", "tail_edges"))
def test_files_and_imports_are_not_broadcast(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_a_route_of_many_files_and_paths_is_made_by_several_tasks(spark):
    from factloom.operators import routes

    declared = spark.range(1500).selectExpr("'r' as repo", "'f' || id as path", "'GET' as method", "'/a/:id' as route", "'h' as handler")
    seen = spark.range(1500).selectExpr("'r' as repo", "'/a/' || id % 1000 as path", "cast(if(id % 1000 < 900, 500, 200) as bigint) as status")
    got = routes.contradicted_routes(declared, seen).withColumn("task", F.spark_partition_id())
    tasks = got.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum("observed").alias("seen")).collect()
    assert (sum(t.n for t in tasks), sum(t.seen for t in tasks), len(tasks) > 1) == (1500 * 900, 1500 * 1400, True)


def crossed(spark, n):
    """One route that ``n`` files declare and ``n`` failing paths answer."""
    declared = spark.range(n).selectExpr("'r' as repo", "'f' || id as path", "'GET' as method", "'/a/:id' as route", "'h' as handler")
    return declared, spark.range(n).selectExpr("'r' as repo", "'/a/' || id as path", "500L as status")


def test_what_goes_to_the_cells_of_a_route_is_cut_on_both_sides(spark, monkeypatch):
    from factloom.operators import routes

    dealt, frame = [], type(spark.range(1))
    real = frame.repartition

    def spy(self, *a):
        lists = [F.size(c) for c, kind in self.dtypes if kind.startswith("array")]
        dealt.append(self.agg(F.sum(lists[0] if lists else F.lit(1))).first()[0])
        return real(self, *a)

    monkeypatch.setattr(routes, "ROUTE_ROWS", 2500)
    monkeypatch.setattr(frame, "repartition", spy)
    got = routes.contradicted_routes(*crossed(spark, 1000))
    monkeypatch.undo()
    assert got.select("file", "called").distinct().count() == got.count() == 1000 * 1000
    # each file for a twentieth of the paths, and the other way round; before, each path for every twentieth row
    assert len(dealt) == 2 and sum(dealt) <= 2 * 1000 * 20


def test_a_stream_of_contradictions_is_written_by_as_many_tasks_as_it_has_rows(spark, tmp_path, monkeypatch):
    from factloom.operators import routes
    from factloom.streaming import jobs

    declared, seen = crossed(spark, 1000)
    seen.coalesce(1).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(routes, "ROUTE_ROWS", 10_000)
    monkeypatch.setattr(routes, "TASK_ROWS", 50_000, raising=False)
    jobs.observed_contradictions(jobs.file_stream(spark, f"{tmp_path}/in", seen.schema), declared, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.select("file", "called", "status").distinct().count() == out.count() == 1000 * 1000
    files = list((tmp_path / "out").glob("batch=*/*.parquet"))
    assert len(files) > 10 and sum(f.stat().st_size for f in files) < 1_000_000


def test_a_stream_gets_as_many_files_as_its_input_has_tasks(spark, tmp_path):
    from factloom.checks import stream_checks

    few, many = spark.range(1000).repartition(1), spark.range(1000).repartition(7)
    for n, df in ((2, few), (14, many)):
        stream_checks._stream_of(spark, df, f"{tmp_path}/{n}")
        assert stream_checks._files(spark, f"{tmp_path}/{n}") == n


def test_usage_rows_are_dealt_by_their_number(spark, monkeypatch):
    from factloom.operators import catalog

    decls = spark.createDataFrame([("r", "A", "own")], "repo string, name string, path string")
    hits = spark.range(4000).selectExpr("if(id < 0, 's', 'r') as repo", "if(id % 4 = 0, 'B', 'A') as name", "if(id = 1, 'own', 'f' || id % 500) as path", "if(id < 2000, 'x', 'y') as kind")
    monkeypatch.setattr(catalog, "TASK_ROWS", 500, raising=False)
    usage = catalog.attach_usage(hits, decls)
    assert usage.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 4
    plan = usage._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 8)" in plan, plan
    got = catalog.usage_counts(usage).collect()
    assert [tuple(r) for r in got] == [("r", "A", 375, 750)]


def test_hits_are_counted_without_a_join(spark):
    """The counts of the catalog are those of the usage rows, also without paths or kinds, of names that nobody declares, and in declaring files."""
    from factloom.operators import catalog
    from helpers import DECL, HIT

    decls = spark.createDataFrame([("r", p, 1, n, "sql", [], [], None) for n, p in (("A", "own"), ("A", None), ("B", "b"), ("C", "c"))], DECL)
    rows = [("r", "A", "own", "x"), ("r", "A", "f", "x"), ("r", "A", "f", None), ("r", "A", "g", "x"), ("r", "A", "g", "x"), ("r", "A", None, "x"), ("r", "A", "own", None), ("r", "B", "own", "y"), ("r", "Z", "f", "x"), ("s", "A", "f", "x")]
    hits = spark.createDataFrame(rows, HIT)
    got = catalog.build_catalog(decls, hits)
    counted = {(r.repo, r.name): (r.uses, r.use_pairs) for r in catalog.usage_counts(catalog.attach_usage(hits, decls)).collect()}
    assert {(r.repo, r.name): (r.uses, r.use_pairs) for r in got.collect()} == counted | {("r", "C"): (0, 0)} and counted[("r", "A")] == (2, 4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "LeftAnti" not in plan


def test_words_are_keyed_by_all_tasks(spark):
    from factloom.functions import words

    names = spark.range(300).selectExpr("'r' as repo", "'name' || id as name")
    got = words.match_words(names, names.withColumnRenamed("name", "other"), "name", "other", ("repo",))
    assert got.where("name = 'name7'").count() > 1
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2


def test_matched_routes_are_read_not_made_again(spark):
    """Calls and routes of a search for callers are shaped once, not for their masks and for their paths."""
    from factloom.operators import routes

    r = spark.createDataFrame([("r", "A", "/a/:id", "GET", "p", "h"), ("r", "A", "/b", "GET", "p", "h")], "repo string, concept string, route string, method string, path string, handler string")
    calls = spark.createDataFrame([("r", "f", "/a/1"), ("r", "g", "/a/{x}"), ("r", "g", "/c")], "repo string, file string, called string")
    got = routes.match_routes(r, calls)
    assert sorted((x.route, x.called) for x in got.collect()) == [("/a/:id", "/a/1"), ("/a/:id", "/a/{x}")]
    assert all("/cut-" in f for f in got.inputFiles()) and got.inputFiles()
