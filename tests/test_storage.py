"""Sources and sinks on real folders."""

from pyspark.sql import functions as F

from factloom import session
from factloom.checks.bindings import stored
from factloom.extract import facts
from factloom.operators.history import full_history
from factloom.session import checkpoint_folder, cut_lineage
from factloom.sources import inventory, manifests, store
from helpers import pairs, source

EVENT = "repo string, id bigint, ts_ms bigint, kind string, concept string"


def events(spark, *rows):
    return spark.createDataFrame([("r", i, t, k, "c") for i, t, k in rows], EVENT)


def test_append_and_archive_lose_nothing(spark, tmp_path):
    live, arch, kept = (str(tmp_path / n) for n in ("live", "arch", "kept"))
    first = events(spark, (1, 1000, "concept_appeared"), (2, 1000, "decision_added"), (4, None, "concept_appeared"), (5, 1000, None))
    for _ in range(2):
        store.append_events(first, live, "a")
    store.append_events(events(spark, (3, 10**12, "concept_appeared")), live, "b")
    assert store.read_events(spark, live).count() == 5 and store.read_events(spark, live, batch="b").count() == 1
    for _ in range(2):
        assert store.archive_events(spark, live, arch, kept, 10**9) == (4, 1)
    assert pairs(store.read_events(spark, arch), "id") == [(1,)]
    both = full_history(store.read_events(spark, kept), store.read_events(spark, arch))
    assert pairs(both, "id", "archived") == [(1, True), (2, False), (3, False), (4, False), (5, False)]


def test_save_replaces_only_written_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "repo string, name string")
    store.save_table(rows(("a", "x"), ("b", "y")), path)
    store.save_table(rows(("a", "z")), path)
    assert pairs(store.load_table(spark, path), "repo", "name") == [("a", "z"), ("b", "y")]
    assert store.load_table(spark, path, "a").count() == 1
    store.save_table(rows(("007", "x"), (None, "n")), path)
    assert sorted(map(str, store.load_table(spark, path).toPandas().repo)) == ["007", "None", "a", "b"] and store.load_table(spark, path, "007").count() == 1


def test_snapshots_append_by_version(spark, tmp_path):
    path = str(tmp_path / "s")
    for v in (1, 2, 2):
        store.append_snapshot(spark.createDataFrame([("r", v, "c")], "repo string, version bigint, concept string"), path)
    assert spark.read.parquet(path).where("version = 2").count() == 1


def test_read_tree_and_inventory(spark, tmp_path):
    for rel, text in {"src/a.py": "x = 1", "node_modules/b.py": "y", "env/pyvenv.cfg": "home = /usr", "env/lib/c.py": "z", "README.md": "# hi", "q/d.lua": "-"}.items():
        p = tmp_path / "repo" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    root = str(tmp_path / "repo")
    tree = inventory.read_tree(spark, root, "r")
    assert pairs(inventory.scannable_files(tree), "path") == [("src/a.py",)]
    assert pairs(inventory.unclassified_files(tree), "path") == [("q/d.lua",)]
    bare = inventory.read_tree(spark, root, "r", "*.md", content=False)
    assert "content" not in bare.columns and pairs(bare, "path", "ext") == [("README.md", "md")]
    assert "content" not in bare._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_site_packages_mark_an_environment(spark):
    rows = [("r", "odd/lib/python3.1/site-packages/x.py", 1), ("r", "odd/run.py", 1), ("r", "app/run.py", 1)]
    tree = spark.createDataFrame(rows, "repo string, path string, size bigint")
    assert pairs(inventory.scannable_files(tree), "path") == [("app/run.py",)]
    big = spark.createDataFrame([("r", "app/big.py", 3_000_000), ("r", "app/run.py", 1)], "repo string, path string, size bigint")
    assert inventory.scannable_files(big).count() == 2 and pairs(inventory.scannable_files(big, max_bytes=2_000_000), "path") == [("app/run.py",)]
    assert pairs(inventory.oversized_files(big, 2_000_000), "path") == [("app/big.py",)] == pairs(inventory.blind_files(big, max_bytes=2_000_000), "path")


def test_seed_cap(spark):
    text = "# Rules\n" + "\n".join(f"- rule {i}" for i in range(40))
    readme = source(spark, [("README.md", text)])
    assert manifests.decision_candidates(readme, cap=30).count() == 30
    got = manifests.decision_candidates(readme)
    assert got.count() == 40 and pairs(got.where("decision = 'rule 0'"), "id") == [("rules-1",)]


def test_cut_lineage_writes_to_the_checkpoint_folder(spark):
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    assert checkpoint_folder(spark).split(":")[-1].rstrip("/") in df.inputFiles()[0]


def test_a_table_that_packs_well_is_read_by_many_tasks(spark):
    """Files of alike texts take few bytes; what is read from a written table is dealt by its rows all the same."""
    alike = spark.range(0, 2 * session.FILE_ROWS + 1, 1, 1).select(F.lit("r").alias("repo"), F.concat(F.lit("a"), "id", F.lit(".sql")).alias("path"), F.lit("create table t (id int);").alias("content"))
    written = stored(spark, "alike", "files", lambda: alike)
    assert len(written.inputFiles()) == 3 and written.rdd.getNumPartitions() > 1
    assert facts.extract_declarations(written).count() == alike.count()
