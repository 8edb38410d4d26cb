"""Reachability against a plain search, with a hub of a third of all edges, capped counts and inexact edges."""

import random

from pyspark.sql import functions as F

from factloom.operators import governance, order_stats, reach
from helpers import pairs


def plain(starts, edges, hops, late=()):
    """Depth by (key, path), key by key."""
    back = {}
    for a, b in edges:
        back.setdefault(b, set()).add(a)
    out = {}
    for key in {k for k, _ in starts} | {k for k, _ in late}:
        seen = {p: 0 for k, p in starts if k == key}
        layer = set(seen)
        for depth in range(1, hops + 1):
            layer = {a for b in layer for a in back.get(b, ())} | ({p for k, p in late if k == key} if depth == 1 else set())
            layer -= set(seen)
            seen.update({p: depth for p in layer})
        out.update({(key, p): d for p, d in seen.items() if d})
    return out


def graph(seed, nodes=120, edges=500):
    rng = random.Random(seed)
    rows = {(f"f{rng.randrange(nodes)}", f"f{rng.randrange(nodes)}") for _ in range(edges)}
    # a hub that a third of all edges lead to
    rows |= {(f"f{k}", "f0") for k in range(1, nodes)} | {(f"x{k}", "f0") for k in range(edges // 4)}
    starts = [(f"k{k}", f"f{rng.randrange(nodes)}") for k in range(40) for _ in range(rng.choice((1, 1, 2)))] + [("hub", "f0"), ("alone", "zz")]
    late = [(f"k{k}", f"f{rng.randrange(nodes)}") for k in range(0, 40, 5)] + [("only late", "f5")]
    return sorted(rows), starts, late


def tables(spark, edges, starts, late):
    e = spark.createDataFrame([("r", *x) for x in edges], "repo string, from_path string, to_path string")
    s, x = (spark.createDataFrame([("r", *p) for p in rows], "repo string, key string, path string") for rows in (starts, late))
    return e, s, x


def test_reach_is_a_plain_search(spark):
    for seed in (1, 2):
        edges, starts, late = graph(seed)
        e, s, x = tables(spark, edges, starts, late)
        want = plain(starts, edges, 3, late)
        assert {(r.key, r.path): r.depth for r in reach.reach(s, e, 3, x).collect()} == want
        counts = {}
        for key, _ in want:
            counts[key] = counts.get(key, 0) + 1
        assert {r.key: r.n for r in reach.reach_counts(s, e, 3, x).collect()} == counts


def test_a_hub_is_split_and_rows_follow_files_not_keys(spark):
    edges, _, _ = graph(3)
    e, s, _ = tables(spark, edges, [(f"key{k}", "f0") for k in range(500)], [("a", "b")])
    back = e.where("from_path <> to_path").select("repo", F.col("to_path").alias("path"), "from_path").distinct()
    hubs = reach._hubs(back)
    salts = {r.path: r.n for r in reach._salted(back, hubs).groupBy("path").agg(F.countDistinct("salt").alias("n")).collect()}
    assert salts["f0"] > 1 and min(salts.values()) == 1 and hubs.count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    # 500 keys of one file search once
    assert reach._levels(s.where("key = 'key1'"), e, 3).count() == reach._levels(s, e, 3).count() < 400
    assert reach.reach_counts(s, e).where("n = 244").count() == 500


def test_at_least_is_the_count_up_to_a_bound(spark):
    for seed in (4, 5, 6):
        edges, _, _ = graph(seed, 60, 110)
        starts = [(f"f{k}", f"f{k}") for k in range(60)]
        e, s, _ = tables(spark, edges, starts, [("a", "b")])
        full = {r.key: r.n for r in reach.reach_counts(s, e).collect()}
        assert {r.key: r.n for r in reach.reach_at_least(s, e, 10).collect()} == {k: min(n, 10) for k, n in full.items()}
        assert max(full.values()) > 10 > min(full.values())


def test_semantic_diff_needs_no_full_search(spark):
    edges = [(f"d{k}", "a.ts") for k in range(30)] + [(f"e{k}", "b.ts") for k in range(3)]
    e = spark.createDataFrame([("r", *x) for x in edges], "repo string, from_path string, to_path string")
    changes = spark.createDataFrame([("r", "M", p, None) for p in ("a.ts", "b.ts")], "repo string, status string, path string, old_path string")
    objects = lambda v: spark.createDataFrame([("r", p, "symbol", "f", "f", v) for p in ("a.ts", "b.ts")], "repo string, path string, object string, name string, key string, value string")
    ask = lambda **k: pairs(governance.semantic_diff(changes, objects("1"), objects("2"), e, **k), "path", "dependents", "decision_required")
    assert ask() == [("a.ts", 10, True), ("b.ts", 3, False)] and ask(all_dependents=True) == [("a.ts", 30, True), ("b.ts", 3, False)]


def test_tail_edges_take_the_longest_match(spark):
    files = ["src/core/util.ts", "lib/util.ts", "src/core/index.ts", "app/models/user.rb", "pkg/Core.py"]
    f = spark.createDataFrame([("r", p) for p in files], "repo string, path string")
    modules = [("a.ts", "@x/core/util"), ("a.ts", "util"), ("b.ts", "../core"), ("c.rb", "models::User"), ("d.ts", "nothing/here"), ("lib/util.ts", "util.ts"), ("e.ts", "")]
    i = spark.createDataFrame([("r", *m) for m in modules], "repo string, from_path string, to_module string")
    got = pairs(reach.tail_edges(i, f), "from_path", "to_module", "to_path", "matched")
    assert got == sorted([
        ("a.ts", "@x/core/util", "src/core/util.ts", 2), ("a.ts", "util", "lib/util.ts", 1), ("a.ts", "util", "src/core/util.ts", 1), ("b.ts", "../core", "pkg/Core.py", 1), ("b.ts", "../core", "src/core/index.ts", 1),
        ("c.rb", "models::User", "app/models/user.rb", 2), ("lib/util.ts", "util.ts", "src/core/util.ts", 1),
    ])
    symbols = spark.createDataFrame([("r", "lib/util.ts", "Util", "Class", None)], "repo string, path string, name string, kind string, linked_concept string")
    exact = spark.createDataFrame([("r", "m.ts", "lib/util.ts")], "repo string, from_path string, to_path string")
    targets = spark.createDataFrame([("r", "Util")], "repo string, target string")
    both = reach.structural_dependents(targets, symbols, exact, inexact=reach.tail_edges(i, f))
    assert pairs(both, "path", "depth", "exact") == [("a.ts", 1, False), ("m.ts", 1, True)]


def test_exact_rank_is_the_sorted_element(spark):
    rng = random.Random(7)
    rows = [("a", rng.randrange(10**9)) for _ in range(20_000)] + [("b", 5)] * 3000 + [("c", k % 3) for k in range(1001)] + [("d", 1)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    for share in (0.0, 0.5, 0.9):
        want = {}
        for g in "abcd":
            v = sorted(x for h, x in rows if h == g)
            want[g] = (len(v), v[int(share * len(v))])
        assert {r.g: (r.n, r.v) for r in order_stats.exact_rank(df, ["g"], "v", share).collect()} == want


def test_the_registered_diff_counts_all_dependents(spark):
    import __spark_entry__ as entry

    top = entry.queries()["semantic_diff"](spark, "/root/testdata/sf0.01").selectExpr("max(dependents)").first()[0]
    assert top > governance.MANY_DEPENDENTS


def test_layers_are_not_compared_with_those_before(spark):
    """Distances also hold where walks lead back, and no hop but the last grouping shuffles what earlier hops found."""
    edges = [("a", "b"), ("b", "a"), ("c", "a"), ("b", "c"), ("d", "b"), ("a", "a")]
    e, s, _ = tables(spark, edges, [("k", "a")], [("x", "a")])
    found = reach._levels(s, e, 3)
    assert {(r.start, r.path): r.depth for r in found.collect()} == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "d"): 2}
    assert "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("/cut-" in f for f in set(found.inputFiles())) > 0 and {(r.key, r.path): r.depth for r in reach.reach(s, e, 3).collect()} == plain([("k", "a")], edges, 3)


def test_a_search_for_some_files_reads_only_edges_that_lead_from_them(spark):
    for seed in (8, 9):
        edges, starts, late = graph(seed)
        e, s, x = tables(spark, edges, starts, late)
        asked = {f"f{k}" for k in range(0, 120, 7)} | {"x3", "nowhere"}
        ends = spark.createDataFrame([("r", p) for p in asked] * 2, "repo string, path string")
        want = {k: d for k, d in plain(starts, edges, 3, late).items() if k[1] in asked}
        assert {(r.key, r.path): r.depth for r in reach.reach(s, e, 3, x, ends).collect()} == want
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "a")] + [(f"x{k}", "c") for k in range(200)]
    e, s, _ = tables(spark, chain, [("k", "d")], [("x", "a")])
    kept, known = reach._leading(e, spark.createDataFrame([("r", "a")], "repo string, path string"), 3)
    assert pairs(kept, "from_path", "to_path") == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")] and pairs(known, "path") == [("a",), ("b",), ("c",), ("d",)]


def test_claims_search_only_files_that_lie_outside(spark, monkeypatch):
    """The same answers as over all dependents; few files are asked for, all of them if a repo has many prefix lists."""
    import __spark_entry__ as entry
    from factloom.plans import questions

    asked, whole = [], questions.structural_dependents
    monkeypatch.setattr(questions, "structural_dependents", lambda *a, ends=None, **k: asked.append(ends) or whole(*a, ends=ends, **k))
    run = lambda: pairs(entry.queries()["typed_claims"](spark, "/root/testdata/sf0.001"), "repo", "id", "type", "target", "verdict", "outside")
    few = run()
    monkeypatch.setattr(questions, "PREFIX_LISTS", 0)
    assert few == run() and any(r[-1] for r in few)
    assert asked[0].where("path like 'l/%' or path like 'o/%'").isEmpty() and not asked[0].isEmpty() and asked[1] is None


def test_files_that_nobody_imports_are_met_by_the_last_hop_alone(spark, monkeypatch):
    """No hop but the last reads or writes the leaves of a tree, and rows of the last are dealt over as many tasks as they need."""
    edges = [(f"m{k}", "top") for k in range(10)] + [(f"leaf{k}", f"m{k % 10}") for k in range(600)] + [(f"leaf{k}", "top") for k in range(0, 600, 3)]
    starts, late = [("top", "top"), ("m1", "m1"), ("leaf", "leaf9")], [("late", "m2"), ("late", "leaf5")]
    e, s, x = tables(spark, edges, starts, late)
    want, cut, rows = plain(starts, edges, 3, late), reach.cut_lineage, []
    monkeypatch.setattr(reach, "cut_lineage", lambda df, **k: rows.append(cut(df, **k)) or rows[-1])
    monkeypatch.setattr(reach, "TASK_ROWS", 50)
    found = reach.reach(s, e, 3, x)
    assert {(r.key, r.path): r.depth for r in found.collect()} == want and len(want) > 700
    assert sum(t.count() for t in rows) < 100
