"""Set-based operators against the plain definition on small inputs."""

import random
import re

from pyspark.sql import functions as F

from factloom.functions import paths, words
from factloom.operators import chains, duplicates, history, order_stats, ranking, routes
from helpers import concepts, decls, hits, pairs


def same(a: str, b: str) -> bool:
    x, y = a.lower().encode(), b.lower().encode()
    if x == y:
        return True
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return k >= 4 and k * 10 >= min(len(x), len(y)) * 7 and len(x) - k <= 3 and len(y) - k <= 3


def vocabulary(seed, n=120):
    rnd = random.Random(seed)
    stems = ["story", "histor", "widget", "übers", "abc", "a", "config", "élan", "report", "repo"]
    ends = ["", "s", "es", "ing", "ed", "er", "ify", "ée", "ization", "y", "ies"]
    return sorted({rnd.choice(stems) + rnd.choice(ends) + rnd.choice(["", "", "x", "12"]) for _ in range(n)})


def test_match_words_is_the_definition(spark):
    left, right = vocabulary(1), vocabulary(2)
    a = spark.createDataFrame([(w,) for w in left], "l string")
    b = spark.createDataFrame([(w.upper() if i % 3 == 0 else w,) for i, w in enumerate(right)], "r string")
    got = pairs(words.match_words(a, b, "l", "r"), "l", "r")
    want = sorted((x, y) for x in left for (y,) in [tuple(r) for r in b.collect()] if same(x, y))
    assert got == want and len(got) == len(set(got))
    col = a.crossJoin(b).where(words.same_word(F.col("l"), F.col("r")))
    assert pairs(col, "l", "r") == want


def test_name_tokens(spark):
    df = spark.createDataFrame([("UserAuditLog",), ("HTTPServer",), ("snake_case2Go",), ("a-b.c",), ("",)], "n string")
    got = [r[0] for r in df.select(words.name_tokens(F.col("n"))).collect()]
    assert got == [["User", "Audit", "Log"], ["HTTPServer"], ["snake", "case2", "Go"], ["a", "b", "c"], []]


def test_route_join_is_the_column_predicate(spark):
    rnd = random.Random(3)
    seg = lambda: rnd.choice(["a", "B", "{id}", ":x", "<y>", "users", "Users", "9"])
    make = lambda: "/" + "/".join(seg() for _ in range(rnd.randint(0, 3)))
    d = spark.createDataFrame([("r", p) for p in {make() for _ in range(60)}], "repo string, route string")
    c = spark.createDataFrame([("r", p) for p in {"http://h" + make() + "?q=1" for _ in range(60)} | {make() for _ in range(60)}], "repo string, called string")
    both = d.join(c, "repo")
    loose = both.where(paths.paths_match(F.col("route"), F.col("called")))
    assert pairs(routes.match_routes(d, c), "route", "called") == pairs(loose, "route", "called")
    strict = both.where(paths.route_matches(F.col("route"), F.col("called")))
    assert pairs(routes.match_routes(d, c, strict=True), "route", "called") == pairs(strict, "route", "called")


def test_ranking_prelimit_is_lossless(spark):
    rnd = random.Random(5)
    nouns = ["order", "orders", "item", "user", "audit"]
    names = sorted({rnd.choice(nouns).capitalize() + rnd.choice(["", "Log", "Item", "Order", "Store", "Audit"]) + rnd.choice(["", "X", "Row"]) for _ in range(60)} | {"order", "audit"})
    d = decls(spark, *[(n, rnd.choice(["sql", "django"]), None) for n in names])
    h = hits(spark, *[(rnd.choice(names), f"u{i}", "k") for i in range(200)])
    cat = concepts(spark, d, h)
    t = spark.createDataFrame([("r", w) for w in nouns + ["logs", "Orders"]], "repo string, term string")
    got = pairs(ranking.rank_concepts(t, cat, 4), "term", "rank", "name")
    rows = {r.name: r for r in cat.collect()}
    want = []
    for (term,) in [(r.term,) for r in t.collect()]:
        scored = []
        for n, r in rows.items():
            toks = re.findall("[A-Za-z0-9]+", re.sub("([a-z0-9])([A-Z])", r"\1 \2", n))
            exact = same(n, term)
            if exact or any(same(x, term) for x in toks):
                base = {(True, True): 2404, (True, False): 1803, (False, True): 1202, (False, False): 601}[(exact, r.has_orm)]
                scored.append((-(base + min(r.uses, 500) + r.n_relations), n))
        want += [(term, i + 1, n) for i, (_, n) in enumerate(sorted(scored)[:4])]
    assert got == sorted(want)


def test_name_relation_is_linear_and_holds_all_pairs(spark):
    d = decls(spark, *[(f"Ledger{chr(65 + i // 26)}{chr(65 + i % 26)}", "prisma", "t") for i in range(500)], ("OrderItem", "prisma", "t"), ("OrderLine", "sql", "t"), ("Ordering", "prisma", "t"), ("Orders", "prisma", "t"))
    rel = duplicates.name_duplicates(concepts(spark, d)).cache()
    assert rel.where("token = 'ledger'").count() == 1000
    every = duplicates.duplicate_pairs(rel, rel.select("repo", "name"))
    assert every.where("shared_token = 'ledger'").count() == 500 * 499 // 2
    assert pairs(every.where("a like 'Order%'"), "a", "b", "shared_token") == [("OrderItem", "OrderLine", "order"), ("OrderItem", "Ordering", "order"), ("OrderItem", "Orders", "order"), ("OrderLine", "Ordering", "order"), ("OrderLine", "Orders", "order"), ("Ordering", "Orders", "ordering")]
    assert duplicates.duplicate_pairs(rel, rel.where("name = 'LedgerAA'").select("repo", "name")).count() == 499
    want = {n for r in every.where("needs_alias").collect() for n in (r.a, r.b)}
    assert {r.name for r in duplicates.names_needing_alias(rel).collect()} == want


def test_duplicate_logic_has_no_frequency_limit(spark):
    rows = []
    for u in range(30):
        rows += [(f"f{u:02}", "shared boilerplate one"), (f"f{u:02}", "shared boilerplate two")]
    for u in (1, 2, 3):
        rows.append((f"f{u:02}", "a rare literal here"))
    rows += [("f03", "one more of its own"), ("f30", "shared boilerplate one"), ("f30", "shared boilerplate two"), ("f30", "a rare literal here"), ("f30", "and another text")]
    lit = spark.createDataFrame([("r", p, "u", t) for p, t in rows], "repo string, path string, unit string, literal string")
    assert pairs(duplicates.duplicate_logic(lit), "a_path", "b_path", "shared") == [("f01", "f03", 3), ("f01", "f30", 3), ("f03", "f30", 3)]
    copies = duplicates.logic_groups(lit)
    assert copies.where("group_path = 'f00'").count() == 27 and pairs(copies.where("group_path = 'f01'"), "path") == [("f01",), ("f02",)]


def test_as_of_is_the_latest_earlier_version(spark):
    rnd = random.Random(7)
    snaps = [("r", f"c{k}", v, v * 10) for k in range(4) for v in rnd.sample(range(100), 12)]
    asks = [("r", f"c{k}", v) for k in range(5) for v in range(0, 100, 3)]
    s = spark.createDataFrame(snaps, "repo string, concept string, version bigint, state bigint")
    a = spark.createDataFrame(asks, "repo string, concept string, version bigint")
    got = pairs(history.as_of(a, s, width=8).na.fill(-1), "concept", "requested_version", "snapshot_version", "state")
    want = []
    for _, c, v in asks:
        older = [x for x in snaps if x[1] == c and x[2] <= v]
        best = max(older, key=lambda x: x[2]) if older else (0, 0, -1, -1)
        want.append((c, v, best[2], best[3]))
    assert got == sorted(want)


def test_kth_smallest(spark):
    rnd = random.Random(9)
    data = [(f"g{i % 3}", rnd.choice([rnd.randint(0, 9), rnd.randint(0, 10**7), 4096 * rnd.randint(0, 5)])) for i in range(301)]
    df = spark.createDataFrame(data, "g string, v bigint")
    got = {r.g: r.v for r in order_stats.kth_smallest(df, ["g"], "v", F.floor(F.col("n") / 2), 10**7).collect()}
    for g in ("g0", "g1", "g2"):
        vals = sorted(v for k, v in data if k == g)
        assert got[g] == vals[len(vals) // 2]


def test_chains_and_cycles(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("s", "s")]
    df = spark.createDataFrame([("r", a, b) for a, b in edges], "repo string, node string, next string")
    got = {r.node: (r.root, r.cycle) for r in chains.resolve_chains(df).collect()}
    assert all(got[f"n{i}"] == ("n37", False) for i in range(37))
    assert all(got[k] == (None, True) for k in ("x", "y", "z", "into", "s"))


def test_pairs_of_a_common_literal_are_dealt_over_many_tasks(spark, monkeypatch):
    """The same pairs, each once, when a literal has many tasks' share of them; no task is given more than a few shares."""
    monkeypatch.setattr(duplicates, "TASK_ROWS", 100)
    rows = [("r", f"f{k:02}", "body", f"common literal {t}") for k in range(60) for t in range(3)] + [("r", f"f{k:02}", "body", f"its own literal {k}") for k in range(60)]
    lit = spark.createDataFrame(rows, "repo string, path string, unit string, literal string")
    open_ = duplicates._unit_literals(lit.where("literal like 'common%'")).select("repo", "h", "u")
    made, parts = duplicates._opened_pairs(open_)
    assert made.count() == 60 * 59 // 2 and parts == -(-3 * made.count() // 100) == made.rdd.getNumPartitions()
    found = duplicates.duplicate_logic(lit)
    assert found.count() == found.where("shared = 3 and a_path < b_path").distinct().count() == 60 * 59 // 2
