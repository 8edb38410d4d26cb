"""The rules every answer must obey, one small case each."""

from factloom.extract import facts
from factloom.operators import catalog, catalog_diff, duplicates
from factloom.plans import questions
from factloom.plans.resolve import resolve_terms
from factloom.sources import inventory
from helpers import concepts, decls, hits, one, pairs, source, terms

NO_LINKS = "repo string, id string, link string"


def ask(spark, term, d, h=None, **evidence):
    return one(resolve_terms(terms(spark, term), concepts(spark, d, h), **evidence))


def aliases(spark, *rows):
    return spark.createDataFrame([("r", a, t) for a, t in rows], "repo string, alias string, target string")


def guard(spark, sql, d, h=None, links=(), **evidence):
    p = spark.createDataFrame([("r", "p", sql)], "repo string, id string, sql string")
    link = spark.createDataFrame([("r", i, x) for i, x in links], NO_LINKS)
    return questions.storage_guard(p, concepts(spark, d, h), link, **evidence)


def test_word_boundary(spark):
    r = ask(spark, "story", decls(spark, ("story", "sql", "story"), ("harvest_history", "sql", "harvest_history")))
    assert (r.canonical, r.competing) == ("story", "")


def test_exact_redeclaration_is_exempt_and_near_name_is_not(spark):
    d = decls(spark, ("Ghost", "prisma", "Ghost"))
    assert one(guard(spark, "create table ghosts (id int)", d)).status == "blocked"
    assert one(guard(spark, "CREATE TABLE Ghost (id int)", d)).status == "exempt"
    assert one(guard(spark, "CREATE TABLE zebra (id int)", d)).status == "new"


def test_comment_prose_and_ddl_needs_body(spark):
    f = source(spark, [("a.py", "# CREATE TABLE ghosts (id int)\nx = 1\n"), ("b.py", 'log("CREATE TABLE spooks now")\n'), ("c.py", 'run("CREATE TABLE reals (id int)")\n')])
    assert pairs(facts.extract_declarations(f), "name", "kind") == [("reals", "sql")]


def test_exact_name_beats_heavy_use_of_a_token_match(spark):
    d = decls(spark, ("Website", "prisma", "Website"), ("WebsiteEvent", "prisma", "WebsiteEvent"))
    h = hits(spark, *[("WebsiteEvent", f"u{i}.ts", "x") for i in range(30)])
    assert ask(spark, "website", d, h).canonical == "Website"


def test_same_table_folds_into_one_concept(spark):
    d = decls(spark, ("Order", "sqlalchemy", "orders"), ("orders", "sql", "orders"))
    folded = catalog.fold_sql_concepts(d, catalog.assemble_concepts(d))
    row = one(catalog.assemble_folded(folded))
    assert (row.name, row.n_sites, row.table_name) == ("Order", 2, "orders")


def test_table_flag_gives_storage(spark):
    f = source(spark, [("m.py", "class Invoice(Base, table=True):\n    id: int\n")])
    row = one(facts.extract_declarations(f))
    assert (row.name, row.kind, row.table_name, row.fields) == ("Invoice", "sqlmodel", "invoice", ["id"])


def test_orm_beats_sql_on_exact_ties(spark):
    d = decls(spark, ("query", "sql", "query", "a.sql"), ("Query", "django", None, "z.py"))
    assert ask(spark, "query", d).canonical == "Query"


def test_alias_resolves_and_guard_cites_the_decision(spark):
    d = decls(spark, ("stories", "sql", "stories"))
    al = aliases(spark, ("episode", "stories"))
    r = ask(spark, "episode", d, aliases=al)
    assert (r.canonical, r.via) == ("stories", "alias")
    g = one(guard(spark, "create table episodes (id int)", d, links=[("one-story", "stories")], aliases=al))
    assert (g.status, g.decision_id) == ("blocked", "one-story")


def test_alias_target_is_an_exact_name_and_comes_before_name_search(spark):
    d = decls(spark, ("job_dispatch", "sql", "job_dispatch"), ("QueueReader", "rust"))
    r = ask(spark, "queue", d, aliases=aliases(spark, ("queue", "job_dispatch")))
    assert (r.canonical, r.via) == ("job_dispatch", "alias")


def test_dangling_alias_is_reported(spark):
    r = ask(spark, "queue", decls(spark, ("Other", "rust")), aliases=aliases(spark, ("queue", "nowhere_at_all")))
    assert (r.verdict, r.canonical, r.detail) == ("UNKNOWN", None, "dangling alias queue")


def test_whole_name_is_found(spark):
    assert ask(spark, "ScoreBreakdown", decls(spark, ("ScoreBreakdown", "rust"))).verdict == "SYMBOL"


def test_generic_token_is_no_duplicate_risk(spark):
    old = catalog.assemble_concepts(decls(spark, ("PaymentGatewayExecutor", "rust")))
    new = catalog.assemble_concepts(decls(spark, ("PaymentGatewayExecutor", "rust"), ("executor_backlog", "sql", "executor_backlog")))
    none = aliases(spark)
    dec = spark.createDataFrame([], "repo string, id string, decision string")
    assert pairs(catalog_diff.catalog_events(old, new, none, none, dec, dec), "kind", "concept") == [("concept_appeared", "executor_backlog")]


def test_kotlin_is_reachable(spark):
    f = source(spark, [("a/Main.kt", "fun launchRocket() {}\n")])
    assert pairs(facts.extract_symbols(f), "name", "kind") == [("launchRocket", "Function")]
    tree = f.selectExpr("repo", "path", "cast(length(content) as bigint) as size")
    assert inventory.scannable_files(tree).count() == 1


def test_blind_spot_is_not_absence(spark):
    tree = spark.createDataFrame([("r", "game/main.lua", 10)], "repo string, path string, size bigint")
    r = ask(spark, "rocket", decls(spark, ("Other", "rust")), blind_files=inventory.blind_files(tree))
    assert (r.verdict, r.detail) == ("INSUFFICIENT_COVERAGE", "game/main.lua")
    assert ask(spark, "rocket", decls(spark, ("Other", "rust"))).verdict == "ABSENT"


def test_name_duplicates_split_risk_and_missing_alias(spark):
    d = decls(spark, ("ArticleComment", "prisma", "a"), ("ArticleLike", "prisma", "b"), ("articles", "sql", "articles"), ("Plain", "rust"))
    rel = duplicates.name_duplicates(concepts(spark, d))
    got = pairs(duplicates.duplicate_pairs(rel, rel.select("repo", "name")), "a", "b", "shared_token", "needs_alias")
    assert got == [("ArticleComment", "ArticleLike", "article", False), ("ArticleComment", "articles", "article", True), ("ArticleLike", "articles", "article", True)]


def test_claim_thresholds_are_not_capped(spark):
    d, h = decls(spark, ("Widget", "prisma", "Widget")), hits(spark, *[("Widget", f"u{i}.ts", "x") for i in range(14)])
    rows = [("r", "a", '"Widget" is used in more than 13 files'), ("r", "b", '"Widget" is used in at least 14 files'), ("r", "c", '"Widget" is used in more than 14 files')]
    c = spark.createDataFrame(rows, "repo string, id string, statement string")
    assert pairs(questions.free_claims(c, concepts(spark, d, h)), "id", "verdict") == [("a", "CONFIRMED"), ("b", "CONFIRMED"), ("c", "REFUTED")]
