"""Batch questions over the catalog: intent, impact, plan, guard, gate, claims, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.extract.brackets import records
from factloom.extract.rules import CREATES_TABLE, EXPORTED, GAP, PAD, WORD, modifiers, quoted
from factloom.functions.paths import file_stem
from factloom.functions.words import is_generic_role_word, match_words, name_tokens, name_words
from factloom.operators.imports import fold_path
from factloom.operators.ranking import concept_candidates, first_rows
from factloom.operators.reach import structural_counts, structural_dependents
from factloom.operators.routes import route_callers, routes_for_concepts
from factloom.operators.summary import declared_dependents, zero
from factloom.plans.resolve import EXISTING, resolve_terms
from factloom.session import cut_lineage
from factloom.sources.changes import added_text

# Request words that name no concept.
STOP_WORDS = (
    "want", "need", "make", "build", "better", "improve", "with", "that", "this", "have", "from", "into", "would", "should", "could", "will", "more",
    "less", "system", "support", "please", "about", "when", "then", "them", "track", "tracking", "show", "view", "page", "data", "info", "some",
    "every", "feature", "the", "and", "for", "add", "create", "user", "users",
)
IDENT = r"[A-Za-z0-9_]+"
#: Goals that one task takes.
GOAL_ROWS = 200_000


# -- intent -----------------------------------------------------------------------------
def goal_terms(goals: DataFrame, names: DataFrame, cap: int | None = None) -> DataFrame:
    """(repo, goal_id, position, term) of each goal text: names written out in it, longest
    first, then its other words of at least four letters that are no stop words.

    ``goals`` is (repo, goal_id, text), ``names`` is (repo, name). Names are found through their first identifier among
    the identifiers of the texts, without the texts; each goal then meets its names once, where those that are more than one
    identifier are checked in the text and its other words are counted off.
    """
    low = F.lower("text")
    runs = F.array_distinct(F.regexp_extract_all(low, F.lit(IDENT), F.lit(0)))
    first = lambda name: F.regexp_extract(name, IDENT, 0)
    n = names.select("repo", F.lower("name").alias("name")).distinct().withColumn("run", first(F.col("name")))
    n = cut_lineage(n.where(F.col("run") != ""))
    met = goals.select("repo", "goal_id", F.explode(runs).alias("run")).join(n, ["repo", "run"])
    null = F.lit(None).cast("string")
    rows = goals.select("repo", "goal_id", low.alias("low"), null.alias("name")).unionByName(met.select("repo", "goal_id", null.alias("low"), "name"))
    parts = max(1, -(-goals.count() // GOAL_ROWS))
    one = rows.repartition(parts, "repo", "goal_id").groupBy("repo", "goal_id").agg(F.collect_list("low").alias("lows"), F.collect_set("name").alias("names"))
    edges = lambda text, name: F.regexp_like(text, F.concat(F.lit(r"(^|[^a-z0-9_])\Q"), name, F.lit(r"\E($|[^a-z0-9_])")))
    written = lambda name: F.exists("lows", lambda text: F.when(F.contains(text, name), edges(text, name)).otherwise(False))
    one = one.withColumn("names", F.filter("names", lambda name: F.when(name == first(name), True).otherwise(written(name))))
    by_length = F.array_sort(F.transform("names", lambda name: F.struct((-F.octet_length(name)).alias("k"), name.alias("term"))))
    taken = F.flatten(F.transform("names", lambda name: F.array_union(name_tokens(name), F.array(name))))
    words = lambda text: F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda term, pos: F.struct(pos.alias("k"), term.alias("term")))
    told = F.filter(F.flatten(F.transform("lows", words)), lambda w: (F.length(w["term"]) >= 4) & ~w["term"].isin(*STOP_WORDS))
    terms = lambda pairs: F.transform(pairs, lambda w: w["term"])
    every = F.concat(terms(by_length), F.array_except(terms(F.array_sort(told)), taken))
    if cap is not None:
        every = F.slice(every, 1, cap)
    return one.select("repo", "goal_id", F.posexplode(every).alias("position", "term")).withColumn("position", F.col("position") + 1)


def plan_bucket() -> Column:
    """What a plan does about a verdict: extend what exists, confirm what is not known, create what is absent."""
    return F.when(F.col("verdict").isin(*EXISTING), "extend").when(F.col("verdict").isin("UNKNOWN", "INSUFFICIENT_COVERAGE"), "confirm").otherwise("create")


def goal_intent(goals: DataFrame, names: DataFrame, concepts: DataFrame, cap: int | None = None, **evidence) -> DataFrame:
    """(repo, goal_id, position, term, verdict, canonical, bucket): extend, confirm or create."""
    terms = cut_lineage(goal_terms(goals, names, cap))
    answers = cut_lineage(resolve_terms(terms.select("repo", "term"), concepts, **evidence).select("repo", "term", "verdict", "canonical"))
    return terms.join(answers, ["repo", "term"]).select("repo", "goal_id", "position", "term", "verdict", "canonical", plan_bucket().alias("bucket"))


# -- impact ---------------------------------------------------------------------------
def severity(files: Column, dependents: Column, structural: Column, callers: Column) -> Column:
    return (
        F.when((files > 8) | (dependents > 3) | (structural > 5), "HIGH")
        .when((files > 0) | (dependents > 0) | (structural > 0) | (callers > 0), "MODERATE")
        .otherwise("NONE")
    )


def concept_impact(
    targets: DataFrame, concepts: DataFrame, symbols: DataFrame, edges: DataFrame,
    call_edges: DataFrame | None = None, routes: DataFrame | None = None, calls: DataFrame | None = None,
) -> DataFrame:
    """(repo, target, files, dependents, structural, callers, severity) per exact name."""
    t = cut_lineage(targets.select("repo", "target").distinct())
    n = F.count(F.lit(1))
    used = concepts.select("repo", F.col("name").alias("target"), F.col("uses").alias("files"))
    dep = declared_dependents(concepts).groupBy("repo", "target").agg(n.alias("dependents"))
    far = structural_counts(t, symbols, edges, call_edges)
    out = t.join(used, ["repo", "target"], "left").join(dep, ["repo", "target"], "left").join(far, ["repo", "target"], "left")
    if routes is not None and calls is not None:
        # read three times over: for masks, for paths and for the owners
        owned = cut_lineage(routes_for_concepts(routes, t.select("repo", F.col("target").alias("name"))))
        by_route = route_callers(owned, calls).groupBy("repo", F.col("concept").alias("target")).agg(n.alias("callers"))
        out = out.join(by_route, ["repo", "target"], "left")
    else:
        out = out.withColumn("callers", F.lit(0).cast("bigint"))
    out = out.select("repo", "target", *[zero(c) for c in ("files", "dependents", "structural", "callers")])
    return out.withColumn("severity", severity(F.col("files"), F.col("dependents"), F.col("structural"), F.col("callers")))


def term_impact(terms: DataFrame, concepts: DataFrame, symbols: DataFrame, edges: DataFrame, evidence: dict | None = None, **graph) -> DataFrame:
    """Impact per (repo, term): exact names first, then the resolve ladder; unknown without a canonical."""
    found = cut_lineage(resolve_terms(terms, concepts, symbols=symbols, exact_first=True, **(evidence or {})).select("repo", "term", "verdict", "canonical"))
    hit = concept_impact(found.where(F.col("canonical").isNotNull()).select("repo", F.col("canonical").alias("target")), concepts, symbols, edges, **graph)
    out = found.join(hit.withColumnRenamed("target", "canonical"), ["repo", "canonical"], "left")
    return out.withColumn("severity", F.coalesce("severity", F.lit("UNKNOWN")))


def field_impact(requests: DataFrame, usage: DataFrame, concepts: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, concept, field, declared, usage_files, field_files, severity).

    Requests are grouped per used file first, so every file's text is shuffled once and only if
    a request touches it; the identifiers are taken from the whole text.
    """
    r = requests.select("repo", "concept", F.lower("field").alias("field")).distinct()
    u = usage.select("repo", F.col("name").alias("concept"), "path").distinct()
    want = u.join(r, ["repo", "concept"]).groupBy("repo", "path").agg(F.collect_set("field").alias("fields"))
    low = F.lower("content")
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)))
    ident = lambda f: f.rlike("^[a-z0-9_]+$")
    with_text = files.select("repo", "path", "content").join(want, ["repo", "path"])
    direct = F.array_intersect("fields", tokens)
    # other fields are looked for in the text, at word edges; only the names of those found leave the row
    edges = lambda f: F.regexp_like(low, F.concat(F.lit(r"(^|[^a-z0-9_])\Q"), f, F.lit(r"\E($|[^a-z0-9_])")))
    rest = F.filter("fields", lambda f: F.when(ident(f), False).when(F.contains(low, f), edges(f)).otherwise(False))
    seen = with_text.select("repo", "path", F.explode(F.array_union(direct, rest)).alias("field"))
    n = F.count(F.lit(1))
    hits = r.join(u, ["repo", "concept"]).join(seen, ["repo", "path", "field"]).groupBy("repo", "concept", "field").agg(n.alias("field_files"))
    total = u.groupBy("repo", "concept").agg(n.alias("usage_files"))
    known = concepts.select("repo", F.col("name").alias("concept"), F.explode("fields").alias("f")).select("repo", "concept", F.lower("f").alias("field"), F.lit(True).alias("declared")).distinct()
    out = r.join(total, ["repo", "concept"], "left").join(hits, ["repo", "concept", "field"], "left").join(known, ["repo", "concept", "field"], "left")
    c = F.col("field_files")
    return out.select("repo", "concept", "field", F.coalesce("declared", F.lit(False)).alias("declared"), zero("usage_files"), zero("field_files")).withColumn(
        "severity", F.when(c > 5, "HIGH").when(c > 0, "MODERATE").otherwise("NONE")
    )


def change_impact(changes: DataFrame, decls: DataFrame, usage: DataFrame, symbols: DataFrame, routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, what, name, path): concepts, symbols, routes and importers touched by changed files."""
    ch = cut_lineage(changes.select("repo", "path").distinct())
    touch = lambda df, on: df.join(ch.withColumnRenamed("path", on), ["repo", on], "left_semi")
    row = lambda df, what, name, path: df.select("repo", F.lit(what).alias("what"), F.col(name).alias("name"), F.col(path).alias("path"))
    sites = decls.select("repo", "name", "path").unionByName(usage.select("repo", "name", "path")).distinct()
    out = row(touch(sites, "path"), "concept", "name", "path")
    out = out.unionByName(row(touch(symbols, "path"), "symbol", "name", "path"))
    out = out.unionByName(row(touch(routes, "path"), "route", "route", "path"))
    near = touch(edges, "to_path").unionByName(touch(edges, "from_path"))
    return out.unionByName(row(near, "importer", "from_path", "from_path")).distinct()


# -- plan and context -----------------------------------------------------------------
def goal_plan(intent: DataFrame, concepts: DataFrame, owners: DataFrame, governing: DataFrame, impact: DataFrame, top: int | None = None) -> DataFrame:
    """Existing concepts per goal, the first ``top`` if given, with owner, relations, decisions and impact.

    What is known of a concept is brought together once, however many goals name it.
    """
    ext = first_rows(intent.where("bucket = 'extend'"), ["repo", "goal_id"], [F.col("position")], top)
    own = owners.where("rank = 1").select("repo", F.col("target").alias("canonical"), "owner")
    rel = concepts.select("repo", F.col("name").alias("canonical"), F.array_join("relations", ",").alias("related"))
    dec = governing.groupBy("repo", F.col("target").alias("canonical")).agg(F.count(F.lit(1)).alias("decisions"))
    imp = impact.select("repo", F.col("target").alias("canonical"), "severity", "files")
    known = ext.select("repo", "canonical").distinct()
    for part in (own, rel, dec, imp):
        known = known.join(part, ["repo", "canonical"], "left")
    out = ext.join(cut_lineage(known), ["repo", "canonical"], "left")
    return out.select(
        "repo", "goal_id", "position", "term", "canonical", "owner", F.coalesce("related", F.lit("")).alias("related"), zero("decisions"),
        F.coalesce("severity", F.lit("NONE")).alias("severity"), zero("files"),
    )


def context_card(
    answers: DataFrame, owners: DataFrame, impact: DataFrame, events: DataFrame, gaps: DataFrame, governing: DataFrame, repos: DataFrame, coverage: DataFrame,
) -> DataFrame:
    """One row per (repo, term): the answer with owner, impact, plan, decisions, recorded changes, and what is not known.

    ``plan`` is what a change would do: extend the concept, create it, or confirm first. ``governing`` is (repo, target, id), ``repos`` is (repo, freshness),
    ``coverage`` (repo, support, files): files in supported languages, and others that may hold what was not found.
    """
    n = F.count(F.lit(1))
    own = owners.where("rank = 1").select("repo", F.col("target").alias("canonical"), "owner")
    imp = impact.select("repo", F.col("target").alias("canonical"), "severity", "files", "dependents", "structural")
    dec = governing.groupBy("repo", F.col("target").alias("canonical")).agg(n.alias("decisions"))
    hist = events.groupBy("repo", F.col("concept").alias("canonical")).agg(n.alias("changes"), F.max("ts_ms").alias("last_change_ms"))
    per_repo = (
        gaps.groupBy("repo").agg(n.alias("gaps")),
        repos.select("repo", "freshness"),
        coverage.groupBy("repo").agg(F.sum(F.when(F.col("support") == "supported", F.col("files"))).alias("covered_files"), F.sum(F.when(F.col("support") != "supported", F.col("files"))).alias("uncovered_files")),
    )
    out = answers.select("repo", "term", "verdict", "canonical", plan_bucket().alias("plan"))
    for part in (own, imp, dec, hist):
        out = out.join(part, ["repo", "canonical"], "left")
    for part in per_repo:
        out = out.join(part, "repo", "left")
    return out.select(
        "repo", "term", "verdict", "canonical", "plan", "owner", F.coalesce("severity", F.lit("NONE")).alias("severity"), zero("files"), zero("dependents"), zero("structural"), zero("decisions"), zero("changes"),
        "last_change_ms", zero("gaps"), F.coalesce("freshness", F.lit("unknown")).alias("freshness"), zero("covered_files"), zero("uncovered_files"),
    )


# -- guard and gate ------------------------------------------------------------------
CREATE_TABLE = f"(?i){CREATES_TABLE}"


def proposed_tables(proposals: DataFrame) -> DataFrame:
    """(repo, id, pos, proposed, head): tables a text creates and the word they stand for."""
    p = proposals.select("repo", "id", F.posexplode(F.regexp_extract_all("sql", F.lit(CREATE_TABLE), F.lit(1))).alias("pos", "proposed"))
    bare = F.regexp_replace("proposed", "s+$", "")
    return p.withColumn("head", F.element_at(F.split(bare, "_"), -1))


def storage_guard(proposals: DataFrame, concepts: DataFrame, links: DataFrame, **evidence) -> DataFrame:
    """(repo, id, pos, proposed, head, verdict, canonical, status, decision_id) per proposed table.

    Blocked when its head word already resolves, unless the table is re-declared by its exact
    name. A blocked table cites the first decision linked to the head, the table or the concept.
    """
    p = cut_lineage(proposed_tables(proposals))
    answers = resolve_terms(p.select("repo", F.col("head").alias("term")), concepts, **evidence)
    p = p.join(answers.select("repo", F.col("term").alias("head"), "verdict", "canonical"), ["repo", "head"], "left")
    tables = concepts.select("repo", F.col("name").alias("canonical"), "table_name")
    p = p.join(tables, ["repo", "canonical"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("ABSENT")))
    known = F.col("verdict").isin("ACTIVE", "DECLARED_ONLY", "STRUCTURAL") & F.col("canonical").isNotNull()
    low = F.lower("proposed")
    same = known & ((low == F.lower(F.coalesce("table_name", "canonical"))) | (low == F.lower("canonical")))
    p = cut_lineage(p.withColumn("status", F.when(same, "exempt").when(known, "blocked").otherwise("new")))
    blocked = p.where("status = 'blocked'")
    by_head = match_words(blocked, links, "head", "link", ("repo",)).join(links, ["repo", "link"]).groupBy("repo", "head").agg(F.min("id").alias("a"))
    by_name = links.groupBy("repo", F.lower("link").alias("low")).agg(F.min("id").alias("d"))
    out = p.join(by_head, ["repo", "head"], "left")
    for col, name in (("proposed", "b"), ("canonical", "c")):
        out = out.withColumn("low", F.lower(col)).join(by_name.withColumnRenamed("d", name), ["repo", "low"], "left").drop("low")
    cite = F.when(F.col("status") == "blocked", F.least("a", "b", "c"))
    return out.select("repo", "id", "pos", "proposed", "head", "verdict", "canonical", "status", cite.alias("decision_id"))


# A declaration's head: what stands before the keyword, the keyword, the name, and the brace or the bases after it.
HEAD = rf"(?m)^{PAD}({modifiers(EXPORTED)})(class|model){GAP}{WORD}{PAD}(\{{|\([^)]*\))?"


def declared_names(text: Column) -> Column:
    """Names that a text declares as storage: models with a body, classes that a module exports, classes on a base that is a model."""
    storage = lambda r: F.when(r[1] == "model", F.startswith(r[3], F.lit("{"))).otherwise(F.contains(r[0], F.lit("export")) | (F.startswith(r[3], F.lit("(")) & F.contains(r[3], F.lit("Model"))))
    return F.array_distinct(F.transform(F.filter(records(text, HEAD, 4), storage), lambda r: r[2]))


def name_warnings(texts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(repo, id, declared, collides_with, token): new declarations whose name hits a concept."""
    new = texts.select("repo", "id", F.explode(declared_names(F.col("text"))).alias("declared")).where(F.octet_length("declared") >= 4)
    new = new.join(concepts.select("repo", F.col("name").alias("declared")), ["repo", "declared"], "left_anti")
    tokens = new.select("repo", "id", "declared", F.posexplode(name_tokens(F.col("declared"))).alias("pos", "token"))
    tokens = tokens.where((F.octet_length("token") >= 4) & ~is_generic_role_word(F.col("token")))
    first = name_words(concepts.select("repo", "name"), "name").groupBy("repo", "word").agg(F.min("name").alias("hit"))
    hits = match_words(tokens, first, "token", "word", ("repo",), ("hit",)).groupBy("repo", "token").agg(F.min("hit").alias("hit"))
    best = tokens.join(hits, ["repo", "token"]).groupBy("repo", "id", "declared").agg(F.min(F.struct("pos", "hit", "token")).alias("b"))
    return best.select("repo", "id", "declared", F.col("b.hit").alias("collides_with"), F.col("b.token").alias("token"))


def change_gate(
    diffs: DataFrame, concepts: DataFrame, links: DataFrame, governed: DataFrame | None = None, strict: bool = False, **evidence
) -> DataFrame:
    """(repo, id, violations, warnings, verdict) per change; ``governed`` is (repo, id, blocking)."""
    texts = added_text(diffs)
    guard = storage_guard(texts.select("repo", "id", F.col("text").alias("sql")), concepts, links, **evidence)
    n = F.count(F.lit(1))
    bad = guard.where("status = 'blocked'").groupBy("repo", "id").agg(n.alias("blocked"))
    warn = name_warnings(texts, concepts).groupBy("repo", "id").agg(n.alias("warned"))
    out = diffs.select("repo", "id").distinct().join(bad, ["repo", "id"], "left").join(warn, ["repo", "id"], "left")
    if governed is not None:
        g = governed.groupBy("repo", "id").agg(F.count_if("blocking").alias("gb"), F.count_if(~F.col("blocking")).alias("gw"))
        out = out.join(g, ["repo", "id"], "left")
    else:
        out = out.withColumn("gb", F.lit(0)).withColumn("gw", F.lit(0))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = out.select("repo", "id", (z("blocked") + z("gb")).alias("violations"), (z("warned") + z("gw")).alias("warnings"))
    fail = (F.col("violations") > 0) | (F.lit(strict) & (F.col("warnings") > 0))
    return out.withColumn("verdict", F.when(fail, "BLOCKED").when(F.col("warnings") > 0, "WARNING").otherwise("PASSED"))


# -- claims ------------------------------------------------------------------------------
# How a statement says that a name is in use, what its number adds to the least number of files, and how it says that a name is absent.
USES = ("used in", "used by", "used across")
LEAST = {"more than": 1, "over": 1, "at least": 0, "no fewer than": 0}
ABSENT = ("does not exist", "doesn't exist", "is absent", "is missing", "^no ")


def free_claims(claims: DataFrame, concepts: DataFrame, **evidence) -> DataFrame:
    """(repo, id, subject, kind, verdict, found) for statements (repo, id, statement).

    The subject is the first quoted text or capitalised identifier; "used in N" is a usage
    claim, where "more than N" needs more than N files.
    """
    s, low = F.col("statement"), F.lower(F.trim("statement"))
    subject = F.coalesce(*[F.nullif(F.regexp_extract(s, rf"""(?s)^.*?(?:{quoted()}|\b([A-Z]\w+))""", k), F.lit("")) for k in (1, 2)], F.lit(""))
    usage = rf"(?:{'|'.join(USES)}){GAP}(?:({'|'.join(LEAST)}){GAP})?(\d+)"
    bound, more = F.regexp_extract(low, usage, 2), F.regexp_extract(low, usage, 1).isin(*[k for k, v in LEAST.items() if v])
    negation = low.rlike("|".join(ABSENT))
    c = claims.select(
        "repo", "id", subject.alias("subject"),
        F.when(bound != "", "usage").when(negation, "absence").otherwise("existence").alias("kind"),
        F.when(bound != "", bound.cast("bigint") + more.cast("bigint")).alias("at_least"),
    )
    c = cut_lineage(c)
    answers = resolve_terms(c.where("subject <> ''").select("repo", F.col("subject").alias("term")), concepts, **evidence)
    c = c.join(answers.select("repo", F.col("term").alias("subject"), F.col("verdict").alias("found"), "canonical"), ["repo", "subject"], "left")
    uses = concepts.select("repo", F.col("name").alias("canonical"), "uses")
    c = c.join(uses, ["repo", "canonical"], "left")
    exists = F.col("found").isin(*EXISTING)
    blind = F.col("found") == "INSUFFICIENT_COVERAGE"
    verdict = (
        F.when(F.col("found").isNull(), "UNVERIFIABLE")
        .when(F.col("kind") == "usage", F.when(F.coalesce("uses", F.lit(0)) >= F.col("at_least"), "CONFIRMED").otherwise("REFUTED"))
        .when(blind | ((F.col("kind") == "absence") & (F.col("found") == "UNKNOWN")), "UNVERIFIABLE")
        .when(exists == (F.col("kind") == "existence"), "CONFIRMED")
        .otherwise("REFUTED")
    )
    return c.select("repo", "id", "subject", "kind", verdict.alias("verdict"), "found")


#: So many different prefix lists of a repo are tried on each of its files; with more, all dependents are searched.
PREFIX_LISTS = 32


def _outside(rule: Column, path: Column) -> Column:
    """The path starts with no prefix of ``within`` and none of ``exclude``."""
    prefixes = lambda col: F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")
    inside = lambda col: F.exists(prefixes(col), lambda p: F.startswith(path, p))
    return ~inside(rule["within"]) & ~inside(rule["exclude"])


def _files_outside(iso: DataFrame, files: DataFrame) -> DataFrame | None:
    """(repo, path): files that lie outside for some claim of their repo; None if the claims have too many different prefix lists to ask that of every file."""
    rules = cut_lineage(iso.select("repo", F.struct("within", "exclude").alias("rule")).distinct())
    if not rules.groupBy("repo").count().where(F.col("count") > PREFIX_LISTS).isEmpty():
        return None
    per_repo = rules.groupBy("repo").agg(F.collect_list("rule").alias("rules"))
    some = files.join(per_repo, "repo").where(F.exists("rules", lambda r: _outside(r, F.col("path"))))
    return some.select("repo", "path").distinct()


def typed_claims(claims: DataFrame, concepts: DataFrame, usage: DataFrame, symbols: DataFrame, edges: DataFrame, call_edges: DataFrame | None = None, **evidence) -> DataFrame:
    """(repo, id, verdict, found) for (repo, id, type, target, min, within, exclude).

    absence, usage-threshold, or isolation: no use and no dependent outside the ``within``
    prefixes, where ``exclude`` prefixes never count.
    """
    c = cut_lineage(claims)
    answers = cut_lineage(resolve_terms(c.where("target is not null").select("repo", F.col("target").alias("term")), concepts, symbols=symbols, **evidence))
    c = c.join(answers.select("repo", F.col("term").alias("target"), F.col("verdict").alias("found"), "canonical"), ["repo", "target"], "left")
    c = cut_lineage(c.join(concepts.select("repo", F.col("name").alias("canonical"), "uses"), ["repo", "canonical"], "left"))
    iso = c.where("type = 'isolation' and within is not null")
    used = iso.join(usage.select("repo", F.col("name").alias("canonical"), "path").distinct(), ["repo", "canonical"])
    # only files that lie outside for some claim can speak against one
    files = edges.select("repo", F.col("from_path").alias("path"))
    if call_edges is not None:
        files = files.unionByName(call_edges.select("repo", F.col("from_path").alias("path")))
    deps = structural_dependents(iso.select("repo", "target"), symbols, edges, call_edges, ends=_files_outside(iso, files))
    near = iso.join(deps.select("repo", "target", "path"), ["repo", "target"])
    cols = ["repo", "id", "within", "exclude", "path"]
    outside = used.select(*cols).unionByName(near.select(*cols)).where(_outside(F.struct("within", "exclude"), F.col("path")))
    bad = outside.select("repo", "id", "path").distinct().groupBy("repo", "id").agg(F.count(F.lit(1)).alias("outside"))
    c = c.join(bad, ["repo", "id"], "left")
    exists = F.col("found").isin(*EXISTING)
    blind = F.col("found") == "INSUFFICIENT_COVERAGE"
    yes = lambda ok: F.when(ok, "CONFIRMED").otherwise("REFUTED")
    verdict = (
        F.when(F.col("target").isNull(), "UNVERIFIABLE")
        .when(F.col("type") == "absence", F.when(blind | (F.col("found") == "UNKNOWN"), "UNVERIFIABLE").otherwise(yes(~exists)))
        .when(F.col("type") == "usage-threshold", yes(F.coalesce("uses", F.lit(0)) >= F.coalesce("min", F.lit(1))))
        .when((F.col("type") == "isolation") & F.col("within").isNotNull() & ~blind, yes(F.col("outside").isNull()))
        .otherwise("UNVERIFIABLE")
    )
    return c.select("repo", "id", "type", "target", verdict.alias("verdict"), "found", zero("outside"))


# -- readiness, fan-out, shared places ------------------------------------------------------
def readiness(changes: DataFrame, fresh: DataFrame, plans: DataFrame, impacts: DataFrame, guards: DataFrame) -> DataFrame:
    """(repo, id, plan, impact, guard, freshness, decision) per change (repo, id)."""
    has = lambda df, name: df.select("repo", "id").distinct().withColumn(name, F.lit("complete"))
    g = guards.groupBy("repo", "id").agg(F.when(F.bool_or(F.col("status") == "blocked"), "blocked").otherwise("complete").alias("guard"))
    out = changes.select("repo", "id").distinct().join(fresh.select("repo", "freshness"), "repo", "left")
    out = out.join(has(plans, "plan"), ["repo", "id"], "left").join(has(impacts, "impact"), ["repo", "id"], "left").join(g, ["repo", "id"], "left")
    for c in ("plan", "impact", "guard"):
        out = out.withColumn(c, F.coalesce(c, F.lit("not_provided")))
    out = out.withColumn("freshness", F.coalesce("freshness", F.lit("unknown")))
    full = (F.col("plan") == "complete") & (F.col("impact") == "complete") & (F.col("guard") == "complete") & (F.col("freshness") == "fresh")
    return out.withColumn("decision", F.when(F.col("guard") == "blocked", "blocked").when(full, "evidence_complete").otherwise("advisory"))


def fan_out_terms(terms: DataFrame, repos: DataFrame, concepts: DataFrame, **evidence) -> DataFrame:
    """(term, repo, verdict, canonical): each term in every registered repo that knows it.

    Repos are found through their vocabulary - the words of concepts, aliases, symbols, handlers and file names that
    ``evidence`` brings - so terms and repos are never crossed; a last row per term (repo null, verdict
    ``ELSEWHERE_ABSENT``) counts the registered repos without a hit.
    """
    t = terms.select("term").distinct()
    known = repos.select("repo").distinct()
    live = concepts.join(known, "repo", "left_semi")
    words = concept_candidates(live, 1).select("repo", "word")
    named = {"symbols": F.col("name"), "aliases": F.col("alias"), "routes": F.col("handler"), "files": file_stem(F.col("path"))}
    for source, name in named.items():
        if evidence.get(source) is not None:
            some = evidence[source].join(known, "repo", "left_semi").select("repo", name.alias("name")).where("name is not null").distinct()
            words = words.unionByName(name_words(some, "name").select("repo", "word"))
    words = words.distinct()
    near = match_words(t, words, "term", "word").join(words, "word").select("repo", "term").distinct()
    hits = cut_lineage(resolve_terms(near, live, **evidence).where(F.col("canonical").isNotNull()).select("term", "repo", "verdict", "canonical"))
    total = repos.select("repo").distinct().count()
    rest = t.join(hits.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left")
    none = F.lit(None).cast("string")
    rest = rest.select("term", none.alias("repo"), F.lit("ELSEWHERE_ABSENT").alias("verdict"), none.alias("canonical"), (F.lit(total) - F.coalesce("n", F.lit(0))).cast("bigint").alias("repos"))
    return hits.withColumn("repos", F.lit(1).cast("bigint")).unionByName(rest)


def fan_out_status(repos: DataFrame, status: DataFrame) -> DataFrame:
    """Status of every registered repo; one without a catalog stays, with nulls."""
    return repos.select("repo", "root").distinct().join(status, "repo", "left")


def build_context_edges(services: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, service, dir): build contexts that are an existing directory below the root."""
    raw = services.where(F.coalesce("build_context", F.lit("")) != "").select("repo", "service", "build_context")
    # Depth of the walk and its lowest point: below zero means the context leaves the root.
    walk = F.aggregate(
        F.split("build_context", "/"),
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")),
        lambda a, p: F.when(p == "..", F.struct((a["d"] - 1).alias("d"), F.least(a["low"], a["d"] - 1).alias("low")))
        .when((p == "") | (p == "."), a)
        .otherwise(F.struct((a["d"] + 1).alias("d"), a["low"].alias("low"))),
    )
    raw = raw.withColumn("dir", fold_path(F.lit(""), F.col("build_context"))).where((F.col("dir") != "") & (walk["low"] >= 0) & ~F.startswith("build_context", F.lit("/")))
    parts = F.split("path", "/")
    above = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = files.select("repo", F.explode(above).alias("dir")).distinct()
    return raw.join(dirs, ["repo", "dir"], "left_semi").select("repo", "service", "dir").distinct()


def same_project_edges(git_repos: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, git_id, root): git repositories whose root was also scanned as code."""
    scanned = files.select("repo").distinct()
    return git_repos.select("repo", "git_id", "root").join(scanned, "repo", "left_semi").distinct()
