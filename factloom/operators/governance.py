"""Decisions, aliases and semantic diffs: what changed and whether it was decided."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import is_documentation, is_protected, is_test_source
from factloom.functions.words import match_words, name_words
from factloom.operators.chains import resolve_chains
from factloom.operators.reach import reach_at_least, reach_counts
from factloom.session import cut_lineage

MANY_DEPENDENTS = 10


# -- aliases and decisions ------------------------------------------------------------
def canonical_aliases(aliases: DataFrame) -> DataFrame:
    """(repo, alias, root, error): transitive targets. Cycles, empty targets and aliases with several targets are errors, one row each;
    a chain that leads to such an alias ends there."""
    per = aliases.groupBy("repo", "alias").agg(F.countDistinct("target").alias("targets"), F.min("target").alias("target"))
    several = cut_lineage(per.where("targets > 1").select("repo", "alias"))
    aliases = per.where("targets <= 1").select("repo", "alias", F.coalesce("target", F.lit("")).alias("target"))
    empty = aliases.where(F.trim("target") == "")
    edges = aliases.where(F.trim("target") != "").select("repo", F.col("alias").alias("node"), F.col("target").alias("next"))
    chains = cut_lineage(resolve_chains(edges))
    bad = empty.select("repo", F.col("alias").alias("root"), F.lit(True).alias("to_empty"))
    out = chains.join(bad, ["repo", "root"], "left")
    error = F.when(F.col("cycle"), "alias cycle").when(F.col("to_empty"), "empty alias target")
    rows = out.select("repo", F.col("node").alias("alias"), F.when(error.isNull(), F.col("root")).alias("root"), error.alias("error"))
    return rows.unionByName(empty.select("repo", "alias", F.lit(None).cast("string").alias("root"), F.lit("empty alias target").alias("error"))).unionByName(
        several.select("repo", "alias", F.lit(None).cast("string").alias("root"), F.lit("several alias targets").alias("error"))
    )


def normal_decisions(decisions: DataFrame) -> DataFrame:
    """Trimmed texts, sorted distinct lists, default status; order and spaces alone are no change."""
    tidy = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return decisions.select(
        "repo",
        F.trim("id").alias("id"),
        F.trim("decision").alias("decision"),
        F.trim("because").alias("because"),
        tidy("rejected").alias("rejected"),
        tidy("links").alias("links"),
        F.coalesce("status", F.lit("active")).alias("status"),
        "superseded_by",
    )


def decision_errors(decisions: DataFrame) -> DataFrame:
    """(repo, id, error) of decisions that are incomplete, repeated or badly superseded."""
    d = normal_decisions(decisions)
    blank = (F.coalesce("id", F.lit("")) == "") | (F.coalesce("decision", F.lit("")) == "") | (F.coalesce("because", F.lit("")) == "")
    blank = blank | F.exists("links", lambda x: F.trim(x) == "")
    err = lambda df, text: df.select("repo", "id", F.lit(text).alias("error"))
    twice = d.groupBy("repo", "id").count().where("count > 1")
    out = err(d.where(blank), "blank field").unionByName(err(twice, "duplicate id"))
    gone = d.where(F.col("status") == "superseded")
    out = out.unionByName(err(gone.where(F.col("superseded_by").isNull()), "superseded without successor"))
    out = out.unionByName(err(gone.where(F.col("superseded_by") == F.col("id")), "supersedes itself"))
    other = d.groupBy("repo", F.col("id").alias("superseded_by")).agg(F.bool_or(F.col("status") == "active").alias("alive"))
    named = gone.where(F.col("superseded_by").isNotNull() & (F.col("superseded_by") != F.col("id"))).join(other, ["repo", "superseded_by"], "left")
    out = out.unionByName(err(named.where(F.col("alive").isNull()), "successor does not exist"))
    out = out.unionByName(err(named.where(~F.col("alive")), "successor is not active"))
    stray = d.where((F.col("status") != "superseded") & F.col("superseded_by").isNotNull())
    out = out.unionByName(err(stray, "successor on a decision that is not superseded"))
    edges = d.where(F.col("superseded_by").isNotNull()).groupBy("repo", F.col("id").alias("node")).agg(F.min("superseded_by").alias("next"))
    loops = resolve_chains(edges).where("cycle").select("repo", F.col("node").alias("id"))
    return out.unionByName(err(loops, "supersession cycle"))


def changed_decisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Active decisions that are new or differ from the earlier snapshot."""
    body = F.sha2(F.to_json(F.struct("decision", "because", "rejected", "links", "status", "superseded_by")), 256)
    old = normal_decisions(before).select("repo", "id", body.alias("body"))
    new = normal_decisions(after).withColumn("body", body).where(F.col("status") == "active")
    return new.join(old, ["repo", "id", "body"], "left_anti").drop("body")


def applicable_decisions(before: DataFrame, after: DataFrame, targets: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((repo, target, id), (repo, id, link, error)): which changed decisions cover which targets.

    Links and targets are canonical names. A link with ``::`` must equal the target, any other
    its last part; a link that fits several targets is an error.
    """
    canon = canonical_aliases(aliases)
    roots = cut_lineage(canon.select("repo", F.col("alias").alias("name"), "root", "error"))
    links = changed_decisions(before, after).select("repo", "id", F.explode("links").alias("name"))
    links = links.join(roots.drop("error"), ["repo", "name"], "left").select("repo", "id", F.col("name").alias("link"), F.coalesce("root", "name").alias("to"))
    t = targets.select("repo", F.col("target").alias("name")).distinct().join(roots.drop("error"), ["repo", "name"], "left")
    t = t.select("repo", F.col("name").alias("target"), F.coalesce("root", "name").alias("identity"))
    full = t.where(F.contains("identity", F.lit("::"))).select("repo", "target", F.col("identity").alias("to"))
    last = t.select("repo", "target", F.element_at(F.split("identity", "::"), -1).alias("to"))
    hits = links.join(full.unionByName(last).distinct(), ["repo", "to"]).select("repo", "id", "link", "target").distinct()
    hits = cut_lineage(hits)
    fits = hits.groupBy("repo", "id", "link").agg(F.count(F.lit(1)).alias("n"))
    ambiguous = fits.where("n > 1").select("repo", "id", "link", F.lit("ambiguous link").alias("error"))
    bad_alias = roots.where(F.col("error").isNotNull()).select("repo", F.lit("").alias("id"), F.col("name").alias("link"), "error")
    invalid = decision_errors(after).select("repo", "id", F.lit("").alias("link"), "error")
    errors = cut_lineage(ambiguous.unionByName(bad_alias).unionByName(invalid).distinct())
    supplied = hits.select("repo", "target", "id").distinct().join(errors.select("repo").distinct(), "repo", "left_anti")
    return supplied, errors


def governing_decisions(targets: DataFrame, links: DataFrame, by_words: bool = False) -> DataFrame:
    """(repo, target, id): decisions linked to a target, by any ``::`` suffix of its name.

    ``by_words`` also takes links equal ignoring case, and links that are the same word as the
    target name or one of its tokens.
    """
    t = targets.select("repo", "target").distinct()
    parts = F.split("target", "::")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))
    exact = t.select("repo", "target", F.explode(tails).alias("link")).join(links, ["repo", "link"])
    out = exact.select("repo", "target", "id")
    if by_words:
        words = name_words(t, "target").select("repo", "target", "word").distinct()
        pairs = match_words(words, links, "word", "link", ("repo",))
        fuzzy = words.join(pairs, ["repo", "word"]).join(links, ["repo", "link"]).select("repo", "target", "id")
        out = out.unionByName(fuzzy)
    return out.distinct()


def stale_links(links: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(repo, id, link): decision links that are no known name and whose alias chain ends at none.

    ``names`` is (repo, name) of concepts and symbols. Every node of the chain is tried.
    """
    known = names.select("repo", F.col("name").alias("link")).distinct()
    open_links = links.where(F.trim("link") != "").join(known, ["repo", "link"], "left_anti")
    # An alias with a known target resolves at once; such targets end the chain.
    ends = aliases.join(known.withColumnRenamed("link", "target"), ["repo", "target"], "left_semi").select("repo", "alias", F.col("target").alias("root"))
    longer = aliases.join(ends.select("repo", "alias"), ["repo", "alias"], "left_anti")
    nodes = longer.select("repo", F.col("alias").alias("node"), F.col("target").alias("next"))
    roots = resolve_chains(nodes).where("not cycle").select("repo", F.col("node").alias("alias"), "root")
    good = roots.join(ends.select("repo", F.col("alias").alias("root")), ["repo", "root"], "left_semi").select("repo", "alias", "root")
    resolved = ends.unionByName(good).select("repo", F.col("alias").alias("link")).distinct()
    return open_links.join(resolved, ["repo", "link"], "left_anti")


# -- semantic diff --------------------------------------------------------------------
def semantic_objects(decls: DataFrame | None, symbols: DataFrame | None, imports: DataFrame | None, routes: DataFrame | None) -> DataFrame:
    """(repo, path, object, name, key, value): what a file declares, keyed for comparison."""
    parts = []

    def add(df, obj, path, name, key, value):
        parts.append(df.select("repo", F.col(path).alias("path"), F.lit(obj).alias("object"), name.alias("name"), key.alias("key"), value.alias("value")))

    if decls is not None:
        v = F.to_json(F.struct("kind", "table_name", F.array_sort("fields").alias("fields"), F.array_sort("relations").alias("relations")))
        add(decls, "concept", "path", F.col("name"), F.col("name"), v)
    if symbols is not None:
        source = F.col("source") if "source" in symbols.columns else F.lit("")
        add(symbols, "symbol", "path", F.col("name"), F.col("name"), F.to_json(F.struct("kind", source.alias("source"))))
    if imports is not None:
        v = F.to_json(F.struct("to_module", F.array_sort("names").alias("names")))
        add(imports, "relationship", "from_path", F.col("to_module"), v, v)
    if routes is not None:
        v = F.to_json(F.struct("method", "route", "handler"))
        add(routes, "route", "path", F.col("route"), v, v)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # Several rows of one key in one file: the last by value stands for it, as one object.
    return out.groupBy("repo", "path", "object", "key").agg(F.max("name").alias("name"), F.max("value").alias("value"))


def semantic_diff(
    changes: DataFrame, before: DataFrame, after: DataFrame, edges: DataFrame | None = None, unknown: DataFrame | None = None, all_dependents: bool = False
) -> DataFrame:
    """(repo, path, old_path, object, name, resource, kind, before, after, dependents, decision_required).

    ``changes`` is the output of ``changed_files``; only objects of changed files take part.
    ``unknown`` is (repo, path, reason) of files whose identities are ambiguous. ``dependents`` counts up to ``MANY_DEPENDENTS``,
    all that a decision depends on, unless ``all_dependents`` are asked for.
    """
    ch = changes.where(~is_documentation(F.col("path"))).select("repo", "status", "path", F.coalesce("old_path", "path").alias("old_path"))
    ch = cut_lineage(ch)
    b = ch.join(before.withColumnRenamed("path", "old_path"), ["repo", "old_path"]).select("repo", "path", "old_path", "object", "key", F.col("name").alias("b_name"), F.col("value").alias("before"))
    a = ch.join(after, ["repo", "path"]).select("repo", "path", "old_path", "object", "key", F.col("name").alias("a_name"), F.col("value").alias("after"))
    both = b.join(a, ["repo", "path", "old_path", "object", "key"], "full")
    moved = F.col("path") != F.col("old_path")
    link = F.col("object").isin("relationship", "route")
    kind = (
        F.when(F.col("before").isNotNull() & (F.col("before") == F.col("after")), F.when(moved, "Renamed"))
        .when(F.col("before").isNull() & link, "RelationshipAdded")
        .when(F.col("after").isNull() & link, "RelationshipRemoved")
        .when(F.col("before").isNull(), "Added")
        .when(F.col("after").isNull(), "Removed")
        .when(moved, "Renamed")
        .otherwise("Modified")
    )
    rows = both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        "repo", "path", "old_path", "object", F.coalesce("a_name", "b_name").alias("name"), "kind", "before", "after"
    )
    rows = rows.withColumn("resource", F.when(F.col("object") == "concept", F.col("name")).otherwise(F.concat_ws("::", "path", "name")))
    objects = b.select("repo", "path").unionByName(a.select("repo", "path")).distinct()
    bare = ch.where(moved).join(objects, ["repo", "path"], "left_anti").select("repo", "path", "old_path", F.lit("moved without known objects").alias("reason"))
    odd = bare
    if unknown is not None:
        odd = odd.unionByName(ch.select("repo", "path", "old_path").join(unknown.select("repo", "path", "reason").distinct(), ["repo", "path"]))
    none = F.lit(None).cast("string")
    odd = odd.select("repo", "path", "old_path", F.lit("file").alias("object"), F.col("reason").alias("name"), F.lit("Unknown").alias("kind"), none.alias("before"), none.alias("after"), F.col("path").alias("resource"))
    rows = rows.unionByName(odd)
    if edges is not None:
        starts = ch.select("repo", F.col("old_path").alias("key"), F.col("old_path").alias("path"))
        counts = reach_counts(starts, edges) if all_dependents else reach_at_least(starts, edges, MANY_DEPENDENTS)
        counts = counts.select("repo", F.col("key").alias("old_path"), F.col("n").alias("dependents"))
        rows = rows.join(counts, ["repo", "old_path"], "left")
        rows = rows.withColumn("dependents", F.coalesce("dependents", F.lit(0).cast("bigint")))
    else:
        rows = rows.withColumn("dependents", F.lit(0).cast("bigint"))
    need = (F.col("object") == "concept") | (F.col("dependents") >= MANY_DEPENDENTS) | (F.col("kind") == "Unknown")
    return rows.withColumn("decision_required", need)


def governed_diff(
    mutations: DataFrame, policy: DataFrame, links: DataFrame, supplied: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """Mutations with the decision they need: (..., decision_required, governing, supplied, violation, blocking).

    A decision is required only on protected, non-test paths of repos with a policy; advisory
    repos report without blocking. ``policy`` is (repo, enforcement, protected, excludes).
    """
    m = cut_lineage(mutations)
    none = F.array().cast("array<string>")
    rows = m.join(policy, "repo", "left")
    guarded = is_protected(F.col("path"), F.coalesce("protected", none), F.coalesce("excludes", none)) & ~is_test_source(F.col("path"))
    rows = rows.withColumn("decision_required", F.col("decision_required") & guarded)
    targets = m.select("repo", F.col("resource").alias("target")).distinct()
    n = F.count(F.lit(1))
    gov = governing_decisions(targets, links).groupBy("repo", F.col("target").alias("resource")).agg(n.alias("governing"))
    sup = supplied.groupBy("repo", F.col("target").alias("resource")).agg(n.alias("supplied"))
    rows = rows.join(gov, ["repo", "resource"], "left").join(sup, ["repo", "resource"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    rows = rows.withColumn("governing", zero("governing")).withColumn("supplied", zero("supplied"))
    bad = F.col("decision_required") & ((F.col("kind") == "Unknown") | (F.col("supplied") == 0))
    violation = F.when(bad, F.when(F.col("kind") == "Unknown", "unknown_structural_mutation").otherwise("missing_decision"))
    rows = rows.withColumn("violation", violation).withColumn(
        "blocking", violation.isNotNull() & (F.coalesce("enforcement", F.lit("advisory")) != "advisory")
    )
    out = rows.select("repo", "path", "object", "resource", "kind", "decision_required", "governing", "supplied", "violation", "blocking")
    if errors is not None:
        on = policy.where(F.size("protected") > 0).select("repo", (F.col("enforcement") != "advisory").alias("blocking"))
        inv = errors.join(on, "repo").select(
            "repo", F.lit("").alias("path"), F.lit("decision").alias("object"), F.concat_ws(" ", "id", "link").alias("resource"), F.lit("Unknown").alias("kind"),
            F.lit(True).alias("decision_required"), F.lit(0).cast("bigint").alias("governing"), F.lit(0).cast("bigint").alias("supplied"),
            F.lit("invalid_decision_update").alias("violation"), "blocking",
        )
        out = out.unionByName(inv)
    return out
