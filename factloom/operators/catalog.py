"""Assemble concepts from declarations, attach usage, fold, link and sign the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.chains import resolve_chains
from factloom.operators.order_stats import numbered_in_groups
from factloom.functions.words import match_words, name_words
from factloom.session import cut_lineage, unbroadcast

# Kinds that describe memory layout, not storage.
IN_MEMORY_KINDS = ("rust", "go-struct")
#: Usage rows, or files, that one task takes.
TASK_ROWS = 1_000_000
LINKABLE_KINDS = ("Class", "Interface", "Route", "Event")


def declaration_sites(decls: DataFrame) -> DataFrame:
    """Distinct (repo, name, path, kind)."""
    return decls.select("repo", "name", "path", "kind").distinct()


def assemble_concepts(decls: DataFrame) -> DataFrame:
    """One row per (repo, name): site count, kind flags, and the first non-empty
    fields, relations and table in (path, line, kind) order."""
    at = F.struct("path", "line", "kind")
    first = lambda c, ok: F.min_by(F.when(ok, c), F.when(ok, at))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    empty = F.array().cast("array<string>")
    return decls.groupBy("repo", "name").agg(
        F.countDistinct("path", "kind").alias("n_sites"),
        F.bool_or(F.col("kind") != "sql").alias("has_orm"),
        F.bool_and(F.col("kind").isin(*IN_MEMORY_KINDS)).alias("all_memory_kinds"),
        F.bool_and(F.col("kind") == "prisma-enum").alias("enum_only"),
        F.coalesce(first(F.col("fields"), some(F.col("fields"))), empty).alias("fields"),
        F.coalesce(first(F.col("relations"), some(F.col("relations"))), empty).alias("relations"),
        first(F.col("table_name"), F.col("table_name").isNotNull()).alias("table_name"),
        F.min("path").alias("first_path"),
    )


def attach_usage(hits: DataFrame, decls: DataFrame) -> DataFrame:
    """Distinct usage rows of declared concepts, without the files that declare them.

    They are dealt by concept and file over as many tasks as their rows need: equal paths compress so well that a task's share by bytes would be millions of rows.
    """
    site, known = ["repo", "name", "path"], decls.select("repo", "name").distinct()
    rows = hits.select(*site, "kind")
    parts = max(1, -(-rows.count() // TASK_ROWS))
    sites = decls.select(*site).distinct().repartition(parts, *site)
    return rows.join(known, ["repo", "name"], "left_semi").repartition(parts, *site).distinct().join(unbroadcast(sites), site, "left_anti")


def usage_counts(usage: DataFrame) -> DataFrame:
    """Distinct using files, and (file, kind) pairs, per concept."""
    files = usage.groupBy("repo", "name", "path").agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("repo", "name").agg(F.count("path").alias("uses"), F.sum("n").alias("use_pairs"))


def hit_counts(hits: DataFrame, decls: DataFrame) -> DataFrame:
    """``usage_counts`` of ``attach_usage`` for every name that is hit, declared or not.

    Declaring files come along as marked rows, so hits are dealt once, by concept and file, and joined with nothing.
    """
    site = ["repo", "name", "path"]
    parts = max(1, -(-hits.count() // TASK_ROWS))
    sites = decls.where(F.col("path").isNotNull()).select(*site, F.lit(None).cast("string").alias("kind"), F.lit(True).alias("own"))
    rows = hits.select(*site, "kind", F.lit(False).alias("own")).unionByName(sites).repartition(parts, *site)
    files = rows.distinct().groupBy(*site).agg(F.count_if(~F.col("own")).alias("n"), F.bool_or("own").alias("own"))
    return files.where("not own").groupBy("repo", "name").agg(F.count("path").alias("uses"), F.sum("n").alias("use_pairs"))


def build_catalog(decls: DataFrame, hits: DataFrame) -> DataFrame:
    """Concepts with usage counts and the flags the questions need."""
    # names that nobody declares fall away where counts meet the concepts
    counts = hit_counts(hits, decls)
    return (
        assemble_concepts(decls)
        .join(counts, ["repo", "name"], "left")
        .withColumn("uses", F.coalesce("uses", F.lit(0).cast("bigint")))
        .withColumn("use_pairs", F.coalesce("use_pairs", F.lit(0).cast("bigint")))
        .withColumn("n_relations", F.size("relations"))
        .withColumn("in_memory", F.col("all_memory_kinds") & F.col("table_name").isNull())
        .drop("all_memory_kinds")
    )


def sql_folds(concepts: DataFrame) -> DataFrame:
    """(repo, name, root): SQL-only concepts that are another concept's table.

    Chains end at a surviving root; cycles stay unmerged.
    """
    sql_only = concepts.where(~F.col("has_orm")).select("repo", "name", F.lower("name").alias("k"))
    owners = concepts.where(F.col("table_name").isNotNull()).select(
        "repo", F.col("name").alias("owner"), F.lower("table_name").alias("k")
    )
    step = (
        sql_only.join(owners, ["repo", "k"])
        .where(F.col("owner") != F.col("name"))
        .groupBy("repo", "name")
        .agg(F.min("owner").alias("next"))
    )
    chains = resolve_chains(step.select("repo", F.col("name").alias("node"), "next"))
    return chains.where(~F.col("cycle")).select("repo", F.col("node").alias("name"), "root")


def fold_sql_concepts(decls: DataFrame, concepts: DataFrame) -> DataFrame:
    """Declarations with folded SQL names renamed to their root; the concepts' own fields win.

    A folded row keeps its site but adds neither fields nor relations, and its table is
    used only when no row of the root names one, because it sorts behind all of them.
    """
    folds = sql_folds(concepts).withColumnRenamed("root", "to")
    return decls.join(folds, ["repo", "name"], "left").select(
        "repo",
        "path",
        "line",
        F.coalesce("to", "name").alias("name"),
        "kind",
        F.when(F.col("to").isNull(), F.col("fields")).alias("fields"),
        F.when(F.col("to").isNull(), F.col("relations")).alias("relations"),
        F.when(F.col("to").isNull(), F.col("table_name")).alias("table_name"),
        F.when(F.col("to").isNotNull(), F.col("table_name")).alias("folded_table"),
    )


def assemble_folded(folded: DataFrame) -> DataFrame:
    """``assemble_concepts`` over folded declarations."""
    spare = folded.groupBy("repo", "name").agg(
        F.min_by("folded_table", F.when(F.col("folded_table").isNotNull(), F.struct("path", "line"))).alias("spare")
    )
    return (
        assemble_concepts(folded)
        .join(spare, ["repo", "name"])
        .withColumn("table_name", F.coalesce("table_name", "spare"))
        .drop("spare")
    )


def carry_first_seen(concepts: DataFrame, prior: DataFrame, now_ms: Column) -> DataFrame:
    """first_seen_ms from the prior catalog when it has one, else now."""
    old = prior.where(F.col("first_seen_ms") > 0).groupBy("repo", "name").agg(F.min("first_seen_ms").alias("old_ms"))
    return (
        concepts.join(old, ["repo", "name"], "left")
        .withColumn("first_seen_ms", F.least(F.coalesce("old_ms", now_ms), now_ms))
        .withColumn("last_verified_ms", now_ms)
        .drop("old_ms")
    )


def catalog_signature(concepts: DataFrame) -> DataFrame:
    """Order-free signature per repo over ``name:table``.

    Two independent 64-bit halves of SHA-256 are summed, so a repo of any size folds in
    map-side partial aggregates and is never gathered into one task.
    """
    line = F.concat(F.col("name"), F.lit(":"), F.coalesce("table_name", F.lit("")))
    digest = F.sha2(line, 256)
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")
    return (
        concepts.select("repo", part(1).alias("a"), part(13).alias("b"))
        .groupBy("repo")
        .agg(
            F.count(F.lit(1)).alias("concepts"),
            F.concat_ws("-", F.sum("a").cast("string"), F.sum("b").cast("string")).alias("signature"),
        )
    )


def link_symbols(symbols: DataFrame, concepts: DataFrame) -> DataFrame:
    """Add ``linked_concept``: the concept of that exact name, else the first concept name
    that is the same word as the symbol name or one of its tokens."""
    linkable = symbols.where(F.col("kind").isin(*LINKABLE_KINDS)).select("repo", "name").distinct()
    names = concepts.select("repo", F.col("name").alias("concept")).distinct()
    exact = linkable.join(names.withColumn("name", F.col("concept")), ["repo", "name"])
    words = name_words(linkable.join(exact.select("repo", "name"), ["repo", "name"], "left_anti"), "name")
    first = (
        match_words(words, names, "word", "concept", ("repo",))
        .groupBy("repo", "word")
        .agg(F.min("concept").alias("concept"))
    )
    fuzzy = words.join(first, ["repo", "word"]).groupBy("repo", "name").agg(F.min("concept").alias("concept"))
    links = exact.select("repo", "name", "concept").unionByName(fuzzy).withColumnRenamed("concept", "linked_concept")
    linked = symbols.join(links, ["repo", "name"], "left")
    keep = F.col("kind").isin(*LINKABLE_KINDS)
    return linked.withColumn("linked_concept", F.when(keep, F.col("linked_concept")))


def symbols_of_concepts(linked: DataFrame) -> DataFrame:
    """Symbols per concept with their ``position`` in (kind, name, path, line) order, from 1."""
    found = linked.where(F.col("linked_concept").isNotNull()).select("repo", F.col("linked_concept").alias("concept"), "kind", "name", "path", "line")
    return numbered_in_groups(found, ["repo", "concept"], [F.col(c) for c in ("kind", "name", "path", "line")], "position")


def file_facts(decls: DataFrame, linked: DataFrame) -> DataFrame:
    """Concepts declared in a file and its symbols that link to no concept."""
    declared = decls.select("repo", "path", "name", F.lit("concept").alias("what")).distinct()
    loose = (
        linked.where(F.col("linked_concept").isNull())
        .select("repo", "path", "name", F.lit("symbol").alias("what"))
        .distinct()
    )
    return declared.unionByName(loose)


def known_files(decls: DataFrame, files: DataFrame) -> DataFrame:
    """Every scanned file with a flag: does it declare a concept?"""
    declaring = decls.select("repo", "path").distinct().withColumn("declares", F.lit(True))
    return (
        files.select("repo", "path")
        .distinct()
        .join(declaring, ["repo", "path"], "left")
        .withColumn("declares", F.coalesce("declares", F.lit(False)))
    )


def file_counts(known: DataFrame, facts: DataFrame) -> DataFrame:
    """(repo, declares, what, files, names): how many files hold how many facts, files without any included.

    Files and facts meet dealt by file over as many tasks as their rows need, as usage is, and are counted where they meet.
    """
    site, known = ["repo", "path"], cut_lineage(known)
    parts = max(1, -(-known.count() // TASK_ROWS))
    rows = known.repartition(parts, *site).join(unbroadcast(facts.repartition(parts, *site)), site, "left")
    return rows.groupBy("repo", "declares", "what").agg(F.countDistinct("path").alias("files"), F.count("name").alias("names"))
