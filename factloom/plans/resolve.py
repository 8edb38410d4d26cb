"""Resolve terms: does it exist, under which name, and how do we know?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import file_stem
from factloom.functions.words import match_words, name_words, starts
from factloom.session import cut_lineage
from factloom.operators.ranking import best_by_word, concept_candidates, match_candidates, tier_score

EXISTING = ("ACTIVE", "DECLARED_ONLY", "SYMBOL", "STRUCTURAL")


def alias_lookup(terms: DataFrame, aliases: DataFrame) -> DataFrame:
    """(repo, term, alias, target): the first alias, by key, that the term names."""
    keys = aliases.select("repo", "alias", "target").distinct()
    words = name_words(keys, "alias", ("repo", "target"))
    best = words.groupBy("repo", "word").agg(F.min(F.struct("alias", "target")).alias("best"))
    return (
        match_words(terms.select("repo", "term").distinct(), best, "term", "word", ("repo",))
        .join(best, ["repo", "word"])
        .groupBy("repo", "term")
        .agg(F.min("best").alias("best"))
        .select("repo", "term", "best.alias", "best.target")
    )


def resolve_terms(
    terms: DataFrame,
    concepts: DataFrame,
    symbols: DataFrame | None = None,
    routes: DataFrame | None = None,
    files: DataFrame | None = None,
    aliases: DataFrame | None = None,
    blind_files: DataFrame | None = None,
    exact_first: bool = False,
) -> DataFrame:
    """One row per (repo, term): verdict, canonical, via, confidence, competing.

    Rungs: alias, declared concept, symbol, route handler, file name, blind spot, absent. The
    rungs form one candidate list with a bounded number of rows per word, so all terms are
    matched in a single join; the best rung per term is one aggregation. With ``exact_first`` a term that is a concept's exact
    name is that concept, before any alias or word search.
    """
    null = F.lit(None).cast("string")
    asked = terms.select("repo", F.trim("term").alias("term")).where(F.col("term") != "").distinct()
    names = concepts.select("repo", "name", "uses", "in_memory")
    work = asked.withColumn("alias", null).withColumn("search", F.col("term"))
    if aliases is not None:
        via = alias_lookup(asked, aliases)
        work = asked.join(via, ["repo", "term"], "left").select("repo", "term", "alias", F.coalesce("target", "term").alias("search"))
    if exact_first:
        own = names.select("repo", F.col("name").alias("term"), F.lit(True).alias("own"))
        work = work.join(own, ["repo", "term"], "left").select(
            "repo", "term", F.when(F.col("own").isNull(), F.col("alias")).alias("alias"),
            F.when(F.col("own"), F.col("term")).otherwise(F.col("search")).alias("search"), "own",
        )
    else:
        work = work.withColumn("own", F.lit(None).cast("boolean"))
    if aliases is not None or exact_first:
        target = names.select("repo", F.col("name").alias("search"), F.col("uses").alias("fixed_uses"))
        work = work.join(target, ["repo", "search"], "left")
        direct = F.col("fixed_uses").isNotNull() & (F.col("alias").isNotNull() | F.col("own"))
        work = cut_lineage(work.withColumn("direct", F.coalesce(direct, F.lit(False))))
    else:
        work = work.withColumn("fixed_uses", F.lit(None).cast("bigint")).withColumn("direct", F.lit(False))

    # One candidate list over all rungs, so the terms are matched against one vocabulary.
    search = work.where(~F.col("direct")).select("repo", F.col("search").alias("term"))
    # written, so that its size is known before the names are read: a short list goes to where they are, a long one is joined
    wanted = cut_lineage(starts(search, "term"))
    cand = concept_candidates(concepts, wanted=wanted).withColumn("rung", F.lit(2)).withColumn("inexact", F.lit(0)).withColumn("at", null)
    cols = ["repo", "word", "rung", "inexact", "at", "name"]
    for rung, source in (
        (3, symbols),
        (4, None if routes is None else routes.select("repo", "path", F.col("handler").alias("name"))),
        (5, None if files is None else files.select("repo", "path", file_stem(F.col("path")).alias("name"))),
    ):
        if source is not None:
            best = best_by_word(source, wanted=wanted).withColumnRenamed("hit", "name").withColumn("rung", F.lit(rung))
            cand = cand.unionByName(best.select(*cols), allowMissingColumns=True)
    hits = match_candidates(search, cand).groupBy("repo", "term", "rung", "name").agg(
        F.max(F.struct("exact", "has_orm", "usage_score", "relation_score")).alias("c"), F.min(F.struct("inexact", "at")).alias("p")
    )
    total = tier_score(F.col("c.exact"), F.col("c.has_orm")) + F.col("c.usage_score") + F.col("c.relation_score")
    order = [F.col("rung"), F.when(F.col("rung") == 2, total).desc(), F.col("p.inexact"), F.col("p.at"), F.col("name")]
    ranked = hits.withColumn("n", F.row_number().over(Window.partitionBy("repo", "term").orderBy(*order))).where(F.col("n") <= 6)
    others = F.collect_list(F.when((F.col("n") > 1) & (F.col("rung") == 2), F.struct("n", "name")))
    found = ranked.groupBy("repo", F.col("term").alias("search")).agg(
        F.min(F.struct("n", "rung", "name", F.col("p.at").alias("at"))).alias("top"),
        F.transform(F.array_sort(others), lambda s: s["name"]).alias("others"),
    )
    rung = F.col("top.rung")
    found = found.select(
        "repo",
        "search",
        rung.alias("rung"),
        F.when(rung < 5, F.col("top.name")).alias("hit"),
        F.col("top.at").alias("at"),
        F.when(rung == 2, F.array_join("others", ", ")).otherwise("").alias("others"),
    )
    best = work.join(found, ["repo", "search"], "left")
    stats = names.select("repo", F.col("name").alias("hit"), "uses", "in_memory", F.lit(2).alias("rung"))
    best = best.join(stats, ["repo", "hit", "rung"], "left")
    if blind_files is not None:
        best = best.join(blind_files.groupBy("repo").agg(F.min("path").alias("blind")), "repo", "left")
    else:
        best = best.withColumn("blind", null)
    rung, direct = F.col("rung"), F.col("direct")
    answer = lambda v, c, d, k: F.struct(v.alias("verdict"), c.alias("canonical"), d.alias("detail"), k.alias("competing"))
    no = F.lit("")
    best = best.select(
        "repo",
        "term",
        "alias",
        F.when(direct, answer(F.when(F.col("fixed_uses") > 0, "ACTIVE").otherwise("DECLARED_ONLY"), F.col("search"), F.lit("declared"), no))
        .when(
            rung == 2,
            answer(
                F.when(F.col("uses") > 0, "ACTIVE").when(F.col("in_memory"), "SYMBOL").otherwise("DECLARED_ONLY"),
                F.col("hit"), F.lit("declared"), F.col("others"),
            ),
        )
        .when(rung < 5, answer(F.lit("STRUCTURAL"), F.col("hit"), F.col("at"), no))
        .when(rung == 5, answer(F.lit("UNKNOWN"), null, F.col("at"), no))
        .when(F.col("blind").isNotNull(), answer(F.lit("INSUFFICIENT_COVERAGE"), null, F.col("blind"), no))
        .otherwise(answer(F.lit("ABSENT"), null, no, no))
        .alias("r"),
    )
    dangling = F.col("alias").isNotNull() & F.col("r.canonical").isNull()
    verdict = F.when(dangling, "UNKNOWN").otherwise(F.col("r.verdict"))
    return best.select(
        "repo",
        "term",
        verdict.alias("verdict"),
        F.col("r.canonical").alias("canonical"),
        F.when(F.col("alias").isNotNull(), "alias").otherwise("name").alias("via"),
        F.when(dangling, F.concat(F.lit("dangling alias "), "alias")).otherwise(F.col("r.detail")).alias("detail"),
        F.when(dangling, F.lit("")).otherwise(F.col("r.competing")).alias("competing"),
        F.when(dangling | (verdict == "UNKNOWN"), "low")
        .when(verdict.isin("ACTIVE", "STRUCTURAL", "ABSENT"), "high")
        .when(verdict == "INSUFFICIENT_COVERAGE", "unknown")
        .otherwise("medium")
        .alias("confidence"),
        F.when(dangling, "fix the alias")
        .when(verdict == "ACTIVE", "extend it")
        .when(verdict == "DECLARED_ONLY", "confirm before extending")
        .when(verdict == "SYMBOL", "in memory only")
        .when(verdict == "STRUCTURAL", "exists in source, no storage")
        .when(verdict == "UNKNOWN", "read the named files")
        .when(verdict == "INSUFFICIENT_COVERAGE", "read the unseen files")
        .otherwise("new here")
        .alias("recommendation"),
    )
