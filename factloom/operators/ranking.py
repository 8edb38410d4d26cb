"""Rank the concepts a term may mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.words import match_words, name_words, starting_like, starts

# Base score per tier; ties are broken by capped use and relation counts.
EXACT_ORM, EXACT_SQL, TOKEN_ORM, TOKEN_SQL = 2404, 1803, 1202, 601
MAX_USES, MAX_RELATIONS = 500, 100


def tier_score(exact: Column, orm: Column) -> Column:
    return (
        F.when(exact & orm, EXACT_ORM).when(exact, EXACT_SQL).when(orm, TOKEN_ORM).otherwise(TOKEN_SQL)
    )


def tier_label(exact: Column, orm: Column) -> Column:
    return (
        F.when(exact & orm, "exact-orm").when(exact, "exact-sql").when(orm, "token-orm").otherwise("token-sql")
    )


def rank_concepts(terms: DataFrame, concepts: DataFrame, top: int = 6) -> DataFrame:
    """The ``top`` concepts per (repo, term) with their score parts, rank 1 best.

    Whole-name matches always outrank token matches, so per (repo, word) only the best
    ``top`` names by token score can ever be needed. They are picked first (Spark limits
    each group before its shuffle), so a word found in a third of all names costs ``top``
    rows per term instead of all its names.
    """
    wanted = starts(terms, "term")
    hits = match_candidates(terms.select("repo", "term"), concept_candidates(concepts, top, wanted))
    return rank_candidates(hits, top)


def match_candidates(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate rows of every word each (repo, term) is the same word as.

    The few rows per word travel with it as an array, so the vocabulary join is the only one.
    """
    cols = [c for c in candidates.columns if c not in ("repo", "word")]
    by_word = candidates.groupBy("repo", "word").agg(F.collect_list(F.struct(*cols)).alias("rows"))
    pairs = match_words(terms, by_word, "term", "word", ("repo",), ("rows",))
    return pairs.select("repo", "term", F.explode("rows").alias("r")).select("repo", "term", "r.*")


def concept_candidates(concepts: DataFrame, top: int = 6, wanted: DataFrame | None = None) -> DataFrame:
    """(repo, word, name, exact, ...): the best ``top`` whole names and names per token of a word.

    ``wanted`` (see ``starts``) keeps only words that some term can match.
    """
    scored = concepts.select(
        "repo",
        "name",
        "has_orm",
        F.least(F.col("uses"), F.lit(MAX_USES)).cast("int").alias("usage_score"),
        F.least(F.col("n_relations"), F.lit(MAX_RELATIONS)).cast("int").alias("relation_score"),
    )
    words = starting_like(name_words(scored, "name", ("repo", "has_orm", "usage_score", "relation_score")), wanted)
    words = words.groupBy("repo", "name", "has_orm", "usage_score", "relation_score", "word").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"))
    words = words.select("*", F.explode(F.expr("case when pos = 0 and last > 0 then array(true, false) else array(pos = 0) end")).alias("exact"))
    token_total = tier_score(F.col("exact"), F.col("has_orm")) + F.col("usage_score") + F.col("relation_score")
    by_word = Window.partitionBy("repo", "word", "exact").orderBy(token_total.desc(), F.col("name"))
    ranked = words.withColumn("n", F.row_number().over(by_word)).where(F.col("n") <= top)
    return ranked.select("repo", "word", "name", "exact", "has_orm", "usage_score", "relation_score")


def rank_candidates(hits: DataFrame, top: int = 6) -> DataFrame:
    """Best ``top`` names per (repo, term) out of matched candidate rows."""
    found = (
        hits.groupBy("repo", "term", "name")
        .agg(
            F.max("exact").alias("exact"),
            F.first("has_orm").alias("has_orm"),
            F.first("usage_score").alias("usage_score"),
            F.first("relation_score").alias("relation_score"),
        )
        .withColumn("tier", tier_label(F.col("exact"), F.col("has_orm")))
        .withColumn("tier_score", tier_score(F.col("exact"), F.col("has_orm")))
        .withColumn("total", F.col("tier_score") + F.col("usage_score") + F.col("relation_score"))
    )
    best = Window.partitionBy("repo", "term").orderBy(F.col("total").desc(), F.col("name"))
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select("repo", "term", "rank", "name", "tier", "tier_score", "usage_score", "relation_score", "total")
    )


def competing(ranked: DataFrame) -> DataFrame:
    """Ranks 2..6 of each term."""
    return ranked.where((F.col("rank") >= 2) & (F.col("rank") <= 6))


def first_rows(df: DataFrame, group: list[str], order: list[Column], cap: int | None) -> DataFrame:
    """The first ``cap`` rows per group in a total order; all rows when ``cap`` is None."""
    if cap is None:
        return df
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("_n") <= cap).drop("_n")


def best_by_word(symbols: DataFrame, name_col: str = "name", path_col: str = "path", wanted: DataFrame | None = None) -> DataFrame:
    """(repo, word, inexact, at, hit): the first symbol per word, exact names first, then path and name.

    Equal names are folded to their first path before they are cut into words. With ``wanted`` words that no term can match are dropped
    where the names are read, so nothing is shuffled for them.
    """
    rows = symbols.select("repo", path_col, name_col) if wanted is not None else symbols.groupBy("repo", name_col).agg(F.min(path_col).alias(path_col))
    return (
        starting_like(name_words(rows, name_col, ("repo", path_col)), wanted)
        .withColumn("inexact", (F.col("pos") > 0).cast("int"))
        .groupBy("repo", "word")
        .agg(F.min(F.struct("inexact", F.col(path_col).alias("at"), F.col(name_col).alias("hit"))).alias("best"))
        .select("repo", "word", "best.*")
    )


def symbol_hits(terms: DataFrame, symbols: DataFrame, cap: int | None = None) -> DataFrame:
    """All symbols a term names, with their order number: exact first, then path, name.

    With ``cap`` the lists are cut per (repo, word) before the terms are joined in.
    """
    words = name_words(symbols, "name", ("repo", "path", "kind", "line")).withColumn("exact", F.col("pos") == 0)
    words = words.groupBy("repo", "word", "path", "name", "kind", "line").agg(F.max("exact").alias("exact"))
    order = [F.col("exact").desc(), F.col("path"), F.col("name"), F.col("kind"), F.col("line")]
    words = first_rows(words, ["repo", "word"], order, cap)
    pairs = match_words(terms.select("repo", "term").distinct(), words, "term", "word", ("repo",))
    hits = pairs.join(words, ["repo", "word"]).groupBy("repo", "term", "path", "name", "kind", "line").agg(
        F.max("exact").alias("exact")
    )
    return first_rows(hits, ["repo", "term"], order, cap)
