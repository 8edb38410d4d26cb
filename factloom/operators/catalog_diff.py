"""What changed between two catalogs, as timeline events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.words import is_generic_role_word, match_words, name_tokens, name_words
from factloom.session import cut_lineage


def _event(df: DataFrame, kind: str, concept: str, related=None, via=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c)
    return df.select(
        "repo", F.lit(kind).alias("kind"), F.col(concept).alias("concept"), text(related).alias("related"), text(via).alias("via")
    )


def renames(removed: DataFrame, appeared: DataFrame) -> DataFrame:
    """(repo, old, new, evidence): same table, or at least 3 and 60 % of the old fields shared.

    Field overlap is found by prefix filtering: with the old fields ordered from rare to common, a
    pair that shares t of n fields must share one of the first n - t + 1, so common fields
    such as ``id`` rarely become join keys. The first new name by order wins.
    """
    by_table = (
        removed.select("repo", F.col("name").alias("old"), "table_name")
        .join(appeared.select("repo", F.col("name").alias("new"), "table_name"), ["repo", "table_name"])
        .select("repo", "old", "new", F.concat(F.lit("same table "), "table_name").alias("evidence"), F.lit(0).alias("prio"))
    )
    of = removed.select("repo", F.col("name").alias("old"), F.size("fields").alias("n"), F.explode("fields").alias("field"))
    nf = appeared.select("repo", F.col("name").alias("new"), F.explode(F.array_distinct("fields")).alias("field"))
    freq = nf.groupBy("repo", "field").agg(F.count(F.lit(1)).alias("freq"))
    order = Window.partitionBy("repo", "old").orderBy(F.coalesce("freq", F.lit(0)), "field")
    need = F.greatest(F.lit(3), F.ceil(F.col("n") * 6 / 10)).cast("int")
    prefix = of.join(freq, ["repo", "field"], "left").withColumn("at", F.row_number().over(order)).where(F.col("at") <= F.col("n") - need + 1)
    cand = prefix.select("repo", "old", "field").join(nf, ["repo", "field"]).select("repo", "old", "new").distinct()
    old_arr = removed.select("repo", F.col("name").alias("old"), F.col("fields").alias("of"))
    new_arr = appeared.select("repo", F.col("name").alias("new"), F.col("fields").alias("nf"))
    shared = F.size(F.filter("of", lambda f: F.array_contains(F.col("nf"), f)))
    by_fields = (
        cand.join(old_arr, ["repo", "old"])
        .join(new_arr, ["repo", "new"])
        .withColumn("shared", shared)
        .where((F.col("shared") >= 3) & (F.col("shared") * 10 >= F.size("of") * 6))
        .select("repo", "old", "new", F.concat(F.col("shared").cast("string"), F.lit(" shared fields")).alias("evidence"), F.lit(1).alias("prio"))
    )
    best = by_table.unionByName(by_fields).groupBy("repo", "old").agg(F.min(F.struct("new", "prio", "evidence")).alias("b"))
    return best.select("repo", "old", F.col("b.new").alias("new"), F.col("b.evidence").alias("evidence"))


def stale_aliases(aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """Aliases whose target, without trailing s, names no concept."""
    names = concepts.select("repo", "name").distinct()
    exact = aliases.join(names.withColumnRenamed("name", "target"), ["repo", "target"], "left_anti")
    bare = exact.withColumn("bare", F.regexp_replace("target", "s+$", ""))
    words = name_words(names, "name").select("repo", "word").distinct()
    hit = match_words(bare, words, "bare", "word", ("repo",)).select("repo", "bare").distinct()
    return bare.join(hit, ["repo", "bare"], "left_anti").drop("bare")


def catalog_events(
    old: DataFrame,
    new: DataFrame,
    old_aliases: DataFrame,
    new_aliases: DataFrame,
    old_decisions: DataFrame,
    new_decisions: DataFrame,
) -> DataFrame:
    """(repo, kind, concept, related, via) rows of everything that changed.

    Catalogs are (repo, name, table_name, fields); aliases (repo, alias, target); decisions (repo, id, decision).
    """
    gone = cut_lineage(old.join(new.select("repo", "name"), ["repo", "name"], "left_anti").select("repo", "name", "table_name", "fields"))
    came = cut_lineage(new.join(old.select("repo", "name"), ["repo", "name"], "left_anti").select("repo", "name", "table_name", "fields"))
    moved = cut_lineage(renames(gone, came))
    fresh = came.join(moved.select("repo", F.col("new").alias("name")), ["repo", "name"], "left_anti")
    lost = gone.join(moved.select("repo", F.col("old").alias("name")), ["repo", "name"], "left_anti")

    tokens = fresh.select("repo", "name", F.posexplode(name_tokens(F.col("name"))).alias("pos", "token"))
    tokens = tokens.where(~is_generic_role_word(F.col("token"))).withColumn("token", F.lower("token"))
    old_words = name_words(old.select("repo", "name"), "name").groupBy("repo", "word").agg(F.min("name").alias("hit"))
    by_name = match_words(tokens, old_words, "token", "word", ("repo",), ("hit",)).groupBy("repo", "token").agg(F.min("hit").alias("hit"))
    first_alias = new_aliases.groupBy("repo", F.lower("alias").alias("word")).agg(F.min(F.struct("alias", "target")).alias("a"))
    by_alias = match_words(tokens, first_alias, "token", "word", ("repo",), ("a",)).groupBy("repo", "token").agg(F.min("a").alias("a"))
    risk = (
        tokens.join(by_name, ["repo", "token"], "left")
        .join(by_alias, ["repo", "token"], "left")
        .withColumn("existing", F.coalesce("hit", "a.target"))
        .where(F.col("existing") != F.col("name"))
        .groupBy("repo", "name")
        .agg(F.min(F.struct("pos", "existing", "token")).alias("r"))
        .select("repo", "name", F.col("r.existing").alias("existing"), F.col("r.token").alias("token"))
    )
    a_new = new_aliases.join(old_aliases.select("repo", "alias"), ["repo", "alias"], "left_anti")
    a_old = old_aliases.join(new_aliases.select("repo", "alias"), ["repo", "alias"], "left_anti")
    d_new = new_decisions.join(old_decisions.select("repo", "id"), ["repo", "id"], "left_anti")
    d_old = old_decisions.join(new_decisions.select("repo", "id"), ["repo", "id"], "left_anti")
    events = [
        _event(moved, "concept_renamed", "new", "old", "evidence"),
        _event(fresh, "concept_appeared", "name"),
        _event(risk, "duplicate_concept_risk", "name", "existing", "token"),
        _event(lost, "concept_lost_storage", "name"),
        _event(a_new, "alias_introduced", "alias", "target"),
        _event(a_old, "alias_removed", "alias", "target"),
        _event(d_new, "decision_added", "id", "decision"),
        _event(d_old, "decision_removed", "id", "decision"),
        _event(stale_aliases(new_aliases, new), "stale_alias", "alias", "target"),
    ]
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e)
    return out
