"""Near-duplicate concept names, name families and duplicated logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.words import is_generic_role_word, match_words, name_tokens, name_words
from factloom.session import cut_lineage, unbroadcast

MIN_TOKEN = 5
#: Literals, or pairs of units, that one task takes.
TASK_ROWS = 1_000_000


def name_duplicates(concepts: DataFrame) -> DataFrame:
    """(repo, token, name, role, pos, has_orm): which storage concepts meet through which token.

    A ``bearer`` has the token (>= 5 bytes) at position ``pos`` of its name; a ``match`` has a word that the token
    names, ``pos`` is null. A bearer and a match of one token, bearer first by name, are near duplicates; the
    relation holds all pairs in linear size. Tokens that only one name meets are left out.
    """
    storage = concepts.where(F.col("table_name").isNotNull()).select("repo", "name", "has_orm")
    words = name_words(storage, "name", ("repo", "has_orm"))
    named = words.select("repo", "word", "name", "has_orm").distinct()
    bearers = (
        words.where((F.col("pos") > 0) & (F.octet_length("word") >= MIN_TOKEN))
        .groupBy("repo", F.col("word").alias("token"), "name")
        .agg(F.min("pos").cast("bigint").alias("pos"), F.first("has_orm").alias("has_orm"))
    )
    met = match_words(bearers, named, "token", "word", ("repo",)).join(named, ["repo", "word"])
    matches = met.groupBy("repo", "token", "name").agg(F.first("has_orm").alias("has_orm"))
    shared = matches.groupBy("repo", "token").agg(F.count(F.lit(1)).alias("names")).where("names > 1").select("repo", "token")
    rows = bearers.withColumn("role", F.lit("bearer")).unionByName(matches.withColumn("role", F.lit("match")).withColumn("pos", F.lit(None).cast("bigint")))
    return rows.join(shared, ["repo", "token"]).select("repo", "token", "name", "role", "pos", "has_orm")


def duplicate_pairs(relation: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (repo, a, b, shared_token, needs_alias), a < b, of the names in ``asked`` (repo, name), with the first token of a they share."""
    bearers = relation.where("role = 'bearer'").select("repo", "token", F.col("name").alias("a"), "pos", F.col("has_orm").alias("a_orm"))
    matches = relation.where("role = 'match'").select("repo", "token", F.col("name").alias("b"), F.col("has_orm").alias("b_orm"))
    names = asked.select("repo", "name").distinct()
    first = bearers.join(names.withColumnRenamed("name", "a"), ["repo", "a"]).join(matches, ["repo", "token"])
    second = matches.join(names.withColumnRenamed("name", "b"), ["repo", "b"]).join(bearers, ["repo", "token"])
    both = first.unionByName(second).where("a < b")
    return both.groupBy("repo", "a", "b").agg(F.min_by("token", "pos").alias("shared_token"), F.first(F.col("a_orm") != F.col("b_orm")).alias("needs_alias"))


def names_needing_alias(relation: DataFrame) -> DataFrame:
    """(repo, name): names with a near duplicate of the other storage kind, from least and greatest names alone."""
    kind = F.struct((F.col("role") == "bearer").alias("bearer"), "has_orm")
    last = F.max(F.when((F.col("role") == "match") & F.col("has_orm"), F.col("name"))).alias("last_orm"), F.max(F.when((F.col("role") == "match") & ~F.col("has_orm"), F.col("name"))).alias("last_plain")
    first = F.min(F.when((F.col("role") == "bearer") & F.col("has_orm"), F.col("name"))).alias("first_orm"), F.min(F.when((F.col("role") == "bearer") & ~F.col("has_orm"), F.col("name"))).alias("first_plain")
    ends = relation.groupBy("repo", "token").agg(*last, *first)
    other_last = F.when(F.col("has_orm"), F.col("last_plain")).otherwise(F.col("last_orm"))
    other_first = F.when(F.col("has_orm"), F.col("first_plain")).otherwise(F.col("first_orm"))
    needs = F.when(kind["bearer"], other_last > F.col("name")).otherwise(other_first < F.col("name"))
    return relation.join(ends, ["repo", "token"]).where(needs).select("repo", "name").distinct()


def name_families(concepts: DataFrame, decision_links: DataFrame, cap: int | None = None, min_size: int = 3) -> DataFrame:
    """Non-generic tokens shared by at least ``min_size`` storage concepts and linked by no decision."""
    storage = concepts.where(F.col("table_name").isNotNull()).select("repo", "name")
    tokens = storage.select("repo", "name", F.explode(name_tokens(F.col("name"))).alias("t"))
    tokens = tokens.where((F.octet_length("t") >= MIN_TOKEN) & ~is_generic_role_word(F.col("t")))
    families = (
        tokens.groupBy("repo", F.lower("t").alias("token"))
        .agg(F.count(F.lit(1)).alias("members"))
        .where(F.col("members") >= min_size)
    )
    governed = match_words(families, decision_links, "token", "link", ("repo",)).select("repo", "token").distinct()
    free = families.join(governed, ["repo", "token"], "left_anti")
    if cap is None:
        return free
    order = Window.partitionBy("repo").orderBy(F.col("members").desc(), F.col("token"))
    return free.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def _unit_literals(literals: DataFrame) -> DataFrame:
    """(repo, u, h): distinct literals of each unit, as a pair of hashes."""
    return literals.select("repo", F.struct("path", "unit").alias("u"), F.struct(F.xxhash64("literal").alias("h1"), F.hash("literal").alias("h2")).alias("h")).distinct()


def _grouped(units: DataFrame) -> DataFrame:
    """(repo, g, u, literals): units with equal literal sets, under the first of them."""
    sets = units.groupBy("repo", "u").agg(
        F.count(F.lit(1)).alias("literals"), F.sum(F.col("h.h1").cast("decimal(38,0)")).alias("s1"), F.bit_xor("h.h1").alias("s2"), F.sum(F.col("h.h2").cast("bigint")).alias("s3")
    )
    key = ["repo", "literals", "s1", "s2", "s3"]
    first = sets.groupBy(*key).agg(F.min("u").alias("g"))
    return sets.join(first, key).select("repo", "g", "u", "literals")


def logic_groups(literals: DataFrame) -> DataFrame:
    """(repo, group_path, group_unit, path, unit, literals): units with equal literal sets, under the first of them.

    Copies meet through a commutative signature of their sets, however many there are.
    """
    return _grouped(_unit_literals(literals)).select("repo", F.col("g.path").alias("group_path"), F.col("g.unit").alias("group_unit"), "u.path", "u.unit", "literals")


def _tasks(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def _opened_pairs(open_: DataFrame) -> tuple[DataFrame, int]:
    """(repo, a, b), a < b, of the units that open a pair through one of their literals in ``open_`` (repo, h, u), and the number of tasks they are dealt over.

    Pairs are counted before they are made. A literal with more than a task's share of them is cut into a grid of cells, and no task takes more than a few shares.
    """
    n = open_.groupBy("repo", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("pairs", F.expr("n * (n - 1) div 2"))
    parts = _tasks(open_, n.agg(F.sum("pairs")).first()[0] or 0)
    # at most one for each task
    hot = n.where(F.col("pairs") > TASK_ROWS).select("repo", "h", F.ceil(F.sqrt(F.col("pairs") / TASK_ROWS)).cast("int").alias("k"))
    rows = open_.join(F.broadcast(hot), ["repo", "h"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own, every, cell = F.pmod(F.hash("u"), F.col("k")), F.explode(F.sequence(F.lit(0), F.col("k") - 1)), ["repo", "h", "i", "j"]
    left = rows.select("repo", "h", own.alias("i"), every.alias("j"), F.col("u").alias("a")).repartition(parts, *cell)
    right = rows.select("repo", "h", every.alias("i"), own.alias("j"), F.col("u").alias("b")).repartition(parts, *cell)
    pairs = left.join(unbroadcast(right), cell).where("a < b").select("repo", "a", "b")
    return pairs.repartition(parts, "repo", "a", "b").distinct(), parts


def duplicate_logic(literals: DataFrame, min_shared: int = 3) -> DataFrame:
    """Pairs (repo, a_path, a_unit, b_path, b_unit, shared) of groups with at least ``min_shared`` common literals.

    ``literals`` is (repo, path, unit, literal). Groups are those of ``logic_groups``, named by their first unit; their
    copies are duplicates by membership. No literal is too common to count: two sets that share k literals
    share one beyond the k - 1 most common of each, so only those open a pair, rarest first. Groups whose units
    all lie in one file are no pair. Literals and pairs are dealt by their number, and pairs run past the sets of a task, which alone it holds.
    """
    unit = ["repo", "u"]
    units = cut_lineage(_unit_literals(literals))
    parts = _tasks(units, units.count())
    files = cut_lineage(_grouped(units.repartition(parts, *unit)).groupBy("repo", F.col("g").alias("u")).agg(F.min("u.path").alias("first_file"), F.max("u.path").alias("last_file")))
    lit = cut_lineage(units.repartition(parts, *unit).join(unbroadcast(files.select(*unit).repartition(parts, *unit)), unit, "left_semi"))
    by_literal, by_unit = lit.repartition(parts, "repo", "h"), Window.partitionBy(*unit)
    freq = by_literal.groupBy("repo", "h").agg(F.count(F.lit(1)).alias("df"))
    common = by_literal.join(freq.hint("shuffle_hash"), ["repo", "h"]).repartition(parts, *unit)
    ranked = common.withColumn("at", F.row_number().over(by_unit.orderBy("df", "h"))).withColumn("n", F.count(F.lit(1)).over(by_unit))
    open_ = cut_lineage(ranked.where((F.col("at") <= F.col("n") - (min_shared - 1)) & (F.col("df") > 1)).select("repo", "h", "u"))
    pairs, n_pairs = _opened_pairs(open_)
    parts = max(parts, n_pairs)
    sets = cut_lineage(lit.repartition(parts, *unit).groupBy(*unit).agg(F.collect_set("h").alias("hs")).join(unbroadcast(files), unit))
    side = lambda k: sets.select("repo", F.col("u").alias(k), F.col("hs").alias(f"{k}_hs"), F.col("first_file").alias(f"{k}_first"), F.col("last_file").alias(f"{k}_last")).repartition(parts, "repo", k)
    # merged, so that the pairs of one unit follow each other and the sets they carry on pack well
    both = pairs.repartition(parts, "repo", "a").join(unbroadcast(side("a")), ["repo", "a"])
    both = both.repartition(parts, "repo", "b").join(side("b").hint("shuffle_hash"), ["repo", "b"])
    both = both.where((F.least("a_first", "b_first") != F.greatest("a_last", "b_last"))).withColumn("shared", F.size(F.array_intersect("a_hs", "b_hs")).cast("bigint"))
    return both.where(F.col("shared") >= min_shared).select("repo", F.col("a.path").alias("a_path"), F.col("a.unit").alias("a_unit"), F.col("b.path").alias("b_path"), F.col("b.unit").alias("b_unit"), "shared")


def boilerplate_literals(literals: DataFrame, max_df: int = 15) -> DataFrame:
    """Literals used by more than ``max_df`` units: the common ground of a repo."""
    return (
        literals.groupBy("repo", "literal")
        .agg(F.countDistinct("path", "unit").alias("units"))
        .where(F.col("units") > max_df)
    )
