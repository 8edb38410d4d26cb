"""Counts, rankings and reports over the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import owning_dir
from factloom.operators.order_stats import exact_rank, first_names, numbered_in_groups
from factloom.operators.ranking import first_rows


def zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)


def usage_counts(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """Per repo: files, concepts, used and unused; enum-only concepts do not count as unused."""
    f = files.groupBy("repo").agg(F.countDistinct("path").alias("files"))
    c = concepts.groupBy("repo").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("uses") > 0).alias("used"), F.count_if(_unused()).alias("unused"))
    return f.join(c, "repo", "left").select("repo", "files", zero("concepts"), zero("used"), zero("unused"))


def _unused() -> Column:
    return (F.col("uses") == 0) & ~F.col("enum_only")


def status_counts(files: DataFrame, concepts: DataFrame, cap: int) -> DataFrame:
    """``usage_counts`` and the first ``cap`` unused names of each repo."""
    names = first_names(concepts.where(_unused()), ["repo"], "name", cap, "unused_names")
    return usage_counts(files, concepts).join(names, "repo", "left").withColumn("unused_names", F.coalesce("unused_names", F.lit("")))


def status_list(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """The counts of ``status_counts`` with every unused name as a row; a repo without one has a row with a null name."""
    return usage_counts(files, concepts).join(concepts.where(_unused()).select("repo", "name"), "repo", "left")


def freshness(repos: DataFrame) -> DataFrame:
    """fresh, stale_commit, stale_worktree or unknown from the indexed and current commit."""
    same = F.col("indexed_commit") == F.col("current_commit")
    return repos.withColumn(
        "freshness",
        F.when(~same, "stale_commit").when(same & F.col("dirty"), "stale_worktree").when(same & ~F.col("dirty"), "fresh").otherwise("unknown"),
    )


def _verdicts(concepts: DataFrame) -> tuple[DataFrame, DataFrame]:
    v = concepts.select("repo", "name", F.when(F.col("uses") > 0, "ACTIVE").otherwise("DECLARED_ONLY").alias("verdict"))
    return v, v.groupBy("repo", "verdict").agg(F.count(F.lit(1)).alias("concepts"))


def verdict_buckets(concepts: DataFrame, cap: int) -> DataFrame:
    """ACTIVE and DECLARED_ONLY: count and first ``cap`` names."""
    v, counts = _verdicts(concepts)
    return counts.join(first_names(v, ["repo", "verdict"], "name", cap, "names"), ["repo", "verdict"])


def verdict_list(concepts: DataFrame) -> DataFrame:
    """The counts of ``verdict_buckets`` with every name as a row."""
    v, counts = _verdicts(concepts)
    return v.join(counts, ["repo", "verdict"]).select("repo", "verdict", "concepts", "name")


def declarations_per_dir(decls: DataFrame) -> DataFrame:
    """Declaring files per owning directory."""
    return (
        decls.select("repo", "path", owning_dir(F.col("path")).alias("dir"))
        .distinct()
        .groupBy("repo", "dir")
        .agg(F.count(F.lit(1)).alias("declaring_files"))
    )


def top_concepts(concepts: DataFrame, cap: int | None = None) -> DataFrame:
    """Concepts per repo by falling use, ties by name; the first ``cap`` if given, else all, ranked in many tasks."""
    some, order = concepts.select("repo", "name", "uses"), [F.col("uses").desc(), F.col("name")]
    if cap is None:
        return numbered_in_groups(some, ["repo"], order, "rank").withColumn("rank", F.col("rank").cast("int"))
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("rank") <= cap)


def unused_concepts(concepts: DataFrame, cap: int | None = None) -> DataFrame:
    return first_rows(concepts.where(F.col("uses") == 0).select("repo", "name"), ["repo"], [F.col("name")], cap)


def owners(targets: DataFrame, decls: DataFrame, usage: DataFrame, cap: int | None = None) -> DataFrame:
    """(repo, target, rank, dir, declarations, uses, weight, owner): only declaring dirs may own.

    Declarers are ordered by (declarations, uses); every dir weighs 2 per declaration and 1 per use.
    """
    t = targets.select("repo", F.col("target").alias("name")).distinct()
    d = decls.select("repo", "name", "path", "kind").distinct().join(t, ["repo", "name"], "left_semi")
    d = d.groupBy("repo", "name", owning_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("declarations"))
    u = usage.select("repo", "name", "path").distinct().join(t, ["repo", "name"], "left_semi")
    u = u.groupBy("repo", "name", owning_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("uses"))
    both = d.join(u, ["repo", "name", "dir"], "full").select("repo", F.col("name").alias("target"), "dir", zero("declarations"), zero("uses"))
    both = both.withColumn("weight", F.col("declarations") * 2 + F.col("uses"))
    best = F.max(F.when(F.col("declarations") > 0, F.struct("declarations", "uses"))).over(Window.partitionBy("repo", "target"))
    order = [F.col("weight").desc(), (F.col("declarations") > 0).desc(), F.col("declarations").desc(), F.col("uses").desc(), F.col("dir")]
    both = both.withColumn("lead", F.coalesce(F.struct("declarations", "uses") == best, F.lit(False)))
    first = F.min(F.when(F.col("lead"), F.col("dir"))).over(Window.partitionBy("repo", "target"))
    both = both.withColumn("owner", first)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("repo", "target").orderBy(*order)))
    if cap is not None:
        ranked = ranked.where(F.col("rank") <= cap)
    return ranked.select("repo", "target", "rank", "dir", "declarations", "uses", "weight", "owner")


def concept_bytes(decls: DataFrame, usage: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of the distinct files that declare or use each concept."""
    touch = decls.select("repo", "name", "path").unionByName(usage.select("repo", "name", "path")).distinct()
    sizes = files.groupBy("repo", "path").agg(F.max("size").alias("size"))
    return touch.join(sizes, ["repo", "path"], "left").groupBy("repo", "name").agg(F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def answer_bytes(concepts: DataFrame) -> DataFrame:
    """Size of the JSON card that answers a question about each concept."""
    card = F.to_json(
        F.struct(
            F.col("name").alias("canonical"),
            F.when(F.col("uses") > 0, "ACTIVE").otherwise("DECLARED_ONLY").alias("verdict"),
            F.coalesce("table_name", F.lit("")).alias("table"),
            F.slice("fields", 1, 15).alias("fields"),
            F.col("relations").alias("relations"),
        )
    )
    return concepts.select("repo", "name", F.octet_length(card).cast("bigint").alias("payload"))


def context_efficiency(concepts: DataFrame, decls: DataFrame, usage: DataFrame, files: DataFrame, sample: int = 10) -> DataFrame:
    """Per repo: source bytes, upper median of the bytes behind a concept, mean answer size of
    the most used concepts, and the reduction in percent (0 to 99.9, null without data)."""
    per_concept = concept_bytes(decls, usage, files)
    positive = per_concept.where(F.col("bytes") > 0)
    median = exact_rank(positive, ["repo"], "bytes", 0.5).select("repo", F.col("bytes").alias("median_bytes"))
    top = top_concepts(concepts, sample).select("repo", "name")
    means = (
        top.join(answer_bytes(concepts), ["repo", "name"])
        .join(per_concept, ["repo", "name"], "left")
        .groupBy("repo")
        .agg(F.sum("payload").alias("p"), F.sum(F.coalesce("bytes", F.lit(0))).alias("b"), F.count(F.lit(1)).alias("n"))
        .select("repo", F.expr("p div n").alias("mean_answer_bytes"), F.expr("b div n").alias("mean_top_bytes"))
    )
    source = files.groupBy("repo", "path").agg(F.max("size").alias("size")).groupBy("repo").agg(F.sum("size").alias("source_bytes"))
    out = source.join(median, "repo", "left").join(means, "repo", "left").select(
        "repo", "source_bytes", zero("median_bytes"), zero("mean_answer_bytes"), zero("mean_top_bytes")
    )
    answer = F.col("mean_answer_bytes")
    base = F.when(F.col("median_bytes") > answer, F.col("median_bytes")).when(F.col("source_bytes") > answer, F.col("source_bytes")).otherwise(0)
    cut = F.least(F.lit(99.9), F.greatest(F.lit(0.0), (1 - answer / base) * 100))
    return out.withColumn("reduction_pct", F.when((base > 0) & (answer > 0), F.round(cut, 1)))


def ambiguous_identity(symbols: DataFrame) -> DataFrame:
    """Symbols of one name and kind declared more than once in a file.

    With a ``guarded`` column, copies that are all conditional compilations are not ambiguous.
    """
    guarded = F.col("guarded") if "guarded" in symbols.columns else F.lit(False)
    return (
        symbols.groupBy("repo", "path", "name", "kind")
        .agg(F.count(F.lit(1)).alias("copies"), F.bool_and(guarded).alias("all_guarded"))
        .where((F.col("copies") > 1) & ~F.col("all_guarded"))
        .drop("all_guarded")
    )


def declared_dependents(concepts: DataFrame) -> DataFrame:
    """(repo, target, dependent): concepts whose relations name the target."""
    rel = concepts.select("repo", F.col("name").alias("dependent"), F.explode("relations").alias("target"))
    known = concepts.select("repo", F.col("name").alias("target")).distinct()
    return rel.join(known, ["repo", "target"], "left_semi").select("repo", "target", "dependent").distinct()


def invariants(decls: DataFrame, concepts: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """Quality findings: storage identity, alias targets, decision links, ghosts. ``links`` is (repo, id, link)."""
    tables = decls.where(F.col("table_name").isNotNull()).groupBy("repo", "name").agg(
        F.countDistinct(F.lower("table_name")).alias("n"), F.min("table_name").alias("a"), F.max("table_name").alias("b")
    )
    kinds = decls.groupBy("repo", "name").agg(F.bool_or(F.col("kind") != "sql").alias("orm"), F.bool_or(F.col("kind") == "sql").alias("sql"))
    one = tables.where("n > 1").join(kinds.where("orm and sql"), ["repo", "name"]).select(
        "repo", F.lit("single storage identity").alias("rule"), F.col("name").alias("subject"), F.concat_ws(", ", "a", "b").alias("detail")
    )
    names = concepts.select("repo", "name").distinct()
    alias = aliases.join(names.withColumnRenamed("name", "target"), ["repo", "target"], "left_anti").select(
        "repo", F.lit("alias resolves").alias("rule"), F.col("alias").alias("subject"), F.col("target").alias("detail")
    )
    low = names.select("repo", F.lower("name").alias("k"), F.lit(True).alias("known")).distinct()
    decision = (
        links.withColumn("k", F.lower("link"))
        .join(low, ["repo", "k"], "left")
        .groupBy("repo", "id")
        .agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("any"), F.count(F.lit(1)).alias("n"))
        .where(~F.col("any"))
        .select("repo", F.lit("decision links something known").alias("rule"), F.col("id").alias("subject"), F.concat(F.col("n").cast("string"), F.lit(" links")).alias("detail"))
    )
    ghost = names.join(decls.select("repo", "name").distinct(), ["repo", "name"], "left_anti").select(
        "repo", F.lit("concept has a declaration").alias("rule"), F.col("name").alias("subject"), F.lit("").alias("detail")
    )
    return one.unionByName(alias).unionByName(decision).unionByName(ghost)


def query_audit(log: DataFrame, threshold: int = 2, keep_first: int | None = None) -> DataFrame:
    """Repeated statements per (repo, fingerprint) that look like one query per row.

    Suspicious with many distinct bind keys and executions, or with very many executions.
    ``keep_first`` looks at the first N statements of each operation only, as a bounded recorder does.
    """
    from factloom.functions.text import sql_fingerprint

    t = max(2, threshold)
    if keep_first is not None:
        log = first_rows(log, ["repo", "op_id"], [F.col("seq")], keep_first)
    groups = log.groupBy("repo", sql_fingerprint(F.col("sql")).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("executions"),
        F.countDistinct("bind_key").alias("bind_keys"),
        F.sum("elapsed_us").alias("elapsed_us"),
        F.min_by("sql", F.struct("op_id", "seq")).alias("example_sql"),
    )
    n = F.col("executions")
    return groups.withColumn("suspicious", ((F.col("bind_keys") >= t) & (n >= t)) | (n >= 4 * t))
