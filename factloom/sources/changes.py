"""Change sets between two file snapshots, added diff lines, and which files to re-extract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.order_stats import numbered_in_groups


def _pair(gone: DataFrame, came: DataFrame, key: list[str], heaps: bool) -> DataFrame:
    """The n-th path that went with the n-th that came, of each key; where ``heaps`` may share a key they are numbered in many tasks."""
    if heaps:
        left, right = numbered_in_groups(gone, key, [F.col("old_path")], "n"), numbered_in_groups(came, key, [F.col("path")], "n")
    else:
        w = lambda p: Window.partitionBy(*key).orderBy(p)
        left, right = gone.withColumn("n", F.row_number().over(w("old_path"))), came.withColumn("n", F.row_number().over(w("path")))
    return left.join(right, [*key, "n"]).select("repo", "old_path", "path")


def changed_files(before: DataFrame, after: DataFrame, untracked: DataFrame | None = None) -> DataFrame:
    """(repo, status, path, old_path) with A, M, D, R (and ?? for untracked paths).

    Snapshots are (repo, path, content_hash). A removed and an added path of equal content are
    a rename: paths with the same last three segments pair up first, then the rest in path
    order, so a heap of equal files moved together does not end in one group.
    """
    b = before.select("repo", "path", F.col("content_hash").alias("old_hash"))
    a = after.select("repo", "path", F.col("content_hash").alias("new_hash"))
    both = b.join(a, ["repo", "path"], "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    tail = lambda p: F.array_join(F.slice(F.split(p, "/"), F.greatest(F.size(F.split(p, "/")) - 2, F.lit(1)), F.lit(3)), "/")
    gone = both.where(F.col("new_hash").isNull()).select("repo", F.col("path").alias("old_path"), F.col("old_hash").alias("hash"), tail("path").alias("tail"))
    came = both.where(F.col("old_hash").isNull()).select("repo", "path", F.col("new_hash").alias("hash"), tail("path").alias("tail"))
    near = _pair(gone, came, ["repo", "hash", "tail"], False)
    rest_gone = gone.join(near, ["repo", "old_path"], "left_anti").drop("tail")
    rest_came = came.join(near, ["repo", "path"], "left_anti").drop("tail")
    moved = near.unionByName(_pair(rest_gone, rest_came, ["repo", "hash"], True))
    row = lambda df, status, path, old: df.select("repo", F.lit(status).alias("status"), F.col(path).alias("path"), (F.col(old) if old else F.lit(None).cast("string")).alias("old_path"))
    out = (
        row(moved, "R", "path", "old_path")
        .unionByName(row(came.join(moved, ["repo", "path"], "left_anti"), "A", "path", None))
        .unionByName(row(gone.join(moved, ["repo", "old_path"], "left_anti"), "D", "old_path", None))
        .unionByName(row(both.where(F.col("old_hash").isNotNull() & F.col("new_hash").isNotNull()), "M", "path", None))
    )
    if untracked is not None:
        fresh = untracked.select("repo", "path").distinct().join(out.select("repo", "path"), ["repo", "path"], "left_anti")
        out = out.unionByName(row(fresh, "??", "path", None))
    return out


def added_lines(diffs: DataFrame) -> DataFrame:
    """(repo, id, line, text): lines a unified diff adds, in order. ``diffs`` is (repo, id, diff)."""
    lines = diffs.select("repo", "id", F.posexplode(F.split("diff", "\n")).alias("line", "raw"))
    hit = F.startswith("raw", F.lit("+")) & ~F.startswith("raw", F.lit("+++"))
    return lines.where(hit).select("repo", "id", "line", F.substr("raw", F.lit(2)).alias("text"))


def added_text(diffs: DataFrame) -> DataFrame:
    """(repo, id, text): the added lines of each diff joined again; one row per diff, no shuffle."""
    kept = F.filter(F.split("diff", "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++")))
    return diffs.select("repo", "id", F.array_join(F.transform(kept, lambda x: F.substr(x, F.lit(2))), "\n").alias("text"))


def stale_facts(files: DataFrame, facts: DataFrame, version: int) -> DataFrame:
    """Files whose (size, mtime) or extractor version has no stored facts: the ones to extract again."""
    stored = facts.where(F.col("extractor_version") == version).select("repo", "path", "size", "mtime_ms").distinct()
    return files.join(stored, ["repo", "path", "size", "mtime_ms"], "left_anti")


def kept_facts(facts: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """Stored facts that are still valid: their file is unchanged and present."""
    same = files.select("repo", "path", "size", "mtime_ms")
    return facts.where(F.col("extractor_version") == version).join(same, ["repo", "path", "size", "mtime_ms"], "left_semi")
