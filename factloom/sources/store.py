"""Parquet tables of the catalog and the history.

Folders are named by digests, so no reader guesses a type from a folder's name and every column comes back as
it was written. A write names what it writes - a batch, a version, the keys of its rows - and replaces just that, so
a job that is run again leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.history import archive_split

FOLDER, BATCH = "p_key", "p_batch"


def _digest(*values: Column) -> Column:
    """A folder name for a tuple of values; null is a value of its own."""
    return F.concat(F.lit("k"), F.md5(F.to_json(F.struct(*[v.cast("string").alias(f"c{k}") for k, v in enumerate(values)]), {"ignoreNullFields": "false"})))


def _replace(df: DataFrame, path: str, *folders: str) -> None:
    """Write ``df`` over the folders it has rows for. Partitions are rebalanced by size: a large key gets many files, small keys share tasks."""
    df.hint("rebalance", *[F.col(c) for c in folders]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def append_events(events: DataFrame, path: str, batch: str) -> None:
    """Add one batch of events to the timeline, or replace it: the same batch again leaves the same rows."""
    _replace(events.withColumn(BATCH, _digest(F.lit(batch))).withColumn(FOLDER, _digest(F.col("repo"))), path, BATCH, FOLDER)


def read_events(spark: SparkSession, path: str, repo: str | None = None, batch: str | None = None) -> DataFrame:
    """The timeline; a repo or batch prunes folders."""
    df = spark.read.parquet(path)
    if batch is not None:
        df = df.where(F.col(BATCH) == _digest(F.lit(batch)))
    if repo is not None:
        df = df.where((F.col(FOLDER) == _digest(F.lit(repo))) & (F.col("repo") == repo))
    return df.drop(BATCH, FOLDER)


def save_table(df: DataFrame, path: str, by: tuple[str, ...] = ("repo",)) -> None:
    """Replace only the rows of the keys present in ``df``."""
    _replace(df.withColumn(FOLDER, _digest(*[F.col(c) for c in by])), path, FOLDER)


def load_table(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """A table saved by repo; a repo prunes folders."""
    df = spark.read.parquet(path)
    return (df if repo is None else df.where((F.col(FOLDER) == _digest(F.lit(repo))) & (F.col("repo") == repo))).drop(FOLDER)


def archive_events(spark: SparkSession, live: str, archive: str, kept: str, cutoff_ms: int) -> tuple[int, int]:
    """Write the archived events to ``archive`` and the rest to ``kept``; what is read back must add up."""
    events, batch = read_events(spark, live), f"archive-{cutoff_ms}"
    stay, leave = archive_split(events, cutoff_ms)
    append_events(leave, archive, batch)
    append_events(stay, kept, batch)
    counts = []
    for path, part in ((kept, stay), (archive, leave)):
        counts.append(0 if part.isEmpty() else read_events(spark, path, batch=batch).count())
    if sum(counts) != events.count():
        raise RuntimeError("archive split lost events")
    return counts[0], counts[1]


def append_snapshot(snapshot: DataFrame, path: str) -> None:
    """Write catalog versions, each over itself; the version is a folder, so as-of reads can prune."""
    snapshot.hint("rebalance", F.col("version")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)
