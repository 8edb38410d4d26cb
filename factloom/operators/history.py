"""Timeline, archive, digests, versions and as-of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import joined_capped, plural
from factloom.functions.words import names_concept
from factloom.operators.order_stats import numbered_in_groups
from factloom.operators.ranking import first_rows

# Kinds that never leave the live history.
PROTECTED_KINDS = ("decision_added", "decision_removed", "alias_introduced", "alias_removed", "stale_alias")


def _newest() -> list[Column]:
    return [F.col("ts_ms").desc(), F.col("id").desc()]


def timeline(events: DataFrame, want: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; ``want`` keeps events of concepts it names. The filter comes before the limit."""
    if want is not None:
        hit = names_concept(F.col("concept"), F.lit(want)) | (F.lower("concept") == want.lower())
        events = events.where(hit)
    ordered = events.orderBy(*_newest())
    return ordered if limit is None else ordered.limit(limit)


def newest_per_repo(events: DataFrame, limit: int) -> DataFrame:
    return first_rows(events, ["repo"], _newest(), limit)


def archive_split(events: DataFrame, cutoff_ms: int) -> tuple[DataFrame, DataFrame]:
    """(live, archived): old events of unprotected kinds leave, everything else stays, also what has no kind or time."""
    leaves = F.coalesce((F.col("ts_ms") < cutoff_ms) & ~F.col("kind").isin(*PROTECTED_KINDS), F.lit(False))
    return events.where(~leaves), events.where(leaves)


def full_history(live: DataFrame, archived: DataFrame) -> DataFrame:
    return live.withColumn("archived", F.lit(False)).unionByName(archived.withColumn("archived", F.lit(True)))


def history_list(events: DataFrame) -> DataFrame:
    """(repo, kind, events, oldest_ms, newest_ms, position, concept): every event's name under its kind, newest first, numbered in many tasks."""
    spans = events.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("oldest_ms"), F.max("ts_ms").alias("newest_ms"))
    placed = numbered_in_groups(events.select("repo", "kind", "ts_ms", "id", "concept"), ["repo", "kind"], _newest(), "position")
    return placed.join(spans, ["repo", "kind"]).select("repo", "kind", "events", "oldest_ms", "newest_ms", "position", "concept")


def history_digest(events: DataFrame, cap: int, limit: int | None = None) -> DataFrame:
    """Events per repo, the newest ``limit`` if given, as one row per kind: count, time span and a sentence with the first ``cap`` names."""
    recent = newest_per_repo(events, limit)
    by_kind = Window.partitionBy("repo", "kind").orderBy(*_newest())
    # only the first names are numbered: Spark cuts each kind before its shuffle
    top = recent.select("repo", "kind", "concept", *("ts_ms", "id")).withColumn("n", F.row_number().over(by_kind)).where(F.col("n") <= cap)
    names = top.groupBy("repo", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col("concept").alias("c")))), lambda s: s["c"]).alias("names"))
    g = recent.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("events"), F.min("ts_ms").alias("oldest_ms"), F.max("ts_ms").alias("newest_ms")).join(names, ["repo", "kind"])
    n = F.col("events")
    listed = joined_capped(F.col("names"), n, cap)
    say = lambda noun, what, suffix="s": F.concat(n.cast("string"), F.lit(" "), plural(n, noun, suffix), F.lit(f" {what}: "), listed)
    sentence = (
        F.when(F.col("kind").isin("ci_passed", "ci_blocked"), F.concat(F.lit("gate "), F.substr("kind", F.lit(4)), F.lit(" "), n.cast("string"), F.lit(" "), plural(n, "time")))
        .when(F.col("kind") == "concept_appeared", say("concept", "appeared"))
        .when(F.col("kind") == "concept_renamed", say("concept", "renamed"))
        .when(F.col("kind") == "duplicate_concept_risk", say("duplicate risk", "seen"))
        .when(F.col("kind") == "concept_lost_storage", say("concept", "without storage"))
        .when(F.col("kind") == "alias_introduced", say("alias", "introduced", "es"))
        .when(F.col("kind") == "alias_removed", say("alias", "removed", "es"))
        .when(F.col("kind") == "decision_added", say("decision", "recorded"))
        .when(F.col("kind") == "decision_removed", say("decision", "deleted"))
        .when(F.col("kind") == "stale_alias", say("alias", "pointing nowhere", "es"))
        .when(F.col("kind") == "architecture_version", F.concat(F.lit("catalog version "), F.element_at("names", 1)))
        .otherwise(say("event", "of another kind"))
    )
    return g.select("repo", "kind", "events", "oldest_ms", "newest_ms", sentence.alias("sentence"))


def register_repos(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert: first_registered_ms stays, last_seen_ms and the newest name move on."""
    rows = known.select("root", "name", "first_registered_ms", "last_seen_ms").unionByName(
        seen.select("root", "name", F.col("seen_ms").alias("first_registered_ms"), F.col("seen_ms").alias("last_seen_ms"))
    )
    return rows.groupBy("root").agg(
        F.max_by("name", F.struct("last_seen_ms", "name")).alias("name"),
        F.min("first_registered_ms").alias("first_registered_ms"),
        F.max("last_seen_ms").alias("last_seen_ms"),
    )


def newest_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy(F.col("last_seen_ms").desc(), F.col("root"))


def concept_snapshot(concepts: DataFrame, version: Column, ts_ms: Column) -> DataFrame:
    """The catalog as snapshot rows of one version, ready to append."""
    return concepts.select(
        "repo",
        version.alias("version"),
        ts_ms.alias("ts_ms"),
        F.col("name").alias("concept"),
        F.when(F.col("uses") > 0, "ACTIVE").otherwise("DECLARED_ONLY").alias("verdict"),
        "table_name",
        F.to_json("fields").alias("fields"),
        F.coalesce(F.col("first_seen_ms"), ts_ms).alias("first_seen_ms") if "first_seen_ms" in concepts.columns else ts_ms.alias("first_seen_ms"),
    )


def as_of(requests: DataFrame, snapshots: DataFrame, width: int = 1024) -> DataFrame:
    """Latest snapshot at or before each requested version, null when there is none.

    ``requests`` is (repo, concept, version). Versions are cut into buckets of ``width``:
    inside a bucket a running "last" answers, and what a bucket hands on is one row, carried
    over buckets in a second, short window. A concept with a third of all rows is spread
    over its buckets, and requests are never paired with all older snapshots.
    """
    keys = ["repo", "concept"]
    cols = [c for c in snapshots.columns if c not in keys]
    bucket = F.floor(F.col("version") / width).alias("bucket")
    snap = snapshots.select(*keys, bucket, F.col("version").alias("v"), F.struct("version", *[c for c in cols if c != "version"]).alias("s"))
    ask = requests.select(*keys, "version").distinct().select(*keys, bucket, F.col("version").alias("v"))
    last = snap.groupBy(*keys, "bucket").agg(F.max_by("s", "v").alias("s"))
    every = last.unionByName(ask.select(*keys, "bucket").distinct(), allowMissingColumns=True)
    every = every.groupBy(*keys, "bucket").agg(F.first("s", ignorenulls=True).alias("s"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select(*keys, "bucket", F.last("s", ignorenulls=True).over(before).alias("carry"))
    rows = snap.select(*keys, "bucket", "v", "s", F.lit(0).alias("asked")).unionByName(
        ask.select(*keys, "bucket", "v", F.lit(1).alias("asked")), allowMissingColumns=True
    )
    upto = Window.partitionBy(*keys, "bucket").orderBy("v", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("found", F.last("s", ignorenulls=True).over(upto)).where(F.col("asked") == 1)
    out = filled.join(carry, [*keys, "bucket"], "left").withColumn("found", F.coalesce("found", "carry"))
    return out.select(
        *keys,
        F.col("v").alias("requested_version"),
        F.col("found.version").alias("snapshot_version"),
        F.coalesce(F.col("found.version") == F.col("v"), F.lit(False)).alias("exact"),
        *[F.col(f"found.{c}").alias(c) for c in cols if c != "version"],
    )


def set_signature(col: Column) -> list[Column]:
    """Two commutative sums over 48-bit digests: equal sets, equal sums, no gathering."""
    d = F.sha2(col, 256)
    part = lambda at: F.sum(F.conv(F.substring(d, at, 12), 16, 10).cast("decimal(38,0)"))
    return [part(1).alias("sig_a"), part(13).alias("sig_b"), F.count(F.lit(1)).alias("concepts")]


def architecture_versions(members: DataFrame) -> DataFrame:
    """(repo, snap, version, changed, concepts) from (repo, snap, concept) sets.

    The version grows by one whenever the concept set differs from the snapshot before.
    """
    sig = members.distinct().groupBy("repo", "snap").agg(*set_signature(F.col("concept")))
    w = Window.partitionBy("repo").orderBy("snap")
    same = (
        (F.lag("sig_a").over(w) == F.col("sig_a")) & (F.lag("sig_b").over(w) == F.col("sig_b")) & (F.lag("concepts").over(w) == F.col("concepts"))
    )
    out = sig.withColumn("changed", ~F.coalesce(same, F.lit(False)))
    return out.select(
        "repo", "snap", F.sum(F.col("changed").cast("bigint")).over(w).alias("version"), "changed", "concepts"
    )


def set_changes(members: DataFrame) -> DataFrame:
    """(repo, snap, concept, change): concepts added to or removed from the previous snapshot."""
    m = members.select("repo", "snap", "concept").distinct()
    snaps = m.select("repo", "snap").distinct()
    steps = snaps.withColumn("prev", F.lag("snap").over(Window.partitionBy("repo").orderBy("snap"))).where(F.col("prev").isNotNull())
    now = m.join(steps, ["repo", "snap"]).withColumn("side", F.lit(1))
    before = m.withColumnRenamed("snap", "prev").join(steps, ["repo", "prev"]).withColumn("side", F.lit(-1))
    both = now.select("repo", "snap", "concept", "side").unionByName(before.select("repo", "snap", "concept", "side"))
    net = both.groupBy("repo", "snap", "concept").agg(F.sum("side").alias("net")).where(F.col("net") != 0)
    return net.select("repo", "snap", "concept", F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"))


def key_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys added and removed between two tables, in one aggregation."""
    both = new.select(*keys).distinct().withColumn("side", F.lit(1)).unionByName(old.select(*keys).distinct().withColumn("side", F.lit(-1)))
    net = both.groupBy(*keys).agg(F.sum("side").alias("net")).where(F.col("net") != 0)
    return net.select(*keys, F.when(F.col("net") > 0, "added").otherwise("removed").alias("change"))
