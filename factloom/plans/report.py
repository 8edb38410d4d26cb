"""Reports that compose the catalog: gaps, deltas, tour, glance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.policy import STRUCTURED
from factloom.operators.order_stats import first_names
from factloom.operators.summary import top_concepts, unused_concepts, zero

# Evidence tiers an area can never give.
NEVER_PRODUCED = (
    ("git", "Observed"),
    ("documents", "Explicit"), ("documents", "Inferred"),
    ("photos", "Explicit"), ("photos", "Inferred"),
    ("messages", "Explicit"), ("messages", "Inferred"),
)


def gap_register(concepts: DataFrame, blind: DataFrame, settings: DataFrame) -> DataFrame:
    """(repo, kind, domain, amount, why, remedy): everything an answer may silently miss.

    ``settings`` is (repo, domain, enabled, source, confirmed), as resolved by layered
    settings; ``blind`` is (repo, path, ext).
    """
    s = settings.withColumn("structured", F.col("domain").isin(*STRUCTURED))
    explicit = F.col("source").endswith("-config")
    on = F.col("enabled") | (~F.col("structured") & ~explicit & F.coalesce("confirmed", F.lit(False)))
    s = s.withColumn("on", on)
    waits = ~F.col("structured") & ~explicit & F.col("confirmed").isNull()

    def gaps(df, kind, domain, amount, why, remedy):
        return df.select(
            "repo", F.lit(kind).alias("kind"), domain.alias("domain"), amount.cast("bigint").alias("amount"),
            F.lit(why).alias("why"), F.lit(remedy).alias("remedy"),
        )

    one, none = F.lit(1), F.lit("")
    never = s.where("on").withColumn(
        "tier", F.explode(F.filter(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(t).alias("t")) for d, t in NEVER_PRODUCED]), lambda x: x["d"] == F.col("domain")))
    )
    unused = concepts.where((F.col("uses") == 0) & ~F.col("enum_only")).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    unread = blind.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return (
        gaps(unread, "unsupported_language", none, F.col("n"), "no extractor reads these files", "read them or add rules")
        .unionByName(gaps(never, "tier_not_producible", F.concat_ws(":", "domain", "tier.t"), one, "this area cannot give this tier", "observe it by hand"))
        .unionByName(gaps(s.where(~F.col("on") & waits), "unstructured_domain_unconfirmed", F.col("domain"), one, "never confirmed, never looked at", "confirm or enable it"))
        .unionByName(gaps(s.where(~F.col("on") & ~waits), "domain_disabled", F.col("domain"), one, "switched off, never looked at", "enable it"))
        .unionByName(gaps(unused, "usage_unobserved", none, F.col("n"), "declared, no access seen", "look for an access style no rule sees"))
    )


def register_known(concepts: DataFrame, files: DataFrame, settings: DataFrame) -> DataFrame:
    """Per repo: files, concepts, used concepts, enabled areas, newest verification."""
    seen = F.max("last_verified_ms") if "last_verified_ms" in concepts.columns else F.lit(None).cast("bigint")
    c = concepts.groupBy("repo").agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("uses") > 0).alias("used"), seen.alias("as_of_ms"))
    f = files.groupBy("repo").agg(F.countDistinct("path").alias("files"))
    d = settings.where("enabled").groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"))
    return c.join(f, "repo", "left").join(d, "repo", "left").select("repo", zero("files"), "concepts", "used", F.coalesce("domains", F.lit("")).alias("domains"), "as_of_ms")


def register_delta(before: DataFrame, after: DataFrame, gaps_before: DataFrame, gaps_after: DataFrame) -> DataFrame:
    """(repo, what, item, delta): count deltas and gap pairs that appeared or were resolved."""
    counts = before.select("repo", F.lit(-1).alias("sign"), "files", "concepts", "used").unionByName(
        after.select("repo", F.lit(1).alias("sign"), "files", "concepts", "used")
    )
    cols = ("files", "concepts", "used")
    sums = counts.groupBy("repo").agg(*[F.sum(F.col("sign") * F.col(c)).cast("bigint").alias(c) for c in cols])
    deltas = sums.select(
        "repo", F.explode(F.array(*[F.struct(F.lit("count").alias("what"), F.lit(c).alias("item"), F.col(c).alias("delta")) for c in cols])).alias("d")
    ).select("repo", "d.*")
    pair = lambda g, n: g.select("repo", F.concat_ws(":", "kind", "domain").alias("item")).distinct().withColumn("n", F.lit(n))
    net = pair(gaps_after, 1).unionByName(pair(gaps_before, -1)).groupBy("repo", "item").agg(F.sum("n").cast("bigint").alias("delta")).where("delta <> 0")
    changed = net.select("repo", F.when(F.col("delta") > 0, "gap_present").otherwise("gap_resolved").alias("what"), "item", "delta")
    return deltas.unionByName(changed)


def tour(concepts: DataFrame, aliases: DataFrame, decisions: DataFrame, important: int | None = 8, ignorable: int | None = 10) -> DataFrame:
    """(repo, section, position, text): what to know first. ``decisions`` has rejected as an array; None for all of a section."""
    important = top_concepts(concepts, important).select("repo", F.lit("important").alias("section"), F.col("rank").alias("position"), F.col("name").alias("text"))
    ignorable = unused_concepts(concepts, ignorable).select("repo", F.lit("ignorable").alias("section"), F.lit(0).alias("position"), F.col("name").alias("text"))
    by_alias = aliases.select("repo", F.lit("mistake").alias("section"), F.lit(0).alias("position"), F.concat(F.col("alias"), F.lit(" is "), F.col("target")).alias("text"))
    rejected = decisions.select(
        "repo", F.lit("mistake").alias("section"), F.lit(1).alias("position"), "id", F.explode("rejected").alias("r")
    ).select("repo", "section", "position", F.concat(F.col("r"), F.lit(" was rejected by "), F.col("id")).alias("text"))
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    minutes = decisions.groupBy("repo").agg(F.sum(words("decision") + words("because")).alias("w")).select(
        "repo", F.lit("reading_minutes").alias("section"), F.lit(0).alias("position"), F.greatest(F.expr("w div 200"), F.lit(1)).cast("string").alias("text")
    )
    return important.unionByName(ignorable).unionByName(by_alias).unionByName(rejected).unionByName(minutes)


def glance(
    concepts: DataFrame, duplicates: DataFrame, stale: DataFrame, decisions: DataFrame, families: DataFrame, events: DataFrame, recent: int = 5, undecided: int = 5
) -> DataFrame:
    """One row per repo: counts, names with a near duplicate of the other storage kind (``duplicates`` is the linear relation), stale aliases, families without a decision, newest changes."""
    from factloom.operators.duplicates import names_needing_alias
    from factloom.operators.history import newest_per_repo

    n = F.count(F.lit(1))
    base = concepts.groupBy("repo").agg(n.alias("concepts"))
    parts = (
        names_needing_alias(duplicates).groupBy("repo").agg(n.alias("needs_alias")),
        stale.groupBy("repo").agg(n.alias("stale_aliases")),
        decisions.groupBy("repo").agg(F.countDistinct("id").alias("decisions")),
        families.groupBy("repo").agg(n.alias("families")),
    )
    out = base
    for p in parts:
        out = out.join(p, "repo", "left")
    last = newest_per_repo(events, recent).groupBy("repo").agg(n.alias("recent_changes"), F.max("ts_ms").alias("last_change_ms"))
    suggest = first_names(families, ["repo"], "token", undecided, "undecided_families")
    out = out.join(last, "repo", "left").join(suggest, "repo", "left")
    counts = ("needs_alias", "stale_aliases", "decisions", "families", "recent_changes")
    return out.select("repo", "concepts", *[zero(c) for c in counts], "last_change_ms", F.coalesce("undecided_families", F.lit("")).alias("undecided_families"))
