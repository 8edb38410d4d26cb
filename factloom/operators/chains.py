"""Follow ``node -> next`` pointers to their end, with cycle detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut_lineage


def resolve_chains(edges: DataFrame) -> DataFrame:
    """(repo, node, root, cycle) for a table with one ``next`` per (repo, node).

    Pointer jumping: every round doubles the reach, so n chains end after log2(n) rounds.
    Rows that still point at a node with a successor after that many rounds are in, or lead
    into, a cycle.
    """
    active = cut_lineage(edges.select("repo", "node", F.col("next").alias("root")))
    rounds = max(1, active.count()).bit_length() + 1
    done = None
    for _ in range(rounds):
        # Ended rows stay on the looked-up side: who points at one takes its root and ends too.
        seen = active.withColumn("ended", F.lit(False))
        if done is not None:
            seen = seen.unionByName(done.withColumn("ended", F.lit(True)))
        seen = seen.select("repo", F.col("node").alias("root"), F.col("root").alias("beyond"), "ended")
        hop = cut_lineage(
            active.join(seen, ["repo", "root"], "left").select(
                "repo", "node", F.coalesce("beyond", "root").alias("root"), F.coalesce("ended", F.lit(True)).alias("ended")
            )
        )
        finished = hop.where("ended").select("repo", "node", "root")
        done = finished if done is None else done.unionByName(finished)
        active = hop.where("not ended").select("repo", "node", "root")
        if active.isEmpty():
            break
    stuck = active.select("repo", "node", F.lit(None).cast("string").alias("root"), F.lit(True).alias("cycle"))
    return done.withColumn("cycle", F.lit(False)).unionByName(stuck)
