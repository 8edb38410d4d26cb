"""Exact order statistics, places within groups and first names: no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import cut_lineage

DIGIT_BITS = 12


def first_names(df: DataFrame, group: list[str], name: str, cap: int, out: str) -> DataFrame:
    """First ``cap`` distinct names per group, joined. Spark cuts each group before its shuffle."""
    top = df.select(*group, name).distinct()
    top = top.withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy(name))).where(F.col("n") <= cap)
    return top.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias(out))


def numbered_in_groups(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Adds the 1-based place of each row within its group in ``order``; a large group is numbered in many tasks.

    Rows are dealt by ranges of group and order, numbered inside each range, and moved on by what earlier ranges hold of the group.
    """
    n, names = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns
    dealt = cut_lineage(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    earlier = Window.partitionBy(*[f"_{g}" for g in group]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(F.col("_part").alias("_at"), *[F.col(g).alias(f"_{g}") for g in group]).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    same = F.col("_part") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return inside.join(sizes, same).select(*names, (F.col("_n") + F.col("_before")).cast("bigint").alias(out))


def kth_smallest(df: DataFrame, group: list[str], value: str, kth: Column, max_value: int) -> DataFrame:
    """(group, n, value): the element at 0-based rank ``kth`` (an expression over ``n``) per group.

    Radix selection: per round one digit of 12 bits is counted, at most 4096 counters per
    group, so a group holding a third of all rows is reduced by map-side partial
    aggregation and is never sorted. Values are non-negative integers up to ``max_value``.
    """
    rounds = max(1, -(-max(1, max_value.bit_length()) // DIGIT_BITS))
    rows = df.groupBy(*group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    state = rows.groupBy(*group).agg(F.sum("c").alias("n")).withColumn("k", kth).withColumn("prefix", F.lit(0).cast("bigint"))
    run = Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for r in range(rounds):
        low = DIGIT_BITS * (rounds - 1 - r)
        live = rows.join(state, group).where(F.shiftright("v", low + DIGIT_BITS) == F.col("prefix"))
        digit = F.shiftright("v", low).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        counts = live.groupBy(*group, "n", "k", "prefix", digit.alias("digit")).agg(F.sum("c").alias("c"))
        counts = counts.withColumn("upto", F.sum("c").over(run)).withColumn("before", F.col("upto") - F.col("c"))
        hit = counts.where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("upto")))
        state = hit.select(
            *group, "n", (F.col("k") - F.col("before")).alias("k"), (F.col("prefix") * (1 << DIGIT_BITS) + F.col("digit")).alias("prefix")
        )
    return state.select(*group, "n", F.col("prefix").alias(value))


def exact_rank(df: DataFrame, group: list[str], value: str, share: float, accuracy: int = 1000) -> DataFrame:
    """(group, n, value): the element at 0-based rank ``floor(share * n)`` per group, in one pass after a sketch.

    Spark's own quantile sketch, whose rank error is at most ``n / accuracy``, brackets the element; values inside the bracket are counted
    exactly, those below it only as a number, and values above it are dropped by each task. No value goes to the driver.
    """
    margin = 4 / accuracy
    ends = F.percentile_approx(value, F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))), F.lit(accuracy))
    sketch = df.groupBy(*group).agg(F.count(value).alias("n"), ends.alias("b")).select(*group, "n", F.floor(F.col("n") * share).alias("k"), F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    near = df.select(*group, value).join(sketch, group).where(F.col(value) <= F.col("high"))
    # what lies below the bracket is one row
    held = near.withColumn(value, F.when(F.col(value) >= F.col("low"), F.col(value))).groupBy(*group, "n", "k", value).agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("upto", F.sum("c").over(run))
    return held.where((F.col("upto") > F.col("k")) & F.col(value).isNotNull()).groupBy(*group, "n").agg(F.min(value).alias(value))
