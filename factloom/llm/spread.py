"""Spark helpers of this subpackage: global order offsets, fixed-size tables and connected components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import cut_lineage

CHUNK = 1 << 12


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns renamed c0, c1, ...: no name of the caller's meets one of ours, not even in another case."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def column(df: DataFrame, name: str) -> str:
    """The name that ``numbered`` gives the first column called exactly ``name``."""
    return f"c{df.columns.index(name)}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns called exactly so."""
    return numbered(df).select(*[F.col(column(df, n)).alias(n) for n in names])


def fixed_table(rows: DataFrame, kind: str = "int32") -> dict[int, np.ndarray]:
    """The tables that tasks emitted as ``table_rows``, brought together cell by cell on the driver.

    Counts (int32) are added up to 2**31 - 1, bits (uint8) united. The result has as many cells as one
    task's table, whatever the input, so it may be broadcast. Chunks are combined where they land.
    """

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(cells.as_buffer(), kind)
                if chunk not in found:
                    found[chunk] = more.copy()
                elif kind == "uint8":
                    found[chunk] |= more
                else:
                    found[chunk] = np.minimum(found[chunk].astype(np.int64) + more, 2**31 - 1).astype(np.int32)
        for chunk, cells in found.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "cells": pa.array([cells.tobytes()], pa.binary())})

    spark = rows.sparkSession
    united = rows.select("chunk", "cells").repartition(min(partitions(spark), 64), "chunk").mapInArrow(unite, "chunk int, cells binary")
    return {r.chunk: np.frombuffer(bytes(r.cells), kind) for r in united.collect()}


def whole_table(chunks: dict[int, np.ndarray], cells: int, kind: str) -> np.ndarray:
    table = np.zeros(cells, kind)
    for chunk, found in chunks.items():
        table[chunk * CHUNK : (chunk + 1) * CHUNK] = found
    return table


def table_rows(cells: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The chunks of a task's table that are not all zero, as (chunk, cells) rows."""
    parts = cells.reshape(-1, CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    return used.tolist(), [parts[k].tobytes() for k in used]


def bit_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` places (a power of two) where the hashes in the first column fall: it never misses one."""
    places = np.uint64(bits - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(bits, bool)
        for batch in batches:
            table[batch.column(0).to_numpy().view(np.uint64) & places] = True
        chunks, cells = table_rows(np.packbits(table))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunks, pa.int32()), "cells": pa.array(cells, pa.binary())})

    return whole_table(fixed_table(keys.mapInArrow(mark, "chunk int, cells binary"), "uint8"), bits // 8, "uint8")


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(table) * 8 - 1)
    return (table[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1


def in_order(df: DataFrame, keys: list[Column], n: int) -> DataFrame:
    """Rows range-partitioned and sorted by ``keys`` (nulls last) with their partition number in ``_part``."""
    by = [k.asc_nulls_last() for k in keys]
    return df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())


def starts_of(parts: DataFrame, key: str, size: str) -> DataFrame:
    """For each row of a small table of partitions or files: the sum of ``size`` of those before it by ``key``."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``root``: the smallest node reachable from each node of an undirected edge table.

    Alternates large-star and small-star steps, each a grouped minimum and a join that AQE may
    split; every round is written to the checkpoint folder. Ends when the edges no longer change.
    """
    pairs = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pairs.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(lower, "u")
        small = step.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lower.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        pairs = cut_lineage(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def map_slices(f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], text: str = "text") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that sees a bounded run of rows at a time."""
    from factloom.llm.text import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield from f(part)

    return run


@lru_cache(maxsize=1)
def _package() -> str:
    """This library as a zip in the driver's own folder, from where Spark hands it to the executors."""
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    return str(path)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this library where it is not installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_ships_" + Path(_package()).stem, False):
        sc.addPyFile(_package())
        setattr(sc, "_ships_" + Path(_package()).stem, True)
    return spark
