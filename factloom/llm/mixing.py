"""Mixing sources to target weights by the cube method.

Every document of a source is taken ``floor(r)`` times for sure and once more with probability ``r - floor(r)``,
r being the source's target over its size. The flight phase moves the probabilities of three undecided
documents along the null space of the two balancing constraints (documents and words of the source) until one
is 0 or 1. It runs over blocks of a source, then over what the blocks left, until at most two documents
a source are undecided; those land, with the last few decided ones, where the words come nearest to the target.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.spread import column, in_order, numbered, partitions, pick, starts_of
from factloom.session import cut_lineage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 1_000
FAN_IN = 5_000
#: Units decided last that the landing may still trade, and units that a block leaves untouched for the next round.
LANDING, RESERVE = 64, 16
SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``n``, ``src``, ``target`` from ``source``, ``size``.

    Sources in code point order, null last, have the weights in turn and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size; the excess goes to the others by weight. Each round
    is one aggregate over the table of sources, which stays distributed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    ranged = cut_lineage(in_order(per, [F.col("source")], min(partitions(sizes.sparkSession), 32)))
    before = starts_of(ranged.groupBy("_part").agg(F.count("*").alias("k")), "_part", "k").select("_part", "_before")
    at = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranged.join(F.broadcast(before), "_part").withColumn("src", at.cast("long")).withColumn("weight", each).withColumn("cap", most * F.col("source_size")).drop("_part", "_before"))
    total = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("cap")
        held, weight, n = table.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if not weight or n == capped:
            break
        level, capped = (total - held) / weight, n
    return table.withColumn("target", F.when(F.col("weight") * level >= F.col("cap"), F.col("cap")).otherwise(F.col("weight") * level)).drop("cap", "weight")


def _unit(key: int, salt: int) -> float:
    x = (key ^ (salt * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) / 2**64


class Flight:
    """Flight phase of one block: at most three undecided units are held."""

    def __init__(self, salt: int):
        self.salt, self.held = salt, []

    def add(self, row: tuple, size: int, chance: float, key: int) -> Iterator[tuple[tuple, float]]:
        """Takes one unit; gives the units that this decides, with 0 or 1."""
        if chance <= 0.0 or chance >= 1.0:
            yield row, chance
            return
        self.held.append([size, chance, key, row])
        if len(self.held) == 3:
            yield from self._move()

    def end(self) -> Iterator[tuple[tuple, float]]:
        """Two units of one size still trade; what stays undecided is left in ``held``."""
        while len(self.held) == 2 and self.held[0][0] == self.held[1][0]:
            yield from self._move()

    def _move(self) -> Iterator[tuple[tuple, float]]:
        s = [h[0] for h in self.held]
        u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]] if len(s) == 3 else [1, -1]
        if not any(u):
            u = [1, -1, 0]
        p = [h[1] for h in self.held]
        up = min((1 - a) / b if b > 0 else a / -b for a, b in zip(p, u, strict=True) if b)
        down = min(a / b if b > 0 else (1 - a) / -b for a, b in zip(p, u, strict=True) if b)
        step = up if _unit(self.held[0][2] ^ self.held[-1][2], self.salt) * (up + down) < down else -down
        rest = []
        for h, b in zip(self.held, u, strict=True):
            h[1] = min(1.0, max(0.0, h[1] + step * b))
            if h[1] < 1e-12 or h[1] > 1 - 1e-12:
                yield h[3], float(round(h[1]))
            else:
                rest.append(h)
        if len(rest) == len(self.held):  # rounding kept the bound from being met: the nearest one is
            k = min(range(len(rest)), key=lambda i: min(rest[i][1], 1 - rest[i][1]))
            yield rest[k][3], float(round(rest[k][1]))
            del rest[k]
        self.held = rest


def _land(held: list, recent: list[tuple[tuple, float]]) -> Iterator[tuple[tuple, float]]:
    """Decides the last undecided units, then trades one taken for one left unit of ``recent`` if that brings the words nearer."""
    options = [[k >> i & 1 for i in range(len(held))] for k in range(1 << len(held))]
    gap = lambda o: sum(h[0] * (x - h[1]) for h, x in zip(held, o, strict=True))
    best = min(options, key=lambda o: (abs(gap(o)), o))
    units = [*recent, *((h[3], float(x)) for h, x in zip(held, best, strict=True))]
    off, trade = gap(best), None
    for i, (a, x) in enumerate(units):
        for k, (b, y) in enumerate(units):
            if x == 1.0 and y == 0.0 and abs(gap(best) + b[2] - a[2]) < abs(off):
                off, trade = gap(best) + b[2] - a[2], (i, k)
    for i, (row, x) in enumerate(units):
        yield row, 1.0 - x if trade and i in trade else x


SCHEMA = "src long, block long, size long, key long, chance double, base long, doc_id long, copy long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _flight(level: int, last: bool):
    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, flight, recent, out, waiting = None, Flight(level), [], [], deque()

        def settle(units: Iterator[tuple[tuple, float]]) -> None:
            for row, chance in units:
                if last and 0.0 < row[4] < 1.0:
                    recent.append((row, chance))
                else:
                    out.append((row, chance))
            out.extend(recent[:-LANDING])
            del recent[:-LANDING]

        def enter(row: tuple) -> None:
            if not last and 0.0 < row[4] < 1.0:
                waiting.append(row)
                if len(waiting) <= RESERVE:
                    return
                row = waiting.popleft()
            settle(flight.add(row, row[2], row[4], row[3]))

        def close() -> None:
            out.extend((row, row[4]) for row in waiting)
            waiting.clear()
            settle(flight.end())
            out.extend(_land(flight.held, recent) if last else ((h[3], h[1]) for h in flight.held))
            recent.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:2] != at:
                    close()
                    at, flight = row[:2], Flight(level)
                enter(row)
            yield _decided(out)
            out.clear()
        close()
        yield _decided(out)

    return fly


def _decided(out: list) -> pa.RecordBatch:
    cols = list(zip(*[(*row[:4], chance, *row[5:]) for row, chance in out], strict=True)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "chance" else pa.int64()) for n, c in zip(NAMES, cols, strict=True)], NAMES)


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """How often the mix takes each row: ``doc_id``, ``source``, ``size``, ``copy``, ``source_size``, ``target``, ``times``, ``taken``.

    Size is the number of words, 0 for null or blank text. Rows alike in id, source and size are told apart by
    ``copy``, and each is decided on its own; a null id or source is a value like another. The blocks hash id,
    size and copy, so neither a hot source nor a hot id fills one; a rerun decides alike on any cluster.
    An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    like = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(0))
    sized = cut_lineage(pick(docs, "doc_id", "source", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")))
    units = sized.withColumn("copy", F.row_number().over(like).cast("long"))
    targets = cut_lineage(source_targets(sized, weights, share, most))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("doc_id", "size", "copy")
    blocks = F.ceil(F.col("n") / BLOCK)
    keyed = units.join(targets.withColumn("r", times), units.source.eqNullSafe(targets.source)).select(
        "src", F.pmod(key, blocks).cast("long").alias("block"), "size", key.alias("key"), (F.col("r") - F.floor("r")).alias("chance"), F.floor("r").cast("long").alias("base"), units.doc_id, "copy"
    )
    n = partitions(spark)
    most_blocks = int(targets.agg(F.coalesce(F.max(F.ceil(F.col("n") / BLOCK)), F.lit(0))).first()[0])
    done, level = None, 0
    while most_blocks:
        dealt = keyed.select(*NAMES).repartition(n, "src", "block").sortWithinPartitions("src", "block", "key", "size", "doc_id", "copy")
        flown = cut_lineage(dealt.mapInArrow(_flight(level, most_blocks == 1), SCHEMA))
        settled = flown.where("chance in (0.0, 1.0)")
        done = settled if done is None else done.unionAll(settled)
        if most_blocks == 1:
            break
        keyed = flown.where("chance not in (0.0, 1.0)").withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
        most_blocks, level = -(-most_blocks // FAN_IN), level + 1
    if done is None:
        done = spark.createDataFrame([], SCHEMA)
    result = done.join(targets, "src").withColumn("times", F.col("base") + F.col("chance").cast("long"))
    return result.select("doc_id", "source", "size", "copy", F.col("source_size").cast("long").alias("source_size"), "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``plan_mix`` takes it, with all its columns.

    Of rows alike in id, source and size the first by text hash are those taken once more.
    """
    names = numbered(docs).columns
    doc_id, source, text = (column(docs, c) for c in ("doc_id", "source", "text"))
    rows = numbered(docs).select("*", F.col(doc_id).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), word_count(F.col(text)).alias("_size"))
    rows = rows.withColumn("_k", F.xxhash64("_id", "_source", "_size"))
    plan = plan_mix(docs, **options).groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z")).agg(F.min("times").alias("_low"), (F.sum("times") - F.count("*") * F.min("times")).alias("_more"))
    plan = plan.where("_low + _more > 0").withColumn("_h", F.xxhash64("_i", "_s", "_z"))
    same = (F.col("_k") == F.col("_h")) & F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z"))
    alike = Window.partitionBy("_k", "_id", "_source", "_size").orderBy(F.xxhash64(text))
    taken = rows.join(plan, same).withColumn("_times", F.col("_low") + (F.row_number().over(alike) <= F.col("_more")).cast("long"))
    return taken.where("_times > 0").select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select(*names).toDF(*docs.columns)
