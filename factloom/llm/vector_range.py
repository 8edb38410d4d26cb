"""Exact metric range join of embeddings: pivots partition the vectors of a label, the triangle
inequality says which vectors a cell needs besides its own, and cells are joined independently."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.spread import components, partitions, pick
from factloom.llm.vectors import matrix, usable
from factloom.session import cut_lineage

COSINE = 0.93
#: Own vectors of a cell that one task holds; a larger cell is cut into parts that meet each other as visitors.
PART = 32_768
#: Pivots that meet a vector at a time.
PIVOT_BLOCK = 512


def range_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per row: ``vec_id``, ``n_links`` (other rows of the label with cosine >= ``cosine``), ``component_id``, ``kept``.

    ``vectors`` has ``vec_id``, ``embedding``, ``label``. Vectors link only within equal labels and equal numbers
    of components; a null label, or a vector that is null, empty, zero or has null or non-finite components, links with
    nothing. Rows with equal vectors are one point with a weight, however many, and count each other as links.
    ``component_id`` is the smallest id reachable, ``kept`` whether it is the row's own (both ids null: kept).
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    wide = F.col("embedding").cast("array<double>")
    rows = pick(vectors, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), wide.alias("v"))
    fine = F.coalesce(usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    keyed = rows.withColumn("key", F.when(fine, F.xxhash64("label", F.transform("v", lambda x: x + 0.0)))).withColumn("group", F.when(fine, F.concat(F.size("v").cast("string"), F.lit(":"), F.col("label"))))
    points = cut_lineage(keyed.where("key is not null").groupBy("key").agg(F.first("group").alias("group"), F.first("v").alias("v"), F.count("*").alias("weight")).mapInArrow(_unit, "key long, group string, v array<double>, weight long"))
    reach = sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    cells = _cells(points, reach)
    found = cut_lineage(cells.mapInArrow(_joiner(cosine, reach), "key long, links long, root long"))
    joined = components(found.where("root is not null").select(F.col("key").alias("a"), F.col("root").alias("b")))
    comp = joined.select(F.col("node").alias("key"), "root")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    table = points.select("key", "weight").join(counts, "key", "left").join(comp, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    labelled = keyed.select("vec_id", "key").where("key is not null").join(table, "key")
    least = labelled.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    linked = labelled.join(least, "root").select("vec_id", "n_links", "component_id")
    alone = keyed.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to length 1 in double precision."""
    for batch in batches:
        out = []
        for v in batch.column(2):
            x = v.values.to_numpy()
            x = x / np.abs(x).max()
            out.append(x / np.sqrt(x @ x))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64())), batch.column(3)], ["key", "group", "v", "weight"])


def _cells(points: DataFrame, reach: float) -> DataFrame:
    """Points dealt to cells, sorted so that a cell's own points come first.

    A group of n points has about max(sqrt(n) / 32, n / 65536) pivots, taken by hash. A point is at home with its nearest
    pivot p and visits each pivot q with d(v, q) <= d(v, p) + 2 * reach: a point within reach of it may live there.
    """
    size = points.groupBy("group").agg(F.count("*").alias("n"), F.min("key").alias("least"))
    rate = F.greatest(1 / (32 * F.sqrt("n")), F.lit(1 / 65536))
    share = F.pmod(F.xxhash64("key", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    pivots = points.join(size, "group").where((share < rate) | (F.col("key") == F.col("least"))).select("group", F.col("key").alias("pivot"), "v")
    block = F.pmod(F.col("pivot"), F.ceil(F.count("*").over(Window.partitionBy("group")) / PIVOT_BLOCK))
    blocks = pivots.withColumn("block", block).groupBy("group", "block").agg(F.collect_list(F.struct("pivot", "v")).alias("p"))
    blocks = blocks.select("group", F.col("p.pivot").alias("pivots"), F.flatten("p.v").alias("flat"))
    met = points.join(blocks, "group")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *_nearest(v, p, f)) for k, v, p, f in _met(batch)]
            yield pa.RecordBatch.from_pydict({"key": pa.array([o[0] for o in out], pa.int64()), "home": pa.array([o[2] for o in out], pa.int64()), "near": pa.array([o[1] for o in out], pa.float64())})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (k, v, p, f), home, near in zip(_met(batch), batch.column("home").to_pylist(), batch.column("near").to_pylist(), strict=True):
                d = _distances(v, f)
                out += [(k, int(p[i]), int(p[i]) != home, float(d[i])) for i in np.flatnonzero((d <= near + 2 * reach) | (p == home))]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.float64()))], ["key", "cell", "visits", "d"])

    homes = met.select("key", "v", "pivots", "flat").mapInArrow(nearest, "key long, home long, near double").groupBy("key").agg(F.min_by("home", F.struct("near", "home")).alias("home"), F.min("near").alias("near"))
    placed = met.join(homes, "key").select("key", "v", "pivots", "flat", "home", "near").mapInArrow(dealt, "key long, cell long, visits boolean, d double")
    placed = cut_lineage(placed)
    parts = placed.where("not visits").groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
    own = F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts"))
    spread = placed.join(parts, "cell").withColumn("own", own).select("key", "cell", "visits", "d", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    spread = spread.select("key", "cell", "part", (F.col("visits") | (F.col("own") != F.col("part"))).alias("visits"), "d")
    full = spread.join(points.select("key", "v", "weight"), "key")
    return full.repartition(partitions(points.sparkSession), "cell", "part").sortWithinPartitions("cell", "part", "visits", "d", "key").select("cell", "part", "visits", "d", "key", "v", "weight")


def _met(batch: pa.RecordBatch) -> Iterator[tuple]:
    last, pair = None, None
    for k, v, pivots, flat in zip(*(batch.column(i) for i in range(4)), strict=True):
        p = pivots.values
        if last is None or not p.equals(last):
            last = p
            ids = p.to_numpy()
            pair = ids, flat.values.to_numpy().reshape(len(ids), -1)
        yield k.as_py(), v.values.to_numpy(), *pair


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ v)))


def _nearest(v: np.ndarray, ids: np.ndarray, pivots: np.ndarray) -> tuple[float, int]:
    d = _distances(v, pivots)
    k = np.lexsort((ids, d))[0]
    return float(d[k]), int(ids[k])


class _Roots:
    """Local union-find over point keys, least key as root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (u := self.up.get(x, x)) != x:
            path.append(x)
            x = u
        for p in path:
            self.up[p] = x
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))


def _joiner(cosine: float, reach: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, homes, links, roots = None, None, None, _Roots()

        def close() -> Iterator[pa.RecordBatch]:
            if homes is not None:
                keys = homes[0]
                up = sorted(roots.up)
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.r_[keys, np.array(up, np.int64)]), "links": pa.array(np.r_[links, np.zeros(len(up), np.int64)]), "root": pa.array([None] * len(keys) + [roots.root(x) for x in up], pa.int64())})

        def meet(keys: np.ndarray, v: np.ndarray, weight: np.ndarray, d: np.ndarray) -> None:
            """Links of the homes with these rows, which may be the homes themselves; only the homes count them."""
            at_root = np.array([roots.root(k) for k in homes[0].tolist()], np.int64)
            for lo in range(0, len(keys), 256):
                at = slice(lo, lo + 256)
                a = np.searchsorted(homes[3], d[at].min() - reach - 1e-9)
                b = np.searchsorted(homes[3], d[at].max() + reach + 1e-9)
                if a == b:
                    continue
                x, y = np.nonzero(v[at] @ homes[1][a:b].T >= cosine)
                x, y = x + lo, y + a
                differ = keys[x] != homes[0][y]
                x, y = x[differ], y[differ]
                np.add.at(links, y, weight[x])
                # homes of one root so far need one link
                pairs = np.unique(np.stack([keys[x], at_root[y]], 1), axis=0)
                for i, k in pairs.tolist():
                    roots.link(i, k)
                if len(pairs):
                    at_root = np.array([roots.root(k) for k in at_root.tolist()], np.int64)

        held: list[tuple] = []

        def settle() -> None:
            nonlocal homes, links
            if homes is None:
                homes = tuple(np.concatenate([h[i] for h in held]) for i in range(4)) if held else None
                held.clear()
                if homes is not None:
                    links = np.zeros(len(homes[0]), np.int64)
                    meet(*homes)

        for batch in batches:
            c, part, visits = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = np.flatnonzero(np.r_[True, (np.diff(c) != 0) | (np.diff(part) != 0) | (np.diff(visits.astype(np.int8)) != 0)]) if len(c) else []
            for lo, hi in zip(change, np.r_[change[1:], len(c)] if len(c) else [], strict=True):
                piece = batch.slice(int(lo), int(hi - lo))
                if (int(c[lo]), int(part[lo])) != cell:
                    settle()
                    yield from close()
                    cell, homes, links, roots = (int(c[lo]), int(part[lo])), None, None, _Roots()
                rows = piece.column(4).to_numpy(), matrix(piece.column(5)), piece.column(6).to_numpy(), piece.column(3).to_numpy()
                if visits[lo]:
                    settle()
                    if homes is not None:
                        meet(*rows)
                else:
                    held.append(rows)
        settle()
        yield from close()

    return join
