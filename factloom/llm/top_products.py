"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets. A query's k-th best score in the longest bucket is its first
threshold: a bucket whose longest vector cannot reach it is not visited. In a visited bucket the threshold over
both lengths is a least cosine; where that is high, coordinates prune (a vector whose largest query
coordinates lie outside the cone is skipped), else lengths do (vectors too short are skipped). What
is left is verified by integer products, exact at any size: in floating point where all of them stay below 2**53,
else in 64 bits, else in Python's integers. Bounds are floating-point with a slack well above rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.spread import in_order, partitions, pick
from factloom.llm.vectors import matrix, usable
from factloom.session import cut_lineage

TOP, EVERY, SCALE = 5, 50, 256
BUCKET, QUERY_BLOCK = 4096, 1024
#: From this least cosine on coordinates prune better than lengths; so many coordinates are looked at.
STEEP, FOCUS = 0.6, 3
NO_ID = np.iinfo(np.int64).max
#: Components are held within this, so that inner products of some ten thousand of them fit into 38 digits.
MOST_COMPONENT = 1 << 56

BLOCKS = "block long, dim int, longest double, ids binary, cells binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of ``size`` vectors of one number of components, by falling length; one row each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, n, dim = TaskContext.get().partitionId() << 32, [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal name, held, n
            if n:
                ids, cells = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                for lo in range(0, n, size):
                    some = cells[lo : lo + size]
                    yield pa.RecordBatch.from_pylist([{"block": name, "dim": some.shape[1], "longest": float(lengths(some).max()), "ids": ids[lo : lo + size].tobytes(), "cells": some.tobytes()}], schema=_schema)
                    name += 1
            held, n = [], 0

        for batch in batches:
            dims = batch.column(2).to_numpy()
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for lo, hi in _runs(dims):
                if dims[lo] != dim or n >= size:
                    yield from flush()
                    dim = dims[lo]
                held.append((ids[lo:hi], matrix(batch.column(1).slice(lo, hi - lo))))
                n += hi - lo
        yield from flush()

    _schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("cells", pa.binary())])
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sized = rows.select("vec_id", "v", F.size("v").alias("dim"), length.alias("length"))
    dealt = in_order(sized, [F.col("dim"), -F.col("length"), F.col("vec_id")], partitions(rows.sparkSession)).select("vec_id", "v", "dim")
    return cut_lineage(dealt.mapInArrow(cut, BLOCKS))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.r_[True, np.diff(values) != 0]) if len(values) else np.zeros(0, int)
    return [(int(a), int(b)) for a, b in zip(cuts, np.r_[cuts[1:], len(values)], strict=True)]


def _load(ids: bytes, cells: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(cells, np.int64).reshape(-1, dim)


def lengths(cells: np.ndarray) -> np.ndarray:
    return np.sqrt((cells.astype(float) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``, exact; as Python integers where 64 bits may not hold one."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T if most < 1 << 63 else a.astype(object) @ b.T.astype(object)


def _best(scores: np.ndarray, ids: np.ndarray, own: int, top: int) -> list[tuple[int, int]]:
    """The ``top`` highest scores, ties to the smaller id, without the query's own id."""
    other = ids != own
    scores, ids = scores[other], ids[other]
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k]))[:top]
    elif len(scores) > top:
        at = scores >= np.partition(scores, len(scores) - top)[len(scores) - top]
        scores, ids = scores[at], ids[at]
        order = np.lexsort((ids, -scores))[:top]
    else:
        order = np.lexsort((ids, -scores))
    return [(int(scores[k]), int(ids[k])) for k in order]


class Bucket:
    """Vectors by falling length, with their directions for the pruning."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray):
        self.ids, self.cells = ids, cells
        self.length = lengths(cells)
        self.unit = cells / np.maximum(self.length, 1e-300)[:, None]

    def search(self, own: np.ndarray, queries: np.ndarray, least: np.ndarray, top: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Per query its best of this bucket among those that reach ``least``; all of the best if ties meet it."""
        norms = lengths(queries)
        reach = norms * self.length.max(initial=0.0)
        cosine = np.where(reach > 0, least / np.maximum(reach, 1e-300), np.where(least > 0, np.inf, -np.inf))
        slack = 1e-9
        for k in np.flatnonzero((cosine >= STEEP) & (cosine <= 1 + slack)):
            rows = self._by_coordinates(queries[k] / norms[k], min(1.0, cosine[k]), slack)
            yield int(k), _best(products(queries[k : k + 1], self.cells[rows])[0], self.ids[rows], own[k], top)
        flat = np.flatnonzero(cosine < STEEP)
        for lo in range(0, len(flat), 256):
            some = flat[lo : lo + 256]
            # lengths fall along the bucket: a prefix is long enough
            enough = np.where(least[some] > 0, least[some] / np.maximum(norms[some], 1e-300), -1.0) * (1 - slack)
            n = len(self.length) - np.searchsorted(self.length[::-1], enough, side="left")
            scores = products(queries[some], self.cells[: n.max(initial=0)])
            for row, k, m in zip(scores, some, n, strict=True):
                yield int(k), _best(row[:m], self.ids[:m], own[k], top)

    def _by_coordinates(self, q: np.ndarray, cosine: float, slack: float) -> np.ndarray:
        inside = np.ones(len(self.ids), bool)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            half = np.sqrt((1 - cosine * cosine) * max(0.0, 1 - q[f] * q[f])) + slack
            low = -1.0 - slack if q[f] < -cosine else cosine * q[f] - half
            high = 1.0 + slack if q[f] > cosine else cosine * q[f] + half
            inside &= (self.unit[:, f] >= low) & (self.unit[:, f] <= high)
        return np.flatnonzero(inside)


def top_products(vectors: DataFrame, top: int = TOP, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row with an id divisible by ``every`` its ``top`` best other rows.

    Components become floor(scale * x), x in double precision, held within 2**56; the score is their integer inner product, by
    whose exact value rows are ranked; one beyond 64 bits is given as the nearest long. Ties go to
    the smaller id, rows without an id last. Rows with the query's own id are its own. Vectors that are null, empty or hold null
    or non-finite components take no part; vectors meet only with as many components. Repeated query rows
    are each answered; fewer than ``top`` candidates give fewer ranks; other columns are ignored.
    """
    most = F.lit(MOST_COMPONENT)
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))), most), -most))
    rows = pick(vectors, "vec_id", "embedding").where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    buckets = _blocks(rows, BUCKET)
    asked = _blocks(rows.where(F.col("vec_id") % every == 0), QUERY_BLOCK)
    heads = buckets.groupBy("dim").agg(F.min_by("block", F.struct(-F.col("longest"), F.col("block"))).alias("head"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, queries = _load(r["ids"], r["cells"], r["dim"])
                bucket, least = Bucket(*_load(r["head_ids"], r["head_cells"], r["dim"])), np.full(len(own), -np.inf)
                for k, best in bucket.search(own, queries, least.copy(), top):
                    if len(best) == top:
                        least[k] = best[-1][0]
                yield pa.RecordBatch.from_pydict({"block": [r["block"]], "least": pa.array([least.tobytes()], pa.binary()), "reach": pa.array([(np.where(least > 0, least, 0) / np.maximum(lengths(queries), 1e-300)).min()], pa.float64())})

    head = buckets.join(heads.select(F.col("head").alias("block")), "block").select("dim", F.col("ids").alias("head_ids"), F.col("cells").alias("head_cells"))
    least = cut_lineage(asked.join(head, "dim").mapInArrow(first, "block long, least binary, reach double"))
    known = asked.join(least, "block")
    # block against block, by their numbers alone: a bucket is visited if one of the block's queries can still reach its threshold there
    visits = known.select("dim", F.col("block").alias("q"), "reach").join(buckets.select("dim", F.col("block").alias("b"), "longest"), "dim").where(F.col("longest") >= F.col("reach") * (1 - 1e-9)).select("q", "b")
    sides = known.select(F.col("block").alias("q"), "dim", "ids", "cells", "least"), buckets.select(F.col("block").alias("b"), F.col("ids").alias("bucket_ids"), F.col("cells").alias("bucket_cells"))
    pairs = visits.join(sides[0], "q").join(sides[1], "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                own, queries = _load(r["ids"], r["cells"], r["dim"])
                found = Bucket(*_load(r["bucket_ids"], r["bucket_cells"], r["dim"])).search(own, queries, np.frombuffer(r["least"]), top)
                out = [(r["q"], j, int(own[j]), None if i == NO_ID else i, s) for j, best in found for s, i in best]
                cells = [pa.array([o[c] for o in out], pa.int64()) for c in range(4)] + [pa.array([Decimal(o[4]) for o in out], pa.decimal128(38, 0))]
                yield pa.RecordBatch.from_arrays(cells, ["q", "j", "query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(search, "q long, j long, query_id long, vec_id long, score decimal(38,0)")
    w = Window.partitionBy("q", "j").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    low, high = (F.lit(Decimal(x)).cast("decimal(38,0)") for x in (-(2**63), 2**63 - 1))
    held = F.greatest(F.least("score", high), low).cast("long")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", held.alias("score"))
