"""Packing of token ids into fixed windows: bounded-space online best-fit, then a merge of leftovers."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.encode import encoder, tokenizer_path
from factloom.llm.spread import pick
from factloom.llm.text import slices
from factloom.session import cut_lineage

SIZE = 1024
OPEN_WINDOWS = 256


class Windows:
    """At most ``most`` open windows of ``size`` cells; ``put`` places best-fit and closes the fullest when none fits."""

    def __init__(self, size: int, most: int, name: int):
        self.size, self.most, self.next = size, most, name
        self.free: list[tuple[int, int]] = []

    def whole(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, length: int) -> tuple[int, int]:
        """The window that takes ``length`` cells, and where they begin in it."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            free, name = self.free.pop(at)
        else:
            if len(self.free) >= self.most:
                self.free.pop(0)
            free, name = self.size, self.whole()
        if free > length:
            insort(self.free, (free - length, name))
        return name, self.size - free


def _first_name() -> int:
    return TaskContext.get().partitionId() << 36


def pack(df: DataFrame, tokenizer: str | None = None, size: int = SIZE, open_windows: int = OPEN_WINDOWS, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of the documents' ids (``doc_id``, ``text``) and their places in sequences of at most ``size`` ids.

    A document is its ids and ``end_id``; a null text is empty. Each full window's worth is a sequence
    of its own, the rest of a document goes best-fit into the open windows of its partition; windows left
    open are merged across partitions in rounds of at most ``64 * open_windows`` a task. One row per
    piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``
    and, on request, ``ids`` (little-endian uint32). Repeated rows and rows without an id are packed like
    any other; other columns are ignored. An empty table gives no rows.
    """
    path = tokenizer or tokenizer_path()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, left_fill long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, fill, seen = Windows(size, open_windows, _first_name()), {}, False
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder(path).encode(part.column(1).fill_null("")), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        window, offset = (windows.whole(), 0) if len(piece) == size else windows.put(len(piece))
                        raw = piece.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(piece), zlib.crc32(raw), len(ids), window, offset, None, raw)[: len(names)])
                seen = True
                yield _batch(rows, names)
        if seen:
            left = [(None, None, None, None, None, name, None, size - free, None)[: len(names)] for free, name in windows.free]
            yield _batch(left, names)

    def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    placed = cut_lineage(pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(place, schema))
    pieces = placed.where("left_fill is null").drop("left_fill")
    moves = _merge(placed.where("left_fill is not null").select("window", F.col("left_fill").alias("fill")), size, open_windows)
    moved = pieces.join(moves, "window", "left").withColumn("sequence_id", F.coalesce("into", "window"))
    moved = moved.withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0)))
    return moved.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def _merge(left: DataFrame, size: int, open_windows: int) -> DataFrame:
    """``window``, ``into``, ``base``: where the content of each leftover window goes. Windows only move whole."""
    spark = left.sparkSession
    level, total, room = 0, left.count(), 64 * open_windows
    moves = left.select("window", F.col("window").alias("into"), F.lit(0).cast("long").alias("base")).limit(0)
    while total:
        parts, level = -(-total // room), level + 1
        top = level << 60

        def merge(batches: Iterator[pa.RecordBatch], top: int = top) -> Iterator[pa.RecordBatch]:
            windows, fill = Windows(size, open_windows, top + _first_name()), {}
            for batch in batches:
                out = []
                for window, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    into, base = windows.put(cells)
                    out.append((window, into, base))
                yield pa.RecordBatch.from_pydict({n: pa.array([o[k] for o in out], pa.int64()) for k, n in enumerate(("window", "into", "base"))} | {"fill": pa.nulls(len(out), pa.int64())})
            yield pa.RecordBatch.from_pydict({"window": pa.array([n for _, n in windows.free], pa.int64()), "into": pa.nulls(len(windows.free), pa.int64()), "base": pa.nulls(len(windows.free), pa.int64()), "fill": pa.array([size - f for f, _ in windows.free], pa.int64())})

        # repartition() is held to one task when few windows are left, and each task's share stays below ``room`` and its spread
        dealt = left.repartition(parts, "window") if parts > 1 else left.coalesce(1)
        done = cut_lineage(dealt.sortWithinPartitions(F.desc("fill"), "window").mapInArrow(merge, "window long, into long, base long, fill long"))
        step = done.where("into is not null").select("window", "into", "base")
        if level == 1:
            moves = step
        else:
            later = step.select(F.col("window").alias("into"), F.col("into").alias("_into"), F.col("base").alias("_base"))
            moves = moves.join(later, "into", "left").select("window", F.coalesce("_into", "into").alias("into"), (F.col("base") + F.coalesce("_base", F.lit(0))).alias("base"))
        if parts == 1:
            return moves
        left = done.where("into is null").select("window", "fill")
        total = left.count()
    return moves
