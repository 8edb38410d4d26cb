"""Substring dedup by minimiser grouping of windows, in place of De Bruijn compaction: no edges are built or joined.

The nodes are k-mers chosen by content: of the k-mers in a window the one with the least hash, so equal
windows choose alike. The windows that choose one place of a text are a path through its node; their words
form the path's context. Contexts that recur are repeated as a whole and stay compact, and a node with one
context is a nonbranching path. Only contexts of branching nodes are opened into single windows, which are
grouped by node and words. Source coordinates (text, first window, which of its windows) carry the repeated
windows back to the texts, where the words they cover are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.spread import bit_filter, column, may_hold, numbered, pick
from factloom.llm.text import Rolling, Words, mix, signed, slices
from factloom.session import cut_lineage

WINDOW, KMER = 35, 6
#: Places of the bitmap of repeated nodes that is sent to every task: 2**25 bits, 4 MB.
FILTER_BITS = 1 << 25
SALT = np.uint64(0xD6E8FEB86659FD93)


class Paths:
    """The windows of a run of texts, grouped by the node they choose: node, first window and number of windows of each path."""

    def __init__(self, texts: pa.Array, window: int, kmer: int):
        words = Words(texts)
        self.counts, self.first = words.counts, words.first
        self.window, n = window, len(words.starts)
        self.rolling = Rolling(words.hashes())
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        start = np.flatnonzero(np.arange(n) + window <= self.first[1:][doc]) if n else np.zeros(0, np.int64)
        if not len(start):
            self.node, self.lo, self.size, self.doc = np.zeros(0, np.uint64), start, start, start
            return
        grams = max(0, n - kmer + 1)
        g = mix(self.rolling.of(np.arange(grams), np.arange(grams) + kmer) ^ SALT)
        place = np.arange(grams)
        low, at, width, span = g, place, 1, window - kmer + 1
        while 2 * width <= span:  # leftmost least hash of 2 * width k-mers from those of width
            take = low[:-width] <= low[width:]
            low, at, width = np.where(take, low[:-width], low[width:]), np.where(take, at[:-width], at[width:]), 2 * width
        right = start + span - width
        chosen = np.where(low[start] <= low[right], at[start], at[right])
        new = np.flatnonzero(np.r_[True, (np.diff(chosen) != 0) | (np.diff(start) != 1)])
        self.lo, self.size = start[new], np.diff(np.r_[new, len(start)])
        self.node, self.doc = g[chosen[new]], doc[start[new]]

    def contexts(self, at: np.ndarray) -> np.ndarray:
        return self.rolling.of(self.lo[at], self.lo[at] + self.size[at] - 1 + self.window)


class Twice:
    """Which rows of a task hold a text seen less than twice: more copies tell nothing new."""

    def __init__(self):
        self.once, self.twice = set(), set()

    def keep(self, keys: list) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for k, key in enumerate(keys):
            if key not in self.once:
                self.once.add(key)
                out[k] = True
            elif key not in self.twice:
                self.twice.add(key)
                out[k] = True
        return out


def repeated_windows(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``t``, ``len``, ``spans``: for each text with repeated windows, their places as ``first << 30 | bits``."""
    if not 0 <= window - kmer < 30:
        raise ValueError("a window has at most 30 k-mers")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Twice()
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pa.array(twice.keep(part.column(0).to_pylist())))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(Paths(part.column(2), window, kmer).node))], ["node"])

    counted = texts.mapInArrow(nodes, "node long").groupBy("node").count().where("count > 1").select("node")
    known = texts.sparkSession.sparkContext.broadcast(bit_filter(counted, FILTER_BITS))
    schema = "node long, context long, t long, len long, lo long, size int"

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = Twice()
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pa.array(twice.keep(part.column(0).to_pylist())))
                if not part.num_rows:
                    continue
                found = Paths(part.column(2), window, kmer)
                at = np.flatnonzero(may_hold(known.value, found.node))
                doc = found.doc[at]
                t, size = part.column(0).to_numpy()[doc], part.column(1).to_numpy()[doc]
                cols = [signed(found.node[at]), signed(found.contexts(at)), t, size, found.lo[at] - found.first[doc], found.size[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], [x.split()[0] for x in schema.split(", ")])

    places = cut_lineage(texts.mapInArrow(paths, schema))
    contexts = cut_lineage(places.groupBy("node", "context").agg(F.count("*").alias("n")))
    branching = contexts.groupBy("node").count().where("count > 1").select("node")
    split = texts.sparkSession.sparkContext.broadcast(bit_filter(branching, FILTER_BITS))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The single windows of the contexts of branching nodes, each context once a task."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                found = Paths(part.column(2), window, kmer)
                at = np.flatnonzero(may_hold(known.value, found.node) & may_hold(split.value, found.node))
                context, fresh = found.contexts(at), []
                for k, pair in enumerate(zip(found.node[at].tolist(), context.tolist(), strict=True)):
                    if pair not in seen:
                        seen.add(pair)
                        fresh.append(k)
                at, context = at[fresh], context[fresh]
                size = found.size[at]
                bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                words = found.rolling.of(np.repeat(found.lo[at], size) + bit, np.repeat(found.lo[at], size) + bit + window)
                cols = [signed(np.repeat(found.node[at], size)), signed(np.repeat(context, size)), signed(words), (1 << bit).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["node", "context", "words", "bit"])

    single = cut_lineage(texts.mapInArrow(opened, "node long, context long, words long, bit long"))
    # a window that two contexts hold is repeated; a context's own recurrences are whole already
    shared = single.groupBy("node", "words").agg(F.min("context").alias("a"), F.max("context").alias("b")).where("a <> b").select("node", "words")
    parts = single.join(shared, ["node", "words"]).groupBy("node", "context").agg(F.bit_or("bit").alias("bits"))
    whole = contexts.where("n > 1").select("node", "context", F.lit((1 << 30) - 1).cast("long").alias("bits"))
    # written, so that the join below deals both sides anew and a hot context can be split
    bits = cut_lineage(whole.unionByName(parts).groupBy("node", "context").agg(F.bit_or("bits").alias("bits")))
    hits = places.select("node", "context", "t", "len", "lo", "size").join(bits, ["node", "context"])
    packed = F.shiftleft("lo", 30).bitwiseOR(F.col("bits").bitwiseAND(F.expr("shiftleft(1L, size) - 1")))
    return hits.groupBy("t", "len").agg(F.collect_set(packed).alias("spans"))


def keyed_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Text key (hash and length) and the text as bytes; null texts and those with too few bytes for a window are left out."""
    return docs.where(F.octet_length("text") >= 2 * window - 1).select(F.xxhash64("text").alias("t"), F.octet_length("text").cast("long").alias("len"), F.col("text").cast("binary").alias("text"))


def with_spans(rows: DataFrame, text: str, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``rows`` with ``_spans``, joined by their column ``text``: equal texts have equal repeated windows."""
    spans = repeated_windows(keyed_texts(rows.select(F.col(text).alias("text")), window), window, kmer).select(F.col("t").alias("_t"), F.col("len").alias("_len"), F.col("spans").alias("_spans"))
    keyed = rows.withColumn("_t", F.xxhash64(text)).withColumn("_len", F.octet_length(text).cast("long"))
    return keyed.join(spans, ["_t", "_len"], "left").drop("_t", "_len")


def _removed(spans: list[int] | None, n: int, window: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        packed = np.array(spans, np.int64)
        bit = (packed[:, None] >> np.arange(30)) & 1 == 1
        start = ((packed >> 30)[:, None] + np.arange(30))[bit]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: bytes | None, spans: list[int] | None, window: int) -> tuple[list[bytes], int, int]:
    words = (text or b"").split()
    gone = _removed(spans, len(words), window)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], len(words), int(gone.sum())


def removal_digest(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of the kept words joined by one space.

    A word goes if a window of ``window`` consecutive words of its text covers it whose words also start anywhere
    else. Null and empty texts have no words; repeated rows remove each other's windows; a null id is kept
    as it is; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [_kept(t, s, window) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([hashlib.sha256(b" ".join(f[0])).hexdigest() for f in found])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    rows = with_spans(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", window, kmer)
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"), "_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """``docs`` with the kept words, joined by one space, as ``text`` where words went; other texts and columns stay as they are."""
    rows, at = numbered(docs), docs.columns.index("text")
    names, types = rows.columns, rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    texts[k] = b" ".join(_kept(texts[k].encode(), spans, window)[0]).decode()
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return with_spans(rows, column(docs, "text"), window, kmer).select(*names, "_spans").mapInArrow(run, types).toDF(*docs.columns)


def digest_sql(window: int = WINDOW, table: str = "documents") -> str:
    """The same digest in DuckDB SQL, window by window."""
    return f"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from {table}),
win as (select r, unnest(range(1, len(w) - {window} + 2)) as s, w from d where len(w) >= {window}),
hashed as (select r, s, array_to_string(w[s:s + {window - 1}], ' ') as x from win),
rep as (select x from hashed group by x having count(*) > 1),
hits as (select r, s from hashed semi join rep using (x)),
gone as (select distinct r, unnest(range(s, s + {window})) as i from hits),
words as (select r, unnest(w) as v, generate_subscripts(w, 1) as i from d),
kept as (select words.r, string_agg(v, ' ' order by words.i) as t, count(*) as n from words anti join gone on words.r = gone.r and words.i = gone.i group by words.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (r)"""
