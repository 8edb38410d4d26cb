"""Alignment of two tokenizers' tokens over the bytes of a text.

Both tokenizers' tokens cut the same bytes. With A and B as token-byte incidence matrices in compressed rows, the row-wise
product A * B' has an entry for each pair of tokens that overlap (its value: the bytes they share), and with tokens
against groups - runs between byte offsets where both tokenizers end a token - the product of the group
incidences has an entry for each pair of tokens of one group.

A text is cut into units before single spaces, where neither tokenizer joins what stands on both sides, so
each distinct unit is tokenised and aligned once per worker and a document adds up its units.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.csr import Rows, members, spans
from factloom.llm.encode import tokenizer_path
from factloom.llm.spread import pick
from factloom.llm.text import offsets, release, slices
from factloom.session import cut_lineage

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Units kept by a worker before its memory of them starts anew.
KEEP_UNITS = 300_000
#: A text's slice in work, in bytes: its groups as text take several times that.
SLICE = 2 << 20
#: Up to so many id pairs (17 bytes each) the table of counts travels to the tasks; beyond, it is joined.
BROADCAST_PAIRS = 4_000_000
#: Pairs that a task counts in memory before it hands them on.
HELD_PAIRS = 1_000_000
#: First bytes of characters among which Unicode has white space.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True

TABLE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


class Vocabulary:
    """Bytes of each id: ``data[start[i]:start[i] + size[i]]``."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of consecutive tokens, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)], ends


class ByteLevel:
    """Tokenizer A. It sees the text with its leading space; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        names = [t for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.vocabulary = Vocabulary([bytes(letters.get(c, 63) for c in t) for t in names])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokenizer B. It adds the leading space itself, so it is given the text without."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.vocabulary = Vocabulary([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def cuts(rows: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Byte positions where units begin: the texts' own starts, and each space that has no other white space on either side.

    ``rows`` are the offsets in ``data`` of texts that begin with a space. Where a neighbour may be a wide white space there is no cut.
    """
    begins = np.zeros(len(data), bool)
    if len(data) > 4:
        third, second, before, here, after = (data[k : len(data) - 4 + k] for k in range(5))
        narrow = (before > 32) & (before < 127) | (before >= 128) & (second != 0xC2) & ~_WIDE_SPACE[third]
        begins[3:-1] = (here == 32) & narrow & (after > 32) & (after != 127) & ~_WIDE_SPACE[after]
    begins[rows[:-1]] = True
    return np.flatnonzero(begins)


class Aligner:
    """Distinct units with their ids, links and groups."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.width = len(self.b.vocabulary.size)
        self.clear()

    def clear(self) -> None:
        self.units = pa.array([], pa.string())
        self.groups = pa.array([], pa.string())
        self.counts = np.zeros((4, 0), np.int64)  # tokens of A, of B, groups, links
        self.right = np.zeros(0, bool)
        self.pairs, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers, where each unit's begin, and which units both give back byte by byte."""
        texts = units.to_pylist()
        a, b = self.a.encode(texts), self.b.encode(texts)
        ends, data = offsets(units)
        right = np.ones(len(texts), bool)
        out: list[np.ndarray] = []
        for vocabulary, found in ((self.a.vocabulary, a), (self.b.vocabulary, b)):
            ids = np.array([i for x in found for i in x], np.int64)
            first = np.r_[0, np.cumsum([len(x) for x in found])].astype(np.int64)
            joined, token_ends = vocabulary.joined(ids)
            mine = np.r_[0, token_ends][first]
            same = np.diff(mine) == np.diff(ends)
            for k in np.flatnonzero(same) if not same.all() or not np.array_equal(joined, data) else ():
                same[k] = np.array_equal(joined[mine[k] : mine[k + 1]], data[ends[k] : ends[k + 1]])
            right &= same
            out += [ids, first]
        return out[0], out[1], out[2], out[3], right

    def _learn(self, fresh: pa.Array) -> None:
        a, first_a, b, first_b, right = self._ids(fresh)
        keep_a, keep_b = np.repeat(right, np.diff(first_a)), np.repeat(right, np.diff(first_b))
        a, b = a[keep_a], b[keep_b]
        n_a, n_b = np.diff(first_a) * right, np.diff(first_b) * right
        links, group_a, group_b, n_groups = align(self.a.vocabulary.joined(a)[1], self.b.vocabulary.joined(b)[1])
        i, j, _ = links.entries()
        unit_a = np.repeat(np.arange(len(fresh)), n_a)
        unit_group = np.zeros(n_groups, np.int64)
        unit_group[group_a] = unit_a
        n_of = np.bincount(unit_group, minlength=len(fresh)) if n_groups else np.zeros(len(fresh), np.int64)
        n_links = np.bincount(unit_a[i], minlength=len(fresh)) if len(i) else np.zeros(len(fresh), np.int64)
        sides = [_joined(pa.array(ids).cast(pa.string()), np.bincount(group, minlength=n_groups), ",") for ids, group in ((a, group_a), (b, group_b))]
        self.groups = pa.concat_arrays([self.groups, _joined(pc.binary_join_element_wise(*sides, "|"), n_of, ";")])
        self.units = pa.concat_arrays([self.units, fresh])
        self.counts = np.concatenate([self.counts, [n_a, n_b, n_of, n_links]], axis=1)
        self.right = np.r_[self.right, right]
        self.start = np.r_[self.start, len(self.pairs) + np.cumsum(n_links) - n_links]
        self.pairs = np.r_[self.pairs, a[i] * self.width + b[j]]

    def documents(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Columns of ``TABLE`` but ``doc_id``; a text without tokens has zeros and empty strings."""
        size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
        some = np.flatnonzero(size > 0)
        n, totals, right = len(texts), np.zeros((4, len(texts)), np.int64), np.zeros(len(texts), bool)
        strings = pa.array([""] * n)
        empty = pa.array([b""] * n, pa.binary())
        pairs = times = empty
        if len(some):
            spaced = pc.binary_join_element_wise(" ", texts.take(pa.array(some)), "")
            rows, data = offsets(spaced)
            begins = cuts(rows, data)
            units = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, len(data)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
            distinct = units.dictionary_encode()
            if len(self.units) > KEEP_UNITS:
                self.clear()
            found = pc.index_in(distinct.dictionary, value_set=self.units)
            places = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            fresh = distinct.dictionary.filter(pc.is_null(found))
            if len(fresh):
                places[places < 0] = len(self.units) + np.arange(len(fresh))
                self._learn(fresh)
            at = places[distinct.indices.to_numpy()]
            first = np.searchsorted(begins, rows)
            right[some] = np.logical_and.reduceat(self.right[at], first[:-1])
            totals[:, some] = np.add.reduceat(self.counts[:, at], first[:-1], axis=1) * right[some]
            whole = _joined(self.groups.take(pa.array(at)), np.diff(first), ";")
            good = np.flatnonzero(right[some])
            where = np.full(n, -1)
            where[some[good]] = good
            strings = pc.fill_null(whole.take(pa.array(where, mask=where < 0)), "")
            pairs, times = self._pairs(at, first, some, right, n)
        names = ("n_a", "n_b", "n_groups", "n_links")
        return {name: pa.array(t) for name, t in zip(names, totals, strict=True)} | {"groups": strings, "pairs": pairs, "times": times}

    def _pairs(self, at: np.ndarray, first: np.ndarray, some: np.ndarray, right: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Each document's distinct linked id pairs (int64, rising) and how often it holds each (int64)."""
        owner = np.repeat(some, np.diff(first))
        at, owner = at[right[owner]], owner[right[owner]]
        size = self.counts[3][at]
        ends = np.cumsum(size)
        pair = self.pairs[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - size), size)]
        # a pair is below the product of both vocabularies, so document and pair fit into 64 bits
        key = np.sort(np.repeat(owner, size) * np.int64(len(self.a.vocabulary.size) * self.width) + pair)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        doc, pair = np.divmod(key[new], np.int64(len(self.a.vocabulary.size) * self.width))
        bounds = (8 * np.searchsorted(doc, np.arange(n + 1))).astype(np.int32)
        times = np.diff(np.r_[new, len(key)])
        return tuple(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(x, "<i8"))]) for x in (pair, times))


def _joined(strings: pa.Array, sizes: np.ndarray, mark: str) -> pa.Array:
    """Runs of ``sizes`` strings joined by ``mark``."""
    bounds = np.r_[0, np.cumsum(sizes)]
    if len(strings) and (nbytes := strings.nbytes) > (1 << 31) - (1 << 26):
        raise ValueError(f"{nbytes} bytes of one text's groups")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), strings), mark)


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Rows, np.ndarray, np.ndarray, int]:
    """Overlap links of two cuts of the same bytes, the group of each token of A and of B, and the number of groups."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    links = spans(ends_a).times(spans(ends_b).transposed())
    return links, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b), len(common)


def group_links(group_a: np.ndarray, group_b: np.ndarray, n_groups: int) -> Rows:
    """Pairs of tokens of one group: the product of the group incidences."""
    return members(group_a, n_groups).times(members(group_b, n_groups).transposed())


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    """One aligner per Python worker and pair of tokenizers."""
    return Aligner(a, b)


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or tokenizer_path(A_FILE), b or tokenizer_path(B_FILE)


def alignments(df: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per row of ``df`` (``doc_id``, ``text``): token counts, groups as text, linked id pairs and their times.

    ``groups`` reads `a1,a2|b1;a3|b2`: ids of A and B of each group. ``pairs`` holds the distinct linked id pairs as
    int64 ``a * size of B's vocabulary + b``, ``times`` how many links each has, both as little-endian bytes.
    Null and empty texts, and texts whose tokens do not give back a space and the text, have no tokens: zeros and empty strings. A long
    text is worked on whole, in memory of some tens of times its size; its groups as text must stay below 2 GB. Repeated rows and rows without an id are rows like any other;
    other columns are ignored; an empty table gives no rows.
    """
    paths = _paths(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0)} | aligner(*paths).documents(part.column(1)))

    return pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TABLE)


LINKS = "doc_id long, a_index long, b_index long, a_id long, b_id long, n_bytes long"


def token_links(df: DataFrame, kind: str = "overlap", a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per link: the tokens' places in the text and their ids; ``n_bytes`` they share, null for links of ``kind`` "group".

    Links within a group grow with the product of its tokens; groups are words or runs without common cuts.
    """
    if kind not in ("overlap", "group"):
        raise ValueError(kind)
    paths = _paths(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                both = aligner(*paths)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids_a, _, ids_b, _, right = both._ids(pa.array([" " + text] if text else [], pa.string()))
                    if right.all() and len(ids_a):
                        links, group_a, group_b, n = align(both.a.vocabulary.joined(ids_a)[1], both.b.vocabulary.joined(ids_b)[1])
                        i, j, shared = (links if kind == "overlap" else group_links(group_a, group_b, n)).entries()
                        cells = {"doc_id": pa.array([doc_id] * len(i), pa.int64()), "a_index": i, "b_index": j, "a_id": ids_a[i], "b_id": ids_b[j]}
                        yield pa.RecordBatch.from_pydict(cells | {"n_bytes": pa.array(shared) if kind == "overlap" else pa.nulls(len(i), pa.int64())})

    return pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, LINKS)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pair, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
    return pair, np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(pair)).astype(np.int64)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """``pair``, ``n`` (documents that hold it linked) and ``best``: whether no other pair of its A id has more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            cells = np.frombuffer(offsets(batch.column(0))[1].tobytes(), "<i8")
            for lo in range(0, len(cells), HELD_PAIRS):
                held.append(np.unique(cells[lo : lo + HELD_PAIRS], return_counts=True))
            if sum(len(pair) for pair, _ in held) > 2 * HELD_PAIRS:
                held = [_added(held)]
                if len(held[0][0]) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _added(held)], ["pair", "n"])

    counted = cut_lineage(aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counted = counted.withColumn("a", F.expr(f"pair div {width}"))
    top = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_counts(df: DataFrame, a: str | None = None, b: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row of ``df``: its alignment's counts, ``n_best`` and ``count_sum`` over its links, and a digest of its groups.

    A pair's count is the number of rows of ``df`` that hold it linked. The table of counts is bounded by both vocabularies, not by
    the rows; up to ``broadcast_pairs`` pairs travel to the tasks, more are joined by pair. Edge cases: see ``alignments``.
    """
    paths = _paths(a, b)
    width = len(Pieces(paths[1]).vocabulary.size)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    held = ("doc_id", "n_a", "n_b", "n_groups", "n_links")
    aligned = cut_lineage(alignments(df, a, b).select(F.monotonically_increasing_id().alias("row"), *held, digest, "pairs", "times"))
    counts = cut_lineage(pair_counts(aligned, width))
    sums = _by_table if counts.count() <= broadcast_pairs else _by_join
    return sums(aligned, counts).select(*held, "n_best", "count_sum", "groups_sha256")


def _by_table(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    table = [c.to_numpy() for c in counts.toArrow().columns]
    order = np.argsort(table[0])
    found = aligned.sparkSession.sparkContext.broadcast([c[order] for c in table])
    names = [f for f in aligned.columns if f not in ("row", "pairs", "times")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = found.value
        for batch in batches:
            rows, cells = offsets(batch.column("pairs"))
            times = np.frombuffer(offsets(batch.column("times"))[1].tobytes(), "<i8")
            at = np.searchsorted(pair, np.frombuffer(cells.tobytes(), "<i8"))
            sums = [np.r_[0, np.cumsum(x)][rows // 8] for x in (times * best[at], times * n[at])]
            extra = {k: pa.array(np.diff(s)) for k, s in zip(("n_best", "count_sum"), sums, strict=True)}
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in names} | extra)
        release()

    schema = ", ".join(f"{k} {aligned.schema[k].dataType.simpleString()}" for k in names) + ", n_best long, count_sum long"
    return aligned.select(*names, "pairs", "times").mapInArrow(add, schema)


def _by_join(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    def open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = offsets(batch.column(1))
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(rows) // 8)
            pair = np.frombuffer(cells.tobytes(), "<i8")
            times = np.frombuffer(offsets(batch.column(2))[1].tobytes(), "<i8")
            for lo in range(0, len(pair), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                yield pa.RecordBatch.from_pydict({"row": owner[some], "pair": pair[some], "times": times[some]})

    opened = aligned.select("row", "pairs", "times").mapInArrow(open_pairs, "row long, pair long, times long")
    best, total = F.sum(F.col("times") * F.col("best").cast("long")), F.sum(F.col("times") * F.col("n"))
    sums = opened.join(counts, "pair").groupBy("row").agg(best.alias("n_best"), total.alias("count_sum"))
    zero = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").withColumn("n_best", F.coalesce("n_best", zero)).withColumn("count_sum", F.coalesce("count_sum", zero))
