"""Exact Jaccard self-join of word n-gram sets by set-relation skipping.

Shingles are ordered by how often the corpus holds them (a fixed-size count table) and then by hash; sets that
reach the threshold share one of their rarest shingles. Inverted lists of those prefix shingles are sorted by
position, so a pair whose positions leave too few shingles, or whose bit maps differ in too many places, is skipped
without a look at the sets. The set
that comes first in a list is compared with all others; the sets linked to it take over its answer
(their component) and skip each other. Only list members whose answers still differ are paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.spread import bit_filter, column, components, fixed_table, may_hold, numbered, partitions, pick, table_rows, whole_table
from factloom.llm.text import Rolling, Words, mix, signed, slices
from factloom.session import cut_lineage

#: Cells of the count table that orders shingles, and places of the bitmap of candidate sets: 4 MB each.
COUNT_CELLS, FILTER_BITS = 1 << 20, 1 << 25
#: Bits of a set's own map. Two maps differ in no more places than their sets differ in shingles.
MAP_BITS = 1024


class Sets:
    """The shingle set of each text: sorted distinct 64-bit hashes, and a key that equal sets share."""

    def __init__(self, texts: pa.Array, n: int):
        words = Words(texts, lower=True)
        rolling = Rolling(words.hashes())
        lo = np.arange(len(words.starts))
        doc = np.repeat(np.arange(len(words.counts)), words.counts)
        # a text with fewer words has its whole run as the one shingle
        length = np.minimum(n, words.counts)[doc]
        at = lo[lo + length <= words.first[1:][doc]] if len(lo) else lo
        h = rolling.of(at, at + length[at])
        order = np.lexsort((h, doc[at]))
        h, doc = h[order], doc[at][order]
        new = np.r_[True, (np.diff(h) != 0) | (np.diff(doc) != 0)] if len(h) else np.zeros(0, bool)
        self.hashes = h[new]
        self.bounds = np.searchsorted(doc[new], np.arange(len(words.counts) + 1))
        self.sizes = np.diff(self.bounds)
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(self.hashes + np.uint64(1)))]
        self.keys = signed(mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.sizes.astype(np.uint64)))


    def maps(self) -> pa.Array:
        """For each text the parity of its shingles over ``MAP_BITS`` places, as longs."""
        rows = len(self.sizes)
        place = np.repeat(np.arange(rows), self.sizes) * MAP_BITS + (mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(MAP_BITS - 1)).astype(np.int64)
        bits = np.packbits((np.bincount(place, minlength=rows * MAP_BITS) & 1).astype(bool)).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * (MAP_BITS // 64), pa.int32()), pa.array(bits))


class Fresh:
    """Which sets of a task are met for the first time."""

    def __init__(self):
        self.seen: set[int] = set()

    def rows(self, sets: Sets) -> list[int]:
        out = []
        for k in np.flatnonzero(sets.sizes):
            key = int(sets.keys[k])
            if key not in self.seen:
                self.seen.add(key)
                out.append(int(k))
        return out


def _least_overlap(a: Column, b: Column, percent: int) -> Column:
    return F.ceil((percent * (a + b)) / (100 + percent))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Sizes and positions of a shared shingle leave room for enough common shingles."""
    a, i, b, j = (F.col(c) for c in (f"{x}.n", f"{x}.pos", f"{y}.n", f"{y}.pos"))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (F.least(a - i, b - j) >= _least_overlap(a, b, percent))


def _row_key(text: str) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(text).cast("binary"))


def _labelled(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Per row: ``doc_id``, ``row`` (its text's hash), ``n`` (shingles), ``key`` of the set and ``root``, which linked sets share."""
    spark = docs.sparkSession
    texts = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, row long, n long, key long, map array<long>, chunk int, cells binary"

    names = [x.split()[0] for x in schema.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, counts = Fresh(), np.zeros(COUNT_CELLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = Sets(part.column(1), n)
                for k in fresh.rows(sets):
                    np.add.at(counts, (sets.hashes[sets.bounds[k] : sets.bounds[k + 1]] & np.uint64(COUNT_CELLS - 1)).astype(np.int64), 1)
                rows = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sets.sizes.astype(np.int64)), pa.array(sets.keys), sets.maps(), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        chunks, cells = table_rows(np.minimum(counts, 2**31 - 1).astype(np.int32))
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(chunks), pa.list_(pa.int64())), pa.array(chunks, pa.int32()), pa.array(cells, pa.binary())], names)

    measured = cut_lineage(texts.select("doc_id", "text", _row_key("text").alias("row")).mapInArrow(measure, schema))
    table = spark.sparkContext.broadcast(whole_table(fixed_table(measured.where("chunk is not null")), COUNT_CELLS, "int32"))
    rows = measured.where("chunk is null").select("doc_id", "row", "n", "key")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, often = Fresh(), table.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets, out = Sets(part.column(1), n), ([], [], [], [])
                for k in fresh.rows(sets):
                    h = sets.hashes[sets.bounds[k] : sets.bounds[k + 1]]
                    size = len(h)
                    keep = size - -(-percent * size // 100) + 1
                    rank = (often[h & np.uint64(COUNT_CELLS - 1)].astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
                    first = np.argsort(rank, kind="stable")[:keep]
                    out[0].append(h[first])
                    out[1].append(np.full(keep, sets.keys[k]))
                    out[2].append(np.full(keep, size, np.int32))
                    out[3].append(np.arange(keep, dtype=np.int32))
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(out[0]))), *[pa.array(np.concatenate(c)) for c in out[1:]]], ["shingle", "key", "n", "pos"])

    entries = texts.select("doc_id", "text").mapInArrow(prefixes, "shingle long, key long, n int, pos int")
    entries = entries.repartition(partitions(spark), "shingle").groupBy("shingle", "key").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    by_place = Window.partitionBy("shingle").orderBy("pos", "n", "key")
    me = F.struct("pos", "n", "key")
    listed = entries.select("shingle", me.alias("x"), F.first(me).over(by_place).alias("head"), F.lead("key").over(by_place).alias("after"))
    # lists of one set hold no pair
    lists = cut_lineage(listed.where((F.col("x.key") != F.col("head.key")) | F.col("after").isNotNull()).select("shingle", "x", "head"))

    pair = lambda x, y: (F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b"))
    heads = lists.where(F.col("x.key") != F.col("head.key")).where(_may_link("x", "head", percent)).select(*pair("x", "head")).distinct()
    maps = measured.where("n > 0").select("key", "n", "map").dropDuplicates(["key"])

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose maps differ in few enough places for the sets to link."""
        side = lambda k, n, m: maps.select(F.col("key").alias(k), F.col("n").alias(n), F.col("map").alias(m))
        both = pairs.join(side("a", "na", "ma"), "a").join(side("b", "nb", "mb"), "b")
        apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
        return cut_lineage(both.where(apart <= F.col("na") + F.col("nb") - 2 * _least_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among the pairs: their sets, fetched from the texts, are intersected."""
        pairs = near(pairs)
        wanted = spark.sparkContext.broadcast(bit_filter(pairs.select("a").unionAll(pairs.select("b")), FILTER_BITS))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh = Fresh()
            for batch in batches:
                for part in slices(batch, "text"):
                    sets = Sets(part.column(1), n)
                    found = [k for k in fresh.rows(sets) if may_hold(wanted.value, sets.keys[k : k + 1].view(np.uint64))[0]]
                    values = pa.array([signed(sets.hashes[sets.bounds[k] : sets.bounds[k + 1]]) for k in found], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(sets.keys[found]), values], ["key", "members"])

        members = texts.mapInArrow(fetch, "key long, members array<long>").groupBy("key").agg(F.first("members").alias("members"))
        members = cut_lineage(members)
        both = pairs.join(members.select(F.col("key").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("key").alias("b"), F.col("members").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        sized = both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("both"))
        return cut_lineage(sized.where(f"{100 + percent} * common >= {percent} * both").select("a", "b"))

    first = verified(heads)
    answer = cut_lineage(components(first).select(F.col("node").alias("key"), F.col("root").alias("answer")))
    asked = lists.select("shingle", "x", F.col("x.key").alias("key")).join(answer, "key", "left").select("shingle", "x", F.coalesce("answer", "key").alias("answer"))
    open_lists = asked.groupBy("shingle").agg(F.min("answer").alias("least"), F.max("answer").alias("most")).where("least <> most").select("shingle")
    asked = asked.join(open_lists, "shingle")
    other = asked.select("shingle", F.col("x").alias("y"), F.col("answer").alias("_answer"))
    apart = (F.col("x") < F.col("y")) & (F.col("answer") != F.col("_answer")) & _may_link("x", "y", percent)
    rest = asked.join(other, "shingle").where(apart).select(*pair("x", "y")).distinct().join(heads, ["a", "b"], "left_anti")
    links = first.unionByName(verified(rest))
    found = components(links).select(F.col("node").alias("key"), "root")
    return rows.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` for links at 100 * common >= percent * union.

    Words are runs outside U+0020 and U+0009 to U+000D, A-Z lower-cased; a set is the distinct n-word shingles, with
    fewer words the whole sequence, and empty for null or blank texts, which link with nothing. Equal sets (copies and
    repeated rows) are one set in all steps, however many. ``component_id`` is the smallest id reachable by
    links (null only if all reachable ids are null). Other columns are ignored; an empty table gives no rows.
    """
    labelled = _labelled(docs, n, percent)
    label = cut_lineage(labelled.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    joined = labelled.where("n > 0").join(label, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(labelled.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest id, then the smallest text hash. An id's rows are told apart by their texts; rows without an id, which no id speaks for, stay."""
    labelled = _labelled(docs, n, percent).where("doc_id is not null and n > 0")
    first = cut_lineage(labelled.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first")))
    lost = labelled.join(first, "root").where(F.struct("doc_id", "row") != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    rows = numbered(docs)
    rows = rows.withColumn("_id", F.col(column(docs, "doc_id")).cast("long")).withColumn("_row", _row_key(column(docs, "text")))
    kept = rows.join(lost, ["_id", "_row"], "left_anti").select(*rows.columns)
    again = Window.partitionBy("_id", "_row").orderBy("_row")
    known = kept.where("_id is not null").withColumn("_again", F.row_number().over(again)).where("_again = 1").drop("_again")
    return known.unionByName(kept.where("_id is null")).drop("_id", "_row").toDF(*docs.columns)


def components_sql(n: int = 3, percent: int = 90, table: str = "documents") -> str:
    """The same components in DuckDB SQL, from all pairs that share a shingle."""
    return f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as w from {table}),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) end) as s from d),
size as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as materialized (select x, y from pairs join size p on x = p.doc_id join size q on y = q.doc_id where 100 * k >= {percent} * (p.n + q.n - k)),
reach(doc_id, root) as (select doc_id, doc_id from d union select y, root from reach join links on reach.doc_id = x)
select d.doc_id, cast(coalesce(any_value(n), 0) as bigint) as n_shingles, min(root) as component_id from d join reach on d.doc_id = reach.doc_id left join size on d.doc_id = size.doc_id group by d.doc_id"""
