"""Who depends on what: bounded breadth-first search over edge tables, all starts at once.

The search runs from distinct files, whatever keys they belong to, over files that are imported themselves, so its rows follow pairs of
such files; keys meet its result before the last hop, which alone meets the files that nobody imports. Targets that hold more than a task's share of the edges are split over several join keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import file_stem
from factloom.session import cut_lineage, unbroadcast

DEPTH = 3
#: Layers of a search are paths over and over.
PACKED = {"compression": "zstd"}


def _split(degree: DataFrame) -> DataFrame:
    """(repo, path, parts) of the targets with more than a task's share of the edges, by their ``n`` edges."""
    share = max(1, (degree.agg(F.sum("n")).first()[0] or 0) // int(degree.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut_lineage(degree.where(F.col("n") > share).select("repo", "path", F.ceil(F.col("n") / share).cast("int").alias("parts")))


def _hubs(back: DataFrame) -> DataFrame:
    """(repo, path, parts) of the targets with more than a task's share of the edges: at most as many as there are partitions."""
    return _split(back.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n")))


def _salted(back: DataFrame, hubs: DataFrame) -> DataFrame:
    """The edges with a ``salt``: those of a hub under as many keys as it has parts."""
    many = back.join(F.broadcast(hubs), ["repo", "path"], "left")
    return many.withColumn("salt", F.coalesce(F.pmod(F.hash("from_path"), F.col("parts")), F.lit(0))).drop("parts")


def _every_salt(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """``rows`` (repo, path, ...) once for each ``salt`` under which the edges to their path lie."""
    keys = F.coalesce(F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.lit(0)))
    return rows.join(F.broadcast(hubs), ["repo", "path"], "left").withColumn("salt", F.explode(keys)).drop("parts")


def _backwards(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The edges between different files as (repo, path, from_path, salt), those of them that lead from imported files, the imported files as (repo, path, n) with their edges counted, and the hubs.

    Only over edges that lead from imported files a search goes on.
    """
    back = edges.where("from_path <> to_path").select("repo", F.col("to_path").alias("path"), "from_path")
    heads = cut_lineage(back.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n")), **PACKED)
    known = heads.select("repo", F.col("path").alias("from_path"))
    inner = cut_lineage(back.join(unbroadcast(known), ["repo", "from_path"], "left_semi").distinct(), **PACKED)
    hubs = _split(heads)
    return _salted(back, hubs), _salted(inner, hubs), heads, hubs


def _walks(files: DataFrame, back: DataFrame, hubs: DataFrame, hops: int) -> DataFrame:
    """(repo, start, path, depth): where walks of each length end that begin at a file; depth 0 is the file itself.

    A file may end walks of several lengths, and the last ones may come more than once; the shortest is its distance. Whoever asks groups the
    rows anyway, so no layer is compared with those before it. Each hop is one join of the newest layer with the edges and ends in a
    written table, so the plan stays flat and a lost executor costs one hop; the last one goes straight into the grouping.
    """
    layer = cut_lineage(files.select("repo", "path").distinct().select("repo", F.col("path").alias("start"), "path"), **PACKED)
    found = layer.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        step = _every_salt(layer, hubs).join(back, ["repo", "path", "salt"]).select("repo", "start", F.col("from_path").alias("path"))
        # walks of one edge are distinct as the edges are
        if depth < hops:
            step = cut_lineage(step.distinct() if depth > 1 else step, **PACKED)
        layer = step
        found = found.unionByName(layer.withColumn("depth", F.lit(depth)))
    return found


#: Rows that one task groups after the last hop.
TASK_ROWS = 2_000_000


def _last_hop(near: DataFrame, own: DataFrame, back: DataFrame, heads: DataFrame, hubs: DataFrame) -> DataFrame:
    """(repo, path, key, depth): the least depth of each file in ``own``, or one hop beyond ``near``; both are (repo, path, key, depth).

    Most files are imported by none, so they are met by this hop alone. Its rows are counted beforehand and grouped by as many tasks as they need.
    """
    site = ["repo", "path"]
    near = cut_lineage(near.groupBy(*site, "key").agg(F.min("depth").alias("depth")), **PACKED)
    total = near.groupBy(*site).agg(F.count(F.lit(1)).alias("k")).join(unbroadcast(heads), site).agg(F.sum(F.col("k") * F.col("n"))).first()[0] or 0
    parts = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    on = back.join(unbroadcast(_every_salt(near, hubs)), [*site, "salt"]).select("repo", F.col("from_path").alias("path"), "key", (F.col("depth") + 1).alias("depth"))
    return on.unionByName(own.select(*site, "key", "depth")).repartition(parts, *site).groupBy(*site, "key").agg(F.min("depth").alias("depth"))


def _levels(files: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(repo, start, path, depth): each file by the first hop that reaches it; depth 0 is the start itself."""
    back, inner, heads, hubs = _backwards(edges)
    own = cut_lineage(files.select("repo", "path").distinct(), **PACKED)
    near = _walks(own.join(unbroadcast(heads), ["repo", "path"], "left_semi"), inner, hubs, hops - 1).where(F.col("depth") < hops)
    found = _last_hop(near.withColumnRenamed("start", "key"), own.withColumn("key", F.col("path")).withColumn("depth", F.lit(0)), back, heads, hubs)
    return found.select("repo", F.col("key").alias("start"), "path", "depth")


#: A list of files up to this long may be sent to the edges; a longer one is merged with them.
FEW_FILES = 100_000


def _leading(edges: DataFrame, ends: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """The edges that walks of at most ``hops`` edges from the files ``ends`` (repo, path) can use, and all files on such walks.

    ``ends`` holds each file once. What they lead to is followed forwards hop by hop until nothing new comes, so a search that is asked for few files reads few edges.
    """
    fresh = known = ends
    kept = edges.select("repo", "from_path", "to_path").limit(0)
    for _ in range(hops):
        n = fresh.count()
        if n == 0:
            break
        side = fresh.withColumnRenamed("path", "from_path")
        part = cut_lineage(edges.select("repo", "from_path", "to_path").join(side if n <= FEW_FILES else unbroadcast(side), ["repo", "from_path"], "left_semi"), **PACKED)
        kept = kept.unionByName(part)
        fresh = cut_lineage(part.select("repo", F.col("to_path").alias("path")).distinct().join(unbroadcast(known), ["repo", "path"], "left_anti"), **PACKED)
        known = known.unionByName(fresh)
    return kept, known


def reach(starts: DataFrame, edges: DataFrame, hops: int = DEPTH, extra: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(repo, key, path, depth): nodes that reach a start of ``key`` over ``edges`` within ``hops``.

    ``starts`` is (repo, key, path), ``edges`` is (repo, from_path, to_path) read backwards,
    ``extra`` (repo, key, path) joins the first hop. Files of several keys are searched once. With ``ends`` (repo, path) only these nodes are
    asked for: edges and starts on no walk from them are left out, and the rows are those of the whole search whose path is among them.
    """
    own = starts.select("repo", "key", "path", F.lit(0).alias("late"))
    if extra is not None:
        own = own.unionByName(extra.select("repo", "key", "path", F.lit(1).alias("late")))
    if ends is not None:
        ends = cut_lineage(ends.select("repo", "path").distinct(), **PACKED)
        edges, known = _leading(edges, ends, hops)
        own = own.join(unbroadcast(known), ["repo", "path"], "left_semi")
    members = cut_lineage(own.distinct(), **PACKED)
    back, inner, heads, hubs = _backwards(edges)
    imported = cut_lineage(members.join(unbroadcast(heads), ["repo", "path"], "left_semi"), **PACKED)
    walks = _walks(imported, inner, hubs, hops - 1)
    near = imported.withColumnRenamed("path", "start").join(walks, ["repo", "start"]).withColumn("depth", F.col("depth") + F.col("late")).where(F.col("depth") < hops)
    own = members.withColumnRenamed("late", "depth")
    if ends is not None:
        back = back.join(unbroadcast(ends.withColumnRenamed("path", "from_path")), ["repo", "from_path"], "left_semi")
        own = own.join(unbroadcast(ends), ["repo", "path"], "left_semi")
    rows = _last_hop(near.select("repo", "path", "key", "depth"), own, back, heads, hubs)
    # a key's own files are found at depth 0
    return rows.where("depth > 0").select("repo", "key", "path", "depth")


def reach_counts(starts: DataFrame, edges: DataFrame, hops: int = DEPTH, extra: DataFrame | None = None) -> DataFrame:
    """(repo, key, n): how many nodes ``reach`` returns."""
    return reach(starts, edges, hops, extra).groupBy("repo", "key").agg(F.count(F.lit(1)).alias("n"))


def reach_at_least(starts: DataFrame, edges: DataFrame, n: int, hops: int = DEPTH) -> DataFrame:
    """(repo, key, n): the number of nodes ``reach`` would return, up to ``n``; exact below it, keys without any left out.

    Every file hands on at most ``n + 1`` of its importers and every key keeps at most as many: where that leaves some out there
    are ``n`` others without the key's own file, so the answer stays right. ``starts`` has one file per key. Rows are bounded by keys.
    """
    few = Window.partitionBy("repo", "path").orderBy("from_path")
    back = edges.where("from_path <> to_path").select("repo", F.col("to_path").alias("path"), "from_path").distinct()
    back = cut_lineage(back.withColumn("k", F.row_number().over(few)).where(F.col("k") <= n + 1).drop("k"))
    kept = Window.partitionBy("repo", "key").orderBy("path")
    own = cut_lineage(starts.select("repo", "key", "path").distinct())
    seen = own
    for _ in range(hops):
        step = seen.join(back, ["repo", "path"]).select("repo", "key", F.col("from_path").alias("path"))
        fresh = step.unionByName(seen).distinct().join(own, ["repo", "key", "path"], "left_anti")
        found = fresh.withColumn("k", F.row_number().over(kept)).where(F.col("k") <= n + 1).drop("k")
        seen = cut_lineage(found.unionByName(own))
    counted = seen.join(own, ["repo", "key", "path"], "left_anti").groupBy("repo", "key").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("n", F.least("n", F.lit(n).cast("bigint")))


def file_dependents(files: DataFrame, edges: DataFrame, hops: int = DEPTH) -> DataFrame:
    """(repo, key, path, depth): files that import each file ``key`` within ``hops``."""
    return _levels(files, edges, hops).where("depth > 0").withColumnRenamed("start", "key")


def concept_owners(targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, key, path, symbol): symbols linked to, or named like, each target."""
    t = targets.select("repo", F.col("target").alias("key")).distinct()
    linked = t.join(
        symbols.select("repo", F.col("linked_concept").alias("key"), "path", F.col("name").alias("symbol")),
        ["repo", "key"],
    )
    named = t.join(symbols.select("repo", F.col("name").alias("key"), "path", F.col("name").alias("symbol")), ["repo", "key"])
    return linked.unionByName(named).distinct()


def _tails(parts: Column, count: int) -> Column:
    """The last 1, 2, ... ``count`` parts of a list, joined by slashes, as (length, tail)."""
    n = F.size(parts)
    return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(count)), F.lit(1))), lambda k: k <= n), lambda k: F.struct(k.alias("length"), F.array_join(F.slice(parts, F.greatest(n - k + 1, F.lit(1)), k), "/").alias("tail")))


#: A module string names no more parts of a path than this; what stands before them would not tell files apart.
TAIL_PARTS = 12


def tail_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, from_path, to_module, to_path, matched): files whose path ends like the module string, for imports that resolve to no file.

    ``imports`` is (repo, from_path, to_module) of unresolved imports. A module is read as parts between slashes, dots, colons and backslashes,
    a file as its folders and stem, case aside; ``index``, ``mod``, ``main`` and ``__init__`` stand for their folder as well. Each import takes the files that match its longest tail,
    ``matched`` parts long - all of them, so an edge is a resemblance, not a fact. Tails are looked up among distinct
    tails first; files are joined only at the length that wins.
    """
    known = files.select("repo", "path").distinct()
    stem = F.lower(file_stem(F.col("path")))
    folders = F.filter(F.split(F.lower(F.regexp_replace("path", "[^/]*$", "")), "/"), lambda x: x != "")
    as_file = known.select("repo", F.col("path").alias("to_path"), F.concat(folders, F.array(stem)).alias("parts"))
    as_folder = known.where(stem.isin("index", "mod", "main", "__init__") & (F.size(folders) > 0)).select("repo", F.col("path").alias("to_path"), folders.alias("parts"))
    ends = as_file.unionByName(as_folder).select("repo", "to_path", F.explode(_tails(F.col("parts"), TAIL_PARTS)).alias("t")).select("repo", "to_path", "t.tail").distinct()
    bare = F.regexp_replace(F.lower("to_module"), r"\.(?:[cm]?[jt]sx?|vue|py|rb|php|dart|proto|h|hpp)$", "")
    wanted = imports.select("repo", "from_path", "to_module", F.filter(F.split(bare, r"[/.:\\\s]+"), lambda x: x != "").alias("parts")).distinct()
    asked = wanted.select("repo", "to_module", "parts").distinct().select("repo", "to_module", F.explode(_tails(F.col("parts"), TAIL_PARTS)).alias("t"))
    best = asked.select("repo", "to_module", "t.length", "t.tail").join(unbroadcast(ends.select("repo", "tail").distinct()), ["repo", "tail"])
    best = best.groupBy("repo", "to_module").agg(F.max(F.struct("length", "tail")).alias("t")).select("repo", "to_module", "t.length", "t.tail")
    hits = best.join(unbroadcast(ends), ["repo", "tail"]).select("repo", "to_module", "to_path", F.col("length").alias("matched"))
    return wanted.select("repo", "from_path", "to_module").join(unbroadcast(hits), ["repo", "to_module"]).where("from_path <> to_path").select("repo", "from_path", "to_module", "to_path", "matched")


def _callers(owners: DataFrame, call_edges: DataFrame | None) -> DataFrame | None:
    """Direct callers of the targets' own symbols."""
    if call_edges is None:
        return None
    # not made distinct here: the files of all keys are, where the search takes them
    callers = call_edges.select("repo", F.col("callee").alias("symbol"), F.col("from_path"))
    return owners.join(callers, ["repo", "symbol"]).select("repo", "key", F.col("from_path").alias("path"))


def structural_dependents(
    targets: DataFrame, symbols: DataFrame, edges: DataFrame, call_edges: DataFrame | None = None, depth: int = DEPTH, inexact: DataFrame | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """(repo, target, path, depth): files that depend on the files owning each target.

    Direct callers of the target's own symbols join at depth 1. With ``inexact`` edges, as ``tail_edges`` finds them, a fifth column ``exact`` says
    whether the file is found over ``edges`` and calls alone; its depth is then the one over those. With ``ends`` (repo, path) only these files are listed.
    """
    owners = cut_lineage(concept_owners(targets, symbols))
    starts, extra = owners.select("repo", "key", "path"), _callers(owners, call_edges)
    found = reach(starts, edges, depth, extra, ends).withColumnRenamed("key", "target")
    if inexact is None:
        return found
    sure = cut_lineage(found)
    wide = reach(starts, edges.select("repo", "from_path", "to_path").unionByName(inexact.select("repo", "from_path", "to_path")), depth, extra, ends).withColumnRenamed("key", "target")
    loose = wide.join(sure.select("repo", "target", "path"), ["repo", "target", "path"], "left_anti")
    return sure.withColumn("exact", F.lit(True)).unionByName(loose.withColumn("exact", F.lit(False)))


def structural_counts(targets: DataFrame, symbols: DataFrame, edges: DataFrame, call_edges: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """(repo, target, structural): how many files ``structural_dependents`` would list for each target."""
    owners = cut_lineage(concept_owners(targets, symbols))
    counts = reach_counts(owners.select("repo", "key", "path"), edges, depth, _callers(owners, call_edges))
    return counts.select("repo", F.col("key").alias("target"), F.col("n").alias("structural"))


def type_symbols(symbols: DataFrame) -> DataFrame:
    """(repo, path, via): the type names that files declare."""
    return symbols.where(F.col("kind").isin("Class", "Interface")).select("repo", "path", F.col("name").alias("via")).distinct()


def via_symbols(dependents: DataFrame, symbols: DataFrame) -> DataFrame:
    """Type names declared in each dependent file, one row each.

    Dependents may be searched with ``ends=type_symbols(symbols)``: no other file has a row.
    """
    return dependents.join(type_symbols(symbols), ["repo", "path"])
