"""Resolve module strings to files of the same repo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.paths import file_dir, segments
from factloom.session import unbroadcast

# Extensions tried for relative imports and package entry files.
RELATIVE_EXTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "dart")
INDEX_EXTS = ("ts", "tsx", "js", "jsx", "mjs")


def fold_path(base_dir: Column, relative: Column) -> Column:
    """Join and fold ``.`` and ``..``; going above the root stays at the root."""
    none = F.array().cast("array<string>")
    parts = F.concat(segments(base_dir), F.split(relative, "/"))
    folded = F.aggregate(
        parts,
        none,
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def _ranked(*paths: Column) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("prio"), p.alias("to_path")) for i, p in enumerate(paths)])


def resolve_imports(imports: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(repo, from_path, to_module, to_path): exact, unambiguous edges only.

    Every import becomes a few candidate paths that are equi-joined with the file list.
    Relative imports need exactly one hit; the other forms take their first hit.
    """
    known = unbroadcast(files.select("repo", F.col("path").alias("to_path")).distinct())
    asked = imports.select("repo", "from_path", "to_module").distinct()
    module = F.col("to_module")
    relative = module.rlike(r"^\.\.?/")
    norm = fold_path(file_dir(F.col("from_path")), module)
    rel_paths = [norm] + [F.concat(norm, F.lit(s + e)) for e in RELATIVE_EXTS for s in (".", "/index.")]
    crate = F.replace(F.substr(module, F.lit(8)), F.lit("::"), F.lit("/"))
    candidates = (
        F.when(F.startswith(module, F.lit("res://")), _ranked(F.substr(module, F.lit(7))))
        .when(
            F.startswith(module, F.lit("crate::")),
            _ranked(F.concat(F.lit("src/"), crate, F.lit(".rs")), F.concat(F.lit("src/"), crate, F.lit("/mod.rs"))),
        )
        .when(relative & (norm != ""), _ranked(*rel_paths))
    )
    plain = asked.select("*", relative.alias("strict"), F.explode(candidates).alias("c")).select(
        "repo", "from_path", "to_module", "strict", "c.prio", "c.to_path"
    )
    hits = plain.join(known, ["repo", "to_path"])
    if packages is not None:
        hits = hits.unionByName(_package_candidates(asked.where(~relative), packages, known))
    return (
        hits.groupBy("repo", "from_path", "to_module")
        .agg(
            F.countDistinct("to_path").alias("n"),
            F.first("strict").alias("strict"),
            F.min_by("to_path", F.struct("prio", "to_path")).alias("to_path"),
        )
        .where(~F.col("strict") | (F.col("n") == 1))
        .select("repo", "from_path", "to_module", "to_path")
    )


def _package_candidates(asked: DataFrame, packages: DataFrame, known: DataFrame) -> DataFrame:
    pkg = unbroadcast(packages.select("repo", F.col("name").alias("package"), "dir"))
    whole = asked.withColumn("package", F.col("to_module")).join(pkg, ["repo", "package"])
    entry = [F.concat(F.col("dir"), F.lit(f"{s}/index.{e}")) for e in INDEX_EXTS for s in ("", "/src")]
    rows = whole.select("repo", "from_path", "to_module", F.lit(False).alias("strict"), F.explode(_ranked(*entry)).alias("c"))
    rows = rows.select("repo", "from_path", "to_module", "strict", "c.prio", "c.to_path").join(known, ["repo", "to_path"])
    fallback = whole.select(
        "repo", "from_path", "to_module", F.lit(False).alias("strict"), F.lit(99).alias("prio"), F.col("dir").alias("to_path")
    )
    # Deep imports: every proper prefix of the module at a slash may be a package.
    parts = F.split("to_module", "/")
    cuts = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1))
    deep = (
        asked.select("*", F.explode(cuts).alias("cut"))
        .withColumn("package", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), "/"))
        .join(pkg, ["repo", "package"])
        .withColumn("rest", F.expr("array_join(slice(split(to_module, '/'), cut + 1, size(split(to_module, '/'))), '/')"))
        .select(
            "repo",
            "from_path",
            "to_module",
            F.lit(False).alias("strict"),
            (100 + F.col("cut")).alias("prio"),
            F.concat_ws("/", "dir", "rest").alias("to_path"),
        )
        .join(known, ["repo", "to_path"])
    )
    return rows.unionByName(fallback).unionByName(deep)


def file_imports(edges: DataFrame) -> DataFrame:
    """Resolved edges seen from both ends: (repo, file, direction, other)."""
    out = edges.select("repo", F.col("from_path").alias("file"), F.lit("imports").alias("direction"), F.col("to_path").alias("other"))
    back = edges.select("repo", F.col("to_path").alias("file"), F.lit("imported_by").alias("direction"), F.col("from_path").alias("other"))
    return out.unionByName(back).distinct()
