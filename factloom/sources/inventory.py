"""File inventory: what is scanned, what is only listed, what nobody can read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paths import file_dir, file_ext, file_name, in_skipped_dir

# Languages and the extensions they are known by.
LANGUAGES = {
    "Rust": ("rs",),
    "Python": ("py",),
    "TypeScript/JavaScript": ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"),
    "Vue": ("vue",),
    "Go": ("go",),
    "Java/Kotlin": ("java", "kt"),
    "Ruby": ("rb", "jbuilder"),
    "Elixir": ("ex", "exs"),
    "PHP": ("php",),
    "C#": ("cs",),
    "Swift": ("swift",),
    "Objective-C": ("m", "mm"),
    "C/C++": ("c", "h", "cpp", "hpp", "cc", "cxx"),
    "Scala": ("scala",),
    "Dart": ("dart",),
    "Haskell": ("hs",),
    "Clojure": ("clj", "cljs"),
    "GraphQL": ("graphql", "gql"),
    "Protocol Buffers": ("proto",),
    "Gherkin": ("feature",),
    "GDScript": ("gd",),
    "Godot Scene": ("tscn",),
    "Godot Project Config": ("godot",),
    "Terraform": ("tf",),
    "Kubernetes Manifest": ("yaml", "yml"),
}
SCHEMA_EXTS = ("prisma", "sql")
UNSUPPORTED = {"Shell": ("sh", "bash", "zsh", "fish")}
# Extensions known to hold no source code.
NON_CODE_EXTS = (
    "md", "markdown", "txt", "rst", "adoc", "json", "toml", "ini", "cfg", "conf", "lock", "lockb", "env", "editorconfig", "gitignore",
    "gitattributes", "code-workspace", "tsbuildinfo", "png", "jpg", "jpeg", "gif", "svg", "ico", "bmp", "webp", "avif", "woff", "woff2", "ttf", "eot",
    "otf", "css", "scss", "sass", "less", "html", "htm", "xml", "csv", "tsv", "log", "map", "pdf", "zip", "tar", "gz", "7z", "rar", "mp3", "mp4",
    "wav", "mov", "avi", "webm", "wasm", "sh", "bat", "ps1", "makefile", "dockerfile", "license", "lic", "ipynb", "pyc", "class", "o", "so", "dylib",
    "dll", "a", "exe", "db", "sqlite", "sqlite3", "db-wal", "db-shm", "db-journal", "icns", "bak", "tag", "example", "local", "development",
    "template", "mod", "sum", "service", "plist", "unit", "1", "man", "rdoc", "tex", "doc", "docx", "epub", "pptx", "xlsx", "dbml", "jsonl", "patch",
    "snap", "desktop", "ru", "mdx", "erb", "vsix", "tgz", "pak", "asar", "nupkg", "crx", "appimage", "deb", "rpm", "msi", "dmg", "bin", "dat", "raw",
    "node", "whl", "egg", "jar", "aar", "war", "apk", "ipa",
)
SCANNABLE_EXTS = tuple(e for group in (*LANGUAGES.values(), SCHEMA_EXTS, *UNSUPPORTED.values()) for e in group)
# Extensions of the two metadata-only listings.
DOCUMENT_EXTS = ("pdf", "docx", "txt", "md", "odt")
PHOTO_EXTS = ("jpg", "jpeg", "png", "gif", "heic", "webp")


def read_tree(spark: SparkSession, root: str, repo: str, glob: str = "*", content: bool = True) -> DataFrame:
    """Files below ``root`` as rows; without ``content`` no file is opened.

    Size and time filters reach the reader, and ``glob`` is applied while listing.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rel = F.expr(f"substring_index(path, '{root.rstrip('/')}/', -1)")
    out = df.select(
        F.lit(repo).alias("repo"),
        rel.alias("path"),
        F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        *([F.decode("content", "UTF-8").alias("content")] if content else []),
    )
    return out.withColumn("ext", file_ext(F.col("path")))


def _ancestors(path: Column) -> Column:
    """All directories above a file."""
    parts = F.split(path, "/")
    return F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def venv_roots(files: DataFrame) -> DataFrame:
    """(repo, dir) of Python environments: a pyvenv.cfg, or lib/python*/site-packages below."""
    marked = files.where(file_name(F.col("path")) == "pyvenv.cfg").select("repo", file_dir(F.col("path")).alias("dir"))
    shaped = F.regexp_extract("path", r"^(.+?)/lib(?:64)?/python[^/]*/site-packages/", 1)
    return marked.unionByName(files.select("repo", shaped.alias("dir"))).where(F.col("dir") != "").distinct()


def visible_files(files: DataFrame, excludes: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """Files outside skipped directories, environments and the repo's excluded prefixes. ``tree`` lists the files that mark environments, by default ``files``."""
    kept = files.where(~in_skipped_dir(F.col("path")))
    roots = venv_roots(files if tree is None else tree)
    if excludes is not None:
        bare = excludes.select("repo", F.regexp_replace("prefix", "/+$", "").alias("dir"))
        roots = roots.unionByName(bare).distinct()
    above = kept.select("repo", "path", F.explode(F.concat(_ancestors(F.col("path")), F.array("path"))).alias("dir"))
    hidden = above.join(roots, ["repo", "dir"], "left_semi").select("repo", "path").distinct()
    return kept.join(hidden, ["repo", "path"], "left_anti")


def scannable_files(files: DataFrame, excludes: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """The scan set: files of a known extension, and not larger than ``max_bytes`` if that is given.

    Both are plain filters on the files, so a reader that prunes by size gets the size; environments are found in a
    listing of names alone. What ``max_bytes`` leaves out is in ``oversized_files``.
    """
    ext = file_ext(F.col("path"))
    wanted = files.where(ext.isin(*SCANNABLE_EXTS))
    if max_bytes is not None:
        wanted = wanted.where(F.col("size") <= max_bytes)
    return visible_files(wanted, excludes, files.select("repo", "path"))


def oversized_files(files: DataFrame, max_bytes: int, excludes: DataFrame | None = None) -> DataFrame:
    """(repo, path, size) of visible files of a known extension that a scan with ``max_bytes`` leaves out."""
    large = files.where(file_ext(F.col("path")).isin(*SCANNABLE_EXTS) & (F.col("size") > max_bytes)).select("repo", "path", "size")
    return visible_files(large, excludes, files.select("repo", "path"))


def unclassified_files(files: DataFrame, excludes: DataFrame | None = None) -> DataFrame:
    """(repo, path, ext) of visible files that are neither scannable nor known to be no code."""
    ext = file_ext(F.col("path"))
    odd = ext.isNotNull() & ~ext.isin(*SCANNABLE_EXTS) & ~ext.isin(*NON_CODE_EXTS)
    return visible_files(files, excludes).select("repo", "path", ext.alias("ext")).where(odd)


def blind_files(files: DataFrame, excludes: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """(repo, path) no extractor reads: unsupported languages, unclassified files and those over ``max_bytes``."""
    shell = [e for g in UNSUPPORTED.values() for e in g]
    known = visible_files(files, excludes).where(file_ext(F.col("path")).isin(*shell)).select("repo", "path")
    known = known.unionByName(unclassified_files(files, excludes).select("repo", "path"))
    return known if max_bytes is None else known.unionByName(oversized_files(files, max_bytes, excludes).select("repo", "path")).distinct()


def folder_listing(files: DataFrame, folder: str, exts: tuple[str, ...], domain: str) -> DataFrame:
    """Metadata-only resources of one folder, not its subfolders; contents are never read."""
    path = F.col("path")
    hit = (file_dir(path) == folder.strip("/")) & file_ext(path).isin(*exts)
    return files.where(hit).select(
        "repo",
        F.concat(F.lit(domain + ":"), path).alias("id"),
        F.lit(domain).alias("domain"),
        path.alias("location"),
        F.create_map(F.lit("filename"), file_name(path), F.lit("extension"), file_ext(path), F.lit("bytes"), F.col("size").cast("string")).alias("attributes"),
        F.lit("Derived").alias("tier"),
    )


def language_table(spark: SparkSession) -> DataFrame:
    rows = [(e, n, True) for n, es in LANGUAGES.items() for e in es] + [(e, n, False) for n, es in UNSUPPORTED.items() for e in es]
    return spark.createDataFrame(rows, "ext string, language string, supported boolean")


def coverage_report(files: DataFrame, excludes: DataFrame | None = None) -> DataFrame:
    """Per repo: files per supported language, per unsupported language, per unclassified extension."""
    seen = visible_files(files, excludes).groupBy("repo", file_ext(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    # About forty fixed rows, so the size of the broadcast side is known.
    known = F.broadcast(language_table(files.sparkSession))
    rows = seen.join(known, "ext", "left").where(
        F.col("language").isNotNull() | (F.col("ext").isNotNull() & ~F.col("ext").isin(*NON_CODE_EXTS, *SCHEMA_EXTS))
    )
    return rows.groupBy(
        "repo",
        F.coalesce("language", F.concat(F.lit("."), F.col("ext"))).alias("language"),
        F.when(F.col("supported"), "supported").when(F.col("supported").isNotNull(), "unsupported").otherwise("unclassified").alias("support"),
    ).agg(F.sum("files").alias("files"))
