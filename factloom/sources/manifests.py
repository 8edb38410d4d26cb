"""Facts from project manifests: lineage files, workspaces, containers, rule-like notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.paths import file_dir, file_name
from factloom.functions.words import slugify
from factloom.session import cut_lineage

NODE = "struct<resource_type:string,name:string,original_file_path:string,relation_name:string,depends_on:struct<nodes:array<string>>>"


# -- lineage ---------------------------------------------------------------------------
def _nodes(files: DataFrame) -> DataFrame:
    hit = files.where(F.col("path").rlike(r"(^|/)(target|dbt)/manifest\.json$"))
    root = F.regexp_replace(F.col("path"), r"(^|/)(target|dbt)/manifest\.json$", "")
    parsed = F.from_json("content", f"nodes map<string,{NODE}>")["nodes"]
    m = hit.select("repo", F.col("path").alias("manifest"), F.when(root == "", "").otherwise(F.concat(root, F.lit("/"))).alias("prefix"), parsed.alias("nodes"))
    return m.select("repo", "manifest", "prefix", F.explode("nodes").alias("id", "n"))


def _placed(prefix, raw):
    return F.when(F.coalesce(raw, F.lit("")) == "", None).otherwise(F.when(F.startswith(raw, prefix), raw).otherwise(F.concat(prefix, raw)))


def lineage_symbols(files: DataFrame) -> DataFrame:
    """(repo, path, name, kind, line, linked_concept, observation) of models and sources."""
    n = _nodes(files).where(F.col("n.resource_type").isin("model", "source") & (F.coalesce("n.name", F.lit("")) != ""))
    last = F.lower(F.regexp_replace(F.element_at(F.split("n.relation_name", r"\."), -1), '^"+|"+$', ""))
    return n.select(
        "repo",
        F.coalesce(_placed(F.col("prefix"), F.col("n.original_file_path")), F.col("manifest")).alias("path"),
        F.col("n.name").alias("name"),
        F.lit("Class").alias("kind"),
        F.lit(1).alias("line"),
        F.coalesce(last, F.lower("n.name")).alias("linked_concept"),
        F.lit("Lexical").alias("observation"),
    ).distinct()


def lineage_imports(files: DataFrame) -> DataFrame:
    """(repo, from_path, to_module): one edge per dependency; the id when its file is unknown."""
    nodes = cut_lineage(_nodes(files).select("repo", "manifest", "prefix", "id", "n"))
    n = nodes.where(F.col("n.resource_type").isin("model", "source") & (F.coalesce("n.name", F.lit("")) != ""))
    d = n.select("repo", "manifest", "prefix", F.col("n.original_file_path").alias("of"), F.explode("n.depends_on.nodes").alias("id"))
    known = nodes.select("repo", "manifest", "id", F.col("n.original_file_path").alias("to"))
    d = d.join(known, ["repo", "manifest", "id"], "left")
    from_path, to = F.coalesce(_placed(F.col("prefix"), F.col("of")), F.col("manifest")), F.coalesce(_placed(F.col("prefix"), F.col("to")), F.col("id"))
    return d.select("repo", from_path.alias("from_path"), to.alias("to_module")).distinct()


# -- workspaces -------------------------------------------------------------------------
def workspace_packages(files: DataFrame) -> DataFrame:
    """(repo, name, dir) of workspace members of package.json and Cargo.toml roots."""
    name = file_name(F.col("path"))
    m = files.where(name.isin("package.json", "Cargo.toml")).select("repo", name.alias("file"), file_dir(F.col("path")).alias("dir"), "content")
    js = F.col("file") == "package.json"
    listed = F.coalesce(F.get_json_object("content", "$.workspaces.packages"), F.get_json_object("content", "$.workspaces"))
    members = F.regexp_extract("content", r"(?s)\[workspace\].*?members\s*=\s*\[([^\]]*)\]", 1)
    patterns = F.regexp_extract_all(F.when(js, F.coalesce(listed, F.lit(""))).otherwise(members), F.lit(r"[\"']([^\"']+)[\"']"), F.lit(1))
    cargo = F.regexp_extract("content", r"(?s)\[package\].*?name\s*=\s*[\"']([^\"']+)", 1)
    own = F.when(js, F.get_json_object("content", "$.name")).otherwise(cargo)
    roots = m.select("repo", "file", F.col("dir").alias("root"), F.explode(patterns).alias("pattern"))
    full = F.when(F.col("root") == "", F.col("pattern")).otherwise(F.concat_ws("/", "root", "pattern"))
    roots = roots.select("repo", "file", F.regexp_replace(F.regexp_replace(full, r"^\./", ""), r"/\*+$", "").alias("at"), full.rlike(r"/\*+$").alias("below"))
    mem = m.select("repo", "file", "dir", own.alias("name")).where(F.coalesce("name", F.lit("")) != "")
    spot = mem.select("*", F.explode(F.array(F.struct(F.col("dir").alias("at"), F.lit(False).alias("below")), F.struct(file_dir(F.col("dir")).alias("at"), F.lit(True).alias("below")))).alias("s"))
    spot = spot.select("repo", "file", "dir", "name", "s.at", "s.below")
    return spot.join(roots, ["repo", "file", "at", "below"]).select("repo", "name", "dir").distinct()


# -- containers ------------------------------------------------------------------------
def base_images(files: DataFrame) -> DataFrame:
    """(repo, path, position, image): FROM lines of Dockerfiles, in order."""
    hit = files.where(file_name(F.col("path")).rlike(r"^Dockerfile(\..+)?$|\.Dockerfile$"))
    images = F.filter(F.transform(F.split("content", "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:FROM|from)\s+(\S+)", 1)), lambda x: x != "")
    return hit.select("repo", "path", F.posexplode(images).alias("position", "image"))


def _unquoted(c):
    return F.regexp_replace(F.trim(c), "^[\"']|[\"']$", "")


def compose_services(files: DataFrame) -> DataFrame:
    """(repo, path, service, image, ports, build_context, dockerfile) of compose files.

    Lines carry their section and service by running windows inside one file.
    """
    hit = files.where(file_name(F.col("path")).rlike(r"^(docker-)?compose(\.[\w-]+)?\.ya?ml$"))
    lines = hit.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("n", "raw"))
    lines = lines.where((F.trim("raw") != "") & ~F.startswith(F.ltrim("raw"), F.lit("#")))
    lines = lines.withColumn("indent", F.length("raw") - F.length(F.ltrim("raw"))).withColumn("t", F.trim("raw"))
    run = Window.partitionBy("repo", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.last(F.when(F.col("indent") == 0, F.col("t")), ignorenulls=True).over(run)
    inside = lines.withColumn("section", section).where((F.col("section") == "services:") & (F.col("indent") > 0))
    inside = inside.withColumn("level", F.min("indent").over(Window.partitionBy("repo", "path")))
    head = (F.col("indent") == F.col("level")) & F.col("t").rlike(r"^[^\s:]+:$")
    inside = inside.withColumn("service", F.last(F.when(head, F.regexp_replace("t", ":$", "")), ignorenulls=True).over(run))
    body = inside.where(F.col("service").isNotNull())
    key = F.when(F.col("t").rlike(r"^(image|build|context|dockerfile):\s*\S|:$") & ~F.col("t").rlike(r"^(context|dockerfile):"), F.regexp_extract("t", r"^([^:\s]+):", 1))
    by_service = Window.partitionBy("repo", "path", "service").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("key", F.last(key, ignorenulls=True).over(by_service))
    value = lambda name: _unquoted(F.regexp_extract("t", rf"^{name}:\s*(.+)$", 1))
    has = lambda name: F.col("t").rlike(rf"^{name}:\s*\S")
    ports = F.collect_list(F.when((F.col("key") == "ports") & F.startswith("t", F.lit("- ")), F.struct("n", _unquoted(F.substr("t", F.lit(3))).alias("p"))))
    context = F.when(has("build"), value("build")).when((F.col("key") == "build") & has("context"), value("context"))
    return body.groupBy("repo", "path", "service").agg(
        F.max_by(F.when(has("image"), value("image")), F.when(has("image"), F.col("n"))).alias("image"),
        F.array_join(F.transform(F.array_sort(ports), lambda s: s["p"]), ",").alias("ports"),
        F.max_by(context, F.when(context.isNotNull(), F.col("n"))).alias("build_context"),
        F.max(F.when((F.col("key") == "build") & has("dockerfile"), value("dockerfile"))).alias("dockerfile"),
    )


# -- notes that read like decisions ---------------------------------------------------------
# Words that make a heading a rule heading.
RULE_WORDS = ("constraint", "convention", "decision", "guideline", "principle", "rule")


def decision_candidates(readmes: DataFrame, known: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """(repo, path, id, decision): bullets under rule-like headings, verbatim, minus known ones; at most ``cap`` a file if given."""
    lines = readmes.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("n", "raw")).withColumn("t", F.ltrim("raw"))
    is_head = F.startswith("t", F.lit("#"))
    title = F.trim(F.regexp_replace("t", "^#+", ""))
    run = Window.partitionBy("repo", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.select(
        "repo", "path", "n", "t", is_head.alias("head"),
        F.last(F.when(is_head, F.lower(title)), ignorenulls=True).over(run).alias("section"),
        F.coalesce(F.last(F.when(is_head & (title != ""), title), ignorenulls=True).over(run), F.lit("README")).alias("heading"),
        F.sum(is_head.cast("int")).over(run).alias("sec_no"),
    )
    text = F.trim(F.regexp_extract("t", r"^[-*+] (.*)$", 1))
    b = lines.where(~F.col("head") & F.coalesce(F.col("section").rlike("|".join(RULE_WORDS)), F.lit(False))).withColumn("decision", text).where(F.col("decision") != "")
    if cap is not None:
        b = b.withColumn("at", F.row_number().over(Window.partitionBy("repo", "path").orderBy("n"))).where(F.col("at") <= cap)
    b = b.withColumn("i", F.row_number().over(Window.partitionBy("repo", "path", "sec_no").orderBy("n")))
    out = b.select("repo", "path", F.concat_ws("-", slugify(F.col("heading")), "i").alias("id"), "decision")
    if known is not None:
        out = out.join(known.select("repo", "decision").distinct(), ["repo", "decision"], "left_anti")
        out = out.join(known.select("repo", "id").distinct(), ["repo", "id"], "left_anti").select("repo", "path", "id", "decision")
    return out
