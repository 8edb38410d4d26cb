"""Extraction jobs: files in, fact tables out. All map-side: rules travel to the files.

Our own rule list is a few hundred short rows, so it is joined to the files by extension as a broadcast of known
size, and file contents are not shuffled; a list that the caller brings is left to the optimizer.

Matches are cut with ``cut_at``: a mark before each match splits the text once, so a piece begins with its match,
and its line is that of its mark - no second search that could find an earlier look-alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.extract.brackets import balanced, records
from factloom.extract.calls import called_routes, object_routes
from factloom.extract.rules import CREATES_TABLE, declaration_rules, rules_table
from factloom.functions.paths import (
    app_router_route, file_ext, file_name, file_stem, is_meaningful_literal, looks_like_path, page_route, server_api_method, server_api_route,
)

OBSERVATION = "Lexical"


MARK = "\x01"


def cut_at(text: Column, pattern: Column, first_line: Column | int = 1) -> Column:
    """Pieces (txt, line) that begin with a match of ``pattern`` and reach to the next one.

    ``first_line`` is the line that ``text`` begins on. Lines are numbered once, and each gives its number to the marks on it,
    so the work grows with the text and its matches, not with their product.
    """
    marked = F.regexp_replace(F.translate(text, MARK, " "), pattern, F.lit(MARK + "$0"))
    parts = F.split(marked, MARK)
    marks = lambda line: F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))
    start = first_line if isinstance(first_line, Column) else F.lit(first_line)
    lines = F.flatten(F.transform(F.split(marked, "\n"), lambda line, k: F.array_repeat((start + k).cast("int"), marks(line))))
    pieces = F.arrays_zip(F.slice(parts, F.lit(2), F.size(parts) - 1).alias("txt"), lines.alias("line"))
    return F.when(F.size(parts) > 1, pieces).otherwise(F.slice(pieces, 1, 0))


def _joined(files: DataFrame, rules: DataFrame, given: bool) -> DataFrame:
    return files.join(rules if given else F.broadcast(rules), "ext")


def _matched(files: DataFrame, rules: DataFrame | None, family: str) -> DataFrame:
    """(repo, path, lang, kind, line, g1, g2, g3): every match of the family's rules; an absent part is empty."""
    table = rules if rules is not None else rules_table(files.sparkSession)
    r = table.where(F.col("family") == family).select("lang", "kind", F.explode("exts").alias("ext"), "gate", F.concat(F.lit("(?m)"), "pattern", F.lit("()()()")).alias("rx"), "name", "a", "b")
    f = files.select("repo", "path", "content", file_ext(F.col("path")).alias("ext"))
    j = _joined(f, r, rules is not None)
    j = j.where(F.when((F.col("gate") == "") | F.contains("content", F.col("gate")), F.expr("regexp_like(content, rx)")).otherwise(False))
    j = j.withColumn("p", F.explode(cut_at(F.col("content"), F.col("rx")))).drop("content")
    part = lambda pos: F.expr(f"case when {pos} > 0 then regexp_extract(p.txt, rx, case when {pos} > 0 then {pos} else 0 end) else '' end")
    return j.select("repo", "path", "lang", "kind", F.col("p.line").alias("line"), part("name").alias("g1"), part("a").alias("g2"), part("b").alias("g3"))


def extract_symbols(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(repo, path, name, kind, line, observation). Infrastructure blocks are named as expressions name them: ``aws_s3.logs``."""
    m = _matched(files, rules, "symbol").where("g1 <> ''")
    dotted = F.regexp_replace(F.regexp_replace("g1", r"[\s\"]+", "."), r"^\.|\.$", "")
    m = m.select("repo", "path", F.when(F.col("lang") == "tf", dotted).otherwise(F.col("g1")).alias("name"), "kind", "line")
    named = _yaml_entries(files).select("repo", "path", "name", F.lit("Class").alias("kind"), "line")
    m = m.unionByName(_manifest_kinds(files)).unionByName(named).withColumn("observation", F.lit(OBSERVATION))
    return m.dropDuplicates(["repo", "path", "name", "kind", "line"])


def _yaml(files: DataFrame, *needles: str) -> DataFrame:
    some = F.lit(False)
    for needle in needles:
        some = some | F.contains("content", F.lit(needle))
    return files.where(file_ext(F.col("path")).isin("yaml", "yml") & some)


def _manifest_kinds(files: DataFrame) -> DataFrame:
    """Named Kubernetes objects: the first shallow name of each YAML document with a kind, at the line of the kind."""
    docs = _yaml(files, "kind:").select("repo", "path", F.explode(cut_at(F.concat(F.lit("---\n"), "content"), F.lit("(?m)^---"), 0)).alias("d"))
    docs = docs.where(F.col("d.txt").rlike(r"(?m)^kind:[ \t]*\w")).withColumn("name", F.regexp_extract("d.txt", r"(?m)^ {0,2}name:[ \t]*([^\s#]+)", 1)).where("name <> ''")
    kind = F.element_at(cut_at(F.col("d.txt"), F.lit(r"(?m)^kind:"), F.col("d.line")), 1)
    return docs.select("repo", "path", "name", F.lit("Class").alias("kind"), kind["line"].alias("line"))


# YAML sections whose entries are symbols: where the section is, the indent of its entries, and what their names begin with.
YAML_SECTIONS = (
    (r"(?m)^services:[ \t]*$", 2, "Service."),
    (r"(?m)^jobs:[ \t]*$", 2, "Job."),
    (r"(?m)^ {2}schemas:[ \t]*$", 4, ""),
    (r"(?m)^definitions:[ \t]*$", 2, ""),
)


def _yaml_entries(files: DataFrame) -> DataFrame:
    """(repo, path, name, prefix, body, line): compose services, CI jobs and OpenAPI schemas with the text of each."""
    found = None
    y = _yaml(files, "services:", "jobs:", "schemas:", "definitions:").select("repo", "path", "content")
    for opening, indent, prefix in YAML_SECTIONS:
        section = y.select("repo", "path", F.explode(cut_at(F.col("content"), F.lit(opening))).alias("s"))
        # the section ends at the first line that is indented less than its entries
        inside = F.regexp_extract("s.txt", rf"(?s)^[^\n]*(\n.*?)(?=\n {{0,{indent - 1}}}[^\s#]|\z)", 1)
        name = r"[A-Z]\w*" if not prefix else r"[\w.-]+"
        entry = section.withColumn("e", F.explode(cut_at(inside, F.lit(rf"(?m)^ {{{indent}}}{name}:"), F.col("s.line"))))
        rows = entry.select("repo", "path", F.concat(F.lit(prefix), F.regexp_extract("e.txt", rf"^ *({name}):", 1)).alias("name"), F.lit(prefix).alias("prefix"), F.col("e.txt").alias("body"), F.col("e.line").alias("line"))
        found = rows if found is None else found.unionByName(rows)
    return found


def _yaml_edges(files: DataFrame) -> DataFrame:
    """(repo, from_path, to_module, names): ``depends_on`` of services and ``needs`` of jobs, as inline list, list, map or single name."""
    e = _yaml_entries(files).where("prefix <> ''").withColumn("key", F.when(F.col("prefix") == "Job.", "needs").otherwise("depends_on"))
    value = F.expr(r"""regexp_extract(body, concat('(?s)\n    ', key, ':[ \t]*(.*?)(?=\n {0,4}[^\\s-]|\\z)'), 1)""")
    e = e.withColumn("value", value).where("value <> ''")
    keys = F.regexp_extract_all("value", F.lit(r"(?m)^ {6}([\w.-]+):"), F.lit(1))
    items = F.regexp_extract_all("value", F.lit(r"(?m)^ +-[ \t]+[\"']?([\w.-]+)"), F.lit(1))
    inline = F.regexp_extract_all(F.regexp_extract("value", r"^([^\n]*)", 1), F.lit(r"([\w.-]+)"), F.lit(1))
    every = F.array_distinct(F.concat(inline, items, keys))
    each = F.explode(F.transform(every, lambda x: F.concat("prefix", x)))
    return e.select("repo", F.col("path").alias("from_path"), each.alias("to_module"), F.array(F.concat_ws(".", "name", "key")).alias("names"))


def _scene_imports(files: DataFrame) -> DataFrame:
    """(repo, from_path, to_module, names): resources of scenes, each with the nodes that instance it, met by its id inside the file."""
    attribute = lambda text, name: F.regexp_extract(text, rf'(?<![\w]){name}="?([^"\s\])]+)', 1)
    resource = F.transform(records(F.col("content"), r"(?m)^\[ext_resource\b([^\]\n]*)\]", 1), lambda r: F.named_struct(F.lit("module"), attribute(r[0], "path"), F.lit("id"), attribute(r[0], "id")))
    name = lambda text: F.regexp_extract(text, r'\bname="([^"\n]*)"', 1)
    node = F.transform(records(F.col("content"), r"(?m)^\[node\b([^\n]*)\]", 1), lambda r: F.named_struct(F.lit("name"), name(r[0]), F.lit("id"), F.regexp_extract(r[0], r'\binstance=ExtResource\(\s*"?([^")\s]+)', 1)))
    scenes = files.where((file_ext(F.col("path")) == "tscn") & F.contains("content", F.lit("res://"))).select("repo", "path", F.explode(resource).alias("r"), node.alias("nodes"))
    names = F.transform(F.filter("nodes", lambda x: x["id"] == F.col("r.id")), lambda x: x["name"])
    return scenes.where(F.startswith("r.module", F.lit("res://"))).select("repo", F.col("path").alias("from_path"), F.col("r.module").alias("to_module"), names.alias("names"))


def extract_imports(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(repo, from_path, to_module, names): module strings with the names taken from them; statements may span lines."""
    m = _matched(files, rules, "import").where("g1 <> ''")
    bare = lambda n: F.trim(F.regexp_replace(n, r"\s+as\s+\w+|^\s*type\s+|[(){}\s]+", " "))
    names = F.filter(F.transform(F.split(F.regexp_replace("g2", r"#[^\n]*|//[^\n]*", ""), ","), bare), lambda n: n != "")
    # several modules in one statement: a block of lines, or a list
    items = F.transform(F.split("g1", r"[,\n]"), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+\w+", "")))
    inner = F.transform(items, lambda x: F.when(F.col("lang") == "go", F.regexp_extract(x, r'^\s*(?:[\w.]+\s+)?"([^"]*)"', 1)).otherwise(x))
    m = m.select("repo", F.col("path").alias("from_path"), F.explode(F.filter(inner, lambda x: x != "")).alias("to_module"), names.alias("names"))
    return m.unionByName(_yaml_edges(files)).unionByName(_scene_imports(files)).dropDuplicates(["repo", "from_path", "to_module", "names"])


def extract_routes(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(repo, path, method, route, handler): declared routes, from calls and decorators, other code and file places.

    A mapping without a path is the root.
    """
    m = _matched(files, rules, "route").where("g1 <> '' or g2 <> ''")
    method = F.when(F.col("g2") != "", F.upper("g2")).otherwise(F.upper("kind"))
    coded = m.select("repo", "path", method.alias("method"), F.when(F.col("g1") == "", "/").otherwise(F.col("g1")).alias("route"), F.col("g3").alias("handler"))
    place = files.select("repo", "path", app_router_route(F.col("path")).alias("app"), server_api_route(F.col("path")).alias("srv"), page_route(F.col("path")).alias("page"), "content")
    page = place.where(F.col("app").isNotNull() & file_stem(F.col("path")).isin("page")).select("repo", "path", F.lit("GET").alias("method"), F.col("app").alias("route"), F.lit("default").alias("handler"))
    nuxt = place.where(F.col("page").isNotNull()).select("repo", "path", F.lit("GET").alias("method"), F.col("page").alias("route"), F.lit("default").alias("handler"))
    verbs = F.regexp_extract_all("content", F.lit(r"(?m)^export[ \t]+(?:(?:async[ \t]+)?function|const|let)[ \t]+([A-Z]+)\b"), F.lit(1))
    verbs = F.filter(verbs, lambda v: v.isin("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT"))
    api = place.where(F.col("app").isNotNull() & file_stem(F.col("path")).isin("route")).withColumn(
        "v", F.explode(F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("ANY"))))
    ).select("repo", "path", F.col("v").alias("method"), F.col("app").alias("route"), F.when(F.col("v") == "ANY", "unknown").otherwise(F.col("v")).alias("handler"))
    server = place.where(F.col("srv").isNotNull()).select("repo", "path", server_api_method(F.col("path")).alias("method"), F.col("srv").alias("route"), file_stem(F.col("path")).alias("handler"))
    found = coded
    for more in (called_routes(files), object_routes(files), page, nuxt, api, server, _service_rpcs(files), _api_paths(files)):
        found = found.unionByName(more)
    return found.distinct()


def _api_paths(files: DataFrame) -> DataFrame:
    """OpenAPI paths with each of their methods: entries of the paths section, and the entries below them."""
    y = _yaml(files, "paths:").select("repo", "path", F.explode(cut_at(F.col("content"), F.lit(r"(?m)^ {2}/[^\n]*?:[ \t]*$|^\S"))).alias("p"))
    y = y.where(F.startswith("p.txt", F.lit("  /"))).select("repo", "path", F.regexp_extract("p.txt", r"^ *(/[^\n]*?):[ \t]*(?:\n|$)", 1).alias("route"), F.col("p.txt").alias("body"))
    keys = F.filter(F.regexp_extract_all("body", F.lit(r"(?m)^ {4}([a-z]+):"), F.lit(1)), lambda k: k.isin("delete", "get", "head", "options", "patch", "post", "put"))
    return y.select("repo", "path", F.explode(F.transform(keys, F.upper)).alias("method"), "route", F.lit("").alias("handler"))


def _service_rpcs(files: DataFrame) -> DataFrame:
    """Remote procedures, each scoped to its service: every declaration at the margin opens a scope."""
    s = files.where(file_ext(F.col("path")) == "proto").select("repo", "path", F.explode(cut_at(F.col("content"), F.lit(r"(?m)^[a-z]+[ \t]+\w+"))).alias("s"))
    s = s.withColumn("service", F.regexp_extract("s.txt", r"^service[ \t]+(\w+)", 1)).where("service <> ''")
    r = s.select("repo", "path", "service", F.explode(F.regexp_extract_all("s.txt", F.lit(r"(?m)^[ \t]*rpc[ \t]+(\w+)"), F.lit(1))).alias("rpc"))
    return r.select("repo", "path", F.lit("RPC").alias("method"), F.concat(F.lit("/"), "service", F.lit("/"), "rpc").alias("route"), F.col("rpc").alias("handler"))


def extract_route_calls(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(repo, file, called): outbound HTTP and socket literals that look like a path."""
    m = _matched(files, rules, "call")
    return m.where(looks_like_path(F.col("g1"))).select("repo", F.col("path").alias("file"), F.col("g1").alias("called")).distinct()


# -- declarations -----------------------------------------------------------------------
# A Rust test module, up to the brace that closes it at the margin: matched so that nothing in it is.
TEST_MODULE = r"(?m)^[ \t]*#\[cfg\(test\)\]\s*mod\s+\w+\s*\{(?:\n(?!\})[^\n]*)*+"
CREATE = rf"(?i){CREATES_TABLE}\s*(?:\(|as\s)"


def _sql_declarations(files: DataFrame) -> DataFrame:
    """CREATE TABLE with a column list or AS; comments only count in .sql files, tests never."""
    path, ext = F.col("path"), F.coalesce(file_ext(F.col("path")), F.lit(""))
    dirs = F.split(path, "/")
    tests = F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in ("test", "tests", "__tests__")])) | F.contains(file_name(path), F.lit(".test.")) | F.contains(file_name(path), F.lit(".spec."))
    allowed = ~tests | F.array_contains(dirs, "fixtures") | (ext == "sql")
    # comment lines are emptied, not dropped, so that lines keep their numbers
    bare = F.regexp_replace("content", r"(?m)^[ \t]*+(?://|#|--|\*)[^\n]*+", "")
    text = F.when(ext == "sql", F.col("content")).otherwise(bare)
    found = files.where(allowed & F.col("content").rlike(CREATE)).select("repo", "path", F.explode(cut_at(text, F.lit(CREATE))).alias("p"))
    none = F.array().cast("array<string>")
    name = F.regexp_extract("p.txt", CREATE, 1)
    return found.select("repo", "path", F.col("p.line").alias("line"), name.alias("name"), F.lit("sql").alias("kind"), none.alias("fields"), none.alias("relations"), name.alias("table_name"))


def extract_declarations(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(repo, path, line, name, kind, fields, relations, table_name)."""
    r = rules if rules is not None else declaration_rules(files.sparkSession)
    r = r.withColumn("ext", F.explode("exts")).drop("exts")
    f = files.select("repo", "path", file_ext(F.col("path")).alias("ext"), "content", file_name(F.col("path")).alias("fname"))
    j = _joined(f, r, rules is not None).where((F.col("file") == "") | (F.col("file") == F.col("fname")))
    # A schema.rb file declares tables only.
    j = j.where(~((F.col("kind") == "rails") & (F.col("fname") == "schema.rb")))
    j = j.where(F.when((F.col("gate") == "") | F.contains("content", F.col("gate")), F.expr("regexp_like(content, block)")).otherwise(False))
    whole = F.when(F.col("ext") == "rs", F.concat(F.lit(TEST_MODULE + "|"), "block")).otherwise(F.col("block"))
    j = j.withColumn("p", F.explode(cut_at(F.col("content"), whole)))
    j = j.where((F.col("ext") != "rs") | ~F.col("p.txt").rlike("^" + TEST_MODULE))
    group = lambda pos: F.expr(f"case when {pos} > 0 then regexp_extract(p.txt, block, {pos}) else '' end")
    j = j.select("*", group("name").alias("decl"), group("head").alias("head_text"), group("body").alias("body_text"))
    # Accept and reject read "head NUL body SOH path".
    probe = F.concat("head_text", F.lit("\x00"), "body_text", F.lit("\x01"), F.when(F.contains("path", F.lit("Models/")), F.lit("Models")).otherwise(F.lit("")))
    j = j.withColumn("probe", probe)
    j = j.where((F.col("accept") == "") | F.expr("regexp_like(probe, accept)")).where((F.col("reject") == "") | ~F.expr("regexp_like(probe, reject)"))
    scope = F.when(F.col("scope") == "file", F.col("content")).otherwise(F.col("body_text"))
    j = j.withColumn("src", scope)
    j = j.withColumn("fs", F.expr("case when fields = '' then cast(array() as array<string>) else regexp_extract_all(src, fields, 1) end"))
    j = j.withColumn("rs", F.expr("case when relations = '' then cast(array() as array<string>) else array_sort(array_distinct(regexp_extract_all(src, relations, 1))) end"))
    where = F.when(F.col("table_in") == "head", F.col("head_text")).when(F.col("table_in") == "file", F.col("content")).otherwise(F.col("body_text"))
    j = j.withColumn("tsrc", where)
    named = F.expr("case when table = '' then '' else regexp_extract(tsrc, table, 1) end")
    table = (
        F.when(named != "", named)
        .when(F.col("default_table") == "name", F.col("decl"))
        .when((F.col("default_table") == "lower_if_table") & F.col("head_text").rlike(r"\btable\s*=\s*True"), F.lower("decl"))
    )
    out = j.select("repo", "path", F.col("p.line").alias("line"), F.col("decl").alias("name"), "kind", F.col("fs").alias("fields"), F.filter("rs", lambda x: x != F.col("decl")).alias("relations"), table.alias("table_name"))
    return out.unionByName(_sql_declarations(files))


# -- units: bodies, literals, calls, identifiers ------------------------------------------------
def _braced(family: str) -> str:
    return rf"\{{{balanced(family)}\}}"


# A function at the margin and its body: parameters and braces as they close; a Python body is what is indented below.
UNIT = {
    "py": rf"(?m)^(?:async[ \t]+)?def[ \t]+(\w+)([ \t]*\({balanced('py')}\)[^\n]*+(?:\n(?:[ \t][^\n]*+)?+(?=\n|\z))*+)",
    "rs": rf"(?m)^(?:(?:pub(?:\([^()\n]*\))?|async|const|unsafe|extern[ \t]+\"\w+\")[ \t]+)*+fn[ \t]+(\w+)([^{{;]*+{_braced('rs')})",
    "ts": rf"(?m)^(?:(?:export|default|async)[ \t]+)*+function\b[ \t]*\*?[ \t]*(\w+)([^(\n]*+\({balanced('js')}\)[^{{;\n]*+{_braced('js')})",
    "arrow": rf"(?m)^(?:export[ \t]+)?(?:const|let)[ \t]+(\w+)[^=\n]*=\s*(?:async\b\s*)?(?:\({balanced('js')}\)|\w+)[^=;{{\n]*=>\s*({_braced('js')})",
}
JS_EXTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs")
NOT_CALLS = (
    "if", "for", "while", "switch", "match", "return", "catch", "function", "fn", "def", "await", "typeof", "new", "sizeof", "loop", "in", "and", "or", "not", "assert", "super",
)


def function_units(files: DataFrame, exts: tuple[str, ...] | None = None) -> DataFrame:
    """(repo, path, ext, unit, body) of top-level functions, cut by indent or closing brace."""
    ext = file_ext(F.col("path"))
    f = files.select("repo", "path", "content", ext.alias("ext"))
    if exts is not None:
        f = f.where(F.col("ext").isin(*exts))

    def units(rx, when):
        z = F.arrays_zip(F.regexp_extract_all("content", F.lit(rx), F.lit(1)).alias("unit"), F.regexp_extract_all("content", F.lit(rx), F.lit(2)).alias("body"))
        return F.when(when, z)

    js = F.col("ext").isin(*JS_EXTS)
    empty = F.array().cast("array<struct<unit:string,body:string>>")
    one = F.coalesce(units(UNIT["py"], F.col("ext") == "py"), units(UNIT["rs"], F.col("ext") == "rs"), units(UNIT["ts"], js), empty)
    two = F.coalesce(units(UNIT["arrow"], js), empty)
    return f.select("repo", "path", "ext", F.explode(F.concat(one, two)).alias("u")).select("repo", "path", "ext", "u.unit", "u.body")


def extract_body_literals(files: DataFrame) -> DataFrame:
    """(repo, path, unit, literal): distinct meaningful string literals per function."""
    u = function_units(files)
    # Possessive loops: a literal of any length is matched without recursion.
    double = F.regexp_extract_all("body", F.lit(r'"((?:[^"\\]++|\\[\s\S])*+)"'), F.lit(1))
    either = r"'((?:[^'\\]++|\\[\s\S])*+)'|" + r'"((?:[^"\\]++|\\[\s\S])*+)"'
    both = F.concat(F.regexp_extract_all("body", F.lit(either), F.lit(1)), F.regexp_extract_all("body", F.lit(either), F.lit(2)))
    lits = F.array_distinct(F.filter(F.when(F.col("ext") == "rs", double).otherwise(both), is_meaningful_literal))
    return u.select("repo", "path", "unit", F.explode(lits).alias("literal"))


def extract_call_edges(files: DataFrame) -> DataFrame:
    """(repo, from_path, caller, callee) of Rust and JavaScript functions, no self-calls."""
    u = function_units(files, ("rs", *JS_EXTS))
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"(?:^|[^A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    c = u.select("repo", F.col("path").alias("from_path"), F.col("unit").alias("caller"), F.explode(names).alias("callee"))
    return c.where(~F.col("callee").isin(*NOT_CALLS) & (F.col("callee") != F.col("caller"))).distinct()


# One pass from left to right: strings, comments and declared names are consumed, group 1 is an identifier in use.
_DECLARED = r"(?:class|def|enum|fn|func|function|interface|model|struct|trait|type)\s+[A-Za-z_]\w*"
_DOUBLE, _SINGLE, _BACK = r'"(?:[^"\\\n]++|\\.)*+"', r"'(?:[^'\\\n]++|\\.)*+'", r"`[^`]*+`"
_SLASHES, _HASH, _DASHES = r"/\*(?:[^*]++|\*(?!/))*+\*/|//[^\n]*+", r"#[^\n]*+", r"--[^\n]*+"
_TRIPLE = r'"""(?:[^"]++|"(?!""))*+"""|' + r"'''(?:[^']++|'(?!''))*+'''"
LEXERS = (
    (("py",), (_TRIPLE, _DOUBLE, _SINGLE, _HASH)),
    (("rb", "jbuilder", "ex", "exs", "yaml", "yml", "gd", "tf", "graphql", "gql", "feature"), (_DOUBLE, _SINGLE, _HASH)),
    (("php",), (_SLASHES, _DOUBLE, _SINGLE, _HASH)),
    (("sql", "hs"), (_DOUBLE, _SINGLE, _DASHES)),
    # a single quote also opens a lifetime
    (("rs",), (_SLASHES, _DOUBLE, r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'")),
    (("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "vue", "go", "java", "kt", "cs", "swift", "m", "mm", "c", "h", "cpp", "hpp", "cc", "cxx", "scala", "dart", "proto", "prisma"), (_SLASHES, _DOUBLE, _SINGLE, _BACK)),
)
_IN_USE = r"([A-Za-z_]\w*)"
# An import statement: to the end of its line, or of the brackets it opens.
_IMPORT = r"(?m)^[ \t]*(?:pub[ \t]+)?(?:export|from|import|use)\b(?:\([^)]*\)|\{[^}]*\}|[^\n;({])*"


def used_identifiers(files: DataFrame) -> DataFrame:
    """(repo, path, ident): identifiers a file uses outside comments, strings and its own declarations.

    Import aliases are resolved, and each identifier comes with a capitalised variant. Files of other kinds
    are prose: all their words count.
    """
    ext = file_ext(F.col("path"))
    rx = F.lit(f"{_DECLARED}|{_IN_USE}")
    for exts, parts in LEXERS:
        rx = F.when(ext.isin(*exts), F.lit("|".join((*parts, _DECLARED, _IN_USE)))).otherwise(rx)
    f = files.select("repo", "path", "content", rx.alias("rx"))
    raw = F.filter(F.array_distinct(F.expr("regexp_extract_all(content, rx, 1)")), lambda x: x != "")
    pair = r"([A-Za-z_]\w*)[ \t]+as[ \t]+([A-Za-z_]\w*)"
    lines = F.array_join(F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(0)), "\n")
    aliases = F.arrays_zip(F.regexp_extract_all(lines, F.lit(pair), F.lit(1)).alias("real"), F.regexp_extract_all(lines, F.lit(pair), F.lit(2)).alias("alias"))
    f = f.select("repo", "path", raw.alias("raw"), aliases.alias("al"))
    real = F.transform(F.filter("al", lambda x: F.array_contains(F.col("raw"), x["alias"])), lambda x: x["real"])
    pascal = F.transform("raw", lambda n: F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2))))
    every = F.array_union(F.array_union("raw", real), pascal)
    return f.select("repo", "path", F.explode(every).alias("ident"))


def raw_sql_tables(files: DataFrame) -> DataFrame:
    """(repo, path, table_key): tables named after insert into, update, from or join."""
    rx = r"\b(?:insert\s+into|update|from|join)\s+[\"'`]?([a-z_][a-z0-9_]*)"
    return files.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(rx), F.lit(1)))).alias("table_key"))


def usage_hits(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """(repo, name, path, kind): raw SQL on a concept's table, and identifiers equal to its name.

    Two equality joins on (repo, word); neither scans a file once per concept.
    """
    by_table = concepts.where(F.col("table_name").isNotNull()).select("repo", "name", F.lower("table_name").alias("table_key"))
    sql = raw_sql_tables(files).join(by_table, ["repo", "table_key"]).select("repo", "name", "path", F.lit("raw-sql").alias("kind"))
    ident = used_identifiers(files).withColumnRenamed("ident", "name").join(concepts.select("repo", "name").distinct(), ["repo", "name"])
    return sql.unionByName(ident.select("repo", "name", "path", F.lit("identifier").alias("kind"))).distinct()


def source_excerpt(files: DataFrame, spots: DataFrame, around: int = 2) -> DataFrame:
    """(repo, path, line, excerpt): numbered lines around each spot. The spots of a file meet its text once, and it is split once."""
    asked = spots.select("repo", "path", "line").distinct().groupBy("repo", "path").agg(F.collect_set("line").alias("asked"))
    j = asked.join(files.select("repo", "path", "content"), ["repo", "path"])
    j = j.select("repo", "path", "asked", F.split(F.regexp_replace("content", "\n$", ""), "\n").alias("ls"))
    inside = F.filter("asked", lambda n: (n >= 1) & (n <= F.size("ls")))
    number = lambda n: F.sequence(F.greatest(n - around, F.lit(1)).cast("int"), F.least(n + around, F.size("ls")).cast("int"))
    text = lambda n: F.array_join(F.transform(number(n), lambda i: F.concat(i.cast("string"), F.lit(": "), F.element_at("ls", i))), "\n")
    cut = F.transform(inside, lambda n: F.struct(n.alias("line"), text(n).alias("excerpt")))
    return j.select("repo", "path", F.explode(cut).alias("c")).select("repo", "path", "c.line", "c.excerpt")
