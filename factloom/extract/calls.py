"""Routes from calls and decorators with their whole argument lists.

One pass per text finds the heads (``usersRouter.get(``, ``@Get(``, ``@router.post(``) and looks ahead over the balanced arguments;
arguments are then rows' arrays: the path is the first one, put together from literals and constants
of the file, the handler is the last one or the function that is decorated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.extract.brackets import balanced, bracketed, items, joined_literals, records
from factloom.functions.paths import file_ext

VERBS = ("get", "post", "put", "patch", "delete", "options", "head", "all")
#: Receivers whose calls go out, as a pattern, and what the names of routers end in, whose paths may lack a slash.
CLIENTS = r"(?:\$http|axios|got|ky|superagent|\w*[Cc]lient)"
ROUTER = r"(?i)(?:^|_)(?:api|app|routes?|router|server)$|(?:App|Api|Routes?|Router|Server)$"

_SOME = r"\s{0,60}+"
_NEST = "|".join(v.capitalize() for v in VERBS)
_DECORATORS = rf"(?:\s*+@[\w.]++(?:{_SOME}{bracketed('js', 8)})?+|\s*+//[^\n]*+|\s*+/\*(?:[^*]++|\*(?!/))*+\*/)*+"
_PY_DECORATORS = rf"(?:\s*+@[\w.]++(?:{_SOME}{bracketed('py', 8)})?+|\s*+#[^\n]*+)*+"

# (family, extensions, text that must be there, pattern); groups: receiver, method, arguments, handler
HEADS = (
    ("js", ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts"), "(",
     rf"(?:(?<![\w$])([\w$]++){_SOME})?\.{_SOME}({'|'.join(VERBS)}){_SOME}(?:<[^<>()\n]*+>)?\((?=({balanced('js')})\)())"),
    ("nest", ("ts", "js"), "@",
     rf"()@({_NEST}){_SOME}\((?=({balanced('js')})\){_DECORATORS}\s*+(?:(?:public|private|protected|static|async)\s++)*+(\w++)\s*+[(<])"),
    ("py", ("py",), "@",
     rf"(?m)^[ \t]*+@([\w.]+)\.(get|post|put|patch|delete|options|head|route|api_route){_SOME}\((?=({balanced('py')})\){_PY_DECORATORS}\s*+(?:async\s++)?def\s++(\w++))"),
)


def constants(content: Column, python: Column) -> Column:
    """(name, value) of the string constants of a file."""
    js = r"\bconst\s+(\w+)\s*(?::\s*string\s*)?=\s*[\"'`]([^\"'`$\n]*)[\"'`]"
    py = r"(?m)^([A-Za-z_]\w*)(?:[ \t]*:[ \t]*\w+)?[ \t]*=[ \t]*[\"']([^\"'\n]*)[\"'][ \t]*(?:#[^\n]*)?$"
    found = F.when(python, records(content, py, 2)).otherwise(records(content, js, 2))
    return F.transform(found, lambda x: F.named_struct(F.lit("name"), x[0], F.lit("value"), x[1]))


def called(files: DataFrame) -> DataFrame:
    """(repo, path, family, known, receiver, method, args, after): each call or decorator with its argument list."""
    f = files.select("repo", "path", "content", file_ext(F.col("path")).alias("ext"))
    found = None
    for family, exts, gate, pattern in HEADS:
        some = f.where(F.col("ext").isin(*exts) & F.contains("content", F.lit(gate)))
        some = some.withColumn("r", records(F.col("content"), pattern, 4)).where(F.size("r") > 0)
        lex = "py" if family == "py" else "js"
        some = some.select("repo", "path", F.lit(family).alias("family"), constants(F.col("content"), F.lit(lex == "py")).alias("known"), F.explode("r").alias("r"))
        some = some.select("repo", "path", "family", "known", F.col("r")[0].alias("receiver"), F.col("r")[1].alias("method"), items(F.col("r")[2], lex).alias("args"), F.col("r")[3].alias("after"))
        found = some if found is None else found.unionByName(some)
    return found


def _paths(first: Column, known: Column, family: str) -> Column:
    """The paths that an argument names: one, or those of a list."""
    several = F.when(first.rlike(r"^\["), items(F.regexp_extract(first, r"(?s)^\[(.*)\]$", 1), family)).otherwise(F.array(first))
    return F.filter(F.transform(several, lambda x: joined_literals(x, known, family)), lambda x: x.isNotNull())


def _keyword(args: Column, name: str, mark: str) -> Column:
    """The value of a named argument, null where there is none."""
    hit = F.filter(args, lambda x: x.rlike(rf"^{name}\s*{mark}(?!=)"))
    return F.regexp_replace(F.get(hit, F.lit(0)), rf"^{name}\s*{mark}\s*", "")


def _handler(last: Column, method: Column) -> Column:
    """What handles a call: a name, also inside a wrapper or at the end of a list; the method for a nameless function; null for data."""
    inline = last.rlike(r"=>|\bfunction\b")
    named = F.regexp_extract(last, r"\bfunction\s*\*?\s*([\w$]+)\s*\(", 1)
    word = F.regexp_extract(F.regexp_replace(last, r"\.bind\([^()]*\)$", ""), r"([A-Za-z_$][\w$]*)[\s)\]]*$", 1)
    data = last.rlike(r"^(?:[\"'`{\d]|new\b|true$|false$|null$|undefined$)")
    return F.when(data, None).when(inline, F.when(named != "", named).otherwise(F.lower(method))).when(word != "", word)


def called_routes(files: DataFrame, clients: str = CLIENTS) -> DataFrame:
    """(repo, path, method, route, handler) of ``called``; calls of ``clients`` (a pattern) go out and are no routes."""
    c = called(files)
    args, known = F.col("args"), F.col("known")
    js = c.where((F.col("family") == "js") & (F.size("args") > 1) & ~F.col("receiver").rlike(f"^{clients}$"))
    js = js.withColumn("handler", _handler(F.get("args", F.size("args") - 1), F.col("method"))).where("handler is not null")
    js = js.select("repo", "path", F.upper("method").alias("method"), F.explode(_paths(F.get(args, F.lit(0)), known, "js")).alias("route"), "handler", F.col("receiver").rlike(ROUTER).alias("sure"))
    js = js.where(F.col("sure") | F.col("route").rlike(r"^[/*]")).drop("sure")

    nest = c.where(F.col("family") == "nest")
    inside = items(F.regexp_extract(F.get("args", F.lit(0)), r"(?s)^\{(.*)\}$", 1), "js")
    first = F.when(F.get("args", F.lit(0)).rlike(r"^\{"), _keyword(inside, "path", ":")).otherwise(F.get("args", F.lit(0)))
    root = F.when((F.size("args") == 0) | (first.isNull()), F.array(F.lit("")))
    verb = F.when(F.col("method") == "All", "ANY").otherwise(F.upper("method"))
    nest = nest.select("repo", "path", verb.alias("method"), F.explode(F.coalesce(root, _paths(first, known, "js"))).alias("route"), F.col("after").alias("handler"))

    py = c.where((F.col("family") == "py") & ~F.col("receiver").rlike(r"(?:^|\.)mock$"))
    positional = F.get(F.filter("args", lambda x: ~x.rlike(r"^\w+\s*=(?!=)")), F.lit(0))
    first = F.coalesce(_keyword(args, "path", "="), _keyword(args, "rule", "="), positional)
    listed = F.transform(items(F.regexp_extract(_keyword(args, "methods", "="), r"(?s)^[\[({](.*)[\])}]$", 1), "py"), lambda x: F.upper(F.regexp_extract(x, r"(\w+)", 1)))
    methods = F.when(~F.col("method").isin("route", "api_route"), F.array(F.upper("method"))).when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("ANY")))
    py = py.select("repo", "path", F.explode(methods).alias("method"), _paths(first, known, "py").alias("routes"), F.col("after").alias("handler"))
    py = py.select("repo", "path", "method", F.explode("routes").alias("route"), "handler")
    every = js.unionByName(nest).unionByName(py)
    return every.withColumn("route", F.when(F.col("route") == "", "/").otherwise(F.col("route")))


def object_routes(files: DataFrame) -> DataFrame:
    """(repo, path, method, route, handler) of objects with a path and a component, whatever stands between and in either order."""
    f = files.where(file_ext(F.col("path")).isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts") & F.contains("content", F.lit("component")) & F.contains("content", F.lit("path")))
    literal = r"[\"'`]([^\"'`\n]*+)[\"'`]"
    head = rf"(?<![\w$.])(path|component)\s*+:\s*+(?:{literal}|(\w++)(?!\s*+[(.]))(?=({balanced('js', 8)}))"
    r = f.select("repo", "path", F.explode(records(F.col("content"), head, 4)).alias("r"))
    # only keys of the same object: what its brackets hold is left out
    rest = F.regexp_replace(F.col("r")[3], bracketed("js", 8), "")
    one = r.where((F.col("r")[0] == "path") & (F.col("r")[2] == "")).select("repo", "path", F.col("r")[1].alias("route"), F.regexp_extract(rest, r"(?<![\w$.])component\s*:\s*(\w+)(?!\s*[(.\w])", 1).alias("handler"))
    two = r.where((F.col("r")[0] == "component") & (F.col("r")[2] != "")).select("repo", "path", F.regexp_extract(rest, rf"(?<![\w$.])path\s*:\s*{literal}", 1).alias("route"), F.col("r")[2].alias("handler"), rest.rlike(rf"(?<![\w$.])path\s*:\s*{literal}").alias("has"))
    found = one.where("handler <> ''").unionByName(two.where("has").drop("has"))
    return found.select("repo", "path", F.lit("ANY").alias("method"), F.when(F.col("route") == "", "/").otherwise(F.col("route")).alias("route"), "handler")
