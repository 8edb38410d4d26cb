"""Path, URL and route expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that only group owners.
CONTAINER_DIRS = ("crates", "packages", "apps", "bin", "services", "libs", "modules")
# Directories never scanned.
SKIP_DIRS = (
    "node_modules", ".git", ".next", "target", "dist", "build", "__pycache__", ".venv",
    "venv", ".turbo", "coverage", ".cache", "vendor", ".claude", ".vscode-test",
    ".vscode-server", ".idea", ".metals",
)
# Extensions and directories of documentation and tests.
DOC_EXTS = ("md", "txt", "rst", "png", "jpg", "jpeg", "svg", "ico", "icns")
TEST_DIRS = ("test", "tests", "__tests__", "fixtures")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_ext(path: Column) -> Column:
    """Lower-cased extension, null when the file name has none (a leading dot is no extension)."""
    ext = F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def file_dir(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def path_only(raw: Column) -> Column:
    """Drop scheme, host and query; a bare host gives the empty path."""
    plain = F.regexp_replace(raw, r"(?s)\?.*$", "")
    return F.when(
        F.contains(plain, F.lit("://")),
        F.regexp_extract(plain, r"(?s)^.*?://[^/]*?(/.*?)?(?:://.*)?$", 1),
    ).otherwise(plain)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_dynamic(seg: Column) -> Column:
    return seg.rlike(r"^(\{.*\}|<.*>|\$\{.*\}|:.*)$")


def paths_match(declared: Column, called: Column) -> Column:
    """Route equality: same segment count, dynamic segments on either side are wildcards."""
    d, c = segments(path_only(declared)), segments(path_only(called))
    same = F.zip_with(d, c, lambda x, y: is_dynamic(x) | is_dynamic(y) | (F.lower(x) == F.lower(y)))
    return (F.size(d) > 0) & (F.size(d) == F.size(c)) & F.forall(same, lambda ok: ok)


def observed_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"(?s)\?.*$", ""), "/+$", "")


def route_matches(declared: Column, observed: Column) -> Column:
    """Observed-route equality: only declared ``:x`` is a wildcard, case-sensitive."""
    dn, on = observed_path(declared), observed_path(observed)
    d, o = segments(dn), segments(on)
    same = F.zip_with(d, o, lambda x, y: F.startswith(x, F.lit(":")) | (x == y))
    return (dn == on) | ((F.size(d) == F.size(o)) & F.forall(same, lambda ok: ok))


def looks_like_path(text: Column) -> Column:
    return F.startswith(text, F.lit("/")) | F.contains(text, F.lit("://"))


def is_meaningful_literal(text: Column) -> Column:
    """At least 10 bytes and not a CSS colour."""
    colour = text.rlike(r"^(#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$|rgb\(|rgba\()")
    return (F.octet_length(text) >= 10) & ~colour


def is_documentation(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1).isin(*DOC_EXTS), F.lit(False))


def is_test_source(path: Column) -> Column:
    in_dir = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in TEST_DIRS]))
    return in_dir | F.contains(path, F.lit(".test.")) | F.contains(path, F.lit(".spec."))


def under(path: Column, prefix: Column) -> Column:
    bare = F.regexp_replace(prefix, "/+$", "")
    return (path == bare) | F.startswith(path, F.concat(bare, F.lit("/")))


def is_protected(path: Column, prefixes: Column, excludes: Column) -> Column:
    """Under a protected prefix (``.`` means everything) and under no exclude."""
    hit = F.exists(prefixes, lambda p: (F.regexp_replace(p, "/+$", "") == ".") | under(path, p))
    return hit & ~F.exists(excludes, lambda p: under(path, p))


def owning_dir(path: Column) -> Column:
    """First segment; two when the first only groups owners and the second is no file."""
    parts = F.split(path, "/")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    nested = first.isin(*CONTAINER_DIRS) & second.isNotNull() & ~F.contains(second, F.lit("."))
    return F.when(nested, F.concat_ws("/", first, second)).otherwise(first)


def in_skipped_dir(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in SKIP_DIRS]))


def bracket_route(segs: Column) -> Column:
    """``[id]`` to ``:id``, ``[...x]`` to ``*``; ``(group)`` segments are dropped."""
    kept = F.filter(segs, lambda s: ~s.rlike(r"^\(.*\)$"))
    out = F.transform(
        kept,
        lambda s: F.when(s.rlike(r"^\[\[?\.\.\."), F.lit("*")).otherwise(F.regexp_replace(s, r"\[([A-Za-z0-9_]+)\]", ":$1")),
    )
    return F.concat(F.lit("/"), F.array_join(out, "/"))


def app_router_route(path: Column) -> Column:
    """Route of an ``app/**/page|route`` file, else null."""
    body = F.regexp_extract(path, r"^(?:.*/)?app/(?:(.*)/)?(?:page|route)\.(?:tsx|ts|jsx|js)$", 1)
    hit = path.rlike(r"^(.*/)?app/((.*)/)?(page|route)\.(tsx|ts|jsx|js)$")
    return F.when(hit, bracket_route(segments(body)))


_SERVER = r"^(?:.*?)server/(api|routes)/(?:(.*)/)?([^/]+)$"
_VERB = r"\.(get|post|put|delete|patch|head|options)$"


def server_api_route(path: Column) -> Column:
    """Route of a ``server/api/**`` or ``server/routes/**`` file, else null; a verb suffix is no path part."""
    kind, folder = F.regexp_extract(path, _SERVER, 1), F.regexp_extract(path, _SERVER, 2)
    name = F.regexp_replace(file_stem(path), _VERB, "")
    leaf = F.regexp_replace(name, r"^\[(.+)\]$", ":$1")
    parts = F.array(F.concat(F.lit("/server/"), kind), F.when(folder != "", folder), leaf)
    return F.when(kind != "", F.array_join(parts, "/"))


def server_api_method(path: Column) -> Column:
    verb = F.regexp_extract(file_stem(path), _VERB, 1)
    return F.when(verb == "", F.lit("ANY")).otherwise(F.upper(verb))


def page_route(path: Column) -> Column:
    """Route of a ``pages/**.vue`` file, else null: ``[id]`` to ``:id`` and ``[...x]`` to ``*x`` anywhere in a segment, ``index`` is no segment."""
    inner = F.regexp_extract(path, r"^(?:.*?/)?pages/(.*)\.vue$", 1)
    parts = F.filter(F.split(inner, "/"), lambda s: (s != "") & (F.lower(s) != "index"))
    named = F.regexp_replace(F.regexp_replace(F.array_join(parts, "/"), r"\[\.\.\.(\w+)\]", "*$1"), r"\[(\w+)\]", ":$1")
    return F.when(path.rlike(r"^(.*/)?pages/.+\.vue$"), F.concat(F.lit("/"), named))
