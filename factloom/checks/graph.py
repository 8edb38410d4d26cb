"""Checks for imports, routes, reachability, impact inputs and duplicated logic."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame, sql
from factloom.functions import paths
from factloom.operators import duplicates, imports, reach, routes
from factloom.session import unbroadcast

QUERIES, ORACLES = {}, {}


# -- imports ---------------------------------------------------------------------------
def resolved_imports(spark, sf):
    return imports.resolve_imports(frame(spark, sf, "b_mimp"), frame(spark, sf, "b_mfile"), frame(spark, sf, "b_mpkg"))


_IMPORTS = """
x as (select *, 'src/' || w1 || '/m' || pk || '.ts' as self, pk % 9 as k from b_mimp),
hit as (
  select repo, from_path, to_module, self as to_path from x where k in (0, 2, 6)
  union all select x.repo, from_path, to_module, f.path from x join b_mfile f on f.repo = x.repo and f.path = 'src/core/' || w2 || '.rs' where k = 3
  union all select x.repo, from_path, to_module, 'src/core/' || w1 || '/mod.rs' from x where k = 8
  union all select x.repo, from_path, to_module, coalesce(f.path, 'packages/' || w1) from x left join b_mfile f
    on f.repo = x.repo and f.path = 'packages/' || w1 || '/src/index.ts' where k = 4
  union all select x.repo, from_path, to_module, f.path from x join b_mfile f on f.repo = x.repo and f.path = 'packages/' || w1 || '/sub/m' || pk || '.ts' where k = 5
  union all select x.repo, from_path, to_module, 'src/' || w2 || '.ts' from x where k = 7
    and not exists (select 1 from b_mfile f where f.repo = x.repo and f.path = 'src/' || w2 || '/index.ts'))"""
QUERIES["resolved_imports"] = resolved_imports
ORACLES["resolved_imports"] = f"with {_IMPORTS} select distinct repo, from_path, to_module, to_path from hit"


def file_imports(spark, sf):
    return imports.file_imports(resolved_imports(spark, sf))


QUERIES["file_imports"] = file_imports
ORACLES["file_imports"] = f"""with {_IMPORTS}
select distinct repo, from_path as file, 'imports' as direction, to_path as other from hit
union all select distinct repo, to_path, 'imported_by', from_path from hit"""


def tail_edges(spark, sf):
    asked = frame(spark, sf, "b_mimp").join(unbroadcast(resolved_imports(spark, sf)), ["repo", "from_path", "to_module"], "left_anti")
    return reach.tail_edges(asked, frame(spark, sf, "b_mfile")).withColumn("matched", F.col("matched").cast("bigint"))


QUERIES["tail_edges"] = tail_edges
ORACLES["tail_edges"] = f"""with {_IMPORTS},
f0 as (select distinct repo, path, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')) as stem, list_filter(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), lambda d: d <> '') as dirs from b_mfile),
ends as (select repo, path, list_append(dirs, stem) as p from f0 union all select repo, path, dirs from f0 where stem in ('index', 'mod', 'main', '__init__') and len(dirs) > 0),
w as (select distinct repo, from_path, to_module, list_filter(regexp_split_to_array(regexp_replace(lower(to_module), '[.]ts$', ''), '[/.:]+'), lambda d: d <> '') as m from b_mimp i
  where not exists (select 1 from hit where hit.repo = i.repo and hit.from_path = i.from_path and hit.to_module = i.to_module)),
pair as (select w.repo, to_module, path, len(list_filter(range(1, least(len(m), len(p)) + 1), lambda i: m[len(m) - i + 1:] = p[len(p) - i + 1:])) as k
  from (select distinct repo, to_module, m from w) w join ends on ends.repo = w.repo and ends.p[-1] = w.m[-1]),
best as (select repo, to_module, max(k) as k from pair group by 1, 2)
select distinct w.repo, w.from_path, w.to_module, pair.path as to_path, best.k as matched from w join best using (repo, to_module) join pair on pair.repo = w.repo and pair.to_module = w.to_module and pair.k = best.k
where w.from_path <> pair.path"""


# -- path and route expressions ------------------------------------------------------------
def url_parts(spark, sf):
    c = frame(spark, sf, "b_gcall").distinct()
    p = F.col("called")
    return c.select(
        "repo", "file", "called",
        paths.path_only(p).alias("local"),
        paths.looks_like_path(p).alias("is_path"),
        F.size(paths.segments(paths.path_only(p))).cast("bigint").alias("n"),
        paths.owning_dir(F.col("file")).alias("owner"),
    )


QUERIES["url_parts"] = url_parts
PATH_ONLY = "case when contains(split_part({0}, '?', 1), '://') then regexp_extract(split_part({0}, '?', 1), '^[^:]*://[^/]*(/.*)?$', 1) else split_part({0}, '?', 1) end"
ORACLES["url_parts"] = f"""
with c as (select distinct repo, file, called, {PATH_ONLY.format('called')} as local from b_gcall)
select repo, file, called, local, starts_with(called, '/') or contains(called, '://') as is_path,
  len(list_filter(string_split(local, '/'), lambda s: s <> '')) as n, 'p' as owner from c"""


_DYN = "regexp_matches({0}, '^([{{].*[}}]|<.*>|[$][{{].*[}}]|:.*)$')"


def _brute(decl: str, call: str, test: str) -> str:
    return f"len({decl}) = len({call}) and len(list_filter(range(1, len({decl}) + 1), lambda i: not ({test}))) = 0"


def concept_routes(spark, sf):
    return routes.routes_for_concepts(frame(spark, sf, "b_route"), frame(spark, sf, "b_word"))


QUERIES["concept_routes"] = concept_routes
from factloom.checks.names import TOKENS, sw  # noqa: E402

ORACLES["concept_routes"] = f"""
with hw as (select distinct repo, handler, lower(unnest(list_append({TOKENS.format('handler')}, handler))) as word from (select distinct repo, handler from b_route)),
used as (select distinct h.repo, h.handler, w.name as concept from hw h join b_word w on w.repo = h.repo and {sw('h.word', 'lower(w.name)')}),
named as (select distinct r.repo, r.route, w.name as concept from (select distinct repo, route from b_route) r join b_word w on w.repo = r.repo and contains(lower(r.route), lower(w.name)))
select distinct r.repo, u.concept, r.path, r.method, r.route, r.handler, 'Used' as tier from b_route r join used u on u.repo = r.repo and u.handler = r.handler
union all select distinct r.repo, n.concept, r.path, r.method, r.route, r.handler, 'Named' from b_route r join named n on n.repo = r.repo and n.route = r.route
  where not exists (select 1 from used u where u.repo = r.repo and u.handler = r.handler and u.concept = n.concept)"""


def route_matches(spark, sf):
    return routes.match_routes(frame(spark, sf, "b_groute"), frame(spark, sf, "b_gcall"))


QUERIES["route_matches"] = route_matches
_MATCH = f"""
md as (select distinct repo, route, list_filter(string_split(split_part(route, '?', 1), '/'), lambda s: s <> '') as d from b_groute),
mc as (select distinct repo, called, list_filter(string_split({PATH_ONLY.format('called')}, '/'), lambda s: s <> '') as c from b_gcall),
mm as (select md.repo, route, called from md join mc on md.repo = mc.repo and len(d) > 0 and
  {_brute('d', 'c', f"{_DYN.format('d[i]')} or {_DYN.format('c[i]')} or lower(d[i]) = lower(c[i])")})"""
ORACLES["route_matches"] = f"with {_MATCH} select * from mm"


def route_callers(spark, sf):
    r = frame(spark, sf, "b_groute").withColumn("concept", F.regexp_replace("handler", "_.*$", ""))
    return routes.route_callers(r, frame(spark, sf, "b_gcall"))


QUERIES["route_callers"] = route_callers
ORACLES["route_callers"] = f"""with {_MATCH},
r as (select distinct repo, split_part(handler, '_', 1) as concept, route, method from b_groute),
best as (select r.repo, r.concept, mm.called, min((r.route, r.method)) as m from r join mm on mm.repo = r.repo and mm.route = r.route group by 1, 2, 3)
select distinct c.repo, b.concept, c.file, c.called, b.m[2] as method, b.m[1] as matched_route from b_gcall c join best b on b.repo = c.repo and b.called = c.called"""

_STRICT = f"""
od as (select distinct repo, route, list_filter(string_split(regexp_replace(split_part(route, '?', 1), '/+$', ''), '/'), lambda s: s <> '') as d from b_groute),
oc as (select distinct repo, path as called, list_filter(string_split(regexp_replace(split_part(path, '?', 1), '/+$', ''), '/'), lambda s: s <> '') as c from b_obs),
om as (select od.repo, route, called from od join oc on od.repo = oc.repo and {_brute('d', 'c', "starts_with(d[i], ':') or d[i] = c[i]")})"""


def contradicted_routes(spark, sf):
    return routes.contradicted_routes(frame(spark, sf, "b_groute"), frame(spark, sf, "b_obs"))


QUERIES["contradicted_routes"] = contradicted_routes
ORACLES["contradicted_routes"] = f"""with {_STRICT}
select r.repo, r.path as file, r.method, r.route, r.handler, o.path as called, o.status, count(*) as observed
from b_groute r join om on om.repo = r.repo and om.route = r.route join b_obs o on o.repo = om.repo and o.path = om.called
where o.status >= 400 group by all"""


def contradiction_summary(spark, sf):
    return routes.contradiction_summary(frame(spark, sf, "b_groute"), frame(spark, sf, "b_obs"))


QUERIES["contradiction_summary"] = contradiction_summary
ORACLES["contradiction_summary"] = f"""with {_STRICT},
a as (select repo, count(*) as checked, count(*) filter (status >= 400) as failing from b_obs o
  where exists (select 1 from om where om.repo = o.repo and om.called = o.path) group by 1),
d as (select repo, count(*) as routes, count(*) filter (not exists (select 1 from om where om.repo = r.repo and om.route = r.route)) as unverified from b_groute r group by 1)
select d.repo, routes, unverified, coalesce(checked, 0) as checked, coalesce(failing, 0) as failing from d left join a using (repo)"""


# -- reachability ------------------------------------------------------------------------
def structural_symbols(spark, sf):
    return frame(spark, sf, "b_gsym").withColumn("linked_concept", F.when(F.col("kind") == "Class", F.col("name")))


def dependents(spark, sf, ends=None):
    targets = frame(spark, sf, "b_gdecl").select("repo", F.col("name").alias("target"))
    return reach.structural_dependents(targets, structural_symbols(spark, sf), frame(spark, sf, "b_edge"), frame(spark, sf, "b_call"), ends=ends)


REACH = """
{name}(repo, key, path, depth) as (
  select repo, key, path, 0 from {starts}
  union
  select * from (
    select t.repo, t.key, e.from_path, t.depth + 1 from {name} t join b_edge e on e.repo = t.repo and e.to_path = t.path where t.depth < 3
    {extra})),
{name}_min as (select repo, key, path, min(depth) as depth from {name} group by 1, 2, 3)"""

_STARTS = "(select g.repo, g.name as key, s.path from b_gdecl g join b_gsym s on s.repo = g.repo and s.name = g.name)"
_CALLERS = "union all select t.repo, t.key, c.from_path, 1 from {name} t join b_call c on c.repo = t.repo and c.callee = t.key where t.depth = 0"
DEPENDENTS = REACH.format(name="dep", starts=_STARTS, extra=_CALLERS.format(name="dep"))


def structural_dependents(spark, sf):
    return dependents(spark, sf).groupBy("repo", "target", "depth").agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    ).withColumn("depth", F.col("depth").cast("bigint"))


QUERIES["structural_dependents"] = structural_dependents
ORACLES["structural_dependents"] = f"""with recursive {DEPENDENTS}
select repo, key as target, cast(depth as bigint) as depth, count(*) as files, min(path) as first_path, max(path) as last_path from dep_min where depth > 0 group by 1, 2, 3"""


def file_dependents(spark, sf):
    files = sql(spark, sf, "select distinct repo, to_path as path from b_edge")
    d = reach.file_dependents(files, frame(spark, sf, "b_edge"))
    return d.groupBy("repo", "key").agg(F.count(F.lit(1)).alias("dependents"), F.max("depth").cast("bigint").alias("depth"))


QUERIES["file_dependents"] = file_dependents
_FILE_STARTS = "(select distinct repo, to_path as key, to_path as path from b_edge)"
FILE_DEPS = REACH.format(name="fdep", starts=_FILE_STARTS, extra="")
ORACLES["file_dependents"] = f"""with recursive {FILE_DEPS}
select repo, key, count(*) as dependents, cast(max(depth) as bigint) as depth from fdep_min where depth > 0 group by 1, 2"""


def via_symbols(spark, sf):
    symbols = structural_symbols(spark, sf)
    d = dependents(spark, sf, reach.type_symbols(symbols))
    return reach.via_symbols(d, symbols).groupBy("repo", "target").agg(
        F.count(F.lit(1)).alias("vias"), F.min("via").alias("first_via")
    )


QUERIES["via_symbols"] = via_symbols
ORACLES["via_symbols"] = f"""with recursive {DEPENDENTS}
select d.repo, d.key as target, count(*) as vias, min(s.name) as first_via from dep_min d
join (select distinct repo, path, name from b_gsym where kind in ('Class', 'Interface')) s on s.repo = d.repo and s.path = d.path where d.depth > 0 group by 1, 2"""


# -- duplicated logic -------------------------------------------------------------------
def _literals(spark, sf):
    lines = frame(spark, sf, "b_line")
    return lines.where(paths.is_meaningful_literal(F.col("txt"))).select("repo", "path", F.lit("body").alias("unit"), F.col("txt").alias("literal"))


_LIT = """lit as (select distinct repo, path, txt from b_line where strlen(txt) >= 10
  and not regexp_matches(txt, '^(#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{4}|[0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$|rgb\\(|rgba\\()'))"""


def duplicate_logic(spark, sf):
    return duplicates.duplicate_logic(_literals(spark, sf))


QUERIES["duplicate_logic"] = duplicate_logic
_GROUPS = """u as (select repo, path, list_sort(list(txt)) as ls from lit group by 1, 2),
grp as (select repo, ls, min(path) as g, max(path) as last from u group by 1, 2)"""
ORACLES["duplicate_logic"] = f"""with {_LIT}, {_GROUPS},
gl as (select repo, g, last, unnest(ls) as txt from grp),
twin as (select a.repo, a.g as a, b.g as b, count(*) as shared from gl a join gl b on b.repo = a.repo and b.txt = a.txt and a.g < b.g group by all)
select repo, a as a_path, 'body' as a_unit, b as b_path, 'body' as b_unit, shared from twin where shared >= 3"""


def logic_groups(spark, sf):
    return duplicates.logic_groups(_literals(spark, sf))


QUERIES["logic_groups"] = logic_groups
ORACLES["logic_groups"] = f"""with {_LIT}, {_GROUPS}
select repo, g as group_path, 'body' as group_unit, path, 'body' as unit, cast(len(ls) as bigint) as literals from u join grp using (repo, ls)"""


def boilerplate(spark, sf):
    return duplicates.boilerplate_literals(_literals(spark, sf), max_df=5)


QUERIES["boilerplate_literals"] = boilerplate
ORACLES["boilerplate_literals"] = f"with {_LIT} select repo, txt as literal, count(*) as units from lit group by 1, 2 having count(*) > 5"
