"""Checks for change sets, semantic diffs, decisions and alias chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame, sql
from factloom.checks.graph import REACH
from factloom.checks.reports import links
from factloom.operators import chains, governance, summary
from factloom.plans import questions
from factloom.session import cut_lineage
from factloom.sources import changes

QUERIES, ORACLES = {}, {}


def _lists(df):
    arr = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "[,;]"), lambda x: x != "")
    return df.withColumn("links", arr("links")).withColumn("rejected", arr("rejected"))


# -- chains --------------------------------------------------------------------------
def canonical_aliases(spark, sf):
    return governance.canonical_aliases(frame(spark, sf, "b_chain"))


QUERIES["canonical_aliases"] = canonical_aliases
ORACLES["canonical_aliases"] = """
with recursive w(repo, alias, cur, n) as (select repo, alias, target, 1 from b_chain union all
  select w.repo, w.alias, c.target, n + 1 from w join b_chain c on c.repo = w.repo and c.alias = w.cur where n < 40),
e as (select repo, alias, arg_max(cur, n) as root, max(n) as n from w group by 1, 2)
select repo, alias, case when n < 40 and trim(root) <> '' then root end as root, case when n >= 40 then 'alias cycle' when trim(root) = '' then 'empty alias target' end as error from e"""


def chain_depths(spark, sf):
    c = frame(spark, sf, "b_chain").where(F.trim("target") != "").select("repo", F.col("alias").alias("node"), F.col("target").alias("next"))
    return chains.resolve_chains(c).groupBy("repo", "root", "cycle").agg(F.count(F.lit(1)).alias("nodes"))


QUERIES["chain_roots"] = chain_depths
ORACLES["chain_roots"] = """
with recursive c as (select * from b_chain where trim(target) <> ''), w(repo, alias, cur, n) as (select repo, alias, target, 1 from c union all
  select w.repo, w.alias, c.target, n + 1 from w join c on c.repo = w.repo and c.alias = w.cur where n < 40),
e as (select repo, alias, arg_max(cur, n) as root, max(n) as n from w group by 1, 2)
select repo, case when n < 40 then root end as root, n >= 40 as cycle, count(*) as nodes from e group by 1, 2, 3"""


# -- decisions -----------------------------------------------------------------------
def decision_errors(spark, sf):
    return governance.decision_errors(_lists(frame(spark, sf, "b_ledger"))).distinct()


QUERIES["decision_errors"] = decision_errors
ORACLES["decision_errors"] = """
with recursive d as (select * from b_ledger), o as (select repo, id, bool_or(status = 'active') as alive from d group by 1, 2),
nx as (select repo, id, min(superseded_by) as nxt from d where superseded_by is not null group by 1, 2),
w(repo, id, cur, n) as (select repo, id, nxt, 1 from nx union all select w.repo, w.id, x.nxt, n + 1 from w join nx x on x.repo = w.repo and x.id = w.cur where n < 60)
select distinct repo, id, 'blank field' as error from d where trim(decision) = ''
union all select repo, id, 'duplicate id' from d group by 1, 2 having count(*) > 1
union all select distinct repo, id, 'superseded without successor' from d where status = 'superseded' and superseded_by is null
union all select distinct repo, id, 'supersedes itself' from d where status = 'superseded' and superseded_by = id
union all select distinct d.repo, d.id, case when o.alive is null then 'successor does not exist' else 'successor is not active' end from d left join o on o.repo = d.repo and o.id = d.superseded_by
  where status = 'superseded' and superseded_by <> d.id and coalesce(o.alive, false) = false
union all select distinct repo, id, 'successor on a decision that is not superseded' from d where status <> 'superseded' and superseded_by is not null
union all select distinct repo, id, 'supersession cycle' from w where n >= 60"""


def governing_decisions(spark, sf):
    t = sql(spark, sf, "select repo, path || '::' || name as target from b_symbol union select repo, name from b_decl")
    l = sql(spark, sf, "select repo, id, links as link from b_decision").withColumn("link", F.explode(F.split("link", ",")))
    extra = sql(spark, sf, "select distinct repo, 'sym' as id, name as link from b_symbol where kind = 'Function'")
    return governance.governing_decisions(t, l.select("repo", "id", "link").unionByName(extra))


QUERIES["governing_decisions"] = governing_decisions
ORACLES["governing_decisions"] = """
with l as (select repo, id, unnest(string_split(links, ',')) as link from b_decision union select distinct repo, 'sym', name from b_symbol where kind = 'Function'),
t as (select repo, path || '::' || name as target from b_symbol union select repo, name from b_decl)
select distinct t.repo, t.target, l.id from t join l on l.repo = t.repo and (t.target = l.link or ends_with(t.target, '::' || l.link))"""


def stale_links(spark, sf):
    names = sql(spark, sf, "select repo, name from b_decl union select repo, name from b_symbol")
    extra = sql(spark, sf, "select repo, 'via' as id, alias as link from b_alias")
    al = sql(spark, sf, "select repo, alias, target from b_alias union all select distinct repo, 'Lostpromo', 'legacy_promo' from b_alias where alias <> 'legacy_small' and repo < 'Brand#15'")
    return governance.stale_links(links(spark, sf).unionByName(extra), names, al)


QUERIES["stale_links"] = stale_links
ORACLES["stale_links"] = """
with l as (select repo, id, unnest(string_split(links, ',')) as link from b_decision union all select repo, 'via', alias from b_alias),
n as (select repo, name from b_decl union select repo, name from b_symbol),
a as (select repo, alias, target from b_alias union all select distinct repo, 'Lostpromo', 'legacy_promo' from b_alias where alias <> 'legacy_small' and repo < 'Brand#15')
select l.* from l where not exists (select 1 from n where n.repo = l.repo and n.name = l.link)
 and not exists (select 1 from a join n on n.repo = a.repo and n.name = a.target where a.repo = l.repo and a.alias = l.link)
 and not exists (select 1 from a join a b on b.repo = a.repo and b.alias = a.target join n on n.repo = a.repo and n.name = b.target where a.repo = l.repo and a.alias = l.link)"""


# -- change sets --------------------------------------------------------------------------
def _snap(spark, sf, side):
    return frame(spark, sf, "b_fsnap").where(F.col("side") == side)


def _changes(spark, sf):
    lone = sql(spark, sf, "select repo, 'scratch/' || w1 as path from b_part where sz = 3")
    return changes.changed_files(_snap(spark, sf, "before"), _snap(spark, sf, "after"), lone)


QUERIES["changed_files"] = _changes
CHANGES = """
o_b as (select * from b_fsnap where side = 'before'), o_a as (select * from b_fsnap where side = 'after'),
o_gone as (select repo, path, content_hash as h, array_to_string(list_slice(string_split(path, '/'), -3, -1), '/') as tail from o_b b where not exists (select 1 from o_a a where a.repo = b.repo and a.path = b.path)),
o_came as (select repo, path, content_hash as h, array_to_string(list_slice(string_split(path, '/'), -3, -1), '/') as tail from o_a a where not exists (select 1 from o_b b where a.repo = b.repo and a.path = b.path)),
o_near as (select g.repo, g.path as old_path, c.path from (select *, row_number() over (partition by repo, h, tail order by path) as n from o_gone) g
  join (select *, row_number() over (partition by repo, h, tail order by path) as n from o_came) c on c.repo = g.repo and c.h = g.h and c.tail = g.tail and c.n = g.n),
o_far as (select g.repo, g.path as old_path, c.path from (select *, row_number() over (partition by repo, h order by path) as n from o_gone x where not exists (select 1 from o_near m where m.repo = x.repo and m.old_path = x.path)) g
  join (select *, row_number() over (partition by repo, h order by path) as n from o_came x where not exists (select 1 from o_near m where m.repo = x.repo and m.path = x.path)) c on c.repo = g.repo and c.h = g.h and c.n = g.n),
o_moved as (select * from o_near union all select * from o_far),
o_change as (select repo, 'R' as status, path, old_path from o_moved
  union all select repo, 'A', path, null from o_came c where not exists (select 1 from o_moved m where m.repo = c.repo and m.path = c.path)
  union all select repo, 'D', path, null from o_gone c where not exists (select 1 from o_moved m where m.repo = c.repo and m.old_path = c.path)
  union all select a.repo, 'M', a.path, null from o_a a join o_b b on a.repo = b.repo and a.path = b.path and a.content_hash <> b.content_hash
  union all select distinct repo, '??', 'scratch/' || w1, null from b_part where sz = 3)"""
ORACLES["changed_files"] = f"with {CHANGES} select * from o_change"


def change_impact(spark, sf):
    snap = _snap(spark, sf, "after")
    decls = snap.select("repo", F.col("camel").alias("name"), "path")
    usage = sql(spark, sf, "select repo, w2 as name, path from b_fsnap where side = 'after'")
    symbols = snap.select("repo", F.concat("w1", F.lit("Fn")).alias("name"), "path")
    routes = snap.select("repo", F.concat(F.lit("/"), "w2").alias("route"), "path")
    return questions.change_impact(_changes(spark, sf), decls, usage, symbols, routes, frame(spark, sf, "b_fedge"))


QUERIES["change_impact"] = change_impact
ORACLES["change_impact"] = f"""with {CHANGES}, t as (select distinct repo, path from o_change), a as (select o_a.* from o_a join t using (repo, path))
select repo, 'concept' as what, camel as name, path from a union select repo, 'concept', w2, path from a union select repo, 'symbol', w1 || 'Fn', path from a union select repo, 'route', '/' || w2, path from a
union select e.repo, 'importer', e.from_path, e.from_path from b_fedge e where exists (select 1 from t where t.repo = e.repo and t.path in (e.from_path, e.to_path))"""


# -- semantic diff ---------------------------------------------------------------------
def _objects(spark, sf, side):
    s = _snap(spark, sf, side)
    one = lambda *c: F.array(*c)
    v2 = F.col("ver") == 2
    decls = s.select("repo", "path", F.col("camel").alias("name"), F.lit("prisma").alias("kind"), F.col("snake").alias("table_name"), F.when(v2, one("w1", "w2")).otherwise(one("w2")).alias("fields"), one("ty").alias("relations"))
    symbols = s.select("repo", "path", F.concat("w1", F.lit("Fn"), "pk").alias("name"), F.lit("Function").alias("kind"), F.col("w2").alias("source"))
    imports = s.select("repo", F.col("path").alias("from_path"), F.when(v2, F.concat("w1", F.lit("/new"))).otherwise(F.col("w1")).alias("to_module"), one("w2").alias("names"))
    routes = s.where("sz > 20").select("repo", "path", F.lit("GET").alias("method"), F.concat(F.lit("/"), "w2").alias("route"), F.when(v2, "w1").otherwise("w2").alias("handler"))
    return governance.semantic_objects(decls, symbols, imports, routes)


def _mutations(spark, sf, all_dependents=False):
    ch = changes.changed_files(_snap(spark, sf, "before"), _snap(spark, sf, "after"))
    odd = _snap(spark, sf, "after").where("sz = 31").select("repo", "path", F.lit("twice").alias("reason"))
    return governance.semantic_diff(ch, _objects(spark, sf, "before"), _objects(spark, sf, "after"), frame(spark, sf, "b_fedge"), odd, all_dependents)


def semantic_diff(spark, sf):
    return _mutations(spark, sf, all_dependents=True).select("repo", "path", "old_path", "object", "name", "resource", "kind", "dependents", "decision_required")


QUERIES["semantic_diff"] = semantic_diff
_OBJ = """o_obj as (select side, repo, path, object, name, key from (
  select side, repo, path, 'concept' as object, camel as name, camel || '|' || ver as v, camel as key from b_fsnap
  union all select side, repo, path, 'symbol', w1 || 'Fn' || pk, 'x', w1 || 'Fn' || pk from b_fsnap
  union all select side, repo, path, 'relationship', case when ver = 2 then w1 || '/new' else w1 end, 'x', case when ver = 2 then w1 || '/new' else w1 end from b_fsnap
  union all select side, repo, path, 'route', '/' || w2, 'x', '/' || w2 || case when ver = 2 then 'h1' else 'h2' end from b_fsnap where sz > 20)),
o_val as (select side, repo, path, ver from b_fsnap),
o_ch as (select repo, path, coalesce(old_path, path) as old_path from o_change where status <> '??' and path not like '%.md'),
o_sb as (select c.repo, c.path, c.old_path, o.object, o.key, o.name, v.ver from o_ch c join o_obj o on o.side = 'before' and o.repo = c.repo and o.path = c.old_path join o_val v on v.side = 'before' and v.repo = c.repo and v.path = c.old_path),
o_sa as (select c.repo, c.path, c.old_path, o.object, o.key, o.name, v.ver from o_ch c join o_obj o on o.side = 'after' and o.repo = c.repo and o.path = c.path join o_val v on v.side = 'after' and v.repo = c.repo and v.path = c.path),
o_m0 as (select coalesce(a.repo, b.repo) as repo, coalesce(a.path, b.path) as path, coalesce(a.old_path, b.old_path) as old_path, coalesce(a.object, b.object) as object, coalesce(a.name, b.name) as name,
    case when a.key is not null and b.key is not null and (a.object <> 'concept' or a.ver = b.ver) then case when coalesce(a.path, b.path) <> coalesce(a.old_path, b.old_path) then 'Renamed' end
     when b.key is null then case when a.object in ('relationship', 'route') then 'RelationshipAdded' else 'Added' end
     when a.key is null then case when b.object in ('relationship', 'route') then 'RelationshipRemoved' else 'Removed' end
     when a.path <> a.old_path then 'Renamed' else 'Modified' end as kind
  from o_sa a full join o_sb b on a.repo = b.repo and a.path = b.path and a.old_path = b.old_path and a.object = b.object and a.key = b.key),
o_m1 as (select repo, path, old_path, object, name, kind, case when object = 'concept' then name else path || '::' || name end as resource from o_m0 where kind is not null
  union all select c.repo, c.path, c.old_path, 'file', 'twice', 'Unknown', c.path from o_ch c join o_a a on a.repo = c.repo and a.path = c.path where a.sz = 31),"""
_FDEP = REACH.format(name="sd", starts="(select distinct repo, old_path as key, old_path as path from o_ch)", extra="").replace("b_edge", "b_fedge")
_DIFF = f"""{CHANGES.replace("union all select distinct repo, '??', 'scratch/' || w1, null from b_part where sz = 3", "")}, {_OBJ} {_FDEP},
o_dep as (select repo, key, count(*) as n from sd_min where depth > 0 group by 1, 2),
o_mut as (select m.repo, m.path, m.old_path, m.object, m.name, m.resource, m.kind, least(coalesce(d.n, 0), 10) as dependents, m.object = 'concept' or coalesce(d.n, 0) >= 10 or m.kind = 'Unknown' as decision_required
  from o_m1 m left join o_dep d on d.repo = m.repo and d.key = m.old_path)"""
ORACLES["semantic_diff"] = f"with recursive {_DIFF.replace('least(coalesce(d.n, 0), 10)', 'coalesce(d.n, 0)')} select * from o_mut"


# -- governed diff -----------------------------------------------------------------------
def _governance(spark, sf):
    muts = cut_lineage(_mutations(spark, sf))
    targets = muts.where("decision_required and kind <> 'Unknown'").select("repo", F.col("resource").alias("target"))
    before, after = _lists(frame(spark, sf, "b_decision")), _lists(frame(spark, sf, "b_decision2"))
    supplied, errors = governance.applicable_decisions(before, after, targets, frame(spark, sf, "b_alias"))
    return muts, supplied, errors


def applicable_decisions(spark, sf):
    _, supplied, errors = _governance(spark, sf)
    return supplied.select("repo", "target", "id", F.lit("").alias("error")).unionByName(errors.select("repo", F.col("link").alias("target"), "id", "error"))


QUERIES["applicable_decisions"] = applicable_decisions
_GOVERN = f"""{_DIFF},
o_tgt as (select distinct repo, resource as target, string_split(resource, '::')[-1] as last from o_mut where decision_required and kind <> 'Unknown'),
o_root as (select repo, alias, target as root from b_alias),
o_dl as (select d.repo, d.id, l as link, coalesce(r.root, l) as to_name from (select repo, id, unnest(list_distinct(string_split(links, ','))) as l from b_decision2 where id like 'n-%' or id = 'd-small') d
  left join o_root r on r.repo = d.repo and r.alias = d.l),
o_hit as (select distinct l.repo, l.id, l.link, t.target from o_dl l join o_tgt t on t.repo = l.repo and (t.last = l.to_name or t.target = l.to_name)),
o_err as (select repo, id, link, 'ambiguous link' as error from o_hit group by 1, 2, 3 having count(*) > 1),
o_sup as (select distinct repo, target, id from o_hit h where not exists (select 1 from o_err e where e.repo = h.repo))"""
ORACLES["applicable_decisions"] = f"""with recursive {_GOVERN}
select repo, target, id, '' as error from o_sup union all select repo, link, id, error from o_err"""


def governed_diff(spark, sf):
    muts, supplied, errors = _governance(spark, sf)
    arr = lambda c: F.split(c, ",")
    policy = frame(spark, sf, "b_policy").withColumn("protected", arr("protected")).withColumn("excludes", arr("excludes"))
    after = _lists(frame(spark, sf, "b_decision2"))
    after_links = after.select("repo", "id", F.explode("links").alias("link"))
    return governance.governed_diff(muts, policy, after_links, supplied, errors)


QUERIES["governed_diff"] = governed_diff
ORACLES["governed_diff"] = f"""with recursive {_GOVERN},
p as (select m.*, p.enforcement, m.decision_required and p.repo is not null and (m.path like 'src/small/%' or m.path like 'moved/%') and not (m.path like 'src/small/red/%') as need
  from o_mut m left join b_policy p on p.repo = m.repo),
l as (select distinct repo, id, unnest(string_split(links, ',')) as link from b_decision2),
g as (select r.repo, r.resource, count(distinct l.id) as n from (select distinct repo, resource from o_mut) r join l on l.repo = r.repo and (r.resource = l.link or ends_with(r.resource, '::' || l.link)) group by 1, 2),
s as (select repo, target, count(*) as n from o_sup group by 1, 2),
x as (select p.repo, p.path, p.object, p.resource, p.kind, p.need as decision_required, coalesce(g.n, 0) as governing, coalesce(s.n, 0) as supplied,
  case when p.need and p.kind = 'Unknown' then 'unknown_structural_mutation' when p.need and s.n is null then 'missing_decision' end as violation, coalesce(p.enforcement, 'advisory') <> 'advisory' as hard
  from p left join g on g.repo = p.repo and g.resource = p.resource left join s on s.repo = p.repo and s.target = p.resource)
select repo, path, object, resource, kind, decision_required, governing, supplied, violation, violation is not null and hard as blocking from x
union all select e.repo, '', 'decision', e.id || ' ' || e.link, 'Unknown', true, 0, 0, 'invalid_decision_update', p.enforcement <> 'advisory' from o_err e join b_policy p on p.repo = e.repo"""


def stale_facts(spark, sf):
    files = _snap(spark, sf, "after").select("repo", "path", F.col("ver").cast("bigint").alias("size"), F.col("sz").alias("mtime_ms"))
    facts = _snap(spark, sf, "before").select("repo", "path", F.col("ver").cast("bigint").alias("size"), F.col("sz").alias("mtime_ms"), F.when(F.col("sz") == 40, 0).otherwise(1).alias("extractor_version"))
    todo = changes.stale_facts(files, facts, 1).select("repo", "path", F.lit("extract").alias("action"))
    return todo.unionByName(changes.kept_facts(facts, files, 1).select("repo", "path", F.lit("keep").alias("action")))


QUERIES["stale_facts"] = stale_facts
ORACLES["stale_facts"] = """
with b as (select * from b_fsnap where side = 'before' and sz <> 40), a as (select * from b_fsnap where side = 'after')
select a.repo, a.path, case when b.path is null then 'extract' else 'keep' end as action from a left join b on b.repo = a.repo and b.path = a.path and b.ver = a.ver and b.sz = a.sz"""
