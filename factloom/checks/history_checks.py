"""Checks for the timeline, archive, versions, as-of state and catalog events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.checks.bindings import frame
from factloom.checks.names import TOKENS, sw
from factloom.functions.text import age_label
from factloom.functions.words import GENERIC_ROLE_WORDS
from factloom.operators import catalog, catalog_diff, history
from factloom.session import checkpoint_folder
from factloom.sources import store

QUERIES, ORACLES = {}, {}

CUTOFF = 1705276800000  # 2024-01-15
NOW = 1706400000000
PROTECTED = "'decision_added', 'decision_removed', 'alias_introduced', 'alias_removed', 'stale_alias'"


def timeline(spark, sf):
    return history.timeline(frame(spark, sf, "b_event"), "purchases").select("repo", "id", "ts_ms", "kind", "concept")


QUERIES["timeline"] = timeline
ORACLES["timeline"] = "select repo, id, ts_ms, kind, concept from b_event where concept like 'Purchase%'"


def newest_events(spark, sf):
    return history.newest_per_repo(frame(spark, sf, "b_event"), 25).select("repo", "id", "ts_ms", "kind", "concept")


QUERIES["newest_events"] = newest_events
ORACLES["newest_events"] = """
select repo, id, ts_ms, kind, concept from b_event qualify row_number() over (partition by repo order by ts_ms desc, id desc) <= 25"""


def archived_history(spark, sf):
    live, old = history.archive_split(frame(spark, sf, "b_event"), CUTOFF)
    return history.full_history(live, old).select("repo", "id", "ts_ms", "kind", "archived")


QUERIES["archived_history"] = archived_history
ORACLES["archived_history"] = f"select repo, id, ts_ms, kind, ts_ms < {CUTOFF} and kind not in ({PROTECTED}) as archived from b_event"


def _scratch(spark):
    return f"{checkpoint_folder(spark).rstrip('/')}/store-{uuid.uuid4().hex}"


def stored_events(spark, sf):
    """Events written in two batches, one of them twice, and read back."""
    d, ev = _scratch(spark), frame(spark, sf, "b_event").select("repo", "id", "ts_ms", "kind", "concept")
    parts = {"early": ev.where(F.col("ts_ms") < CUTOFF), "late": ev.where(F.col("ts_ms") >= CUTOFF)}
    for batch in ("early", "late", "early"):
        store.append_events(parts[batch], d, batch)
    return store.read_events(spark, d)


QUERIES["stored_events"] = stored_events
ORACLES["stored_events"] = "select repo, id, ts_ms, kind, concept from b_event"


def stored_archive(spark, sf):
    """The timeline split into two stores, read back as one history."""
    d, ev = _scratch(spark), frame(spark, sf, "b_event").select("repo", "id", "ts_ms", "kind")
    store.append_events(ev, f"{d}/live", "all")
    store.archive_events(spark, f"{d}/live", f"{d}/old", f"{d}/kept", CUTOFF)
    return history.full_history(store.read_events(spark, f"{d}/kept"), store.read_events(spark, f"{d}/old"))


QUERIES["stored_archive"] = stored_archive
ORACLES["stored_archive"] = ORACLES["archived_history"]


def stored_catalog(spark, sf):
    """A catalog stored by repo, each repo saved again over itself."""
    d, c = _scratch(spark), _catalogs(spark, sf)
    for df in (c[0], c[1]):
        store.save_table(df.select("repo", "name", "table_name"), d)
    return store.load_table(spark, d)


QUERIES["stored_catalog"] = stored_catalog


def event_ages(spark, sf):
    e = frame(spark, sf, "b_event")
    return e.select("repo", "id", age_label(F.col("ts_ms"), F.lit(NOW)).alias("age"))


QUERIES["event_ages"] = event_ages
_UNIT = "case when {n} = 1 then '1 {u} ago' else cast({n} as varchar) || ' {u}s ago' end"


def _ago(u, ms):
    return _UNIT.format(n=f"(({NOW} - ts_ms) // {ms})", u=u)


ORACLES["event_ages"] = f"""
select repo, id, case when ts_ms <= 0 or ts_ms > {NOW} then null when {NOW} - ts_ms < 60000 then 'just now' when {NOW} - ts_ms < 3600000 then {_ago('minute', 60000)}
 when {NOW} - ts_ms < 86400000 then {_ago('hour', 3600000)} when {NOW} - ts_ms < 172800000 then 'yesterday' when {NOW} - ts_ms < 604800000 then {_ago('day', 86400000)}
 when {NOW} - ts_ms < 2592000000 then {_ago('week', 604800000)} else {_ago('month', 2592000000)} end as age from b_event"""


def history_digest(spark, sf):
    return history.history_digest(frame(spark, sf, "b_event"), cap=10, limit=200)


QUERIES["history_digest"] = history_digest
ORACLES["history_digest"] = """
with r as (select * from b_event qualify row_number() over (partition by repo order by ts_ms desc, id desc) <= 200),
n as (select *, row_number() over (partition by repo, kind order by ts_ms desc, id desc) as k from r),
g as (select repo, kind, count(*) as events, min(ts_ms) as oldest_ms, max(ts_ms) as newest_ms, string_agg(concept, ', ' order by k) filter (k <= 10) as names from n group by 1, 2)
select repo, kind, events, oldest_ms, newest_ms, case when kind = 'ci_passed' then 'gate passed ' || events || ' time' || case when events = 1 then '' else 's' end
  else events || case kind when 'alias_introduced' then ' alias' else ' concept' end || case when events = 1 then '' when kind = 'alias_introduced' then 'es' else 's' end ||
    case kind when 'concept_appeared' then ' appeared: ' when 'concept_renamed' then ' renamed: ' when 'concept_lost_storage' then ' without storage: ' else ' introduced: ' end
    || names || case when events > 10 then ' (+' || (events - 10) || ' more)' else '' end end as sentence from g"""
QUERIES["history_digest_whole"] = lambda spark, sf: history.history_list(frame(spark, sf, "b_event"))
ORACLES["history_digest_whole"] = """
select repo, kind, count(*) over k as events, min(ts_ms) over k as oldest_ms, max(ts_ms) over k as newest_ms, row_number() over (partition by repo, kind order by ts_ms desc, id desc) as position, concept
from b_event window k as (partition by repo, kind)"""


def repo_registry(spark, sf):
    e = frame(spark, sf, "b_event")
    known = e.where(F.col("ts_ms") < CUTOFF).groupBy(F.col("repo").alias("root")).agg(
        F.lit("old name").alias("name"), F.min("ts_ms").alias("first_registered_ms"), F.max("ts_ms").alias("last_seen_ms")
    )
    seen = e.select(F.concat("repo", F.when(F.col("kind") == "ci_passed", "x").otherwise("")).alias("root"), F.col("concept").alias("name"), F.col("ts_ms").alias("seen_ms"))
    return history.newest_repos(history.register_repos(known, seen))


QUERIES["repo_registry"] = repo_registry
ORACLES["repo_registry"] = f"""
with r as (select repo as root, 'old name' as name, min(ts_ms) as a, max(ts_ms) as b from b_event where ts_ms < {CUTOFF} group by 1
  union all select repo || case when kind = 'ci_passed' then 'x' else '' end, concept, ts_ms, ts_ms from b_event)
select root, arg_max(name, (b, name)) as name, min(a) as first_registered_ms, max(b) as last_seen_ms from r group by 1"""


def as_of_state(spark, sf):
    return history.as_of(frame(spark, sf, "b_ask"), frame(spark, sf, "b_snap"), width=8)


QUERIES["as_of_state"] = as_of_state
ORACLES["as_of_state"] = """
select a.repo, a.concept, a.version as requested_version, s.version as snapshot_version, coalesce(s.version = a.version, false) as exact, s.ts_ms, s.state, s.verdict
from b_ask a asof left join b_snap s on s.repo = a.repo and s.concept = a.concept and s.version <= a.version"""


def architecture_versions(spark, sf):
    return history.architecture_versions(frame(spark, sf, "b_member"))


QUERIES["architecture_versions"] = architecture_versions
ORACLES["architecture_versions"] = """
with s as (select repo, snap, string_agg(distinct concept, ',' order by concept) as sig, count(distinct concept) as concepts from b_member group by 1, 2),
c as (select *, sig is distinct from lag(sig) over (partition by repo order by snap) as changed from s)
select repo, snap, cast(sum(changed::int) over (partition by repo order by snap) as bigint) as version, changed, concepts from c"""


def set_changes(spark, sf):
    return history.set_changes(frame(spark, sf, "b_member"))


QUERIES["concept_set_changes"] = set_changes
ORACLES["concept_set_changes"] = """
with m as (select distinct repo, snap, concept from b_member), s as (select repo, snap, lag(snap) over (partition by repo order by snap) as prev from (select distinct repo, snap from m)),
n as (select m.repo, m.snap, m.concept from m join s on s.repo = m.repo and s.snap = m.snap where prev is not null),
p as (select m.repo, s.snap, m.concept from m join s on s.repo = m.repo and s.prev = m.snap)
select repo, snap, concept, 'added' as change from (select * from n except select * from p) union all select repo, snap, concept, 'removed' from (select * from p except select * from n)"""


def concept_snapshots(spark, sf):
    d = frame(spark, sf, "b_decl").withColumn("fields", F.filter(F.split("fields", ","), lambda x: x != "")).withColumn("relations", F.array().cast("array<string>"))
    prior = frame(spark, sf, "b_hit").groupBy("repo", "name").agg((F.max("size") * 1000).alias("first_seen_ms"))
    c = catalog.carry_first_seen(catalog.build_catalog(d, frame(spark, sf, "b_hit")), prior, F.lit(30000).cast("bigint"))
    return history.concept_snapshot(c, F.lit(7).cast("bigint"), F.lit(30000).cast("bigint"))


QUERIES["concept_snapshots"] = concept_snapshots
ORACLES["concept_snapshots"] = """
with c as (select repo, name, coalesce(arg_min(fields, path) filter (fields <> ''), '') as fields, arg_min(table_name, path) filter (table_name is not null) as table_name from b_decl group by 1, 2),
u as (select repo, name, count(*) as n, max(size) * 1000 as ms from b_hit group by 1, 2)
select c.repo, cast(7 as bigint) as version, cast(30000 as bigint) as ts_ms, c.name as concept, case when n > 0 then 'ACTIVE' else 'DECLARED_ONLY' end as verdict, table_name,
  case when fields = '' then '[]' else '["' || replace(fields, ',', '","') || '"]' end as fields, cast(least(coalesce(ms, 30000), 30000) as bigint) as first_seen_ms
from c left join u on u.repo = c.repo and u.name = c.name"""

# Two catalogs of the same parts: names, tables and fields change by attribute.
_OLD = """
o_old as (select repo, name, arg_min(table_name, path) filter (table_name is not null) as table_name, coalesce(arg_min(fields, path) filter (fields <> ''), '') as fields
  from b_decl where path not like '%/nut/%' group by 1, 2),
o_new as (select repo, case when name like 'Cold%' then 'Chilled' || substr(name, 5) when name like 'hot%' then 'heated' || substr(name, 4) else name end as name,
    arg_min(table_name, path) filter (table_name is not null) as table_name, coalesce(arg_min(fields, path) filter (fields <> ''), '') as fields
  from b_decl where path not like '%/gear/%' group by 1, 2)"""


ORACLES["stored_catalog"] = f"with {_OLD} select repo, name, table_name from o_new union all select repo, name, table_name from o_old where repo not in (select repo from o_new)"


def _catalogs(spark, sf):
    d = frame(spark, sf, "b_decl").withColumn("fields", F.filter(F.split("fields", ","), lambda x: x != "")).withColumn("relations", F.array().cast("array<string>"))
    old = catalog.assemble_concepts(d.where(~F.contains("path", F.lit("/nut/"))))
    name = (
        F.when(F.startswith("name", F.lit("Cold")), F.concat(F.lit("Chilled"), F.substr("name", F.lit(5))))
        .when(F.startswith("name", F.lit("hot")), F.concat(F.lit("heated"), F.substr("name", F.lit(4))))
        .otherwise(F.col("name"))
    )
    new = catalog.assemble_concepts(d.where(~F.contains("path", F.lit("/gear/"))).withColumn("name", name))
    return old, new


def catalog_events(spark, sf):
    old, new = _catalogs(spark, sf)
    a, d = frame(spark, sf, "b_alias"), frame(spark, sf, "b_decision").select("repo", "id", "decision")
    return catalog_diff.catalog_events(
        old, new, a.where(F.col("alias") != "legacy_large"), a.where(F.col("alias") != "legacy_medium"),
        d.where(F.col("id") != "d-small"), d.where(F.col("id") != "d-promo"),
    )


QUERIES["catalog_events"] = catalog_events
ORACLES["catalog_events"] = f"""with {_OLD},
gone as (select * from o_old o where not exists (select 1 from o_new n where n.repo = o.repo and n.name = o.name)),
came as (select * from o_new n where not exists (select 1 from o_old o where n.repo = o.repo and n.name = o.name)),
x as (select g.repo, g.name as old, c.name as new, g.table_name is not null and g.table_name = c.table_name as same,
    g.table_name as t, len(list_filter(string_split(g.fields, ','), lambda f: f <> '' and list_contains(string_split(c.fields, ','), f))) as shared,
    case when g.fields = '' then 0 else len(string_split(g.fields, ',')) end as n from gone g join came c on c.repo = g.repo),
ren as (select repo, old, min(new) as new, arg_min(case when same then 'same table ' || t else shared || ' shared fields' end, new) as via from x
  where same or (shared >= 3 and shared * 10 >= greatest(n, 1) * 6) group by 1, 2),
fresh as (select * from came c where not exists (select 1 from ren r where r.repo = c.repo and r.new = c.name)),
lost as (select * from gone c where not exists (select 1 from ren r where r.repo = c.repo and r.old = c.name)),
na as (select * from b_alias where alias <> 'legacy_medium'), oa as (select * from b_alias where alias <> 'legacy_large'),
tok as (select repo, name, lower(unnest(ts)) as t, generate_subscripts(ts, 1) as pos from (select repo, name, {TOKENS.format('name')} as ts from fresh)),
ow as (select distinct repo, name, lower(unnest(list_append({TOKENS.format('name')}, name))) as word from o_old),
h as (select tok.repo, tok.name, tok.t, tok.pos, (select min(ow.name) from ow where ow.repo = tok.repo and {sw('tok.t', 'ow.word')}) as hit,
   (select arg_min(target, alias) from na where na.repo = tok.repo and {sw('tok.t', 'lower(na.alias)')}) as via from tok where t not in ({', '.join(repr(w) for w in GENERIC_ROLE_WORDS)})),
risk as (select repo, name, arg_min(coalesce(hit, via), pos) as existing, arg_min(t, pos) as t from h where coalesce(hit, via) <> name group by 1, 2),
nw as (select distinct repo, lower(unnest(list_append({TOKENS.format('name')}, name))) as word from o_new)
select repo, 'concept_renamed' as kind, new as concept, old as related, via from ren
union all select repo, 'concept_appeared', name, null, null from fresh
union all select repo, 'duplicate_concept_risk', name, existing, t from risk
union all select repo, 'concept_lost_storage', name, null, null from lost
union all select repo, 'alias_introduced', alias, target, null from b_alias where alias = 'legacy_large'
union all select repo, 'alias_removed', alias, target, null from b_alias where alias = 'legacy_medium'
union all select repo, 'decision_added', id, decision, null from b_decision where id = 'd-small'
union all select repo, 'decision_removed', id, decision, null from b_decision where id = 'd-promo'
union all select repo, 'stale_alias', alias, target, null from na where not exists (select 1 from o_new n where n.repo = na.repo and n.name = na.target)
  and not exists (select 1 from nw where nw.repo = na.repo and {sw("lower(rtrim(na.target, 's'))", 'nw.word')})"""


def catalog_key_changes(spark, sf):
    old, new = _catalogs(spark, sf)
    return history.key_changes(old, new, ["repo", "name"])


QUERIES["catalog_key_changes"] = catalog_key_changes
ORACLES["catalog_key_changes"] = f"""with {_OLD}
select repo, name, 'removed' as change from (select repo, name from o_old except select repo, name from o_new)
union all select repo, name, 'added' from (select repo, name from o_new except select repo, name from o_old)"""
