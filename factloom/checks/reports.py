"""Checks for counts, rankings, inventories and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame
from factloom.checks.names import CATALOG, TOKENS, bound_catalog, declared, sw
from factloom.checks import names as name_checks
from factloom.checks.graph import structural_symbols
from factloom.functions import policy
from factloom.operators import catalog, catalog_diff, duplicates, summary
from factloom.plans import report
from factloom.sources import inventory

QUERIES, ORACLES = {}, {}


def _big(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def status_counts(spark, sf):
    return summary.status_counts(frame(spark, sf, "b_file"), bound_catalog(spark, sf), 25)


QUERIES["status_counts"] = status_counts
ORACLES["status_counts"] = f"""with {CATALOG},
f as (select repo, count(distinct path) as files from b_file group by 1),
c as (select repo, count(*) as concepts, count(*) filter (uses > 0) as used, count(*) filter (uses = 0 and not enum_only) as unused from o_concept group by 1),
u as (select repo, name from o_concept where uses = 0 and not enum_only qualify row_number() over (partition by repo order by name) <= 25),
n as (select repo, string_agg(name, ', ' order by name) as unused_names from u group by 1)
select f.repo, files, coalesce(concepts, 0) as concepts, coalesce(used, 0) as used, coalesce(unused, 0) as unused, coalesce(unused_names, '') as unused_names
from f left join c using (repo) left join n using (repo)"""
QUERIES["status_counts_whole"] = lambda spark, sf: summary.status_list(frame(spark, sf, "b_file"), bound_catalog(spark, sf))
ORACLES["status_counts_whole"] = f"""with {CATALOG},
f as (select repo, count(distinct path) as files from b_file group by 1),
c as (select repo, count(*) as concepts, count(*) filter (uses > 0) as used, count(*) filter (uses = 0 and not enum_only) as unused from o_concept group by 1)
select f.repo, files, coalesce(concepts, 0) as concepts, coalesce(used, 0) as used, coalesce(unused, 0) as unused, u.name
from f left join c using (repo) left join (select repo, name from o_concept where uses = 0 and not enum_only) u on u.repo = f.repo"""


def verdict_buckets(spark, sf):
    return summary.verdict_buckets(bound_catalog(spark, sf), 25)


QUERIES["verdict_buckets"] = verdict_buckets
ORACLES["verdict_buckets"] = f"""with {CATALOG},
v as (select repo, name, case when uses > 0 then 'ACTIVE' else 'DECLARED_ONLY' end as verdict from o_concept),
r as (select *, row_number() over (partition by repo, verdict order by name) as n from v)
select repo, verdict, count(*) as concepts, string_agg(name, ', ' order by name) filter (n <= 25) as names from r group by 1, 2"""
QUERIES["verdict_buckets_whole"] = lambda spark, sf: summary.verdict_list(bound_catalog(spark, sf))
ORACLES["verdict_buckets_whole"] = f"""with {CATALOG},
v as (select repo, name, case when uses > 0 then 'ACTIVE' else 'DECLARED_ONLY' end as verdict from o_concept)
select repo, verdict, count(*) over (partition by repo, verdict) as concepts, name from v"""


def declaring_dirs(spark, sf):
    return summary.declarations_per_dir(frame(spark, sf, "b_decl"))


QUERIES["declarations_per_dir"] = declaring_dirs
ORACLES["declarations_per_dir"] = """
select repo, 'crates/' || split_part(path, '/', 2) as dir, count(distinct path) as declaring_files from b_decl group by 1, 2"""


def top_concepts(spark, sf):
    return _big(summary.top_concepts(bound_catalog(spark, sf), 10), "rank")


QUERIES["top_concepts"] = top_concepts
ORACLES["top_concepts"] = f"""with {CATALOG}
select repo, name, uses, row_number() over (partition by repo order by uses desc, name) as rank from o_concept qualify rank <= 10"""
QUERIES["top_concepts_whole"] = lambda spark, sf: _big(summary.top_concepts(bound_catalog(spark, sf)), "rank")
ORACLES["top_concepts_whole"] = ORACLES["top_concepts"].replace(" qualify rank <= 10", "")


def unused_concepts(spark, sf):
    return summary.unused_concepts(bound_catalog(spark, sf), 15)


QUERIES["unused_concepts"] = unused_concepts
ORACLES["unused_concepts"] = f"""with {CATALOG}
select repo, name from o_concept where uses = 0 qualify row_number() over (partition by repo order by name) <= 15"""
QUERIES["unused_concepts_whole"] = lambda spark, sf: summary.unused_concepts(bound_catalog(spark, sf))
ORACLES["unused_concepts_whole"] = ORACLES["unused_concepts"].replace(" qualify row_number() over (partition by repo order by name) <= 15", "")


def owners(spark, sf):
    d = frame(spark, sf, "b_decl")
    usage = catalog.attach_usage(frame(spark, sf, "b_hit"), d)
    targets = d.select("repo", F.col("name").alias("target"))
    return _big(summary.owners(targets, d, usage), "rank")


QUERIES["owner_dirs"] = owners
ORACLES["owner_dirs"] = f"""with {CATALOG},
d as (select repo, name, 'crates/' || split_part(path, '/', 2) as dir, count(distinct path || kind) as declarations from b_decl group by 1, 2, 3),
u as (select repo, name, 'apps/' || split_part(path, '/', 2) as dir, count(distinct path) as uses from o_usage group by 1, 2, 3),
b as (select repo, name, dir, coalesce(declarations, 0) as declarations, coalesce(uses, 0) as uses from d full join u using (repo, name, dir)),
w as (select repo, name, arg_min(dir, (-declarations, -uses, dir)) as owner from b where declarations > 0 group by 1, 2)
select b.repo, b.name as target, dir, declarations, uses, declarations * 2 + uses as weight, owner,
  row_number() over (partition by b.repo, b.name order by declarations * 2 + uses desc, declarations desc, uses desc, dir) as rank
from b join w on w.repo = b.repo and w.name = b.name"""



def context_efficiency(spark, sf):
    d = declared(spark, sf)
    usage = catalog.attach_usage(frame(spark, sf, "b_hit"), d)
    return _big(
        summary.context_efficiency(bound_catalog(spark, sf), d, usage, frame(spark, sf, "b_file")),
        "source_bytes", "median_bytes", "mean_answer_bytes", "mean_top_bytes",
    )


QUERIES["context_efficiency"] = context_efficiency
_JSON = """'{"canonical":"' || name || '","verdict":"' || case when uses > 0 then 'ACTIVE' else 'DECLARED_ONLY' end || '","table":"' || coalesce(table_name, '')
 || '","fields":[' || case when fields = '' then '' else '"' || replace(fields, ',', '","') || '"' end
 || '],"relations":[' || case when relations = '' then '' else '"' || replace(relations, ',', '","') || '"' end || ']}'"""
ORACLES["context_efficiency"] = f"""with {CATALOG},
touch as (select repo, name, path from b_decl union select repo, name, path from o_usage),
cb as (select t.repo, t.name, sum(coalesce(f.size, 0)) as bytes from touch t left join b_file f on f.repo = t.repo and f.path = t.path group by 1, 2),
med as (select repo, list_sort(list(bytes))[len(list(bytes)) // 2 + 1] as m from cb where bytes > 0 group by 1),
top as (select repo, name, uses, table_name, fields, relations from o_concept qualify row_number() over (partition by repo order by uses desc, name) <= 10),
mean as (select t.repo, sum(strlen({_JSON.replace('name ', 't.name ', 1)})) // count(*) as a, sum(coalesce(bytes, 0)) // count(*) as b from top t left join cb on cb.repo = t.repo and cb.name = t.name group by 1),
src as (select repo, sum(size) as s from b_file group by 1),
j as (select src.repo, cast(s as bigint) as source_bytes, cast(coalesce(m, 0) as bigint) as median_bytes, cast(coalesce(a, 0) as bigint) as mean_answer_bytes, cast(coalesce(b, 0) as bigint) as mean_top_bytes
  from src left join med using (repo) left join mean using (repo)),
k as (select *, case when median_bytes > mean_answer_bytes then median_bytes when source_bytes > mean_answer_bytes then source_bytes else 0 end as base from j)
select repo, source_bytes, median_bytes, mean_answer_bytes, mean_top_bytes,
  case when base > 0 and mean_answer_bytes > 0 then round(least(99.9, greatest(0.0, (1 - cast(mean_answer_bytes as double) / base) * 100)), 1) end as reduction_pct from k"""


def ambiguous_identity(spark, sf):
    s = frame(spark, sf, "b_symbol").withColumn("path", F.regexp_replace("path", "/m[0-9]+", "/all"))
    return summary.ambiguous_identity(s.withColumn("guarded", F.col("line") > 40))


QUERIES["ambiguous_identity"] = ambiguous_identity
ORACLES["ambiguous_identity"] = """
select repo, regexp_replace(path, '/m[0-9]+', '/all') as path, name, kind, count(*) as copies from b_symbol group by 1, 2, 3, 4
having count(*) > 1 and not bool_and(line > 40)"""


def declared_dependents(spark, sf):
    return summary.declared_dependents(bound_catalog(spark, sf))


QUERIES["declared_dependents"] = declared_dependents
ORACLES["declared_dependents"] = f"""with {CATALOG},
r as (select repo, name as dependent, unnest(string_split(relations, ',')) as target from o_concept where relations <> '')
select distinct r.repo, r.target, r.dependent from r join o_concept c on c.repo = r.repo and c.name = r.target"""


def links(spark, sf):
    d = frame(spark, sf, "b_decision")
    return d.select("repo", "id", F.explode(F.split("links", ",")).alias("link"))


def invariants(spark, sf):
    d = declared(spark, sf).withColumn("name", F.lower(F.regexp_replace("name", "([a-z])([A-Z])", "$1_$2")))
    return summary.invariants(d, catalog.assemble_concepts(d), frame(spark, sf, "b_alias"), links(spark, sf))


QUERIES["invariants"] = invariants
ORACLES["invariants"] = """
with d as (select * replace (lower(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g')) as name) from b_decl),
n as (select distinct repo, name from d),
t as (select repo, name, count(distinct lower(table_name)) as k, min(table_name) as a, max(table_name) as b, bool_or(kind <> 'sql') as orm, bool_or(kind = 'sql') as s from d group by 1, 2),
l as (select repo, id, unnest(string_split(links, ',')) as link from b_decision),
x as (select l.repo, l.id, bool_or(n.name is not null) as ok, count(*) as c from l left join n on n.repo = l.repo and n.name = lower(l.link) group by 1, 2)
select repo, 'single storage identity' as rule, name as subject, a || ', ' || b as detail from t where k > 1 and orm and s
union all select repo, 'alias resolves', alias, target from b_alias a where not exists (select 1 from n where n.repo = a.repo and n.name = a.target)
union all select repo, 'decision links something known', id, c || ' links' from x where not ok"""


def query_audit(spark, sf):
    return summary.query_audit(frame(spark, sf, "b_log"), threshold=3)


QUERIES["query_audit"] = query_audit
ORACLES["query_audit"] = """
with f as (select *, trim(lower(regexp_replace(regexp_replace(regexp_replace(sql, '''[^'']*''', '?', 'g'), '[0-9][0-9.]*', '?', 'g'), '\\s+', ' ', 'g'))) as fingerprint from b_log),
g as (select repo, fingerprint, count(*) as executions, count(distinct bind_key) as bind_keys, cast(sum(elapsed_us) as bigint) as elapsed_us, arg_min(sql, (op_id, seq)) as example_sql from f group by 1, 2)
select *, (bind_keys >= 3 and executions >= 3) or executions >= 12 as suspicious from g"""


# -- inventory ----------------------------------------------------------------------------
def scan_set(spark, sf):
    t = inventory.scannable_files(frame(spark, sf, "b_tree"), frame(spark, sf, "b_exclude"))
    return t.select("repo", "path", "size")


QUERIES["scan_set"] = scan_set
_VISIBLE = "not (path like 'node_modules/%' or path like 'src/vendor/%' or path like 'legacy/%' or path like 'env1/%')"
ORACLES["scan_set"] = f"""
select repo, path, size from b_tree where {_VISIBLE} and split_part(path, '.', 2) in ('py', 'ts', 'rs', 'sql', 'sh')"""


def unclassified(spark, sf):
    return inventory.unclassified_files(frame(spark, sf, "b_tree"), frame(spark, sf, "b_exclude"))


QUERIES["unclassified_files"] = unclassified
ORACLES["unclassified_files"] = f"select repo, path, split_part(path, '.', 2) as ext from b_tree where {_VISIBLE} and split_part(path, '.', 2) in ('lua', 'zig')"


def blind(spark, sf):
    return inventory.blind_files(frame(spark, sf, "b_tree"), frame(spark, sf, "b_exclude"))


QUERIES["blind_files"] = blind
ORACLES["blind_files"] = f"select repo, path from b_tree where {_VISIBLE} and split_part(path, '.', 2) in ('lua', 'zig', 'sh')"


def folder_listing(spark, sf):
    t = frame(spark, sf, "b_tree")
    docs = inventory.folder_listing(t, "legacy/old", inventory.DOCUMENT_EXTS, "documents")
    photos = inventory.folder_listing(t, "legacy/old", inventory.PHOTO_EXTS, "photos")
    return docs.unionByName(photos).select("repo", "id", "domain", "location", "tier", F.col("attributes")["extension"].alias("ext"), F.col("attributes")["bytes"].alias("bytes"))


QUERIES["folder_listing"] = folder_listing
ORACLES["folder_listing"] = """
select repo, domain || ':' || path as id, domain, path as location, 'Derived' as tier, ext, cast(size as varchar) as bytes from (
  select *, lower(split_part(path, '.', 2)) as ext, case when lower(split_part(path, '.', 2)) in ('pdf', 'md') then 'documents' else 'photos' end as domain from b_tree)
where path like 'legacy/old/%' and ext in ('pdf', 'md', 'jpg', 'png')"""


def coverage(spark, sf):
    return inventory.coverage_report(frame(spark, sf, "b_tree"), frame(spark, sf, "b_exclude"))


QUERIES["coverage_report"] = coverage
ORACLES["coverage_report"] = f"""
with e as (select repo, split_part(path, '.', 2) as ext from b_tree where {_VISIBLE})
select repo, case ext when 'py' then 'Python' when 'ts' then 'TypeScript/JavaScript' when 'rs' then 'Rust' when 'sh' then 'Shell' else '.' || ext end as language,
  case when ext in ('py', 'ts', 'rs') then 'supported' when ext = 'sh' then 'unsupported' else 'unclassified' end as support, count(*) as files
from e where ext in ('py', 'ts', 'rs', 'sh', 'lua', 'zig') group by 1, 2, 3"""


# -- settings and access ---------------------------------------------------------------------
def settings(spark, sf):
    return policy.layered_settings(
        frame(spark, sf, "b_domain"), frame(spark, sf, "b_project_setting"), frame(spark, sf, "b_shared_setting"), policy.DEFAULT_ON
    )


QUERIES["layered_settings"] = settings
SETTINGS = """o_set as (select d.repo, d.name, coalesce(p.enabled, s.enabled, d.name in ('code', 'git')) as enabled,
  case when p.enabled is not null then 'project-config' when s.enabled is not null then 'shared-config' when d.name in ('code', 'git') then 'default-enabled' else 'default-disabled' end as source
  from b_domain d left join b_project_setting p on p.repo = d.repo and p.name = d.name left join b_shared_setting s on s.name = d.name)"""
ORACLES["layered_settings"] = f"with {SETTINGS} select * from o_set"


def access(spark, sf):
    f = frame(spark, sf, "b_file").withColumn(
        "path",
        F.when(F.col("size") % 11 == 0, F.concat(F.lit(".ssh/"), "path")).when(F.col("size") % 11 == 1, F.concat(F.lit("home/Chromium/"), "path"))
        .when(F.col("size") % 11 == 2, F.concat("path", F.lit(".PEM"))).otherwise(F.col("path")),
    )
    s = settings(spark, sf).where("name = 'docker'")
    allowed, reason = policy.check_resource(F.col("path"), F.col("name"), F.col("enabled"), F.col("source"))
    return f.join(s, "repo").select(
        "repo", "path", allowed.alias("allowed"), reason.alias("reason"),
        policy.attribute_allowed(F.lit("documents"), F.lit("Metadata"), F.when(F.col("size") % 2 == 0, F.array(F.lit("content")))).alias("metadata_ok"),
    )


QUERIES["access_check"] = access
ORACLES["access_check"] = f"""with {SETTINGS},
f as (select repo, size, case size % 11 when 0 then '.ssh/' || path when 1 then 'home/Chromium/' || path when 2 then path || '.PEM' else path end as path from b_file),
x as (select f.*, s.enabled, s.source, case size % 11 when 0 then 'secret directory .ssh' when 1 then 'browser profile chromium' when 2 then 'secret-like name .pem' end as denied
  from f join o_set s on s.repo = f.repo and s.name = 'docker')
select repo, path, denied is null and enabled as allowed, case when denied is not null then 'denied always: ' || denied when enabled then 'docker is enabled'
  else 'docker is disabled (' || source || ')' end as reason, size % 2 = 1 as metadata_ok from x"""


def bound_settings(spark, sf):
    s = settings(spark, sf).withColumnRenamed("name", "domain")
    return s.withColumn("confirmed", F.when(F.length("repo") == 8, F.lit(True)).when(F.col("domain") == "photos", F.lit(False)))


def gaps(spark, sf):
    blind_rows = frame(spark, sf, "b_blind").withColumn("ext", F.lit("lua"))
    return report.gap_register(bound_catalog(spark, sf), blind_rows, bound_settings(spark, sf)).select("repo", "kind", "domain", "amount")


QUERIES["gap_register"] = gaps
GAPS = """o_s as (select repo, name as domain, enabled, source, name in ('code', 'git', 'docker', 'systemd') as structured,
    case when length(repo) = 8 then true when name = 'photos' then false end as confirmed from o_set),
o_on as (select *, enabled or (not structured and source not like '%-config' and coalesce(confirmed, false)) as is_on,
    not structured and source not like '%-config' and confirmed is null as waits from o_s),
o_never as (select 'git' as d, 'Observed' as t union all select 'documents', 'Explicit' union all select 'documents', 'Inferred' union all select 'photos', 'Explicit'
  union all select 'photos', 'Inferred' union all select 'messages', 'Explicit' union all select 'messages', 'Inferred'),
o_gap as (
  select repo, 'unsupported_language' as kind, '' as domain, count(*) as amount from b_blind group by 1
  union all select repo, 'tier_not_producible', domain || ':' || t, 1 from o_on join o_never on d = domain where is_on
  union all select repo, 'unstructured_domain_unconfirmed', domain, 1 from o_on where not is_on and waits
  union all select repo, 'domain_disabled', domain, 1 from o_on where not is_on and not waits
  union all select repo, 'usage_unobserved', '', count(*) from o_concept where uses = 0 and not enum_only group by 1)"""
ORACLES["gap_register"] = f"with {CATALOG}, {SETTINGS}, {GAPS} select * from o_gap"


def known(spark, sf):
    s = settings(spark, sf).withColumnRenamed("name", "domain")
    return report.register_known(bound_catalog(spark, sf), frame(spark, sf, "b_file"), s).drop("as_of_ms")


QUERIES["register_known"] = known
ORACLES["register_known"] = f"""with {CATALOG}, {SETTINGS},
c as (select repo, count(*) as concepts, count(*) filter (uses > 0) as used from o_concept group by 1),
f as (select repo, count(distinct path) as files from b_file group by 1),
d as (select repo, string_agg(name, ',' order by name) as domains from o_set where enabled group by 1)
select repo, coalesce(files, 0) as files, concepts, used, coalesce(domains, '') as domains from c left join f using (repo) left join d using (repo)"""


def register_delta(spark, sf):
    c = bound_catalog(spark, sf)
    blind_rows = frame(spark, sf, "b_blind").withColumn("ext", F.lit("lua"))
    s = bound_settings(spark, sf)
    early = s.withColumn("confirmed", F.lit(None).cast("boolean"))
    old_c = c.where(F.col("has_orm"))
    files = frame(spark, sf, "b_file")
    old_files = files.where(~F.startswith("path", F.lit("docs/")))
    return report.register_delta(
        report.register_known(old_c, old_files, s), report.register_known(c, files, s),
        report.gap_register(old_c, blind_rows.where(F.lit(False)), early), report.gap_register(c, blind_rows, s),
    )


QUERIES["register_delta"] = register_delta
ORACLES["register_delta"] = f"""with {CATALOG}, {SETTINGS}, {GAPS},
o_old as (select repo, domain, enabled as was_on, not structured and source not like '%-config' as waits from o_s),
o_before as (
  select distinct repo, 'tier_not_producible:' || domain || ':' || t as item from o_old join o_never on d = domain where was_on
  union select repo, 'unstructured_domain_unconfirmed:' || domain from o_old where not was_on and waits
  union select repo, 'domain_disabled:' || domain from o_old where not was_on and not waits
  union select repo, 'usage_unobserved:' from o_concept where uses = 0 and not enum_only and has_orm),
o_after as (select distinct repo, kind || ':' || domain as item from o_gap),
o_counts as (select c.repo, f.files - g.files as files, c.n - c.m as concepts, c.u - c.v as used from
  (select repo, count(*) as n, count(*) filter (has_orm) as m, count(*) filter (uses > 0) as u, count(*) filter (uses > 0 and has_orm) as v from o_concept group by 1) c
  join (select repo, count(*) as files from b_file group by 1) f using (repo) join (select repo, count(*) as files from b_file where path not like 'docs/%' group by 1) g using (repo))
select repo, 'count' as what, 'files' as item, files as delta from o_counts union all select repo, 'count', 'concepts', concepts from o_counts union all select repo, 'count', 'used', used from o_counts
union all select repo, 'gap_present', item, 1 from o_after a where not exists (select 1 from o_before b where b.repo = a.repo and b.item = a.item)
union all select repo, 'gap_resolved', item, -1 from o_before a where not exists (select 1 from o_after b where b.repo = a.repo and b.item = a.item)"""


def decisions(spark, sf):
    d = frame(spark, sf, "b_decision")
    return d.withColumn("rejected", F.split("rejected", ";")).withColumn("links", F.split("links", ","))


def tour(spark, sf):
    return _big(report.tour(bound_catalog(spark, sf), frame(spark, sf, "b_alias"), decisions(spark, sf)), "position")


QUERIES["tour"] = tour
ORACLES["tour"] = f"""with {CATALOG}
select repo, 'important' as section, row_number() over (partition by repo order by uses desc, name) as position, name as text from o_concept qualify position <= 8
union all select repo, 'ignorable', 0, name from (select repo, name from o_concept where uses = 0 qualify row_number() over (partition by repo order by name) <= 10)
union all select repo, 'mistake', 0, alias || ' is ' || target from b_alias
union all select repo, 'mistake', 1, r || ' was rejected by ' || id from (select repo, id, unnest(string_split(rejected, ';')) as r from b_decision)
union all select repo, 'reading_minutes', 0, cast(greatest(sum(len(string_split(decision, ' ')) + len(string_split(because, ' '))) // 200, 1) as varchar) from b_decision group by 1"""


def stale_aliases(spark, sf):
    return catalog_diff.stale_aliases(frame(spark, sf, "b_alias"), frame(spark, sf, "b_decl"))


QUERIES["stale_aliases"] = stale_aliases
STALE = f"""o_nw as (select distinct repo, lower(unnest(list_append({TOKENS.format('name')}, name))) as word from b_decl),
o_stale as (select a.repo, a.alias, a.target from b_alias a where not exists (select 1 from b_decl d where d.repo = a.repo and d.name = a.target)
  and not exists (select 1 from o_nw w where w.repo = a.repo and {sw("lower(rtrim(a.target, 's'))", 'w.word')}))"""
ORACLES["stale_aliases"] = f"with {STALE} select * from o_stale"


def glance(spark, sf):
    c = bound_catalog(spark, sf)
    ev = frame(spark, sf, "b_event").withColumn("repo", F.concat(F.lit("Brand#"), F.substr("repo", F.lit(2))))
    fam = duplicates.name_families(c, links(spark, sf))
    return report.glance(c, duplicates.name_duplicates(c), stale_aliases(spark, sf), frame(spark, sf, "b_decision"), fam, ev)


QUERIES["glance"] = glance
_DUP = name_checks.ORACLES["name_duplicate_pairs"].split(",\nst as", 1)[1].split("\nselect p.repo", 1)
ORACLES["glance"] = f"""with {CATALOG}, {STALE},
st as{_DUP[0]},
dup as (select p.repo, unnest([p.a, p.b]) as name from pairs p join st x on x.repo = p.repo and x.name = p.a join st y on y.repo = p.repo and y.name = p.b where x.has_orm <> y.has_orm),
dn as (select repo, count(distinct name) as n from dup group by 1),
ftok as (select repo, lower(unnest({TOKENS.format('name')})) as t from o_concept where table_name is not null),
fam as (select repo, t as token, count(*) as members from ftok where length(t) >= 5 group by 1, 2 having count(*) >= 3),
lk as (select repo, lower(unnest(string_split(links, ','))) as l from b_decision),
free as (select * from fam where not exists (select 1 from lk where lk.repo = fam.repo and {sw('fam.token', 'lk.l')})),
fr as (select repo, count(*) as families, string_agg(token, ', ' order by token) filter (k <= 5) as undecided_families from (select *, row_number() over (partition by repo order by token) as k from free) group by 1),
ev as (select 'Brand#' || substr(repo, 2) as repo, ts_ms, id from b_event qualify row_number() over (partition by repo order by ts_ms desc, id desc) <= 5),
er as (select repo, count(*) as recent_changes, max(ts_ms) as last_change_ms from ev group by 1),
ce as (select repo, count(*) as concepts from o_concept group by 1),
sa as (select repo, count(*) as stale_aliases from o_stale group by 1), de as (select repo, count(distinct id) as decisions from b_decision group by 1)
select ce.repo, concepts, coalesce(dn.n, 0) as needs_alias, coalesce(stale_aliases, 0) as stale_aliases, coalesce(decisions, 0) as decisions, coalesce(families, 0) as families,
  coalesce(recent_changes, 0) as recent_changes, last_change_ms, coalesce(undecided_families, '') as undecided_families
from ce left join dn using (repo) left join sa using (repo) left join de using (repo) left join fr using (repo) left join er using (repo)"""
