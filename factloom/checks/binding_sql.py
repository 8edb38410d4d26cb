"""Views over the driver tables, in SQL that Spark and DuckDB both run.

A pair gives (spark, duckdb) where the dialects differ.
"""

from __future__ import annotations


def _cap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || lower(substr({x}, 2))"


def _explode_words(source: str, cols: str, text: str, pattern: str) -> tuple[str, str]:
    """Words of ``text`` (a lower-cased expression), one row each with a 1-based position."""
    spark = (
        f"select {cols}, cast(p + 1 as bigint) as pos, word from (select {cols}, regexp_extract_all({text}, '{pattern}', 0) as ws"
        f" from {source}) lateral view posexplode(ws) as p, word"
    )
    duck = (
        f"select {cols}, cast(pos as bigint) as pos, word from (select {cols}, unnest(ws) as word, generate_subscripts(ws, 1) as pos"
        f" from (select {cols}, regexp_extract_all({text}, '{pattern}') as ws from {source}))"
    )
    return spark, duck


BINDINGS: dict[str, str | tuple[str, str]] = {}

# -- names: parts as declarations -------------------------------------------------------
BINDINGS["b_part"] = f"""
select pk, repo, sz, w1, w2, ty, price, w1 || '_' || w2 || '_' || ty as snake,
  {_cap('w1')} || {_cap('w2')} || {_cap('ty')} as camel
from (select p_partkey as pk, p_brand as repo, cast(p_size as bigint) as sz, split_part(p_name, ' ', 1) as w1,
  split_part(p_name, ' ', 2) as w2, lower(p_type) as ty, p_retailprice as price from part)"""

BINDINGS["b_decl"] = f"""
select repo, 'crates/' || ty || '/' || w2 || '/f' || cast(pk as string) || '.' || ext as path, cast(1 as bigint) as line,
  case when kind = 'sql' then snake else camel end as name, kind,
  case when pk % 5 = 0 then '' else 'id,' || w1 || '_code,' || w2 || '_no,' || ty end as fields,
  case when pk % 3 = 0 then {_cap('w1')} || {_cap('w2')} || 'Economy' else '' end as relations,
  case when kind in ('sql', 'drizzle') then snake when kind = 'prisma' then snake || 's' else null end as table_name
from (select *, case sz % 5 when 0 then 'sql' when 1 then 'django' when 2 then 'rust' when 3 then 'prisma' else 'drizzle' end as kind,
  case sz % 5 when 0 then 'sql' when 1 then 'py' when 2 then 'rs' when 3 then 'prisma' else 'ts' end as ext from b_part)"""

BINDINGS["b_hit"] = """
select p.repo, case when p.sz % 5 = 0 then p.snake else p.camel end as name, 'apps/' || lower(l.l_returnflag) || '/o' || cast(l.l_orderkey as string) || '.py' as path,
  case when l.l_linenumber % 2 = 0 then 'raw-sql' else 'tree-sitter' end as kind, cast(l.l_quantity as bigint) as size
from lineitem l join b_part p on p.pk = l.l_partkey where p.sz not between 8 and 14"""

BINDINGS["b_symbol"] = f"""
select repo, 'src/' || w1 || '/m' || cast(pk as string) || '.ts' as path,
  case pk % 4 when 0 then {_cap('w1')} || 'Client' when 1 then w2 || '_service' when 2 then camel else {_cap('w2')} || 'Created' end as name,
  case pk % 4 when 0 then 'Class' when 1 then 'Function' when 2 then 'Interface' else 'Event' end as kind, sz as line
from b_part"""

BINDINGS["b_route"] = """
select repo, 'src/' || w1 || '/m' || cast(pk as string) || '.ts' as path, case when pk % 2 = 0 then 'GET' else 'POST' end as method,
  '/' || w2 || 's/' || case when pk % 3 = 0 then ':id' else ty end as route, w1 || '_' || w2 || '_endpoint' as handler
from b_part"""

BINDINGS["b_file"] = """
select repo, path, max(size) as size from (
  select repo, path, cast(1000 as bigint) as size from b_decl
  union all select repo, path, cast(300 as bigint) + line as size from b_symbol
  union all select repo, path, size from b_hit
  union all select repo, 'docs/ledger' || cast(pk as string) || '_' || w1 || '.md' as path, sz as size from b_part
  union all select repo, 'tools/' || w2 || cast(pk as string) || case when repo in ('Brand#1', 'Brand#3', 'Brand#14') then '.lua' else '.py' end as path, sz as size
    from b_part where sz > 40
) f group by repo, path"""

BINDINGS["b_blind"] = "select repo, path from b_file where path like '%.lua'"

BINDINGS["b_term"] = f"""
select distinct repo, term from (
  select repo, w1 as term from b_part union all select repo, w2 || 's' from b_part union all select repo, ty from b_part
  union all select repo, 'un' || w1 from b_part union all select repo, camel from b_part union all select repo, snake from b_part
  union all select repo, 'zz' || w2 from b_part union all select repo, {_cap('w1')} || {_cap('w2')} from b_part
  union all select repo, 'clients' from b_part union all select repo, 'endpoints' from b_part
  union all select repo, 'service' from b_part union all select repo, 'ledger' || cast(sz as string) from b_part
  union all select repo, 'nothing' || cast(sz as string) from b_part) t"""

BINDINGS["b_alias"] = """
select repo, 'legacy_' || ty as alias, case when ty = 'small' then 'Missing' || ty else min(name) end as target
from (select repo, split_part(path, '/', 2) as ty, name from b_decl) x group by repo, ty"""

# -- documents as files, their lines as literals ------------------------------------------
BINDINGS["b_doc"] = """
select lang as repo, source || '/d' || cast(doc_id as string) || '.py' as path, text as content, doc_id, source, n_chars from documents"""
BINDINGS["b_line"] = (
    """select repo, path, cast(p + 1 as bigint) as line, txt from (select repo, path, split(content, chr(10)) as ls from b_doc) d
    lateral view posexplode(ls) as p, txt""",
    """select repo, path, cast(line as bigint) as line, txt from (select repo, path, unnest(ls) as txt, generate_subscripts(ls, 1) as line
    from (select repo, path, string_split(content, chr(10)) as ls from b_doc))""",
)

# -- pages as routes and calls ---------------------------------------------------------
BINDINGS["b_page"] = """
select page_id, url, html, split_part(regexp_replace(url, '^https?://', ''), '/', 2) as repo,
  regexp_replace(url, '^https?://[^/]+', '') as local, split_part(split_part(split_part(url, '/', 5), '?', 1), '#', 1) as num from pages"""
BINDINGS["b_groute"] = """
select distinct repo, path, method, route, handler from (
  select repo, 'p/' || cast(page_id as string) || '.ts' as path, 'GET' as method, '/' || repo || '/:id' as route, 'show_' || repo as handler from b_page where num like '1%'
  union all select repo, 'p/' || cast(page_id as string) || '.ts', 'POST', '/' || repo || '/' || num, 'page_' || num from b_page
  union all select repo, 'p/' || cast(page_id as string) || '.ts', 'GET', '/{slug}', 'slug' from b_page where num like '77%'
  union all select repo, 'p/' || cast(page_id as string) || '.ts', 'GET', '/' || repo || '/' || num || '/', 'tail_' || num from b_page where num like '%5') r"""
BINDINGS["b_gcall"] = (
    """select repo, 'p/' || cast(page_id as string) || '.ts' as file, url as called from b_page
    union all select repo, file, h as called from (select repo, 'p/' || cast(page_id as string) || '.ts' as file, regexp_extract_all(html, 'href="([^"]+)"', 1) as hs from b_page)
      lateral view explode(hs) as h""",
    """select repo, 'p/' || cast(page_id as string) || '.ts' as file, url as called from b_page
    union all select repo, 'p/' || cast(page_id as string) || '.ts', unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) from b_page""",
)
BINDINGS["b_obs"] = """
select repo, local as path, cast(case when page_id % 4 = 0 then 500 when page_id % 9 = 0 then 404 else 200 end as bigint) as status from b_page"""
BINDINGS["b_word"] = f"""
select distinct repo, name from (select repo, {_cap('w1')} as name from b_part union all select repo, w2 from b_part union all select repo, ty from b_part) w"""

# -- star schema as a dependency graph -------------------------------------------------
BINDINGS["b_cust"] = """
select c_custkey as ck, 'r' || cast(n_regionkey as string) as repo, n_nationkey as nk, n_regionkey as rk, c_mktsegment as seg from customer join nation on c_nationkey = n_nationkey"""
BINDINGS["b_supp"] = """
select s_suppkey as sk, 'r' || cast(n_regionkey as string) as repo, n_nationkey as nk, n_regionkey as rk from supplier join nation on s_nationkey = n_nationkey"""
BINDINGS["b_order"] = """
select o_orderkey as ok, ck, nk, rk, repo, o_orderstatus as st, o_orderpriority as pri, o_totalprice as price from orders join b_cust on o_custkey = ck"""
BINDINGS["b_item"] = """
select l_orderkey as ok, cast(l_linenumber as bigint) as ln, l_suppkey as sk, l_partkey as pk, ck, nk, rk, repo, st, l_quantity as qty,
  l_returnflag as rf, 'l/' || cast(l_orderkey as string) || '-' || cast(l_linenumber as string) as path from lineitem join b_order on l_orderkey = ok"""
BINDINGS["b_edge"] = """
select 'r' || cast(n_regionkey as string) as repo, 'n/' || cast(n_nationkey as string) as from_path, 'r/' || cast(n_regionkey as string) as to_path from nation
union all select repo, 'c/' || cast(ck as string), 'n/' || cast(nk as string) from b_cust
union all select repo, 's/' || cast(sk as string), 'n/' || cast(nk as string) from b_supp
union all select repo, 'o/' || cast(ok as string), 'c/' || cast(ck as string) from b_order
union all select repo, path, 'o/' || cast(ok as string) from b_item
union all select repo, path, 's/' || cast(sk as string) from b_item"""
BINDINGS["b_gsym"] = """
select 'r' || cast(r_regionkey as string) as repo, 'r/' || cast(r_regionkey as string) as path, cast(r_regionkey as string) || 'Region' as name, 'Class' as kind from region
union all select 'r' || cast(n_regionkey as string), 'n/' || cast(n_nationkey as string), cast(n_nationkey as string) || 'Nation', 'Class' from nation
union all select repo, 'c/' || cast(ck as string), cast(ck as string) || 'Customer', 'Class' from b_cust
union all select repo, 's/' || cast(sk as string), cast(sk as string) || 'Supplier', 'Interface' from b_supp
union all select repo, 'o/' || cast(ok as string), 'place_order', 'Function' from b_order"""
BINDINGS["b_call"] = """
select repo, 'o/' || cast(ok as string) as from_path, 'place_order' as caller, cast(rk as string) || 'Region' as callee from b_order where st = 'F'
union all select repo, path, 'ship', cast(ck as string) || 'Customer' from b_item where rf = 'R'"""
# The same star as a catalog: concepts with relations, usage, routes and calls.
BINDINGS["b_gdecl"] = """
select repo, path, cast(1 as bigint) as line, name, kind, fields, relations, table_name from (
  select 'r' || cast(r_regionkey as string) as repo, 'r/' || cast(r_regionkey as string) as path, cast(r_regionkey as string) || 'Region' as name,
    'rust' as kind, '' as fields, '' as relations, cast(null as string) as table_name from region
  union all select 'r' || cast(n_regionkey as string), 'n/' || cast(n_nationkey as string), cast(n_nationkey as string) || 'Nation', 'django', 'id,name', cast(n_regionkey as string) || 'Region', null from nation
  union all select repo, 'c/' || cast(ck as string), cast(ck as string) || 'Customer', 'prisma', 'id,nation', cast(nk as string) || 'Nation', 'customer' || cast(ck as string) from b_cust
  union all select repo, 's/' || cast(sk as string), cast(sk as string) || 'Supplier', 'sql', '', cast(nk as string) || 'Nation', cast(sk as string) || 'Supplier' from b_supp) d"""
BINDINGS["b_ghit"] = """
select repo, cast(ck as string) || 'Customer' as name, 'o/' || cast(ok as string) as path, 'tree-sitter' as kind from b_order
union all select repo, cast(sk as string) || 'Supplier', path, case when ln % 2 = 0 then 'raw-sql' else 'tree-sitter' end from b_item
union all select repo, cast(sk as string) || 'Supplier', path, 'raw-sql' from b_item where rf = 'A'"""
BINDINGS["b_sroute"] = """
select repo, 'c/' || cast(ck as string) as path, 'GET' as method, '/customers/' || cast(ck as string) || '/{part}' as route, cast(ck as string) || 'Customer' as handler from b_cust"""
BINDINGS["b_scall"] = """
select repo, 'o/' || cast(ok as string) as file, 'http://api/Customers/' || cast(ck as string) || '/orders?st=' || st as called from b_order where st <> 'P'"""

# -- module imports -----------------------------------------------------------------------
BINDINGS["b_mfile"] = """
select distinct repo, path from (
  select repo, 'src/' || w1 || '/m' || cast(pk as string) || '.ts' as path from b_part
  union all select repo, 'src/core/' || w2 || '.rs' from b_part where sz > 10
  union all select repo, 'src/core/' || w1 || '/mod.rs' from b_part
  union all select repo, 'src/' || w2 || '.ts' from b_part
  union all select repo, 'src/' || w2 || '/index.ts' from b_part where sz > 35
  union all select repo, 'packages/' || w1 || '/src/index.ts' from b_part where sz > 25
  union all select repo, 'packages/' || w1 || '/sub/m' || cast(pk as string) || '.ts' from b_part where sz > 25) f"""
BINDINGS["b_mimp"] = """
select repo, 'src/' || w1 || '/m' || cast(pk as string) || '.ts' as from_path, case pk % 9
  when 0 then './m' || cast(pk as string) when 1 then './missing' when 2 then 'res://src/' || w1 || '/m' || cast(pk as string) || '.ts'
  when 3 then 'crate::core::' || w2 when 4 then '@acme/' || w1 when 5 then '@acme/' || w1 || '/sub/m' || cast(pk as string) || '.ts'
  when 6 then '../../src/./' || w1 || '//m' || cast(pk as string) when 7 then '../' || w2 else 'crate::core::' || w1 end as to_module, pk, w1, w2 from b_part"""
BINDINGS["b_mpkg"] = "select distinct repo, '@acme/' || w1 as name, 'packages/' || w1 as dir from b_part"

# -- events as history and as a query log -----------------------------------------------
_EVENT = f"""
select 'e' || cast(user_id % 7 as string) as repo, event_id as id, {{ms}} as ts_ms,
  case event_type when 'signup' then 'concept_appeared' when 'purchase' then 'concept_renamed' when 'error' then 'concept_lost_storage'
    when 'view' then 'ci_passed' else 'alias_introduced' end as kind,
  {_cap('event_type')} || 'Item' || cast(user_id as string) as concept, props as detail, user_id, value, event_type from events"""
BINDINGS["b_event"] = (_EVENT.format(ms="unix_millis(cast(ts as timestamp))"), _EVENT.format(ms="epoch_us(ts) // 1000"))
BINDINGS["b_log"] = (
    "select repo, cast(user_id as string) as op_id, id as seq, cast(user_id as string) as bind_key, cast(floor(value * 100) as bigint) as elapsed_us,"
    " 'SELECT *  FROM ' || event_type || '_log WHERE k = ' || regexp_extract(detail, '([0-9]+)', 1) || '.5 AND  Name = ' || chr(39) || 'x'"
    " || cast(user_id as string) || ' y' || chr(39) as sql from b_event"
)
BINDINGS["b_member"] = """
select repo, cast(floor(ts_ms / 86400000) as bigint) as snap, concept from b_event where kind <> 'ci_passed'"""
BINDINGS["b_snap"] = """
select repo, cast(floor(ts_ms / 86400000) as bigint) as version, max(ts_ms) as ts_ms, concept, cast(max(id) as bigint) as state,
  case when max(value) > 30 then 'ACTIVE' else 'DECLARED_ONLY' end as verdict from b_event group by repo, cast(floor(ts_ms / 86400000) as bigint), concept"""
BINDINGS["b_ask"] = (
    "select distinct repo, concept, cast(floor(ts_ms / 86400000) as bigint) + d as version from b_event lateral view explode(array(0, 3, -4)) as d",
    "select distinct repo, concept, version from (select repo, concept, cast(floor(ts_ms / 86400000) as bigint) + unnest([0, 3, -4]) as version from b_event)",
)

# -- documents as a file tree ------------------------------------------------------------
_TREE = """
select repo, path, size, content from (
  select lang as repo, case n_chars % 12 when 0 then 'node_modules/x/' when 1 then 'src/vendor/' when 2 then 'legacy/old/' when 3 then 'env1/lib/' else source || '/' end
    || 'd' || cast(doc_id as string) || '.' || case n_chars % 11 when 0 then 'py' when 1 then 'ts' when 2 then 'rs' when 3 then 'md' when 4 then 'lua' when 5 then 'sql'
    when 6 then 'sh' when 7 then 'png' when 8 then 'zig' when 9 then 'JPG' else 'pdf' end as path, cast({size} as bigint) as size, text as content from documents
  union all select distinct lang, 'env1/pyvenv.cfg', cast(10 as bigint), '' from documents) t"""
BINDINGS["b_tree"] = (_TREE.format(size="octet_length(text)"), _TREE.format(size="strlen(text)"))
BINDINGS["b_exclude"] = "select distinct lang as repo, 'legacy/' as prefix from documents"

# -- settings, decisions ---------------------------------------------------------------
BINDINGS["b_domain"] = (
    "select repo, name from (select distinct p_brand as repo from part) r lateral view explode(split('code,git,docker,systemd,documents,photos,messages,browser', ',')) as name",
    "select repo, unnest(string_split('code,git,docker,systemd,documents,photos,messages,browser', ',')) as name from (select distinct p_brand as repo from part) r",
)
BINDINGS["b_project_setting"] = """
select repo, name, (length(repo) + length(name)) % 2 = 0 as enabled from b_domain where length(repo) + length(name) > 13"""
BINDINGS["b_shared_setting"] = "select distinct name, length(name) % 2 = 0 as enabled from b_domain where name in ('docker', 'photos', 'git')"
BINDINGS["b_decision"] = """
select repo, 'd-' || ty as id, 'keep ' || ty || ' parts in one place' as decision, 'because ' || cast(count(*) as string) || ' parts share it' as because,
  min(snake) || ';' || min(w1) as rejected, case when ty = 'promo' then 'Lost' || ty else max(camel) end || ',' || min(w2) as links,
  'lead' as proposed_by, 'active' as status, cast(null as string) as superseded_by from b_part group by repo, ty"""

# -- goals, claims, proposals, diffs -----------------------------------------------------
BINDINGS["b_goal"] = """
select repo, 'g' || cast(pk as string) as goal_id, 'Please add ' || w1 || ' ' || w2 || 's tracking to ' || case when sz % 2 = 0 then camel else snake end
  || ' and build zz' || ty || ' reports with ' || w2 || '_service' as text from b_part
union all select 'Brand#1', 'c' || cast(conv_id as string) || '-' || cast(turn as string), text from conversations where role = 'user'"""
BINDINGS["b_claim"] = """
select repo, 'q' || cast(pk as string) as id, case pk % 7 when 0 then 'model "' || camel || '" exists' when 1 then 'model ' || camel || ' does not exist'
  when 2 then 'table "' || w2 || 's" is used in more than 12 files' when 3 then '"' || snake || '" is used in at least 12 places' when 4 then 'the thing "ledger' || cast(sz as string) || '" is absent'
  when 5 then '"zz' || w1 || '" is absent' else 'nothing to see' end as statement from b_part"""
BINDINGS["b_prop"] = """
select repo, 'p' || cast(pk as string) as id, 'CREATE TABLE ' || snake || ' (id int); create table if not exists "zz_' || w2 || 's" (x int)'
  || case when sz % 3 = 0 then '; CREATE TABLE q_' || ty || 's as select 1' else '' end as sql from b_part"""
BINDINGS["b_diff"] = f"""
select repo, 'p' || cast(pk as string) as id, 'diff --git a/x b/x' || chr(10) || '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '+CREATE TABLE ' || case when sz % 4 = 0 then 'new_zebra' else snake end
  || ' (id int)' || chr(10) || '-class Old' || {_cap('w2')} || '(models.Model):' || chr(10) || '+class ' || {_cap('w1')} || 'Ledger(models.Model):' || chr(10)
  || ' export class Kept' || chr(10) || '+export class Quux' || {_cap('w2')} || 'Service' || chr(10) || '+model ' || camel || ' {{' as diff from b_part"""
BINDINGS["b_tclaim"] = """
select repo, name || '-a' as id, 'absence' as type, name as target, cast(null as bigint) as min, cast(null as string) as within, cast(null as string) as exclude from b_gdecl
union all select repo, name || '-z', 'absence', 'zz' || name, null, null, null from b_gdecl
union all select repo, name || '-u', 'usage-threshold', name, 9, null, null from b_gdecl
union all select repo, name || '-i', 'isolation', name, null, 'o/, n/', 'l/' from b_gdecl
union all select repo, name || '-n', 'isolation', name, null, null, null from b_gdecl where kind = 'django'"""

# -- two snapshots of a source tree ------------------------------------------------------
BINDINGS["b_fsnap"] = """
select 'before' as side, repo, 'src/' || ty || '/' || w1 || '/m' || cast(pk as string) || case when pk % 10 = 0 then '.md' else '.ts' end as path, md5(camel) as content_hash, 1 as ver, pk, w1, w2, ty, camel, snake, sz
  from b_part where sz <= 44
union all select 'after', repo, case when sz between 20 and 23 then 'moved/' || ty || '/' || w1 || '/m' || cast(pk as string) || case when pk % 10 = 0 then '.md' else '.ts' end when sz = 24 then 'moved/x' || cast(pk as string) || '.ts'
    else 'src/' || ty || '/' || w1 || '/m' || cast(pk as string) || case when pk % 10 = 0 then '.md' else '.ts' end end,
  md5(camel || case when sz between 30 and 35 then 'v2' else '' end), case when sz between 30 and 35 then 2 else 1 end, pk, w1, w2, ty, camel, snake, sz
  from b_part where sz >= 5"""
BINDINGS["b_fedge"] = """
select f.repo, f.path as from_path, h.hub as to_path from b_fsnap f join (select repo, w1, min(path) as hub from b_fsnap where side = 'before' group by repo, w1) h
  on h.repo = f.repo and h.w1 = f.w1 where f.side = 'before'
union all select f.repo, f.path, h.hub from b_fsnap f join (select repo, ty, min(path) as hub from b_fsnap where side = 'before' group by repo, ty) h
  on h.repo = f.repo and h.ty = f.ty where f.side = 'before'"""
BINDINGS["b_policy"] = (
    "select repo, case when length(repo) = 7 then 'preventive' else 'advisory' end as enforcement, 'src/small,moved' as protected, 'src/small/red' as excludes"
    " from (select distinct repo from b_part) r where repo <> 'Brand#2'"
)
BINDINGS["b_decision2"] = """
select repo, id, decision, because, rejected, links, proposed_by, status, superseded_by from b_decision where id <> 'd-small'
union all select repo, 'd-small', ' keep it small ', 'because', '', 'Elsewhere', 'lead', 'active', null from b_decision where id = 'd-small'
union all select repo, 'n-' || w1, 'new ' || w1, 'needed', '', min(camel) || ',' || max(camel), 'lead', 'active', cast(null as string) from b_part group by repo, w1"""
BINDINGS["b_chain"] = """
select seg as repo, 'c' || cast(ck as string) as alias, case when ck < 3 then 'root' else 'c' || cast(cast(floor(ck / 3) as bigint) as string) end as target from b_cust where ck > 0
union all select 'HOUSEHOLD', 'x' || cast(n_nationkey as string), 'y' || cast(n_nationkey as string) from nation
union all select 'HOUSEHOLD', 'y' || cast(n_nationkey as string), 'x' || cast(n_nationkey as string) from nation
union all select 'MACHINERY', 'e' || cast(n_nationkey as string), ' ' from nation union all select 'MACHINERY', 'f' || cast(n_nationkey as string), 'e' || cast(n_nationkey as string) from nation"""
BINDINGS["b_ledger"] = """
select repo, 'd' || cast(case when ck % 97 = 5 then ck - 1 else ck end as string) as id, case when ck % 50 = 0 then '  ' else 'do ' || seg end as decision, 'because' as because, '' as rejected, seg as links,
  case when ck % 7 = 0 then 'superseded' else 'active' end as status,
  case when ck % 49 = 0 then null when ck % 7 = 0 and ck % 3 = 0 then 'd' || cast(ck as string) when ck % 7 = 0 then 'd' || cast(ck + 7 * (ck % 2) + 5 * (ck % 5) as string) when ck % 31 = 1 then 'd1' end as superseded_by
  from b_cust"""
BINDINGS["b_namepair"] = (
    "select repo, name, term from (select repo, case when sz > 25 then camel else snake end as name, array(w1 || 's', w2, ty || 'ing', 'un' || w1, camel, w2 || '_' || ty) as ts from b_part)"
    " lateral view explode(ts) as term",
    "select repo, case when sz > 25 then camel else snake end as name, unnest([w1 || 's', w2, ty || 'ing', 'un' || w1, camel, w2 || '_' || ty]) as term from b_part",
)
