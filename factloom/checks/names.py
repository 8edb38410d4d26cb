"""Checks for names: matching, assembling, ranking, resolving, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame, stored
from factloom.functions import words
from factloom.operators import catalog, duplicates, ranking
from factloom.plans import resolve

QUERIES, ORACLES = {}, {}


def declared(spark, sf):
    """Bound declarations with real array columns."""
    d = frame(spark, sf, "b_decl")
    arr = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    return d.withColumn("fields", arr("fields")).withColumn("relations", arr("relations"))


def bound_catalog(spark, sf):
    """The bound catalog as a stored table, written once per session and scale."""
    return stored(spark, sf, "catalog", lambda: catalog.build_catalog(declared(spark, sf), frame(spark, sf, "b_hit")))


# Bounded-inflection equality by its definition, over lower-cased ASCII columns a and b.
def sw(a: str, b: str) -> str:
    shared = f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, 1, i) = substr({b}, 1, i)))"
    return (
        f"({a} = {b} or (substr({a}, 1, 4) = substr({b}, 1, 4) and {shared} >= 4 and {shared} * 10 >= least(length({a}), length({b})) * 7"
        f" and length({a}) - {shared} <= 3 and length({b}) - {shared} <= 3))"
    )


TOKENS = "regexp_extract_all(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+')"

# Catalog as the oracle sees it: first non-empty value per concept by (path, line).
CATALOG = """
o_sites as (select distinct repo, name, path, kind from b_decl),
o_usage as (select distinct h.repo, h.name, h.path, h.kind from b_hit h
  where exists (select 1 from b_decl d where d.repo = h.repo and d.name = h.name)
  and not exists (select 1 from b_decl d where d.repo = h.repo and d.name = h.name and d.path = h.path)),
o_uses as (select repo, name, count(distinct path) as uses, count(*) as use_pairs from o_usage group by 1, 2),
o_concept as (
  select c.repo, c.name, c.n_sites, c.has_orm, c.enum_only, c.fields, c.relations, c.table_name, c.in_memory,
    coalesce(u.uses, 0) as uses, coalesce(u.use_pairs, 0) as use_pairs,
    case when c.relations = '' then 0 else len(string_split(c.relations, ',')) end as n_relations
  from (select repo, name, count(distinct path || '|' || kind) as n_sites, bool_or(kind <> 'sql') as has_orm,
      bool_and(kind = 'prisma-enum') as enum_only,
      coalesce(arg_min(fields, path) filter (fields <> ''), '') as fields,
      coalesce(arg_min(relations, path) filter (relations <> ''), '') as relations,
      arg_min(table_name, path) filter (table_name is not null) as table_name,
      bool_and(kind in ('rust', 'go-struct')) and max(table_name) is null as in_memory
    from b_decl group by 1, 2) c left join o_uses u using (repo, name))"""


# -- same word, tokens, generic words ------------------------------------------------------
def same_word_pairs(spark, sf):
    """Same-word pairs of all terms and all name words of a repo."""
    names = words.name_words(frame(spark, sf, "b_decl").select("repo", "name").distinct(), "name")
    return words.match_words(frame(spark, sf, "b_term"), names, "term", "word", ("repo",))


QUERIES["same_word_pairs"] = same_word_pairs
ORACLES["same_word_pairs"] = f"""
with w as (select distinct repo, lower(word) as word from (
    select repo, name as word from b_decl union all select repo, unnest({TOKENS.format('name')}) from b_decl))
select t.repo, t.term, w.word from b_term t join w on t.repo = w.repo and substr(lower(t.term), 1, 1) = substr(w.word, 1, 1)
where {sw('lower(t.term)', 'w.word')}"""


def name_token_list(spark, sf):
    d = frame(spark, sf, "b_symbol").select("repo", "name").distinct()
    toks = words.name_tokens(F.col("name"))
    return d.select(
        "repo",
        "name",
        F.array_join(toks, "|").alias("tokens"),
        F.size(F.filter(toks, lambda t: words.is_generic_role_word(t))).cast("bigint").alias("generic"),
        words.slugify(F.col("name")).alias("slug"),
    )


QUERIES["name_token_list"] = name_token_list
ORACLES["name_token_list"] = f"""
with t as (select distinct repo, name, {TOKENS.format('name')} as ts from b_symbol)
select repo, name, array_to_string(ts, '|') as tokens,
  cast(len(list_filter(ts, lambda x: lower(x) in ({', '.join(repr(w) for w in words.GENERIC_ROLE_WORDS)}))) as bigint) as generic,
  trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug
from t"""


def names_concept_pairs(spark, sf):
    """Column form of the name match, over a name and six words of each part."""
    return frame(spark, sf, "b_namepair").distinct().where(words.names_concept(F.col("name"), F.col("term")))


QUERIES["names_concept_pairs"] = names_concept_pairs
ORACLES["names_concept_pairs"] = f"""
with w as (select distinct repo, name, term, lower(unnest(list_append({TOKENS.format('name')}, name))) as word from b_namepair)
select distinct repo, name, term from w where {sw('lower(term)', 'word')}"""


# -- catalog ----------------------------------------------------------------------------
def concept_catalog(spark, sf):
    c = catalog.build_catalog(declared(spark, sf), frame(spark, sf, "b_hit"))
    return c.select(
        "repo", "name", F.col("n_sites").cast("bigint").alias("n_sites"), "has_orm", "in_memory", "enum_only",
        F.array_join("fields", ",").alias("fields"), F.array_join("relations", ",").alias("relations"), "table_name", "uses", "use_pairs",
    )


QUERIES["concept_catalog"] = concept_catalog
ORACLES["concept_catalog"] = f"""with {CATALOG}
select repo, name, n_sites, has_orm, in_memory, enum_only, fields, relations, table_name, uses, use_pairs from o_concept"""


def usage_attached(spark, sf):
    return catalog.attach_usage(frame(spark, sf, "b_hit"), frame(spark, sf, "b_decl"))


QUERIES["usage_attached"] = usage_attached
ORACLES["usage_attached"] = f"with {CATALOG} select repo, name, path, kind from o_usage"


def sql_fold(spark, sf):
    d = declared(spark, sf)
    folded = catalog.fold_sql_concepts(d, catalog.assemble_concepts(d))
    out = catalog.assemble_folded(folded)
    return out.select("repo", "name", F.col("n_sites").cast("bigint").alias("n_sites"), "table_name", F.array_join("fields", ",").alias("fields"))


QUERIES["sql_fold"] = sql_fold
ORACLES["sql_fold"] = f"""with {CATALOG},
step as (select s.repo, s.name, min(o.name) as nxt from o_concept s join o_concept o
  on s.repo = o.repo and lower(o.table_name) = lower(s.name) and o.name <> s.name where not s.has_orm group by 1, 2)
select repo, name, count(distinct path || '|' || kind) as n_sites,
  coalesce(arg_min(t, path) filter (t is not null), arg_min(spare, path) filter (spare is not null)) as table_name,
  coalesce(arg_min(f, path) filter (f <> ''), '') as fields
from (select d.repo, coalesce(s.nxt, d.name) as name, d.path, d.kind, case when s.nxt is null then d.table_name end as t,
    case when s.nxt is not null then d.table_name end as spare, case when s.nxt is null then d.fields end as f
  from b_decl d left join step s on s.repo = d.repo and s.name = d.name) x group by 1, 2"""


def symbol_links(spark, sf):
    linked = catalog.link_symbols(frame(spark, sf, "b_symbol"), frame(spark, sf, "b_decl").select("repo", "name").distinct())
    return linked.select("repo", "path", "name", "kind", "line", "linked_concept")


QUERIES["symbol_links"] = symbol_links
_LINKS = f"""
o_name as (select distinct repo, name from b_decl),
o_symw as (select distinct repo, name, lower(unnest(list_append({TOKENS.format('name')}, name))) as word from
  (select distinct repo, name from b_symbol where kind in ('Class', 'Interface', 'Route', 'Event'))),
o_fuzzy as (select w.repo, w.name, min(n.name) as concept from o_symw w join o_name n
  on n.repo = w.repo and substr(lower(n.name), 1, 1) = substr(w.word, 1, 1) and {sw('w.word', 'lower(n.name)')} group by 1, 2),
o_linked as (select s.repo, s.path, s.name, s.kind, s.line, case when s.kind in ('Class', 'Interface', 'Route', 'Event')
    then coalesce(n.name, f.concept) end as linked_concept
  from b_symbol s left join o_name n on n.repo = s.repo and n.name = s.name left join o_fuzzy f on f.repo = s.repo and f.name = s.name)"""
ORACLES["symbol_links"] = f"with {_LINKS} select * from o_linked"


def concept_symbols(spark, sf):
    linked = catalog.link_symbols(frame(spark, sf, "b_symbol"), frame(spark, sf, "b_decl").select("repo", "name").distinct())
    return catalog.symbols_of_concepts(linked)


QUERIES["concept_symbols"] = concept_symbols
ORACLES["concept_symbols"] = f"""with {_LINKS}
select repo, linked_concept as concept, kind, name, path, line, row_number() over (partition by repo, linked_concept order by kind, name, path, line) as position
from o_linked where linked_concept is not null"""


def file_fact_list(spark, sf):
    linked = catalog.link_symbols(frame(spark, sf, "b_symbol"), frame(spark, sf, "b_decl").select("repo", "name").distinct())
    facts = catalog.file_facts(frame(spark, sf, "b_decl"), linked)
    known = catalog.known_files(frame(spark, sf, "b_decl"), frame(spark, sf, "b_file"))
    return catalog.file_counts(known, facts)


QUERIES["file_fact_list"] = file_fact_list
ORACLES["file_fact_list"] = f"""with {_LINKS},
facts as (select distinct repo, path, name, 'concept' as what from b_decl
  union all select distinct repo, path, name, 'symbol' from o_linked where linked_concept is null)
select f.repo, d.path is not null as declares, x.what, count(distinct f.path) as files, count(x.name) as names
from b_file f left join (select distinct repo, path from b_decl) d on d.repo = f.repo and d.path = f.path
left join facts x on x.repo = f.repo and x.path = f.path group by 1, 2, 3"""


def signature(spark, sf):
    return catalog.catalog_signature(bound_catalog(spark, sf))


QUERIES["catalog_signature"] = signature
ORACLES["catalog_signature"] = f"""with {CATALOG},
h as (select repo, sha256(name || ':' || coalesce(table_name, '')) as d from o_concept)
select repo, count(*) as concepts,
  cast(sum(cast('0x' || substr(d, 1, 12) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(d, 13, 12) as bigint)) as varchar) as signature
from h group by 1"""


# -- ranking and resolving -------------------------------------------------------------------
def ranked_concepts(spark, sf):
    return ranking.rank_concepts(frame(spark, sf, "b_term"), bound_catalog(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


_RANK = f"""{CATALOG},
o_words as (select distinct repo, name, lower(name) as word, true as exact from o_concept
  union all select distinct repo, name, lower(unnest({TOKENS.format('name')})), false from o_concept),
o_vocab as (select distinct repo, word from o_words),
o_pairs as (select t.repo, t.term, v.word from b_term t join o_vocab v on v.repo = t.repo and substr(v.word, 1, 1) = substr(lower(t.term), 1, 1)
  where {sw('lower(t.term)', 'v.word')}),
o_cand as (select p.repo, p.term, w.name, bool_or(w.exact) as exact from o_pairs p join o_words w on w.repo = p.repo and w.word = p.word group by 1, 2, 3),
o_scored as (select c.repo, c.term, c.name,
    case when exact and has_orm then 'exact-orm' when exact then 'exact-sql' when has_orm then 'token-orm' else 'token-sql' end as tier,
    case when exact and has_orm then 2404 when exact then 1803 when has_orm then 1202 else 601 end as tier_score,
    least(uses, 500) as usage_score, least(n_relations, 100) as relation_score
  from o_cand c join o_concept o on o.repo = c.repo and o.name = c.name),
o_ranked as (select *, tier_score + usage_score + relation_score as total,
    row_number() over (partition by repo, term order by tier_score + usage_score + relation_score desc, name) as rank from o_scored)"""
QUERIES["ranked_concepts"] = ranked_concepts
ORACLES["ranked_concepts"] = f"""with {_RANK}
select repo, term, cast(rank as bigint) as rank, name, tier, tier_score, usage_score, relation_score, total from o_ranked where rank <= 6"""


def competing_concepts(spark, sf):
    c = ranking.competing(ranking.rank_concepts(frame(spark, sf, "b_term"), bound_catalog(spark, sf)))
    return c.groupBy("repo", "term").agg(F.count(F.lit(1)).alias("competing"), F.min("name").alias("first_name"))


QUERIES["competing_concepts"] = competing_concepts
ORACLES["competing_concepts"] = f"""with {_RANK}
select repo, term, count(*) as competing, min(name) as first_name from o_ranked where rank between 2 and 6 group by 1, 2"""


def symbol_hit_list(spark, sf):
    h = ranking.symbol_hits(frame(spark, sf, "b_term"), frame(spark, sf, "b_symbol"), cap=10)
    return h.select("repo", "term", "exact", "path", "name", "kind")


QUERIES["symbol_hit_list"] = symbol_hit_list
ORACLES["symbol_hit_list"] = f"""
with w as (select distinct repo, path, name, kind, lower(name) as word, true as exact from b_symbol
  union all select distinct repo, path, name, kind, lower(unnest({TOKENS.format('name')})), false from b_symbol),
v as (select distinct repo, word from w),
p as (select t.repo, t.term, v.word from b_term t join v on v.repo = t.repo and substr(v.word, 1, 1) = substr(lower(t.term), 1, 1)
  where {sw('lower(t.term)', 'v.word')}),
h as (select p.repo, p.term, w.path, w.name, w.kind, bool_or(w.exact) as exact from p join w on w.repo = p.repo and w.word = p.word group by 1, 2, 3, 4, 5)
select repo, term, exact, path, name, kind from h
qualify row_number() over (partition by repo, term order by exact desc, path, name, kind) <= 10"""


def alias_lookups(spark, sf):
    return resolve.alias_lookup(frame(spark, sf, "b_term"), frame(spark, sf, "b_alias"))


_ALIAS = f"""
o_aw as (select distinct repo, alias, target, lower(unnest(list_append({TOKENS.format('alias')}, alias))) as word from b_alias),
o_via as (select t.repo, t.term, min(a.alias) as alias, arg_min(a.target, a.alias) as target from b_term t join o_aw a
  on a.repo = t.repo and {sw('lower(t.term)', 'a.word')} group by 1, 2)"""
QUERIES["alias_lookup"] = alias_lookups
ORACLES["alias_lookup"] = f"with {_ALIAS} select * from o_via"


def resolved_terms(spark, sf):
    r = resolve.resolve_terms(
        frame(spark, sf, "b_term"), bound_catalog(spark, sf), frame(spark, sf, "b_symbol"), frame(spark, sf, "b_route"),
        frame(spark, sf, "b_file"), frame(spark, sf, "b_alias"), frame(spark, sf, "b_blind"),
    )
    return r.select("repo", "term", "verdict", "canonical", "via", "competing", "confidence")


# The verdict ladder, one rung per common table expression, over effective search words.
RESOLVE = f"""{CATALOG}, {_ALIAS},
o_work as (select t.repo, t.term, v.alias, coalesce(v.target, t.term) as search, c.name as fixed, c.uses as fixed_uses
  from b_term t left join o_via v on v.repo = t.repo and v.term = t.term
  left join o_concept c on c.repo = t.repo and v.alias is not null and c.name = v.target),
o_search as (select distinct repo, search as term from o_work where fixed is null),
o_words as (select distinct repo, name, lower(name) as word, true as exact from o_concept
  union all select distinct repo, name, lower(unnest({TOKENS.format('name')})), false from o_concept),
o_symwords as (select distinct repo, path, name, lower(name) as word, true as exact from b_symbol
  union all select distinct repo, path, name, lower(unnest({TOKENS.format('name')})), false from b_symbol),
o_routewords as (select distinct repo, path, handler as name, lower(handler) as word, true as exact from b_route
  union all select distinct repo, path, handler, lower(unnest({TOKENS.format('handler')})), false from b_route),
o_stem as (select repo, path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') as name from b_file),
o_filewords as (select distinct repo, lower(name) as word from o_stem union select distinct repo, lower(unnest({TOKENS.format('name')})) from o_stem),
o_vocab as (select distinct repo, word from o_words union select repo, word from o_symwords union select repo, word from o_routewords union select repo, word from o_filewords),
o_pairs as (select t.repo, t.term, v.word from o_search t join o_vocab v on v.repo = t.repo and substr(v.word, 1, 1) = substr(lower(t.term), 1, 1)
  where {sw('lower(t.term)', 'v.word')}),
o_cand as (select p.repo, p.term, w.name, bool_or(w.exact) as exact from o_pairs p join o_words w on w.repo = p.repo and w.word = p.word group by 1, 2, 3),
o_ranked as (select c.repo, c.term, c.name, row_number() over (partition by c.repo, c.term order by
    case when exact and has_orm then 2404 when exact then 1803 when has_orm then 1202 else 601 end + least(uses, 500) + least(n_relations, 100) desc, c.name) as rank
  from o_cand c join o_concept o on o.repo = c.repo and o.name = c.name),
o_top as (select r.repo, r.term, max(r.name) filter (rank = 1) as name,
    coalesce(string_agg(r.name, ', ' order by rank) filter (rank between 2 and 6), '') as competing from o_ranked r where rank <= 6 group by 1, 2),
o_sym as (select p.repo, p.term, arg_min(w.name, (case when w.exact then 0 else 1 end, w.path, w.name)) as hit from o_pairs p join o_symwords w on w.repo = p.repo and w.word = p.word group by 1, 2),
o_rt as (select p.repo, p.term, arg_min(w.name, (case when w.exact then 0 else 1 end, w.path, w.name)) as hit from o_pairs p join o_routewords w on w.repo = p.repo and w.word = p.word group by 1, 2),
o_fl as (select distinct p.repo, p.term from o_pairs p join o_filewords w on w.repo = p.repo and w.word = p.word),
o_bl as (select distinct repo from b_blind),
o_raw as (select w.repo, w.term, w.alias,
    case when w.fixed is not null then case when w.fixed_uses > 0 then 'ACTIVE' else 'DECLARED_ONLY' end
      when tc.name is not null then case when tc.uses > 0 then 'ACTIVE' when tc.in_memory then 'SYMBOL' else 'DECLARED_ONLY' end
      when s.hit is not null or r.hit is not null then 'STRUCTURAL' when f.term is not null then 'UNKNOWN'
      when b.repo is not null then 'INSUFFICIENT_COVERAGE' else 'ABSENT' end as v,
    coalesce(w.fixed, t.name, s.hit, r.hit) as canonical,
    case when w.fixed is not null then '' else coalesce(t.competing, '') end as competing
  from o_work w left join o_top t on w.fixed is null and t.repo = w.repo and t.term = w.search
  left join o_concept tc on tc.repo = w.repo and tc.name = t.name
  left join o_sym s on s.repo = w.repo and s.term = w.search left join o_rt r on r.repo = w.repo and r.term = w.search
  left join o_fl f on f.repo = w.repo and f.term = w.search left join o_bl b on b.repo = w.repo),
o_resolved as (select repo, term, case when alias is not null and canonical is null then 'UNKNOWN' else v end as verdict, canonical,
    case when alias is not null then 'alias' else 'name' end as via, competing,
    case when alias is not null and canonical is null then 'low' when v = 'UNKNOWN' then 'low' when v in ('ACTIVE', 'STRUCTURAL', 'ABSENT') then 'high'
      when v = 'INSUFFICIENT_COVERAGE' then 'unknown' else 'medium' end as confidence from o_raw)"""
QUERIES["resolved_terms"] = resolved_terms
ORACLES["resolved_terms"] = f"with {RESOLVE} select * from o_resolved"


# -- duplicates -----------------------------------------------------------------------------
def name_duplicates(spark, sf):
    return duplicates.name_duplicates(bound_catalog(spark, sf))


QUERIES["name_duplicates"] = name_duplicates
ORACLES["name_duplicates"] = f"""with {CATALOG},
st as (select repo, name, has_orm from o_concept where table_name is not null),
tok as (select repo, name, has_orm, unnest(ts) as t, generate_subscripts(ts, 1) as pos from (select *, {TOKENS.format('name')} as ts from st)),
w as (select distinct repo, name, lower(name) as word from st union select repo, name, lower(t) from tok),
tv as (select distinct repo, lower(t) as token from tok where length(t) >= 5),
wv as (select distinct repo, word from w),
m as (select tv.repo, tv.token, wv.word from tv join wv on tv.repo = wv.repo and {sw('tv.token', 'wv.word')}),
pairs as (select a.repo, a.name as a, w.name as b, arg_min(lower(a.t), a.pos) as shared_token from tok a join m on m.repo = a.repo and m.token = lower(a.t)
  join w on w.repo = m.repo and w.word = m.word where a.name < w.name group by 1, 2, 3)"""
_DUPLICATES = ORACLES["name_duplicates"]
ORACLES["name_duplicates"] += """,
bear as (select repo, lower(t) as token, name, min(pos) as pos from tok where length(t) >= 5 group by 1, 2, 3),
hit as (select distinct m.repo, m.token, w.name from m join w on w.repo = m.repo and w.word = m.word),
rel as (select repo, token, name, 'bearer' as role, cast(pos as bigint) as pos from bear union all select repo, token, name, 'match', null from hit)
select repo, token, name, role, pos, has_orm from rel join st using (repo, name) where (repo, token) in (select (repo, token) from hit group by repo, token having count(*) > 1)"""


def name_duplicate_pairs(spark, sf):
    """All pairs of the names that aliases point to."""
    c = bound_catalog(spark, sf)
    return duplicates.duplicate_pairs(duplicates.name_duplicates(c), frame(spark, sf, "b_alias").select("repo", F.col("target").alias("name")))


QUERIES["name_duplicate_pairs"] = name_duplicate_pairs
ORACLES["name_duplicate_pairs"] = f"""{_DUPLICATES}
select p.repo, p.a, p.b, p.shared_token, x.has_orm <> y.has_orm as needs_alias
from pairs p join st x on x.repo = p.repo and x.name = p.a join st y on y.repo = p.repo and y.name = p.b
where exists (select 1 from b_alias l where l.repo = p.repo and l.target in (p.a, p.b))"""


def name_families(spark, sf):
    links = frame(spark, sf, "b_alias").select("repo", F.regexp_replace("alias", "legacy_", "").alias("link"))
    return duplicates.name_families(bound_catalog(spark, sf), links)


QUERIES["name_families"] = name_families
ORACLES["name_families"] = f"""with {CATALOG},
tok as (select repo, name, lower(unnest({TOKENS.format('name')})) as t from o_concept where table_name is not null),
fam as (select repo, t as token, count(*) as members from tok where length(t) >= 5
  and t not in ({', '.join(repr(w) for w in words.GENERIC_ROLE_WORDS)}) group by 1, 2 having count(*) >= 3),
free as (select * from fam where not exists (select 1 from b_alias a where a.repo = fam.repo and {sw('fam.token', "replace(a.alias, 'legacy_', '')")}))
select repo, token, members from free"""
