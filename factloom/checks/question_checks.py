"""Checks for goals, impact, plans, guards, claims and fan-out."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame, sql, stored
from factloom.checks.graph import DEPENDENTS, structural_symbols
from factloom.checks.names import _LINKS, CATALOG, RESOLVE, TOKENS, bound_catalog, declared, sw
from factloom.checks.reports import _big, bound_settings, links
from factloom.functions.words import GENERIC_ROLE_WORDS
from factloom.operators import catalog, governance, history, summary
from factloom.plans import questions, report
from factloom.plans.resolve import resolve_terms
from factloom.session import cut_lineage
from factloom.sources import changes, inventory

QUERIES, ORACLES = {}, {}
GENERIC = ", ".join(repr(w) for w in GENERIC_ROLE_WORDS)


def star_catalog(spark, sf):
    d = frame(spark, sf, "b_gdecl")
    arr = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    d = d.withColumn("fields", arr("fields")).withColumn("relations", arr("relations"))
    return stored(spark, sf, "star", lambda: catalog.build_catalog(d, frame(spark, sf, "b_ghit")))


def evidence(spark, sf):
    return dict(
        symbols=frame(spark, sf, "b_symbol"), routes=frame(spark, sf, "b_route"), files=frame(spark, sf, "b_file"),
        aliases=frame(spark, sf, "b_alias"), blind_files=frame(spark, sf, "b_blind"),
    )


def resolve_for(terms: str) -> str:
    """The resolve oracle over another (repo, term) relation."""
    return RESOLVE.replace("b_term t", f"{terms} t")


# -- goals ---------------------------------------------------------------------------
def _names(spark, sf):
    return sql(spark, sf, "select repo, name from b_decl union select repo, name from b_symbol")


def goal_terms(spark, sf):
    return _big(questions.goal_terms(frame(spark, sf, "b_goal"), _names(spark, sf)), "position")


QUERIES["goal_terms"] = goal_terms
_STOPS = ", ".join(repr(w) for w in questions.STOP_WORDS)
GOAL = f"""
o_names as (select distinct repo, lower(name) as name from (select repo, name from b_decl union select repo, name from b_symbol)),
o_runs as (select distinct repo, goal_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) as run from b_goal),
o_exact as (select r.repo, r.goal_id, n.name from o_runs r join o_names n on n.repo = r.repo and n.name = r.run),
o_taken as (select distinct repo, goal_id, unnest(list_append(regexp_extract_all(name, '[A-Za-z0-9]+'), name)) as term from o_exact),
o_rest as (select repo, goal_id, w as term, min(pos) as pos from (select repo, goal_id, unnest(ws) as w, generate_subscripts(ws, 1) as pos
    from (select repo, goal_id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from b_goal)) where length(w) >= 4 and w not in ({_STOPS}) group by 1, 2, 3),
o_all as (select repo, goal_id, name as term, 0 as late, -length(name) as k from o_exact union all
  select repo, goal_id, term, 1, pos from o_rest r where not exists (select 1 from o_taken t where t.repo = r.repo and t.goal_id = r.goal_id and t.term = r.term)),
o_goal as (select repo, goal_id, row_number() over (partition by repo, goal_id order by late, k, term) as position, term from o_all)"""
ORACLES["goal_terms"] = f"with {GOAL} select * from o_goal"


def _intent(spark, sf):
    return questions.goal_intent(frame(spark, sf, "b_goal"), _names(spark, sf), bound_catalog(spark, sf), **evidence(spark, sf))


def goal_intent(spark, sf):
    return _big(_intent(spark, sf), "position")


QUERIES["goal_intent"] = goal_intent
INTENT = f"""{GOAL}, o_ask as (select distinct repo, term from o_goal), {resolve_for('o_ask')},
o_intent as (select g.*, r.verdict, r.canonical, case when r.verdict in ('ACTIVE', 'DECLARED_ONLY', 'SYMBOL', 'STRUCTURAL') then 'extend'
  when r.verdict in ('UNKNOWN', 'INSUFFICIENT_COVERAGE') then 'confirm' else 'create' end as bucket from o_goal g join o_resolved r on r.repo = g.repo and r.term = g.term)"""
ORACLES["goal_intent"] = f"with {INTENT} select * from o_intent"


# -- impact --------------------------------------------------------------------------
def _star_impact(spark, sf, targets=None):
    targets = targets if targets is not None else frame(spark, sf, "b_gdecl").select("repo", F.col("name").alias("target"))
    return questions.concept_impact(
        targets, star_catalog(spark, sf), structural_symbols(spark, sf), frame(spark, sf, "b_edge"), frame(spark, sf, "b_call"),
        frame(spark, sf, "b_sroute"), frame(spark, sf, "b_scall"),
    )


QUERIES["concept_impact"] = _star_impact
IMPACT = f"""{DEPENDENTS},
o_used as (select h.repo, h.name, count(distinct h.path) as files from b_ghit h join b_gdecl d on d.repo = h.repo and d.name = h.name group by 1, 2),
o_rel as (select d.repo, d.relations as target, count(distinct d.name) as dependents from b_gdecl d join b_gdecl t on t.repo = d.repo and t.name = d.relations group by 1, 2),
o_far as (select repo, key, count(*) as structural from dep_min where depth > 0 group by 1, 2),
o_calls as (select c.repo, r.handler, count(distinct c.file || ' ' || c.called) as callers from b_scall c join b_sroute r on r.repo = c.repo
  and lower(split_part(split_part(c.called, '?', 1), '/', 5)) = split_part(r.route, '/', 3) group by 1, 2),
o_impact as (select d.repo, d.name as target, coalesce(u.files, 0) as files, coalesce(r.dependents, 0) as dependents, coalesce(f.structural, 0) as structural, coalesce(c.callers, 0) as callers
  from b_gdecl d left join o_used u on u.repo = d.repo and u.name = d.name left join o_rel r on r.repo = d.repo and r.target = d.name
  left join o_far f on f.repo = d.repo and f.key = d.name left join o_calls c on c.repo = d.repo and c.handler = d.name),
o_severe as (select *, case when files > 8 or dependents > 3 or structural > 5 then 'HIGH' when files + dependents + structural + callers > 0 then 'MODERATE' else 'NONE' end as severity from o_impact)"""
ORACLES["concept_impact"] = f"with recursive {IMPACT} select * from o_severe"


def term_impact(spark, sf):
    terms = sql(spark, sf, "select repo, name as term from b_gdecl union select repo, 'qq' || lower(kind) from b_gdecl")
    out = questions.term_impact(terms, star_catalog(spark, sf), structural_symbols(spark, sf), frame(spark, sf, "b_edge"), call_edges=frame(spark, sf, "b_call"))
    return out.select("repo", "term", "verdict", "files", "structural", "severity")


QUERIES["term_impact"] = term_impact
ORACLES["term_impact"] = f"""with recursive {IMPACT},
x as (select i.repo, i.target as term, i.files, i.structural, case when i.files > 8 or dependents > 3 or structural > 5 then 'HIGH' when i.files + dependents + structural > 0 then 'MODERATE' else 'NONE' end as severity, d.kind
  from o_impact i join b_gdecl d on d.repo = i.repo and d.name = i.target)
select repo, term, case when files > 0 then 'ACTIVE' else 'DECLARED_ONLY' end as verdict, files, structural, severity from x
union all select distinct repo, 'qq' || lower(kind), 'ABSENT', cast(null as bigint), cast(null as bigint), 'UNKNOWN' from b_gdecl"""


def field_impact(spark, sf):
    req = sql(spark, sf, "select distinct repo, source as concept from b_doc").withColumn("field", F.explode(F.array(*[F.lit(x) for x in ("The", "ing", "nd.", "und", "que")])))
    usage = sql(spark, sf, "select repo, source as name, path from b_doc")
    concepts = sql(spark, sf, "select distinct repo, source as name from b_doc").withColumn("fields", F.array(F.lit("the"), F.lit("Que")))
    return questions.field_impact(req, usage, concepts, frame(spark, sf, "b_doc"))


QUERIES["field_impact"] = field_impact
ORACLES["field_impact"] = """
with f as (select unnest(['the', 'ing', 'nd.', 'und', 'que']) as field),
r as (select distinct repo, source as concept, field from b_doc, f),
h as (select d.repo, d.source as concept, f.field, count(*) as n from b_doc d, f where regexp_matches(lower(d.content), '(^|[^a-z0-9_])' || replace(f.field, '.', '[.]') || '($|[^a-z0-9_])') group by 1, 2, 3),
u as (select repo, source as concept, count(*) as usage_files from b_doc group by 1, 2)
select r.repo, r.concept, r.field, r.field in ('the', 'que') as declared, usage_files, coalesce(n, 0) as field_files,
  case when n > 5 then 'HIGH' when n > 0 then 'MODERATE' else 'NONE' end as severity from r join u using (repo, concept) left join h using (repo, concept, field)"""


# -- plan, card ----------------------------------------------------------------------
def _owners(spark, sf):
    d = declared(spark, sf)
    usage = catalog.attach_usage(frame(spark, sf, "b_hit"), d)
    return summary.owners(d.select("repo", F.col("name").alias("target")), d, usage)


def _p_edges(spark, sf):
    return sql(spark, sf, "select s.repo, s.path as from_path, h.hub as to_path from b_symbol s join (select repo, min(path) as hub from b_symbol group by repo) h on h.repo = s.repo")


def _p_impact(spark, sf, concepts, targets):
    s = frame(spark, sf, "b_symbol")
    linked = cut_lineage(catalog.link_symbols(s, concepts))
    return questions.concept_impact(targets, concepts, linked, _p_edges(spark, sf))


def goal_plan(spark, sf):
    c = bound_catalog(spark, sf)
    intent = cut_lineage(_intent(spark, sf))
    targets = intent.where("bucket = 'extend'").select("repo", F.col("canonical").alias("target")).distinct()
    gov = governance.governing_decisions(targets, links(spark, sf), by_words=True)
    return _big(questions.goal_plan(intent, c, _owners(spark, sf), gov, _p_impact(spark, sf, c, targets)), "position")


QUERIES["goal_plan"] = goal_plan
_OWN = """o_d as (select repo, name, 'crates/' || split_part(path, '/', 2) as dir, count(distinct path || kind) as declarations from b_decl group by 1, 2, 3),
o_u as (select repo, name, 'apps/' || split_part(path, '/', 2) as dir, count(distinct path) as uses from o_usage group by 1, 2, 3),
o_own as (select repo, name, arg_min(dir, (-declarations, dir)) as owner from o_d group by 1, 2)"""
_GOV = f"""o_link as (select repo, id, unnest(string_split(links, ',')) as link from b_decision),
o_gw as (select distinct repo, canonical, lower(unnest(list_append({TOKENS.format('canonical')}, canonical))) as word from o_intent where bucket = 'extend'),
o_gov as (select w.repo, w.canonical, count(distinct l.id) as decisions from o_gw w join o_link l on l.repo = w.repo and {sw('w.word', 'lower(l.link)')} group by 1, 2)"""
# impact over the star of imports: who owns the hub is reached by all other files
_SEVERE = f"""{_LINKS.replace("o_name as (select distinct repo, name from b_decl)", "o_name as (select distinct repo, name from o_concept)")},
o_hub as (select repo, min(path) as hub, count(distinct path) as n from b_symbol group by 1),
o_holder as (select repo, linked_concept as name, path from o_linked where linked_concept is not null union select repo, name, path from o_linked),
o_star as (select o.repo, o.name, h.n - count(*) as structural from o_holder o join o_hub h on h.repo = o.repo group by o.repo, o.name, h.n having bool_or(o.path = h.hub)),
o_rel1 as (select distinct repo, name as dependent, unnest(string_split(relations, ',')) as target from o_concept where relations <> ''),
o_rel2 as (select repo, target, count(*) as dependents from o_rel1 group by 1, 2),
o_severe0 as (select a.repo, a.name, coalesce(c.uses, 0) as uses, coalesce(r.dependents, 0) as dependents, coalesce(s.structural, 0) as structural
  from (select repo, name from o_concept union select repo, name from b_symbol) a left join o_concept c on c.repo = a.repo and c.name = a.name left join o_rel2 r on r.repo = c.repo and r.target = c.name left join o_star s on s.repo = a.repo and s.name = a.name),
o_severe as (select *, case when uses > 8 or dependents > 3 or structural > 5 then 'HIGH' when uses + dependents + structural > 0 then 'MODERATE' else 'NONE' end as severity from o_severe0)"""
ORACLES["goal_plan"] = f"""with {INTENT}, {_OWN}, {_GOV}, {_SEVERE},
x as (select * from o_intent where bucket = 'extend')
select x.repo, x.goal_id, x.position, x.term, x.canonical, w.owner, coalesce(c.relations, '') as related, coalesce(g.decisions, 0) as decisions, coalesce(s.severity, 'NONE') as severity, coalesce(c.uses, 0) as files
from x left join o_severe s on s.repo = x.repo and s.name = x.canonical left join o_own w on w.repo = x.repo and w.name = x.canonical left join o_concept c on c.repo = x.repo and c.name = x.canonical left join o_gov g on g.repo = x.repo and g.canonical = x.canonical"""


def _repos(spark, sf):
    return sql(
        spark, sf,
        "select repo, '/srv/' || repo as root, 'a' || cast(count(*) as string) as indexed_commit, case when count(*) % 3 = 0 then 'b' else 'a' || cast(count(*) as string) end as current_commit,"
        " case when count(*) % 5 = 0 then null else count(*) % 2 = 0 end as dirty from b_part group by repo union all select 'ghost', '/srv/ghost', null, 'x', false",
    )


_FRESH = """o_repo as (select repo, '/srv/' || repo as root, case when count(*) % 3 = 0 then 'stale_commit' when count(*) % 5 = 0 then 'unknown' when count(*) % 2 = 0 then 'stale_worktree' else 'fresh' end as freshness
  from b_part group by repo union all select 'ghost', '/srv/ghost', 'unknown')"""


def context_cards(spark, sf):
    c = bound_catalog(spark, sf)
    answers = cut_lineage(resolve_terms(frame(spark, sf, "b_term"), c, **evidence(spark, sf)))
    targets = answers.where("canonical is not null").select("repo", F.col("canonical").alias("target")).distinct()
    ev = sql(spark, sf, "select repo, name as concept, size as ts_ms from b_hit")
    gaps = report.gap_register(c, frame(spark, sf, "b_blind"), bound_settings(spark, sf))
    gov = governance.governing_decisions(targets, links(spark, sf), by_words=True)
    cover = inventory.coverage_report(frame(spark, sf, "b_tree"), frame(spark, sf, "b_exclude"))
    return questions.context_card(answers, _owners(spark, sf), _p_impact(spark, sf, c, targets), ev, gaps, gov, summary.freshness(_repos(spark, sf)), cover)


QUERIES["context_cards"] = context_cards
from factloom.checks.reports import GAPS, SETTINGS  # noqa: E402
from factloom.checks.reports import ORACLES as REPORTS  # noqa: E402

_CARD_GOV = _GOV.replace("from o_intent where bucket = 'extend'", "from o_resolved where canonical is not null")
ORACLES["context_cards"] = f"""with {RESOLVE}, {_OWN}, {SETTINGS}, {GAPS}, {_SEVERE}, {_CARD_GOV}, {_FRESH},
g as (select repo, count(*) as gaps from o_gap group by 1),
h as (select repo, name, count(*) as changes, max(size) as last_change_ms from b_hit group by 1, 2),
v as (select repo, cast(sum(files) filter (support = 'supported') as bigint) as yes, cast(sum(files) filter (support <> 'supported') as bigint) as no from ({REPORTS['coverage_report']}) c group by 1)
select r.repo, r.term, r.verdict, r.canonical, case when r.verdict in ('ACTIVE', 'DECLARED_ONLY', 'SYMBOL', 'STRUCTURAL') then 'extend' when r.verdict in ('UNKNOWN', 'INSUFFICIENT_COVERAGE') then 'confirm' else 'create' end as plan,
  w.owner, coalesce(s.severity, 'NONE') as severity, coalesce(s.uses, 0) as files, coalesce(s.dependents, 0) as dependents, coalesce(s.structural, 0) as structural, coalesce(d.decisions, 0) as decisions,
  coalesce(h.changes, 0) as changes, h.last_change_ms, coalesce(g.gaps, 0) as gaps, coalesce(f.freshness, 'unknown') as freshness, coalesce(v.yes, 0) as covered_files, coalesce(v.no, 0) as uncovered_files
from o_resolved r left join o_own w on w.repo = r.repo and w.name = r.canonical left join o_severe s on s.repo = r.repo and s.name = r.canonical left join o_gov d on d.repo = r.repo and d.canonical = r.canonical
left join h on h.repo = r.repo and h.name = r.canonical left join g on g.repo = r.repo left join o_repo f on f.repo = r.repo left join v on v.repo = r.repo"""


# -- guard, gate ------------------------------------------------------------------------
def storage_guard(spark, sf):
    return _big(questions.storage_guard(frame(spark, sf, "b_prop"), bound_catalog(spark, sf), links(spark, sf), **evidence(spark, sf)), "pos")


QUERIES["storage_guard"] = storage_guard


def _guard(source: str) -> str:
    rx = "(?i)\\bcreate +table +(?:if +not +exists +)?\\W?(\\w+)"
    return f"""o_prop as (select repo, id, unnest(ps) as proposed, generate_subscripts(ps, 1) - 1 as pos from (select repo, id, regexp_extract_all(sql, '{rx}', 1) as ps from {source})),
o_head as (select *, string_split(rtrim(proposed, 's'), '_')[-1] as head from o_prop), o_ask as (select distinct repo, head as term from o_head), {resolve_for('o_ask')},
o_gl as (select repo, id, unnest(string_split(links, ',')) as link from b_decision),
o_st as (select h.*, r.verdict, r.canonical, case when r.verdict in ('ACTIVE', 'DECLARED_ONLY', 'STRUCTURAL') and r.canonical is not null then
    case when lower(h.proposed) in (lower(coalesce(c.table_name, r.canonical)), lower(r.canonical)) then 'exempt' else 'blocked' end else 'new' end as status
  from o_head h join o_resolved r on r.repo = h.repo and r.term = h.head left join o_concept c on c.repo = h.repo and c.name = r.canonical),
o_guard as (select s.repo, s.id, s.pos, s.proposed, s.head, s.verdict, s.canonical, s.status, min(l.id) as decision_id
  from o_st s left join o_gl l on l.repo = s.repo and ({sw('lower(s.head)', 'lower(l.link)')} or lower(l.link) = lower(s.proposed) or lower(l.link) = lower(s.canonical)) and s.status = 'blocked' group by all)"""


ORACLES["storage_guard"] = f"with {_guard('b_prop')} select * from o_guard"


def added_lines(spark, sf):
    return _big(changes.added_lines(frame(spark, sf, "b_diff")), "line")


QUERIES["added_lines"] = added_lines
ORACLES["added_lines"] = """
select repo, id, line - 1 as line, substr(t, 2) as text from (select repo, id, unnest(ls) as t, generate_subscripts(ls, 1) as line from (select *, string_split(diff, chr(10)) as ls from b_diff))
where t like '+%' and t not like '+++%'"""


def name_warnings(spark, sf):
    return questions.name_warnings(changes.added_text(frame(spark, sf, "b_diff")), bound_catalog(spark, sf))


QUERIES["name_warnings"] = name_warnings
_WARN = f"""
o_decl as (select repo, id, d as declared from (select repo, id, unnest([regexp_extract(diff, '[+]class ([A-Za-z]+)', 1), regexp_extract(diff, '[+]export class ([A-Za-z]+)', 1), regexp_extract(diff, '[+]model ([A-Za-z]+)', 1)]) as d from b_diff)
  where not exists (select 1 from b_decl b where b.repo = repo and b.name = d)),
o_new as (select o.* from o_decl o where not exists (select 1 from b_decl b where b.repo = o.repo and b.name = o.declared)),
o_tk as (select repo, id, declared, unnest(ts) as token, generate_subscripts(ts, 1) as pos from (select *, {TOKENS.format('declared')} as ts from o_new)),
o_cw as (select distinct repo, name, lower(unnest(list_append({TOKENS.format('name')}, name))) as word from b_decl),
o_tv as (select distinct repo, token from o_tk where length(token) >= 4 and lower(token) not in ({GENERIC})),
o_th as (select t.repo, t.token, min(w.name) as hit from o_tv t join o_cw w on w.repo = t.repo and {sw('lower(t.token)', 'w.word')} group by 1, 2),
o_warn as (select t.repo, t.id, t.declared, arg_min(h.hit, t.pos) as collides_with, arg_min(t.token, t.pos) as token from o_tk t join o_th h on h.repo = t.repo and h.token = t.token group by 1, 2, 3)"""
_WARN = _WARN.replace("\n  where not exists (select 1 from b_decl b where b.repo = repo and b.name = d))", ")")
ORACLES["name_warnings"] = f"with {_WARN} select * from o_warn"


def change_gate(spark, sf):
    return questions.change_gate(frame(spark, sf, "b_diff"), bound_catalog(spark, sf), links(spark, sf), strict=False, **evidence(spark, sf))


QUERIES["change_gate"] = change_gate
ORACLES["change_gate"] = f"""with {_WARN}, o_sqltext as (select repo, id, array_to_string(list_filter(string_split(diff, chr(10)), lambda l: l like '+%' and l not like '+++%'), chr(10)) as sql from b_diff),
{_guard('o_sqltext').replace('o_cw as', 'o_cw2 as')},
b as (select repo, id, count(*) as n from o_guard where status = 'blocked' group by 1, 2), w as (select repo, id, count(*) as n from o_warn group by 1, 2)
select d.repo, d.id, coalesce(b.n, 0) as violations, coalesce(w.n, 0) as warnings, case when b.n > 0 then 'BLOCKED' when w.n > 0 then 'WARNING' else 'PASSED' end as verdict
from b_diff d left join b on b.repo = d.repo and b.id = d.id left join w on w.repo = d.repo and w.id = d.id"""


# -- claims --------------------------------------------------------------------------
def free_claims(spark, sf):
    return questions.free_claims(frame(spark, sf, "b_claim"), bound_catalog(spark, sf), **evidence(spark, sf))


QUERIES["free_claims"] = free_claims
ORACLES["free_claims"] = f"""with o_sub as (select *, trim(case when strpos(statement, '"') > 0 then split_part(statement, '"', 2) when statement like 'model %' then split_part(statement, ' ', 2) else '' end) as subject from b_claim),
o_ask as (select distinct repo, subject as term from o_sub where subject <> ''), {resolve_for('o_ask')},
x as (select s.repo, s.id, s.subject, case when statement like '%used in%' then 'usage' when statement like '%does not exist%' or statement like '%is absent%' then 'absence' else 'existence' end as kind,
  r.verdict as found, coalesce(c.uses, 0) as uses, case when statement like '%more than%' then 13 else 12 end as least_n from o_sub s
  left join o_resolved r on r.repo = s.repo and r.term = s.subject left join o_concept c on c.repo = s.repo and c.name = r.canonical)
select repo, id, subject, kind, found, case when found is null then 'UNVERIFIABLE' when kind = 'usage' then case when uses >= least_n then 'CONFIRMED' else 'REFUTED' end
  when found = 'INSUFFICIENT_COVERAGE' or (kind = 'absence' and found = 'UNKNOWN') then 'UNVERIFIABLE'
  when (found in ('ACTIVE', 'DECLARED_ONLY', 'SYMBOL', 'STRUCTURAL')) = (kind = 'existence') then 'CONFIRMED' else 'REFUTED' end as verdict from x"""


def typed_claims(spark, sf):
    c = star_catalog(spark, sf)
    usage = catalog.attach_usage(frame(spark, sf, "b_ghit"), frame(spark, sf, "b_gdecl"))
    t = questions.typed_claims(frame(spark, sf, "b_tclaim"), c, usage, structural_symbols(spark, sf), frame(spark, sf, "b_edge"), frame(spark, sf, "b_call"), exact_first=True)
    return t.select("repo", "id", "type", "target", "verdict", "outside")


QUERIES["typed_claims"] = typed_claims
ORACLES["typed_claims"] = f"""with recursive {IMPACT},
o_touch as (select repo, name as key, path from b_ghit union select repo, key, path from dep_min where depth > 0),
o_out as (select repo, key, count(*) as outside from o_touch where path not like 'o/%' and path not like 'n/%' and path not like 'l/%' group by 1, 2)
select t.repo, t.id, t.type, t.target, case when t.type = 'isolation' and t.within is not null then coalesce(o.outside, 0) else 0 end as outside, case
  when t.type = 'absence' then case when t.target like 'zz%' then 'CONFIRMED' else 'REFUTED' end when t.type = 'usage-threshold' then case when i.files >= 9 then 'CONFIRMED' else 'REFUTED' end
  when t.within is null then 'UNVERIFIABLE' when o.outside is null then 'CONFIRMED' else 'REFUTED' end as verdict
from b_tclaim t left join o_impact i on i.repo = t.repo and i.target = t.target left join o_out o on o.repo = t.repo and o.key = t.target"""


# -- readiness, fan-out, places -----------------------------------------------------------
def freshness(spark, sf):
    return summary.freshness(_repos(spark, sf)).select("repo", "freshness")


QUERIES["freshness"] = freshness
ORACLES["freshness"] = f"with {_FRESH} select repo, freshness from o_repo"


def readiness(spark, sf):
    p = frame(spark, sf, "b_prop")
    guard = questions.storage_guard(p, bound_catalog(spark, sf), links(spark, sf), **evidence(spark, sf))
    ids = p.select("repo", "id")
    return questions.readiness(ids, summary.freshness(_repos(spark, sf)), ids.where("length(id) > 3"), ids.where("id not like '%7'"), guard)


QUERIES["readiness"] = readiness
ORACLES["readiness"] = f"""with {_guard('b_prop')}, {_FRESH},
g as (select repo, id, case when bool_or(status = 'blocked') then 'blocked' else 'complete' end as guard from o_guard group by 1, 2),
x as (select p.repo, p.id, r.freshness, case when length(p.id) > 3 then 'complete' else 'not_provided' end as plan, case when p.id not like '%7' then 'complete' else 'not_provided' end as impact, coalesce(g.guard, 'not_provided') as guard
  from b_prop p left join o_repo r on r.repo = p.repo left join g on g.repo = p.repo and g.id = p.id)
select *, case when guard = 'blocked' then 'blocked' when plan = 'complete' and impact = 'complete' and guard = 'complete' and freshness = 'fresh' then 'evidence_complete' else 'advisory' end as decision from x"""


def fan_out_status(spark, sf):
    status = summary.usage_counts(frame(spark, sf, "b_file"), bound_catalog(spark, sf))
    return questions.fan_out_status(_repos(spark, sf), status)


QUERIES["fan_out_status"] = fan_out_status
ORACLES["fan_out_status"] = f"""with {CATALOG}, {_FRESH},
f as (select repo, count(distinct path) as files from b_file group by 1),
c as (select repo, count(*) as concepts, count(*) filter (uses > 0) as used, count(*) filter (uses = 0 and not enum_only) as unused from o_concept group by 1)
select r.repo, r.root, files, concepts, used, unused from o_repo r left join f using (repo) left join c using (repo)"""


def fan_out_terms(spark, sf):
    terms = sql(spark, sf, "select distinct term from b_term")
    return questions.fan_out_terms(terms, _repos(spark, sf), bound_catalog(spark, sf))


QUERIES["fan_out_terms"] = fan_out_terms
_EVERYWHERE = "o_every as (select r.repo, t.term from (select distinct repo from b_part) r, (select distinct term from b_term) t)"
_PLAIN = resolve_for("o_every").replace("left join o_concept c on c.repo = t.repo and v.alias is not null and c.name = v.target", "left join o_concept c on false")
_PLAIN = _PLAIN.replace("left join o_via v on v.repo = t.repo and v.term = t.term", "left join o_via v on false")
ORACLES["fan_out_terms"] = f"""with {_EVERYWHERE}, {_PLAIN}, {_FRESH},
h as (select w.term, w.repo, case when tc.uses > 0 then 'ACTIVE' when tc.in_memory then 'SYMBOL' else 'DECLARED_ONLY' end as verdict, t.name as canonical
  from o_every w join o_top t on t.repo = w.repo and t.term = w.term join o_concept tc on tc.repo = w.repo and tc.name = t.name)
select term, repo, verdict, canonical, cast(1 as bigint) as repos from h
union all select t.term, null, 'ELSEWHERE_ABSENT', null, (select count(*) from o_repo) - (select count(*) from h where h.term = t.term) from (select distinct term from b_term) t"""


def place_edges(spark, sf):
    services = sql(
        spark, sf,
        "select repo, 'svc' || cast(pk as string) as service, case pk % 6 when 0 then './src/' || w1 when 1 then '../outside' when 2 then 'src/../src/core/' when 3 then '.'"
        " when 4 then 'packages/' || w1 || '/sub' else 'missing/' || w2 end as build_context from b_part",
    )
    built = questions.build_context_edges(services, frame(spark, sf, "b_mfile")).select("repo", F.col("service").alias("from_id"), F.lit("built_from").alias("kind"), F.col("dir").alias("to_id"))
    git = _repos(spark, sf).select("repo", F.concat(F.lit("git:"), "root").alias("git_id"), "root")
    same = questions.same_project_edges(git, frame(spark, sf, "b_mfile")).select("repo", F.col("git_id").alias("from_id"), F.lit("same_project_as").alias("kind"), F.col("root").alias("to_id"))
    return built.unionByName(same)


QUERIES["place_edges"] = place_edges
ORACLES["place_edges"] = f"""with {_FRESH},
x as (select repo, 'svc' || pk as service, case pk % 6 when 0 then 'src/' || w1 when 2 then 'src/core' when 4 then 'packages/' || w1 || '/sub' when 5 then 'missing/' || w2 end as dir from b_part)
select x.repo, service as from_id, 'built_from' as kind, dir as to_id from x where dir is not null and exists (select 1 from b_mfile f where f.repo = x.repo and starts_with(f.path, x.dir || '/'))
union all select repo, 'git:' || root, 'same_project_as', root from o_repo where repo <> 'ghost'"""
