"""Checks for manifests, containers, notes, envelopes and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame, sql
from factloom.checks.graph import concept_routes, resolved_imports
from factloom.checks.names import CATALOG, bound_catalog
from factloom.checks.source_templates import fill
from factloom.functions import evidence
from factloom.sources import manifests

QUERIES, ORACLES = {}, {}
_T = {i: f"from b_tpl where pk % 5 = {i}" for i in range(5)}


def lineage_symbols(spark, sf):
    return manifests.lineage_symbols(frame(spark, sf, "b_manifest")).select("repo", "path", "name", "linked_concept")


QUERIES["lineage_symbols"] = lineage_symbols
ORACLES["lineage_symbols"] = f"""
select repo, {fill('p{n}/models/{a}.sql')} as path, c1 as name, lower(c2) as linked_concept {_T[0]} union all select repo, {fill('p{n}/models/{b}.yml')}, c2, lower(c2) {_T[0]}
union all select repo, {fill('p{n}/target/manifest.json')}, {fill('Y{n}')}, lower({fill('Y{n}')}) {_T[0]}"""


def lineage_imports(spark, sf):
    return manifests.lineage_imports(frame(spark, sf, "b_manifest"))


QUERIES["lineage_imports"] = lineage_imports
ORACLES["lineage_imports"] = f"""
select repo, {fill('p{n}/models/{a}.sql')} as from_path, {fill('p{n}/models/{b}.yml')} as to_module {_T[0]} union all select repo, {fill('p{n}/models/{a}.sql')}, 'model.gone' {_T[0]}
union all select repo, {fill('p{n}/target/manifest.json')}, {fill('p{n}/models/{a}.sql')} {_T[0]}"""


def base_images(spark, sf):
    return manifests.base_images(frame(spark, sf, "b_manifest")).withColumn("position", F.col("position").cast("bigint"))


QUERIES["base_images"] = base_images
ORACLES["base_images"] = f"""
select repo, {fill('deploy{n}/Dockerfile')} as path, cast(0 as bigint) as position, {fill('{a}:{n}')} as image {_T[1]} union all select repo, {fill('deploy{n}/Dockerfile')}, 1, w2 {_T[1]}"""


def compose_services(spark, sf):
    return manifests.compose_services(frame(spark, sf, "b_manifest"))


QUERIES["compose_services"] = compose_services
ORACLES["compose_services"] = f"""
select repo, {fill('deploy{n}/docker-compose.yml')} as path, w1 as service, w2 || ':1' as image, {fill('80:{n},81')} as ports, './' || w1 as build_context, {fill('D{n}')} as dockerfile {_T[2]}
union all select repo, {fill('deploy{n}/docker-compose.yml')}, 'worker', null, '', '../' || w2, null {_T[2]}"""


def workspace_packages(spark, sf):
    return manifests.workspace_packages(frame(spark, sf, "b_manifest"))


QUERIES["workspace_packages"] = workspace_packages
ORACLES["workspace_packages"] = f"""
select repo, '@x/' || w2 as name, {fill('w{n}/packages/{b}')} as dir {_T[3]} union all select repo, '@x/tool-' || w1, {fill('w{n}/tools/{a}')} {_T[3]}
union all select repo, w2 || '-core', {fill('c{n}/crates/{b}')} from b_tpl"""


def decision_candidates(spark, sf):
    known = sql(spark, sf, "select distinct repo, 'x' as id, 'keep ' || w1 as decision from b_part where sz > 30")
    return manifests.decision_candidates(frame(spark, sf, "b_manifest").where("path like '%README.md'"), known)


QUERIES["decision_candidates"] = decision_candidates
_R = fill("docs{n}/README.md")
ORACLES["decision_candidates"] = f"""
with c as (select repo, {_R} as path, 'coding-rules-1' as id, 'first ' || w2 as decision {_T[4]} union all select repo, {_R}, 'coding-rules-2', 'second' {_T[4]}
union all select repo, {_R}, 'coding-rules-3', 'third ' || w1 {_T[4]} union all select repo, {_R}, {fill('design-decisions-{n}-1')}, 'keep ' || w1 {_T[4]})
select * from c where not exists (select 1 from b_part p where p.repo = c.repo and p.sz > 30 and c.decision = 'keep ' || p.w1)"""


def envelopes(spark, sf):
    e = frame(spark, sf, "b_event")
    kind = F.when(F.col("kind") == "ci_passed", "http_response").when(F.col("kind") == "concept_renamed", "browser_page")
    doc = evidence.envelope(kind, F.lit("probe"), F.col("concept"), F.from_json("detail", "k int"), F.col("ts_ms"), F.when(F.col("id") % 2 == 0, "noted"), F.lit(None).cast("string"))
    broken = (
        F.when(F.col("id") % 7 == 0, F.replace(doc, F.lit('"source"'), F.lit('"sauce"')))
        .when(F.col("id") % 7 == 1, F.replace(doc, F.lit("evidence.v1"), F.lit("evidence.v0")))
        .when(F.col("id") % 7 == 2, F.regexp_replace(doc, '"observed_at_ms":([0-9]+)', '"observed_at_ms":"$1"'))
        .when(F.col("id") % 7 == 3, F.regexp_replace(doc, r'"limitations":\[[^\]]*\]', '"limitations":"none"'))
        .when(F.col("id") % 7 == 4, F.lit("[1]"))
        .otherwise(doc)
    )
    return e.select("repo", "id", F.get_json_object(doc, "$.confidence").alias("confidence"), F.get_json_object(doc, "$.limitations").alias("limitations"), evidence.envelope_error(broken).alias("error"))


QUERIES["evidence_envelopes"] = envelopes
ORACLES["evidence_envelopes"] = """
select repo, id, case kind when 'ci_passed' then 'high' when 'concept_renamed' then 'medium' else 'low' end as confidence, case when id % 2 = 0 then '["noted"]' else '[]' end as limitations,
 case id % 7 when 0 then 'missing source' when 1 then 'unsupported version' when 2 then 'observed_at_ms is no integer' when 3 then 'limitations is no array' when 4 then 'not an object' end as error from b_event"""


def resources(spark, sf):
    c, s = evidence.concept_resources(bound_catalog(spark, sf)), evidence.symbol_resources(frame(spark, sf, "b_symbol"))
    pick = lambda d: d.select("repo", "id", "kind", "domain", "location", F.col("attributes")["name"].alias("name"), F.coalesce(F.col("attributes")["table"], F.lit("-")).alias("tbl"))
    return pick(c).unionByName(pick(s))


QUERIES["resources"] = resources
ORACLES["resources"] = f"""with {CATALOG}
select c.repo, 'concept:' || c.name as id, 'concept' as kind, 'code' as domain, (select min(path) from b_decl d where d.repo = c.repo and d.name = c.name) as location, c.name, coalesce(c.table_name, '') as tbl from o_concept c
union all select repo, path || '::' || name, lower(kind), 'code', path || ':' || line, name, '-' from b_symbol"""


def relationships(spark, sf):
    return evidence.import_relationships(resolved_imports(spark, sf)).unionByName(evidence.route_relationships(concept_routes(spark, sf))).distinct()


QUERIES["relationships"] = relationships
from factloom.checks import graph  # noqa: E402

ORACLES["relationships"] = f"""
with i as ({graph.ORACLES['resolved_imports']}), r as ({graph.ORACLES['concept_routes']})
select distinct repo, from_path as from_id, 'imports' as kind, to_path as to_id, 'Declared' as tier from i union select distinct repo, method || ' ' || route, 'handles', concept, tier from r"""
