"""Checks for extraction: every language template must yield exactly its facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.checks.bindings import frame, sql
from factloom.checks.source_templates import DECLS, UNITS, expected, fill
from factloom.extract import facts
from factloom.functions import paths
from factloom.operators import catalog

QUERIES, ORACLES = {}, {}


def symbols(spark, sf):
    return facts.extract_symbols(frame(spark, sf, "b_src")).withColumn("line", F.col("line").cast("bigint")).drop("observation")


QUERIES["extract_symbols"] = symbols
ORACLES["extract_symbols"] = expected(2, ("name", "kind", "line"))


def imports(spark, sf):
    return facts.extract_imports(frame(spark, sf, "b_src")).withColumn("names", F.array_join("names", ",")).withColumnRenamed("from_path", "path")


QUERIES["extract_imports"] = imports
ORACLES["extract_imports"] = expected(3, ("to_module", "names"))


def routes(spark, sf):
    return facts.extract_routes(frame(spark, sf, "b_src"))


QUERIES["extract_routes"] = routes
ORACLES["extract_routes"] = expected(4, ("method", "route", "handler"))


def calls(spark, sf):
    return facts.extract_route_calls(frame(spark, sf, "b_src")).withColumnRenamed("file", "path")


QUERIES["extract_route_calls"] = calls
ORACLES["extract_route_calls"] = expected(5, ("called",))


def declarations(spark, sf):
    d = facts.extract_declarations(frame(spark, sf, "b_dsrc"))
    return d.withColumn("fields", F.array_join("fields", ",")).withColumn("relations", F.array_join(F.array_sort("relations"), ",")).withColumn("line", F.col("line").cast("bigint"))


QUERIES["extract_declarations"] = declarations
_D = expected(2, ("name", "kind", "fields", "relations", "table_name", "line"), DECLS)
ORACLES["extract_declarations"] = f"""
select repo, path, name, kind, fields, array_to_string(list_sort(list_distinct(string_split(relations, ','))), ',') as relations, table_name, cast(line as bigint) as line from ({_D}) x"""


def document_declarations(spark, sf):
    """The same rules over real texts: whole documents, with a CREATE TABLE after their first line."""
    d = sql(spark, sf, "select repo, path, content || chr(10) || 'create table doc_' || cast(doc_id as string) || ' (id int);' as content from b_doc")
    return facts.extract_declarations(d).groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"), F.sum("line").cast("bigint").alias("lines"))


QUERIES["document_declarations"] = document_declarations
ORACLES["document_declarations"] = """
select repo, 'sql' as kind, count(*) as n, count(*) as names, cast(sum(len(string_split(content, chr(10))) + 1) as bigint) as lines from b_doc group by 1"""


def body_literals(spark, sf):
    return facts.extract_body_literals(frame(spark, sf, "b_usrc"))


QUERIES["extract_body_literals"] = body_literals
_U = {i: f"from b_tpl where pk % {len(UNITS)} = {i}" for i in range(len(UNITS))}
ORACLES["extract_body_literals"] = f"""
select repo, {fill('u/{a}{n}.py')} as path, 'one_' || w1 as unit, w1 || ' is a long text' as literal {_U[0]}
union all select repo, {fill('u/{a}{n}.py')}, 'one_' || w1, w2 || ' is a long text' {_U[0]} union all select repo, {fill('u/{a}{n}.py')}, 'two_' || w2, w1 || ' is a long text' {_U[0]}
union all select repo, {fill('u/{a}{n}.rs')}, 'one_' || w1, w2 || ' rust literal' {_U[1]} union all select repo, {fill('u/{a}{n}.rs')}, 'two_' || w2, w1 || ' rust literal' {_U[1]}
union all select repo, {fill('u/{a}{n}.ts')}, 'one_' || w1, w1 || ' js literal' {_U[2]} union all select repo, {fill('u/{a}{n}.ts')}, 'three', 'select * from ' || w1 || '_' || w2 || ' join ' || w2 || '_x' {_U[2]}
union all select repo, {fill('u/{a}{n}_wide.py')}, 'one_' || w1, w1 || ' is a wide text' {_U[3]} union all select repo, {fill('u/{a}{n}_wide.py')}, 'two_' || w2, w2 || ' is a wide text' {_U[3]}
union all select repo, {fill('u/{a}{n}_wide.ts')}, 'one_' || w1, w1 || ' wide literal' {_U[4]} union all select repo, {fill('u/{a}{n}_wide.ts')}, 'last_' || w2, w2 || ' wide literal' {_U[4]}"""


def call_edges(spark, sf):
    return facts.extract_call_edges(frame(spark, sf, "b_usrc"))


QUERIES["extract_call_edges"] = call_edges
ORACLES["extract_call_edges"] = f"""
select repo, {fill('u/{a}{n}.rs')} as from_path, 'one_' || w1 as caller, 'helper_' || w2 as callee {_U[1]} union all select repo, {fill('u/{a}{n}.rs')}, 'one_' || w1, 'make_' || w1 {_U[1]}
union all select repo, {fill('u/{a}{n}.rs')}, 'two_' || w2, 'other' {_U[1]} union all select repo, {fill('u/{a}{n}.ts')}, 'one_' || w1, 'two_' || w2 {_U[2]}
union all select repo, {fill('u/{a}{n}.ts')}, 'three', 'find' {_U[2]} union all select repo, {fill('u/{a}{n}.ts')}, 'three', 'go' {_U[2]}
union all select repo, {fill('u/{a}{n}_wide.ts')}, 'one_' || w1, 'two_' || w2 {_U[4]} union all select repo, {fill('u/{a}{n}_wide.ts')}, 'last_' || w2, 'go_' || w1 {_U[4]}"""


def usage_hits(spark, sf):
    c = sql(
        spark, sf,
        "select distinct repo, 'Real' || c1 as name, cast(null as string) as table_name from b_tpl union select distinct repo, 'Real' || c2, null from b_tpl union select distinct repo, c1, null from b_tpl"
        " union select distinct repo, 'Commented' || c1, null from b_tpl union select distinct repo, 'Tab' || c1 || c2, w1 || '_' || w2 from b_tpl union select distinct repo, 'One_' || w1, null from b_tpl",
    )
    return facts.usage_hits(frame(spark, sf, "b_usrc"), c)


QUERIES["usage_hits"] = usage_hits
ORACLES["usage_hits"] = f"""
select repo, 'Real' || c1 as name, {fill('u/{a}{n}.rs')} as path, 'identifier' as kind {_U[1]} union select repo, 'Real' || c2, {fill('u/{a}{n}.ts')}, 'identifier' {_U[2]}
union select repo, c1, {fill('u/{a}{n}.ts')}, 'identifier' {_U[2]} union select repo, 'Tab' || c1 || c2, {fill('u/{a}{n}.ts')}, 'raw-sql' {_U[2]}
union select repo, 'One_' || w1, {fill('u/{a}{n}.rs')}, 'identifier' {_U[1]}"""


def document_identifiers(spark, sf):
    """Distinct identifiers of whole raw documents, read as prose and as code with strings and comments in it."""
    d = sql(
        spark, sf,
        "select repo, path || '.txt' as path, content from b_doc union all"
        " select repo, path || '.py' as path, 'u = \"http://h/' || cast(doc_id as string) || '#x\"; Use' || cast(doc_id as string) || '()  # Never Counted' || chr(10) || '\"\"\"Doc string, it''s ' || regexp_replace(content, '[\"^]', ' ') || '\"\"\"' || chr(10) || 'class Own: pass' as content from b_doc",
    )
    return facts.used_identifiers(d).groupBy("repo").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("ident").alias("idents"))


QUERIES["document_identifiers"] = document_identifiers
ORACLES["document_identifiers"] = """
with r as (select distinct repo, path || '.txt' as path, unnest(regexp_extract_all(content, '(?:class|def|enum|fn|func|function|interface|model|struct|trait|type)\\s+[A-Za-z_][A-Za-z0-9_]*|([A-Za-z_][A-Za-z0-9_]*)', 1)) as i from b_doc
  union select repo, path || '.py', unnest(['u', 'Use' || cast(doc_id as varchar), 'pass']) from b_doc),
e as (select repo, path, i from r where i <> '' union select repo, path, upper(substr(i, 1, 1)) || substr(i, 2) from r where i <> '')
select repo, count(*) as uses, count(distinct i) as idents from e group by 1"""


def excerpts(spark, sf):
    spots = sql(spark, sf, "select repo, path, 1 + doc_id % 5 as line from b_doc")
    return facts.source_excerpt(frame(spark, sf, "b_doc"), spots, 1)


QUERIES["source_excerpts"] = excerpts
ORACLES["source_excerpts"] = """
with l as (select repo, path, 1 + doc_id % 5 as line, string_split(regexp_replace(content, chr(10) || '$', ''), chr(10)) as ls from b_doc)
select repo, path, line, array_to_string(list_transform(list_filter([line - 1, line, line + 1], lambda i: i >= 1 and i <= len(ls)), lambda i: cast(i as varchar) || ': ' || ls[i]), chr(10)) as excerpt
from l where line <= len(ls)"""


def path_classes(spark, sf):
    p = F.col("path")
    f = sql(spark, sf, "select repo, path from b_fsnap union select repo, path from b_dsrc union select repo, path from b_tree")
    return f.select(
        "repo", "path", paths.is_test_source(p).alias("test"), paths.is_documentation(p).alias("doc"),
        paths.is_protected(p, F.array(F.lit("src/"), F.lit("app")), F.array(F.lit("src/small"))).alias("protected"), paths.owning_dir(p).alias("owner"),
    )


QUERIES["path_classes"] = path_classes
ORACLES["path_classes"] = """
with f as (select repo, path from b_fsnap union select repo, path from b_dsrc union select repo, path from b_tree)
select repo, path, starts_with(path, 'tests/') as test, regexp_extract(path, '[.]([^./]*)$', 1) in ('md', 'txt', 'png', 'jpg') as doc,
  (starts_with(path, 'src/') or starts_with(path, 'app/')) and not starts_with(path, 'src/small/') as protected, split_part(path, '/', 1) as owner from f"""


def literal_classes(spark, sf):
    t = F.col("txt")
    return frame(spark, sf, "b_line").select("repo", "path", "line", paths.is_meaningful_literal(t).alias("meaningful"), F.octet_length(t).cast("bigint").alias("bytes"))


QUERIES["literal_classes"] = literal_classes
ORACLES["literal_classes"] = "select repo, path, line, strlen(txt) >= 10 as meaningful, strlen(txt) as bytes from b_line"


def extracted_catalog(spark, sf):
    """End to end: files to declarations to a catalog."""
    d = facts.extract_declarations(frame(spark, sf, "b_dsrc"))
    c = catalog.assemble_concepts(d)
    return c.groupBy("repo").agg(F.count(F.lit(1)).alias("concepts"), F.count_if("has_orm").alias("orm"), F.count("table_name").alias("tables"))


QUERIES["extracted_catalog"] = extracted_catalog
ORACLES["extracted_catalog"] = f"""
with d as ({_D}), c as (select repo, name, bool_or(kind <> 'sql') as orm, max(table_name) as t from d group by 1, 2)
select repo, count(*) as concepts, count(*) filter (orm) as orm, count(t) as tables from c group by 1"""
