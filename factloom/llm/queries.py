"""Driver queries of this subpackage: each dealt operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import fill_middle, licenses, mixing, ngram_join, packing, quality, substrings, token_align, token_files, top_products, toxicity, url_filter, vector_range
from factloom.llm.spread import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(read(spark, sf_dir, "documents")))


ORACLES["op6_license_scans"] = licenses.scan_sql()
ORACLES["op3_url_filters"] = url_filter.judge_sql()


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(read(spark, sf_dir, "documents"))


ORACLES["op2_substring_dedup"] = substrings.digest_sql()


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


ORACLES["op7_ngram_jaccard"] = ngram_join.components_sql()


@query
def op5_vector_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_range.range_links(read(spark, sf_dir, "embeddings"))


@query
def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.top_products(read(spark, sf_dir, "embeddings"))


ORACLES["op5_vector_range_join"] = """
with recursive d as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
v as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from d),
fine as (select * from v where n > 0 and isfinite(n)),
links as materialized (select a.vec_id as x, b.vec_id as y from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach(vec_id, root) as (select vec_id, vec_id from d union select y, root from reach join links on reach.vec_id = x),
low as (select vec_id, min(root) as component_id from reach group by vec_id),
deg as (select x, count(*) as k from links group by x)
select vec_id, cast(coalesce(k, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from low left join deg on vec_id = x"""
ORACLES["op8_top_products"] = """
with d as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings),
s as (select a.vec_id as query_id, b.vec_id, cast(list_dot_product(a.e, b.e) as bigint) as score from d a, d b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.link_counts(read(spark, sf_dir, "documents"))


@query
def op12_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judge(read(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", *quality.FACTS, "base_failed", "kept")


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(read(spark, sf_dir, "documents"))


ORACLES["op12_host_quality"] = quality.judge_sql()
ORACLES["op13_fill_middle"] = fill_middle.digest_sql()
