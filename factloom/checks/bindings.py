"""Operator inputs derived from the driver tables in SQL that Spark and DuckDB both run.

``BINDINGS`` maps a view name to its SELECT; a pair gives (spark, duckdb) where the dialects
differ. Views may use the driver tables and earlier views. ``frame`` builds one for Spark,
``with_views`` puts the same text in front of an oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom import session
from factloom.checks.binding_sql import BINDINGS
from factloom.session import cut_lineage

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _used(text: str) -> list[str]:
    return [v for v in BINDINGS if re.search(rf"\b{v}\b", text)]


def _closure(text: str, side: int) -> list[str]:
    """Views that ``text`` needs, in definition order."""
    need: set[str] = set()
    todo = _used(text)
    while todo:
        v = todo.pop()
        if v not in need:
            need.add(v)
            todo += [u for u in _used(_sql(v, side)) if u != v]
    return [v for v in BINDINGS if v in need]


def _sql(view: str, side: int) -> str:
    body = BINDINGS[view]
    return body if isinstance(body, str) else body[side]


def with_views(query: str) -> str:
    """Oracle SQL: the needed views as common table expressions, then ``query``.

    ``query`` may itself start with ``with``; its expressions are appended to the list.
    """
    ctes = [f"{v} as materialized ({_sql(v, 1).strip()})" for v in _closure(query, 1)]
    ctes = [c.replace("unix_millis(", "epoch_ms(") for c in ctes]
    q = query.strip().replace("unix_millis(", "epoch_ms(")
    recursive = bool(re.match(r"(?i)with\s+recursive\b", q))
    rest = re.sub(r"(?i)^with\s+(recursive\s+)?", "", q) if re.match(r"(?i)with\b", q) else None
    head = "with recursive " if recursive else "with "
    if not ctes:
        return q
    if rest is not None:
        return head + ",\n".join(ctes) + ",\n" + rest
    return head + ",\n".join(ctes) + "\n" + q


# Fact tables that a catalog keeps on disk: derived once per session, then read as Parquet.
STORED = frozenset("b_part b_decl b_hit b_symbol b_route b_file b_term b_alias b_cust b_order b_item b_edge b_src b_dsrc b_usrc b_fsnap".split())
_READ: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is read once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _READ:
        _READ[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.read.schema(_READ[key]).parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    """Run ``query`` over the driver tables and the views it names."""
    tables = {t for t in TABLES}
    needed = _closure(query, 0)
    text = query + " ".join(_sql(v, 0) for v in needed)
    for t in tables:
        if re.search(rf"\b{t}\b", text):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    for v in needed:
        made = stored(spark, sf_dir, v, lambda v=v: spark.sql(_sql(v, 0))) if v in STORED else spark.sql(_sql(v, 0))
        made.createOrReplaceTempView(v)
    return spark.sql(query)


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return sql(spark, sf_dir, f"select * from {view}")


_STORED: dict = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table the questions read, such as the catalog: built and written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(build(), maxRecordsPerFile=session.FILE_ROWS)
    return _STORED[key]
