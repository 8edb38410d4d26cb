"""Evidence envelopes as JSON, and the projection of facts to general resource rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Contract version (pass another one to exchange with a partner), and the required keys.
VERSION = "factloom.evidence.v1"
REQUIRED = ("contract_version", "evidence_type", "source", "observed_at_ms", "target", "confidence", "limitations", "payload")


def confidence_of(kind: Column) -> Column:
    return F.when(kind == "browser_page", "medium").when(kind == "http_response", "high").otherwise("low")


def envelope(kind: Column, source: Column, target: Column, payload: Column, observed_at_ms: Column, note: Column, commit: Column, confidence: Column | None = None, version: str = VERSION) -> Column:
    """JSON envelope; the kind decides the confidence unless one is given."""
    kind = F.coalesce(kind, F.lit("architectural_observation"))
    notes = F.when(note.isNotNull(), F.array(note)).otherwise(F.array().cast("array<string>"))
    sure = confidence_of(kind) if confidence is None else F.coalesce(confidence, confidence_of(kind))
    return F.to_json(
        F.struct(
            F.lit(version).alias("contract_version"), kind.alias("evidence_type"), source.alias("source"), observed_at_ms.alias("observed_at_ms"),
            commit.alias("commit"), target.alias("target"), sure.alias("confidence"), notes.alias("limitations"), payload.alias("payload"),
        )
    )


def envelope_error(doc: Column, version: str = VERSION) -> Column:
    """Why an envelope is not valid, or null."""
    v = F.try_parse_json(doc)
    keys = F.json_object_keys(doc)
    at = lambda key: F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    error = F.when(keys.isNull(), F.lit("not an object"))
    for key in REQUIRED:
        error = error.when(~F.array_contains(keys, key), F.lit(f"missing {key}"))
    return (
        error.when(~F.get_json_object(doc, "$.contract_version").eqNullSafe(version), "unsupported version")
        .when(~at("observed_at_ms").eqNullSafe("BIGINT"), "observed_at_ms is no integer")
        .when(~F.startswith(F.coalesce(at("limitations"), F.lit("")), F.lit("ARRAY")), "limitations is no array")
    )


def concept_resources(concepts: DataFrame) -> DataFrame:
    """Concepts as (repo, id, kind, domain, location, attributes)."""
    return concepts.select(
        "repo", F.concat(F.lit("concept:"), "name").alias("id"), F.lit("concept").alias("kind"), F.lit("code").alias("domain"), F.col("first_path").alias("location"),
        F.create_map(F.lit("name"), F.col("name"), F.lit("table"), F.coalesce("table_name", F.lit("")), F.lit("fields"), F.array_join("fields", ",")).alias("attributes"),
    )


def symbol_resources(symbols: DataFrame) -> DataFrame:
    return symbols.select(
        "repo", F.concat_ws("::", "path", "name").alias("id"), F.lower("kind").alias("kind"), F.lit("code").alias("domain"), F.concat_ws(":", "path", "line").alias("location"),
        F.create_map(F.lit("name"), F.col("name")).alias("attributes"),
    )


def import_relationships(edges: DataFrame) -> DataFrame:
    return edges.select("repo", F.col("from_path").alias("from_id"), F.lit("imports").alias("kind"), F.col("to_path").alias("to_id"), F.lit("Declared").alias("tier"))


def route_relationships(concept_routes: DataFrame) -> DataFrame:
    return concept_routes.select("repo", F.concat_ws(" ", "method", "route").alias("from_id"), F.lit("handles").alias("kind"), F.col("concept").alias("to_id"), "tier")
