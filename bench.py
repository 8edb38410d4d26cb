"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = (
    "concept_catalog", "usage_attached", "symbol_links", "ranked_concepts", "resolved_terms", "name_duplicates", "name_families", "duplicate_logic",
    "structural_dependents", "file_dependents", "concept_impact", "route_matches", "route_callers", "contradiction_summary", "resolved_imports",
    "extract_symbols", "extract_declarations", "document_declarations", "document_identifiers", "field_impact", "context_efficiency", "owner_dirs",
    "query_audit", "history_digest", "as_of_state", "architecture_versions", "catalog_events", "changed_files", "semantic_diff", "storage_guard", "stream_facts",
)


def main() -> None:
    from factloom.checks import registry
    from factloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    names = sys.argv[1:] or HEADLINES
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
