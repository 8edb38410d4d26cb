"""All registered queries and their oracle SQL."""

from __future__ import annotations

from factloom.checks import extract_checks, governance_checks, graph, history_checks, manifest_checks, names, question_checks, reports, stream_checks
from factloom.checks.bindings import with_views

MODULES = (names, graph, reports, history_checks, question_checks, governance_checks, extract_checks, manifest_checks, stream_checks)
QUERIES: dict = {}
ORACLES: dict = {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLES.update({k: with_views(v) for k, v in _m.ORACLES.items()})
