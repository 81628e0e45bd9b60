"""The registered queries of the core."""

from __future__ import annotations

import importlib
import importlib.util

from thicket.plans.registry import ORACLES, QUERIES, Query

for _module in ("code_queries", "pack_queries", "relational_queries", "retrieval_queries", "intent_queries", "ops_queries", "governance_queries", "context_queries", "ingest_queries"):
    if importlib.util.find_spec(f"thicket.plans.{_module}"):
        importlib.import_module(f"thicket.plans.{_module}")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
