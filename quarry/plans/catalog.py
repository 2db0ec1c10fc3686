"""All registered queries of the engine; importing a plan module registers its queries."""

from __future__ import annotations

import importlib

from quarry.plans.base import ORACLES, QUERIES

for _name in ("text_plans", "vector_plans", "relation_plans", "fusion_plans", "ranking_plans", "record_plans", "source_plans", "pipeline_plans", "retrieval_plans", "code_plans"):
    importlib.import_module(f"quarry.plans.{_name}")

FLAGSHIP = "flagship_context"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
