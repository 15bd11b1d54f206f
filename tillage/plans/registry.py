"""All registered queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

import importlib

from tillage.plans.common import Registered

MODULES = [
    "tillage.plans.admin",
    "tillage.plans.depot",
    "tillage.plans.catalog",
    "tillage.plans.orders",
    "tillage.plans.vendor",
    "tillage.plans.customer",
    "tillage.plans.sales",
    "tillage.plans.access",
    "tillage.plans.jobs",
    "tillage.plans.content",
    "tillage.plans.blocks",
    "tillage.plans.rollups",
]


def registered() -> list[Registered]:
    out: list[Registered] = []
    seen: set[str] = set()
    for mod in MODULES:
        for r in importlib.import_module(mod).REGISTRY:
            if r.name in seen:
                raise ValueError(f"duplicate query name {r.name}")
            seen.add(r.name)
            out.append(r)
    return out
