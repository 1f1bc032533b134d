"""Registered queries over the given tables, each with its SQL equivalent."""

from __future__ import annotations

import importlib

MODULES = (
    "packet_plans", "flow_plans", "encode_plans", "dataset_plans", "embedding_plans", "text_plans",
)


def _load():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from flowmill.plans import registry

    return registry


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict:
    return dict(_load().ORACLES)
