"""All registered queries, by the area they belong to."""

from __future__ import annotations

import importlib

from keysift.plans.catalog.base import ORACLES, QUERIES

AREAS = [
    "membership", "source_queries", "feature_queries", "model_queries", "evaluation_queries", "observation_queries", "log_queries",
    "stream_queries",
]


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"keysift.plans.catalog.{area}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
