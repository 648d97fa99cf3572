"""Named queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "feature_queries",
    "quality_queries",
    "profile_queries",
    "sampling_queries",
    "detection_queries",
    "oversampling_queries",
    "model_queries",
    "invariant_queries",
)


def _load():
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from . import registry

    return registry


def queries():
    return dict(_load().QUERIES)


def oracles():
    return dict(_load().ORACLES)
