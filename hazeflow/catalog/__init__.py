"""Registered queries and their SQL twins."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

MODULES = ["features", "live", "profile", "store", "mldata", "models", "explain", "streams"]

for _m in MODULES:
    import_module(f"{__name__}.{_m}")


def all_queries():
    return dict(QUERIES)


def all_oracles():
    return dict(ORACLES)
