"""Every query of the package by name, with the SQL each must agree with."""

from __future__ import annotations

import importlib

MODULES = ["curves", "cleaning", "profiles", "features", "models", "monitoring", "streams"]


def _catalogs():
    return [importlib.import_module(f"scorewell.catalog.{m}").catalog for m in MODULES]


def all_queries() -> dict:
    return {name: fn for cat in _catalogs() for name, fn in cat.queries.items()}


def all_sql() -> dict:
    return {name: sql for cat in _catalogs() for name, sql in cat.sql.items()}
