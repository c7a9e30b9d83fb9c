"""The query surface. Modules listed here register their queries on import."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import ORACLE, QUERIES

MODULES = ["snapshots", "market", "postings", "state", "feeds", "rules", "loads", "site", "checks", "streams"]


def load_queries() -> dict:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")
    return dict(QUERIES)


def load_oracle() -> dict:
    load_queries()
    return dict(ORACLE)
