"""Registered queries: each on the given tables, with its SQL check."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module; returns (queries, SQL checks)."""
    from paperloom.plans.registry import QUERIES, SQL_CHECKS

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return QUERIES, SQL_CHECKS
