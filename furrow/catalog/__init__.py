"""Every operator as a named query over the given tables, with its SQL."""

from __future__ import annotations

import importlib

MODULES = ["models", "lags", "cleaning", "preparation", "evaluation", "tracking", "profiling"]


def load_all():
    from furrow.catalog import base

    for name in MODULES:
        importlib.import_module(f"furrow.catalog.{name}")
    return base.QUERIES, base.ORACLE
