"""Named queries over the given tables, each with the SQL it must equal."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog() -> dict:
    """All named queries: ``key -> (function of Tables, SQL or None)``."""
    from . import catalog

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{m.name}")
    return {k: (fn, catalog.SQL.get(k)) for k, fn in catalog.QUERIES.items()}
