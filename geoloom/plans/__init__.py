"""Ready-made queries over the star-schema test tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every query module and return ``(queries, sql)``."""
    from geoloom.plans import registry
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry.QUERIES, registry.ORACLES
