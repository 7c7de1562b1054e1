"""Query plans: each module registers its queries in :mod:`platewise.catalog` when it is imported."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of this package, so that all queries are registered."""
    for found in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{found.name}")
