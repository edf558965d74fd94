"""Every operator bound to the driver tables, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil

from rushlight.queries.registry import QUERIES, SQL


def load():
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return dict(QUERIES), dict(SQL)
