"""Named queries over the driver's tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """Import every query module of this folder and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
