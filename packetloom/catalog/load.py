"""Imports every catalog module, so that each registers its queries."""

from __future__ import annotations

import importlib
import pkgutil

from packetloom import catalog

_NOT_QUERIES = {"base", "load"}


def all_queries() -> None:
    for module in pkgutil.iter_modules(catalog.__path__):
        if module.name not in _NOT_QUERIES:
            importlib.import_module(f"{catalog.__name__}.{module.name}")
