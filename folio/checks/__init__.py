"""Registered queries over the driver tables, each beside its independent SQL check."""

from __future__ import annotations

import importlib

from folio.checks.base import ORACLES, QUERIES

MODULES = ["raster", "geometry", "catalogue", "naming", "sources", "looks", "outlines", "live", "jobs"]


def load():
    for name in MODULES:
        try:
            importlib.import_module(f"folio.checks.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"folio.checks.{name}":
                raise
    return QUERIES, ORACLES
