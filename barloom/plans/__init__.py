"""Registered queries. ``load`` imports the modules that hold them."""

from __future__ import annotations

import importlib

MODULES = ("market", "trading", "simulation", "streams", "records", "sources")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"barloom.plans.{name}")
