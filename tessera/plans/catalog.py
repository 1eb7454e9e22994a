"""The query modules of the engine; importing one registers its queries."""

from __future__ import annotations

import importlib

MODULES = ["retrieval", "notes", "graphs", "topics", "streams", "details", "profiles"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.plans.{name}")
