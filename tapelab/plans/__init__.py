"""Registered queries. Importing a plan module adds its queries to the registry."""

from __future__ import annotations

import importlib

MODULES = ["tape", "files", "screen", "pools", "wallets", "replay", "ledger", "models", "streams"]


def load_registry():
    from tapelab.plans import registry
    for m in MODULES:
        importlib.import_module(f"tapelab.plans.{m}")
    return registry.QUERIES, registry.ORACLES
