"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ["text", "scoring", "accounts", "ledger", "mining", "creative", "streaming"]


def load_all():
    """Import every query module and return the registry."""
    for name in MODULES:
        import_module(f"adloom.queries.{name}")
    return import_module("adloom.queries.registry")
