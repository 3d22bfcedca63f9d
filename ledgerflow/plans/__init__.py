"""Registered queries over the given tables."""

from importlib import import_module

MODULES = ("ledger_queries", "sequence_queries", "profile_queries", "match_queries", "panel_queries")


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
