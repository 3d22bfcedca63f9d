"""Spark jobs over client event ledgers: conform, profile, match, window, encode, evaluate."""

from ledgerflow.schema import ColumnSpec, EventSchema

__all__ = ["ColumnSpec", "EventSchema"]
