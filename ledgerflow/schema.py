"""Descriptors that tell the operators which columns play which part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventSchema:
    """Column roles of an event ledger (one row per event, or per client-day roll-up)."""

    client: str
    time: str
    categories: tuple[str, ...]
    numerics: tuple[str, ...]

    @property
    def features(self) -> tuple[str, ...]:
        return self.categories + self.numerics

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.client, self.time, *self.features)

    def newest_first(self) -> list[Column]:
        """Total order for "latest N": every feature breaks ties, so input order never matters."""
        return [F.col(c).desc_nulls_last() for c in (self.time, *self.features)]

    def oldest_first(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() for c in (self.time, *self.features)]


@dataclass(frozen=True)
class ColumnSpec:
    """A column to profile; ``kind`` is ``"categorical"`` or ``"numeric"``."""

    name: str
    kind: str

    def __post_init__(self):
        if self.kind not in ("categorical", "numeric"):
            raise ValueError(f"unsupported column kind: {self.kind}")
