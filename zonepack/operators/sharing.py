"""Layers over one source: one table for all members, whose views are recovered by their own filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_fields(schema: Sequence[str], kept: Mapping[str, Sequence[str]], filtered: Mapping[str, Sequence[str]]) -> list[str]:
    """Fields of a shared table: what some member keeps or filters by, in schema order."""
    wanted = {c for own in (*kept.values(), *filtered.values()) for c in own}
    return [c for c in schema if c in wanted]


def member_view(shared: DataFrame, fields: Sequence[str], subset: str | None = None) -> DataFrame:
    """A member's exact rows and fields, from the shared table."""
    return (shared.where(F.expr(subset)) if subset else shared).select(*fields)
