"""Unions of maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(first: Column, *others: Column) -> Column:
    """Union of maps; of equal keys the last map's value, whatever the session's policy for duplicates."""
    for other in others:
        kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(other, k))  # noqa: B023
        first = F.map_concat(kept, other)
    return first
