"""All queries over the test tables, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, lookup_queries, telemetry_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (archive_queries, lookup_queries, telemetry_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
