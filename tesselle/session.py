"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Right side wins where two maps share a key; times are UTC; streams keep state in RocksDB.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def session(name: str = "tesselle", **settings: str) -> SparkSession:
    """A session with the library's settings; further ones by their names with ``__`` for dots."""
    builder = configure(SparkSession.builder.appName(name))
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
