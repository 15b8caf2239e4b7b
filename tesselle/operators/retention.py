"""What may be deleted: objects and namespaces that are not of the live deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_live(names: DataFrame, deployment_key: str, name: str = "name") -> DataFrame:
    """Names that do not contain the live key; a null name stays out."""
    return names.where(~F.contains(F.col(name), F.lit(deployment_key)))


def outside_prefix(objects: DataFrame, deployment_key: str, regions: DataFrame, branch: str = "main", path: str = "path") -> DataFrame:
    """Objects of every region outside /<key>/; nothing on another branch than main. Broadcast is the engine's choice, by size."""
    doomed = objects.where(~F.col(path).startswith(f"/{deployment_key}/")) if branch == "main" else objects.where(F.lit(False))
    return doomed.withColumn("_all", F.lit(1)).join(regions.withColumn("_all", F.lit(1)), "_all").drop("_all")


def unreferenced(objects: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Objects whose key the live table does not have."""
    return objects.join(live.select(key).distinct(), key, "left_anti")


def values(json: str, df: DataFrame, out: str = "value") -> DataFrame:
    """The values of a JSON object, a row each."""
    entries = F.from_json(json, "map<string,string>")
    return df.select("*", F.explode(F.map_values(entries)).alias(out))


def required(df: DataFrame, json: str, path: str, out: str) -> DataFrame:
    """A field of a JSON text; a missing, null or empty one is an error."""
    found = F.nullif(F.get_json_object(json, path), F.lit(""))
    return df.withColumn(out, F.when(found.isNull(), F.raise_error(F.lit(f"{path} is missing"))).otherwise(found))
