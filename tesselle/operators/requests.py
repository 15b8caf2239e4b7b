"""Requests: what they ask for, how they are answered, and the documents that go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.curve import in_bounds
from ..functions.maps import merged

#: Fixed value: seconds that a client may keep a response, 31 days.
MAX_AGE = 60 * 60 * 24 * 31

#: Fixed values, as they stand in responses.
KEY_HEADER = "PMTiles-Deployment-Key"
CONTENT_TYPES = {"tile": "application/vnd.mapbox-vector-tile", "json": "application/json", "style": "application/json"}


def parse(requests: DataFrame, url: str = "url", strict_dot: bool = False) -> DataFrame:
    """Adds request_type, version, style, z, x, y."""
    return requests.withColumn("_r", urls.parse_request(F.col(url), strict_dot)).select("*", "_r.*").drop("_r")


def coordinates(parsed: DataFrame) -> DataFrame:
    """The coordinates as numbers; digits that no long holds become null, and so out of bounds."""
    return parsed.withColumns({c: F.expr(f"try_cast({c} AS bigint)") for c in ("z", "x", "y")})


def with_cached(requests: DataFrame, cache: DataFrame, deployment_key: Column, url: str = "url") -> DataFrame:
    """Adds cached_status of a cached response that the live deployment wrote, null otherwise."""
    valid = cache.select(F.col("url").alias("_url"), F.col("deployment_key").alias("_key"), F.col("status").alias("cached_status"))
    return requests.join(valid, (requests[url] == valid["_url"]) & (valid["_key"] == deployment_key), "left").drop("_url", "_key")


def status(method: Column, request_type: Column, z: Column, x: Column, y: Column, found: Column, minzoom: int, maxzoom: int, cached: Column | None = None, strict_parity: bool = False) -> Column:
    """The response's status, by the first rule that holds.

    405 for another method than GET; a valid cached response's own; for tiles 500 out of bounds,
    404 for a zoom that the archive lacks, 200 or else 404 by whether the tile was found (500 for
    a miss under strict_parity); 200 for JSON and styles; 404 for what matches nothing.
    """
    tile = F.when(~in_bounds(z, x, y), 500).when(~z.between(minzoom, maxzoom), 404).when(found, 200).otherwise(500 if strict_parity else 404)
    rules = F.when(F.upper(method) != "GET", 405)
    if cached is not None:
        rules = rules.when(cached.isNotNull(), cached)
    return rules.when(request_type == "tile", tile).when(request_type.isin("json", "style"), 200).otherwise(404)


#: Fixed value: what a worker of the proxy kind answers to everything.
PROXY_TEXT = "get out of here"


def answered(status: Column, broken: Column, worker_type: Column | None = None) -> Column:
    """struct<status, body, flushed>: the response around that of the request's own handling.

    A worker of the proxy kind answers a fixed text; an error outside the handling (``broken``) gives
    500, and then the points gathered so far are not sent.
    """
    proxy = F.lit(False) if worker_type is None else F.coalesce(worker_type == "D1_PROXY", F.lit(False))
    wrong = F.coalesce(broken, F.lit(False))
    return F.struct(
        F.when(proxy, 200).when(wrong, 500).otherwise(status).alias("status"),
        F.when(proxy, PROXY_TEXT).when(wrong, "Internal Server Error").alias("body"),
        (~proxy & ~wrong).alias("flushed"),
    )


def binding(environment: Column, own: Column, shared: Column) -> Column:
    """What a name stands for: the environment's own resource, or the shared one in production."""
    return F.when(environment != "prod", own).otherwise(shared)


def json_cache_key(key: Column) -> Column:
    """The key under which a JSON object is cached: itself."""
    return key


def cacheable(status: Column, request_type: Column) -> Column:
    """Whether a response is put into the cache: found ones, and paths that match nothing."""
    return (status == 200) | ((status == 404) & request_type.isNull())


def headers(deployment_key: Column, request_type: Column) -> Column:
    """The headers of a response, as a map."""
    kind = F.create_map(*(F.lit(v) for pair in CONTENT_TYPES.items() for v in pair))
    fixed = F.create_map(
        F.lit("Cache-Control"), F.lit(f"public, max-age={MAX_AGE}"),
        F.lit("Access-Control-Allow-Origin"), F.lit("*"),
        F.lit("Vary"), F.lit("Origin"),
        F.lit(KEY_HEADER), deployment_key,
        F.lit("Content-Type"), kind[request_type],
    )
    gzip = F.when(request_type == "tile", F.create_map(F.lit("Content-Encoding"), F.lit("gzip"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(fixed, lambda k, v: v.isNotNull()), gzip)


def tilejson(header: Column, metadata: Column, tiles: Column) -> Column:
    """The tile set's description as a struct; vector_layers stays JSON text of whatever shape."""
    return F.struct(
        F.lit("3.0.0").alias("tilejson"),
        F.lit("xyz").alias("scheme"),
        F.array(tiles).alias("tiles"),
        F.get_json_object(metadata, "$.vector_layers").alias("vector_layers"),
        *(F.get_json_object(metadata, f"$.{k}").alias(k) for k in ("attribution", "description", "name", "version")),
        F.array(*(header[k] for k in ("min_lon", "min_lat", "max_lon", "max_lat"))).alias("bounds"),
        F.array(header["center_lon"], header["center_lat"], header["center_zoom"].cast("double")).alias("center"),
        header["min_zoom"].alias("minzoom"),
        header["max_zoom"].alias("maxzoom"),
    )


def with_tile_url(description: Column, url: Column, version: Column) -> Column:
    """A description whose tiles are found where the request came in."""
    place = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    return description.withField("tiles", F.array(urls.tile_url(place, version)))


def rewrite_style(style: Column, origin: Column, version: Column, environment: Column) -> Column:
    """A style document (JSON text) whose vector source is found where the request came in, unless in production."""
    parsed = F.from_json(style, "version int, name string, id string, sources map<string, struct<type string, url string>>, layers string, sprite string, glyphs string")
    source = parsed["sources"]["vector"].withField("url", F.concat(origin, F.lit("/v"), version))
    moved = merged(parsed["sources"], F.create_map(F.lit("vector"), source))
    return F.when(environment == "prod", style).otherwise(F.to_json(parsed.withField("sources", moved)))
