"""Queries on curve ids, requests and tile lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import curve, urls
from ..operators import index as ix
from ..operators import lookup as lk
from ..operators import requests as rq
from ..operators import telemetry as tm
from .derive import ENTRIES, KEY, MAX_ZOOM, PATHS, REQUESTS, TILE_IDS, lookup_index, paths, requests, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH RECURSIVE {REQUESTS}, {TILE_IDS} SELECT event_id, tile_id FROM tile_ids")
def tile_id_hilbert(spark, sf_dir):
    return curve.with_tile_id(requests(spark, sf_dir)).select("event_id", "tile_id")


@query(f"WITH {REQUESTS} SELECT event_id, z, x, y FROM requests")
def tile_id_inverse(spark, sf_dir):
    ids = requests(spark, sf_dir).select("event_id", curve.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("t"))
    return ids.select("event_id", curve.tile_zxy(F.col("t")).alias("p")).select("event_id", F.col("p.z").cast("long").alias("z"), "p.x", "p.y")


ODD = "event_id, event_id % 29 AS z, (user_id * 7919 + event_id) % 4096 AS x, event_id % 64 - 1 AS y"


@query(f"SELECT event_id, CASE WHEN z BETWEEN 0 AND 26 AND x < (1::BIGINT << z) AND y >= 0 AND y < (1::BIGINT << z) THEN 200 ELSE 500 END AS status FROM (SELECT {ODD} FROM events)")
def tile_id_bounds_status(spark, sf_dir):
    r = table(spark, sf_dir, "events").selectExpr(*[c.strip() for c in ("event_id", "event_id % 29 AS z", "(user_id * 7919 + event_id) % 4096 AS x", "event_id % 64 - 1 AS y")])
    return r.select("event_id", F.when(curve.in_bounds(F.col("z"), F.col("x"), F.col("y")), 200).otherwise(500).alias("status"))


@query(f"WITH {REQUESTS} SELECT event_id, z FROM requests WHERE z BETWEEN 2 AND {MAX_ZOOM}")
def tile_zoom_filter(spark, sf_dir):
    return requests(spark, sf_dir).where(F.col("z").between(2, MAX_ZOOM)).select("event_id", "z")


def _parsed(spark, sf_dir):
    return rq.parse(paths(spark, sf_dir))


@query(f"WITH {PATHS} SELECT event_id, url, request_type, version, style, z, x, y FROM parsed")
def request_parse(spark, sf_dir):
    return _parsed(spark, sf_dir).drop("method")


@query(f"WITH {PATHS} SELECT coalesce(request_type, 'none') AS request_type, count(*) AS n FROM parsed GROUP BY 1")
def request_type_counts(spark, sf_dir):
    return _parsed(spark, sf_dir).groupBy(F.coalesce("request_type", F.lit("none")).alias("request_type")).agg(F.count(F.lit(1)).alias("n"))


#: Tiles that the archive has: those whose x and y sum up to an even number.
STATUS = f"""CASE WHEN upper(method) <> 'GET' THEN 405
    {{cached}}
    WHEN request_type = 'tile' THEN
        CASE WHEN TRY_CAST(z AS BIGINT) > 26 OR TRY_CAST(x AS BIGINT) >= (1::BIGINT << least(TRY_CAST(z AS BIGINT), 26)) OR TRY_CAST(y AS BIGINT) >= (1::BIGINT << least(TRY_CAST(z AS BIGINT), 26)) THEN 500
             WHEN TRY_CAST(z AS BIGINT) > {MAX_ZOOM} THEN 404 WHEN (TRY_CAST(x AS BIGINT) + TRY_CAST(y AS BIGINT)) % 2 = 0 THEN 200 ELSE 404 END
    WHEN request_type IN ('json', 'style') THEN 200 ELSE 404 END"""


def _status(parsed, cached=None):
    r = rq.coordinates(parsed)
    found = (F.col("x") + F.col("y")) % 2 == 0
    return r.withColumn("status", rq.status(F.col("method"), F.col("request_type"), F.col("z"), F.col("x"), F.col("y"), found, 0, MAX_ZOOM, cached))


@query(f"WITH {PATHS}, s AS (SELECT *, {STATUS.format(cached='')} AS status FROM parsed) SELECT event_id, status, status = 200 OR (status = 404 AND request_type IS NULL) AS cacheable FROM s")
def request_status(spark, sf_dir):
    s = _status(_parsed(spark, sf_dir))
    return s.select("event_id", "status", rq.cacheable(F.col("status"), F.col("request_type")).alias("cacheable"))


@query(f"""WITH {PATHS}, cache AS (SELECT DISTINCT url, CASE WHEN length(url) % 2 = 0 THEN '{KEY}' ELSE 'old' END AS key, 203 AS st FROM parsed WHERE event_id % 5 = 0),
    j AS (SELECT p.*, c.st FROM parsed p LEFT JOIN cache c ON p.url = c.url AND c.key = '{KEY}')
    SELECT event_id, st IS NOT NULL AS cached, {STATUS.format(cached='WHEN st IS NOT NULL THEN st')} AS status FROM j""")
def cache_validity(spark, sf_dir):
    p = _parsed(spark, sf_dir)
    cache = paths(spark, sf_dir).where("event_id % 5 = 0").selectExpr("url", f"CASE WHEN length(url) % 2 = 0 THEN '{KEY}' ELSE 'old' END AS deployment_key", "203 AS status").distinct()
    s = _status(rq.with_cached(p, cache, F.lit(KEY)), F.col("cached_status"))
    return s.selectExpr("event_id", "cached_status IS NOT NULL AS cached", "status")


@query(f"""WITH {PATHS} SELECT event_id, 'public, max-age=2678400' AS cache_control, CASE request_type WHEN 'tile' THEN 'application/vnd.mapbox-vector-tile' ELSE 'application/json' END AS content_type, CASE request_type WHEN 'tile' THEN 'gzip' END AS content_encoding FROM parsed WHERE request_type IS NOT NULL""")
def response_headers(spark, sf_dir):
    h = _parsed(spark, sf_dir).where("request_type IS NOT NULL").select("event_id", rq.headers(F.lit(KEY), F.col("request_type")).alias("h"))
    return h.select("event_id", *(F.try_element_at("h", F.lit(k)).alias(n) for k, n in (("Cache-Control", "cache_control"), ("Content-Type", "content_type"), ("Content-Encoding", "content_encoding"))))


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/v2/{z}/{x}/{y}.mvt' AS tile_url, 'planet' AS name, 14 AS maxzoom FROM pages")
def tilejson_rewrite(spark, sf_dir):
    header = F.struct(*(F.lit(v).alias(k) for k, v in {"min_lon": -180.0, "min_lat": -85.0, "max_lon": 180.0, "max_lat": 85.0, "center_lon": 0.0, "center_lat": 0.0, "center_zoom": 0, "min_zoom": 0, "max_zoom": 14}.items()))
    made = rq.tilejson(header, F.lit('{"name":"planet","vector_layers":[{"id":"water"}]}'), F.lit("unset"))
    pages = table(spark, sf_dir, "pages").select("page_id", rq.with_tile_url(made, F.col("url"), F.lit("2")).alias("t"))
    return pages.select("page_id", F.col("t.tiles")[0].alias("tile_url"), "t.name", "t.maxzoom")


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/v1' AS source_url, 'World' AS name FROM pages")
def style_rewrite(spark, sf_dir):
    style = F.lit('{"version":8,"name":"World","sources":{"vector":{"type":"vector","url":"https://tiles.example.com/v1.json"}},"layers":[]}')
    origin = F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1)
    made = table(spark, sf_dir, "pages").select("page_id", rq.rewrite_style(style, origin, F.lit("1"), F.lit("dev")).alias("s"))
    return made.select("page_id", F.get_json_object("s", "$.sources.vector.url").alias("source_url"), F.get_json_object("s", "$.name").alias("name"))


@query("""WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) || ':' AS protocol, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
    SELECT page_id, protocol, host, CASE WHEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) END AS apex FROM h""")
def origin_protocol_host(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.protocol(u).alias("protocol"), urls.host(u).alias("host"), urls.apex_domain(u).alias("apex"))


# --- lookups

ASOF = f"""{REQUESTS}, {TILE_IDS},
    idx AS (SELECT o_orderkey * 5 AS start_tile_id, 1 + o_orderkey % 4 AS run_length, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders),
    found AS (SELECT t.event_id, t.z, t.tile_id, i.start_tile_id, i.run_length, i.length FROM tile_ids t ASOF LEFT JOIN idx i ON t.tile_id >= i.start_tile_id)"""


@query(f"WITH RECURSIVE {ASOF} SELECT event_id, tile_id, start_tile_id AS entry_start_tile_id, run_length AS entry_run_length FROM found")
def tile_lookup_asof(spark, sf_dir):
    ids = requests(spark, sf_dir).select("event_id", curve.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"))
    return lk.asof_lookup(ids, lookup_index(spark, sf_dir)).select("event_id", "tile_id", "entry_start_tile_id", "entry_run_length")


@query(f"""WITH RECURSIVE {ASOF}, c AS (SELECT *, z <= {MAX_ZOOM} AND tile_id >= start_tile_id AND tile_id < start_tile_id + greatest(run_length, 1) AS hit FROM found)
    SELECT event_id, tile_id, CASE WHEN hit THEN 200 ELSE 404 END AS status, CASE WHEN hit THEN start_tile_id END AS entry_start_tile_id, CASE WHEN hit THEN length END AS entry_length FROM c""")
def tile_lookup_contains(spark, sf_dir):
    return lk.locate(requests(spark, sf_dir), lookup_index(spark, sf_dir), 0, MAX_ZOOM).select("event_id", "tile_id", "status", "entry_start_tile_id", "entry_length")


@query("SELECT o_orderkey * 5 AS start_tile_id, 1 + o_orderkey % 4 AS run_length FROM orders WHERE o_orderkey * 5 <= 12345 ORDER BY 1 DESC LIMIT 1")
def tile_lookup_point(spark, sf_dir):
    return lk.point_lookup(lookup_index(spark, sf_dir), 12345).select("start_tile_id", "run_length")


@query("SELECT doc_id AS chunk_id, n_chars // 3 AS \"offset\", 16 AS length, substr(text, CAST(n_chars // 3 + 1 AS BIGINT), 16) AS bytes FROM documents")
def tile_lookup_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    located = docs.selectExpr("doc_id AS chunk_id", "n_chars div 3 AS offset", "16 AS length")
    return lk.read_ranges(located, docs.selectExpr("doc_id AS chunk_id", "text AS data")).select("chunk_id", "offset", "length", "bytes")


@query("SELECT doc_id AS chunk_id, n // 3 AS \"offset\", 16 AS length, substr(h, CAST(2 * (n // 3) + 1 AS BIGINT), 32) AS bytes FROM (SELECT doc_id, hex(encode(text)) AS h, length(hex(encode(text))) // 2 AS n FROM documents)")
def tile_lookup_blob(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id AS chunk_id", "encode(text, 'UTF-8') AS data")
    located = docs.selectExpr("chunk_id", "octet_length(data) div 3 AS offset", "16 AS length")
    return lk.read_ranges(located, docs).select("chunk_id", "offset", "length", F.hex("bytes").alias("bytes"))


@query(f"WITH {ENTRIES}, s AS (SELECT chunk_id, min(\"offset\") AS start_byte FROM entries GROUP BY chunk_id) SELECT tile_id, format('chunk_{{}}.pmtiles', chunk_id) AS object, \"offset\" - start_byte AS first_byte, \"offset\" - start_byte + length - 1 AS last_byte FROM entries JOIN s USING (chunk_id)")
def object_ranges(spark, sf_dir):
    from .derive import entries

    e = entries(spark, sf_dir)
    r = ix.relative(e, ix.chunks(e))
    return r.select("tile_id", F.format_string("chunk_%d.pmtiles", "chunk_id").alias("object"), F.col("chunk_offset").alias("first_byte"), (F.col("chunk_offset") + F.col("length") - 1).alias("last_byte"))


# --- metric points

TAGS = ("continent", "colo", "asOrg", "apexDomain", "protocol")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'EU' END AS continent, 'C' || (user_id % 8) AS colo, 'AS' || (user_id % 4) AS as_org, 'example.com' AS apex_domain, 'https:' AS protocol,
    CAST(event_id % 12 AS VARCHAR) AS z, 5 + (user_id % 2) AS n FROM events""")
def metric_tags_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    origin = F.lit("https://maps.example.com")
    defaults = tm.default_tags(F.when(F.col("user_id") % 3 != 0, "EU"), F.concat(F.lit("C"), (F.col("user_id") % 8).cast("string")), F.concat(F.lit("AS"), (F.col("user_id") % 4).cast("string")), urls.apex_domain(origin), urls.protocol(origin))
    own = F.create_map(F.lit("colo"), F.lit("lost"), F.lit("z"), (F.col("event_id") % 12).cast("string"))
    more = F.when(F.col("user_id") % 2 == 1, F.create_map(F.lit("v"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    tags = e.select("event_id", tm.merged_tags(F.map_concat(own, more), defaults).alias("t"))
    named = {"continent": "continent", "colo": "colo", "asOrg": "as_org", "apexDomain": "apex_domain", "protocol": "protocol", "z": "z"}
    return tags.select("event_id", *(F.col("t")[k].alias(n) for k, n in named.items()), (F.size("t") - 1).cast("long").alias("n"))


@query("""SELECT event_id, 'tiles_' || event_type AS name, 1.0::DOUBLE AS invocation, CASE WHEN event_type = 'error' AND user_id % 4 <> 0 THEN 1.0::DOUBLE END AS errors, value AS duration FROM events""")
def metric_monitor_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    fields = tm.monitored(F.col("value"), F.col("event_type") == "error", F.when(F.col("user_id") % 4 == 0, "NotFound").otherwise("Other"), ["NotFound"])
    made = e.select("event_id", tm.metric_name(F.lit("tiles"), F.col("event_type")).alias("name"), fields.alias("f"))
    return made.select("event_id", "name", *(F.try_element_at("f", F.lit(k))["value"].alias(k) for k in ("invocation", "errors", "duration")))


@query("""SELECT event_id, 'tiles_' || event_type || ',colo=C' || (user_id % 8) || ',org=AS\\ ' || (user_id % 4) || '\\,x' || ' duration=' || CAST(floor(value) AS BIGINT) || 'i,'
    || CASE WHEN event_type = 'error' THEN 'errors=1i,' ELSE '' END || 'invocation=1i' AS line FROM events""")
def line_protocol(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tags = F.create_map(F.lit("org"), F.concat(F.lit("AS "), (F.col("user_id") % 4).cast("string"), F.lit(",x")), F.lit("colo"), F.concat(F.lit("C"), (F.col("user_id") % 8).cast("string")), F.lit("none"), F.lit(""))
    fields = tm.monitored(F.col("value"), F.col("event_type") == "error")
    return e.select("event_id", tm.line_protocol(tm.metric_name(F.lit("tiles"), F.col("event_type")), tags, fields).alias("line"))


@query("""SELECT user_id, string_agg(CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '_sql' ELSE event_type || '_count' END || ';dur=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), ', ' ORDER BY event_id) AS server_timing FROM events GROUP BY user_id""")
def server_timing(spark, sf_dir):
    label = F.when(F.col("event_id") % 3 == 0, "duration").when(F.col("event_id") % 3 == 1, "sql_duration").otherwise("count")
    item = tm.timing(F.col("event_type"), label, F.floor("value").cast("string"))
    return tm.server_timing(table(spark, sf_dir, "events").select("user_id", "event_id", item.alias("item")), "user_id", "event_id")


@query(f"""WITH {PATHS} SELECT event_id, 'tiles_cdn_hit,deployment_key={KEY},request_type=' || coalesce(request_type, 'unknown')
    || CASE WHEN request_type = 'style' THEN ',style=' || style WHEN request_type = 'tile' THEN ',z=' || z ELSE '' END || ' count=1i' AS line FROM parsed""")
def cdn_hit_points(spark, sf_dir):
    tags, fields = tm.cdn_hit(F.lit(KEY), F.col("request_type"), F.col("z"), F.col("style"))
    return _parsed(spark, sf_dir).select("event_id", tm.line_protocol(F.lit("tiles_cdn_hit"), tags, fields).alias("line"))


@query("""SELECT event_id, 'd1_query,query=SELECT\\ 1' || CASE WHEN user_id % 2 = 0 THEN ',served_by_primary=true' ELSE '' END || ',served_by_region=R' || (user_id % 3)
    || ' count=1i,duration=' || CAST(floor(value) AS BIGINT) || 'i,rows_read=' || (event_id % 50) || 'i' || CASE WHEN user_id % 5 > 0 THEN ',sql_duration=' || CAST(floor(value / 2) AS BIGINT) || 'i' ELSE '' END AS line FROM events""")
def query_points(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    region, primary = F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string")), F.when(F.col("user_id") % 2 == 0, True)
    tags, fields = tm.query_point(F.lit("SELECT 1"), region, primary, F.col("value"), F.col("event_id") % 50, F.when(F.col("user_id") % 5 > 0, F.col("value") / 2))
    return e.select("event_id", tm.line_protocol(F.lit("d1_query"), tags, fields).alias("line"))


@query("SELECT CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS kept, 0::BIGINT AS sent FROM events")
def error_points(spark, sf_dir):
    tags, fields = tm.error_point(F.col("props"))
    made = table(spark, sf_dir, "events").where("event_type = 'error'").select(tags.alias("t"), tm.line_protocol(F.lit("error"), tags, fields).alias("line"))
    return made.agg(F.count("t").alias("kept"), F.count("line").alias("sent"))


NAMES = "[" + ", ".join(f"'{n}'" for n in tm.OPERATIONS) + "]"


@query(f"SELECT event_id, 'tiles_' || {NAMES}[1 + event_id % {len(tm.OPERATIONS)}] AS name FROM events")
def metric_names(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in tm.OPERATIONS))
    return table(spark, sf_dir, "events").select("event_id", tm.metric_name(F.lit("tiles"), F.get(names, (F.col("event_id") % len(tm.OPERATIONS)).cast("int"))).alias("name"))


@query("""SELECT event_id, 'header' AS provider, event_type || ';dur=' || CAST(floor(value) AS BIGINT) AS item FROM events WHERE user_id % 3 > 0
    UNION ALL SELECT event_id, 'influx', event_type || ' duration=' || CAST(floor(value) AS BIGINT) || 'i' FROM events""")
def metric_fan_out(spark, sf_dir):
    duration = F.floor("value")
    line = tm.line_protocol(F.col("event_type"), F.create_map().cast("map<string,string>"), F.create_map(F.lit("duration"), tm.field(F.col("value"), "duration")))
    header = F.when(F.col("user_id") % 3 > 0, tm.timing(F.col("event_type"), F.lit("duration"), duration.cast("string")))
    return tm.fan_out(table(spark, sf_dir, "events"), {"influx": line, "header": header}).select("event_id", "provider", "item")


@query(f"""WITH {PATHS}, s AS (SELECT *, {STATUS.format(cached='')} AS status FROM parsed)
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 200 WHEN event_id % 17 = 0 THEN 500 ELSE status END AS status,
    CASE WHEN event_id % 13 = 0 THEN 'get out of here' WHEN event_id % 17 = 0 THEN 'Internal Server Error' END AS body, event_id % 13 > 0 AND event_id % 17 > 0 AS flushed FROM s""")
def response_outside_handling(spark, sf_dir):
    s = _status(_parsed(spark, sf_dir))
    kind = F.when(F.col("event_id") % 13 == 0, "D1_PROXY").otherwise("LOADER")
    return s.select("event_id", rq.answered(F.col("status"), F.col("event_id") % 17 == 0, kind).alias("a")).select("event_id", "a.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'global_db' ELSE 'dev_db' END AS bound, 'k' || event_id AS cache_key, (epoch_us(ts) % 1000) / 1000.0::DOUBLE AS elapsed_ms FROM events")
def environment_binding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.timestamp_micros(F.unix_micros("ts") - F.unix_micros("ts") % 1000)
    bound = rq.binding(F.when(F.col("event_id") % 3 == 0, "prod").otherwise("dev"), F.lit("dev_db"), F.lit("global_db"))
    return e.select("event_id", bound.alias("bound"), rq.json_cache_key(F.concat(F.lit("k"), F.col("event_id").cast("string"))).alias("cache_key"), tm.elapsed(start, F.col("ts")).alias("elapsed_ms"))
