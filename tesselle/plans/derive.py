"""Archive, request and metric inputs made from the test tables, and the same in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import telemetry as tm

KEY = "20250818"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one; a local one only where none is set and Spark is on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tesselle-")
    return f"{where.rstrip('/')}/{name}/{uuid.uuid4().hex}"


MAX_ZOOM = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without offsets: pos, leaf, tile_id, run_length, length."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS pos", "o_orderkey div 4096 AS leaf", "o_orderkey * 5 AS tile_id", "1 + o_orderkey % 4 AS run_length", "CAST(floor(o_totalprice) AS BIGINT) AS length"
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with offset (running sum of lengths) and chunk_id."""
    return ix.prefix_sum(bare_entries(spark, sf_dir), "length", "pos", "offset").withColumn("chunk_id", ix.chunk_of(F.col("offset")))


ENTRIES = """e0 AS (
    SELECT o_orderkey AS pos, o_orderkey // 4096 AS leaf, o_orderkey * 5 AS tile_id, 1 + o_orderkey % 4 AS run_length, CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders),
  e1 AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM e0),
  entries AS (SELECT *, "offset" // 1000000 AS chunk_id FROM e1)"""


def lookup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index that lookups need: keys and runs."""
    return bare_entries(spark, sf_dir).selectExpr("tile_id AS start_tile_id", "run_length", "length")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, z, x, y of a tile request for each event."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 12 AS z", "user_id")
    return events.selectExpr("event_id", "z", "(user_id * 7919 + event_id) % shiftleft(1L, CAST(z AS INT)) AS x", "(event_id * 104729) % shiftleft(1L, CAST(z AS INT)) AS y")


REQUESTS = """requests AS (
    SELECT event_id, event_id % 12 AS z, (user_id * 7919 + event_id) % (1::BIGINT << (event_id % 12)) AS x, (event_id * 104729) % (1::BIGINT << (event_id % 12)) AS y FROM events)"""

#: Curve ids of requests, bit by bit.
TILE_IDS = """walk(event_id, z, i, x, y, d) AS (
    SELECT event_id, z, CAST(z - 1 AS BIGINT), x, y, 0::BIGINT FROM requests
    UNION ALL
    SELECT event_id, z, i - 1,
           CASE WHEN ry = 1 THEN lx WHEN rx = 1 THEN side - 1 - ly ELSE ly END,
           CASE WHEN ry = 1 THEN ly WHEN rx = 1 THEN side - 1 - lx ELSE lx END,
           d + side * side * xor(3 * rx, ry)
    FROM (SELECT *, (x >> i) & 1 AS rx, (y >> i) & 1 AS ry, x % (1::BIGINT << i) AS lx, y % (1::BIGINT << i) AS ly, (1::BIGINT << i) AS side FROM walk WHERE i >= 0)),
  tile_ids AS (SELECT event_id, z, d + ((1::BIGINT << (2 * z)) - 1) // 3 AS tile_id FROM walk WHERE i = -1)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, method, url: seven kinds of paths, good and bad."""
    r = requests(spark, sf_dir)
    return r.selectExpr(
        "event_id",
        "CASE WHEN event_id % 11 = 0 THEN 'POST' WHEN event_id % 11 = 1 THEN 'get' ELSE 'GET' END AS method",
        """concat('https://tiles', event_id % 3, '.example.com', CASE event_id % 7
            WHEN 0 THEN concat('/v1/', z, '/', x, '/', y, '.mvt')
            WHEN 1 THEN concat('/v', event_id % 3)
            WHEN 2 THEN concat('/v2.json', CASE WHEN event_id % 2 = 0 THEN '?a=1' ELSE '' END)
            WHEN 3 THEN concat('/v1/style/dark', CASE WHEN event_id % 2 = 0 THEN '.json' ELSE '' END)
            WHEN 4 THEN concat('/v1/', z + 20, '/', x, '/', y, 'Xmvt')
            WHEN 5 THEN concat('/v1/', z, '/', y, '/', x + 1, '.mvt?q=2')
            ELSE concat('/v1/', z, '/', x, '/', y, '.mvt/extra') END) AS url""",
    )


PATHS = (
    REQUESTS
    + """,
  paths AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'POST' WHEN event_id % 11 = 1 THEN 'get' ELSE 'GET' END AS method,
    'https://tiles' || (event_id % 3) || '.example.com' || CASE event_id % 7
            WHEN 0 THEN '/v1/' || z || '/' || x || '/' || y || '.mvt'
            WHEN 1 THEN '/v' || (event_id % 3)
            WHEN 2 THEN '/v2.json' || CASE WHEN event_id % 2 = 0 THEN '?a=1' ELSE '' END
            WHEN 3 THEN '/v1/style/dark' || CASE WHEN event_id % 2 = 0 THEN '.json' ELSE '' END
            WHEN 4 THEN '/v1/' || (z + 20) || '/' || x || '/' || y || 'Xmvt'
            WHEN 5 THEN '/v1/' || z || '/' || y || '/' || (x + 1) || '.mvt?q=2'
            ELSE '/v1/' || z || '/' || x || '/' || y || '.mvt/extra' END AS url FROM requests),
  cut AS (SELECT *, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path FROM paths),
  got AS (SELECT *, regexp_extract(path, '^/v([0-9]+)(?:/style/(\\w+)(?:\\.json)?|(\\.json)|/([0-9]+)/([0-9]+)/([0-9]+).mvt)?$', ['v', 's', 'j', 'z', 'x', 'y']) AS m FROM cut),
  parsed AS (SELECT event_id, method, url, CASE WHEN m.z <> '' THEN 'tile' WHEN m.s <> '' THEN 'style' WHEN m.v <> '' THEN 'json' END AS request_type,
    nullif(m.v, '') AS version, nullif(m.s, '') AS style, nullif(m.z, '') AS z, nullif(m.x, '') AS x, nullif(m.y, '') AS y FROM got)"""
)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric samples: t_us, event_id, metric, colo, value, domain, and a series of metric and colo."""
    e = table(spark, sf_dir, "events")
    return e.select(
        tm.micros("ts").alias("t_us"),
        "event_id",
        F.col("event_type").alias("metric"),
        F.concat(F.lit("C"), (F.col("user_id") % 8).cast("string")).alias("colo"),
        "value",
        F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("domain"),
    )


SAMPLES = """samples AS (
    SELECT epoch_us(ts) AS t_us, event_id, event_type AS metric, 'C' || (user_id % 8) AS colo, value, 'd' || (user_id % 5) AS domain FROM events)"""


def spread(source: str, window: int, step: int, name: str = "spread", where: str = "true") -> str:
    """SQL: each sample once for each window that holds it."""
    return f"""{name} AS (SELECT *, unnest(generate_series(((t_us + {step - 1}) // {step}) * {step}, ((t_us + {step - 1}) // {step}) * {step} + {window - step}, {step})) AS t FROM {source} WHERE {where})"""
