"""Queries on the index, packing, styles and retention."""

from __future__ import annotations

import os
import shutil
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import radix64
from ..operators import index as ix
from ..operators import retention, styles
from ..sources import archive
from .derive import ENTRIES, KEY, MAX_ZOOM, bare_entries, entries, shared_folder, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


DIGITS64 = "'" + radix64.DIGITS + "'"
#: SQL macro-like text for base 64 of a number.
SQL64 = "(CASE WHEN {n} < 0 THEN '-' ELSE '' END || ltrim(array_to_string(list_transform(range(10, -1, -1), lambda p: substr(" + DIGITS64 + ", CAST((abs({n}) >> (6 * p)) & 63 AS INTEGER) + 1, 1)), ''), '0'))"

NUMBERS = "(SELECT o_orderkey, (o_orderkey * 7919 - o_custkey * 104729) * (1 + o_orderkey % 1000) AS n FROM orders)"


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "(o_orderkey * 7919 - o_custkey * 104729) * (1 + o_orderkey % 1000) AS n")


@query(f"SELECT o_orderkey, n, {SQL64.format(n='n')} AS s FROM {NUMBERS}")
def radix64_encode(spark, sf_dir):
    return _numbers(spark, sf_dir).select("o_orderkey", "n", radix64.encode(F.col("n")).alias("s"))


@query(f"""SELECT o_orderkey, s, CAST((CASE WHEN s LIKE '-%' THEN -1 ELSE 1 END) * coalesce(list_reduce(list_transform(list_filter(string_split(ltrim(s, '-'), ''), lambda c: c <> ''), lambda c: CAST(instr({DIGITS64}, c) - 1 AS BIGINT)), lambda a, c: a * 64 + c), 0) AS BIGINT) AS n
    FROM (SELECT o_orderkey, {SQL64.format(n='n')} AS s FROM {NUMBERS})""")
def radix64_decode(spark, sf_dir):
    coded = _numbers(spark, sf_dir).select("o_orderkey", radix64.encode(F.col("n")).alias("s"))
    return coded.withColumn("n", radix64.decode(F.col("s")))


@query(f'WITH {ENTRIES} SELECT pos, tile_id, length, "offset" FROM entries')
def index_offsets(spark, sf_dir):
    return entries(spark, sf_dir).select("pos", "tile_id", "length", "offset")


@query(f"WITH {ENTRIES}, d AS (SELECT leaf, pos, tile_id, tile_id - coalesce(lag(tile_id) OVER (PARTITION BY leaf ORDER BY pos), 0) AS delta FROM e0) SELECT leaf, pos, delta, CAST(sum(delta) OVER (PARTITION BY leaf ORDER BY pos) AS BIGINT) AS tile_id FROM d")
def delta_decode(spark, sf_dir):
    e = bare_entries(spark, sf_dir)
    coded = e.withColumn("delta", F.expr("tile_id - coalesce(lag(tile_id) OVER (PARTITION BY leaf ORDER BY pos), 0)")).drop("tile_id")
    return ix.undelta(coded, "delta", "leaf", "pos", "tile_id").select("leaf", "pos", "delta", "tile_id")


#: Offset codes: 0 continues; every seventh entry, and each leaf's first, names its place.
CODED = "CASE WHEN pos % 7 = 0 OR pos % 4096 = 0 THEN pos * 11 + 1 ELSE 0 END"


@query(f"""WITH {ENTRIES}, c AS (SELECT leaf, pos, length, {CODED} AS coded, coalesce(sum(length) OVER (PARTITION BY leaf ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM e0),
    a AS (SELECT *, last_value(CASE WHEN coded <> 0 THEN coded - 1 - cum END IGNORE NULLS) OVER (PARTITION BY leaf ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS shift FROM c)
    SELECT leaf, pos, coded, CAST(cum + shift AS BIGINT) AS "offset" FROM a""")
def contiguous_offset_fill(spark, sf_dir):
    coded = bare_entries(spark, sf_dir).withColumn("coded", F.expr(CODED))
    return ix.fill_offsets(coded, "coded", "length", "leaf", "pos", "offset").select("leaf", "pos", "coded", "offset")


@query(f'WITH {ENTRIES} SELECT chunk_id, min("offset") AS start_byte, max("offset" + length) AS end_byte, count(*) AS n_entries FROM entries GROUP BY chunk_id')
def chunk_bounds(spark, sf_dir):
    return ix.chunks(entries(spark, sf_dir))


#: Chunks that now and then fall back, as an archive that isn't clustered has them.
UNORDERED = "CASE WHEN pos % 97 = 3 THEN chunk_id - pos % 5 ELSE chunk_id END"


@query(f"WITH {ENTRIES}, u AS (SELECT pos, {UNORDERED} AS chunk_id FROM entries), m AS (SELECT pos, chunk_id, max(chunk_id) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM u) SELECT pos, chunk_id, prev_max, prev_max IS NULL OR chunk_id >= prev_max AS kept FROM m")
def chunk_running_max(spark, sf_dir):
    found = ix.running_max_chunk(entries(spark, sf_dir).withColumn("chunk_id", F.expr(UNORDERED)))
    return found.selectExpr("pos", "chunk_id", "prev_max", "prev_max IS NULL OR chunk_id >= prev_max AS kept")


@query(f'WITH {ENTRIES}, l AS (SELECT pos, "offset", chunk_id, lag(chunk_id) OVER (ORDER BY pos) AS prev FROM entries) SELECT pos, "offset", chunk_id FROM l WHERE prev IS NULL OR prev <> chunk_id')
def chunk_boundary_changes(spark, sf_dir):
    return ix.boundaries(entries(spark, sf_dir)).select("pos", "offset", "chunk_id")


@query(f"WITH {ENTRIES} SELECT CAST(count(*) FILTER (lo < f) AS BIGINT) AS disordered, count(*) AS chunks FROM (SELECT chunk_id, min(\"offset\") AS lo, arg_min(\"offset\", pos) AS f FROM entries GROUP BY chunk_id)")
def chunk_invariant(spark, sf_dir):
    e = entries(spark, sf_dir)
    return ix.disordered(e).agg(F.count(F.lit(1)).alias("disordered")).crossJoin(e.agg(F.count_distinct("chunk_id").alias("chunks")))


@query(f'WITH {ENTRIES}, c AS (SELECT chunk_id, min("offset") AS start_byte FROM entries GROUP BY chunk_id) SELECT pos, chunk_id, "offset" - start_byte AS chunk_offset, length FROM entries JOIN c USING (chunk_id)')
def chunk_relative_entries(spark, sf_dir):
    e = entries(spark, sf_dir)
    return ix.relative(e, ix.chunks(e)).select("pos", "chunk_id", "chunk_offset", "length")


PACKED = (
    ENTRIES
    + """,
  c AS (SELECT chunk_id, min("offset") AS start_byte FROM entries GROUP BY chunk_id),
  r AS (SELECT leaf, pos, tile_id, "offset" - start_byte AS o, length, run_length, chunk_id, (row_number() OVER (PARTITION BY leaf ORDER BY pos) - 1) // 50 AS nth FROM entries JOIN c USING (chunk_id)),
  d AS (SELECT *, tile_id - first_value(tile_id) OVER w AS dt, o - first_value(o) OVER w AS dd FROM r WINDOW w AS (PARTITION BY leaf, nth ORDER BY pos)),
  s AS (SELECT *, """
    + " || '|' || ".join(SQL64.format(n=n) for n in ("dt", "dd", "length", "run_length", "chunk_id"))
    + """ || ':' AS item FROM d),
  packed AS (SELECT min(tile_id) AS start_tile_id, arg_min(o, pos) AS first_offset, string_agg(item, '' ORDER BY pos) AS items, CAST(count(*) AS INTEGER) AS n_entries FROM s GROUP BY leaf, nth)"""
)


def _packed(spark, sf_dir):
    e = entries(spark, sf_dir)
    return ix.pack(ix.relative(e, ix.chunks(e)))


@query(f"WITH {PACKED} SELECT start_tile_id, {SQL64.format(n='start_tile_id')} || '|' || {SQL64.format(n='first_offset')} || ':' || items AS entry, n_entries FROM packed")
def directory_pack(spark, sf_dir):
    return _packed(spark, sf_dir)


@query(f"WITH {PACKED} SELECT min(tile_id) OVER (PARTITION BY leaf, nth) AS start_tile_id, CAST(row_number() OVER (PARTITION BY leaf, nth ORDER BY pos) - 1 AS INTEGER) AS i, tile_id, o AS chunk_offset, length, run_length, chunk_id FROM r")
def directory_parse(spark, sf_dir):
    return ix.unpack(_packed(spark, sf_dir))


@query(f"WITH {ENTRIES} SELECT count(*) AS overlapping FROM (SELECT tile_id, run_length, lead(tile_id) OVER (ORDER BY tile_id) AS nxt FROM e0) WHERE nxt < tile_id + run_length")
def index_overlaps(spark, sf_dir):
    return ix.overlapping(bare_entries(spark, sf_dir)).agg(F.count(F.lit(1)).alias("overlapping"))


METADATA = '{"name":"planet","version":"1"}'


@query(f"SELECT start_tile_id, entry FROM (SELECT o_orderkey * 5 AS start_tile_id, CAST(o_totalprice AS BIGINT)::VARCHAR AS entry FROM orders UNION ALL SELECT -1, '{METADATA}') WHERE start_tile_id = -1 LIMIT 1")
def metadata_row(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey * 5 AS start_tile_id", "CAST(CAST(o_totalprice AS BIGINT) AS STRING) AS entry")
    return ix.metadata_row(ix.with_metadata(rows, METADATA))


def _flavours(spark, sf_dir):
    """Base colours from region names."""
    return table(spark, sf_dir, "region").selectExpr("explode(array('light', 'dark', 'black')) AS flavour", "r_regionkey", "lower(r_name) AS r").selectExpr(
        "flavour", "CASE r_regionkey WHEN 0 THEN 'background' WHEN 1 THEN 'earth' WHEN 2 THEN 'water' WHEN 3 THEN 'iconStyle' ELSE r END AS key", "concat(flavour, '-', r) AS value"
    )


_OVERRIDE_ROWS = ", ".join(f"('{t}', '{k}', '{v}')" for t, o in styles.OVERRIDES.items() for k, v in o.items())


@query(f"""WITH f AS (SELECT t.flavour, CASE r_regionkey WHEN 0 THEN 'background' WHEN 1 THEN 'earth' WHEN 2 THEN 'water' WHEN 3 THEN 'iconStyle' ELSE lower(r_name) END AS key, t.flavour || '-' || lower(r_name) AS value
        FROM region CROSS JOIN (VALUES ('light'), ('dark'), ('black')) t(flavour)),
    o(theme, key, value) AS (VALUES {_OVERRIDE_ROWS}),
    u AS (SELECT flavour AS theme, key, value, 1 AS rank FROM f
          UNION ALL SELECT 'dark', key, value, 2 FROM f WHERE flavour = 'black' AND key IN ('background', 'earth')
          UNION ALL SELECT theme, key, value, 3 FROM o)
    SELECT theme, key, arg_max(value, rank) AS value FROM u GROUP BY theme, key""")
def style_matrix(spark, sf_dir):
    rows = styles.themes(spark, _flavours(spark, sf_dir))
    return rows.select("theme", F.explode("colours").alias("key", "value"))


@query("""SELECT t.theme, 'World Map' AS name, 'world-map-' || t.theme AS id, r_name AS layer, 'https://static.example.com/tiles/sprites/v2/' || t.theme AS sprite
    FROM region CROSS JOIN (VALUES ('light'), ('dark'), ('black')) t(theme)""")
def style_documents(spark, sf_dir):
    flavours = _flavours(spark, sf_dir).withColumn("value", F.when(F.col("key") == "iconStyle", F.col("flavour")).otherwise(F.col("value")))
    layers = table(spark, sf_dir, "region").agg(F.to_json(F.array_sort(F.collect_list("r_name"))).alias("layers"))
    rows = styles.themes(spark, flavours)
    made = styles.documents(rows, styles.matrix(rows.select("theme"), layers), "World Map", "https://static.example.com", "https://tiles.example.com/v1.json")
    read = made.select("theme", F.from_json("style", "name string, id string, layers array<string>, sprite string").alias("s"))
    return read.select("theme", "s.name", "s.id", F.explode("s.layers").alias("layer"), "s.sprite")


NAMES = f"concat('ns-', CASE WHEN o_orderkey % 3 = 0 THEN '{KEY}' ELSE concat('2024', o_orderkey % 9) END, '-', o_orderkey)"


@query(f"SELECT o_orderkey, {NAMES} AS name FROM orders WHERE {NAMES} NOT LIKE '%{KEY}%' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def retention_anti(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{NAMES} AS name")
    live = table(spark, sf_dir, "customer").where("c_nationkey < 5").selectExpr("c_custkey AS o_custkey")
    return retention.unreferenced(retention.not_live(orders, KEY), live, "o_custkey").select("o_orderkey", "name")


PATHS = f"concat('/', CASE WHEN o_orderkey % 3 = 0 THEN '{KEY}' ELSE '20240101' END, '/chunk_', o_orderkey, '.pmtiles')"


@query(f"SELECT r_name, {PATHS} AS path FROM orders CROSS JOIN region WHERE NOT starts_with({PATHS}, '/{KEY}/')")
def retention_by_region(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").selectExpr(f"{PATHS} AS path")
    return retention.outside_prefix(objects, KEY, table(spark, sf_dir, "region").select("r_name")).select("r_name", "path")


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def json_values(spark, sf_dir):
    return retention.values("props", table(spark, sf_dir, "events").select("event_id", "props")).select("event_id", "value")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_required(spark, sf_dir):
    return retention.required(table(spark, sf_dir, "events").select("event_id", "props"), "props", "$.k", "k").select("event_id", "k")


# --- a written archive, read back

@query(f'WITH {ENTRIES} SELECT leaf, CAST(row_number() OVER (PARTITION BY leaf ORDER BY tile_id) - 1 AS INTEGER) AS i, tile_id, "offset", length, run_length FROM entries')
def directory_coding(spark, sf_dir):
    return archive.decoded_leaves(archive.encoded_leaves(entries(spark, sf_dir)))


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """The place of an archive of the test entries, without tile bytes."""
    e = entries(spark, sf_dir)
    folder = shared_folder(spark, "archives").removeprefix("file:").replace("//", "/")
    os.makedirs(folder, exist_ok=True)
    weakref.finalize(spark, shutil.rmtree, folder, True)
    path = f"{folder}/test.pmtiles"
    end = e.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0
    archive.write_directories(archive.encoded_leaves(e), path, {"name": "planet", "vector_layers": [{"id": "water"}]}, end, max_zoom=MAX_ZOOM, min_lon=-180, max_lat=85.5, center_zoom=2, center_lat=-1.25)
    archive.register(spark)
    return path


#: Leaves are numbered from 0 on in an archive.
@query(f'WITH {ENTRIES} SELECT CAST(dense_rank() OVER (ORDER BY leaf) - 1 AS INTEGER) AS leaf, row_number() OVER (PARTITION BY leaf ORDER BY tile_id) - 1 AS i, tile_id, "offset", length, run_length FROM entries')
def archive_entries(spark, sf_dir):
    read = spark.read.format("tilearchive").load(_archive(spark, sf_dir))
    return read.select("leaf", (F.col("pos") - F.shiftleft(F.col("leaf").cast("long"), 32)).alias("i"), "tile_id", "offset", "length", "run_length")


@query(f"""WITH {ENTRIES} SELECT 3 AS spec_version, count(*) AS tile_entries, CAST(max("offset" + length) AS BIGINT) AS data_length, true AS clustered, 2 AS internal_compression, 1 AS tile_type,
    {MAX_ZOOM} AS max_zoom, -180.0::DOUBLE AS min_lon, 85.5::DOUBLE AS max_lat, 2 AS center_zoom, -1.25::DOUBLE AS center_lat FROM entries""")
def archive_header(spark, sf_dir):
    read = spark.read.format("tilearchive").option("part", "header").load(_archive(spark, sf_dir))
    return read.select("spec_version", "tile_entries", "data_length", "clustered", "internal_compression", "tile_type", "max_zoom", "min_lon", "max_lat", "center_zoom", "center_lat")


@query("SELECT 'planet' AS name, 'water' AS layer")
def archive_metadata(spark, sf_dir):
    read = spark.read.format("tilearchive").option("part", "metadata").load(_archive(spark, sf_dir))
    return read.select(F.get_json_object("metadata", "$.name").alias("name"), F.get_json_object("metadata", "$.vector_layers[0].id").alias("layer"))
