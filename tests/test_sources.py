import struct

import pytest
from pyspark.sql import functions as F

from tesselle.operators import index as ix
from tesselle.operators import lookup as lk
from tesselle.sources import archive, tables


def test_varints():
    numbers = [0, 1, 127, 128, 300, 2**32, 2**53, 2**62]
    assert archive.varints(archive.encode_varints(numbers)).tolist() == numbers
    assert archive.varints(b"").tolist() == []
    with pytest.raises(ValueError):
        archive.varints(b"\xff" * 11 + b"\x01")


def test_directory_round_trip_and_fill():
    d = archive.decode_directory(archive.encode_varints([5, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 10, 5, 7, 4, 3, 1, 0, 0, 11, 0]))
    assert d["offset"].tolist() == [0, 10, 15, 10, 14]
    for broken in (b"", archive.encode_varints([0]), archive.encode_varints([1, 5, 1, 3, 0]), archive.encode_varints([2, 1, 1])):
        with pytest.raises(ValueError):
            archive.decode_directory(broken)


def test_header_round_trip_and_errors():
    h = {"root_offset": 127, "root_length": 5, "data_length": 2**40, "min_lon": -179.5, "max_lat": 85.0511287, "center_zoom": 3, "max_zoom": 14, "internal_compression": 2, "clustered": True}
    got = archive.decode_header(archive.encode_header(h))
    assert all(got[k] == pytest.approx(v) for k, v in h.items()) and got["spec_version"] == 3
    raw = bytearray(archive.encode_header(h))
    for at, value in ((0, 0), (7, 2)):
        bad = bytearray(raw)
        bad[at] = value
        with pytest.raises(ValueError):
            archive.decode_header(bytes(bad))
    with pytest.raises(ValueError):
        archive.decode_header(raw[:50])
    big = bytearray(raw)
    struct.pack_into("<Q", big, 8, 1 << 63)
    with pytest.raises(ValueError):
        archive.decode_header(bytes(big))
    with pytest.raises(ValueError):
        archive.decompress(b"", 3)


@pytest.mark.parametrize("codec", [1, 2])
def test_whole_path_from_archive_to_tile_bytes(spark, tmp_path, codec):
    tiles = [(i * 3, 1 + i % 3, f"tile {i % 40}".encode() * (1 + i % 5)) for i in range(200)]
    path = str(tmp_path / "a.pmtiles")
    archive.write_archive(path, tiles, {"name": "planet"}, leaf_entries=16, codec=codec, min_zoom=0, max_zoom=6, max_lon=180)
    archive.register(spark)
    read = spark.read.format("tilearchive")
    header = read.option("part", "header").load(path).first()
    assert header.tile_entries == 200 and header.max_zoom == 6 and header.max_lon == 180.0
    assert read.option("part", "metadata").load(path).first().metadata == '{"name": "planet"}'
    entries = spark.read.format("tilearchive").option("leavespartition", "3").load(path)
    assert entries.rdd.getNumPartitions() == 5
    rows = entries.orderBy("pos").collect()
    assert [(r.tile_id, r.run_length, r.length) for r in rows] == [(t, n, len(b)) for t, n, b in tiles]
    chunked = entries.withColumn("chunk_id", ix.chunk_of(F.col("offset"), 500))
    chunks = ix.chunks(chunked)
    rel = ix.relative(chunked, chunks)
    back = ix.unpack(ix.pack(rel))
    with open(path, "rb") as f:
        data = f.read()[header.data_offset :]
    objects = spark.createDataFrame([(c.chunk_id, bytearray(data[c.start_byte : c.end_byte])) for c in chunks.collect()], "chunk_id long, data binary")
    asked = spark.createDataFrame([(i,) for i in range(700)], "tile_id long")
    index = back.selectExpr("tile_id AS start_tile_id", "run_length", "chunk_id", "chunk_offset AS offset", "length")
    found = lk.asof_lookup(asked, index).where(lk.contains(F.col("tile_id"), F.col("entry_start_tile_id"), F.col("entry_run_length")))
    found = found.selectExpr("tile_id", "entry_chunk_id AS chunk_id", "entry_offset AS offset", "entry_length AS length")
    got = {r.tile_id: bytes(r.bytes) for r in lk.read_ranges(found, objects).collect()}
    assert got == {t + k: b for t, n, b in tiles for k in range(n)}


def test_tiles_in_the_root_and_nested_directories(spark, tmp_path):
    """The root holds tiles and pointers; one leaf points further down."""
    inner = archive.encode_directory([20, 21], [200, 210], [10, 5], [1, 2])
    leaf = archive.encode_directory([10, 20, 30], [100, 0, 300], [7, len(inner), 9], [3, 0, 1])
    root = archive.encode_directory([1, 2, 10, 40], [0, 5, len(inner), 400], [5, 6, len(leaf), 8], [1, 2, 0, 1])
    path = tmp_path / "b.pmtiles"
    at = archive.HEADER_BYTES
    path.write_bytes(archive.encode_header({"root_offset": at, "root_length": len(root), "leaf_offset": at + len(root), "internal_compression": 1}) + root + inner + leaf)
    archive.register(spark)
    got = spark.read.format("tilearchive").option("leavespartition", "1").load(str(path)).orderBy("pos").collect()
    assert [(r.tile_id, r.offset, r.length, r.run_length) for r in got] == [(1, 0, 5, 1), (2, 5, 6, 2), (10, 100, 7, 3), (20, 200, 10, 1), (21, 210, 5, 2), (30, 300, 9, 1), (40, 400, 8, 1)]
    assert [r.leaf for r in got] == [0, 0, 2, 2, 2, 2, 3]
    circle = archive.encode_directory([1], [0], [0], [0])
    circle = archive.encode_directory([1], [0], [len(circle)], [0])
    path.write_bytes(archive.encode_header({"root_offset": at, "root_length": len(circle), "leaf_offset": at, "internal_compression": 1}) + circle)
    with pytest.raises(Exception, match="nested"):
        spark.read.format("tilearchive").load(str(path)).collect()


def test_chunk_objects_from_an_archive(spark, tmp_path):
    tiles = [(i, 1, bytes([i]) * (1 + i % 7)) for i in range(90)]
    path, folder = str(tmp_path / "a.pmtiles"), str(tmp_path / "objects")
    archive.write_archive(path, tiles, {}, leaf_entries=16)
    archive.register(spark)
    data_offset = spark.read.format("tilearchive").option("part", "header").load(path).first().data_offset
    entries = spark.read.format("tilearchive").load(path).withColumn("chunk_id", ix.chunk_of(F.col("offset"), 50))
    cut = tables.cut_chunks(ix.chunks(entries), path, data_offset)
    for _ in range(2):  # a second run leaves the same objects
        names = {r.name: r.bytes for r in tables.write_objects(cut, folder).collect()}
    stored = {p.name: p.read_bytes() for p in (tmp_path / "objects").iterdir()}
    assert {n: len(b) for n, b in stored.items()} == names
    assert b"".join(stored[f"chunk_{i}.pmtiles"] for i in range(len(stored))) == b"".join(t[2] for t in tiles)


def test_counters_and_hot_tables(spark, tmp_path):
    df, seen = tables.counted(spark.range(10).withColumn("n", F.lit(3)), "progress", total="n")
    df.write.parquet(str(tmp_path / "x"))
    assert seen.get == {"rows": 10, "total": 30}
    with tables.hot(spark.range(5)) as kept:
        assert kept.is_cached and kept.count() == 5
    assert not kept.is_cached


def test_publish_swap_and_retire(spark, tmp_path):
    place = str(tmp_path / "index")
    assert tables.versions(spark, place) == [] and tables.live(spark, place) is None
    for at, key in enumerate(("1", "2")):
        rows = spark.createDataFrame([(5, key), (1, key)], "start_tile_id long, entry string")
        tables.publish(spark, "live_index", tables.write_index(rows, place, key, files=1), now=100.0 + at)
        assert {r.entry for r in tables.query(spark, "SELECT * FROM live_index WHERE start_tile_id <= ?", 5).collect()} == {key}
        assert {r.entry for r in tables.live(spark.newSession(), place).collect()} == {key}  # another reader, which has no view
    assert tables.published(spark, "live_index")
    assert tables.retire(spark, place, "2", now=105.0) == []  # replaced a moment ago
    assert tables.retire(spark, place, "2", now=111.5) == ["deployment=1"]
    tables.write_chunks(spark.createDataFrame([(1, bytearray(b"x"))], "chunk_id long, data binary"), place, "2")
    assert tables.read_objects(spark, place, "2").count() >= 1


def test_an_index_has_no_nulls_and_no_repeated_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "start_tile_id long, entry string")
    assert [tuple(r) for r in tables.repeated_keys(rows).collect()] == [(1, 2)]
    for bad in ((None, "x"), (3, None)):
        with pytest.raises(Exception, match="is null"):
            tables.write_index(rows.union(spark.createDataFrame([bad], rows.schema)), str(tmp_path), "1")


def test_a_catalogue_table_with_its_metadata(spark, tmp_path):
    place = tables.write_index(spark.createDataFrame([(5, "x")], "start_tile_id long, entry string"), str(tmp_path / "index"), "1")
    tables.create_index(spark, "index_table", place, '{"name": "planet"}')
    assert sorted(map(tuple, spark.table("index_table").collect())) == [(-1, '{"name": "planet"}'), (5, "x")]
    tables.create_index(spark, "index_table", str(tmp_path / "empty"))
    assert spark.table("index_table").isEmpty()
    spark.sql("DROP TABLE index_table")


def test_cache_refresh_keeps_one_row_of_a_key(spark):
    cache = spark.createDataFrame([("a", 200, 0), ("b", 200, 0)], "url string, status int, at int")
    new = spark.createDataFrame([("b", 404, 2), ("b", 500, 1), ("c", 200, 5), ("c", 201, 5)], "url string, status int, at int")
    assert sorted(map(tuple, tables.refresh_cache(cache, new, order="at").collect())) == [("a", 200, 0), ("b", 404, 2), ("c", 201, 5)]
    assert sorted(map(tuple, tables.refresh_cache(cache, new).collect())) == [("a", 200, 0), ("b", 500, 1), ("c", 201, 5)]
    assert tables.backoff_ms(2) == 2250
