import random
from bisect import bisect_right

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesselle.operators import index as ix
from tesselle.operators import lookup as lk
from tesselle.plans import lookup_queries


def entry_rows(n=400, seed=0):
    r = random.Random(seed)
    rows, tile, offset = [], 0, 0
    for pos in range(n):
        tile += r.randint(1, 6)
        length = r.randint(1, 20_000)
        rows.append((pos, pos // 70, tile, r.randint(1, 1), length, offset))
        tile += rows[-1][3] - 1
        offset += length
    return rows


@pytest.fixture
def entries(spark):
    df = spark.createDataFrame(entry_rows(), "pos long, leaf long, tile_id long, run_length long, length long, offset long")
    return df.withColumn("chunk_id", ix.chunk_of(F.col("offset")))


def test_prefix_sum_in_small_blocks(spark):
    rows = [(i * 3, i % 7) for i in range(500)]
    got = ix.prefix_sum(spark.createDataFrame(rows, "k long, v long"), "v", "k", "before", levels=3, block=4).collect()
    total, want = 0, {}
    for k, v in rows:
        want[k], total = total, total + v
    assert {r.k: r.before for r in got} == want


def test_offset_fill_vector(spark):
    df = spark.createDataFrame([(0, i, c, n) for i, (c, n) in enumerate(zip((1, 0, 0, 11, 0), (10, 5, 7, 4, 3)))], "d long, i int, v long, length long")
    assert [r.offset for r in ix.fill_offsets(df, "v", "length", "d", "i", "offset").orderBy("i").collect()] == [0, 10, 15, 10, 14]
    with pytest.raises(PySparkException):
        ix.fill_offsets(df.where("i > 0"), "v", "length", "d", "i", "offset").collect()


def test_packing_vector(spark):
    rows = [(0, 0, 100, 500, 20, 1, 7), (1, 0, 101, 520, 30, 3, 7), (2, 0, 110, 100, 40, 1, 2)]
    df = spark.createDataFrame(rows, "pos long, leaf long, tile_id long, chunk_offset long, length long, run_length long, chunk_id long")
    packed = ix.pack(df)
    assert packed.first().entry == "1a|7q:||K|1|7:1|K|U|3|7:A|-6G|e|1|2:"
    back = ix.unpack(packed).orderBy("i").select("tile_id", "chunk_offset", "length", "run_length", "chunk_id").collect()
    assert [tuple(r) for r in back] == [r[2:] for r in rows]


def test_packing_round_trip_and_row_sizes(entries):
    rel = ix.relative(entries, ix.chunks(entries))
    packed = ix.pack(rel)
    assert {r.n_entries for r in packed.collect()} <= {50, 20} and packed.agg(F.sum("n_entries")).first()[0] == 400
    cols = ["tile_id", "chunk_offset", "length", "run_length", "chunk_id"]
    assert sorted(ix.unpack(packed).select(cols).collect()) == sorted(rel.select(cols).collect())


def test_chunks_cover_their_entries(entries):
    got = {r.chunk_id: r for r in ix.chunks(entries).collect()}
    for r in entries.collect():
        assert got[r.chunk_id].start_byte <= r.offset and r.offset + r.length <= got[r.chunk_id].end_byte
    assert ix.disordered(entries).isEmpty() and ix.overlapping(entries).isEmpty()


def test_entries_that_fall_back_are_skipped(entries):
    odd = entries.withColumn("chunk_id", F.when(F.col("pos") == 300, F.lit(0)).otherwise(F.col("chunk_id")))
    kept = ix.in_order(odd, block=16)
    assert kept.where("pos = 300").isEmpty() and kept.count() == 399
    assert ix.boundaries(entries, block=16).count() == ix.chunks(entries).count()


@pytest.mark.parametrize("cuts", [None, [], [1000, 4096 * 5, 4096 * 5 + 1, 4096 * 5 + 2, 30_000], [90_000]])
def test_overlaps_across_blocks_and_far_apart(spark, cuts):
    rows = [(i, i * 5, 1 + i % 4) for i in range(9000)]
    rows[4095] = (4095, 4095 * 5, 6)  # into the first entry behind position 4095
    rows[3999] = (3999, 3999 * 5, 1001)  # into the next one and many more
    rows += [(20_000, 35, 1), (30_000, 57, 1), (40_000, 5001, 9)]  # a repeated id, one inside a run, one that reaches on
    r = random.Random(2)
    r.shuffle(rows)
    order = sorted((t, p, n) for p, t, n in rows)
    want = sorted(p for (t, p, n), (after, *_) in zip(order, order[1:]) if after < t + n)
    got = ix.overlapping(spark.createDataFrame(rows, "pos long, tile_id long, run_length long"), **({} if cuts is None else {"cuts": cuts}))
    assert got.columns == ["pos", "tile_id", "run_length"]
    assert sorted(x.pos for x in got.collect()) == want and {7, 11, 3999, 4095, 40_000} <= set(want)


def brute(keys, index):
    starts = [s for s, _ in index]
    return [index[bisect_right(starts, k) - 1] if k is not None and starts and k >= starts[0] else None for k in keys]


@pytest.mark.parametrize("cuts", [None, [], [10, 500, 501, 2000, 90_000]])
def test_asof_against_bisection(spark, cuts):
    r = random.Random(1)
    index = sorted({r.randint(5, 5000): None for _ in range(300)})
    index = [(s, r.randint(0, 9)) for s in index]
    keys = [r.randint(0, 6000) for _ in range(700)] + [None, 0, 5000, 100_000] + [77] * 400
    probes = spark.createDataFrame(list(enumerate(keys)), "i int, tile_id long")
    df = spark.createDataFrame(index, "start_tile_id long, run_length int")
    got = {x.i: x for x in lk.asof_lookup(probes, df, cuts=cuts).collect()}
    assert len(got) == len(keys)
    for i, want in enumerate(brute(keys, index)):
        assert (got[i].entry_start_tile_id, got[i].entry_run_length) == (want or (None, None))


@pytest.mark.parametrize("small", [0, 10_000])
def test_asof_small_and_large_indexes(spark, small):
    r = random.Random(2)
    index = [(s, r.randint(0, 9)) for s in sorted({r.randint(5, 5000) for _ in range(300)})]
    keys = [r.randint(0, 6000) for _ in range(500)] + [None, 4, 5, 100_000] + [77] * 200
    probes, df = spark.createDataFrame(list(enumerate(keys)), "i int, tile_id long"), spark.createDataFrame(index, "start_tile_id long, run_length int")
    got = {x.i: x for x in lk.asof_lookup(probes, df, small=small).collect()}
    assert len(got) == len(keys)
    for i, want in enumerate(brute(keys, index)):
        assert (got[i].entry_start_tile_id, got[i].entry_run_length) == (want or (None, None))


def test_binary_search_in_an_array(spark):
    import numpy as np

    starts = np.array([-5, 0, 3, 9, 2**40], np.int64)
    rows = spark.createDataFrame([(k,) for k in (-6, -5, 0, 2, 3, 9, 10, 2**41, None)], "k long").select("k", lk.at_or_before(F.col("k"), starts).alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 2, 2, 3, 4, 4, 5, 0]
    assert spark.range(1).select(lk.at_or_before(F.col("id"), starts[:0])).first()[0] == 0


def test_ranges_of_a_blob_are_cut_once(spark):
    located = spark.createDataFrame([(i, i % 2, i % 5, 3) for i in range(40)] + [(90, 7, 0, 1), (91, None, 0, 1)], "i long, chunk_id long, offset long, length long")
    blobs = spark.createDataFrame([(0, bytearray(b"abcdefgh")), (1, bytearray(range(8))), (2, bytearray(b"unused"))], "chunk_id long, data binary")
    data = {0: b"abcdefgh", 1: bytes(range(8))}
    got = {r.i: r.bytes and bytes(r.bytes) for r in lk.read_ranges(located, blobs).collect()}
    assert got == {i: data[i % 2][i % 5 : i % 5 + 3] for i in range(40)} | {90: None, 91: None}


def test_running_values_by_recursion(spark):
    rows = [(i * 3, (i * 7919) % 50) for i in range(600)]
    df = spark.createDataFrame(rows, "pos long, chunk_id long")
    got = {r.pos: r.prev_max for r in ix.running(df, F.col("chunk_id"), "pos", "prev_max", levels=3, block=8).collect()}
    best, want = None, {}
    for pos, chunk in rows:
        want[pos], best = best, chunk if best is None else max(best, chunk)
    assert got == want
    changes = [r.pos for r in ix.boundaries(df.withColumn("chunk_id", F.expr("pos div 50")), block=8).orderBy("pos").collect()]
    assert changes == [p for p, q in zip([x[0] for x in rows], [None] + [x[0] for x in rows]) if q is None or p // 50 != q // 50]


def test_asof_splitters_and_empty_sides(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("start_tile_id"), F.lit(1).alias("run_length"))
    cuts = lk.splitters(df, "start_tile_id", rows=100)
    assert 5 <= len(cuts) <= 10 and cuts == sorted(cuts)
    probes = spark.createDataFrame([(1,), (None,)], "tile_id long")
    assert {r.entry_start_tile_id for r in lk.asof_lookup(probes, df.limit(0)).collect()} == {None}
    assert lk.asof_lookup(probes.limit(0), df).collect() == []


def test_no_nested_loop_in_the_plan(spark):
    probes, df = spark.range(10).withColumnRenamed("id", "tile_id"), spark.range(10).select(F.col("id").alias("start_tile_id"), F.lit(1).alias("run_length"))
    plan = lk.asof_lookup(probes, df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_locate_statuses(spark):
    index = spark.createDataFrame([(0, 1, 10), (5, 3, 20), (100, 0, 30)], "start_tile_id long, run_length long, length long")
    requests = spark.createDataFrame([(0, 0, 0, 0), (1, 2, 0, 0), (2, 2, 1, 0), (3, 2, 1, 1), (4, 2, 0, 1), (5, 27, 0, 0), (6, 1, 2, 0), (7, 3, 0, 0)], "i int, z long, x long, y long")
    got = {r.i: r for r in lk.locate(requests, index, 0, 2).collect()}
    assert [got[i].status for i in range(8)] == [200, 200, 200, 200, 404, 500, 500, 404]
    assert got[2].entry_start_tile_id == 5 and got[4].entry_start_tile_id is None
    contained = spark.createDataFrame([(100, 0), (101, 0), (102, 3), (103, 3)], "k long, r long").select(lk.contains(F.col("k"), F.lit(100), F.col("r"))).collect()
    assert [r[0] for r in contained] == [True, False, True, False]


def test_metadata_row_and_point_lookup(spark):
    rows = spark.createDataFrame([(5, "a"), (9, "b")], "start_tile_id long, entry string")
    both = ix.with_metadata(rows, "{}")
    assert ix.metadata_row(both).collect() == [(-1, "{}")]
    assert lk.point_lookup(rows, 8).first().entry == "a" and lk.point_lookup(rows, 4).isEmpty()


def test_every_entry_has_its_object_and_byte_range(spark, tmp_path):
    r = random.Random(4)
    orders = [(k, float(r.randint(1, 400_000)) + 0.5) for k in sorted(r.sample(range(1, 12_000), 300))]
    spark.createDataFrame(orders, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    offset, starts, want = 0, {}, []
    for k, price in orders:
        chunk, length = offset // ix.CHUNK_BYTES, int(price)
        first = offset - starts.setdefault(chunk, offset)
        want.append((k * 5, f"chunk_{chunk}.pmtiles", first, first + length - 1))
        offset += length
    assert sorted(map(tuple, lookup_queries.object_ranges(spark, str(tmp_path)).collect())) == want
