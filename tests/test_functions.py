import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselle.functions import curve, maps, radix64, urls

#: (z, x, y, id) computed by an independent integer walk.
IDS = [
    (0, 0, 0, 0), (1, 0, 0, 1), (1, 0, 1, 2), (1, 1, 1, 3), (1, 1, 0, 4), (2, 0, 0, 5), (2, 1, 2, 12), (2, 3, 0, 20), (3, 5, 2, 76),
    (14, 8191, 5461, 129743803), (14, 16383, 0, 357913940), (26, 0, 0, 1501199875790165), (26, 0, 67108863, 3002399751580330),
    (26, 67108863, 67108863, 4503599627370495), (26, 67108863, 0, 6004799503160660),
]

TEXTS = [(0, ""), (1, "1"), (-1, "-1"), (63, "."), (64, "10"), (100, "1a"), (4096, "100"), (663668044, "dZiLC"), (1769420107, "1fTpLB"), (-1105752063, "-11w6.."), (2**53 - 1, "V........")]


def test_curve_vectors_and_inverse(spark):
    df = spark.createDataFrame(IDS, "z long, x long, y long, id long")
    got = df.select("*", curve.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("got"), curve.tile_zxy(F.col("id")).alias("p")).collect()
    for r in got:
        assert r.got == r.id and tuple(r.p) == (r.z, r.x, r.y)


def walked(z, x, y):
    """The id by a walk over the bits, from the highest."""
    if z is None or x is None or y is None or not (0 <= z <= 26 and 0 <= x < 1 << z and 0 <= y < 1 << z):
        return None
    d = 0
    for bit in range(z - 1, -1, -1):
        side = 1 << bit
        rx, ry = int(x & side > 0), int(y & side > 0)
        d += side * side * ((3 * rx) ^ ry)
        x, y = x & (side - 1), y & (side - 1)
        if ry == 0:
            if rx == 1:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return (4**z - 1) // 3 + d


def test_both_ways_to_an_id_agree(spark):
    import random

    r = random.Random(4)
    tiles = [(z, r.randrange(1 << z), r.randrange(1 << z)) for z in range(27) for _ in range(60)] + [(27, 0, 0), (3, 8, 0), (3, -1, 0), (None, 0, 0), (2, None, 1), (-1, 0, 0)]
    tiles += [i[:3] for i in IDS]
    df = spark.createDataFrame([(*t, walked(*t)) for t in tiles], "z long, x long, y long, slow long")
    made = curve.with_tile_id(df)
    assert made.columns == ["z", "x", "y", "slow", "tile_id"]
    assert made.where("NOT (slow <=> tile_id)").isEmpty()


def test_a_filter_on_an_id_is_planned_at_once(spark):
    import time

    made = curve.with_tile_id(spark.range(100).selectExpr("7L AS z", "id AS x", "id AS y"))
    start = time.time()
    plan = made.where("tile_id > 100 AND tile_id % 3 = 1").select("tile_id")._jdf.queryExecution().executedPlan().toString()
    assert time.time() - start < 5 and "tile_id" in plan
    assert made.where("tile_id BETWEEN 5461 AND 21844").count() == 100


def test_curve_is_a_bijection_of_low_zooms(spark):
    tiles = [(z, x, y) for z in range(6) for x in range(1 << z) for y in range(1 << z)]
    got = spark.createDataFrame(tiles, "z long, x long, y long").select(curve.tile_id(F.col("z"), F.col("x"), F.col("y")).alias("t")).collect()
    assert sorted(r.t for r in got) == list(range((4**6 - 1) // 3))


@pytest.mark.parametrize("z,x,y", [(27, 0, 0), (0, 0, 1), (-1, 0, 0), (3, 8, 0), (3, 0, -1), (None, 0, 0)])
def test_out_of_bounds_is_null(spark, z, x, y):
    row = spark.createDataFrame([(z, x, y)], "z long, x long, y long").select(curve.tile_id(F.col("z"), F.col("x"), F.col("y"))).first()
    assert row[0] is None


def test_radix64_vectors(spark):
    df = spark.createDataFrame(TEXTS, "n long, s string")
    for r in df.select("*", radix64.encode(F.col("n")).alias("e"), radix64.decode(F.col("s")).alias("d")).collect():
        assert (r.e, r.d) == (r.s, r.n)
    assert spark.createDataFrame([("a b",), (None,)], "s string").select(radix64.decode(F.col("s"))).collect() == [(None,), (None,)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-(2**60), 2**60), min_size=1, max_size=50))
def test_radix64_round_trip(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert df.where(radix64.decode(radix64.encode(F.col("n"))) != F.col("n")).isEmpty()


URLS = [
    ("/v1", "json", "1", None, None), ("/v2", "json", "2", None, None), ("/v1.json", "json", "1", None, None), ("/v2.json", "json", "2", None, None),
    ("/v1/style/dark", "style", "1", "dark", None), ("/v2/style/light", "style", "2", "light", None), ("/v2/style/dark.json", "style", "2", "dark", None), ("/v1/style/light.json", "style", "1", "light", None),
    ("/v1/0/0/0.mvt", "tile", "1", None, ("0", "0", "0")), ("/v2/1/2/3.mvt", "tile", "2", None, ("1", "2", "3")),
    ("/v1.jason", None, None, None, None), ("/v2/1/2/3", None, None, None, None), ("/v2/1/2/3.mvt/extra", None, None, None, None), ("/v1/1/2.mvt", None, None, None, None),
    ("/v1/0/0/0Xmvt", "tile", "1", None, ("0", "0", "0")), ("/v1/1/2/3.mvt?a=1", "tile", "1", None, ("1", "2", "3")), ("/v1/99999999999999999999/0/0.mvt", "tile", "1", None, ("99999999999999999999", "0", "0")),
    ("/v1\n", None, None, None, None), ("", None, None, None, None),
]


@pytest.mark.parametrize("host", ["", "http://example.com"])
def test_request_paths(spark, host):
    df = spark.createDataFrame([(i, host + u) for i, (u, *_) in enumerate(URLS) if not (host and "\n" in u)], "i int, u string")
    for r in df.select("i", urls.parse_request(F.col("u")).alias("r")).collect():
        _, kind, version, style, zxy = URLS[r.i]
        assert (r.r.request_type, r.r.version, r.r.style) == (kind, version, style)
        assert (r.r.z, r.r.x, r.r.y) == (zxy or (None, None, None))


def test_strict_dot(spark):
    df = spark.createDataFrame([("/v1/0/0/0Xmvt",)], "u string")
    assert df.select(urls.parse_request(F.col("u"), strict_dot=True)["request_type"]).first()[0] is None


def test_origins(spark):
    cases = [("https://a.b.example.com/x", "https:", "example.com"), ("http://example.co.uk", "http:", "example.co.uk"), ("http://x.y.co.uk:80", "http:", "y.co.uk"), ("http://shop.example.com.tr", "http:", "example.com.tr"), ("http://a.example.gob.mx", "http:", "example.gob.mx"), ("http://a.co.example", "http:", "co.example"), ("http://localhost", "http:", "localhost"), ("http://10.0.0.1", "http:", "10.0.0.1"), (None, "http:", "missing.url")]
    df = spark.createDataFrame([(c[0],) for c in cases], "o string")
    got = df.select(urls.protocol(F.col("o")), urls.apex_domain(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_maps_merge_to_the_right(spark):
    row = spark.range(1).select(maps.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)), F.create_map(F.lit("c"), F.lit(4))).alias("m")).first()
    assert row.m == {"a": 1, "b": 3, "c": 4}
