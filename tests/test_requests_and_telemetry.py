import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tesselle.operators import requests as rq
from tesselle.operators import retention, styles
from tesselle.operators import telemetry as tm
from tesselle.streaming import alerts

MIN = tm.MINUTE


@pytest.mark.parametrize("strict,miss", [(False, 404), (True, 500)])
def test_status_rules_in_order(spark, strict, miss):
    rows = [
        (0, "POST", "tile", 27, 0, 0, True, 203, 405), (1, "get", "tile", 0, 0, 0, True, None, 200), (2, "GET", "tile", 27, 0, 0, True, None, 500), (3, "GET", "tile", 27, 0, 0, True, 203, 203),
        (4, "GET", "tile", 15, 1, 1, True, None, 404), (5, "GET", "tile", 15, 1 << 15, 0, True, None, 500), (6, "GET", "tile", 3, 1, 1, False, None, miss), (7, "GET", "json", None, None, None, None, None, 200),
        (8, "GET", "style", None, None, None, None, None, 200), (9, "GET", None, None, None, None, None, None, 404), (10, "GET", "tile", None, 0, 0, True, None, 500),
    ]
    df = spark.createDataFrame(rows, "i int, m string, t string, z long, x long, y long, f boolean, c int, want int")
    made = rq.status(*(F.col(c) for c in "mtzxyf"), 0, 14, F.col("c"), strict)
    assert [r.want for r in df.orderBy("i").collect()] == [r[0] for r in df.orderBy("i").select(made).collect()]


def test_pending_and_firing(spark):
    rows = [(m * MIN, v) for m, v in ((1, 1.0), (2, 1.0), (3, 0.5), (4, 2.0), (5, 2.0), (6, 2.0), (7, 2.0), (8, 2.0), (9, 2.0), (11, 2.0), (12, None), (13, 2.0))]
    df = spark.createDataFrame(rows, "t_us long, v double")
    got = {r.t_us // MIN: r.state for r in alerts.states(df, alerts.SUSTAINED_ERRORS).collect()}
    assert got == {1: "pending", 2: "pending", 4: "pending", 5: "pending", 6: "pending", 7: "pending", 8: "pending", 9: "firing", 11: "pending", 13: "pending"}
    floor = spark.createDataFrame([(MIN, 0.5), (2 * MIN, 1.5)], "t_us long, v double")
    assert [r.t_us for r in alerts.states(floor, alerts.DOMAIN_RATE).collect()] == [2 * MIN]


def test_stream_states_keep_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "series string, t_us long, v double"
    source = tmp_path / "in"
    for i, rows in enumerate(([("a", 1, 2.0), ("a", 2, 2.0), ("b", 2, 0.1)], [("a", 3, 2.0), ("b", 3, 5.0)], [("a", 5, 2.0), ("b", 4, 5.0)])):
        spark.createDataFrame([(s, t * MIN, v) for s, t, v in rows], schema).coalesce(1).write.parquet(str(source / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    rule = alerts.Rule("r", 1.0, 2 * MIN, 1)
    query = alerts.stream_states(stream, rule).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.series, r.t_us // MIN): r.state for r in spark.table("states").collect()}
    assert got == {("a", 1): "pending", ("a", 2): "pending", ("a", 3): "firing", ("a", 5): "pending", ("b", 3): "pending", ("b", 4): "pending"}


def test_windowed_stream_is_closed_on_the_right(spark, tmp_path):
    rows = [(pd.Timestamp("2024-01-01 00:00:00"), "a", 1.0), (pd.Timestamp("2024-01-01 00:01:00"), "a", 2.0), (pd.Timestamp("2024-01-01 00:01:00.000001"), "a", 4.0), (pd.Timestamp("2024-01-01 01:00:00"), "z", 0.0)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["ts", "k", "value"])).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(str(tmp_path / "in"))
    made = alerts.windowed_counts(stream, "1 minute", "1 minute", ["k"])
    for n in range(2):  # the second run sees the watermark of the first
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = {str(r.t): r.total for r in spark.read.parquet(str(tmp_path / "out")).where("k = 'a'").collect()}
    assert got == {"2024-01-01 00:00:00": 1.0, "2024-01-01 00:01:00": 2.0, "2024-01-01 00:02:00": 4.0}


def test_line_sink(spark, tmp_path):
    spark.createDataFrame([("a b=1i",), (None,)], "line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("line string").parquet(str(tmp_path / "in"))
    query = alerts.write_lines(stream, str(tmp_path / "out"), str(tmp_path / "c"), every="1 second")
    query.processAllAvailable()
    query.stop()
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a b=1i"]


def test_points_go_to_all_providers_and_then_what_was_deferred_runs(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema("line string").parquet(str(tmp_path / "in")), []
    providers = {n: (lambda frame, number, n=n: seen.append((n, sorted(r.line for r in frame.collect())))) for n in ("influx", "header")}
    query = alerts.write_points(stream, providers, str(tmp_path / "c"), [lambda number: seen.append(("deferred", number))], every="1 second")
    query.processAllAvailable()
    query.stop()
    assert seen == [("influx", ["a", "b"]), ("header", ["a", "b"]), ("deferred", 0)]


def test_a_point_put_together(spark):
    point = tm.Point(F.lit("d1_query")).tag("query", F.lit("a b")).tag("query", F.lit("SELECT 1")).with_tags(F.create_map(F.lit("colo"), F.lit("AMS")))
    made = point.duration("duration", F.col("d")).number("rows", F.lit(3)).number("none", F.lit(None))
    row = spark.createDataFrame([(12.9,)], "d double").select(made.line().alias("line"), point.line().alias("bare")).first()
    assert row.line == "d1_query,colo=AMS,query=SELECT\\ 1 duration=12i,rows=3i" and row.bare is None


def test_lines_are_posted(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.headers["Authorization"], self.rfile.read(int(self.headers["Content-Length"])).decode().split("\n")))
            self.send_response(204 if self.path == "/write" else 500)
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    lines = spark.createDataFrame([("a x=1i",), (None,), ("b x=2i",)], "line string").coalesce(1)
    place = f"http://127.0.0.1:{server.server_port}"
    alerts.post_lines(f"{place}/write", {"Authorization": "Token t"})(lines, 0)
    assert got == [("Token t", ["a x=1i", "b x=2i"])]
    with pytest.raises(PySparkException):
        alerts.post_lines(f"{place}/broken")(lines, 0)
    server.shutdown()


def test_rollup_windows_and_last(spark):
    rows = [(0, 1, "a", 1.0), (MIN, 2, "a", 2.0), (MIN, 3, "a", 3.0), (MIN + 1, 4, "a", 4.0), (3 * MIN, 5, "b", 5.0)]
    df = spark.createDataFrame(rows, "t_us long, event_id long, s string, value double")
    got = {(r.t_us // MIN, r.s): r.v for r in tm.rollup(df, "last", 2 * MIN, MIN, ["s"]).collect()}
    assert got == {(0, "a"): 1.0, (1, "a"): 3.0, (2, "a"): 4.0, (3, "a"): 4.0, (3, "b"): 5.0, (4, "b"): 5.0}
    sums = {(r.t_us // MIN, r.s): r.v for r in tm.rollup(df, "sum", MIN, MIN, ["s"]).collect()}
    assert sums == {(0, "a"): 1.0, (1, "a"): 5.0, (2, "a"): 4.0, (3, "b"): 5.0}
    with pytest.raises(ValueError):
        tm.rollup(df, "sum", MIN + 1, MIN, ["s"])


def test_histogram_quantile_is_near_the_exact_one(spark):
    df = spark.range(1, 20_001).select(F.lit(5).alias("t_us"), (F.col("id") / 100.0).alias("value"))
    got = tm.histogram_quantile(tm.histogram(df, 10, 10), 0.95).first()
    assert abs(got.v / 190.0 - 1) < 0.05
    zero = spark.createDataFrame([(1, 0.0), (1, -1.0)], "t_us long, value double")
    assert tm.histogram_quantile(tm.histogram(zero, 10, 10), 0.5).first().v <= 1e-9


def test_points(spark):
    df = spark.createDataFrame([(12.7, True, "NotFound"), (None, False, None), (3.0, True, "Other")], "d double, f boolean, c string")
    fields = tm.monitored(F.col("d"), F.col("f"), F.col("c"), ["NotFound"])
    lines = df.select(tm.line_protocol(F.lit("a b"), F.create_map(F.lit("k"), F.lit("x,y")), fields)).collect()
    assert [r[0] for r in lines] == [r"a\ b,k=x\,y duration=12i,invocation=1i", r"a\ b,k=x\,y invocation=1i", r"a\ b,k=x\,y duration=3i,errors=1i,invocation=1i"]
    empty = F.create_map().cast("map<string, struct<value double, type string>>")
    assert df.select(tm.line_protocol(F.lit("m"), F.create_map(F.lit("k"), F.lit("")), empty)).first()[0] is None
    assert df.select(tm.timing(F.lit("q"), F.lit("sql_duration"), F.lit("5"))).first()[0] == "q_sql;dur=5"


def test_matchers_are_anchored(spark):
    df = spark.createDataFrame([("AMS",), ("XAMS",), ("AMSX",)], "colo string")
    assert tm.matching(df, {"colo": "~AM."}).count() == 1 and tm.matching(df, {"colo": ["XAMS", "AMSX"]}).count() == 2


def test_themes(spark):
    flavours = spark.createDataFrame([(f, k, f"{f}-{k}") for f in ("light", "dark", "black") for k in ("background", "earth", "water", "roads")], "flavour string, key string, value string")
    got = {r.theme: r.colours for r in styles.themes(spark, flavours).collect()}
    assert got["light"]["water"].startswith("rgba") and got["light"]["iconStyle"] == "light"
    assert got["dark"]["earth"] == "black-earth" and got["dark"]["roads"] == "dark-roads" and got["dark"]["landcover.forest"] == "#1B211B"
    assert got["black"]["iconStyle"] == "dark" and got["black"]["water"] == "black-water"


def test_style_files(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("dark", {"iconStyle": "dark"})], "theme string, colours map<string,string>")
    layers = spark.createDataFrame([("dark", '[{"id": "water"}]')], "theme string, layers string")
    made = styles.documents(rows, layers, "World Map", "https://static.example.com", "https://tiles.example.com/v1.json")
    text = made.first().style
    doc = json.loads(text)
    assert doc["version"] == 8 and doc["id"] == "world-map-dark" and doc["layers"] == [{"id": "water"}] and doc["sources"]["vector"]["type"] == "vector"
    assert text.startswith('{\n  "version"')
    styles.write(made, str(tmp_path / "styles"))
    assert [p.name for p in tmp_path.glob("styles/theme=*")] == ["theme=dark"]


def test_retention(spark):
    names = spark.createDataFrame([("a-20250818",), ("b-2024",), (None,)], "name string")
    assert [r.name for r in retention.not_live(names, "20250818").collect()] == ["b-2024"]
    regions = spark.createDataFrame([("eu",), ("us",)], "region string")
    objects = spark.createDataFrame([("/20250818/x",), ("/2024/x",)], "path string")
    assert retention.outside_prefix(objects, "20250818", regions).count() == 2
    assert retention.outside_prefix(objects, "20250818", regions, branch="dev").isEmpty()
    with pytest.raises(PySparkException):
        retention.required(spark.createDataFrame([('{"a": ""}',)], "j string"), "j", "$.a", "a").collect()


def test_session_settings_are_applied():
    from tesselle import session

    assert session.SETTINGS["spark.sql.mapKeyDedupPolicy"] == "LAST_WIN"
