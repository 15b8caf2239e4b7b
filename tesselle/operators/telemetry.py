"""Metrics: building points, writing them out, and rolling up series.

A rollup at time t covers samples in (t - window, t], for t at whole multiples of the step. It
goes in panes of one step: each series is summed up per pane first, and only panes are repeated
for the windows that hold them, not samples. Series are told apart by the metric's labels; a
window without samples has no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maps import merged

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

#: Ours: histogram buckets for each power of ten, and the upper end of the lowest one.
BUCKETS_PER_DECADE = 18
LOWEST = 1e-9


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (UTC then)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def pane_end(t: Column, step: int) -> Column:
    """The first multiple of the step at or after t."""
    return F.call_function("div", t + (step - 1), F.lit(step)) * step


# --- points

def merged_tags(operation: Column, defaults: Column) -> Column:
    """Tags of an operation under the request's default ones, which win where both have a key."""
    return merged(operation, defaults)


def default_tags(continent: Column, colo: Column, as_org: Column, apex_domain: Column, protocol: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.create_map(F.lit("continent"), blank(continent), F.lit("colo"), blank(colo), F.lit("asOrg"), blank(as_org), F.lit("apexDomain"), apex_domain, F.lit("protocol"), protocol)


def metric_name(prefix: Column, name: Column) -> Column:
    return F.concat_ws("_", prefix, name)


#: The operations that are watched, whose points are named with the service's prefix.
OPERATIONS = (
    "handle_request",
    "match_request_from_cdn",
    "pmtiles_init",
    "tile_request",
    "json_request",
    "style_request",
    "d1_lookup",
    "find_tile_leaf_directory",
    "get_tile",
)


#: Names that carry no prefix.
UNPREFIXED = ("d1_query", "tigris_storage_get", "tiles_cdn_hit", "error")


@dataclass(frozen=True)
class Point:
    """A point as it is put together: each step gives a new one; a later value of a tag or field counts."""

    name: Column
    tag_pairs: tuple[tuple[str, Column], ...] = ()
    more_tags: tuple[Column, ...] = ()
    field_pairs: tuple[tuple[str, Column], ...] = ()

    def tag(self, key: str, value: Column) -> Point:
        return replace(self, tag_pairs=(*self.tag_pairs, (key, value.cast("string"))))

    def with_tags(self, tags: Column) -> Point:
        """Tags of a map, over those that are named one by one."""
        return replace(self, more_tags=(*self.more_tags, tags))

    def duration(self, key: str, milliseconds: Column) -> Point:
        return replace(self, field_pairs=(*self.field_pairs, (key, field(milliseconds, "duration"))))

    def number(self, key: str, value: Column) -> Point:
        return replace(self, field_pairs=(*self.field_pairs, (key, field(value, "int"))))

    def tags(self) -> Column:
        named = {k: v for k, v in self.tag_pairs}
        own = F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v))) if named else F.create_map().cast("map<string,string>")
        return merged(own, *self.more_tags) if self.more_tags else own

    def fields(self) -> Column:
        found = F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in dict(self.field_pairs).items()))
        if not self.field_pairs:
            return F.create_map().cast("map<string, struct<value: double, type: string>>")
        return F.map_from_entries(F.filter(found, lambda e: e["v"]["value"].isNotNull()))

    def line(self) -> Column:
        return line_protocol(self.name, self.tags(), self.fields())


def elapsed(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps."""
    return (F.unix_micros(end) - F.unix_micros(start)) / 1000.0


def fan_out(points: DataFrame, providers: dict[str, Column]) -> DataFrame:
    """Each point for each provider: ``provider`` and what that makes of it, ``item``; nothing where that is null."""
    made = F.filter(F.array(*(F.struct(F.lit(n).alias("provider"), c.alias("item")) for n, c in providers.items())), lambda x: x["item"].isNotNull())
    return points.withColumn("_p", F.explode(made)).select("*", "_p.provider", "_p.item").drop("_p")


def field(value: Column, kind: str) -> Column:
    return F.struct(value.cast("double").alias("value"), F.lit(kind).alias("type"))


def monitored(duration: Column, failed: Column, error_class: Column | None = None, accepted: Sequence[str] = (), invocations: bool = True) -> Column:
    """Fields of a watched call: invocation, errors if it failed with a class not accepted, duration."""
    pairs = [F.struct(F.lit("duration").alias("k"), F.when(duration.isNotNull(), field(duration, "duration")).alias("v"))]
    if invocations:
        pairs.insert(0, F.struct(F.lit("invocation").alias("k"), field(F.lit(1), "int").alias("v")))
    counted = F.coalesce(failed, F.lit(False))
    if accepted and error_class is not None:
        counted = counted & ~F.coalesce(error_class.isin(*accepted), F.lit(False))
    pairs.append(F.struct(F.lit("errors").alias("k"), F.when(counted, field(F.lit(1), "int")).alias("v")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull()))


def cdn_hit(deployment_key: Column, request_type: Column, z: Column, style: Column) -> tuple[Column, Column]:
    """(tags, fields) of a response that the cache gave: a tile's zoom or a style's name goes along."""
    tags = F.create_map(F.lit("deployment_key"), deployment_key, F.lit("request_type"), F.coalesce(request_type, F.lit("unknown")), F.lit("z"), F.when(request_type == "tile", z), F.lit("style"), F.when(request_type == "style", style))
    return F.map_filter(tags, lambda k, v: v.isNotNull()), F.create_map(F.lit("count"), field(F.lit(1), "int"))


def query_point(sql: Column, region: Column, primary: Column, duration: Column, rows_read: Column, sql_duration: Column) -> tuple[Column, Column]:
    """(tags, fields) of an index query; an unknown region or replica is the empty text."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    tags = F.create_map(F.lit("query"), sql, F.lit("served_by_region"), blank(region), F.lit("served_by_primary"), blank(primary))
    fields = {"duration": field(duration, "duration"), "rows_read": field(rows_read, "int"), "sql_duration": field(sql_duration, "duration"), "count": field(F.lit(1), "int")}
    return tags, F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items())), lambda e: e["v"]["value"].isNotNull()))


def error_point(message: Column) -> tuple[Column, Column]:
    """(tags, fields) of a failure: no field, so that it is kept as a row but not sent as a line."""
    return F.create_map(F.lit("error"), F.coalesce(message, F.lit("unknown"))), F.create_map().cast("map<string, struct<value: double, type: string>>")


def escaped(text: Column, characters: str) -> Column:
    """Text with a backslash before each of the characters."""
    return F.regexp_replace(text, "([" + "".join("\\" + c for c in characters) + "])", r"\\$1")


def line_protocol(name: Column, tags: Column, fields: Column, ts_ns: Column | None = None) -> Column:
    """A point as a line: name,tags fields; keys in order, empty tags left out, numbers cut to whole ones.

    Null for a point without fields, which is not sent.
    """
    tag = F.transform(F.array_sort(F.map_entries(F.map_filter(tags, lambda k, v: v.isNotNull() & (v != "")))), lambda e: F.concat(escaped(e["key"], ",= "), F.lit("="), escaped(e["value"], ",= ")))
    values = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(escaped(k, ",= "), F.lit("="), F.floor(F.element_at(fields, k)["value"]).cast("string"), F.lit("i")))
    line = F.concat(F.concat_ws(",", F.concat(escaped(name, ", ")), tag), F.lit(" "), F.array_join(values, ","))
    if ts_ns is not None:
        line = F.concat_ws(" ", line, ts_ns.cast("string"))
    return F.when(F.size(fields) > 0, line)


def timing(name: Column, label: Column, value: Column) -> Column:
    """One item of a Server-Timing header, for a duration."""
    suffix = F.when(label == "duration", "").otherwise(F.concat(F.lit("_"), F.regexp_replace(label, "^(.*?)_duration", "$1")))
    return F.concat(name, suffix, F.lit(";dur="), value)


def server_timing(points: DataFrame, by: str, order: str, item: str = "item", out: str = "server_timing") -> DataFrame:
    """The items of each request, in order, as a header."""
    rows = points.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, item))).alias("_x"))
    return rows.select(by, F.array_join(F.col("_x")[item], ", ").alias(out))


# --- rollups

def matching(samples: DataFrame, labels: dict[str, str | Sequence[str]]) -> DataFrame:
    """Samples whose labels match: a text exactly, ``~pattern`` as a whole, a list any of its items."""
    for name, want in labels.items():
        c = F.col(name)
        if isinstance(want, str) and want.startswith("~"):
            samples = samples.where(c.rlike(rf"^(?:{want[1:]})\z"))
        elif isinstance(want, str):
            samples = samples.where(c == want)
        else:
            samples = samples.where(c.isin(*want))
    return samples


def _windows(pane: Column, window: int, step: int) -> Column:
    return F.explode(F.sequence(pane, pane + (window - step), F.lit(step)))


def rollup(samples: DataFrame, function: str, window: int, step: int, series: Sequence[str], t: str = "t_us", value: str = "value", order: str = "event_id") -> DataFrame:
    """t_us, the series' labels, v: sum, count or last of each series' samples in each window.

    ``last`` takes the latest sample, of equal times the one with the largest ``order``.
    """
    if window % step:
        raise ValueError("a window is a whole number of steps")
    pane = samples.withColumn("_pane", pane_end(F.col(t), step)).groupBy("_pane", *series)
    if function == "sum":
        panes, merge = pane.agg(F.sum(value).alias("_v")), F.sum("_v")
    elif function == "count":
        panes, merge = pane.agg(F.count(value).alias("_v")), F.sum("_v")
    elif function == "last":
        panes, merge = pane.agg(F.max(F.struct(F.col(t).alias("t"), F.col(order).alias("o"), F.col(value).alias("v"))).alias("_v")), F.max("_v")["v"]
    else:
        raise ValueError(function)
    if window > step:
        panes = panes.select(_windows(F.col("_pane"), window, step).alias("t_us"), *series, "_v")
        return panes.groupBy("t_us", *series).agg(merge.alias("v"))
    return panes.select(F.col("_pane").alias("t_us"), *series, (F.col("_v.v") if function == "last" else F.col("_v")).alias("v"))


def aggregate(rolled: DataFrame, how: str, by: Sequence[str] = (), q: float | None = None, v: str = "v") -> DataFrame:
    """sum, avg or quantile over series, by time and labels. Quantiles are exact, between ranks linear."""
    made = {"sum": F.sum(v), "avg": F.avg(v)}[how] if how != "quantile" else F.percentile(v, q)
    return rolled.groupBy("t_us", *by).agg(made.alias("v"))


def bucket_of(value: Column) -> Column:
    """Number of a value's histogram bucket; its upper end is 10^(number / 18). Null for negative values."""
    lowest = round(-9 * BUCKETS_PER_DECADE)
    return F.when(value < 0, None).when(value <= LOWEST, F.lit(lowest)).otherwise(F.greatest(F.ceil(F.log10(value) * BUCKETS_PER_DECADE), F.lit(lowest + 1))).cast("int")


def histogram(samples: DataFrame, window: int, step: int, t: str = "t_us", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """t_us, labels, bucket, n: how many samples of each window fall into each bucket."""
    panes = samples.withColumns({"_pane": pane_end(F.col(t), step), "bucket": bucket_of(F.col(value))}).where("bucket IS NOT NULL")
    panes = panes.groupBy("_pane", "bucket", *by).agg(F.count(F.lit(1)).alias("n"))
    spread = panes.select(_windows(F.col("_pane"), window, step).alias("t_us"), "bucket", *by, "n")
    return spread.groupBy("t_us", "bucket", *by).agg(F.sum("n").alias("n"))


def histogram_quantile(counts: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """t_us, labels, v: the quantile of bucket counts, linear within its bucket."""
    whole = Window.partitionBy("t_us", *by)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumns({"cum": F.sum("n").over(upto), "total": F.sum("n").over(whole)})
    low, high = F.pow(F.lit(10.0), (F.col("bucket") - 1) / BUCKETS_PER_DECADE), F.pow(F.lit(10.0), F.col("bucket") / BUCKETS_PER_DECADE)
    low = F.when(F.col("bucket") <= -9 * BUCKETS_PER_DECADE, 0.0).otherwise(low)
    rank = F.col("total") * F.lit(float(q))
    value = low + (high - low) * (rank - (F.col("cum") - F.col("n"))) / F.col("n")
    hit = cum.where((F.col("cum") >= rank) & (F.col("cum") - F.col("n") < rank))
    return hit.select("t_us", *by, value.alias("v"))


def last_not_null(rolled: DataFrame, v: str = "v") -> DataFrame:
    """The latest value of a panel."""
    return rolled.where(F.col(v).isNotNull()).agg(F.max_by(v, "t_us").alias("v"), F.max("t_us").alias("t_us"))


def at_last(rolled: DataFrame) -> DataFrame:
    """The rows of the latest time."""
    return rolled.join(rolled.agg(F.max("t_us").alias("t_us")), "t_us", "left_semi")


def union_or(left: DataFrame, right: DataFrame, labels: Sequence[str]) -> DataFrame:
    """All of the left, and of the right what has labels that the left has not, at the same time."""
    keys = ["t_us", *labels]
    return left.unionByName(right.join(left.select(keys).distinct(), keys, "left_anti"))


def combine(left: DataFrame, right: DataFrame, labels: Sequence[str], made: Column, how: str = "inner") -> DataFrame:
    """Vector arithmetic: ``made`` of l and r where times and labels are equal; outer counts a missing side as 0."""
    keys = ["t_us", *labels]
    joined = left.withColumnRenamed("v", "l").join(right.withColumnRenamed("v", "r"), keys, "full" if how == "outer" else how)
    if how == "outer":
        joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in "lr"})
    return joined.select(*keys, made.alias("v"))


def share(parts: DataFrame, total: DataFrame) -> DataFrame:
    """Each labelled value divided by the one without labels of the same time."""
    return parts.join(total.withColumnRenamed("v", "_total"), "t_us").withColumn("v", F.col("v") / F.col("_total")).drop("_total")


def band(value: Column, edges: Sequence[tuple[float, str]], lowest: str) -> Column:
    """Name of the highest edge at or below the value."""
    out = F.lit(lowest)
    for edge, name in sorted(edges):
        out = F.when(value >= edge, name).otherwise(out)
    return out


#: Milliseconds from which a tile's duration is shown in another band.
DURATION_BANDS = ((10, "10"), (500, "500"), (1000, "1000"), (1300, "1300"))
