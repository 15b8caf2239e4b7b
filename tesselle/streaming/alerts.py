"""Alert rules over rolled-up series: thresholds, pending and firing states, in batch and as a stream.

A rule is evaluated at whole steps. It is ``pending`` from the first evaluation at which its
condition holds and ``firing`` once it has held for ``hold`` microseconds; an evaluation without
data counts as a condition that does not hold.
"""

from __future__ import annotations

import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import telemetry as tm


@dataclass(frozen=True)
class Rule:
    name: str
    threshold: float
    hold: int
    severity: int
    step: int = tm.MINUTE
    #: A filter inside the query, before the threshold.
    floor: float | None = None


#: Thresholds, holding times and severities.
SUSTAINED_ERRORS = Rule("sustained_errors", 0.99, 5 * tm.MINUTE, 1)
DOMAIN_RATE = Rule("domain_rate", 1.0, tm.MINUTE, 3, floor=0.3)
HIGH_ERRORS = Rule("high_errors", 100.0, tm.MINUTE, 1)
RULES = (SUSTAINED_ERRORS, DOMAIN_RATE, HIGH_ERRORS)

#: How far back an evaluation looks, and how late a sample of a stream may come; the latter is our choice.
RELATIVE_RANGE = 5 * tm.MINUTE
LATENESS = "5 minutes"


def condition(v: Column, rule: Rule) -> Column:
    """Whether a value is above the rule's floor, if it has one, and its threshold; null is not."""
    passed = v > F.lit(rule.threshold) if rule.floor is None else (v > F.lit(rule.floor)) & (v > F.lit(rule.threshold))
    return F.coalesce(passed, F.lit(False))


def reduce_last(rolled: DataFrame, by: Sequence[str], now: Column, span: int = RELATIVE_RANGE) -> DataFrame:
    """The latest value of each series in the range before ``now``."""
    recent = rolled.where((F.col("t_us") > now - span) & (F.col("t_us") <= now))
    return recent.groupBy(*by).agg(F.max_by("v", "t_us").alias("v"), F.max("t_us").alias("t_us"))


def all_states(rolled: DataFrame, rules: Sequence[Rule], by: Sequence[str] = ()) -> DataFrame:
    """states() of several rules, from one pass over the values: each row is tested once for each rule."""
    tests = F.array(*(F.when(condition(F.col("v"), r), F.struct(*(F.lit(x).alias(n) for n, x in (("rule", r.name), ("severity", r.severity), ("_hold", r.hold), ("_step", r.step))))) for r in rules))
    held = rolled.withColumn("_r", F.explode(F.filter(tests, lambda x: x.isNotNull()))).select("t_us", *by, "v", "_r.*")
    order = Window.partitionBy("rule", *by).orderBy("t_us")
    begins = F.coalesce((F.col("t_us") - F.lag("t_us").over(order) > F.col("_step")).cast("int"), F.lit(1))
    runs = held.withColumn("_begin", F.when(begins == 1, F.col("t_us")))
    since = F.last("_begin", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("t_us") - since >= F.col("_hold"), "firing").otherwise("pending")
    return runs.select("t_us", *by, "v", "rule", "severity", state.alias("state"))


def states(rolled: DataFrame, rule: Rule, by: Sequence[str] = ()) -> DataFrame:
    """t_us, labels, v, rule, severity, state at each evaluation where the condition holds.

    Evaluations without a row end a run, as a series without data is not above anything.
    """
    return all_states(rolled, [rule], by)


def error_counts(samples: DataFrame) -> DataFrame:
    """Errors of each minute, over all series."""
    return tm.aggregate(tm.rollup(samples, "sum", tm.MINUTE, tm.MINUTE, ["series"], order="t_us"), "sum")


def domain_rates(requests: DataFrame, hits: DataFrame, by: str = "apex_domain", parity: bool = False) -> DataFrame:
    """Requests a second of each domain, over an hour: those answered and those served from a cache.

    A domain on one side only counts with 0 on the other; under parity it is dropped, as label
    matching would do.
    """
    left = tm.aggregate(tm.rollup(requests, "count", tm.HOUR, tm.HOUR, [by], order="t_us"), "sum", [by])
    right = tm.aggregate(tm.rollup(hits, "count", tm.HOUR, tm.HOUR, [by], order="t_us"), "sum", [by])
    return tm.combine(left, right, [by], (F.col("l") + F.col("r")) / 3600.0, "inner" if parity else "outer")


# --- streams

def windowed_counts(events: DataFrame, window: str, step: str, by: Sequence[str], ts: str = "ts", value: str = "value", lateness: str = LATENESS) -> DataFrame:
    """Sums and counts of a stream over windows that are closed on the right; t is the window's end."""
    shifted = events.withColumn("_ts", F.col(ts) - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_ts", lateness)
    rows = shifted.groupBy(F.window("_ts", window, step), *by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.end").alias("t"), *by, "total", "n")


class PendingState(StatefulProcessor):
    """Keeps for each series since when its condition has held, and its last evaluation."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "since long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("t_us")
        since, last = self.held.get() if self.held.exists() else (None, None)
        out = []
        for t, v in zip(frame["t_us"].tolist(), frame["v"].tolist()):
            above = v is not None and v > self.rule.threshold and (self.rule.floor is None or v > self.rule.floor)
            if not above:
                since, last = None, None
                continue
            if since is None or t - last > self.rule.step:
                since = t
            last = t
            out.append((*key, t, v, "firing" if t - since >= self.rule.hold else "pending"))
        if since is None:
            self.held.clear()
        else:
            self.held.update((since, last))
        yield pd.DataFrame(out, columns=["series", "t_us", "v", "state"])

    def close(self) -> None:
        pass


def stream_states(rolled: DataFrame, rule: Rule) -> DataFrame:
    """series, t_us, v, state of a stream of (series, t_us, v)."""
    return rolled.groupBy("series").transformWithStateInPandas(PendingState(rule), "series string, t_us long, v double, state string", "append", "none")


def write_lines(points: DataFrame, path: str, checkpoint: str, environment: str = "prod", every: str = "60 seconds"):
    """A streaming query that appends points as lines of text; outside production it shows them."""

    def batch(frame: DataFrame, _: int) -> None:
        lines = frame.where("line IS NOT NULL").select(F.col("line").alias("value"))
        if environment == "prod":
            lines.write.mode("append").text(path)
        else:
            lines.show(truncate=False)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def write_points(points: DataFrame, providers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, deferred: Sequence[Callable[[int], None]] = (), every: str = "60 seconds"):
    """A streaming query that gives each batch of points to several providers, then runs what was deferred.

    A batch is read once. What is deferred runs only after all providers have it, and not where
    one of them failed; the batch comes again then, so providers must bear to see it twice.
    """

    def batch(frame: DataFrame, number: int) -> None:
        kept = frame.persist()
        try:
            for provider in providers.values():
                provider(kept, number)
        finally:
            kept.unpersist()
        for later in deferred:
            later(number)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def post_lines(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Callable[[DataFrame, int], None]:
    """A provider that sends the lines of a batch to a service, a request for each part of at most some megabytes.

    A response that tells of an error fails the task, which is tried again.
    """

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = "\n".join(batch.column(0).to_pylist()).encode()
            with urllib.request.urlopen(urllib.request.Request(url, body, headers or {}, method="POST"), timeout=timeout):
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["sent"])

    def provider(frame: DataFrame, _: int) -> None:
        frame.where("line IS NOT NULL").select("line").mapInArrow(post, "sent long").agg(F.sum("sent")).collect()

    return provider


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a written table.

    ``append`` writes a window once, when the watermark has passed it, and then forgets it.
    ``complete`` keeps every window and rewrites the table with each batch, for small states only.
    """

    def batch(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
