"""Queries that roll up metrics, and alert states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry as tm
from ..streaming import alerts
from .derive import SAMPLES, samples, shared_folder, spread, table

QUERIES, ORACLES = {}, {}
MIN, H, D = tm.MINUTE, tm.HOUR, tm.DAY


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


LAST = f"""WITH {SAMPLES}, {spread('samples', 10 * MIN, MIN, where="metric = 'view'")},
    l AS (SELECT t, metric, colo, arg_max(value, (t_us, event_id)) AS v FROM spread GROUP BY t, metric, colo)"""


def _last(spark, sf_dir):
    views = tm.matching(samples(spark, sf_dir), {"metric": "view", "colo": "~C.*"})
    return tm.rollup(views, "last", 10 * MIN, MIN, ["metric", "colo"])


@query(f"{LAST} SELECT t AS t_us, round(avg(v), 6) AS v FROM l GROUP BY t")
def rollup_last_avg(spark, sf_dir):
    return tm.aggregate(_last(spark, sf_dir), "avg").withColumn("v", F.round("v", 6))


@query(f"{LAST} SELECT t AS t_us, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99, round(quantile_cont(v, 0.80), 6) AS p80 FROM l GROUP BY t")
def rollup_quantiles(spark, sf_dir):
    return _last(spark, sf_dir).groupBy("t_us").agg(*(F.round(F.percentile("v", q), 6).alias(n) for n, q in (("p95", 0.95), ("p99", 0.99), ("p80", 0.8))))


def _cents(spark, sf_dir):
    """Exact money instead of binary fractions, so that sums don't depend on their order."""
    return samples(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))


@query(f"WITH {SAMPLES}, {spread('samples', H, MIN)} SELECT t AS t_us, colo, CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS v FROM spread GROUP BY t, colo")
def sum_over_time_by_label(spark, sf_dir):
    r = tm.rollup(_cents(spark, sf_dir), "sum", H, MIN, ["metric", "colo"])
    return tm.aggregate(r, "sum", ["colo"]).withColumn("v", F.col("v").cast("double"))


@query(f"""WITH {SAMPLES}, {spread('samples', H, MIN)}, s AS (SELECT t AS t_us, colo, CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS v FROM spread GROUP BY t, colo)
    SELECT t_us, colo, v FROM s WHERE t_us = (SELECT max(t_us) FROM s) ORDER BY v, colo""")
def sorted_by_value(spark, sf_dir):
    """What a panel shows of the latest instant: its values in ascending order."""
    last = tm.at_last(sum_over_time_by_label(spark, sf_dir))
    return last.orderBy("v", "colo")


@query(f"""WITH {SAMPLES}, {spread('samples', H, 10 * MIN)}, p AS (SELECT t, colo, sum(value::DECIMAL(18,2)) AS v FROM spread GROUP BY t, colo),
    w AS (SELECT t, sum(v) AS total FROM p GROUP BY t) SELECT t AS t_us, colo, round(CAST(v AS DOUBLE) / CAST(total AS DOUBLE), 6) AS v FROM p JOIN w USING (t)""")
def share_of_total(spark, sf_dir):
    r = tm.rollup(_cents(spark, sf_dir), "sum", H, 10 * MIN, ["metric", "colo"])
    parts, total = (tm.aggregate(r, "sum", by).withColumn("v", F.col("v").cast("double")) for by in (["colo"], []))
    return tm.share(parts, total).withColumn("v", F.round("v", 6))


def _quantile_sql(window, step, metric):
    return f"""WITH {SAMPLES}, {spread('samples', window, step, where=f"metric = '{metric}' AND value >= 0")},
    b AS (SELECT t, CAST(CASE WHEN value <= 1e-9 THEN -162 ELSE greatest(ceil(log10(value) * 18), -161) END AS INTEGER) AS bucket, count(*) AS n FROM spread GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY t ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY t) AS total FROM b)
    SELECT t AS t_us, round((CASE WHEN bucket <= -162 THEN 0 ELSE pow(10.0::DOUBLE, (bucket - 1) / 18.0::DOUBLE) END) + (pow(10.0::DOUBLE, bucket / 18.0::DOUBLE) - CASE WHEN bucket <= -162 THEN 0 ELSE pow(10.0::DOUBLE, (bucket - 1) / 18.0::DOUBLE) END) * (total * 0.95::DOUBLE - (cum - n)) / n, 6) AS v
    FROM c WHERE cum >= total * 0.95::DOUBLE AND cum - n < total * 0.95::DOUBLE"""


def _quantile(spark, sf_dir, window, step, metric):
    counts = tm.histogram(tm.matching(samples(spark, sf_dir), {"metric": metric}), window, step)
    return tm.histogram_quantile(counts, 0.95).withColumn("v", F.round("v", 6))


@query(_quantile_sql(10 * MIN, 10 * MIN, "click"))
def histogram_quantile_10m(spark, sf_dir):
    return _quantile(spark, sf_dir, 10 * MIN, 10 * MIN, "click")


@query(_quantile_sql(D, D, "view"))
def histogram_quantile_24h(spark, sf_dir):
    return _quantile(spark, sf_dir, D, D, "view")


@query(f"WITH {SAMPLES}, {spread('samples', D, H, where=chr(39).join(['colo = ', 'C3', '']))} SELECT t AS t_us, CAST(count(*) AS BIGINT) AS v FROM spread GROUP BY t")
def count_over_time_1d(spark, sf_dir):
    r = tm.rollup(tm.matching(samples(spark, sf_dir), {"colo": "C3"}), "count", D, H, ["metric", "colo"])
    return tm.aggregate(r, "sum")


@query(f"WITH {SAMPLES}, {spread('samples', H, H)}, l AS (SELECT t, metric, colo, arg_max(value, (t_us, event_id)) AS v FROM spread GROUP BY t, metric, colo) SELECT t AS t_us, round(quantile_cont(v, 0.99), 6) AS v FROM l GROUP BY t")
def p99_1h(spark, sf_dir):
    r = tm.rollup(samples(spark, sf_dir), "last", H, H, ["metric", "colo"])
    return tm.aggregate(r, "quantile", q=0.99).withColumn("v", F.round("v", 6))


@query(f"WITH {SAMPLES}, {spread('samples', 7 * D, H)}, s AS (SELECT t, CAST(count(*) AS BIGINT) AS v FROM spread GROUP BY t) SELECT arg_max(v, t) AS v, max(t) AS t_us FROM s")
def total_7d(spark, sf_dir):
    ones = samples(spark, sf_dir).withColumn("value", F.lit(1))
    return tm.last_not_null(tm.aggregate(tm.rollup(ones, "sum", 7 * D, H, ["metric", "colo"]), "sum"))


@query(f"WITH {SAMPLES}, {spread('samples', MIN, MIN, where=chr(39).join(['metric = ', 'error', '']))} SELECT t AS t_us, CAST(count(*) AS BIGINT) AS v FROM spread GROUP BY t")
def errors_1m(spark, sf_dir):
    errors = tm.matching(samples(spark, sf_dir), {"metric": ["error"]}).selectExpr("t_us", "concat_ws('/', metric, colo) AS series", "1L AS value")
    return alerts.error_counts(errors)


DOMAINS = f"""WITH {SAMPLES}, {spread('samples', H, H, 'a', "metric = 'view' AND domain <> 'd4'")}, {spread('samples', H, H, 'b', "metric = 'click'")},
    l AS (SELECT t, domain, count(*) AS n FROM a GROUP BY t, domain), r AS (SELECT t, domain, count(*) AS n FROM b GROUP BY t, domain),
    s AS (SELECT coalesce(l.t, r.t) AS t_us, coalesce(l.domain, r.domain) AS domain, (coalesce(l.n, 0) + coalesce(r.n, 0)) / 3600.0 AS v FROM l FULL JOIN r ON l.t = r.t AND l.domain = r.domain)"""


def _domains(spark, sf_dir, parity=False):
    s = samples(spark, sf_dir)
    return alerts.domain_rates(s.where("metric = 'view' AND domain <> 'd4'"), s.where("metric = 'click'"), "domain", parity)


@query(f"{DOMAINS} SELECT t_us, domain, round(CAST(v AS DOUBLE), 6) AS v FROM s WHERE v > 0.0004")
def domain_rate(spark, sf_dir):
    return _domains(spark, sf_dir).where("v > 0.0004").withColumn("v", F.round("v", 6))


@query(f"{DOMAINS.replace('FULL JOIN', 'JOIN')} SELECT t_us, domain, round(CAST(v AS DOUBLE), 6) AS v FROM s")
def domain_rate_parity(spark, sf_dir):
    return _domains(spark, sf_dir, True).withColumn("v", F.round("v", 6))


@query(f"{DOMAINS} SELECT t AS t_us, domain, n AS v FROM l UNION ALL SELECT t, domain, n FROM r ANTI JOIN l USING (t, domain)")
def vector_or(spark, sf_dir):
    s = samples(spark, sf_dir)
    left, right = (tm.aggregate(tm.rollup(x, "count", H, H, ["domain"]), "sum", ["domain"]) for x in (s.where("metric = 'view' AND domain <> 'd4'"), s.where("metric = 'click'")))
    return tm.union_or(left, right, ["domain"])


#: Rules scaled to the test tables: hours for minutes.
RULES = (alerts.Rule("errors_held", 0.99, 2 * H, 1, H), alerts.Rule("errors_floor", 2.0, H, 3, H, 1.0), alerts.Rule("errors_high", 4.0, H, 1, H))


@query(f"WITH {SAMPLES}, {spread('samples', H, H, where=chr(39).join(['metric = ', 'error', '']))}, c AS (SELECT t, count(*) AS v FROM spread GROUP BY t), "
    "rules(rule, threshold, hold, severity) AS (VALUES " + ", ".join(f"('{r.name}', {max(r.threshold, r.floor or 0)}, {r.hold}, {r.severity})" for r in RULES) + f"""),
    h AS (SELECT t, v, rule, hold, severity, t - {H} * row_number() OVER (PARTITION BY rule ORDER BY t) AS island FROM c JOIN rules ON v > threshold)
    SELECT t AS t_us, CAST(v AS BIGINT) AS v, rule, CAST(severity AS INTEGER) AS severity, CASE WHEN t - min(t) OVER (PARTITION BY rule, island) >= hold THEN 'firing' ELSE 'pending' END AS state FROM h""")
def alert_rule_states(spark, sf_dir):
    errors = tm.matching(samples(spark, sf_dir), {"metric": "error"})
    counts = tm.aggregate(tm.rollup(errors, "count", H, H, ["metric", "colo"]), "sum")
    return alerts.all_states(counts, RULES)


@query(f"WITH {SAMPLES}, c AS (SELECT domain, t_us, value FROM samples WHERE t_us > (SELECT max(t_us) FROM samples) - {6 * H}) SELECT domain, arg_max(value, t_us) AS v, max(t_us) AS t_us FROM c GROUP BY domain")
def alert_reduce_last(spark, sf_dir):
    s = samples(spark, sf_dir)
    now = s.agg(F.max("t_us")).first()[0]
    return alerts.reduce_last(s.withColumn("v", F.col("value")), ["domain"], F.lit(now), 6 * H)


@query("SELECT CASE WHEN value * 10 >= 1300 THEN '1300' WHEN value * 10 >= 1000 THEN '1000' WHEN value * 10 >= 500 THEN '500' WHEN value * 10 >= 10 THEN '10' ELSE 'base' END AS band, count(*) AS n FROM events GROUP BY 1")
def threshold_bands(spark, sf_dir):
    band = tm.band(F.col("value") * 10, tm.DURATION_BANDS, "base")
    return table(spark, sf_dir, "events").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT 'C' || (user_id % 8) AS colo FROM events")
def label_values(spark, sf_dir):
    return samples(spark, sf_dir).select("colo").distinct()


@query(f"WITH {SAMPLES}, {spread('samples', D, D)} SELECT t AS t_us, colo, CAST(count(*) AS BIGINT) AS v FROM spread WHERE colo IN ('C1', 'C2') GROUP BY t, colo")
def repeat_by_label(spark, sf_dir):
    chosen = tm.matching(samples(spark, sf_dir), {"colo": ["C1", "C2"]})
    return tm.aggregate(tm.rollup(chosen, "count", D, D, ["metric", "colo"]), "sum", ["colo"])


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {SAMPLES}, {spread('samples', 6 * H, H)} SELECT t AS t_us, metric, CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS total, CAST(count(*) AS BIGINT) AS n FROM spread GROUP BY t, metric")
def stream_windowed_counts(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("metric"), F.col("value").cast("decimal(18,2)").alias("value"))
    made = alerts.windowed_counts(stream, "6 hours", "1 hour", ["metric"])
    place = shared_folder(spark, "streams")
    done = alerts.run_to_table(made, f"{place}/out", f"{place}/state", "complete")
    return done.select(F.unix_micros("t").alias("t_us"), "metric", F.col("total").cast("double").alias("total"), "n")


#: What a stream has written when it has seen all events: windows that ended before the watermark.
CLOSED = f"t - 1 <= (SELECT max(t_us) FROM samples) - 1 - {5 * MIN}"


@query(f"WITH {SAMPLES}, {spread('samples', 6 * H, H)} SELECT t AS t_us, metric, CAST(sum(value::DECIMAL(18,2)) AS DOUBLE) AS total, CAST(count(*) AS BIGINT) AS n FROM spread WHERE {CLOSED} GROUP BY t, metric")
def stream_closed_windows(spark, sf_dir):
    stream = _event_stream(spark, sf_dir).select("ts", F.col("event_type").alias("metric"), F.col("value").cast("decimal(18,2)").alias("value"))
    made = alerts.windowed_counts(stream, "6 hours", "1 hour", ["metric"])
    place = shared_folder(spark, "streams")
    done = alerts.run_to_table(made, f"{place}/out", f"{place}/state")
    return done.select(F.unix_micros("t").alias("t_us"), "metric", F.col("total").cast("double").alias("total"), "n")
