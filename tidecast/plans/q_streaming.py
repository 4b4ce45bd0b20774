"""Queries: streaming jobs run to the end of the given tables, checked by batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import learn as N
from tidecast.plans import inputs as I
from tidecast.plans.q_ledger import NOW, ledger, plan_rows
from tidecast.plans.q_profile import rounded
from tidecast.plans.registry import ORACLES, cte, query, with_
from tidecast.session import fresh_path, parts
from tidecast.streaming import jobs, state


def _events(spark, sf):
    """Event table as a stream of transactions."""
    schema = I.table(spark, sf, "events").schema
    # A pattern finds the table whether it is one file or a folder of files.
    s = jobs.file_stream(spark, f"{sf}/events.parque[t]", schema)
    return s.select(
        F.col("ts").cast("timestamp").alias("open_time"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_id").cast("string").alias("transaction_id"), F.floor("value").cast("double").alias("guests"),
    )


def _table(spark, out, stem):
    path = fresh_path(spark, stem)
    jobs.run_to_table(out, path, f"{path}-checkpoint")
    return spark.read.parquet(path)


@query(
    "st_dedup_txn",
    "SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'U' || CAST(user_id AS VARCHAR) AS entity, floor(value) AS guests FROM events",
)
def st_dedup_txn(spark, sf):
    e = _events(spark, sf)
    again = _events(spark, sf).where(F.col("transaction_id").cast("long") % 10 == 3)
    got = _table(spark, jobs.dedup_txn(e.unionByName(again)), "stream-dedup")
    return got.select("transaction_id", "entity", "guests")


_EV = "SELECT ts AS open_time, 'U' || CAST(user_id AS VARCHAR) AS entity, floor(value) AS guests FROM events"
cte("ev_txn", _EV)


@query(
    "st_hourly",
    with_(
        """SELECT CAST(s AS VARCHAR) AS start, CAST(s + INTERVAL 1 HOUR AS VARCHAR) AS "end", entity, n, guests FROM (SELECT date_trunc('hour', open_time) AS s, entity, count(*) AS n, sum(guests) AS guests FROM ev_txn GROUP BY ALL)
        WHERE s + INTERVAL 1 HOUR <= (SELECT max(open_time) FROM ev_txn) - INTERVAL 10 MINUTE""",
        "ev_txn",
    ),
)
def st_hourly(spark, sf):
    return _table(spark, jobs.hourly(_events(spark, sf)), "stream-hourly")


@query(
    "st_sliding",
    with_(
        """SELECT CAST(s AS VARCHAR) AS start, CAST(s + INTERVAL 3 HOUR AS VARCHAR) AS "end", entity, n, guests FROM (SELECT date_trunc('hour', open_time) - to_hours(k) AS s, entity, count(*) AS n, sum(guests) AS guests
        FROM ev_txn CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS k) GROUP BY ALL) WHERE s + INTERVAL 3 HOUR <= (SELECT max(open_time) FROM ev_txn) - INTERVAL 10 MINUTE""",
        "ev_txn",
    ),
)
def st_sliding(spark, sf):
    return _table(spark, jobs.hourly(_events(spark, sf), slide="1 hour"), "stream-sliding")


@query(
    "st_sessions",
    with_(
        """SELECT entity, n, guests FROM (SELECT entity, i, count(*) AS n, sum(guests) AS guests, max(open_time) AS t FROM (SELECT *, sum(b) OVER (PARTITION BY entity ORDER BY open_time) AS i FROM (
        SELECT *, CASE WHEN open_time - lag(open_time) OVER (PARTITION BY entity ORDER BY open_time) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM ev_txn)) GROUP BY ALL)
        WHERE t + INTERVAL 2 HOUR <= (SELECT max(open_time) FROM ev_txn) - INTERVAL 10 MINUTE""",
        "ev_txn",
    ),
)
def st_sessions(spark, sf):
    return _table(spark, jobs.sessions(_events(spark, sf)), "stream-sessions").select("entity", "n", "guests")


@query(
    "st_actuals",
    with_(
        f"""SELECT p.entity, CAST(p.date + 7 AS VARCHAR) AS date, p.shift, p.guests AS pred, a.guests AS actual FROM shift_day p LEFT JOIN shift_day a ON a.entity = p.entity AND a.shift = p.shift AND a.date = p.date + 7 AND a.date <= DATE '{NOW}'""",
        "shift_day",
    ),
)
def st_actuals(spark, sf):
    staged = fresh_path(spark, "staged-txn")
    I.txn(spark, sf).select("entity", "date", "hour", "guests").repartition(4).write.parquet(staged)
    out = fresh_path(spark, "stream-actuals")
    stream = jobs.file_stream(spark, staged, spark.read.parquet(staged).schema, files_per_batch=2)
    jobs.collect_actuals(stream, out, f"{out}-checkpoint")
    led = plan_rows(spark, sf).where("shift is not null").withColumn("slot", F.concat(F.lit("S"), F.col("shift"))).drop("actual")
    real = jobs.read_actuals(spark, out)
    known = F.when(F.col("date") <= F.lit(NOW).cast("date"), F.col("real")).alias("actual")
    return led.join(real, ["entity", "date", "slot"], "left").select("entity", "date", "shift", "pred", known)


def _staged_errors(spark, sf, batches=3):
    """Errors as a stream of three batches, in files whose number grows with the orders."""
    staged = fresh_path(spark, "staged-errors")
    each = -(-parts(I.table(spark, sf, "orders")) // batches)
    # dealt out at random, so that days are split between files and between batches
    N.errors(ledger(spark, sf)).select("entity", "date", "error").repartition(batches * each).write.parquet(staged)
    return jobs.file_stream(spark, staged, spark.read.parquet(staged).schema, files_per_batch=each)


@query(
    "st_bias",
    with_(
        """SELECT entity, round(list_reduce(list_prepend(0.0, list(e ORDER BY date)), lambda s, x: 0.3::DOUBLE * x + (1 - 0.3::DOUBLE) * s), 6) AS bias, count(*) AS days FROM (SELECT entity, date, avg(error) AS e FROM pairs GROUP BY ALL) GROUP BY entity""",
        "pairs",
    ),
)
def st_bias(spark, sf):
    out = fresh_path(spark, "stream-bias")
    stream = _staged_errors(spark, sf)
    # files come in any order, so nothing may be late here
    state.track(stream, out, f"{out}-checkpoint", delay="5000 days")
    return rounded(state.newest(spark, out).drop("closed"), "bias", n=6)


@query("st_bias_parts", ORACLES["st_bias"])
def st_bias_parts(spark, sf):
    """The same bias, folded from sums that each batch writes."""
    out = fresh_path(spark, "stream-bias")
    stream = _staged_errors(spark, sf)
    jobs.track_bias(stream, out, f"{out}-checkpoint")
    return rounded(jobs.newest_bias(spark, out), "bias", n=6)
