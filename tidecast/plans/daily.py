"""The daily run: facts, profile, calibration, forecast, corrections and ledger in one go.

Each stage is a composition of operators. Stages that several later ones read are written once
(``materialise``), which also bounds the plan's size."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.operators import calendar as C
from tidecast.operators import calibrate as K
from tidecast.operators import facts, horizon, profile
from tidecast.operators import forecast as P
from tidecast.operators import learn as N
from tidecast.operators import ledger as L
from tidecast.operators import models as D
from tidecast.session import materialise


@dataclass
class Inputs:
    """What a run reads. Optional parts may be left out."""

    txn: DataFrame
    calendar: DataFrame
    ledger: DataFrame
    booking: DataFrame | None = None
    schedule: DataFrame | None = None
    chain_dim: DataFrame | None = None
    keys: DataFrame | None = None
    segments: DataFrame | None = None
    seasonal: DataFrame | None = None
    entity_state: DataFrame | None = None
    future_close: DataFrame | None = None  # entity, future_close_date
    closed_windows: DataFrame | None = None  # entity, from_date, to_date: no facts to learn from


def known_at(inp: Inputs, today: str) -> Inputs:
    """The inputs as of that day: no later transaction is seen, whatever the tables hold."""
    return replace(inp, txn=inp.txn.where(F.col("date") <= F.lit(today).cast("date")))


def forecast_rows(inp: Inputs, today: str, days: int = 30) -> DataFrame:
    """Forecasts of the next ``days`` days for every entity that is not excluded: by shift, and
    those of the ensemble by day (no shift) where the route calls a date long."""
    inp = known_at(inp, today)
    if inp.closed_windows is not None:
        inp = replace(inp, txn=horizon.exclude_windows(inp.txn, inp.closed_windows))
    start = str(dt.date.fromisoformat(today) + dt.timedelta(days=1))
    day = materialise(facts.daily(inp.txn), "daily-facts")
    cal = inp.calendar
    prof = materialise(profile.report(day, cal, today), "profiles")
    ratios = materialise(K.ratios(day, K.baselines(day, cal), cal, today), "holiday-ratios")
    impacts = K.holiday_aggregate(K.ratio_summary(ratios))
    events = materialise(K.event_impacts(day, cal), "event-impacts")
    cal = C.apply_impacts(cal, impacts).drop("holiday_impact_source", "holiday_impact_default")
    cal = materialise(cal, "calendar-impacts")

    h = horizon.skeleton(prof.where("not should_exclude or category = 'NEW'").select("entity"), cal, start, days)
    h = materialise(K.apply_events(h, K.event_per_entity(events), K.event_aggregate(events)), "horizon")
    routed = materialise(P.route(prof, h, start), "routed")

    base = P.baseline_median(day, routed.where("route = 'baseline'")).select("entity", "date", "shift", "forecast", "route")
    ens = _ensemble(inp, day, prof, routed.where("route = 'ensemble'"), cal, today)
    ens = materialise(ens, "ensemble")
    out = base.unionByName(ens.select("entity", "date", "shift", "forecast", "route"))
    if inp.chain_dim is not None:
        out = out.unionByName(_new_entities(inp, day, routed.where("route = 'chain_blend'")))

    out = out.join(h.select("entity", "date", "is_holiday", "holiday_type", "holiday_impact", "is_special_event", "event_type", "is_veg"), ["entity", "date"])
    out = out.join(prof.select("entity", "avg_daily", "max_daily_normal", "min_daily_normal_weekday", "min_daily_normal_weekend", "max_by_special"), "entity")
    if inp.entity_state is not None:
        fixed = N.apply(out.withColumn("hour", F.lit(None).cast("int")), inp.entity_state, inp.keys, inp.segments, inp.seasonal)
        out = fixed.withColumn("system", F.col("forecast")).withColumn("forecast", F.col("corrected")).select(*out.columns, "system")
    else:
        out = out.withColumn("system", F.col("forecast"))
    wd = profile.weekday_stats(day).select("entity", "weekday", "avg")
    out = P.guardrail(P.final_cap(out), wd)
    rates = K.closure_rates(ratios)
    none = day.select("entity").where("false").withColumn("future_close_date", F.lit(None).cast("date"))
    gone = inp.future_close if inp.future_close is not None else none
    gone = gone.groupBy("entity").agg(F.min("future_close_date").alias("future_close_date"))
    sched = inp.schedule if inp.schedule is not None else day.select("entity", "date", F.lit("OPEN").alias("status")).where("false")
    closed = K.closed_dates(h, gone, sched, K.closures(day, inp.calendar), rates)
    return P.half_day(out, closed)


def _ensemble(inp: Inputs, day: DataFrame, prof: DataFrame, rows: DataFrame, cal: DataFrame, today: str) -> DataFrame:
    """Model and statistical sources blended by strategy and adjusted; short dates split to shifts."""
    cols = ["entity", "strategy", "volume_segment", "avg_daily", "trend_score", "trend_short", "mean_7d", "max_by_special",
            "max_daily_normal_weekday", "max_daily_normal_weekend", "min_daily_normal_weekday", "min_daily_normal_weekend"]
    s = materialise(facts.guest_facts(inp.txn, by_shift=True), "shift-facts")
    wd = F.weekday("date").alias("wd")
    means = day.groupBy("entity", wd).agg(F.avg("guests").alias("ml"))
    split = s.groupBy("entity", wd).agg(
        F.avg(F.when(F.col("shift") == "MORNING", F.col("guests"))).alias("ml_morning"),
        F.avg(F.when(F.col("shift") == "EVENING", F.col("guests"))).alias("ml_evening"))
    d = rows.join(P.strategy_weights(prof.select(*cols)), "entity").withColumn("wd", F.weekday("date"))
    d = d.join(means, ["entity", "wd"], "left").join(split, ["entity", "wd"], "left")
    # a model without a value for an entity takes no part in its blend
    wanted = rows.select("entity", "date")
    for name, f in (("seasonal", D.seasonal_forecast(day, wanted, cal)), ("neural", D.global_forecast(day, cal, wanted))):
        d = d.join(f.select("entity", "date", F.col("forecast").alias(name)), ["entity", "date"], "left")
    d = d.withColumn("ai", F.col("mean_7d")).drop("wd")
    if inp.booking is not None:
        d = P.booking_ratio(d, facts.booking_day(inp.booking))
    else:
        d = d.withColumn("booking_ratio", F.lit(0.0))
    d = materialise(d, "sources")
    short = P.shift_split(P.chain(d.where("span = 'short'"), today), facts.weekday_shift_ratio(inp.txn), P.percentiles(s)[1])
    long = P.daily_only(d.where("span = 'long'"), today).withColumn("shift", F.lit(None).cast("string"))
    cols = ["entity", "date", "shift", "forecast", "route"]
    return short.select(*cols).unionByName(long.select(*cols))


def _new_entities(inp: Inputs, day: DataFrame, rows: DataFrame) -> DataFrame:
    """Entities with almost no history lean on the other entities of their chain."""
    hourly = inp.txn.groupBy("entity", "date", "hour").agg(F.sum("guests").alias("guests"))
    level, mult, hours = P.chain_patterns(hourly, P.siblings(day, inp.chain_dim))
    own = day.groupBy("entity").agg(F.avg("guests").alias("own_avg"), F.count("*").alias("own_days"))
    targets = inp.chain_dim.join(rows.select("entity").distinct(), "entity", "left_semi")
    b = P.chain_blend(targets, own, level.drop("n_siblings"), mult, hours, facts.hour_ratio(inp.txn),
                      rows.select("entity", "date", "is_holiday", "holiday_impact"))
    shift = facts.shift_of(F.col("hour"))
    return b.groupBy("entity", "date", shift.alias("shift")).agg(F.sum("forecast").alias("forecast")).withColumn("route", F.lit("chain_blend"))


def run(inp: Inputs, today: str, days: int = 30) -> DataFrame:
    """New ledger: actuals filled, the run's rows merged in, one mode and one row per slot."""
    inp = known_at(inp, today)
    new = forecast_rows(inp, today, days).select(
        F.lit(today).cast("date").alias("run_date"), "entity", "date", F.lit(None).cast("int").alias("hour"), "shift",
        F.col("forecast").alias("pred"), F.lit(None).cast("double").alias("actual"),
        F.when(F.col("shift").isNull(), "daily_only").otherwise("shift").alias("mode"))
    filled = L.fill_actuals(inp.ledger, inp.txn, today).select(*new.columns)
    return L.dedup(L.one_mode(L.merge(filled, new, today)))
