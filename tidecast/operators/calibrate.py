"""Holiday and event impact calibration from daily facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import grouped_quantiles, ratio
from tidecast.operators import calendar as C
from tidecast.session import materialise

PERIOD = ["period_type", "year", "start"]


def baselines(day: DataFrame, cal: DataFrame, lookback: int = rules.CAL_LOOKBACK) -> DataFrame:
    """Median per period, entity and weekday over ordinary days outside the period's zone.

    The days of each period's baseline are laid out as (period, date) rows, a table bounded
    by the calendar, so the facts meet them in an equi join on the date.
    """
    p = C.group_holidays(cal).select(*PERIOD, "end")
    pre, post = C.windows_of(F.col("period_type"))
    normal = cal.where("holiday_type is null").select("date")
    zone = (F.col("date") < F.date_sub("start", pre)) | (F.col("date") > F.date_add("end", post))
    laid = (
        p.withColumn("date", F.explode(F.sequence(F.date_sub("start", lookback), F.date_add("end", lookback))))
        .where(zone).select(*PERIOD, "date").join(normal, "date", "left_semi")
    )
    return (
        day.join(F.broadcast(laid), "date")
        .groupBy(*PERIOD, "entity", F.weekday("date").alias("wd"))
        .agg(F.median("guests").alias("base"), F.count("*").alias("days"))
        .where((F.col("days") >= rules.CAL_MIN_DAYS) & (F.col("base") >= rules.CAL_MIN_GUESTS))
    )


def ratios(day: DataFrame, base: DataFrame, cal: DataFrame, today: str) -> DataFrame:
    """Actual / baseline per entity on every offset date; an entity without a row on a date
    that others have is closed (ratio 0); dates nobody has are skipped."""
    t = F.lit(today).cast("date")
    off = C.holiday_offsets(cal).where((F.col("date") <= t) & (F.col("start") <= t))
    open_dates = day.select("date").distinct()
    off = off.join(F.broadcast(open_dates), "date", "left_semi").withColumn("wd", F.weekday("date"))
    expected = base.join(F.broadcast(off), [*PERIOD, "wd"])
    got = expected.join(day, ["entity", "date"], "left")
    return got.select(
        *PERIOD, "phase", "offset", "date", "entity",
        (F.coalesce("guests", F.lit(0.0)) / F.col("base")).alias("ratio"),
    )


def ratio_summary(r: DataFrame) -> DataFrame:
    """Statistics over entities per period, phase and offset."""
    r = materialise(r, "ratios")
    keys = [*PERIOD, "phase", "offset"]
    base = r.groupBy(*keys).agg(
        F.avg("ratio").alias("mean_all"), F.stddev_pop("ratio").alias("std"),
        F.count("*").alias("n_total"), F.count_if(F.col("ratio") >= 0.1).alias("n_open"),
    )
    every = grouped_quantiles(r, keys, "ratio", {"p25": 0.25, "impact_all": 0.5, "p75": 0.75})
    opened = grouped_quantiles(r.where("ratio >= 0.1"), keys, "ratio", {"impact_open": 0.5})
    out = base.join(every, keys).join(opened, keys, "left")
    closed = F.col("n_total") - F.col("n_open")
    return out.withColumns(
        {
            "n_closed": closed,
            "pct_closed": closed / F.col("n_total") * 100,
            "impact": F.coalesce("impact_open", "impact_all"),
        }
    )


def holiday_aggregate(summary: DataFrame) -> DataFrame:
    """Mean over the years, weighted by the number of entities; periods that look fully
    closed (no data) are left out."""
    dead = (F.col("phase") == "holiday") & (F.col("pct_closed") >= 99) & F.col("impact_open").isNull()
    any_dead = F.max(F.when(dead, 1).otherwise(0)).over(W.partitionBy(*PERIOD))
    return (
        summary.withColumn("__dead", any_dead).where("__dead = 0")
        .groupBy(F.col("period_type").alias("holiday_type"), "phase", "offset")
        .agg((F.sum(F.col("impact") * F.col("n_total")) / F.sum("n_total")).alias("impact"))
    )


def holiday_per_entity(r: DataFrame) -> DataFrame:
    """Latest ratio per entity, type, phase and offset around the holidays."""
    return (
        r.where("phase <> 'holiday'")
        .groupBy("entity", F.col("period_type").alias("holiday_type"), "phase", "offset")
        .agg(F.max_by("ratio", "start").alias("impact"))
    )


def impact_lookup(per_entity: DataFrame, agg: DataFrame, wanted: DataFrame) -> DataFrame:
    """Entity impact, else the aggregate, else null, for (entity, type, phase, offset)."""
    keys = ["holiday_type", "phase", "offset"]
    own = per_entity.withColumnRenamed("impact", "own")
    return (
        wanted.join(own, ["entity", *keys], "left")
        .join(F.broadcast(agg.withColumnRenamed("impact", "agg")), keys, "left")
        .select("entity", *keys, F.coalesce("own", "agg").alias("impact"))
    )


def _event_days(cal: DataFrame) -> DataFrame:
    """date -> event type on the event day; days before an event carry a null type."""
    on = C.event_on(F.col("date"))["type"]
    before = F.col("event_type").startswith("PRE_")
    return cal.where(on.isNotNull() | before).select("date", on.alias("event"))


def event_impacts(day: DataFrame, cal: DataFrame, min_span: int = 60) -> DataFrame:
    """Guests on an event day / the entity's normal mean of that weekday."""
    span = day.agg(F.datediff(F.max("date"), F.min("date"))).scalar()
    d = day.where(span >= min_span).join(F.broadcast(_event_days(cal)).withColumn("marked", F.lit(True)), "date", "left")
    d = d.withColumn("wd", F.weekday("date"))
    normal = d.where("marked is null").groupBy("entity", "wd").agg(F.avg("guests").alias("normal_avg"))
    ev = d.where("event is not null").join(normal.where("normal_avg > 0"), ["entity", "wd"])
    return ev.select(
        "entity", "date", "event", "guests", "normal_avg", ratio(F.col("guests"), F.col("normal_avg")).alias("impact")
    )


def event_per_entity(imp: DataFrame) -> DataFrame:
    n = F.col("n_years")
    return (
        imp.groupBy("entity", "event")
        .agg(F.avg("impact").alias("factor"), F.count("*").alias("n_years"),
             F.max_by("guests", "date").alias("latest_guests"))
        .withColumn("confidence", F.when(n >= 3, "HIGH").when(n >= 2, "MEDIUM").otherwise("LOW"))
    )


def event_aggregate(imp: DataFrame, min_rows: int = 10) -> DataFrame:
    base = imp.groupBy("event").agg(
        F.count("*").alias("n"), F.avg("normal_avg").alias("normal_avg"), F.avg("guests").alias("event_avg"),
        F.stddev_pop("impact").alias("std"),
    )
    q = grouped_quantiles(imp, ["event"], "impact", {"p25": 0.25, "factor": 0.5, "p75": 0.75})
    cv = F.coalesce(ratio(F.col("std"), F.when(F.col("factor") > 0, F.col("factor"))), F.lit(float("inf")))
    conf = (
        F.when((F.col("n") >= 100) & (F.col("cv") < 0.5), "HIGH")
        .when((F.col("n") >= 50) & (F.col("cv") < 0.8), "MEDIUM").otherwise("LOW")
    )
    return (
        base.join(q, "event").where(F.col("n") >= min_rows).withColumn("cv", cv)
        .withColumn("confidence", conf).drop("std")
    )


def apply_events(horizon: DataFrame, per_entity: DataFrame, agg: DataFrame) -> DataFrame:
    """Event impact on horizon days (entity, date, event_type, holiday_impact):
    entity factor, else aggregate, else as is; days before an event scale their extra."""
    pairs = {}
    for kind, factor, _pre, pre_factor in rules.SPECIAL_EVENTS.values():
        pairs.setdefault(kind, (factor, pre_factor))
    main = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v[0])])
    pre = F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v[1])])
    h = horizon.withColumn("event", F.regexp_replace("event_type", "^PRE_", ""))
    own = per_entity.select("entity", "event", F.col("factor").alias("own"))
    all_ = agg.select("event", F.col("factor").alias("every"))
    h = h.join(own, ["entity", "event"], "left").join(F.broadcast(all_), "event", "left")
    cal = F.coalesce("own", "every")
    m, p = F.try_element_at(main, F.col("event")), F.try_element_at(pre, F.col("event"))
    scaled = F.when(m > 1.0, 1.0 + (p - 1.0) * cal / m).otherwise(p)
    new = F.when(F.col("event_type").startswith("PRE_"), scaled).otherwise(cal)
    return h.withColumns(
        {
            "holiday_impact_source": F.when(F.col("own").isNotNull(), "per_entity")
            .when(F.col("every").isNotNull(), "aggregate").otherwise("default"),
            "holiday_impact": F.when(cal.isNotNull(), new).otherwise(F.col("holiday_impact")),
        }
    ).drop("event", "own", "every")


def closures(day: DataFrame, cal: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(holiday_type, entity) judged closed in at least one period: very few guests, or no
    rows in the period although active in the week before or after."""
    hol = cal.where("holiday_type is not null").select("date")
    normal = day.join(F.broadcast(hol), "date", "left_anti").groupBy("entity").agg(F.avg("guests").alias("norm"))
    p = F.broadcast(C.periods(cal))
    in_period = day.join(p, "date").groupBy(*PERIOD, "entity").agg(F.avg("guests").alias("hol_avg"))
    few = in_period.join(normal, "entity").where(
        (F.col("norm") > 0) & ((F.col("hol_avg") / F.col("norm") <= threshold) | (F.col("hol_avg") <= 1))
    )
    return few.select("period_type", "entity").unionByName(
        closed_no_data(day, cal).select("period_type", "entity")
    ).distinct().withColumnRenamed("period_type", "holiday_type")


def closed_no_data(day: DataFrame, cal: DataFrame, reach: int = 7) -> DataFrame:
    """Entities without rows in a period that others have, but active within a week of it."""
    p = C.periods(cal)
    around = p.select(*PERIOD, "end").distinct()
    before = around.select(*PERIOD, F.explode(F.sequence(F.date_sub("start", reach), F.date_sub("start", 1))).alias("date"))
    after = around.select(*PERIOD, F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", reach))).alias("date"))
    near = day.join(F.broadcast(before.unionByName(after)), "date").select(*PERIOD, "entity").distinct()
    inside = day.join(F.broadcast(p), "date").select(*PERIOD, "entity").distinct()
    someone = inside.select(*PERIOD).distinct()
    return near.join(inside, [*PERIOD, "entity"], "left_anti").join(F.broadcast(someone), PERIOD, "left_semi")


def closure_rates(r: DataFrame) -> DataFrame:
    """Share of a type's holiday dates on which an entity was closed."""
    return r.where("phase = 'holiday'").groupBy("entity", F.col("period_type").alias("holiday_type")).agg(
        F.avg(F.when(F.col("ratio") < 0.1, 1.0).otherwise(0.0)).alias("closure_rate")
    )


def closed_dates(
    horizon: DataFrame, future_close: DataFrame, schedule: DataFrame, closed_types: DataFrame, rates: DataFrame,
    limit: float = 0.80,
) -> DataFrame:
    """State of each closed or half-closed (entity, date) of the horizon, best reason first:
    permanent closing > schedule > earlier closures > closure rate."""
    h = (
        horizon.select("entity", "date", "holiday_type")
        .join(future_close, "entity", "left")
        .join(schedule.select("entity", "date", F.col("status").alias("listed")), ["entity", "date"], "left")
        .join(closed_types.withColumn("pattern", F.lit(True)), ["entity", "holiday_type"], "left")
        .join(rates, ["entity", "holiday_type"], "left")
    )
    gone = F.col("date") >= F.col("future_close_date")
    listed = F.col("listed")
    state = (
        F.when(gone | (listed == "CLOSED"), "CLOSED").when(listed == "HALF_DAY", "HALF_DAY")
        .when(F.col("pattern") | (F.col("closure_rate") > limit), "CLOSED")
    )
    why = (
        F.when(gone, "future_close").when(listed.isNotNull(), "schedule")
        .when(F.col("pattern"), "pattern").when(F.col("closure_rate") > limit, "rate")
    )
    return h.select("entity", "date", state.alias("state"), why.alias("reason")).where("state is not null")
