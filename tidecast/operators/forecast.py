"""Statistical forecasts and the adjustment chain, as column steps over horizon rows.

A chain frame has one row per entity and date: the calendar attributes, the profile columns
(strategy, volume_segment, avg_daily, trend_score, trend_short, caps) and ``combined``, the
daily forecast that each step rewrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import clip, grouped_quantiles, is_weekend
from tidecast.operators.horizon import SHIFTS

# Holidays that bring more guests, default shift shares, opening hours.
HIGH_TRAFFIC = ["LIBERATION_DAY", "LABOR_DAY", "NATIONAL_DAY", "HUNG_KINGS", "TET_DUONG_LICH"]
DEFAULT_SHARES = {"MORNING": 0.45, "EVENING": 0.55}
OPEN_HOURS = (8, 22)


def high_traffic() -> Column:
    return F.coalesce(
        F.col("is_holiday") & F.col("holiday_type").isin(*HIGH_TRAFFIC) & ~F.col("closed_likely"), F.lit(False)
    )


def default_share(shift: Column) -> Column:
    return F.when(shift == "MORNING", DEFAULT_SHARES["MORNING"]).otherwise(DEFAULT_SHARES["EVENING"])


# -- simple forecasts ---------------------------------------------------------------------


def baseline_median(day: DataFrame, horizon: DataFrame) -> DataFrame:
    """Low-volume forecast: weekday median split .45/.55, times the impact of the day."""
    wd = day.groupBy("entity", F.weekday("date").alias("wd")).agg(F.median("guests").alias("m"))
    every = day.groupBy("entity").agg(F.median("guests").alias("m_all"))
    h = horizon.withColumn("wd", F.weekday("date")).join(every, "entity").join(wd, ["entity", "wd"], "left")
    impact = F.when(~F.col("is_holiday"), F.col("holiday_impact")).otherwise(1.0)
    h = h.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in SHIFTS])))
    v = F.coalesce("m", "m_all") * default_share(F.col("shift")) * impact
    return h.withColumn("forecast", F.greatest(F.lit(0.0), F.bround(v, 0))).drop("wd", "m", "m_all")


def weekday_mean(series: DataFrame, horizon: DataFrame, keys: list[str], value: str, last: int = 28) -> DataFrame:
    """Mean of the weekday within a series' last rows, else the mean of those rows."""
    h = horizon.join(weekday_means(series, keys, value, last), keys)
    return h.withColumn("forecast", of_weekday(F.col("date"))).drop("by_weekday", "m_all")


def weekday_means(series: DataFrame, keys: list[str], value: str, last: int = 28) -> DataFrame:
    """One row per series: means of its last rows by weekday (Monday first) and of all of them."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("date")))
    recent = series.withColumn("rn", rn).where(F.col("rn") <= last)
    wd = F.weekday("date")
    by = F.array(*[F.avg(F.when(wd == i, F.col(value))) for i in range(7)])
    return recent.groupBy(*keys).agg(by.alias("by_weekday"), F.avg(value).alias("m_all"))


def of_weekday(date: Column) -> Column:
    """The mean that stands for a date, from :func:`weekday_means`."""
    return F.greatest(F.lit(0.0), F.coalesce(F.get("by_weekday", F.weekday(date)), F.col("m_all")))


def sample_weight(features: DataFrame, base: float = 3.0, high: float = 5.0, volume: float = 15.0) -> DataFrame:
    """Training weight: outlier weight in [.2, 1], weekend evenings x3, busy ones x5."""
    w = clip(F.coalesce("outlier_weight", F.lit(1.0)), 0.2, 1.0)
    we = (F.col("is_weekend") == 1) & (F.col("shift") == "EVENING")
    boost = F.when(we & (F.col("guests") > volume), high).when(we, base).otherwise(1.0)
    return features.withColumn("sample_weight", w * boost)


# -- combination ----------------------------------------------------------------------------


def strategy_weights(profile: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """ml_weight and ai_weight by strategy; learned weights of an entity win."""
    ml = F.create_map(*[F.lit(x) for k, v in rules.STRATEGY_WEIGHTS.items() for x in (k, v[0])])
    ai = F.create_map(*[F.lit(x) for k, v in rules.STRATEGY_WEIGHTS.items() for x in (k, v[1])])
    p = profile
    a = F.coalesce(F.try_element_at(ml, F.col("strategy")), F.lit(0.5))
    b = F.coalesce(F.try_element_at(ai, F.col("strategy")), F.lit(0.5))
    if learned is None:
        return p.withColumns({"ml_weight": a, "ai_weight": b})
    p = p.join(learned.select("entity", F.col("ml_weight").alias("__ml"), F.col("ai_weight").alias("__ai")), "entity", "left")
    return p.withColumns({"ml_weight": F.coalesce("__ml", a), "ai_weight": F.coalesce("__ai", b)}).drop("__ml", "__ai")


def blend(df: DataFrame) -> DataFrame:
    """Weighted mean of the sources that are there (ml, neural, seasonal, ai)."""
    a, b, c = rules.ML_SHARES
    parts = [("ml", "ml_weight", a), ("neural", "ml_weight", b), ("seasonal", "ml_weight", c), ("ai", "ai_weight", 1.0)]
    total, value = F.lit(0.0), F.lit(0.0)
    for name, w, share in parts:
        there = F.col(name) >= 0
        total = total + F.when(there, F.col(w) * share).otherwise(0.0)
        # value * weight * share from the left: another order moves halves across the rounding
        value = value + F.when(there, F.col(name) * F.col(w) * share).otherwise(0.0)
    return df.withColumn("combined", F.when(total > 0, F.greatest(F.lit(0.0), value / F.nullif(total, F.lit(0.0)))))


def blend_or_zero(df: DataFrame) -> DataFrame:
    """The blend for every row: 0 where no source has a value."""
    return blend(df).withColumn("combined", F.coalesce("combined", F.lit(0.0)))


def growth_adjust(df: DataFrame, today: str | Column) -> DataFrame:
    """Weekly growth from the trend score, limited to 15 % either way. ``today``: a date, or the
    column that holds one for each row."""
    days = F.datediff("date", today if isinstance(today, Column) else F.lit(today).cast("date"))
    f = clip(1 + F.col("trend_score") / 2000 * (days / 7), 0.85, 1.15)
    return df.withColumn("combined", F.when(days > 0, F.col("combined") * f).otherwise(F.col("combined")))


def trend_adjust(df: DataFrame) -> DataFrame:
    t = F.col("trend_short")
    f = F.when(t > 1.1, clip(t, 1.05, 1.15)).when(t < 0.9, clip(t, 0.85, 0.95)).otherwise(1.0)
    return df.withColumn("combined", F.col("combined") * f)


def _curve() -> Column:
    m = None
    for seg, curve in rules.HOLIDAY_CURVES.items():
        c = F.create_map(*[F.lit(x) for k, v in curve.items() for x in (k, v)])
        hit = F.when(F.col("volume_segment") == seg, F.try_element_at(c, F.col("days_to_holiday")))
        m = hit if m is None else F.coalesce(m, hit)
    return m


def holiday_factor(df: DataFrame, booking_limit: float = 1.5) -> DataFrame:
    """Adds holiday_factor and applies it: busy holidays, then bookings, then the volume
    curve, then the plain impact; closing holidays are left to the closure rules."""
    busy, impact, window = high_traffic(), F.col("holiday_impact"), F.col("is_holiday_window")
    ratio = F.coalesce("booking_ratio", F.lit(0.0))
    f = (
        F.when(busy & (impact != 1.0), F.greatest(F.lit(1.0), impact))
        .when(window & (ratio > booking_limit), F.greatest(F.lit(1.0), ratio * 0.8))
        .when(window & _curve().isNotNull(), _curve())
        .when((impact != 1.0) & ~F.col("is_holiday"), impact)
        .otherwise(1.0)
    )
    out = df.withColumn("holiday_factor", f)
    apply = busy | ~F.col("is_holiday")
    return out.withColumn("combined", F.when(apply, F.col("combined") * F.col("holiday_factor")).otherwise(F.col("combined")))


def _cap(relax: bool) -> Column:
    """Cap of a day: the type's own maximum, else the normal one (relaxed on busy holidays)."""
    own = F.coalesce(
        F.when(F.col("is_holiday"), F.try_element_at("max_by_special", F.col("holiday_type"))),
        F.when(F.col("is_special_event"), F.try_element_at("max_by_special", F.col("event_type"))),
    )
    normal = F.when(is_weekend(F.col("date")), F.col("max_daily_normal_weekend")).otherwise(F.col("max_daily_normal_weekday"))
    if relax:
        normal = F.when(high_traffic(), normal * F.greatest(F.lit(1.0), F.col("holiday_factor"))).otherwise(normal)
    return F.coalesce(own, normal)


def _floor() -> Column:
    plain = ~F.col("is_holiday") & ~F.col("is_special_event")
    lo = F.when(is_weekend(F.col("date")), F.col("min_daily_normal_weekend")).otherwise(F.col("min_daily_normal_weekday"))
    return F.when(plain & (lo > 0), lo)


def cap_floor(df: DataFrame) -> DataFrame:
    """At most the historic maximum of such days; ordinary days at least the minimum."""
    cap = _cap(True)
    v = F.when(cap > 0, F.least(F.col("combined"), cap)).otherwise(F.col("combined"))
    return df.withColumn("combined", F.greatest(v, F.coalesce(_floor(), v)))


def percentiles(shift: DataFrame, min_rows: int = 3) -> tuple[DataFrame, DataFrame]:
    """P95 of the day per weekday, P20 and P95 per weekday and shift."""
    s = shift.withColumn("wd", F.weekday("date"))
    by_shift = s.groupBy("entity", "wd", "shift").agg(
        F.count("*").alias("n"), F.percentile("guests", F.array(F.lit(0.20), F.lit(0.95))).alias("q")
    ).where(F.col("n") >= min_rows).select("entity", "wd", "shift", F.col("q")[0].alias("p20"), F.col("q")[1].alias("p95"))
    day = s.groupBy("entity", "wd", "date").agg(F.sum("guests").alias("guests"))
    by_day = day.groupBy("entity", "wd").agg(
        F.count("*").alias("n"), F.percentile("guests", F.lit(0.95)).alias("day_p95")
    ).where(F.col("n") >= min_rows).select("entity", "wd", "day_p95")
    return by_day, by_shift


def p95_clip(df: DataFrame, by_day: DataFrame, value: str) -> DataFrame:
    """Daily model value limited to the weekday's P95."""
    j = df.withColumn("wd", F.weekday("date")).join(by_day, ["entity", "wd"], "left")
    v = F.when(F.col("day_p95") > 0, F.least(F.col(value), F.col("day_p95"))).otherwise(F.col(value))
    return j.withColumn(value, v).drop("wd", "day_p95")


def shift_split(df: DataFrame, hist: DataFrame, by_shift: DataFrame) -> DataFrame:
    """Daily forecast to shifts. ``ml_morning``/``ml_evening`` hold the model's shift values
    (or null), ``hist`` the weekday shares (entity, weekday, shift, ratio)."""
    h = hist.groupBy("entity", "weekday").agg(
        F.max(F.when(F.col("shift") == "MORNING", F.col("ratio"))).alias("hm"),
        F.max(F.when(F.col("shift") == "EVENING", F.col("ratio"))).alias("he"),
    )
    d = df.withColumn("weekday", F.date_format("date", "EEEE")).join(h, ["entity", "weekday"], "left")
    total = F.col("ml_morning") + F.col("ml_evening")
    mm = F.when(total > 0, F.col("ml_morning") / F.nullif(total, F.lit(0.0)))
    me = 1 - mm
    have_h = F.coalesce("hm", "he").isNotNull()
    hm = F.when(have_h, F.coalesce("hm", F.lit(0.5)))
    he = F.when(have_h, F.coalesce("he", F.lit(0.5)))
    # Spread of the two model shares: std / mean of (mm, 1 - mm).
    cv = F.abs(mm - 0.5) / 0.5
    t = (cv - 0.15) / 0.15
    alpha = F.when(cv < 0.15, 0.7).when(cv > 0.30, 0.3).otherwise(0.7 * (1 - t) + 0.3 * t)
    bm, be = alpha * mm + (1 - alpha) * hm, alpha * me + (1 - alpha) * he
    both = mm.isNotNull() & have_h
    only_h = F.when(have_h, F.struct(F.coalesce("hm", F.lit(0.5)).alias("m"), F.coalesce("he", F.lit(0.5)).alias("e")))
    shares = F.coalesce(
        F.when(both, F.struct((bm / (bm + be)).alias("m"), (be / (bm + be)).alias("e"))),
        F.when(mm.isNotNull(), F.struct(mm.alias("m"), me.alias("e"))),
        only_h,
        F.struct(F.lit(DEFAULT_SHARES["MORNING"]).alias("m"), F.lit(DEFAULT_SHARES["EVENING"]).alias("e")),
    )
    d = d.withColumn("shares", shares).withColumn("shift", F.explode(F.array(*[F.lit(s) for s in SHIFTS])))
    share = F.when(F.col("shift") == "MORNING", F.col("shares.m")).otherwise(F.col("shares.e"))
    d = d.withColumn("wd", F.weekday("date")).join(by_shift, ["entity", "wd", "shift"], "left")
    v = F.greatest(F.lit(0.0), F.bround(F.col("combined") * share, 0))
    p95 = F.when(high_traffic(), F.col("p95") * F.greatest(F.lit(1.0), F.col("holiday_factor"))).otherwise(F.col("p95"))
    v = F.when((p95 > 0) & (v > p95), F.floor(p95).cast("double")).otherwise(v)
    plain = ~F.col("is_holiday") & ~F.col("is_special_event")
    v = F.when(plain & (F.col("p20") > 0) & (v < F.col("p20")), F.floor("p20").cast("double")).otherwise(v)
    return d.withColumns({"share": share, "forecast": v}).drop("hm", "he", "shares", "wd", "p20", "p95")


def chain(df: DataFrame, today: str, long_horizon: bool = False) -> DataFrame:
    """Blend and adjust; the long horizon leaves out the trend step and stays daily."""
    d = growth_adjust(blend_or_zero(df), today)
    d = d if long_horizon else trend_adjust(d)
    return cap_floor(holiday_factor(d))


def daily_only(df: DataFrame, today: str) -> DataFrame:
    """Long horizon: one row per day."""
    return chain(df, today, long_horizon=True).withColumn("forecast", F.bround("combined", 0))


def route(profile: DataFrame, horizon: DataFrame, start: str, short_days: int = 30) -> DataFrame:
    """Which forecast serves an entity and date."""
    r = (
        F.when((F.col("category") == "NEW") | (F.col("active_days") < rules.NEW_DAYS), "chain_blend")
        .when(F.col("volume_segment") == "LOW_VOLUME", "baseline").otherwise("ensemble")
    )
    near = F.datediff("date", F.lit(start).cast("date")) < short_days
    kind = F.when(near, "short").otherwise("long")
    p = profile.where("not should_exclude or category = 'NEW'").select("entity", r.alias("route"))
    return horizon.join(p, "entity").withColumn("span", kind)


def confidence(df: DataFrame) -> DataFrame:
    """0-1 score from models used, data confidence, active days and spread."""
    n, c, d, cv = F.col("n_models"), F.col("confidence"), F.col("active_days"), F.col("cv")
    s = (
        F.lit(0.5) + F.when(n >= 4, 0.15).when(n >= 2, 0.10).when(n >= 1, 0.05).otherwise(0.0)
        + F.when(c == "HIGH", 0.15).when(c == "MEDIUM", 0.05).when(c == "LOW", -0.10).otherwise(0.0)
        + F.when(d > 60, 0.10).when(d > 30, 0.05).when(d < 14, -0.15).otherwise(0.0)
        + F.when(cv > 0.8, -0.10).when(cv > 0.5, -0.05).otherwise(0.0)
    )
    return df.withColumn("confidence_score", clip(s, 0.0, 1.0))


# -- after the corrections ---------------------------------------------------------------------


def _scale_day(df: DataFrame, factor: Column) -> DataFrame:
    v = F.greatest(F.lit(0.0), F.bround(F.col("forecast") * factor, 0))
    return df.withColumn("forecast", F.when(factor.isNotNull(), v).otherwise(F.col("forecast"))).drop("__day")


def _with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("__day", F.sum("forecast").over(W.partitionBy("entity", "date")))


def final_cap(df: DataFrame) -> DataFrame:
    """Scale a day's shifts so that their total respects the cap, then the floor."""
    own = F.coalesce(
        F.when(F.col("is_holiday"), F.try_element_at("max_by_special", F.col("holiday_type"))),
        F.when(F.col("is_special_event"), F.try_element_at("max_by_special", F.col("event_type"))),
    )
    busy = F.coalesce(F.col("is_holiday") & F.col("holiday_type").isin(*HIGH_TRAFFIC), F.lit(False))
    normal = F.when(busy, F.col("max_daily_normal") * F.greatest(F.lit(1.0), F.col("holiday_impact"))).otherwise(F.col("max_daily_normal"))
    cap = F.coalesce(own, normal)
    d = F.col("__day")
    over = F.when((cap > 0) & (d > cap), cap / F.nullif(d, F.lit(0.0)))
    low = _floor()
    under = F.when((d > 0) & (d < low), low / F.greatest(d, F.lit(1.0)))
    return _scale_day(_with_day(df), F.coalesce(over, under))


def guardrail(df: DataFrame, weekday_avg: DataFrame) -> DataFrame:
    """Ordinary days stay near the weekday mean: 80-135 % for busy entities (never pulled
    down), 85-120 % for the others. ``weekday_avg``: entity, weekday, avg."""
    j = df.withColumn("weekday", F.date_format("date", "EEEE")).join(weekday_avg, ["entity", "weekday"], "left")
    return guard(j, F.coalesce("avg", "avg_daily"), ["entity", "date"]).drop("avg")


def guard(df: DataFrame, base: Column, day: list[str]) -> DataFrame:
    """Keeps ordinary days near ``base``; the shifts of a day share the key columns ``day``."""
    j, d = df.withColumn("__day", F.sum("forecast").over(W.partitionBy(*day))), F.col("__day")
    big = F.col("avg_daily") >= 100
    lo = F.when(big, base * 0.80).otherwise(base * 0.85)
    hi = F.when(big, base * 1.35).otherwise(base * 1.20)
    plain = ~F.col("is_holiday") & ~F.col("is_special_event") & (d > 0) & (base > 0)
    out = (d > hi) | (d < lo)
    f = F.when(plain & out & ~(big & (d > base)), clip(d, lo, hi) / F.nullif(d, F.lit(0.0)))
    return _scale_day(j, f)


def half_day(df: DataFrame, closed: DataFrame) -> DataFrame:
    """Half on half days, zero on closed days (entity, date, state)."""
    j = df.join(closed.select("entity", "date", "state"), ["entity", "date"], "left")
    f = F.col("forecast")
    v = F.when(F.col("state") == "CLOSED", 0.0).when(F.col("state") == "HALF_DAY", F.bround(f * 0.5, 0)).otherwise(f)
    return j.withColumn("forecast", v)


# -- entities of a chain --------------------------------------------------------------------------


def siblings(day: DataFrame, chain_dim: DataFrame, min_days: int = 30) -> DataFrame:
    """Entity, its chain and whether it is an active sibling for the others (>= min_days)."""
    n = day.groupBy("entity").agg(F.count("*").alias("days"))
    c = chain_dim.where("chain is not null").join(n, "entity", "left").fillna(0, ["days"])
    return c.select("entity", "chain", "days", (F.col("days") >= min_days).alias("is_sibling"))


def chain_patterns(hourly: DataFrame, sib: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per chain, from its siblings: level (median of entity means), weekday multipliers
    (medians scaled to a mean of 1), hour shares. ``hourly``: entity, date, hour, guests."""
    s = sib.where("is_sibling").select("entity", "chain")
    h = hourly.join(s, "entity")
    day = h.groupBy("chain", "entity", "date").agg(F.sum("guests").alias("guests"))
    means = day.groupBy("chain", "entity").agg(F.avg("guests").alias("m"))
    level = grouped_quantiles(means, ["chain"], "m", {"chain_avg": 0.5})
    level = level.join(means.groupBy("chain").agg(F.count("*").alias("n_siblings")), "chain")
    wd = grouped_quantiles(day.withColumn("wd", F.weekday("date")), ["chain", "wd"], "guests", {"m": 0.5})
    per = W.partitionBy("chain")
    mult = wd.select("chain", "wd", (F.col("m") / F.nullif(F.sum("m").over(per), F.lit(0.0)) * 7).alias("multiplier"))
    kind = F.when(is_weekend(F.col("date")), "weekend").otherwise("weekday")
    hr = h.groupBy("chain", kind.alias("day_kind"), "hour").agg(F.sum("guests").alias("v"))
    k = W.partitionBy("chain", "day_kind")
    hr = hr.withColumn("r", F.col("v") / F.nullif(F.sum("v").over(k), F.lit(0.0))).where(F.col("r") > 0.005)
    # added up by the hour, so that reruns agree to the last bit
    total = F.sum("r").over(k.orderBy("hour").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    hours = hr.select("chain", "day_kind", "hour", (F.col("r") / total).alias("ratio"))
    return level, mult, hours


def chain_blend(
    targets: DataFrame, own: DataFrame, level: DataFrame, mult: DataFrame, hours: DataFrame, own_hours: DataFrame,
    horizon: DataFrame, full_days: int = rules.NEW_DAYS,
) -> DataFrame:
    """New entities: own mean and chain level mixed by days of own data, spread over hours.

    targets: entity, chain; own: entity, own_avg, own_days; own_hours as ``hour_ratio``.
    """
    t = targets.join(own, "entity", "left").fillna(0, ["own_avg", "own_days"])
    t = t.join(level, "chain", "left").withColumn("w", F.least(F.lit(1.0), F.col("own_days") / full_days))
    h = horizon.join(t, "entity").withColumn("wd", F.weekday("date")).join(mult, ["chain", "wd"], "left")
    chain_day = F.col("chain_avg") * F.coalesce("multiplier", F.lit(1.0))
    total = F.when(F.col("chain_avg").isNotNull(), F.col("w") * F.col("own_avg") + (1 - F.col("w")) * chain_day).otherwise(F.col("own_avg"))
    total = F.when(F.col("is_holiday"), total * F.col("holiday_impact")).otherwise(total)
    kind = F.when(is_weekend(F.col("date")), "weekend").otherwise("weekday")
    h = h.withColumns({"daily": total, "day_kind": kind})
    # Hour shares: own and chain shares mixed with the same weight, then scaled to 1.
    slots = t.select("entity", "chain", "w", F.explode(F.array(F.lit("weekday"), F.lit("weekend"))).alias("day_kind"))
    slots = slots.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    mix = (
        slots.join(hours.withColumnRenamed("ratio", "cr"), ["chain", "day_kind", "hour"], "left")
        .join(own_hours.withColumnRenamed("ratio", "orr"), ["entity", "day_kind", "hour"], "left")
        .withColumn("x", F.col("w") * F.coalesce("orr", F.lit(0.0)) + (1 - F.col("w")) * F.coalesce("cr", F.lit(0.0)))
    )
    per = W.partitionBy("entity", "day_kind").orderBy("hour").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flat = F.lit(1.0 / (OPEN_HOURS[1] - OPEN_HOURS[0] + 1))
    share = F.coalesce(F.col("x") / F.nullif(F.sum("x").over(per), F.lit(0.0)), flat)
    mix = mix.select("entity", "day_kind", "hour", share.alias("ratio")).where(F.col("hour").between(*OPEN_HOURS))
    out = h.join(mix, ["entity", "day_kind"])
    return out.select(
        "entity", "chain", "date", "hour", F.col("w").alias("own_weight"), "daily",
        F.greatest(F.lit(0.0), F.bround(F.col("daily") * F.col("ratio"), 0)).alias("forecast"),
        F.when(F.col("chain_avg").isNotNull(), "CHAIN_BLEND").otherwise("OWN_DATA_ONLY").alias("method"),
    )


def future_open(openings: DataFrame, day: DataFrame, horizon: DataFrame) -> DataFrame:
    """Openings inside the horizon: forecast days from the opening date on; entities that
    already have facts are marked as graduates (served by the ensemble)."""
    h = horizon.join(openings, "entity").where(F.col("date") >= F.col("opening_date"))
    seen = day.select("entity").distinct().withColumn("graduate", F.lit(True))
    return h.join(seen, "entity", "left").withColumn("graduate", F.coalesce("graduate", F.lit(False)))


# -- item line ---------------------------------------------------------------------------------------


def item_shift(item_pred: DataFrame, ratios: DataFrame) -> DataFrame:
    """Daily item forecasts to shifts by the item's shares (.45/.55 where unknown). ``item_pred``: a row
    per series with its ``days`` (date, forecast); days and shifts are unfolded behind the join."""
    of = [F.max(F.when(F.col("shift") == s, F.col("ratio"))).alias(s) for s in SHIFTS]
    j = item_pred.join(ratios.groupBy("entity", "item").agg(*of), ["entity", "item"], "left")
    shares = F.array(*[F.struct(F.lit(s).alias("shift"), F.coalesce(F.col(s), default_share(F.lit(s))).alias("share")) for s in SHIFTS])
    d = j.select("entity", "item", shares.alias("shares"), F.inline("days"))
    d = d.select("entity", "item", "date", "forecast", F.inline("shares"))
    return d.withColumn("forecast", F.greatest(F.lit(0.0), F.bround(F.col("forecast") * F.col("share"), 0))).drop("share")


def guest_shift(guest_shift_facts: DataFrame, horizon: DataFrame, ratios: DataFrame, min_rows: int = 14) -> DataFrame:
    """Guests and transactions per shift: the shift's own weekday mean with enough rows of
    every shift, else the daily mean split by the weekday shares."""
    s = guest_shift_facts
    counts = s.groupBy("entity").agg(
        F.count_if(F.col("shift") == "MORNING").alias("nm"), F.count_if(F.col("shift") == "EVENING").alias("ne"),
        (F.sum("guests") / F.nullif(F.sum("transactions"), F.lit(0))).alias("per_txn"),
    )
    own = counts.withColumn("own", (F.col("nm") >= min_rows) & (F.col("ne") >= min_rows)).select("entity", "own", "per_txn")
    h = horizon.join(own, "entity").withColumn("shift", F.explode(F.array(*[F.lit(x) for x in SHIFTS])))
    a = weekday_mean(s, h.where("own"), ["entity", "shift"], "guests")
    day = s.groupBy("entity", "date").agg(F.sum("guests").alias("guests"))
    b = weekday_mean(day, h.where("not own"), ["entity"], "guests")
    r = ratios.withColumnRenamed("ratio", "share")
    b = b.withColumn("weekday", F.date_format("date", "EEEE")).join(r, ["entity", "weekday", "shift"], "left")
    b = b.withColumn("forecast", F.col("forecast") * F.coalesce("share", default_share(F.col("shift")))).drop("weekday", "share")
    out = a.unionByName(b).withColumn("forecast", F.bround("forecast", 0))
    return out.withColumn("transactions", F.bround(F.col("forecast") / F.greatest("per_txn", F.lit(1.0)), 0)).drop("per_txn")


def booking_ratio(df: DataFrame, booking_day: DataFrame) -> DataFrame:
    """Booking ratio of horizon rows against the entity's mean day."""
    j = df.join(booking_day, ["entity", "date"], "left")
    return j.withColumn("booking_ratio", F.coalesce(F.col("booking_guests") / F.nullif(F.col("avg_daily"), F.lit(0.0)), F.lit(0.0)))


