"""Profiles and forecasts as of many past dates in one pass, from prefix sums.

A row per entity and day carries what the days before it add up to: days, guests, squares, guests
and mornings per weekday, pauses. The profile of a window [sim - lookback, sim) is then the
difference of two such rows, whatever the number of simulations, and no day is copied into the
windows it belongs to. The rows wanted are those of mark dates (each simulation date and the starts
of its windows), which run along in the same sort as rows without guests; a mark stands before the
day's own facts, so nothing from the simulation date on is in its sums.

Sums of whole numbers are exact in doubles up to 2**53. A group is one entity's days, bounded by
the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import clip, ratio
from tidecast.operators import forecast as P
from tidecast.operators import profile
from tidecast.operators.horizon import SHIFTS

#: Days before a simulation at which the halves of its last month begin.
HALVES = (31, 16)
INACTIVE_DAYS, LEAST_DAYS = 30, 7


def day_totals(shift_day: DataFrame) -> DataFrame:
    """Guests of the day and of its morning per entity and date."""
    return shift_day.groupBy("entity", "date").agg(
        F.sum("guests").alias("guests"), F.sum(F.when(F.col("shift") == SHIFTS[0], F.col("guests")).otherwise(0.0)).alias("morning")
    )


def sim_dates(start: str, end: str, step: int) -> Column:
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step} days"))


def cumulated(day: DataFrame, sims: Column, backs: list[int], min_gap: int = rules.MIN_GAP_DAYS) -> DataFrame:
    """(entity, date, c) at every mark: ``c`` holds the sums of the days before it, the last day
    before it and the first one from it on. ``backs`` are days before a simulation."""
    marks = F.array_distinct(F.flatten(F.transform(sims, lambda s: F.array(*[F.date_sub(s, b) for b in backs]))))
    none = F.lit(None).cast("double")
    marked = day.select("entity").distinct().select("entity", F.explode(marks).alias("date"), none.alias("guests"), none.alias("morning"), F.lit(0).alias("fact"))
    rows = day.select("entity", "date", F.col("guests").cast("double").alias("guests"), F.col("morning").cast("double").alias("morning"), F.lit(1).alias("fact"))
    rows = rows.unionByName(marked).withColumn("seen", F.when(F.col("fact") == 1, F.col("date")))
    on = W.partitionBy("entity").orderBy("date", "fact")
    upto = on.rowsBetween(W.unboundedPreceding, W.currentRow)
    # from the other end: the facts of the mark's own date come before it
    back = W.partitionBy("entity").orderBy(F.desc("date"), F.desc("fact")).rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = F.datediff("seen", F.max("seen").over(on.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumns({"gap": F.when(gap >= min_gap, gap), "next": F.min("seen").over(back)})
    g, wd = F.col("guests"), F.weekday("date")
    each = lambda c: [F.coalesce(F.sum(F.when(wd == i, c)).over(upto), F.lit(0.0)) for i in range(7)]
    sums = {
        "n": F.sum("fact").over(upto), "s": F.coalesce(F.sum(g).over(upto), F.lit(0.0)),
        "ss": F.coalesce(F.sum(g * g).over(upto), F.lit(0.0)), "gaps": F.count("gap").over(upto),
        "gap_days": F.coalesce(F.sum("gap").over(upto), F.lit(0)), "gap_end": F.max(F.when(F.col("gap").isNotNull(), F.col("seen"))).over(upto),
        "last": F.max("seen").over(upto), "wn": F.array(*each(F.when(g.isNotNull(), 1.0))), "ws": F.array(*each(g)),
        "wm": F.array(*each(F.col("morning"))),
    }
    c = F.struct(*[v.alias(k) for k, v in sums.items()], F.col("next").alias("next"))
    return rows.withColumn("c", c).where("fact = 0").select("entity", "date", "c")


def profiles(day: DataFrame, start: str, end: str, step: int, lookback: int) -> DataFrame:
    """Profile of every entity as of every simulation date, from the ``lookback`` days before it.

    Columns as in :mod:`profile` (growth, exclusion, category, segment), with ``today`` the day
    before the simulation; ``wd_mean`` and ``wd_morning`` hold mean and morning share by weekday.
    """
    backs = {"now": 0, "far": lookback, "half1": HALVES[0], "half2": HALVES[1]}
    sims = sim_dates(start, end, step)
    cum = cumulated(day, sims, list(backs.values()))
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    roles = []
    for name, b in backs.items():
        sim = F.date_add("date", b)
        wanted = (F.datediff(sim, first) % step == 0) & sim.between(first, last)
        roles.append(F.when(wanted, F.struct(F.lit(name).alias("role"), sim.alias("sim_date"))))
    cum = cum.select("entity", "c", F.inline(F.array_compact(F.array(*roles))))
    p = cum.groupBy("entity", "sim_date").agg(*[F.first(F.when(F.col("role") == r, F.col("c")), ignorenulls=True).alias(r) for r in backs])
    of = lambda role, name: F.col(f"{role}.{name}")
    diff = lambda name, a="now", b="far": of(a, name) - of(b, name)
    between = lambda name: F.zip_with(of("now", name), of("far", name), lambda x, y: x - y)
    p = p.withColumns({"active_days": diff("n"), "guests": diff("s"), "wn": between("wn"), "ws": between("ws"), "wm": between("wm")})
    p = p.where(F.col("active_days") > 0)
    n, avg = F.col("active_days"), F.col("guests") / F.col("active_days")
    spread = F.when(n > 1, F.sqrt(F.greatest(diff("ss") - F.col("guests") * avg, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))).otherwise(0.0)
    mean = lambda a, b: F.coalesce(ratio(diff("s", a, b), diff("n", a, b).cast("double")), F.lit(0.0))
    older, newer = mean("half2", "half1"), mean("now", "half2")
    growth = F.when(older > 0, (newer - older) / F.nullif(older, F.lit(0.0)) * 100).when(newer == 0, 0.0).otherwise(100.0)
    # the pause before the window's first day is not one between two days of the window
    outside = F.datediff("far.next", "far.last")
    outside = F.when(outside >= rules.MIN_GAP_DAYS, outside)
    p = p.withColumns(
        {
            "avg_daily": avg, "std_daily": spread, "growth_30d": growth, "span": F.datediff("now.last", "far.next"),
            "total_gaps": (diff("gaps") - outside.isNotNull().cast("int")), "total_gap_days": diff("gap_days") - F.coalesce(outside, F.lit(0)),
            "gap_end": F.when(F.col("now.gap_end") > F.col("far.next"), F.col("now.gap_end")), "last_date": F.col("now.last"),
        }
    )
    cv = F.coalesce(ratio(F.col("std_daily"), F.when(F.col("avg_daily") > 0, F.col("avg_daily"))), F.lit(999.0))
    p = p.withColumns({"cv": cv, "trend_score": clip(F.col("growth_30d"), -100.0, 100.0), "volume_segment": profile.volume_segment(F.col("avg_daily"))})
    gap_ratio = ratio(F.col("total_gap_days").cast("double"), F.col("span").cast("double"))
    reason = profile.exclude_reason(F.col("span"), gap_ratio, n, F.col("gap_end") >= F.date_sub("sim_date", 4))
    safe = lambda a, b: F.zip_with(a, b, lambda x, y: x / F.nullif(y, F.lit(0.0)))
    return p.select(
        "entity", "sim_date", "active_days", "avg_daily", "std_daily", "cv", "growth_30d", "trend_score", "total_gaps", "total_gap_days",
        F.coalesce(gap_ratio, F.lit(0.0)).alias("gap_ratio"), reason.alias("exclude_reason"), (reason != "OK").alias("should_exclude"),
        profile.category(n, F.col("cv"), F.col("avg_daily")).alias("category"), "volume_segment", "last_date",
        safe(F.col("ws"), F.col("wn")).alias("wd_mean"), safe(F.col("wm"), F.col("ws")).alias("wd_morning"),
    )


def walk_forward(shift_day: DataFrame, cal: DataFrame, start: str, end: str, step: int, lookback: int, horizon: int) -> DataFrame:
    """Forecasts of every simulation beside what came: sim_date, entity, date, shift, pred, actual.

    Entities seen in the last ``INACTIVE_DAYS`` days, with ``LEAST_DAYS`` days of facts and not
    excluded by their profile. Weekday mean, growth, holiday factor, shift shares and the guardrail
    around the weekday mean, all of them as of the simulation date. Calendar impacts are an input.
    """
    p = profiles(day_totals(shift_day), start, end, step, lookback)
    p = p.where((F.col("last_date") >= F.date_sub("sim_date", INACTIVE_DAYS)) & (F.col("active_days") >= LEAST_DAYS) & ~F.col("should_exclude"))
    h = p.withColumn("date", F.explode(F.sequence("sim_date", F.date_add("sim_date", horizon - 1)))).join(cal, "date")
    at = F.weekday("date") + 1
    h = h.withColumns({"avg": F.element_at("wd_mean", at), "share": F.element_at("wd_morning", at), "booking_ratio": F.lit(0.0)})
    h = h.withColumn("combined", F.coalesce("avg", "avg_daily"))
    h = P.holiday_factor(P.growth_adjust(h, F.date_sub("sim_date", 1)))
    h = h.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in SHIFTS])))
    own = F.when(F.col("shift") == SHIFTS[0], F.col("share")).otherwise(1 - F.col("share"))
    share = F.coalesce(own, P.default_share(F.col("shift")))
    h = h.withColumn("forecast", F.greatest(F.lit(0.0), F.bround(F.col("combined") * share, 0)))
    h = P.guard(h, F.coalesce("avg", "avg_daily"), ["entity", "sim_date", "date"])
    actual = shift_day.select("entity", "date", "shift", F.col("guests").alias("actual"))
    return h.select("sim_date", "entity", "date", "shift", F.col("forecast").alias("pred")).join(actual, ["entity", "date", "shift"]).select(
        "sim_date", "entity", "date", "shift", "pred", "actual"
    )
