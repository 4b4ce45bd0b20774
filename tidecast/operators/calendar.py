"""Calendar dimension: one row per date, so every table here is bounded by the date range."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules

TET = "TET_NGUYEN_DAN"


def classify(cal: DataFrame) -> DataFrame:
    """Holiday name -> holiday type (null on ordinary days)."""
    name = F.lower("holiday_name")
    kind = F.when(F.col("holiday_name").isNull(), F.lit(None).cast("string"))
    for words, t in rules.HOLIDAY_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | name.contains(w)
        kind = kind.when(hit, t)
    return cal.withColumn("holiday_type", kind.otherwise("TET_DUONG_LICH"))


def _event_map() -> Column:
    pairs = []
    for day, (kind, factor, pre, pre_factor) in rules.SPECIAL_EVENTS.items():
        pairs += [F.lit(day), F.struct(F.lit(kind).alias("type"), F.lit(factor).alias("factor"),
                                       F.lit(pre).alias("pre_days"), F.lit(pre_factor).alias("pre_factor"))]
    return F.create_map(*pairs)


def event_on(date: Column) -> Column:
    """Event rule of a date (struct type, factor, pre_days, pre_factor) or null."""
    return F.try_element_at(_event_map(), F.date_format(date, "MM-dd"))


def events(cal: DataFrame) -> DataFrame:
    """Adds event_type and event_impact: the event day, the days before it, mid-autumn."""
    d = F.col("date")
    on, one, two = event_on(d), event_on(F.date_add(d, 1)), event_on(F.date_add(d, 2))
    autumn = (F.col("lunar_month") == 8) & (F.col("lunar_day") == 15)

    def pick(main, before, moon):
        return (
            F.when(on.isNotNull(), main(on))
            .when(one["pre_days"] >= 1, before(one))
            .when(two["pre_days"] >= 2, before(two))
            .when(autumn, F.lit(moon))
        )

    return cal.withColumns(
        {
            "event_type": pick(lambda e: e["type"], lambda e: F.concat(F.lit("PRE_"), e["type"]), rules.MID_AUTUMN[0]),
            "event_impact": F.coalesce(
                pick(lambda e: e["factor"], lambda e: e["pre_factor"], rules.MID_AUTUMN[1]), F.lit(1.0)
            ),
        }
    )


def _default_factor(kind: Column) -> Column:
    m = F.create_map(*[F.lit(x) for k, v in rules.HOLIDAY_TYPES.items() for x in (k, v[0])])
    return F.try_element_at(m, kind)


def _line(start: float, days: Column, change: float) -> Column:
    """start + days * change in decimals: in doubles 0.9 + 2 * 0.025 is not 0.95."""
    return (F.lit(Decimal(str(start))) + days * F.lit(Decimal(str(change)))).cast("double")


def _steps(o, steps):
    """Piecewise line over days ``o`` from 1: (last day, start, change per day) of each step."""
    out, first = None, 1
    for last, start, change in steps:
        line = _line(start, o - first, change)
        if last is None:
            return line if out is None else out.otherwise(line)
        out = F.when(o <= last, line) if out is None else out.when(o <= last, line)
        first = last + 1
    return out


def day_info(cal: DataFrame, impacts: DataFrame | None = None) -> DataFrame:
    """Pre/post holiday attributes: the nearest holiday ahead (Tet 14 days, others 5), else
    the nearest behind (Tet 7, others 5). ``impacts`` (holiday_type, phase, offset, impact)
    replaces the default factors on holidays and around Tet."""
    h = cal.where("holiday_type is not null").select(
        F.col("date").alias("h"), F.col("holiday_type").alias("near_type")
    )
    reach = h.withColumn("o", F.explode(F.sequence(F.lit(-7), F.lit(14)))).where(
        "o <> 0 and (near_type = 'TET_NGUYEN_DAN' or abs(o) <= 5)"
    )
    near = reach.groupBy(F.expr("date_sub(h, o)").alias("date")).agg(
        F.min(F.when(F.col("o") > 0, F.struct("o", "near_type"))).alias("ahead"),
        F.min(F.when(F.col("o") < 0, F.struct((-F.col("o")).alias("o"), "near_type"))).alias("behind"),
    )
    c = cal.join(F.broadcast(near), "date", "left")
    hol = F.col("holiday_type").isNotNull()
    pre = ~hol & F.col("ahead").isNotNull()
    post = ~hol & F.col("ahead").isNull() & F.col("behind").isNotNull()
    o = F.when(pre, F.col("ahead.o")).when(post, F.col("behind.o"))
    tet = F.when(pre, F.col("ahead.near_type")).when(post, F.col("behind.near_type")) == TET
    c = c.withColumns(
        {
            "is_holiday": hol,
            "is_pre_holiday": pre,
            "is_post_holiday": post,
            "pre_post_type": F.when(pre, F.when(tet, "PRE_TET").otherwise("PRE_HOLIDAY"))
            .when(post, F.when(tet, "POST_TET").otherwise("POST_HOLIDAY")),
            "days_to_holiday": F.when(pre, -o).when(post, o).otherwise(0),
            "is_holiday_window": hol | F.coalesce((pre | post) & (o <= 3), F.lit(False)),
            "is_special_event": F.col("event_type").isNotNull(),
            "closed_likely": F.coalesce(F.col("holiday_type") == TET, F.lit(False)),
            "is_veg": F.col("lunar_day").isin(1, 15),
        }
    )
    pre_tet = _steps(o, rules.PRE_TET_STEPS)
    pre_any = F.when(o <= 2, rules.HOLIDAY_TYPES["PRE_HOLIDAY"][0]).otherwise(_line(1.0, 5 - o, 0.025))
    post_tet = _steps(o, rules.POST_TET_STEPS)
    post_any = F.when(o <= 2, rules.HOLIDAY_TYPES["POST_HOLIDAY"][0]).otherwise(_line(0.90, o - 1, 0.025))
    default = (
        F.when(hol, _default_factor(F.col("holiday_type")))
        .when(pre & tet, pre_tet).when(post & tet, post_tet)
        .when(F.col("is_special_event"), F.col("event_impact"))
        .when(pre, pre_any).when(post, post_any).otherwise(1.0)
    )
    c = c.withColumn("holiday_impact", default).drop("ahead", "behind")
    return c if impacts is None else apply_impacts(c, impacts)


def apply_impacts(cal: DataFrame, impacts: DataFrame) -> DataFrame:
    """Calibrated factors over the defaults; labour day uses the period it belongs to."""
    labor = impacts.where("holiday_type = 'LABOR_DAY'").select(F.lit(1).alias("__own")).limit(1)
    own_labor = labor.exists()
    kind = (
        F.when((F.col("holiday_type") == "LABOR_DAY") & ~own_labor, "LIBERATION_DAY")
        .when(F.col("is_holiday"), F.col("holiday_type"))
        .when(F.col("pre_post_type").isin("PRE_TET", "POST_TET"), TET)
    )
    phase = F.when(F.col("is_holiday"), "holiday").when(F.col("is_pre_holiday"), "pre").when(
        F.col("is_post_holiday"), "post"
    )
    keyed = cal.withColumns({"__t": kind, "__p": phase, "__o": F.abs("days_to_holiday")})
    look = impacts.select(
        F.col("holiday_type").alias("__t"), F.col("phase").alias("__p"), F.col("offset").alias("__o"),
        F.col("impact").alias("__new"),
    )
    out = keyed.join(F.broadcast(look), ["__t", "__p", "__o"], "left")
    changed = F.col("__new").isNotNull() & (F.col("__new") != F.col("holiday_impact"))
    return out.withColumns(
        {
            "holiday_impact_source": F.when(changed, "calibrated").otherwise("default"),
            "holiday_impact_default": F.col("holiday_impact"),
            "holiday_impact": F.when(changed, F.col("__new")).otherwise(F.col("holiday_impact")),
        }
    ).drop("__t", "__p", "__o", "__new")


def periods(cal: DataFrame) -> DataFrame:
    """Holiday dates with their period: same type at most two days apart, per year; the
    30 April and 1 May holidays form one period. One row per holiday date."""
    pair = F.col("holiday_type").isin("LIBERATION_DAY", "LABOR_DAY")
    h = (
        cal.where("holiday_type is not null")
        .withColumn("year", F.year("date"))
        .withColumn("__g", F.when(pair, "PAIR").otherwise(F.col("holiday_type")))
    )
    by = W.partitionBy("year").orderBy("date")
    new = F.when(
        (F.lag("__g").over(by) == F.col("__g")) & (F.datediff("date", F.lag("date").over(by)) <= 2), 0
    ).otherwise(1)
    h = h.withColumn("__new", new).withColumn("__island", F.sum("__new").over(by))
    isl = W.partitionBy("year", "__island")
    kind = F.when(F.col("__g") == "PAIR", "LIBERATION_DAY").otherwise(F.col("holiday_type"))
    return h.select(
        kind.alias("period_type"),
        "year",
        F.min("date").over(isl).alias("start"),
        F.max("date").over(isl).alias("end"),
        "date",
    )


def group_holidays(cal: DataFrame) -> DataFrame:
    """One row per period."""
    p = periods(cal)
    return p.groupBy("period_type", "year", "start", "end").agg(F.count("*").alias("n_dates")).withColumn(
        "duration", F.datediff("end", "start") + 1
    )


def windows_of(kind: Column) -> tuple[Column, Column]:
    pre = F.lit(rules.CAL_WINDOW_DEFAULT[0])
    post = F.lit(rules.CAL_WINDOW_DEFAULT[1])
    for t, (a, b) in rules.CAL_WINDOWS.items():
        pre = F.when(kind == t, a).otherwise(pre)
        post = F.when(kind == t, b).otherwise(post)
    return pre, post


def holiday_offsets(cal: DataFrame) -> DataFrame:
    """(period_type, year, start, end, phase, offset, date) around and inside each period."""
    p = periods(cal)
    inside = p.select(
        "period_type", "year", "start", "end", F.lit("holiday").alias("phase"), F.lit(0).alias("offset"), "date"
    )
    one = p.select("period_type", "year", "start", "end").distinct()
    pre, post = windows_of(F.col("period_type"))
    before = one.withColumn("offset", F.explode(F.sequence(F.lit(1), pre))).select(
        "period_type", "year", "start", "end", F.lit("pre").alias("phase"), "offset",
        F.expr("date_sub(start, offset)").alias("date"),
    )
    after = one.withColumn("offset", F.explode(F.sequence(F.lit(1), post))).select(
        "period_type", "year", "start", "end", F.lit("post").alias("phase"), "offset",
        F.expr("date_add(end, offset)").alias("date"),
    )
    return inside.unionByName(before).unionByName(after)


def forecast_days(cal: DataFrame, start: str, n: int) -> DataFrame:
    s = F.lit(start).cast("date")
    return cal.where((F.col("date") >= s) & (F.col("date") < F.date_add(s, n)))


def horizon_end(ref: Column, months: int = 3) -> Column:
    """Last day of the month ``months`` after ``ref``."""
    return F.last_day(F.add_months(ref, months))


def merge_ranges(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or adjacent date ranges of a key become one range."""
    by = W.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(F.col(start) <= F.date_add(before, 1), 0).otherwise(1)
    marked = ranges.withColumn("__new", new).withColumn("__i", F.sum("__new").over(by))
    return marked.groupBy(*keys, "__i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__i")
