"""Entity profiles from daily facts: growth, gaps, outliers, caps, category.

Input is one row per entity and day, so each entity's group is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import clip, grouped_quantiles, is_weekend, ratio
from tidecast.operators.calendar import event_on

def _per():
    return W.partitionBy("entity")


def growth(day: DataFrame, today: str, windows=(30, 60, 90)) -> DataFrame:
    """Change between the halves of the last N days, trend label and clipped score."""
    ref = F.greatest(F.max("date").over(_per()), F.lit(today).cast("date"))
    ago = F.datediff(ref, "date")
    d = day.select("entity", "guests", ago.alias("ago"))
    aggs = []
    for w in windows:
        first = F.when((F.col("ago") <= w) & (F.col("ago") > w // 2), F.col("guests"))
        second = F.when((F.col("ago") <= w // 2) & (F.col("ago") >= 0), F.col("guests"))
        aggs += [
            F.coalesce(F.avg(first), F.lit(0.0)).alias(f"avg_first_{w}d"),
            F.coalesce(F.avg(second), F.lit(0.0)).alias(f"avg_second_{w}d"),
            F.count(first).alias(f"sample_first_{w}d"),
            F.count(second).alias(f"sample_second_{w}d"),
        ]
    g = d.groupBy("entity").agg(*aggs)
    for w in windows:
        a, b = F.col(f"avg_first_{w}d"), F.col(f"avg_second_{w}d")
        g = g.withColumn(
            f"growth_{w}d",
            F.when(a > 0, (b - a) / F.nullif(a, F.lit(0.0)) * 100).when(b == 0, 0.0).otherwise(100.0),
        )
    g30 = F.col("growth_30d")
    trend = None
    for limit, label in rules.GROWTH_STEPS:
        trend = F.when(g30 > limit, label) if trend is None else trend.when(g30 > limit, label)
    return g.withColumns({"trend": trend.otherwise("STRONG_DECLINE"), "trend_score": clip(g30, -100.0, 100.0)})


def gaps(day: DataFrame, min_gap: int = rules.MIN_GAP_DAYS) -> DataFrame:
    """Pauses of at least ``min_gap`` days between two active days."""
    prev = F.lag("date").over(_per().orderBy("date"))
    n = F.col("gap_days")
    reason = (
        F.when(n > 60, "LONG_CLOSURE").when(n > 30, "RENOVATION").when(n > 14, "EXTENDED_CLOSURE")
        .otherwise("TEMPORARY_CLOSURE")
    )
    return (
        day.select("entity", prev.alias("gap_start"), F.col("date").alias("gap_end"))
        .withColumn("gap_days", F.datediff("gap_end", "gap_start"))
        .where(n >= min_gap)
        .withColumn("reason", reason)
    )


def exclude_reason(span: Column, gap_ratio: Column, active_days: Column, in_gap: Column, since: Column | None = None) -> Column:
    current = F.lit("CURRENTLY_IN_GAP")
    return (
        F.when(span <= 0, "SINGLE_DAY_DATA")
        .when(gap_ratio > rules.MAX_GAP_RATIO, "HIGH_GAP_RATIO")
        .when(active_days < rules.MIN_ACTIVE_DAYS, "LOW_ACTIVE_DAYS")
        .when(in_gap, current if since is None else F.concat(current, since))
        .otherwise("OK")
    )


def exclude(day: DataFrame, today: str, gap_rows: DataFrame | None = None) -> DataFrame:
    """Whether an entity is left out of the forecast, and why (first rule wins)."""
    g = (gaps(day) if gap_rows is None else gap_rows).groupBy("entity").agg(
        F.count("*").alias("total_gaps"), F.sum("gap_days").alias("total_gap_days"),
        F.max(F.struct("gap_end", "gap_start")).alias("last_gap"),
    )
    d = day.groupBy("entity").agg(
        F.count("*").alias("active_days"), F.datediff(F.max("date"), F.min("date")).alias("span")
    )
    j = d.join(g, "entity", "left").fillna(0, ["total_gaps", "total_gap_days"])
    gap_ratio = F.col("total_gap_days") / F.nullif(F.col("span").cast("double"), F.lit(0.0))
    in_gap = F.col("last_gap.gap_end") >= F.date_sub(F.lit(today).cast("date"), 3)
    since = F.concat(F.lit(" since "), F.col("last_gap.gap_start").cast("string"))
    reason = exclude_reason(F.col("span"), gap_ratio, F.col("active_days"), in_gap, since)
    return j.select(
        "entity", "active_days", "total_gaps", "total_gap_days",
        F.coalesce(gap_ratio, F.lit(0.0)).alias("gap_ratio"), reason.alias("exclude_reason"),
        (reason != "OK").alias("should_exclude"),
    )


def outliers(day: DataFrame, k: float = rules.OUTLIER_IQR) -> DataFrame:
    """Daily facts tagged by the IQR rule per weekday, kept with a lower weight."""
    w = W.partitionBy("entity", F.weekday("date"))
    q = F.percentile("guests", F.array(F.lit(0.25), F.lit(0.75))).over(w)
    d = day.withColumns({"__q": q, "__n": F.count("*").over(w)})
    q1, q3 = F.col("__q")[0], F.col("__q")[1]
    usable = (F.col("__n") >= 4) & (q3 != q1)
    low, high = F.greatest(F.lit(0.0), q1 - k * (q3 - q1)), q3 + k * (q3 - q1)
    kind = F.when(usable & (F.col("guests") < low), "LOW").when(usable & (F.col("guests") > high), "HIGH")
    d = d.withColumns(
        {"outlier_type": kind, "lower": F.when(usable, low), "upper": F.when(usable, high)}
    )
    t = F.col("outlier_type")
    return d.withColumns(
        {
            "is_outlier_day": F.when(t.isNotNull(), 1).otherwise(0),
            "outlier_weight": F.when(t == "HIGH", 0.70).when(t == "LOW", 0.40).otherwise(1.0),
        }
    ).drop("__q", "__n")


def tag_txn(txn: DataFrame, tagged_day: DataFrame) -> DataFrame:
    """Carry the day's outlier flag and weight to its transactions."""
    flags = tagged_day.select("entity", "date", "is_outlier_day", "outlier_weight")
    return txn.join(flags, ["entity", "date"], "left").fillna({"is_outlier_day": 0, "outlier_weight": 1.0})


def special_types(cal: DataFrame) -> DataFrame:
    """Holiday and event-day types per date (days before an event do not count)."""
    on = event_on(F.col("date"))["type"]
    return cal.select("date", F.col("holiday_type").alias("__h"), on.alias("__e"))


def smart_caps(day: DataFrame, cal: DataFrame, today: str, recent: int = 90) -> DataFrame:
    """Highest and lowest normal days (last 90 days, else all time), by weekday kind."""
    d = day.join(F.broadcast(special_types(cal)), "date", "left")
    normal = F.col("__h").isNull() & F.col("__e").isNull()
    fresh = normal & (F.col("date") >= F.date_sub(F.lit(today).cast("date"), recent))
    v, we = F.col("guests"), is_weekend(F.col("date"))
    agg = d.groupBy("entity").agg(
        F.max(v).alias("max_daily"),
        F.max(F.when(fresh, v)).alias("mx"), F.min(F.when(fresh, v)).alias("mn"),
        F.max(F.when(normal, v)).alias("mx_all"), F.min(F.when(normal, v)).alias("mn_all"),
        F.max(F.when(fresh & ~we, v)).alias("mx_wd"), F.min(F.when(fresh & ~we, v)).alias("mn_wd"),
        F.max(F.when(fresh & we, v)).alias("mx_we"), F.min(F.when(fresh & we, v)).alias("mn_we"),
    )
    c = F.coalesce
    return agg.select(
        "entity", "max_daily",
        c("mx", "mx_all", "max_daily").alias("max_daily_normal"),
        c("mn", "mn_all", F.lit(0.0)).alias("min_daily_normal"),
        c("mx_wd", "mx", "mx_all", "max_daily").alias("max_daily_normal_weekday"),
        c("mx_we", "mx", "mx_all", "max_daily").alias("max_daily_normal_weekend"),
        c("mn_wd", "mn", "mn_all", F.lit(0.0)).alias("min_daily_normal_weekday"),
        c("mn_we", "mn", "mn_all", F.lit(0.0)).alias("min_daily_normal_weekend"),
    )


def caps_by_type(day: DataFrame, cal: DataFrame) -> DataFrame:
    """Highest day per entity and holiday or event type."""
    d = day.join(F.broadcast(special_types(cal)), "date")
    kinds = F.array_distinct(F.array_compact(F.array("__h", "__e")))
    return (
        d.select("entity", "guests", F.explode(kinds).alias("special_type"))
        .where("guests > 0").groupBy("entity", "special_type").agg(F.max("guests").alias("max_daily"))
    )


def recent_means(day: DataFrame) -> DataFrame:
    """Mean of the last 3, 7 and 14 active days and their ratios (1 with under 7 days)."""
    rn = F.row_number().over(_per().orderBy(F.desc("date")))
    last = lambda n: F.avg(F.when(F.col("rn") <= n, F.col("guests")))
    m = day.select("entity", "guests", rn.alias("rn")).groupBy("entity").agg(
        F.count("*").alias("n"), last(3).alias("mean_3d"), last(7).alias("mean_7d"), last(14).alias("mean_14d")
    )
    enough = F.col("n") >= 7
    m14 = F.when(F.col("n") >= 14, F.col("mean_14d")).otherwise(F.col("mean_7d"))
    one = F.lit(1.0)
    return m.select(
        "entity", "mean_3d", "mean_7d", m14.alias("mean_14d"),
        F.when(enough, F.col("mean_3d") / F.greatest(F.col("mean_7d"), one)).otherwise(1.0).alias("trend_short"),
        F.when(enough, F.col("mean_7d") / F.greatest(m14, one)).otherwise(1.0).alias("trend_medium"),
    )


def volume_segment(avg: Column) -> Column:
    return (
        F.when(avg < rules.LOW_VOLUME_DAILY, "LOW_VOLUME").when(avg < rules.MEDIUM_VOLUME_DAILY, "MEDIUM_VOLUME")
        .otherwise("HIGH_VOLUME")
    )


def category(active_days: Column, cv: Column, avg: Column) -> Column:
    return (
        F.when(active_days < rules.NEW_DAYS, "NEW").when(active_days < rules.YOUNG_DAYS, "YOUNG")
        .when(cv > rules.VOLATILE_CV, "VOLATILE").when(avg > rules.HIGH_VOLUME_AVG, "HIGH_VOLUME")
        .otherwise("STANDARD")
    )


def classify(day: DataFrame) -> DataFrame:
    """Category, strategy and volume segment from the level, spread and length of history."""
    a = day.groupBy("entity").agg(
        F.count("*").alias("active_days"), F.avg("guests").alias("avg_daily"),
        F.coalesce(F.stddev_samp("guests"), F.lit(0.0)).alias("std_daily"),
        F.min("guests").alias("min_daily"), F.median("guests").alias("median_daily"),
    )
    avg, n = F.col("avg_daily"), F.col("active_days")
    a = a.withColumn("cv", F.coalesce(ratio(F.col("std_daily"), F.when(avg > 0, avg)), F.lit(999.0)))
    a = a.withColumns({"category": category(n, F.col("cv"), avg), "volume_segment": volume_segment(avg)})
    c, seg = F.col("category"), F.col("volume_segment")
    strategy = (
        F.when(c == "NEW", "AI_ONLY").when(c == "YOUNG", "AI_PRIMARY_ML_SECONDARY")
        .when(seg == "LOW_VOLUME", "BASELINE_ONLY").when(seg == "MEDIUM_VOLUME", "ENSEMBLE_WEIGHTED")
        .otherwise("HIGH_VOLUME_ML")
    )
    conf = (
        F.when(c == "NEW", "LOW").when(c == "YOUNG", "MEDIUM").when(seg == "LOW_VOLUME", "MEDIUM")
        .when(seg == "HIGH_VOLUME", "HIGH").when(c == "VOLATILE", "MEDIUM").otherwise("HIGH")
    )
    return a.withColumns({"strategy": strategy, "confidence": conf})


def weekday_stats(day: DataFrame) -> DataFrame:
    return day.groupBy("entity", F.date_format("date", "EEEE").alias("weekday")).agg(
        F.avg("guests").alias("avg"), F.coalesce(F.stddev_samp("guests"), F.lit(0.0)).alias("std"),
        F.min("guests").alias("min"), F.max("guests").alias("max"), F.count("*").alias("count"),
    )


def weekday_patterns(day: DataFrame) -> DataFrame:
    """Per entity: map weekday -> statistics, and the weekend/weekday ratio of the means."""
    s = weekday_stats(day)
    we = F.col("weekday").isin("Saturday", "Sunday")
    packed = s.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.struct("weekday", F.struct("avg", "std", "min", "max", "count"))))
        .alias("weekday_patterns"),
        F.coalesce(F.sum(F.when(we, F.col("avg"))), F.lit(0.0)).alias("we"),
        F.coalesce(F.sum(F.when(~we, F.col("avg"))), F.lit(0.0)).alias("wd"),
    )
    r = F.coalesce((F.col("we") / 2) / F.nullif(F.col("wd") / 5, F.lit(0.0)), F.lit(1.0))
    return packed.select("entity", "weekday_patterns", r.alias("weekend_weekday_ratio"))


def report(day: DataFrame, cal: DataFrame, today: str) -> DataFrame:
    """Assembled profile: one row per entity. All parts share the entity key."""
    tagged = outliers(day)
    n_out = tagged.groupBy("entity").agg(F.sum("is_outlier_day").alias("outlier_count"))
    by_type = caps_by_type(day, cal).groupBy("entity").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("special_type", "max_daily")))).alias("max_by_special")
    )
    parts = [
        growth(day, today),
        exclude(day, today).drop("active_days"),
        n_out,
        classify(day),
        smart_caps(day, cal, today),
        recent_means(day),
        weekday_patterns(day),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "entity")
    return out.join(by_type, "entity", "left")


def chain_outliers(day: DataFrame, mult: float = 5.0, min_entities: int = 5) -> DataFrame:
    """Entities whose daily mean is far above the others."""
    avg = day.groupBy("entity").agg(F.avg("guests").alias("avg_daily")).withColumn("scope", F.lit("all"))
    q = grouped_quantiles(avg, ["scope"], "avg_daily", {"q1": 0.25, "med": 0.5, "q3": 0.75})
    n = avg.groupBy("scope").agg(F.count("*").alias("entities"))
    iqr = F.col("q3") - F.col("q1")
    bound = q.join(n, "scope").select(
        "scope", "entities", F.when(iqr == 0, F.col("med") * 10).otherwise(F.col("q3") + mult * iqr).alias("upper_bound")
    )
    j = avg.join(F.broadcast(bound), "scope")
    return j.where((F.col("entities") >= min_entities) & (F.col("avg_daily") > F.col("upper_bound"))).select(
        "entity", "avg_daily", "upper_bound"
    )


def batch_summary(profile: DataFrame) -> DataFrame:
    """Counts of categories, strategies and exclusion reasons."""
    reason = F.regexp_replace("exclude_reason", " since .*", "")
    kinds = F.array(
        F.struct(F.lit("category").alias("section"), F.col("category").alias("key")),
        F.struct(F.lit("strategy").alias("section"), F.col("strategy").alias("key")),
        F.struct(F.lit("excluded").alias("section"), reason.alias("key")),
    )
    return profile.select(F.inline(kinds)).groupBy("section", "key").agg(F.count("*").alias("n"))
