"""KPI tables on shift rows. Weekend here is Friday to Sunday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.clean import shift_legacy
from tidecast.functions.stats import is_weekend_kpi, ratio
from tidecast.operators.metrics import hit_abs, valid_pairs


def prepare(ledger: DataFrame) -> DataFrame:
    """Shift rows with errors; an entity's day that a run holds in hourly rows only is summed to shifts."""
    v = valid_pairs(ledger)
    shifts = v.where(F.col("shift").isin("MORNING", "EVENING"))
    cols = ["run_date", "entity", "date", "shift", "pred", "actual"]
    legacy = F.when(shift_legacy(F.col("hour")) != "OTHER", shift_legacy(F.col("hour")))
    hourly = (
        v.where("hour is not null").withColumn("shift", legacy).where("shift is not null")
        .groupBy("run_date", "entity", "date", "shift")
        .agg(F.sum("pred").alias("pred"), F.sum("actual").alias("actual"))
    )
    keys = ["run_date", "entity", "date"]
    there = shifts.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    hourly = hourly.join(there, same, "left_anti")
    d = shifts.select(*cols).unionByName(hourly.select(*cols))
    e = F.col("pred") - F.col("actual")
    return d.withColumns(
        {
            "diff": e,
            "abs_diff": F.abs(e),
            "error_pct": F.when(F.col("actual") > 0, F.abs(e) / F.nullif(F.col("actual"), F.lit(0.0)) * 100)
            .when(F.col("pred") == 0, 0.0).otherwise(100.0),
            "hit_15": hit_abs(),
            "weekday": F.date_format("date", "EEEE"),
            "day_type": F.when(is_weekend_kpi(F.col("date")), "weekend").otherwise("weekday"),
        }
    )


def _accuracy():
    return F.greatest(F.lit(0.0), 100 - ratio(F.sum("abs_diff"), F.sum("actual")) * 100)


def entity_shift(rows: DataFrame) -> DataFrame:
    """Accuracy per entity and shift, measured by volume."""
    g = rows.groupBy("entity", "shift").agg(
        F.count("*").alias("n"), F.sum("actual").alias("__a"), F.sum("abs_diff").alias("__e"),
        (F.avg("hit_15") * 100).alias("hit_rate"), F.avg("abs_diff").alias("mae"), F.avg("pred").alias("avg_pred"),
        F.avg("actual").alias("avg_actual"), F.avg("diff").alias("avg_error"),
    )
    avg = F.col("avg_actual")
    small = avg < rules.LOW_VOLUME_AVG
    acc = F.when(small & (avg > 0), F.greatest(F.lit(0.0), 100 - ratio(F.col("mae"), avg) * 100)).when(
        ~small & (F.col("__a") > 0), F.greatest(F.lit(0.0), 100 - ratio(F.col("__e"), F.col("__a")) * 100)
    ).otherwise(0.0)
    return g.withColumns(
        {
            "accuracy": acc,
            "metric_type": F.when(small, "MAE").when(F.col("__a") > 0, "WMAPE").otherwise("MAPE"),
            "volume_segment": F.when(small, "LOW_VOLUME").when(avg >= rules.MEDIUM_VOLUME_DAILY, "HIGH_VOLUME")
            .otherwise("MEDIUM_VOLUME"),
        }
    ).drop("__a", "__e")


def shift_by(rows: DataFrame, key: str) -> DataFrame:
    """Accuracy per shift and ``key`` (day_type or weekday)."""
    return rows.groupBy("shift", key).agg(
        F.count("*").alias("n"), F.coalesce(_accuracy(), F.lit(0.0)).alias("accuracy"),
        (F.avg("hit_15") * 100).alias("hit_rate"), F.avg("abs_diff").alias("mae"), F.avg("pred").alias("avg_pred"),
        F.avg("actual").alias("avg_actual"), F.avg("diff").alias("avg_error"), F.max("abs_diff").alias("max_error"),
        F.count_distinct("entity").alias("entities"),
    )


def _tolerance_cols():
    hit = F.sum("hit_15")
    return [
        F.count("*").alias("n"), hit.alias("n_hit"), (F.count("*") - hit).alias("n_miss"),
        (hit / F.count("*") * 100).alias("hit_pct"), F.avg("abs_diff").alias("mae"),
    ]


def tolerance(rows: DataFrame) -> DataFrame:
    """Share within 15 guests: overall, per shift, per shift and day type in one pass, plus
    the overall line without low-volume entities."""
    sets = rows.groupingSets(
        [[], [F.col("shift")], [F.col("shift"), F.col("day_type")]], F.col("shift"), F.col("day_type")
    ).agg(F.grouping_id().alias("g"), *_tolerance_cols())
    a = sets.withColumn("section", F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "shift").otherwise("shift_day_type"))
    low = rows.groupBy("entity").agg(F.avg("actual").alias("m")).where(F.col("m") < rules.LOW_VOLUME_AVG)
    b = rows.join(low, "entity", "left_anti").agg(*_tolerance_cols()).select(
        F.lit("overall_without_low_volume").alias("section"), F.lit(None).cast("string").alias("shift"),
        F.lit(None).cast("string").alias("day_type"), "n", "n_hit", "n_miss", "hit_pct", "mae",
    )
    return a.drop("g").unionByName(b)


def wrong_rows(rows: DataFrame) -> DataFrame:
    return rows.where("hit_15 = 0").select(
        "run_date", "entity", "date", "weekday", "shift", "pred", "actual", "diff", "abs_diff", "error_pct"
    )


def run_errors(rows: DataFrame, show: int = 20) -> DataFrame:
    """Per run: right and wrong shift rows, entities with misses and the first of them.

    The list is made from the ``show`` smallest codes, taken before anything is collected.
    """
    g = rows.groupBy("run_date").agg(
        F.count("*").alias("n"), F.sum("hit_15").alias("n_right"), F.count_distinct("entity").alias("entities"),
        F.count_distinct(F.when(F.col("hit_15") == 0, F.col("entity"))).alias("entities_wrong"),
    )
    out = g.join(wrong_list(rows, show), "run_date", "left").fillna("", ["wrong_list"])
    return out.withColumns(
        {
            "n_wrong": F.col("n") - F.col("n_right"), "right_pct": F.col("n_right") / F.col("n") * 100,
            "entities_wrong_pct": F.col("entities_wrong") / F.col("entities") * 100,
        }
    )


def wrong_list(rows: DataFrame, show: int = 20) -> DataFrame:
    """First ``show`` wrong entity codes per run, sorted and joined."""
    from pyspark.sql import Window as W

    codes = rows.where("hit_15 = 0").select("run_date", "entity").distinct()
    rn = F.row_number().over(W.partitionBy("run_date").orderBy("entity"))
    first = codes.withColumn("rn", rn).where(F.col("rn") <= show)
    return first.groupBy("run_date").agg(
        F.array_join(F.array_sort(F.collect_list("entity")), ", ").alias("wrong_list")
    )


def tolerance_bins(rows: DataFrame) -> DataFrame:
    """Share of shift rows in the four error bands, per shift and overall."""
    e = F.col("abs_diff")
    sets = rows.groupingSets([[], [F.col("shift")]], F.col("shift")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("total"),
        F.count_if(e <= 5).alias("<=5"), F.count_if((e > 5) & (e <= 10)).alias("5-10"),
        F.count_if((e > 10) & (e <= 15)).alias("10-15"), F.count_if(e > 15).alias(">15"),
    )
    named = sets.withColumn("shift", F.when(F.col("g") == 1, "ALL").otherwise(F.col("shift"))).drop("g")
    bands = ["<=5", "5-10", "10-15", ">15"]
    long = named.unpivot(["shift", "total"], [F.col(f"`{b}`") for b in bands], "level", "n")
    return long.withColumn("pct", F.col("n") / F.col("total") * 100)


def run_record(overall: DataFrame) -> DataFrame:
    """Adds the health grade to an overall metrics row (wmape, hit_rate)."""
    m, h = F.col("wmape"), F.col("hit_rate")
    a = F.coalesce(*[F.when(m <= x, 5 - k) for k, x in enumerate(rules.GRADE_WMAPE)], F.when(m.isNotNull(), 1))
    b = F.coalesce(*[F.when(h >= x, 5 - k) for k, x in enumerate(rules.GRADE_HIT_RATE)], F.when(h.isNotNull(), 1))
    n = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    avg = (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) / F.nullif(n, F.lit(0))
    grade = (
        F.when(avg >= 4.5, "EXCELLENT").when(avg >= 3.5, "GOOD").when(avg >= 2.5, "AVERAGE").when(avg >= 1.5, "WEAK")
        .when(avg.isNotNull(), "POOR").otherwise("NO_DATA")
    )
    return overall.withColumns({"score": avg, "grade": grade})
