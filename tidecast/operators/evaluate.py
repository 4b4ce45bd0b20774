"""Model evaluation: breakdowns, error histogram, ablation, backtest reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions.stats import is_weekend
from tidecast.operators.metrics import (
    hit_abs, hit_strict, metrics_full, metrics_hybrid, metrics_smape, segment, valid_pairs, with_errors,
)

# Upper limits of the error histogram (fixed values).
HIST_LIMITS = [5, 10, 15, 20, 30, 50]


def prepare(ledger: DataFrame) -> DataFrame:
    """Valid pairs with errors and calendar labels (ISO week with calendar year)."""
    return with_errors(valid_pairs(ledger)).withColumns(
        {
            "hit": hit_abs(),
            "weekday": F.date_format("date", "EEEE"),
            "day_type": F.when(is_weekend(F.col("date")), "weekend").otherwise("weekday"),
            "shift": F.coalesce("shift", F.lit("UNKNOWN")),
            "year": F.year("date"),
            "week": F.weekofyear("date"),
            "year_month": F.date_format("date", "yyyy-MM"),
        }
    )


def by(errors: DataFrame, *keys: str) -> DataFrame:
    return metrics_full(errors, list(keys))


def histogram(errors: DataFrame, include_zero: bool = True) -> DataFrame:
    """Rows, share and running share per error range; exact hits are part of the first range
    unless ``include_zero`` is off."""
    e = F.col("abs_error")
    b = F.when(e > HIST_LIMITS[-1], len(HIST_LIMITS))
    for i, limit in reversed(list(enumerate(HIST_LIMITS))):
        b = F.when(e <= limit, i).otherwise(b)
    if not include_zero:
        b = F.when(e > 0, b)
    counts = errors.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy())
    labels = F.array(*[F.lit(x) for x in ["<=5", "6-10", "11-15", "16-20", "21-30", "31-50", ">50"]])
    # At most eight rows from here on.
    c = counts.withColumns({"pct": F.col("n") / total * 100}).where("bin is not null")
    c = c.withColumn("__share", F.sum("pct").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    return c.select("bin", F.element_at(labels, F.col("bin") + 1).alias("error_range"), "n", "pct",
                    F.col("__share").alias("cumulative_pct"))


def ablation(ledger: DataFrame, layers: dict[str, str], windows=(7, 14, 30)) -> DataFrame:
    """Accuracy per window, segment (and all) and prediction layer, with the layer change
    ``FINAL - PRE`` on every row; windows and layers unfold in one pass."""
    v = ledger.where("actual >= 0 and date is not null").withColumn("segment", segment())
    last = v.agg(F.max("date")).scalar()
    inside = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.col("date") > F.date_sub("__last", w))
    v = v.where(F.col("date") > F.date_sub(last, max(windows))).withColumn("__last", last)
    v = v.withColumn("window_days", F.explode(inside))
    arr = F.array(*[F.struct(F.lit(k).alias("layer"), F.col(c).alias("pred")) for k, c in layers.items()])
    v = v.select("window_days", "segment", "actual", F.inline(arr)).where("actual > 0 and pred is not null")
    e = F.col("pred") - F.col("actual")
    g = v.groupingSets(
        [[F.col("window_days"), F.col("layer")], [F.col("window_days"), F.col("layer"), F.col("segment")]],
        F.col("window_days"), F.col("layer"), F.col("segment"),
    ).agg(
        F.grouping("segment").alias("__all"), F.count("*").alias("samples"), F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e) / F.col("actual")) * 100).alias("mape"), F.avg(e).alias("bias"),
        (F.avg(hit_strict().cast("double")) * 100).alias("hit_rate"),
    )
    g = g.withColumn("segment", F.when(F.col("__all") == 1, "ALL").otherwise(F.col("segment"))).drop("__all")
    w = W.partitionBy("window_days", "segment")
    for m in ("mae", "mape", "bias", "hit_rate"):
        final = F.max(F.when(F.col("layer") == "FINAL", F.col(m))).over(w)
        pre = F.max(F.when(F.col("layer") == "PRE", F.col(m))).over(w)
        g = g.withColumn(f"{m}_final_minus_pre", final - pre)
    return g


def top_regressions(report: DataFrame, n: int = 10) -> DataFrame:
    return (
        report.where("window_days = 7 and layer = 'FINAL' and segment <> 'ALL'")
        .orderBy(F.desc_nulls_last("mae_final_minus_pre"), F.desc("mae"), "segment").limit(n)
    )


def horizon_day(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("horizon_day", F.datediff("date", "sim_date") + 1)


def backtest_report(pairs: DataFrame) -> DataFrame:
    """All breakdowns of walk-forward pairs (sim_date, entity, date, shift, pred, actual),
    long form: section, key, measures. Each row unfolds into the groups it belongs to, so
    one shuffle serves every breakdown."""
    p = horizon_day(pairs).withColumn("weekday", F.date_format("date", "EEEE"))
    vol = F.avg("actual").over(W.partitionBy("entity"))
    p = p.withColumn("vol", F.when(vol < 30, "LOW_VOLUME").when(vol < 80, "MEDIUM_VOLUME").otherwise("HIGH_VOLUME"))
    s = lambda name, key, when=None: (
        F.struct(F.lit(name).alias("section"), key.alias("key")) if when is None
        else F.when(when, F.struct(F.lit(name).alias("section"), key.alias("key")))
    )
    groups = F.array(
        s("overall", F.lit("all")), s("entity", F.col("entity")), s("weekday", F.col("weekday")),
        s("horizon", F.col("horizon_day").cast("string")), s("simulation", F.col("sim_date").cast("string")),
        s("shift", F.col("shift")),
        s("shift_weekend", F.concat("shift", F.lit("_WEEKEND")), is_weekend(F.col("date"))),
        s("shift_weekday", F.concat_ws("|", "shift", "weekday")), s("volume", F.col("vol")),
        s("volume_shift", F.concat_ws("_", "vol", "shift")),
    )
    m = metrics_hybrid(p.select("date", "pred", "actual", F.inline(F.array_compact(groups))), ["section", "key"])
    need = F.when(F.col("section") == "shift_weekend", 3).when(F.col("section").isin("shift_weekday", "volume_shift"), 2).otherwise(1)
    return m.where(F.col("n") >= need)


def backtest_split(day: DataFrame, start: str, end: str, step: int, lookback: int, horizon: int) -> DataFrame:
    """Every day with the simulations it trains or tests: dates unfold into (date, sim_date,
    role) rows bounded by the calendar and meet the facts on the date."""
    sims = day.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {step} days"))).alias("sim_date")
    )
    train = sims.select("sim_date", F.lit("train").alias("role"),
                        F.explode(F.sequence(F.date_sub("sim_date", lookback), F.date_sub("sim_date", 1))).alias("date"))
    test = sims.select("sim_date", F.lit("test").alias("role"),
                       F.explode(F.sequence("sim_date", F.date_add("sim_date", horizon - 1))).alias("date"))
    return day.join(F.broadcast(train.unionByName(test)), "date")


def backtest_median(split: DataFrame, min_days: int = 7) -> DataFrame:
    """Walk-forward pairs of the weekday-median forecast: all simulations in one plan."""
    tr = split.where("role = 'train'").withColumn("wd", F.weekday("date"))
    known = tr.groupBy("sim_date", "entity").agg(F.count_distinct("date").alias("days")).where(F.col("days") >= min_days)
    med = tr.groupBy("sim_date", "entity", "shift", "wd").agg(F.median("guests").alias("pred"))
    te = split.where("role = 'test'").withColumn("wd", F.weekday("date"))
    return (
        te.join(known, ["sim_date", "entity"], "left_semi").join(med, ["sim_date", "entity", "shift", "wd"])
        .select("sim_date", "entity", "date", "shift", "pred", F.col("guests").alias("actual"))
    )


def holdout(day: DataFrame, test_days: int = 30, min_train: int = 30) -> DataFrame:
    """Last ``test_days`` rows of each entity against its weekday mean before them."""
    w = W.partitionBy("entity")
    d = day.withColumns(
        {"rn": F.row_number().over(w.orderBy(F.desc("date"))), "n": F.count("*").over(w), "wd": F.weekday("date")}
    ).where(F.col("n") >= test_days + min_train)
    train = F.col("rn") > test_days
    wd = W.partitionBy("entity", "wd")
    pred = F.coalesce(
        F.avg(F.when(train, F.col("guests"))).over(wd), F.avg(F.when(train, F.col("guests"))).over(w)
    )
    pairs = d.withColumn("pred", pred).where(~train).select("entity", "date", "pred", F.col("guests").alias("actual"))
    return metrics_smape(pairs, ["entity"])

