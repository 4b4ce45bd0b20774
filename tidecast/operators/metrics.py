"""Prediction errors and accuracy measures. Bias is predicted minus actual everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import is_weekend, ratio


def valid_pairs(ledger: DataFrame) -> DataFrame:
    """Rows with a date and both values present and not negative."""
    return ledger.where("date is not null and pred >= 0 and actual >= 0")


def with_errors(df: DataFrame) -> DataFrame:
    e = F.col("pred") - F.col("actual")
    pos = F.when(F.col("actual") > 0, F.col("actual"))
    return df.withColumns(
        {
            "error": e,
            "abs_error": F.abs(e),
            "squared_error": e * e,
            "pct_error": F.abs(e) / pos * 100,
            "signed_pct": e / pos * 100,
        }
    )


def hit_abs(limit: float = rules.HIT_ABS) -> Column:
    return F.when(F.abs(F.col("pred") - F.col("actual")) <= limit, 1).otherwise(0)


def hit_strict() -> Column:
    """Small days within 10 guests, large ones within 10 %; null where nothing was sold."""
    e, a = F.abs(F.col("pred") - F.col("actual")), F.col("actual")
    return F.when(a > 0, F.when(F.when(a < 100, e <= 10).otherwise(e / F.nullif(a, F.lit(0.0)) <= 0.10), 1).otherwise(0))


def day_type() -> Column:
    return (
        F.when(F.coalesce("is_holiday", F.lit(False)), "HOLIDAY")
        .when(is_weekend(F.col("date")), "WEEKEND").otherwise("WEEKDAY")
    )


def segment(size_by: Column | None = None) -> Column:
    """shift | day type | size; size from the row's actual unless another level is given."""
    level = F.col("actual") if size_by is None else size_by
    return F.concat_ws(
        "|", F.coalesce("shift", F.lit("DAILY")), day_type(), F.when(level >= 100, "LARGE").otherwise("SMALL")
    )


def ai_available(df: DataFrame) -> DataFrame:
    """Flag with null as false; true when the ledger has no such column."""
    c = F.coalesce("ai_available", F.lit(False)) if "ai_available" in df.columns else F.lit(True)
    return df.withColumn("ai_available", c)


def measures(hit: Column | None = None) -> dict[str, Column]:
    """Aggregate expressions over pred/actual, all from one pass of sums."""
    e = F.col("pred") - F.col("actual")
    pos = F.col("actual") > 0
    hit = hit_abs() if hit is None else hit
    return {
        "n": F.count("*"),
        "mae": F.avg(F.abs(e)),
        "wmape": ratio(F.sum(F.when(pos, F.abs(e))), F.sum(F.when(pos, F.col("actual")))) * 100,
        "mape": F.avg(F.when(pos, F.abs(e) / F.nullif(F.col("actual"), F.lit(0.0)))) * 100,
        "rmse": F.sqrt(F.avg(e * e)),
        "bias": F.avg(e),
        "hit_rate": F.avg(hit.cast("double")) * 100,
    }


def metrics(df: DataFrame, by: list[str] | None = None, names=None) -> DataFrame:
    """Accuracy overall or per key."""
    names = names or ["n", "mae", "wmape", "rmse", "bias", "hit_rate"]
    m = measures()
    aggs = [m[k].alias(k) for k in names]
    return valid_pairs(df).groupBy(*(by or [])).agg(*aggs)


def metrics_full(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics(df, by, ["n", "mae", "mape", "wmape", "rmse", "bias", "hit_rate"])


def metrics_hybrid(df: DataFrame, by: list[str] | None = None, low: float = rules.LOW_VOLUME_AVG) -> DataFrame:
    """Adds the volume-aware measures: MAE below ``low`` guests on average, else WMAPE."""
    e = F.abs(F.col("pred") - F.col("actual"))
    a = F.col("actual")
    m = measures()
    out = valid_pairs(df).groupBy(*(by or [])).agg(
        *[m[k].alias(k) for k in ("n", "mae", "wmape", "rmse", "bias", "hit_rate")],
        F.avg(a).alias("avg_actual"),
        (F.avg(F.when((a >= low) & (a > 0), e / F.nullif(a, F.lit(0.0)))) * 100).alias("mape_high_vol"),
        F.avg(F.when(a < low, e)).alias("mae_low_vol"),
        F.count_if(a < low).alias("n_low"),
        F.count_if(a >= low).alias("n_high"),
    )
    small = F.col("avg_actual") < low
    return out.withColumns(
        {
            "weighted_mae": F.col("mae") / F.greatest("avg_actual", F.lit(1.0)),
            "hybrid_type": F.when(small, "MAE").otherwise("WMAPE"),
            "hybrid_metric": F.when(small, F.col("mae")).otherwise(F.col("wmape")),
        }
    )


def metrics_sets(df: DataFrame, sets: list[list[str]], names=None) -> DataFrame:
    """Several breakdowns in one pass; ``level`` tells them apart, so null keys stay rows."""
    names = names or ["n", "mae", "mape", "rmse", "bias", "hit_rate"]
    keys = list(dict.fromkeys(k for s in sets for k in s))
    m = measures()
    g = valid_pairs(df).groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    out = g.agg(F.grouping_id().alias("__g"), *[m[k].alias(k) for k in names])
    level = F.lit("?")
    for s in sets:
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        level = F.when(F.col("__g") == bits, "+".join(s) or "overall").otherwise(level)
    return out.withColumn("level", level).drop("__g")


def metrics_smape(df: DataFrame, by: list[str], low: float = rules.LOW_VOLUME_AVG) -> DataFrame:
    """SMAPE for small entities, MAPE for the others; R2 from sums."""
    e, a, p = F.abs(F.col("pred") - F.col("actual")), F.col("actual"), F.col("pred")
    one = F.lit(1.0)
    out = valid_pairs(df).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(a).alias("avg_daily"),
        (F.avg(2 * e / F.greatest(F.abs(p) + F.abs(a), one)) * 100).alias("__s"),
        (F.avg(e / F.greatest(a, one)) * 100).alias("__m"),
        F.coalesce(1 - ratio(F.sum(e * e), F.var_pop(a) * F.count("*")), F.lit(0.0)).alias("r2"),
    )
    small = F.col("avg_daily") < low
    return out.withColumns(
        {
            "metric_type": F.when(small, "SMAPE").otherwise("MAPE"),
            "mape": F.when(small, F.col("__s")).otherwise(F.col("__m")),
            "weighted_mae": F.col("mae") / F.greatest("avg_daily", one),
        }
    ).drop("__s", "__m")


def metrics_segment(df: DataFrame, by: list[str]) -> DataFrame:
    """Per scope: samples, MAE, bias, strict hit share and MAPE of the daily totals."""
    v = valid_pairs(df).where("actual > 0")
    e = F.col("pred") - F.col("actual")
    day = v.groupBy(*by, "date").agg(
        F.sum("pred").alias("p"), F.sum("actual").alias("a"), F.count("*").alias("samples"),
        F.sum(F.abs(e)).alias("ae"), F.sum(e).alias("e"), F.sum(hit_strict()).alias("hits"),
    )
    n = F.sum("samples")
    return day.groupBy(*by).agg(
        n.alias("samples"), (F.sum("ae") / n).alias("mae"),
        (F.avg(F.abs(F.col("p") - F.col("a")) / F.nullif(F.col("a"), F.lit(0.0))) * 100).alias("mape_daily"),
        (F.sum("e") / n).alias("bias"), (F.sum("hits") / n).alias("hit_rate"),
    )
