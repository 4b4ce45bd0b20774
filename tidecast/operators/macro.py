"""Monthly facts against macro indicators. All tables here have one row per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions.stats import corr_safe, ratio

FACTORS = ["gold", "gas", "deposit_rate", "lending_rate"]


def join_macro(month: DataFrame, macro: DataFrame) -> DataFrame:
    return month.join(macro, ["year", "month"])


def correlations(joined: DataFrame, targets=("guests", "revenue"), min_n: int = 3) -> DataFrame:
    """Pearson r of each factor with each target, with strength and direction; a constant
    factor gives 0 and no label."""
    long = joined.select(
        F.inline(F.array(*[
            F.struct(F.lit(t).alias("target"), F.lit(f).alias("factor"), F.col(t).cast("double").alias("y"), F.col(f).cast("double").alias("x"))
            for t in targets for f in FACTORS
        ]))
    ).where("x is not null and y is not null")
    g = long.groupBy("target", "factor").agg(
        F.count("*").alias("n"), F.max("x").alias("hi"), F.min("x").alias("lo"), corr_safe(F.col("x"), F.col("y")).alias("r")
    ).where(F.col("n") >= min_n)
    flat = F.col("r").isNull() | (F.col("hi") == F.col("lo"))
    a = F.abs("r")
    return g.select(
        "target", "factor", "n", F.when(flat, 0.0).otherwise(F.col("r")).alias("r"),
        F.when(flat, "N/A").when(a >= 0.7, "strong").when(a >= 0.4, "medium").when(a >= 0.2, "weak").otherwise("negligible").alias("strength"),
        F.when(flat, "N/A").when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
    )


def _ym():
    return F.col("year") * 12 + F.col("month") - 1


def rate_periods(joined: DataFrame, periods: DataFrame) -> DataFrame:
    """Change from the baseline month to the end month of each labelled period
    (name, from_year, from_month, to_year, to_month); periods unfold to months."""
    p = periods.select(
        "name", F.explode(F.sequence(F.col("from_year") * 12 + F.col("from_month") - 1, F.col("to_year") * 12 + F.col("to_month") - 1)).alias("ym")
    )
    j = joined.withColumn("ym", _ym()).join(F.broadcast(p), "ym")
    first = lambda c: F.min_by(c, "ym")
    last = lambda c: F.max_by(c, "ym")
    pct = lambda c: (ratio(last(c), first(c).cast("double")) - 1) * 100
    return j.groupBy("name").agg(
        first("deposit_rate").alias("rate_start"), last("deposit_rate").alias("rate_end"),
        (last("deposit_rate") - first("deposit_rate")).alias("rate_change"), F.avg("guests").alias("avg_guests"),
        pct("guests").alias("guests_change_pct"), F.avg("revenue").alias("avg_revenue"), pct("revenue").alias("revenue_change_pct"),
    )


def with_changes(joined: DataFrame) -> DataFrame:
    """Adds the rate's move and the month-over-month percent of guests and revenue."""
    w = W.orderBy("year", "month")
    mom = lambda c: ratio(F.col(c) - F.lag(c).over(w), F.lag(c).over(w).cast("double")) * 100
    return joined.withColumns(
        {"rate_move": F.col("deposit_rate") - F.lag("deposit_rate").over(w), "guests_mom": mom("guests"), "revenue_mom": mom("revenue")}
    )


def rate_direction(joined: DataFrame, step: float = 0.05) -> DataFrame:
    """Months by direction of the rate: mean changes and share moving the other way."""
    m = F.col("rate_move")
    d = with_changes(joined).where("rate_move is not null").withColumn("direction", F.when(m > step, "up").when(m < -step, "down").otherwise("stable"))
    other = F.when(F.col("direction") == "up", F.col("guests_mom") < 0).when(F.col("direction") == "down", F.col("guests_mom") > 0)
    return d.groupBy("direction").agg(
        F.count("*").alias("months"), F.avg("guests_mom").alias("guests_mom"), F.avg("revenue_mom").alias("revenue_mom"),
        (F.avg(F.when(other, 1.0).when(~other, 0.0)) * 100).alias("opposite_pct"),
    )


def month_comment(joined: DataFrame, step: float = 0.2) -> DataFrame:
    m, g = F.col("rate_move"), F.col("guests_mom")
    c = F.when(F.abs(m) > step, F.when((m > 0) & (g < 0), "rate up, guests down").when((m > 0) & (g >= 0), "rate up, guests up")
               .when((m < 0) & (g > 0), "rate down, guests up").when((m < 0) & (g < 0), "rate down, guests down"))
    return with_changes(joined).withColumn("comment", F.coalesce(c, F.lit("")))


def trend(joined: DataFrame) -> DataFrame:
    """First against last month of every series."""
    aggs = []
    for c in [*FACTORS, "guests", "revenue"]:
        a, b = F.min_by(c, _ym()), F.max_by(c, _ym())
        aggs.append(F.struct(F.lit(c).alias("series"), a.cast("double").alias("first"), b.cast("double").alias("last"), ((ratio(b, a.cast("double")) - 1) * 100).alias("change_pct")).alias(c))
    row = joined.agg(*aggs)
    return row.select(F.inline(F.array(*[F.col(c) for c in [*FACTORS, "guests", "revenue"]])))
