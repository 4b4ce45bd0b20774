"""Statistics expressions with the guards the forecasting rules need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def ratio(num: Column, den: Column) -> Column:
    """num/den, null when den is 0 or null."""
    return num / F.nullif(den, F.lit(0.0))


def clip(c: Column, lo, hi) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.least(F.greatest(c, lo), hi)


def weekday_no(c: Column) -> Column:
    """Monday = 0."""
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    """Saturday or Sunday."""
    return F.weekday(c) >= 5


def is_weekend_kpi(c: Column) -> Column:
    """KPI reports count Friday to Sunday as weekend."""
    return F.weekday(c) >= 4


def corr_safe(x: Column, y: Column) -> Column:
    """Pearson r; null on a constant column (``corr`` raises there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def deal_out(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Counted distinct values with their cell: (keys, value, __n, __total, __cell)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    marks = F.percentile_approx(value, [k / bins for k in range(1, bins)], 50 * bins)
    span = counted.groupBy(*keys).agg(marks.alias("__marks"), F.sum("__n").alias("__total"))
    cell = F.size(F.filter("__marks", lambda x: x < F.col(value)))
    return (
        counted.alias("c")
        .join(span.alias("s"), _same(keys, "c", "s"))
        .select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col(value), "__n", "__total",
                cell.cast("long").alias("__cell"))
    )


def order_stats(df: DataFrame, keys: list[str], value: str, ranks: dict, bins: int = 128) -> DataFrame:
    """Exact values at 0-based ranks per key, also when one key holds most rows or values.

    ``ranks`` maps a name to a function of the group's size column. ``percentile`` merges a
    key's whole value map in one task. Here equal values are first counted (map-side). Each key's
    distinct values are cut into ``bins`` cells of about equal numbers of values, at marks from a
    mergeable quantile sketch, so that outliers and heavy tails leave no cell crowded; only the
    cells that hold a wanted rank are ordered. The marks only deal the values out: the result is
    exact. Nothing runs before the result is asked for. Also returns the size as ``__total``.
    """
    placed = deal_out(df, keys, value, bins)
    cells = placed.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__m"), F.max("__total").alias("__total"))
    before = W.partitionBy(*keys).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__m").over(before), F.lit(0)))
    wanted_ranks = {n: f(F.col("__total")) for n, f in ranks.items()}
    hit = F.lit(False)
    for r in wanted_ranks.values():
        hit = hit | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__m")))
    wanted = cells.where(hit).select(*keys, "__cell", "__before")
    inside = W.partitionBy(*keys, "__cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    rows = (
        placed.alias("c")
        .join(wanted.alias("s"), _same([*keys, "__cell"], "c", "s"))
        .select(*[F.col(f"c.{k}").alias(k) for k in keys], F.col("c.__cell").alias("__cell"),
                F.col(value), "__n", "__total", "__before")
        .withColumn("__from", F.col("__before") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    )
    picks = [
        F.max(F.when((r >= F.col("__from")) & (r < F.col("__from") + F.col("__n")), F.col(value))).alias(n)
        for n, r in wanted_ranks.items()
    ]
    return rows.groupBy(*keys).agg(F.max("__total").alias("__total"), *picks)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, safe for hot keys (see order_stats)."""
    ranks = {}
    for name, p in probs.items():
        ranks[f"__{name}_lo"] = lambda t, p=p: F.floor(F.lit(p) * (t - 1))
        ranks[f"__{name}_hi"] = lambda t, p=p: F.ceil(F.lit(p) * (t - 1))
    out = order_stats(df, keys, value, ranks)
    cols = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("__total") - 1)
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return out.select(*keys, *cols)


def _same(keys: list[str], a: str, b: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond
