"""Accuracy monitoring of a ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import ratio
from tidecast.operators.metrics import hit_abs, measures, metrics, metrics_sets, valid_pairs

CORE = ["n", "mae", "wmape", "rmse", "bias", "hit_rate"]


def with_weekday(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("weekday", F.date_format("date", "EEEE"))


def entity_day(ledger: DataFrame) -> DataFrame:
    """Per entity on daily totals: accuracy, best and worst day."""
    day = valid_pairs(ledger).groupBy("entity", "date").agg(F.sum("pred").alias("pred"), F.sum("actual").alias("actual"))
    e = F.col("pred") - F.col("actual")
    return day.groupBy("entity").agg(
        F.count("*").alias("n_days"), F.avg("actual").alias("avg_daily_actual"), F.avg(F.abs(e)).alias("mae"),
        (ratio(F.sum(F.abs(e)), F.sum("actual")) * 100).alias("wmape"), F.avg(e).alias("bias"),
        (F.avg(hit_abs().cast("double")) * 100).alias("hit_rate"),
        F.max(F.abs(e)).alias("worst_day_error"), F.min(F.abs(e)).alias("best_day_error"),
    )


def run_performance(ledger: DataFrame) -> DataFrame:
    """Per run date: coverage, accuracy (bias as actual - predicted), change against the
    previous run and a verdict. The result has one row per run, so its window is small."""
    ok = F.col("actual").isNotNull() & (F.col("pred") >= 0)
    e = F.when(ok, F.col("pred") - F.col("actual"))
    pos = ok & (F.col("actual") > 0)
    r = ledger.where("run_date is not null and date is not null").groupBy("run_date").agg(
        F.count_distinct(F.when(ok, F.col("entity"))).alias("__ev"), F.count_distinct("entity").alias("__ea"),
        F.count_distinct(F.when(ok, F.col("date"))).alias("__dv"), F.count_distinct("date").alias("__da"),
        F.count_if(ok).alias("__n"), F.count("pred").alias("predictions"),
        F.avg(F.abs(e)).alias("mae"),
        (ratio(F.sum(F.when(pos, F.abs(e))), F.sum(F.when(pos, F.col("actual")))) * 100).alias("wmape"),
        F.sqrt(F.avg(e * e)).alias("rmse"), (-F.avg(e)).alias("bias"),
        (F.avg(F.when(ok, F.when(F.abs(e) <= rules.HIT_ABS, 1.0).otherwise(0.0))) * 100).alias("hit_rate"),
    )
    has = F.col("__n") > 0
    r = r.select(
        "run_date",
        F.when(has, F.col("__ev")).otherwise(F.col("__ea")).alias("entities"),
        F.when(has, F.col("__dv")).otherwise(F.col("__da")).alias("days"),
        F.when(has, F.col("__n")).otherwise(F.col("predictions")).alias("samples"),
        F.when(has, F.col("__n") / F.greatest("predictions", F.lit(1)) * 100).otherwise(0.0).alias("actual_pct"),
        "mae", "wmape", "rmse", "bias", "hit_rate",
    )
    w = W.orderBy("run_date")
    for m in ("mae", "wmape", "rmse", "hit_rate"):
        r = r.withColumn(f"{m}_delta", F.col(m) - F.lag(m).over(w))
    a, b = F.col("mae_delta"), F.col("wmape_delta")
    score = F.lit(0)
    for name, (best, good, worst, bad) in rules.VERDICT_STEPS.items():
        sign = 1 if best > 0 else -1
        x = F.col(f"{name}_delta") * sign
        points = F.when(x > best * sign, 2).when(x > good * sign, 1).when(x < worst * sign, -2).when(x < bad * sign, -1).otherwise(0)
        score = score + points
    verdict = (
        F.when(F.col("mae").isNull() | (F.col("actual_pct") == 0), "PENDING")
        .when(a.isNull() | b.isNull(), "FIRST").when(score >= 2, "BETTER").when(score <= -2, "WORSE")
        .when(score == 0, "STABLE").when(score > 0, "SLIGHTLY_BETTER").otherwise("SLIGHTLY_WORSE")
    )
    return r.withColumn("verdict", verdict)


def rolling(ledger: DataFrame, today: str, windows=(7, 14, 30)) -> DataFrame:
    """Accuracy of the last N days, all windows in one pass."""
    t = F.lit(today).cast("date")
    recent = ledger.where(F.col("date") >= F.date_sub(t, max(windows)))
    in_w = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: F.col("date") >= F.date_sub(t, w))
    return metrics(recent.withColumn("window_days", F.explode(in_w)), ["window_days"])


def compare_ai(ledger: DataFrame) -> DataFrame:
    """Final forecast against the raw AI day value, on daily totals."""
    ok = ledger.where("pred is not null and actual > 0 and ai_raw is not null and coalesce(ai_available, false)")
    first = F.min_by("ai_raw", F.struct("entity", F.coalesce("shift", F.lit("")), F.coalesce("hour", F.lit(-1)), "run_date"))
    day = ok.groupBy("date").agg(F.sum("pred").alias("p"), F.sum("actual").alias("a"), first.alias("ai"))
    ens, ai = F.abs(F.col("p") - F.col("a")), F.abs(F.col("ai") - F.col("a"))
    r = day.agg(
        F.avg(ens).alias("ensemble_mae"), (ratio(F.sum(ens), F.sum("a")) * 100).alias("ensemble_wmape"),
        F.avg(ai).alias("ai_mae"), (ratio(F.sum(ai), F.sum("a")) * 100).alias("ai_wmape"),
    )
    return r.withColumns(
        {
            "winner": F.when(F.col("ensemble_mae") <= F.col("ai_mae"), "ensemble").otherwise("ai_raw"),
            "improvement": F.coalesce(ratio(F.col("ai_mae") - F.col("ensemble_mae"), F.col("ai_mae")) * 100, F.lit(0.0)),
        }
    )


def drift(ledger: DataFrame, today: str) -> DataFrame:
    """This week against last week; alerts as text joined in a fixed order, and as the columns that
    :func:`tidecast.operators.learn.absorb` reads (mape_change_pct, mape_alert, hit_alert)."""
    t = F.lit(today).cast("date")
    week = F.when(F.col("date") >= F.date_sub(t, 7), "this").when(F.col("date") >= F.date_sub(t, 14), "last")
    v = valid_pairs(ledger.where(F.col("date") >= F.date_sub(t, 14))).withColumn("week", week)
    m = measures()
    weeks = v.groupBy("week").agg(*[m[k].alias(k) for k in ("n", "mae", "wmape", "rmse", "hit_rate")])
    names = ["n", "mae", "wmape", "rmse", "hit_rate"]
    r = weeks.agg(*[F.max(F.when(F.col("week") == w, F.col(k))).alias(f"{k}_{w}") for w in ("this", "last") for k in names])
    for k in ("mae", "wmape", "rmse", "hit_rate"):
        last = F.when(F.col(f"{k}_last") > 0, F.col(f"{k}_last"))
        r = r.withColumn(f"{k}_change_pct", (F.col(f"{k}_this") - last) / last * 100)
    worse = F.coalesce(F.col("wmape_change_pct") > rules.DRIFT_PCT, F.lit(False))
    fewer = F.col("hit_rate_change_pct").isNotNull() & (F.col("hit_rate_this") - F.col("hit_rate_last") < -10)
    fewer = F.coalesce(fewer, F.lit(False))
    alerts = F.array_compact(
        F.array(
            F.when(worse, "WARNING wmape"),
            F.when(F.col("mae_change_pct") > 30, "WARNING mae"),
            F.when(fewer, "CRITICAL hit_rate"),
        )
    )
    return r.withColumns(
        {
            "alerts": F.array_join(alerts, "; "), "has_drift": F.size(alerts) > 0,
            "mape_change_pct": F.coalesce("wmape_change_pct", F.lit(0.0)), "mape_alert": worse, "hit_alert": fewer,
        }
    )


def problems(ledger: DataFrame, n: int = 20) -> DataFrame:
    """Worst entities, entities with one-sided errors, entities to retune."""
    m = metrics(ledger, ["entity"]).where(F.col("n") >= rules.MIN_ALERT_SAMPLES)
    worst = m.orderBy(F.desc_nulls_last("wmape"), "entity").limit(n).withColumn("problem", F.lit("worst"))
    bias = m.where(F.abs("bias") > F.col("mae") * 0.5).withColumn("problem", F.lit("high_bias"))
    tune = m.where(F.col("wmape") > rules.RETUNE_MAPE).withColumn("problem", F.lit("retune"))
    return worst.unionByName(bias).unionByName(tune)


def best_worst_days(per_entity_day: DataFrame, n: int = 10) -> DataFrame:
    best = per_entity_day.orderBy(F.desc("hit_rate"), "entity").limit(n).withColumn("rank_kind", F.lit("best"))
    worst = per_entity_day.orderBy(F.asc("hit_rate"), "entity").limit(n).withColumn("rank_kind", F.lit("worst"))
    return best.unionByName(worst)


def full_report(ledger: DataFrame, today: str) -> DataFrame:
    """All breakdowns as one long table (section, key, measures).

    Sections: overall, entity, weekday, hour, rolling, problem_*, entity_day (daily totals, n in
    days), worst_day and best_day (mae is the day's error), run (per run date, bias as actual -
    predicted), drift (this and last week) and model (ensemble and raw AI). Measures that a section
    does not have are null.
    """
    led = with_weekday(ledger)
    sets = metrics_sets(led, [[], ["entity"], ["weekday"], ["hour"]], CORE).where("level <> 'hour' or hour is not null")
    key = F.coalesce(
        F.when(F.col("level") == "entity", F.col("entity")), F.when(F.col("level") == "weekday", F.col("weekday")),
        F.when(F.col("level") == "hour", F.col("hour").cast("string")), F.lit("all"),
    )
    a = sets.select(F.col("level").alias("section"), key.alias("key"), *CORE)
    b = rolling(ledger, today).select(F.lit("rolling").alias("section"), F.col("window_days").cast("string").alias("key"), *CORE)
    c = problems(ledger).select(F.concat(F.lit("problem_"), "problem").alias("section"), F.col("entity").alias("key"), *CORE)
    days = entity_day(ledger)
    parts = [
        days.select(F.lit("entity_day").alias("section"), F.col("entity").alias("key"), F.col("n_days").alias("n"), "mae", "wmape", "bias", "hit_rate"),
        days.select(F.lit("worst_day").alias("section"), F.col("entity").alias("key"), F.col("worst_day_error").alias("mae")),
        days.select(F.lit("best_day").alias("section"), F.col("entity").alias("key"), F.col("best_day_error").alias("mae")),
        run_performance(ledger).select(
            F.lit("run").alias("section"), F.col("run_date").cast("string").alias("key"), F.col("samples").alias("n"), "mae", "wmape", "rmse", "bias", "hit_rate"),
        _rows(drift(ledger, today), "drift", {w: {k: f"{k}_{w}" for k in ("n", "mae", "wmape", "rmse", "hit_rate")} for w in ("this", "last")}),
        _rows(compare_ai(ledger), "model", {m: {k: f"{m}_{k}" for k in ("mae", "wmape")} for m in ("ensemble", "ai")}),
    ]
    out = a.unionByName(b).unionByName(c)
    for part in parts:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select("section", "key", *CORE)


def _rows(one: DataFrame, section: str, groups: dict[str, dict[str, str]]) -> DataFrame:
    """A one-row result as a row per group: measure to column."""
    names = next(iter(groups.values()))
    rows = [F.struct(F.lit(g).alias("key"), *[F.col(c).alias(k) for k, c in cols.items()]) for g, cols in groups.items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select(F.lit(section).alias("section"), "r.key", *[f"r.{k}" for k in names])


def top_worst(ledger: DataFrame, n: int = 20) -> DataFrame:
    m = metrics(ledger, ["entity"]).where(F.col("n") >= rules.MIN_ALERT_SAMPLES)
    return m.orderBy(F.desc_nulls_last("wmape"), "entity").limit(n)
