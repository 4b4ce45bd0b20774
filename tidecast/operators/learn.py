"""Learning loop: observed errors into state tables, and state into corrections.

State is kept in long tables: entity state (one row per entity with short history arrays),
key state (entity, scope, key, value, count) and segment state. A learning step is one
aggregate of the error rows, a full outer join with the old state and
``alpha * new + (1 - alpha) * old``; no step loops over entities.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.stats import clip, is_weekend, ratio
from tidecast.operators.metrics import hit_strict, metrics_segment, segment, valid_pairs, with_errors

# Fixed values of the learning rules.
TARGET = 25.0
MIN_ROWS = 10
MAX_CORRECTION = 0.35
MAX_EVENT_CORRECTION = 0.50
SIGNIFICANT_BIAS = 2.0
ISSUE_DAYS = 60
ITEM_ALPHA = 0.3
VALIDATE_DAYS = 7
VALIDATE_ROWS = 5



def errors(ledger: DataFrame) -> DataFrame:
    return with_errors(valid_pairs(ledger)).withColumn("weekday", F.date_format("date", "EEEE"))


def learning_rows(rows: DataFrame) -> DataFrame:
    """Rows each entity learns from: shift rows of shift mode if enough, else shift rows,
    else hourly rows, else all. Adds ``granularity``."""
    sh = F.col("shift").isin("MORNING", "EVENING")
    mode = sh & (F.col("mode") == "shift")
    n = rows.groupBy("entity").agg(
        F.count_if(mode).alias("n1"), F.count_if(sh).alias("n2"), F.count("hour").alias("n3")
    )
    pick = (
        F.when(F.col("n1") >= MIN_ROWS, "shift_mode").when(F.col("n2") >= MIN_ROWS, "shift")
        .when(F.col("n3") >= MIN_ROWS, "hourly").otherwise("mixed")
    )
    j = rows.join(n.select("entity", pick.alias("granularity")), "entity")
    g = F.col("granularity")
    keep = (
        F.when(g == "shift_mode", mode).when(g == "shift", sh).when(g == "hourly", F.col("hour").isNotNull())
        .otherwise(F.lit(True))
    )
    return j.where(F.coalesce(keep, F.lit(False)))


def alpha_of(last_mape: Column) -> Column:
    """Smoothing weight by the previous MAPE."""
    m = F.coalesce(last_mape, F.lit(0.0))
    return F.when(m > 80, 0.5).when(m > 50, 0.4).when(m > 25, 0.3).otherwise(0.2)


def _smooth(new: Column, old: Column, a: Column, start: float = 0.0) -> Column:
    return F.when(new.isNull(), old).otherwise(a * new + (1 - a) * F.coalesce(old, F.lit(start)))


def push(history: Column, value: Column, keep: int) -> Column:
    """Append a value and keep the last ``keep``."""
    h = F.concat(F.coalesce(history, F.array().cast("array<double>")), F.when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<double>")))
    return F.slice(h, F.greatest(F.size(h) - keep + 1, F.lit(1)), keep)


def last(arr: Column, back: int = 1) -> Column:
    return F.try_element_at(arr, F.lit(-back))


# -- entity state ---------------------------------------------------------------------------


def daily_mape(rows: DataFrame, by: list[str], pred: str = "pred") -> DataFrame:
    """Mean of the daily percentage errors (totals first)."""
    d = rows.groupBy(*by, "date").agg(F.sum(pred).alias("p"), F.sum("actual").alias("a")).where("a > 0")
    return d.groupBy(*by).agg((F.avg(F.abs(F.col("p") - F.col("a")) / F.col("a")) * 100).alias("mape"), F.count("*").alias("days"))


def step_entity(rows: DataFrame, old: DataFrame) -> DataFrame:
    """One run of the entity state: bias and history, MAPE and history, ratio anchor and
    correction factor. ``old`` has entity, overall_bias, last_mape, correction_factor,
    anchor, bias_history, mape_history."""
    pos = F.col("pred") > 0
    obs = rows.groupBy("entity").agg(
        F.count("*").alias("n"), F.avg("error").alias("obs_bias"),
        F.median(F.when(pos, F.col("actual") / F.nullif(F.col("pred"), F.lit(0.0)))).alias("obs_ratio"), F.count_if(pos).alias("n_ratio"),
    ).where(F.col("n") >= MIN_ROWS)
    obs = obs.join(daily_mape(rows, ["entity"]).select("entity", F.col("mape").alias("obs_mape")), "entity", "left")
    j = old.join(obs, "entity", "full")
    a = alpha_of(F.col("last_mape"))
    j = j.withColumn("overall_bias", _smooth(F.col("obs_bias"), F.col("overall_bias"), a))
    j = j.withColumn("bias_history", push(F.col("bias_history"), F.when(F.col("n").isNotNull(), F.col("overall_bias")), 10))
    j = j.withColumn("mape_history", push(F.col("mape_history"), F.col("obs_mape"), 30))
    j = j.withColumn("last_mape", F.coalesce("obs_mape", "last_mape"))
    return step_factor(j)


def step_factor(j: DataFrame) -> DataFrame:
    """Ratio anchor and correction factor from obs_ratio (n_ratio rows); a very bad entity
    with one-sided errors may move further."""
    a = alpha_of(F.col("last_mape"))
    r = F.when(F.col("n_ratio") >= MIN_ROWS, F.col("obs_ratio"))
    tail = F.slice(F.col("bias_history"), F.greatest(F.size("bias_history") - 4, F.lit(1)), 5)
    same = F.forall(tail, lambda b: b > 2) | F.forall(tail, lambda b: b < -2)
    wide = (F.col("last_mape") > 100) & (F.size("bias_history") >= 5) & same
    lim = F.when(F.coalesce(wide, F.lit(False)), clip(r, 0.40, 1.75)).otherwise(clip(r, 1 - MAX_CORRECTION, 1 + MAX_CORRECTION))
    lim = F.when(r.isNotNull(), lim)
    anchor = F.when(r.isNull(), F.col("anchor")).otherwise(
        clip(F.when(F.col("anchor").isNull(), r).otherwise(a * r + (1 - a) * F.col("anchor")), 0.5, 2.0)
    )
    return j.withColumns(
        {"anchor": anchor, "correction_factor": F.coalesce(_smooth(lim, F.col("correction_factor"), a, 1.0), F.lit(1.0))}
    ).drop("obs_bias", "obs_ratio", "obs_mape", "n", "n_ratio")


def empty_entity_state(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame(
        [], "entity string, overall_bias double, last_mape double, correction_factor double, anchor double, "
        "bias_history array<double>, mape_history array<double>",
    )


# -- key state --------------------------------------------------------------------------------


def observe_keys(rows: DataFrame, min_rows: int = 3) -> DataFrame:
    """Mean error per entity and key of every scope: weekday, shift, weekday_shift, hour
    (not for shift granularity), context and holiday, in one pass."""
    sh = F.col("shift").isin("MORNING", "EVENING")
    hol = F.coalesce("is_holiday", F.lit(False))
    ctx = F.concat_ws("__", "weekday", "shift", F.when(hol, "holiday").otherwise("normal"))
    s = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("key"))
    hour_ok = ~F.col("granularity").startswith("shift") & F.col("hour").isNotNull()
    groups = F.array_compact(
        F.array(
            s("weekday", F.col("weekday")), F.when(sh, s("shift", F.col("shift"))),
            F.when(sh, s("weekday_shift", F.concat_ws("__", "weekday", "shift"))),
            F.when(hour_ok, s("hour", F.col("hour").cast("string"))), F.when(sh, s("context", ctx)),
            F.when(hol, s("holiday", F.lit("all"))),
        )
    )
    return (
        rows.select("entity", "error", F.inline(groups)).groupBy("entity", "scope", "key")
        .agg(F.avg("error").alias("obs"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    )


def observe_events(rows: DataFrame, cal: DataFrame) -> DataFrame:
    """Mean over the dates of the mean error, per event type (event day, else holiday)."""
    from tidecast.operators.calendar import event_on

    kind = F.coalesce(event_on(F.col("date"))["type"], F.col("holiday_type"))
    c = cal.select("date", kind.alias("key")).where("key is not null")
    d = rows.join(F.broadcast(c), "date").groupBy("entity", "key", "date").agg(F.avg("error").alias("e"), F.count("*").alias("k"))
    return d.groupBy("entity", F.lit("event").alias("scope"), "key").agg(F.avg("e").alias("obs"), F.sum("k").alias("n"))


def merge_keys(old: DataFrame, obs: DataFrame, entity_state: DataFrame) -> DataFrame:
    """Smooth the observed keys into the old ones; keys without news stay."""
    a = entity_state.select("entity", alpha_of(F.col("last_mape")).alias("a"))
    j = old.join(obs, ["entity", "scope", "key"], "full").join(a, "entity", "left")
    v = _smooth(F.col("obs"), F.col("value"), F.coalesce("a", F.lit(0.2)))
    count = F.coalesce("count", F.lit(0)) + F.coalesce("n", F.lit(0))
    return j.select("entity", "scope", "key", v.alias("value"), count.cast("long").alias("count"))


def empty_keys(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "entity string, scope string, key string, value double, count long")


def seasonal_step(rows: DataFrame, old: DataFrame, entity_state: DataFrame) -> DataFrame:
    """Monthly means of actual, forecast and bias, smoothed; counts add up."""
    obs = rows.groupBy("entity", F.month("date").alias("month")).agg(
        F.avg("actual").alias("oa"), F.avg("pred").alias("op"), F.avg("error").alias("ob"), F.count("*").alias("on")
    ).where(F.col("on") >= 3)
    a = entity_state.select("entity", alpha_of(F.col("last_mape")).alias("a"))
    j = old.join(obs, ["entity", "month"], "full").join(a, "entity", "left")
    al = F.coalesce("a", F.lit(0.2))
    mix = lambda new, o: F.when(new.isNull(), o).otherwise(al * new + (1 - al) * F.coalesce(o, new))
    return j.select(
        "entity", "month", mix(F.col("oa"), F.col("avg_actual")).alias("avg_actual"),
        mix(F.col("op"), F.col("avg_pred")).alias("avg_pred"), mix(F.col("ob"), F.col("bias")).alias("bias"),
        (F.coalesce("count", F.lit(0)) + F.coalesce("on", F.lit(0))).cast("long").alias("count"),
    )


def empty_seasonal(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "entity string, month int, avg_actual double, avg_pred double, bias double, count long")


def global_patterns(rows: DataFrame) -> DataFrame:
    """System-wide mean errors: weekend, weekday, hour, holiday percent, month, MAPE."""
    s = lambda scope, key: F.struct(F.lit(scope).alias("scope"), key.alias("key"))
    groups = F.array_compact(
        F.array(
            s("all", F.lit("all")), F.when(is_weekend(F.col("date")), s("weekend", F.lit("all"))),
            s("weekday", F.col("weekday")), F.when(F.col("hour").isNotNull(), s("hour", F.col("hour").cast("string"))),
            F.when(F.coalesce("is_holiday", F.lit(False)), s("holiday", F.lit("all"))),
            s("month", F.month("date").cast("string")),
        )
    )
    g = rows.select("error", "pct_error", "signed_pct", "actual", "pred", F.inline(groups)).groupBy("scope", "key")
    return g.agg(
        F.avg("error").alias("bias"), F.avg("pct_error").alias("mape"), F.avg("signed_pct").alias("signed_pct"),
        F.avg("actual").alias("avg_actual"), F.avg("pred").alias("avg_pred"), F.count("*").alias("n"),
    )


# -- model skill and strategy -------------------------------------------------------------------


def skill(rows: DataFrame, models: dict[str, str]) -> DataFrame:
    """Daily MAPE and utility per model column, and the blend weights they give."""
    arr = F.array(*[F.struct(F.lit(k).alias("skill"), F.col(c).alias("p")) for k, c in models.items()])
    long = rows.where("actual > 0").select("entity", "date", "actual", F.inline(arr)).where("p is not null")
    n = long.groupBy("entity", "skill").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_ROWS)
    m = daily_mape(long.join(n, ["entity", "skill"], "left_semi"), ["entity", "skill"], "p")
    return m.withColumn("utility", clip(1 - F.col("mape") / 100, 0.0, 1.0))


def merge_skill(old: DataFrame, new: DataFrame, entity_state: DataFrame) -> DataFrame:
    a = entity_state.select("entity", alpha_of(F.col("last_mape")).alias("a"))
    j = old.withColumnsRenamed({"mape": "om", "utility": "ou", "days": "od"}).join(new, ["entity", "skill"], "full").join(a, "entity", "left")
    al = F.coalesce("a", F.lit(0.2))
    mix = lambda n, o: F.when(F.col(n).isNull(), F.col(o)).otherwise(al * F.col(n) + (1 - al) * F.coalesce(o, n))
    return j.select("entity", "skill", mix("mape", "om").alias("mape"), mix("utility", "ou").alias("utility"), F.coalesce("days", "od").alias("days"))


def dynamic_weights(skills: DataFrame) -> DataFrame:
    u = lambda k, d: F.coalesce(F.max(F.when(F.col("skill") == k, F.col("utility"))), F.lit(d))
    g = skills.groupBy("entity").agg(u("ml", 0.5).alias("ml"), u("ai", 0.3).alias("ai"), u("prophet", 0.4).alias("pr"))
    ml = 0.7 * F.col("ml") + 0.3 * F.col("pr")
    g = g.withColumn("w", ratio(ml, ml + F.col("ai"))).where("w is not null")
    w = clip(F.col("w"), 0.15, 0.85)
    return g.select("entity", w.alias("ml_weight"), (1 - w).alias("ai_weight"))


def best_strategy(rows: DataFrame) -> DataFrame:
    """Daily MAPE of the system value and of the AI day value, and the strategy they favour."""
    v = rows.where("actual > 0")
    first = F.min_by("ai_raw", F.struct(F.coalesce("shift", F.lit("")), F.coalesce("hour", F.lit(-1)), "run_date"))
    pct = F.avg(F.abs(F.col("p") - F.col("a")) / F.col("a")) * 100

    def one(src, pred, name):
        d = src.groupBy("entity", "date").agg(pred.alias("p"), F.sum("actual").alias("a"), F.count("*").alias("k"))
        return d.groupBy("entity").agg(F.sum("k").alias("rows"), F.count("*").alias("days"), pct.alias(name)).where(
            (F.col("rows") >= 10) & (F.col("days") >= 5)
        ).select("entity", name)

    ml = one(v.where("pre_system is not null"), F.sum("pre_system"), "ml_mape")
    ai = one(v.where("ai_raw is not null"), first, "ai_mape")
    j = ml.join(ai, "entity", "full")
    a, b = F.col("ml_mape"), F.col("ai_mape")
    s = (
        F.when(a < b * 0.7, "ML_PRIMARY_AI_VALIDATE").when(b < a * 0.7, "AI_PRIMARY_ML_SECONDARY")
        .when(a < b, "ENSEMBLE_WEIGHTED").when(a >= b, "ENSEMBLE_EQUAL")
    )
    return j.withColumn("best_strategy", s)


# -- segments ------------------------------------------------------------------------------------


def segment_step(rows: DataFrame, old: DataFrame, entity_state: DataFrame, min_rows: int = 5) -> DataFrame:
    """Factor, bias, hit share and confidence per entity and segment."""
    v = rows.where("actual > 0 and pred > 0").withColumn("segment", segment())
    enough = v.groupBy("entity").agg(F.count("*").alias("k")).where(F.col("k") >= MIN_ROWS)
    obs = v.join(enough, "entity", "left_semi").groupBy("entity", "segment").agg(
        F.count("*").alias("n"), F.avg("error").alias("ob"), F.median(F.col("actual") / F.col("pred")).alias("r"),
        (F.avg(F.abs("error") / F.col("actual")) * 100).alias("nm"), F.avg(hit_strict().cast("double")).alias("nh"),
    ).where(F.col("n") >= min_rows)
    big = F.col("segment").endswith("LARGE")
    obs = obs.withColumn("of", F.when(big, clip(F.col("r"), *rules.SEGMENT_FACTOR_LARGE)).otherwise(clip(F.col("r"), *rules.SEGMENT_FACTOR))).drop("r")
    a = entity_state.select("entity", alpha_of(F.col("last_mape")).alias("a"))
    j = old.join(obs, ["entity", "segment"], "full").join(a, "entity", "left")
    al = F.coalesce("a", F.lit(0.2))
    news = F.col("n").isNotNull()
    bias = _smooth(F.col("ob"), F.col("bias"), al)
    j = j.withColumn("__b", bias)
    most = rules.DIRECTION_BIAS
    direction = F.when(F.col("__b") > most, "CONSISTENT_OVER").when(F.col("__b") < -most, "CONSISTENT_UNDER").otherwise("MIXED")
    c = rules.SEGMENT_CONFIDENCE
    conf = clip(F.coalesce("confidence", F.lit(c["start"])) + c["step"], c["least"], c["most"])
    return j.select(
        "entity", "segment", _smooth(F.col("of"), F.col("factor"), al, 1.0).alias("factor"), F.col("__b").alias("bias"),
        F.when(news, direction).otherwise(F.col("direction")).alias("direction"), F.coalesce("nm", "mape").alias("mape"),
        F.coalesce("nh", "hit_rate").alias("hit_rate"), F.coalesce("n", "samples").alias("samples"),
        F.when(news, conf).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("validated", F.lit(False)).alias("validated"),
    )


def empty_segments(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "entity string, segment string, factor double, bias double, direction string, mape double, hit_rate double, "
        "samples long, confidence double, validated boolean",
    )


def bias_direction(history: Column) -> Column:
    """Direction of the last ten biases; null with fewer than five."""
    h = F.slice(history, F.greatest(F.size(history) - 9, F.lit(1)), 10)
    most = rules.DIRECTION_BIAS
    return F.when(F.size(h) >= 5, F.when(F.forall(h, lambda b: b > most), "CONSISTENT_OVER")
                  .when(F.forall(h, lambda b: b < -most), "CONSISTENT_UNDER").otherwise("MIXED"))


def escalate(state: DataFrame) -> DataFrame:
    """Directional push, then the stagnation rule, on correction_factor and escalation."""
    h = F.col("bias_history")
    five = F.slice(h, F.greatest(F.size(h) - 4, F.lit(1)), 5)
    m = F.coalesce("last_mape", F.lit(0.0))
    cf = F.col("correction_factor")
    (large, small), (fast, slow), most = rules.ESCALATE_STEPS, rules.ESCALATE_BACK, rules.DIRECTION_BIAS
    step = F.when(m > rules.ESCALATE_MAPE, large).otherwise(small)
    off = F.abs(cf - 1.0) > rules.ESCALATE_OFF
    over, under = F.forall(five, lambda b: b > most), F.forall(five, lambda b: b < -most)
    first = (
        F.when(F.size(h) < 5, cf)
        .when(m <= TARGET, F.when(off, cf + (1 - cf) * fast).otherwise(cf))
        .when(over, F.greatest(F.lit(1 - MAX_CORRECTION), cf - step))
        .when(under, F.least(F.lit(1 + MAX_CORRECTION), cf + step))
        .otherwise(F.when(off, cf + (1 - cf) * slow).otherwise(cf))
    )
    s = state.withColumn("correction_factor", first)
    q = F.col("mape_history")
    n = F.size(q)
    mean3 = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / 3
    recent, older = mean3(F.slice(q, n - 2, 3)), mean3(F.slice(q, n - 5, 3))
    cf = F.col("correction_factor")
    rule = rules.STAGNATION
    decayed = F.when(F.abs(cf - 1.0) > rule["off"], cf + (1 - cf) * rule["back"]).otherwise(cf)
    good = F.when(F.abs(cf - 1.0) > rules.ESCALATE_OFF, cf + (1 - cf) * fast).otherwise(cf)
    level = F.coalesce("escalation_level", F.lit(0))
    three = F.slice(h, F.greatest(F.size(h) - 2, F.lit(1)), 3)
    mixed = (F.size(h) >= 3) & ~(F.forall(three, lambda b: b > 0) | F.forall(three, lambda b: b < 0))
    better = recent < older * rule["better"]
    flat = F.abs(recent - older) / F.greatest(older, F.lit(1.0)) < rule["flat"]
    up = F.least(F.lit(rule["top"]), level + 1)
    b = F.col("overall_bias")
    pushed = F.when(b > 0, decayed - up * rule["push"]).when(b < 0, decayed + up * rule["push"])
    active = n >= rule["runs"]
    case = (
        F.when(~active, "none").when(m <= TARGET, "good").when(better, "better").when(mixed, "mixed").when(flat, "flat").otherwise("rest")
    )
    s = s.withColumn("__case", case)
    c = F.col("__case")
    return s.withColumns(
        {
            "correction_factor": F.when(c == "none", cf).when(c == "good", good)
            .when((c == "flat") & pushed.isNotNull(), clip(pushed, 1 - MAX_CORRECTION, 1 + MAX_CORRECTION)).otherwise(decayed),
            "escalation_level": F.when(c == "good", F.lit(0)).when(c == "better", F.greatest(F.lit(0), level - 1))
            .when(c == "flat", up).otherwise(level),
        }
    ).drop("__case")


def hard_reset(state: DataFrame, when: Column, reason: str, today: str) -> DataFrame:
    """Clear learned corrections where ``when`` holds; histories stay."""
    return state.withColumns(
        {
            "reset_reason": F.when(when, reason), "reset_at": F.when(when, today),
            "old_correction_factor": F.when(when, F.col("correction_factor")), "old_bias": F.when(when, F.col("overall_bias")),
            "anchor": F.when(~when, F.col("anchor")),
            "escalation_level": F.when(when, 0).otherwise(F.col("escalation_level")),
            "needs_retune": when | F.coalesce("needs_retune", F.lit(False)),
            "__cf": F.when(when, 1.0).otherwise(F.col("correction_factor")),
            "__b": F.when(when, 0.0).otherwise(F.col("overall_bias")),
        }
    ).drop("correction_factor", "overall_bias").withColumnsRenamed({"__cf": "correction_factor", "__b": "overall_bias"})


def clear_keys(keys: DataFrame, reset_entities: DataFrame) -> DataFrame:
    """Key state without the reset entities' keys."""
    return keys.join(reset_entities.select("entity"), "entity", "left_anti")


# -- issues ------------------------------------------------------------------------------------------


def issues(rows: DataFrame, today: str) -> DataFrame:
    """Days with more than 25 % error, typed, and one-sided weeks (5 of the last 7 days)."""
    d = rows.groupBy("entity", "date").agg(
        F.sum("error").alias("e"), F.sum("pred").alias("predicted"), F.sum("actual").alias("actual"),
        F.max(F.coalesce("is_holiday", F.lit(False))).alias("hol"),
    )
    a = F.nullif(F.col("actual"), F.lit(0.0))
    d = d.withColumns({"pct": F.abs("e") / a * 100, "signed": F.col("e") / a * 100})
    p, s = F.col("pct"), F.col("signed")
    kind = (
        F.when(F.col("hol"), "HOLIDAY_SPIKE").when(p > 50, "EXTREME_ERROR").when(s > 25, "OVERPREDICT")
        .when(s < -25, "UNDERPREDICT").when(is_weekend(F.col("date")), "WEEKEND_ANOMALY").otherwise("HIGH_ERROR")
    )
    days = d.where(p > TARGET).select("entity", "date", kind.alias("type"), p.alias("error_pct"))
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date")))
    week = d.withColumn("rn", rn).where(F.col("rn") <= 7).groupBy("entity").agg(
        F.count("*").alias("n"), F.count_if(s > 10).alias("over"), F.count_if(s < -10).alias("under"), F.avg(s).alias("m")
    ).where(F.col("n") == 7)
    t = F.lit(today).cast("date").alias("date")
    a1 = week.where("over >= 5").select("entity", t, F.lit("CONSISTENT_OVERPREDICT").alias("type"), F.col("m").alias("error_pct"))
    a2 = week.where("under >= 5").select("entity", t, F.lit("CONSISTENT_UNDERPREDICT").alias("type"), F.col("m").alias("error_pct"))
    return days.unionByName(a1).unionByName(a2)


def merge_issues(old: DataFrame, new: DataFrame, today: str, keep: int = 100) -> DataFrame:
    """New issues win over old ones of the same day and type; old ones expire; last 100."""
    fresh = old.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), ISSUE_DAYS)).withColumn("src", F.lit(1))
    both = new.withColumn("src", F.lit(0)).unionByName(fresh)
    one = both.groupBy("entity", "date", "type").agg(F.min_by("error_pct", "src").alias("error_pct"))
    rn = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date"), "type"))
    return one.withColumn("rn", rn).where(F.col("rn") <= keep).drop("rn")


# -- monitoring feedback --------------------------------------------------------------------------------


def accuracy_trend(history: DataFrame) -> DataFrame:
    """One row from the last seven snapshots (date, mape): change of the later half."""
    h = history.where("mape is not null").orderBy(F.desc("date")).limit(7)
    arr = F.sort_array(F.collect_list(F.struct("date", "mape")))
    a = h.agg(F.transform(arr, lambda x: x["mape"]).alias("m"))
    n = F.size("m")
    half = F.floor(n / 2).cast("int")
    mean = lambda x, k: F.aggregate(x, F.lit(0.0), lambda p, q: p + q) / k
    first = mean(F.slice("m", 1, F.greatest(half, F.lit(1))), F.greatest(half, F.lit(1)))
    second = mean(F.slice("m", half + 1, F.greatest(n - half, F.lit(1))), F.greatest(n - half, F.lit(1)))
    pct = F.coalesce(ratio(second - first, first) * 100, F.lit(0.0))
    return a.where(n >= 3).select(
        pct.alias("trend_pct"), n.alias("points"),
        F.when(pct < -3, "improving").when(pct > 3, "degrading").otherwise("stable").alias("direction"),
    )


def absorb(state: DataFrame, per_entity: DataFrame, drift: DataFrame, trend: DataFrame, today: str) -> DataFrame:
    """Monitoring results into the state: hit rates, drift boosts, hard resets after three
    falls, retune flags, long-term trend.

    per_entity: entity, wmape, mae, bias, hit_rate, retune. drift: one row with
    mape_change_pct, mape_alert, hit_alert. trend: one row with trend_pct."""
    lim = lambda c: clip(c, 1 - MAX_CORRECTION, 1 + MAX_CORRECTION)
    m = per_entity.select("entity", F.col("wmape").alias("__m"), F.col("hit_rate").alias("__h"), F.col("retune").alias("__r"))
    s = state.join(m, "entity", "left")
    change, alert = drift.select("mape_change_pct").scalar(), drift.select("mape_alert").scalar()
    hit_alert, trend_pct = drift.select("hit_alert").scalar(), trend.select("trend_pct").scalar()
    s = s.withColumns(
        {
            "last_hit_rate": F.when(F.col("__h").isNotNull(), F.col("monitoring_hit_rate")).otherwise(F.col("last_hit_rate")),
            "monitoring_hit_rate": F.coalesce("__h", "monitoring_hit_rate"), "monitoring_mape": F.col("__m"),
            "__change": change, "__alert": alert, "__hit": hit_alert, "__trend": trend_pct,
        }
    )
    b, cf = F.col("overall_bias"), F.col("correction_factor")

    def push_by(boost, strict):
        hi, lo = (SIGNIFICANT_BIAS, -SIGNIFICANT_BIAS) if strict else (0.0, 0.0)
        return F.when(F.col("overall_bias") > hi, F.col("correction_factor") - boost).when(
            F.col("overall_bias") < lo, F.col("correction_factor") + boost)

    boost = F.least(F.lit(0.05), F.col("__change") / 1000)
    moved = push_by(boost, True)
    s = s.withColumn("correction_factor", F.when(F.col("__alert") & (F.col("__change") > 0) & moved.isNotNull(), lim(moved)).otherwise(cf))
    hr, prev = F.col("monitoring_hit_rate"), F.col("last_hit_rate")
    drops = F.when(F.col("__hit") & (hr < prev - 2), F.col("hr_drops") + 1).when(F.col("__hit") & (hr >= prev), 0).otherwise(F.col("hr_drops"))
    s = s.withColumn("hr_drops", drops)
    reset = F.col("__hit") & (F.col("hr_drops") >= 3)
    s = hard_reset(s.withColumn("__reset", F.coalesce(reset, F.lit(False))), F.col("__reset"), "hit rate fell", today)
    weak = F.coalesce(F.col("__hit") & ~F.col("__reset") & (hr < 50), F.lit(False))
    hit_boost = F.least(F.lit(0.08), (50 - hr) / 500)
    pushed = F.coalesce(push_by(hit_boost, True), F.col("correction_factor"))
    s = s.withColumns(
        {
            "correction_factor": F.when(weak, lim(pushed)).otherwise(F.col("correction_factor")),
            "escalation_level": F.when(weak, F.least(F.lit(5), F.col("escalation_level") + 1)).otherwise(F.col("escalation_level")),
            "hr_drops": F.when(F.col("__reset"), 0).otherwise(F.col("hr_drops")),
        }
    )
    ret = F.coalesce("__r", F.lit(False))
    rb = F.least(F.lit(0.15), F.greatest(F.lit(0.03), F.coalesce("__m", "last_mape", F.lit(50.0)) / 1000))
    s = s.withColumns(
        {
            "correction_factor": F.when(ret, lim(F.coalesce(push_by(rb, False), F.col("correction_factor")))).otherwise(F.col("correction_factor")),
            "escalation_level": F.when(ret, F.least(F.lit(5), F.col("escalation_level") + 2)).otherwise(F.col("escalation_level")),
            "needs_retune": ret,
        }
    )
    tb = F.least(F.lit(0.03), F.col("__trend") / 500)
    tm = push_by(tb, True)
    late = (F.col("__trend") > 10) & tm.isNotNull()
    return s.withColumn("correction_factor", F.when(late, lim(tm)).otherwise(F.col("correction_factor"))).drop(
        "__m", "__h", "__r", "__change", "__alert", "__hit", "__trend", "__reset")


# -- applying the state -----------------------------------------------------------------------------------


def key_maps(keys: DataFrame) -> DataFrame:
    """Key state per entity as one map 'scope|key' -> value (a few hundred entries at most)."""
    e = F.struct(F.concat_ws("|", "scope", "key"), "value")
    return keys.groupBy("entity").agg(F.map_from_entries(F.collect_list(e)).alias("learned"))


def apply(pred: DataFrame, state: DataFrame, keys: DataFrame, segments: DataFrame, seasonal: DataFrame) -> DataFrame:
    """Correct forecasts in fixed order: factor, segment, bias, one specific shift bias
    (context, else weekday and shift, else weekday plus shift), hour, holiday, event, month,
    anchor, clamp. Steps stay as columns so that they can be checked.

    pred: entity, date, shift, hour, forecast, avg_daily, is_holiday, holiday_type,
    is_special_event, event_type. Segment size is looked up by the entity's mean level."""
    seg = segments.select("entity", "segment", F.col("factor").alias("sf"), F.col("bias").alias("sb"), F.col("confidence").alias("sc"))
    mon = seasonal.select("entity", "month", F.col("bias").alias("mb"), F.col("count").alias("mc"))
    size = F.coalesce(F.nullif("avg_daily", F.lit(0.0)), F.col("forecast"))
    p = pred.withColumns({"segment": segment(size), "month": F.month("date"), "weekday": F.date_format("date", "EEEE")})
    p = p.join(state.select("entity", "overall_bias", "last_mape", "correction_factor", "anchor", "escalation_level", "needs_retune"), "entity", "left")
    p = p.join(key_maps(keys), "entity", "left").join(seg, ["entity", "segment"], "left").join(mon, ["entity", "month"], "left")
    known = F.col("correction_factor").isNotNull() & (F.col("forecast") > 0)
    m, lvl = F.coalesce("last_mape", F.lit(0.0)), F.coalesce("escalation_level", F.lit(0))
    tier = F.when((m > 80) | (lvl >= 2), 3).when((m > 50) | (lvl >= 1), 2).when(m > 25, 1).otherwise(0)
    p = p.withColumn("tier", tier)
    t = F.col("tier")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), t + 1)
    bias_s, wd_s, sh_s = pick(0.5, 0.7, 0.8, 0.9), pick(0.4, 0.6, 0.7, 0.8), pick(0.4, 0.6, 0.7, 0.8)
    hour_s, hol_s, ev_s = pick(0.3, 0.5, 0.6, 0.7), pick(0.4, 0.6, 0.7, 0.8), pick(0.5, 0.7, 0.8, 0.9)
    get = lambda scope, key: F.try_element_at("learned", F.concat(F.lit(f"{scope}|"), key))
    cf = F.col("correction_factor")
    p = p.withColumn("a1", F.col("forecast") * F.when(F.abs(cf - 1) >= 0.01, cf).otherwise(1.0))
    # Segment: some segments learn upward corrections only partly or not at all.
    ml, ms = F.col("segment") == "MORNING|WEEKDAY|LARGE", F.col("segment") == "MORNING|WEEKDAY|SMALL"
    f0, b0 = F.col("sf"), F.col("sb")
    st = clip(F.col("sc"), 0.25, 0.85)
    st = F.when(ml, F.least(st, F.lit(0.35))).when(ms, F.least(st, F.lit(0.20))).otherwise(st)
    f1 = F.when(ml & (f0 > 1), 1 + (f0 - 1) * 0.45).when(ms & (f0 > 1), 1.0).otherwise(f0)
    b1 = F.when(ml & (b0 < 0), b0 * 0.45).when(ms & (b0 < 0), 0.0).otherwise(b0)
    a2 = F.col("a1") * F.when(F.abs(f1 - 1) >= 0.01, 1 + (f1 - 1) * st).otherwise(1.0)
    a2 = a2 - F.when(F.abs(b1) >= 1.0, b1 * F.least(F.lit(0.75), st)).otherwise(0.0)
    p = p.withColumn("a2", F.when(F.col("sf").isNotNull(), a2).otherwise(F.col("a1")))
    ob = F.col("overall_bias")
    p = p.withColumn("a3", F.col("a2") - F.when(F.abs(ob) >= SIGNIFICANT_BIAS, ob * bias_s).otherwise(0.0))
    shifted = F.col("shift").isin("MORNING", "EVENING")
    ctx = F.when(shifted, get("context", F.concat_ws("__", "weekday", "shift", F.when(F.col("is_holiday"), "holiday").otherwise("normal"))))
    ws = F.when(shifted, get("weekday_shift", F.concat_ws("__", "weekday", "shift")))
    wd, sb = get("weekday", F.col("weekday")), get("shift", F.col("shift"))
    over = lambda c, lim, s: F.when(F.abs(c) >= lim, c * s).otherwise(0.0)
    specific = (
        F.when(F.abs(ctx) >= 1.0, ctx * sh_s).when(ws.isNotNull(), over(ws, 0.5, sh_s))
        .otherwise(F.coalesce(over(wd, 0.5, wd_s), F.lit(0.0)) + F.coalesce(over(sb, 0.5, sh_s), F.lit(0.0)))
    )
    p = p.withColumn("a4", F.col("a3") - specific)
    hb = F.when(~F.coalesce(shifted, F.lit(False)), get("hour", F.col("hour").cast("string")))
    hol = F.when(F.col("is_holiday"), get("holiday", F.lit("all")))
    ev = F.coalesce(get("event", F.col("event_type")), F.when(F.col("is_special_event") & F.col("is_holiday"), get("event", F.col("holiday_type"))))
    zero = F.lit(0.0)
    p = p.withColumn(
        "a5", F.col("a4") - F.coalesce(over(hb, 0.3, hour_s), zero) - F.coalesce(over(hol, 1.0, hol_s), zero) - F.coalesce(over(ev, 0.5, ev_s), zero)
    )
    season = F.when((F.col("mc") >= 30) & (F.abs("mb") >= 1.5), F.col("mb") * F.least(F.lit(0.4), bias_s * 0.5)).otherwise(0.0)
    p = p.withColumn("a6", F.col("a5") - season)
    an = F.col("anchor")
    use = (F.abs(an - 1) > 0.05) & (F.abs(cf - 1) < 0.03)
    s = F.least(F.lit(0.3), m / 300)
    p = p.withColumn("a7", F.when(use, F.col("a6") * (1 - s) + F.col("forecast") * an * s).otherwise(F.col("a6")))
    span = (
        F.when((m > 200) | F.coalesce("needs_retune", F.lit(False)), 0.85)
        .when(F.coalesce("is_special_event", F.lit(False)), MAX_EVENT_CORRECTION).when(m > 100, 0.70).when(m > 50, MAX_CORRECTION).otherwise(0.40)
    )
    v = F.greatest(F.lit(0.0), F.bround(clip(F.col("a7"), F.col("forecast") * (1 - span), F.col("forecast") * (1 + span)), 0))
    return p.withColumns({"corrected": F.when(known, v).otherwise(F.col("forecast")), "tier": F.col("tier")}).drop(
        "learned", "sf", "sb", "sc", "mb", "mc")


# -- reports on the state ------------------------------------------------------------------------------------


def diagnose(state: DataFrame, keys: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Root causes and grade per entity."""
    wd = keys.where("scope = 'weekday' and abs(value) > 3").groupBy("entity").agg(F.max_by("key", F.struct(F.abs("value"), "key")).alias("worst_day"))
    hr = keys.where("scope = 'hour' and abs(value) > 2").groupBy("entity").agg(F.max_by("key", F.struct(F.abs("value"), "key")).alias("worst_hour"))
    hol = keys.where("scope = 'holiday'").groupBy("entity").agg(F.max("value").alias("hol"))
    ext = issue_rows.where("type = 'EXTREME_ERROR'").groupBy("entity").agg(F.count("*").alias("extreme"))
    j = reduce(lambda a, b: a.join(b, "entity", "left"), [state, wd, hr, hol, ext])
    b, m = F.col("overall_bias"), F.coalesce("last_mape", F.lit(0.0))
    h1, h2, h3 = last(F.col("mape_history"), 1), last(F.col("mape_history"), 2), last(F.col("mape_history"), 3)
    causes = F.array_compact(
        F.array(
            F.when(F.abs(b) >= 5, F.concat(F.lit("systematic "), F.when(b > 0, "over").otherwise("under"))),
            F.when(F.col("worst_day").isNotNull(), F.concat(F.lit("weekday "), F.col("worst_day"))),
            F.when(F.col("worst_hour").isNotNull(), F.concat(F.lit("hour "), F.col("worst_hour"))),
            F.when(F.col("ml_mape") < F.col("ai_mape") * 0.6, "ai much worse").when(F.col("ai_mape") < F.col("ml_mape") * 0.6, "ml much worse"),
            F.when(F.abs("hol") > 5, F.concat(F.lit("holiday "), F.when(F.col("hol") > 0, "over").otherwise("under"))),
            F.when(F.col("extreme") >= 3, "extreme errors"),
            F.when((h1 >= h2) & (h2 >= h3) & ~((h1 <= h2) & (h2 <= h3)), "mape rising"),
        )
    )
    grade = F.when(m <= 25, "GOOD").when(m <= 40, "FAIR").otherwise("POOR")
    return j.select("entity", F.when(F.size(causes) > 0, F.array_join(causes, "; ")).otherwise("none found").alias("causes"), grade.alias("grade"))


def insights(state: DataFrame) -> DataFrame:
    """High MAPE, improving or degrading against three runs ago, strategy override."""
    h = F.col("mape_history")
    now, before = last(h, 1), last(h, 3)
    trend = F.when(F.size(h) >= 3, F.when(now < before * 0.85, "improving").when(now > before * 1.15, "degrading"))
    return state.select(
        "entity", "last_mape", (F.coalesce("last_mape", F.lit(0.0)) > TARGET).alias("high_mape"),
        F.coalesce(trend, F.lit("steady")).alias("trend"), F.col("best_strategy").alias("override"),
    )


def correction_summary(state: DataFrame) -> DataFrame:
    """Factor, bias, MAPE and its trend per entity."""
    h = F.col("mape_history")
    n = F.size(h)
    mean = lambda a, k: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / k
    recent = mean(F.slice(h, F.greatest(n - 2, F.lit(1)), 3), 3)
    k = F.when(n >= 6, 3).otherwise(F.floor(n / 2).cast("int") + 1)
    older = mean(F.slice(h, F.lit(1), k), k)
    trend = F.when(n >= 3, F.when(recent < older * 0.95, "improving").when(recent > older * 1.05, "worsening").otherwise("stable")).otherwise("N/A")
    return state.select("entity", "correction_factor", "overall_bias", "last_mape", trend.alias("mape_trend"), n.alias("cycles"))


# -- validation -------------------------------------------------------------------------------------------------


def checkpoints(rows: DataFrame, segments: DataFrame, pending: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Pending validations for changed segments that have none yet: the baseline of the last
    ``days`` days, at least five samples."""
    t = F.lit(today).cast("date")
    base = metrics_segment(rows.where(F.col("date") >= F.date_sub(t, days)).withColumn("segment", segment()), ["entity", "segment"])
    new = segments.select("entity", "segment", F.col("factor").alias("after_factor"), F.col("bias").alias("after_bias"))
    return (
        new.join(base, ["entity", "segment"]).where(F.col("samples") >= VALIDATE_ROWS)
        .join(pending.select("entity", "segment"), ["entity", "segment"], "left_anti")
        .withColumns({"recorded_at": t, "validate_after": F.date_add(t, VALIDATE_DAYS), "status": F.lit("PENDING")})
    )


def decide(mae_before: Column, mae_after: Column, hit_before: Column, hit_after: Column) -> Column:
    """CONFIRM, ROLLBACK or HOLD from the relative MAE and the hit share."""
    d = (mae_after - mae_before) / F.greatest(mae_before, F.lit(1.0))
    h = hit_after - hit_before
    no = F.lit(False)
    good = F.coalesce(d <= -0.03, no) | F.coalesce(h >= 0.03, no)
    bad = F.coalesce(d >= 0.05, no) | F.coalesce(h <= -0.03, no)
    return F.when(good & ~bad, "CONFIRM").when(bad & ~good, "ROLLBACK").otherwise("HOLD")


def validate(pending: DataFrame, rows: DataFrame, today: str, days: int = VALIDATE_DAYS) -> DataFrame:
    """Due checkpoints (entity, segment, mae, hit_rate, validate_after) with their decision."""
    t = F.lit(today).cast("date")
    after = metrics_segment(rows.where(F.col("date") >= F.date_sub(t, days)).withColumn("segment", segment()), ["entity", "segment"])
    after = after.where(F.col("samples") >= VALIDATE_ROWS).select(
        "entity", "segment", F.col("samples").alias("samples_after"), F.col("mae").alias("mae_after"), F.col("hit_rate").alias("hit_after"))
    due = pending.where(F.col("validate_after") <= t)
    return due.join(after, ["entity", "segment"]).withColumn(
        "decision", decide(F.col("mae"), F.col("mae_after"), F.col("hit_rate"), F.col("hit_after")))


def settle(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Roll back or lock segment corrections. decisions: entity, segment, decision,
    before_factor, before_bias."""
    j = segments.join(decisions.select("entity", "segment", "decision", "before_factor", "before_bias"), ["entity", "segment"], "left")
    back, ok = F.col("decision") == "ROLLBACK", F.col("decision") == "CONFIRM"
    return j.withColumns(
        {
            "factor": F.when(back, F.col("before_factor")).otherwise(F.col("factor")),
            "bias": F.when(back, F.col("before_bias")).otherwise(F.col("bias")),
            "validated": F.coalesce(ok, F.lit(False)) | F.col("validated"),
            "confidence": F.when(ok, F.least(F.lit(1.0), F.col("confidence") + rules.SEGMENT_CONFIDENCE["confirmed"])).otherwise(F.col("confidence")),
        }
    ).drop("before_factor", "before_bias")


def audit(rows: DataFrame) -> DataFrame:
    """Latest 7 days, the 7 before, their difference, and the latest week per segment."""
    end = rows.agg(F.max("date")).scalar()
    v = valid_pairs(rows).withColumn("__end", end).withColumn("segment", segment())
    ago = F.datediff("__end", "date")
    name = F.when(ago <= 6, "latest_7_days").when(ago <= 13, "previous_7_days")
    arr = F.array_compact(F.array(
        F.struct(F.lit("WINDOW").alias("section"), name.alias("name")),
        F.when(ago <= 6, F.struct(F.lit("SEGMENT_LATEST_7").alias("section"), F.col("segment").alias("name"))),
    ))
    m = metrics_segment(v.where(ago <= 13).select("date", "pred", "actual", F.inline(arr)), ["section", "name"])
    m = m.where("section = 'WINDOW' or samples >= 5")
    w = m.where("section = 'WINDOW'")
    at = lambda c, n: F.max(F.when(F.col("name") == n, F.col(c)))
    diff = [(at(c, "latest_7_days") - at(c, "previous_7_days")).alias(c) for c in ("mae", "mape_daily", "bias", "hit_rate")]
    delta = w.agg(at("samples", "latest_7_days").alias("samples"), *diff).select(
        F.lit("DELTA").alias("section"), F.lit("latest_vs_previous").alias("name"), "samples", "mae", "mape_daily", "bias", "hit_rate")
    return m.unionByName(delta)


# -- item line -------------------------------------------------------------------------------------------------------


def item_step(rows: DataFrame, keys: list[str], old: DataFrame, low: float, high: float, min_rows: int = 3) -> DataFrame:
    """Bias, sum-ratio factor and MAPE of the item line (guests by entity, items by entity
    and item), smoothed with a fixed weight."""
    pos = (F.col("pred") > 0) & (F.col("actual") > 0)
    obs = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("error").alias("ob"), F.avg("pct_error").alias("om"), F.count_if(pos).alias("np"),
        (F.sum(F.when(pos, F.col("actual"))) / F.nullif(F.sum(F.when(pos, F.col("pred"))), F.lit(0.0))).alias("r"),
    ).where(F.col("n") >= min_rows)
    j = old.join(obs, keys, "full")
    a = F.lit(ITEM_ALPHA)
    cf = F.when(F.col("np") >= 3, clip(a * F.col("r") + (1 - a) * F.coalesce("correction_factor", F.lit(1.0)), low, high)).otherwise(F.col("correction_factor"))
    return j.select(
        *keys, _smooth(F.col("ob"), F.col("overall_bias"), a).alias("overall_bias"), cf.alias("correction_factor"),
        F.coalesce("om", "last_mape").alias("last_mape"),
    )


def item_weekday(rows: DataFrame, old: DataFrame) -> DataFrame:
    obs = rows.groupBy("entity", "weekday").agg(F.avg("error").alias("o"), F.count("*").alias("n")).where("n >= 3")
    j = old.join(obs, ["entity", "weekday"], "full")
    return j.select("entity", "weekday", _smooth(F.col("o"), F.col("value"), F.lit(ITEM_ALPHA)).alias("value"))


def item_apply(pred: DataFrame, state: DataFrame, keys: list[str], weekday_bias: DataFrame | None = None, significant: float = 2.0) -> DataFrame:
    """Factor, half of the weekday bias (guests only), within 30 % of the forecast."""
    j = pred.join(state.select(*keys, "correction_factor"), keys, "left")
    f = F.col("forecast")
    v = f * F.coalesce("correction_factor", F.lit(1.0))
    if weekday_bias is not None:
        j = j.withColumn("weekday", F.date_format("date", "EEEE")).join(
            weekday_bias.withColumnRenamed("value", "wb"), ["entity", "weekday"], "left")
        v = v - F.when(F.abs("wb") > significant, F.col("wb") * 0.5).otherwise(0.0)
    v = F.greatest(F.lit(0.0), F.bround(clip(v, f * 0.7, f * 1.3), 0))
    return j.withColumn("corrected", F.when(F.col("correction_factor").isNotNull() & (f > 0), v).otherwise(f)).drop("wb", "weekday")


