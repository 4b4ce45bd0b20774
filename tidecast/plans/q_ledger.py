"""Queries: ledger, monitoring, KPIs, evaluation, backtests."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast import rules
from tidecast.operators import asof
from tidecast.operators import evaluate as E
from tidecast.operators import facts, kpi, monitor
from tidecast.operators import ledger as L
from tidecast.operators import metrics as M
from tidecast.plans import inputs as I
from tidecast.plans.q_facts import item_facts
from tidecast.plans.q_profile import rounded
from tidecast.plans.registry import cte, query, with_
from tidecast.session import fresh_path, parts
from tidecast.sources import readers, sinks

NOW = "2001-06-01"
NOWD = f"DATE '{NOW}'"


def ledger(spark, sf):
    """Stand-in ledger: forecast = same weekday and shift before, run date = Monday."""
    s = I.shift_day(spark, sf)
    w = W.partitionBy("entity", "shift", F.weekday("date")).orderBy("date")
    cal = I.calendar(spark, sf).select("date", "is_holiday", "is_veg")
    s = s.withColumns({f"p{i}": F.lag("guests", i).over(w) for i in (1, 2, 3)})
    return s.join(F.broadcast(cal), "date").select(
        F.trunc("date", "week").alias("run_date"), "entity", "date", F.lit(None).cast("int").alias("hour"), "shift",
        F.col("p1").alias("pred"), F.col("guests").alias("actual"), F.col("p2").alias("ai_raw"),
        F.when(F.col("p2").isNotNull(), True).alias("ai_available"), F.col("p3").alias("pre_system"),
        "is_holiday", "is_veg", F.lit("shift").alias("mode"),
    )


cte(
    "ledger",
    """SELECT CAST(date_trunc('week', s.date) AS DATE) AS run_date, entity, s.date, CAST(NULL AS INTEGER) AS hour, shift,
  lag(guests, 1) OVER w AS pred, guests AS actual, lag(guests, 2) OVER w AS ai_raw, lag(guests, 3) OVER w AS pre_system,
  c.is_holiday, c.is_veg, 'shift' AS mode FROM shift_day s JOIN cal c ON c.date = s.date
  WINDOW w AS (PARTITION BY entity, shift, isodow(s.date) ORDER BY s.date)""",
    ["shift_day", "cal"],
)
cte("pairs", "SELECT *, pred - actual AS error, abs(pred - actual) AS ae FROM ledger WHERE pred >= 0 AND actual >= 0", ["ledger"])

_M = {
    "n": "count(*)",
    "mae": "avg(ae)",
    "wmape": "sum(ae) FILTER (actual > 0) / nullif(sum(actual) FILTER (actual > 0), 0) * 100",
    "mape": "avg(ae / nullif(actual, 0)) FILTER (actual > 0) * 100",
    "rmse": "sqrt(avg(error * error))",
    "bias": "avg(error)",
    "hit_rate": "avg(CASE WHEN ae <= 15 THEN 1.0 ELSE 0.0 END) * 100",
}
CORE = ["n", "mae", "wmape", "rmse", "bias", "hit_rate"]
FULL = ["n", "mae", "mape", "wmape", "rmse", "bias", "hit_rate"]


def msql(names=CORE, r=True):
    return ", ".join(f"{_M[k]} AS {k}" if k == "n" or not r else f"round({_M[k]}, 4) AS {k}" for k in names)


def rm(df, names=CORE):
    return rounded(df, *[c for c in names if c != "n"])


# -- ledger building ------------------------------------------------------------------------


def plan_rows(spark, sf):
    """Forecast rows without actuals: hourly, shift and daily, each = value a week before."""
    t = I.txn(spark, sf)
    hourly = t.groupBy("entity", "date", "hour").agg(F.sum("guests").alias("pred")).withColumn("shift", F.lit(None).cast("string"))
    shifts = I.shift_day(spark, sf).select("entity", "date", F.lit(None).cast("int").alias("hour"), F.col("guests").alias("pred"), "shift")
    daily = facts.daily(t).select("entity", "date", F.lit(None).cast("int").alias("hour"), F.col("guests").alias("pred"),
                                  F.lit(None).cast("string").alias("shift"))
    rows = hourly.unionByName(shifts).unionByName(daily)
    return rows.select("entity", F.date_add("date", 7).alias("date"), "hour", "shift", "pred", F.lit(None).cast("double").alias("actual"))


_JA = "entity, CAST(date AS VARCHAR) AS date, hour, shift, pred, actual, pred - actual AS diff, round((pred - actual) / nullif(actual, 0) * 100, 4) AS error_pct"


def _filled(spark, sf):
    return rounded(L.fill_actuals(plan_rows(spark, sf), I.txn(spark, sf), NOW), "error_pct")


def _ja(kind, keys, src, shift, hour):
    on = " AND ".join(f"a.{k} = p.{k}" for k in keys.split(", "))
    return f"""SELECT p.entity, p.date + 7 AS date, {hour} AS hour, {shift} AS shift, p.guests AS pred,
      CASE WHEN p.date + 7 <= {NOWD} THEN a.guests END AS actual FROM ({src}) p LEFT JOIN ({src}) a ON {on.replace('a.date = p.date', 'a.date = p.date + 7')}"""


_HSRC = "SELECT entity, date, hour, sum(guests) AS guests FROM txn GROUP BY ALL"


@query("jn_actuals_hour", with_(f"SELECT {_JA} FROM ({_ja('h', 'entity, date, hour', _HSRC, 'CAST(NULL AS VARCHAR)', 'p.hour')})", "txn"))
def jn_actuals_hour(spark, sf):
    rows = plan_rows(spark, sf).where("hour is not null")
    return rounded(L.fill_actuals(rows, I.txn(spark, sf), NOW, ("H",)), "error_pct")


@query("jn_actuals_shift", with_(f"SELECT {_JA} FROM ({_ja('s', 'entity, date, shift', 'SELECT * FROM shift_day', 'p.shift', 'CAST(NULL AS INTEGER)')})", "shift_day"))
def jn_actuals_shift(spark, sf):
    rows = plan_rows(spark, sf).where("shift is not null")
    return rounded(L.fill_actuals(rows, I.txn(spark, sf), NOW, ("S",)), "error_pct")


@query("jn_actuals_day", with_(f"SELECT {_JA} FROM ({_ja('d', 'entity, date', 'SELECT * FROM day', 'CAST(NULL AS VARCHAR)', 'CAST(NULL AS INTEGER)')})", "day"))
def jn_actuals_day(spark, sf):
    rows = plan_rows(spark, sf).where("hour is null and shift is null")
    return rounded(L.fill_actuals(rows, I.txn(spark, sf), NOW, ("D",)), "error_pct")


@query(
    "jn_guest_actuals",
    with_(
        f"""SELECT p.entity, CAST(p.date + 7 AS VARCHAR) AS date, p.shift, p.guests AS pred, a.guests AS actual, a.transactions AS actual_transactions,
        p.guests - a.guests AS diff, round((p.guests - a.guests) / nullif(a.guests, 0) * 100, 4) AS error_pct
        FROM guest_shift p LEFT JOIN guest_shift a ON a.entity = p.entity AND a.date = p.date + 7 AND a.shift = p.shift AND a.date <= {NOWD}""",
        "guest_shift",
    ),
)
def jn_guest_actuals(spark, sf):
    g = facts.guest_facts(I.txn(spark, sf), by_shift=True)
    led = g.select("entity", F.date_add("date", 7).alias("date"), "shift", F.col("guests").alias("pred"))
    return rounded(L.fill_guest_actuals(led, g, NOW), "error_pct")


def item_ledger(spark, sf):
    n, keys = parts(I.items(spark, sf)), ["entity", "date", "shift", "item"]
    s = item_facts(spark, sf, by_shift=True)
    led = s.select("entity", F.date_add("date", 7).alias("date"), "shift", "item", F.col("quantity").alias("pred"))
    return L.fill_item_actuals(led.repartition(n, *keys), s.repartition(n, *keys), NOW)


cte(
    "item_ledger",
    f"""SELECT p.entity, p.date + 7 AS date, p.shift, p.item, p.quantity AS pred, a.quantity AS actual FROM item_shift p
  LEFT JOIN item_shift a ON a.entity = p.entity AND a.date = p.date + 7 AND a.shift = p.shift AND a.item = p.item AND a.date <= {NOWD}""",
    ["item_shift"],
)


@query(
    "jn_item_actuals",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, shift, item, pred, actual, pred - actual AS diff,
        round((pred - actual) / nullif(actual, 0) * 100, 4) AS error_pct FROM item_ledger""",
        "item_ledger",
    ),
)
def jn_item_actuals(spark, sf):
    return rounded(item_ledger(spark, sf), "error_pct")


def two_runs(spark, sf):
    """Runs a week apart; some days of the earlier run are daily-only rows, odd days of the later run belong to an older one."""
    a = ledger(spark, sf).select("run_date", "entity", "date", "hour", "shift", "pred", "actual", "mode")
    daily = F.dayofmonth("date") % 3 == 0
    b = ledger(spark, sf).select(
        F.date_sub("run_date", 7).alias("run_date"), "entity", "date", "hour",
        F.when(~daily, F.col("shift")).alias("shift"), F.col("ai_raw").alias("pred"), "actual",
        F.when(daily, "daily_only").otherwise("shift").alias("mode"),
    )
    odd = F.dayofmonth("date") % 2 == 1
    older = F.when(odd, F.date_sub("run_date", 14)).otherwise(F.col("run_date"))
    return a.withColumn("run_date", older).unionByName(b)


cte(
    "two_runs",
    """SELECT CASE WHEN day(date) % 2 = 1 THEN run_date - 14 ELSE run_date END AS run_date, entity, date, hour, shift, pred, actual, mode FROM ledger
  UNION ALL SELECT run_date - 7, entity, date, hour, CASE WHEN day(date) % 3 <> 0 THEN shift END, ai_raw, actual,
    CASE WHEN day(date) % 3 = 0 THEN 'daily_only' ELSE 'shift' END FROM ledger""",
    ["ledger"],
)
_TR = "CAST(run_date AS VARCHAR) AS run_date, entity, CAST(date AS VARCHAR) AS date, hour, shift, pred, actual, mode"


@query(
    "ld_dual_mode",
    with_(
        f"""SELECT {_TR} FROM two_runs t JOIN (SELECT entity, date, first(mode ORDER BY n DESC, mode) AS keep FROM (
          SELECT r.entity, r.date, r.mode, count(*) AS n FROM two_runs r JOIN (SELECT entity, date, max(run_date) AS m FROM two_runs GROUP BY ALL) x
          ON x.entity = r.entity AND x.date = r.date AND x.m = r.run_date GROUP BY ALL) GROUP BY ALL) k USING (entity, date) WHERE mode = keep""",
        "two_runs",
    ),
)
def ld_dual_mode(spark, sf):
    return L.one_mode(two_runs(spark, sf))


@query(
    "ld_dedup",
    with_(
        f"""SELECT {_TR} FROM (SELECT *, row_number() OVER (PARTITION BY entity, date, coalesce(hour, -999), coalesce(shift, '__NONE__')
        ORDER BY run_date DESC NULLS LAST, pred DESC NULLS LAST, mode, actual DESC NULLS LAST) AS rn FROM two_runs) WHERE rn = 1""",
        "two_runs",
    ),
)
def ld_dedup(spark, sf):
    return L.dedup(two_runs(spark, sf))


def _old_new(spark, sf):
    led = two_runs(spark, sf)
    old = led.withColumn("run_date", F.when(F.dayofmonth("date") != 13, F.col("run_date")))
    new = ledger(spark, sf).where("date >= date'2001-05-25' and shift = 'MORNING'").select(
        F.lit(NOW).cast("date").alias("run_date"), "entity", "date", "hour", "shift", "pred",
        F.lit(None).cast("double").alias("actual"), F.lit("shift").alias("mode"),
    )
    return old, new


cte("old_led", "SELECT * REPLACE (CASE WHEN day(date) <> 13 THEN run_date END AS run_date) FROM two_runs", ["two_runs"])
cte(
    "new_led",
    f"""SELECT {NOWD} AS run_date, entity, date, hour, shift, pred, CAST(NULL AS DOUBLE) AS actual, 'shift' AS mode FROM ledger
  WHERE date >= DATE '2001-05-25' AND shift = 'MORNING'""",
    ["ledger"],
)
_MERGE = f"""SELECT * FROM old_led WHERE run_date < {NOWD} AND (entity, date) NOT IN (SELECT (entity, date) FROM new_led WHERE date >= {NOWD})
  UNION ALL SELECT * FROM old_led WHERE run_date IS NULL AND date < {NOWD} UNION ALL SELECT * FROM new_led WHERE date >= {NOWD}"""


@query("set_ledger_merge", with_(f"SELECT mode, run_date IS NULL AS orphan, count(*) AS n, sum(pred) AS pred FROM ({_MERGE}) GROUP BY ALL", "old_led", "new_led"))
def set_ledger_merge(spark, sf):
    m = L.merge(*_old_new(spark, sf), NOW)
    return m.groupBy("mode", F.col("run_date").isNull().alias("orphan")).agg(F.count("*").alias("n"), F.sum("pred").alias("pred"))


@query("ld_merge", with_(f"SELECT {_TR} FROM ({_MERGE})", "old_led", "new_led"))
def ld_merge(spark, sf):
    return L.merge(*_old_new(spark, sf), NOW)


@query(
    "jn_supersede",
    with_(f"SELECT {_TR} FROM old_led WHERE (entity, date) NOT IN (SELECT (entity, date) FROM new_led)", "old_led", "new_led"),
)
def jn_supersede(spark, sf):
    return L.drop_superseded(*_old_new(spark, sf))


@query(
    "ld_append_guest",
    with_(
        """SELECT CAST(run_date AS VARCHAR) AS run_date, entity, CAST(date AS VARCHAR) AS date, shift, pred FROM (
        SELECT run_date, entity, date, shift, pred FROM ledger l WHERE NOT (run_date = DATE '2001-05-28')
        UNION ALL SELECT DATE '2001-05-28', entity, date, shift, actual FROM ledger WHERE run_date = DATE '2001-05-28')""",
        "ledger",
    ),
)
def ld_append_guest(spark, sf):
    led = ledger(spark, sf).select("run_date", "entity", "date", "shift", "pred")
    new = ledger(spark, sf).where("run_date = date'2001-05-28'").select("entity", "date", "shift", F.col("actual").alias("pred"))
    return L.append_run(led, new, "2001-05-28", ["entity", "date", "shift"])


@query(
    "ld_append_item",
    with_(
        """SELECT run_date, entity, CAST(date AS VARCHAR) AS date, shift, item, pred FROM (
        SELECT '2001-01-01' AS run_date, entity, date, shift, item, pred FROM item_ledger WHERE year(date) = 2001
        UNION ALL SELECT '2001-05-01', entity, date, shift, item, pred + 1 FROM item_ledger WHERE year(date) = 2001 AND date >= DATE '2001-05-01')""",
        "item_ledger",
    ),
)
def ld_append_item(spark, sf):
    keys = ["entity", "date", "shift", "item"]
    led = item_ledger(spark, sf).select(F.lit("2001-01-01").cast("date").alias("run_date"), *keys, "pred")
    new = item_ledger(spark, sf).select(*keys, (F.col("pred") + 1).alias("pred"))
    return L.append_item_run(led, new, "2001-05-01", 2001, keys)


@query("ld_clean_shift", with_(f"SELECT {_TR} FROM two_runs WHERE shift IN ('MORNING', 'EVENING')", "two_runs"))
def ld_clean_shift(spark, sf):
    return L.only_shifts(two_runs(spark, sf))


@query(
    "ld_summary",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, p AS predicted_total, a AS actual_total, 0 AS hours,
        round(CASE WHEN p > 0 THEN abs(p - a) / a * 100 END, 4) AS error_pct,
        round(CASE WHEN p > 0 AND a IS NOT NULL THEN greatest(0, 100 - abs(p - a) / a * 100) END, 4) AS accuracy
        FROM (SELECT entity, date, sum(pred) AS p, CASE WHEN sum(actual) > 0 THEN sum(actual) END AS a FROM ledger GROUP BY entity, ledger.date)""",
        "ledger",
    ),
)
def ld_summary(spark, sf):
    return rounded(L.summary(ledger(spark, sf)), "error_pct", "accuracy")


@query("ld_upcoming", with_(f"SELECT entity, CAST(date AS VARCHAR) AS date, shift, pred FROM ledger WHERE date >= {NOWD}", "ledger"))
def ld_upcoming(spark, sf):
    return L.upcoming(ledger(spark, sf), NOW).select("entity", "date", "shift", "pred")


_DET = "SELECT entity, CAST(date AS VARCHAR) AS date, shift, pred, actual FROM ledger WHERE entity = 'R0' ORDER BY ledger.date DESC, shift LIMIT {}"


@query("ld_detail", with_(_DET.format(500), "ledger"))
def ld_detail(spark, sf):
    return L.detail(ledger(spark, sf), "R0", 500).select("entity", "date", "shift", "pred", "actual")


@query("top_recent", with_(_DET.format(200), "ledger"))
def top_recent(spark, sf):
    return L.detail(ledger(spark, sf), "R0", 200).select("entity", "date", "shift", "pred", "actual")


@query(
    "jn_booking_ledger",
    with_(
        """SELECT l.entity, CAST(l.date AS VARCHAR) AS date, shift, pred, booking_guests FROM ledger l LEFT JOIN booking_day b
        ON b.entity = l.entity AND b.date = l.date""",
        "ledger", "booking_day",
    ),
)
def jn_booking_ledger(spark, sf):
    led = ledger(spark, sf).select("entity", "date", "shift", "pred")
    return L.attach_booking(led, facts.booking_day(I.booking(spark, sf)))


@query("snk_ledger", with_("SELECT CAST(run_date AS VARCHAR) AS run_date, count(*) AS n, sum(pred) AS pred FROM ledger GROUP BY 1", "ledger"))
def snk_ledger(spark, sf):
    path = fresh_path(spark, "ledger")
    led = ledger(spark, sf).select("run_date", "entity", "date", "shift", "pred", "actual", "mode")
    sinks.write_ledger(led, path)
    sinks.write_ledger(led.where("run_date >= date'2001-05-01'"), path)
    return spark.read.parquet(path).groupBy("run_date").agg(F.count("*").alias("n"), F.sum("pred").alias("pred"))


@query(
    "src_ledger_load",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, shift, pred, actual, CAST(NULL AS DOUBLE) AS booking_guests,
        q.missing < q.rows * 0.5 AND q.rows > 10 AS usable FROM ledger, (SELECT count(*) AS rows, count(*) - count(pred) AS missing FROM ledger) q
        WHERE day(date) <> 31""",
        "ledger",
    ),
)
def src_ledger_load(spark, sf):
    led = ledger(spark, sf)
    raw = led.select(
        F.concat(F.lit("0"), F.lower("entity"), F.lit(".0")).alias("entity"),
        F.when(F.dayofmonth("date") == 31, "n/a").otherwise(F.col("date").cast("string")).alias("date"),
        "shift", F.col("pred").cast("string").alias("pred"), F.col("actual").cast("string").alias("actual"),
    )
    cols = {"shift": "string", "pred": "double", "actual": "double", "booking_guests": "double"}
    out, usable = L.load_checked(raw, cols, fresh_path(spark, "ledger-load"), strict=False)
    return out.withColumn("usable", F.lit(usable))


@query(
    "src_ledger_month",
    with_(
        """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(actual) AS guests, count(*) AS transactions,
        count(DISTINCT entity) AS entities, count(DISTINCT date) AS active_days, CAST(0 AS DOUBLE) AS revenue FROM ledger WHERE actual > 0 GROUP BY 1, 2""",
        "ledger",
    ),
)
def src_ledger_month(spark, sf):
    return readers.ledger_month(ledger(spark, sf))


@query(
    "agg_shift_report",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, dayname(date) AS weekday, shift, sum(pred) AS pred,
        arg_min(c.is_holiday, run_date) AS is_holiday, arg_min(c.is_veg, run_date) AS is_veg FROM two_runs JOIN cal c USING (date)
        WHERE shift IS NOT NULL GROUP BY entity, two_runs.date, shift""",
        "two_runs", "cal",
    ),
)
def agg_shift_report(spark, sf):
    cal = I.calendar(spark, sf).select("date", "is_holiday", "is_veg")
    return facts.shift_report(two_runs(spark, sf).join(F.broadcast(cal), "date"))


# -- errors and measures -----------------------------------------------------------------------


@query("flt_valid_pair", with_("SELECT entity, CAST(date AS VARCHAR) AS date, shift, pred, actual FROM pairs", "pairs"))
def flt_valid_pair(spark, sf):
    return M.valid_pairs(ledger(spark, sf)).select("entity", "date", "shift", "pred", "actual")


@query(
    "prj_errors",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, shift, error, ae AS abs_error, error * error AS squared_error,
        round(ae / nullif(actual, 0) * 100, 4) AS pct_error, round(error / nullif(actual, 0) * 100, 4) AS signed_pct FROM pairs""",
        "pairs",
    ),
)
def prj_errors(spark, sf):
    e = M.with_errors(M.valid_pairs(ledger(spark, sf)))
    return rounded(e.select("entity", "date", "shift", "error", "abs_error", "squared_error", "pct_error", "signed_pct"), "pct_error", "signed_pct")


@query("prj_hit_abs", with_("SELECT shift, CAST(sum(CASE WHEN ae <= 15 THEN 1 ELSE 0 END) AS BIGINT) AS hits, count(*) AS n FROM pairs GROUP BY shift", "pairs"))
def prj_hit_abs(spark, sf):
    return M.valid_pairs(ledger(spark, sf)).groupBy("shift").agg(F.sum(M.hit_abs()).alias("hits"), F.count("*").alias("n"))


_HS = "CASE WHEN actual > 0 THEN CASE WHEN (actual < 100 AND ae <= 10) OR (actual >= 100 AND ae / actual <= 0.1) THEN 1 ELSE 0 END END"
_DT = "CASE WHEN is_holiday THEN 'HOLIDAY' WHEN isodow(date) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END"
_SEG = f"shift || '|' || {_DT} || '|' || CASE WHEN actual >= 100 THEN 'LARGE' ELSE 'SMALL' END"


@query("prj_hit_strict", with_(f"SELECT shift, actual >= 100 AS big, CAST(sum({_HS}) AS BIGINT) AS hits, count(*) AS n FROM pairs GROUP BY 1, 2", "pairs"))
def prj_hit_strict(spark, sf):
    v = M.valid_pairs(ledger(spark, sf))
    return v.groupBy("shift", (F.col("actual") >= 100).alias("big")).agg(F.sum(M.hit_strict()).alias("hits"), F.count("*").alias("n"))


@query("prj_segment", with_(f"SELECT {_SEG} AS segment, count(*) AS n FROM pairs GROUP BY 1", "pairs"))
def prj_segment(spark, sf):
    return M.valid_pairs(ledger(spark, sf)).groupBy(M.segment().alias("segment")).agg(F.count("*").alias("n"))


@query("prj_ai_available", with_("SELECT ai_raw IS NOT NULL AS ai_available, count(*) AS n FROM ledger GROUP BY 1", "ledger"))
def prj_ai_available(spark, sf):
    return M.ai_available(ledger(spark, sf)).groupBy("ai_available").agg(F.count("*").alias("n"))


@query("agg_metrics", with_(f"SELECT entity, {msql()} FROM pairs GROUP BY entity", "pairs"))
def agg_metrics(spark, sf):
    return rm(M.metrics(ledger(spark, sf), ["entity"]))


@query("agg_metrics_full", with_(f"SELECT shift, {msql(FULL)} FROM pairs GROUP BY shift", "pairs"))
def agg_metrics_full(spark, sf):
    return rm(M.metrics_full(ledger(spark, sf), ["shift"]), FULL)


_HY = """round(avg(actual), 4) AS avg_actual, round(avg(ae / nullif(actual, 0)) FILTER (actual >= 30) * 100, 4) AS mape_high_vol,
  round(avg(ae) FILTER (actual < 30), 4) AS mae_low_vol, count(*) FILTER (actual < 30) AS n_low, count(*) FILTER (actual >= 30) AS n_high,
  round(avg(ae) / greatest(avg(actual), 1), 4) AS weighted_mae, CASE WHEN avg(actual) < 30 THEN 'MAE' ELSE 'WMAPE' END AS hybrid_type,
  round(CASE WHEN avg(actual) < 30 THEN avg(ae) ELSE sum(ae) / nullif(sum(actual), 0) * 100 END, 4) AS hybrid_metric"""
HYB = ["mae", "wmape", "rmse", "bias", "hit_rate", "avg_actual", "mape_high_vol", "mae_low_vol", "weighted_mae", "hybrid_metric"]


@query("agg_metrics_hybrid", with_(f"SELECT entity, {msql()}, {_HY} FROM pairs GROUP BY entity", "pairs"))
def agg_metrics_hybrid(spark, sf):
    return rounded(M.metrics_hybrid(ledger(spark, sf), ["entity"]), *HYB)


_IM = ["n", "mae", "mape", "rmse", "bias", "hit_rate"]


@query(
    "agg_metrics_item",
    with_(
        f"""SELECT CASE WHEN grouping(entity) = 0 THEN 'entity' WHEN grouping(shift) = 0 THEN 'shift' ELSE 'overall' END AS level, entity, shift, {msql(_IM)}
        FROM (SELECT *, pred - actual AS error, abs(pred - actual) AS ae FROM item_ledger WHERE actual IS NOT NULL) GROUP BY GROUPING SETS ((), (entity), (shift))""",
        "item_ledger",
    ),
)
def agg_metrics_item(spark, sf):
    return rm(M.metrics_sets(item_ledger(spark, sf), [[], ["entity"], ["shift"]]), _IM)


@query(
    "agg_smape",
    with_(
        """SELECT entity, count(*) AS n, round(avg(ae), 4) AS mae, round(sqrt(avg(ae * ae)), 4) AS rmse, round(avg(actual), 4) AS avg_daily,
        round(coalesce(1 - sum(ae * ae) / nullif(var_pop(actual) * count(*), 0), 0), 4) AS r2, CASE WHEN avg(actual) < 30 THEN 'SMAPE' ELSE 'MAPE' END AS metric_type,
        round(CASE WHEN avg(actual) < 30 THEN avg(2 * ae / greatest(pred + actual, 1)) * 100 ELSE avg(ae / greatest(actual, 1)) * 100 END, 4) AS mape,
        round(avg(ae) / greatest(avg(actual), 1), 4) AS weighted_mae FROM pairs GROUP BY entity""",
        "pairs",
    ),
)
def agg_smape(spark, sf):
    return rounded(M.metrics_smape(ledger(spark, sf), ["entity"]), "mae", "rmse", "avg_daily", "r2", "mape", "weighted_mae")


_SEGM = f"""SELECT segment, CAST(sum(s) AS BIGINT) AS samples, round(sum(ae) / sum(s), 4) AS mae, round(avg(abs(p - a) / a) * 100, 4) AS mape_daily,
  round(sum(e) / sum(s), 4) AS bias, round(sum(h) / sum(s), 4) AS hit_rate FROM (
  SELECT {_SEG} AS segment, date, sum(pred) AS p, sum(actual) AS a, count(*) AS s, sum(ae) AS ae, sum(error) AS e, sum({_HS}) AS h
  FROM pairs WHERE actual > 0 GROUP BY 1, 2) GROUP BY segment"""
SEG_R = ["mae", "mape_daily", "bias", "hit_rate"]


@query("agg_metrics_segment", with_(_SEGM, "pairs"))
def agg_metrics_segment(spark, sf):
    led = ledger(spark, sf).withColumn("segment", M.segment())
    return rounded(M.metrics_segment(led, ["segment"]), *SEG_R)


# -- monitoring -----------------------------------------------------------------------------------


@query("mo_overall", with_(f"SELECT {msql()} FROM pairs", "pairs"))
def mo_overall(spark, sf):
    return rm(M.metrics(ledger(spark, sf)))


@query("mo_daily", with_(f"SELECT CAST(date AS VARCHAR) AS date, {msql()} FROM pairs GROUP BY pairs.date", "pairs"))
def mo_daily(spark, sf):
    return rm(M.metrics(ledger(spark, sf), ["date"]))


@query("mo_weekday", with_(f"SELECT dayname(date) AS weekday, {msql()} FROM pairs GROUP BY 1", "pairs"))
def mo_weekday(spark, sf):
    return rm(M.metrics(monitor.with_weekday(ledger(spark, sf)), ["weekday"]))


cte("hour_pairs", f"SELECT hour, pred - actual AS error, abs(pred - actual) AS ae, actual FROM ({_ja('h', 'entity, date, hour', _HSRC, 'NULL', 'p.hour')}) WHERE actual >= 0", ["txn"])


@query("mo_hour", with_(f"SELECT hour, {msql()} FROM hour_pairs GROUP BY hour", "hour_pairs"))
def mo_hour(spark, sf):
    rows = plan_rows(spark, sf).where("hour is not null")
    return rm(M.metrics(L.fill_actuals(rows, I.txn(spark, sf), NOW, ("H",)), ["hour"]))


@query("mo_entity", with_(f"SELECT entity, {msql()} FROM pairs GROUP BY entity ORDER BY wmape", "pairs"))
def mo_entity(spark, sf):
    return rm(M.metrics(ledger(spark, sf), ["entity"])).orderBy("wmape")


cte("ent_day", "SELECT entity, date, sum(pred) AS pred, sum(actual) AS actual, sum(pred) - sum(actual) AS e, abs(sum(pred) - sum(actual)) AS ae FROM pairs GROUP BY ALL", ["pairs"])
_ED = """SELECT entity, count(*) AS n_days, round(avg(actual), 4) AS avg_daily_actual, round(avg(ae), 4) AS mae, round(sum(ae) / nullif(sum(actual), 0) * 100, 4) AS wmape,
  round(avg(e), 4) AS bias, round(avg(CASE WHEN ae <= 15 THEN 1.0 ELSE 0.0 END) * 100, 4) AS hit_rate, max(ae) AS worst_day_error, min(ae) AS best_day_error FROM ent_day GROUP BY entity"""
_EDR = ["avg_daily_actual", "mae", "wmape", "bias", "hit_rate"]


@query("mo_entity_day", with_(_ED, "ent_day"))
def mo_entity_day(spark, sf):
    return rounded(monitor.entity_day(ledger(spark, sf)), *_EDR)


@query(
    "top_best_worst_day",
    with_(f"WITH x AS ({_ED}) SELECT * FROM (SELECT *, 'best' AS rank_kind FROM x ORDER BY hit_rate DESC, entity LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'worst' FROM x ORDER BY hit_rate, entity LIMIT 10)".replace("WITH x AS", "SELECT * FROM (WITH x AS", 1) + ")", "ent_day"),
)
def top_best_worst_day(spark, sf):
    return monitor.best_worst_days(rounded(monitor.entity_day(ledger(spark, sf)), *_EDR))


@query("top_worst", with_(f"SELECT entity, {msql()} FROM pairs GROUP BY entity HAVING count(*) >= 30 ORDER BY {_M['wmape']} DESC NULLS LAST, entity LIMIT 10", "pairs"))
def top_worst(spark, sf):
    return rm(monitor.top_worst(ledger(spark, sf), 10))


cte(
    "runs",
    """SELECT run_date, count(DISTINCT entity) FILTER (ok) AS ev, count(DISTINCT entity) AS ea, count(DISTINCT date) FILTER (ok) AS dv, count(DISTINCT date) AS da,
  count(*) FILTER (ok) AS n, count(pred) AS predictions, avg(abs(pred - actual)) FILTER (ok) AS mae,
  sum(abs(pred - actual)) FILTER (ok AND actual > 0) / nullif(sum(actual) FILTER (ok AND actual > 0), 0) * 100 AS wmape,
  sqrt(avg((pred - actual) * (pred - actual)) FILTER (ok)) AS rmse, -avg(pred - actual) FILTER (ok) AS bias,
  avg(CASE WHEN abs(pred - actual) <= 15 THEN 1.0 ELSE 0.0 END) FILTER (ok) * 100 AS hit_rate
  FROM (SELECT *, coalesce(actual IS NOT NULL AND pred >= 0, false) AS ok FROM ledger) GROUP BY run_date""",
    ["ledger"],
)
cte(
    "run_delta",
    """SELECT *, mae - lag(mae) OVER w AS mae_delta, wmape - lag(wmape) OVER w AS wmape_delta, rmse - lag(rmse) OVER w AS rmse_delta,
  hit_rate - lag(hit_rate) OVER w AS hit_rate_delta FROM runs WINDOW w AS (ORDER BY run_date)""",
    ["runs"],
)
_SCORE = """(CASE WHEN mae_delta < -0.5 THEN 2 WHEN mae_delta < -0.1 THEN 1 WHEN mae_delta > 1.0 THEN -2 WHEN mae_delta > 0.3 THEN -1 ELSE 0 END
 + CASE WHEN wmape_delta < -3 THEN 2 WHEN wmape_delta < -1 THEN 1 WHEN wmape_delta > 5 THEN -2 WHEN wmape_delta > 2 THEN -1 ELSE 0 END
 + CASE WHEN hit_rate_delta > 3 THEN 2 WHEN hit_rate_delta > 1 THEN 1 WHEN hit_rate_delta < -5 THEN -2 WHEN hit_rate_delta < -2 THEN -1 ELSE 0 END)"""
_RUN = f"""SELECT CAST(run_date AS VARCHAR) AS run_date, CASE WHEN n > 0 THEN ev ELSE ea END AS entities, CASE WHEN n > 0 THEN dv ELSE da END AS days,
  CASE WHEN n > 0 THEN n ELSE predictions END AS samples, round(CASE WHEN n > 0 THEN n / greatest(predictions, 1) * 100 ELSE 0.0 END, 4) AS actual_pct,
  round(mae, 4) AS mae, round(wmape, 4) AS wmape, round(rmse, 4) AS rmse, round(bias, 4) AS bias, round(hit_rate, 4) AS hit_rate,
  round(mae_delta, 4) AS mae_delta, round(wmape_delta, 4) AS wmape_delta, round(rmse_delta, 4) AS rmse_delta, round(hit_rate_delta, 4) AS hit_rate_delta,
  CASE WHEN mae IS NULL THEN 'PENDING' WHEN mae_delta IS NULL OR wmape_delta IS NULL THEN 'FIRST' WHEN {_SCORE} >= 2 THEN 'BETTER' WHEN {_SCORE} <= -2 THEN 'WORSE'
   WHEN {_SCORE} = 0 THEN 'STABLE' WHEN {_SCORE} > 0 THEN 'SLIGHTLY_BETTER' ELSE 'SLIGHTLY_WORSE' END AS verdict FROM run_delta"""
_RUNR = ["actual_pct", "mae", "wmape", "rmse", "bias", "hit_rate", "mae_delta", "wmape_delta", "rmse_delta", "hit_rate_delta"]


@query("mo_run", with_(_RUN, "run_delta"))
def mo_run(spark, sf):
    return rounded(monitor.run_performance(ledger(spark, sf)), *_RUNR)


@query("win_run_delta", with_(f"SELECT run_date, mae_delta, wmape_delta, rmse_delta, hit_rate_delta, verdict FROM ({_RUN})", "run_delta"))
def win_run_delta(spark, sf):
    r = rounded(monitor.run_performance(ledger(spark, sf)), *_RUNR)
    return r.select("run_date", "mae_delta", "wmape_delta", "rmse_delta", "hit_rate_delta", "verdict")


_ROLL = " UNION ALL ".join(f"SELECT {w} AS window_days, {msql()} FROM pairs WHERE date >= DATE '2001-08-01' - {w}" for w in (7, 14, 30))


@query("mo_rolling", with_(_ROLL, "pairs"))
def mo_rolling(spark, sf):
    return rm(monitor.rolling(ledger(spark, sf), I.AS_OF))


_CMP = """SELECT round(em, 4) AS ensemble_mae, round(ew, 4) AS ensemble_wmape, round(am, 4) AS ai_mae, round(aw, 4) AS ai_wmape,
        CASE WHEN em <= am THEN 'ensemble' ELSE 'ai_raw' END AS winner, round(coalesce((am - em) / nullif(am, 0) * 100, 0), 4) AS improvement FROM (
        SELECT avg(abs(p - a)) AS em, sum(abs(p - a)) / sum(a) * 100 AS ew, avg(abs(ai - a)) AS am, sum(abs(ai - a)) / sum(a) * 100 AS aw FROM (
          SELECT date, sum(pred) AS p, sum(actual) AS a, arg_min(ai_raw, (entity, shift)) AS ai FROM ledger
          WHERE pred IS NOT NULL AND actual > 0 AND ai_raw IS NOT NULL GROUP BY date))"""


@query(
    "mo_compare",
    with_(
        _CMP,
        "ledger",
    ),
)
def mo_compare(spark, sf):
    return rounded(monitor.compare_ai(ledger(spark, sf)), "ensemble_mae", "ensemble_wmape", "ai_mae", "ai_wmape", "improvement")


_DR = ["mae", "wmape", "rmse", "hit_rate"]
_DRSEL = ", ".join(
    f"round({k}_this, 4) AS {k}_this, round({k}_last, 4) AS {k}_last, round(({k}_this - {k}_last) / nullif({k}_last, 0) * 100, 4) AS {k}_change_pct" for k in _DR
)
_WK = "SELECT {} FROM pairs WHERE date >= DATE '2001-08-01' - {} AND date < DATE '2001-08-01' - {}"
_SUF = lambda suf: ", ".join(f"{_M[k]} AS {k}_{suf}" for k in ["n", *_DR])


cte("weeks2", f"SELECT * FROM ({_WK.format(_SUF('this'), 7, -9999)}), ({_WK.format(_SUF('last'), 14, 7)})", ["pairs"])
cte(
    "drift_flags",
    """SELECT coalesce((wmape_this - wmape_last) / nullif(wmape_last, 0) * 100, 0) AS mape_change_pct, coalesce((wmape_this - wmape_last) / nullif(wmape_last, 0) * 100 > 15, false) AS mape_alert,
  coalesce(hit_rate_last > 0 AND hit_rate_this - hit_rate_last < -10, false) AS hit_alert FROM weeks2""",
    ["weeks2"],
)


@query(
    "mo_drift",
    with_(
        f"""SELECT n_this, n_last, {_DRSEL}, concat_ws('; ', CASE WHEN (wmape_this - wmape_last) / wmape_last * 100 > 15 THEN 'WARNING wmape' END,
          CASE WHEN (mae_this - mae_last) / mae_last * 100 > 30 THEN 'WARNING mae' END, CASE WHEN hit_rate_this - hit_rate_last < -10 THEN 'CRITICAL hit_rate' END) AS alerts,
        (wmape_this - wmape_last) / wmape_last * 100 > 15 OR (mae_this - mae_last) / mae_last * 100 > 30 OR hit_rate_this - hit_rate_last < -10 AS has_drift,
        round(mape_change_pct, 4) AS mape_change_pct, mape_alert, hit_alert FROM weeks2, drift_flags""",
        "weeks2", "drift_flags",
    ),
)
def mo_drift(spark, sf):
    d = monitor.drift(ledger(spark, sf), I.AS_OF)
    return rounded(d, "mape_change_pct", *[c for c in d.columns if c.startswith(tuple(_DR))])


_PROB = f"""SELECT * FROM (SELECT entity, {msql()}, 'worst' AS problem FROM pairs GROUP BY entity HAVING count(*) >= 30 ORDER BY {_M['wmape']} DESC NULLS LAST, entity LIMIT 20)
  UNION ALL SELECT entity, {msql()}, 'high_bias' FROM pairs GROUP BY entity HAVING count(*) >= 30 AND abs(avg(error)) > avg(ae) * 0.5
  UNION ALL SELECT entity, {msql()}, 'retune' FROM pairs GROUP BY entity HAVING count(*) >= 30 AND {_M['wmape']} > 40"""


@query("mo_problems", with_(_PROB, "pairs"))
def mo_problems(spark, sf):
    return rm(monitor.problems(ledger(spark, sf)))


_WEEK = lambda w: f"round(mae_{w}, 4), round(wmape_{w}, 4), round(rmse_{w}, 4), NULL, round(hit_rate_{w}, 4)"


@query(
    "mo_report",
    with_(
        f"""SELECT 'overall' AS section, 'all' AS key, {msql()} FROM pairs UNION ALL SELECT 'entity', entity, {msql()} FROM pairs GROUP BY entity
        UNION ALL SELECT 'weekday', dayname(date), {msql()} FROM pairs GROUP BY dayname(date)
        UNION ALL SELECT 'rolling', CAST(window_days AS VARCHAR), n, mae, wmape, rmse, bias, hit_rate FROM ({_ROLL})
        UNION ALL SELECT 'problem_' || problem, entity, n, mae, wmape, rmse, bias, hit_rate FROM ({_PROB})
        UNION ALL SELECT 'entity_day', entity, n_days, mae, wmape, NULL, bias, hit_rate FROM ({_ED})
        UNION ALL SELECT 'worst_day', entity, NULL, worst_day_error, NULL, NULL, NULL, NULL FROM ({_ED})
        UNION ALL SELECT 'best_day', entity, NULL, best_day_error, NULL, NULL, NULL, NULL FROM ({_ED})
        UNION ALL SELECT 'run', run_date, samples, mae, wmape, rmse, bias, hit_rate FROM ({_RUN})
        UNION ALL SELECT 'drift', 'this', n_this, {_WEEK('this')} FROM weeks2 UNION ALL SELECT 'drift', 'last', n_last, {_WEEK('last')} FROM weeks2
        UNION ALL SELECT 'model', 'ensemble', NULL, ensemble_mae, ensemble_wmape, NULL, NULL, NULL FROM ({_CMP})
        UNION ALL SELECT 'model', 'ai', NULL, ai_mae, ai_wmape, NULL, NULL, NULL FROM ({_CMP})""",
        "pairs", "ent_day", "run_delta", "weeks2", "ledger",
    ),
)
def mo_report(spark, sf):
    return rm(monitor.full_report(ledger(spark, sf), I.AS_OF))


# -- KPIs -------------------------------------------------------------------------------------------

cte(
    "kpi",
    """SELECT run_date, entity, date, shift, pred, actual, error AS diff, ae AS abs_diff, CASE WHEN actual > 0 THEN ae / actual * 100 WHEN pred = 0 THEN 0.0 ELSE 100.0 END AS error_pct,
  CASE WHEN ae <= 15 THEN 1 ELSE 0 END AS hit_15, dayname(date) AS weekday, CASE WHEN isodow(date) >= 5 THEN 'weekend' ELSE 'weekday' END AS day_type FROM pairs""",
    ["pairs"],
)


def _kpi(spark, sf):
    return kpi.prepare(ledger(spark, sf))


@query(
    "kp_prepare",
    with_(
        """SELECT CAST(run_date AS VARCHAR) AS run_date, entity, CAST(date AS VARCHAR) AS date, shift, pred, actual, diff, abs_diff,
        round(error_pct, 4) AS error_pct, hit_15, weekday, day_type FROM kpi""",
        "kpi",
    ),
)
def kp_prepare(spark, sf):
    return rounded(_kpi(spark, sf), "error_pct")


_K1 = ["hit_rate", "mae", "avg_pred", "avg_actual", "avg_error", "accuracy"]


@query(
    "kp_entity_shift",
    with_(
        """SELECT entity, shift, n, round(h, 4) AS hit_rate, round(mae, 4) AS mae, round(p, 4) AS avg_pred, round(a, 4) AS avg_actual, round(d, 4) AS avg_error,
        round(CASE WHEN a < 30 THEN greatest(0, 100 - mae / a * 100) ELSE greatest(0, 100 - se / sa * 100) END, 4) AS accuracy,
        CASE WHEN a < 30 THEN 'MAE' ELSE 'WMAPE' END AS metric_type, CASE WHEN a < 30 THEN 'LOW_VOLUME' WHEN a >= 80 THEN 'HIGH_VOLUME' ELSE 'MEDIUM_VOLUME' END AS volume_segment
        FROM (SELECT entity, shift, count(*) AS n, avg(hit_15) * 100 AS h, avg(abs_diff) AS mae, avg(pred) AS p, avg(actual) AS a, avg(diff) AS d, sum(abs_diff) AS se, sum(actual) AS sa
          FROM kpi GROUP BY 1, 2)""",
        "kpi",
    ),
)
def kp_entity_shift(spark, sf):
    return rounded(kpi.entity_shift(_kpi(spark, sf)), *_K1)


def _k2(key):
    return f"""SELECT shift, {key}, count(*) AS n, round(greatest(0, 100 - sum(abs_diff) / sum(actual) * 100), 4) AS accuracy, round(avg(hit_15) * 100, 4) AS hit_rate,
    round(avg(abs_diff), 4) AS mae, round(avg(pred), 4) AS avg_pred, round(avg(actual), 4) AS avg_actual, round(avg(diff), 4) AS avg_error, max(abs_diff) AS max_error,
    count(DISTINCT entity) AS entities FROM kpi GROUP BY 1, 2"""


@query("kp_shift_daytype", with_(_k2("day_type"), "kpi"))
def kp_shift_daytype(spark, sf):
    return rounded(kpi.shift_by(_kpi(spark, sf), "day_type"), *_K1)


@query("kp_shift_weekday", with_(_k2("weekday"), "kpi"))
def kp_shift_weekday(spark, sf):
    return rounded(kpi.shift_by(_kpi(spark, sf), "weekday"), *_K1)


_TOL = "count(*) AS n, CAST(sum(hit_15) AS BIGINT) AS n_hit, CAST(count(*) - sum(hit_15) AS BIGINT) AS n_miss, round(sum(hit_15) / count(*) * 100, 4) AS hit_pct, round(avg(abs_diff), 4) AS mae"
_TOLQ = f"""SELECT 'overall' AS section, CAST(NULL AS VARCHAR) AS shift, CAST(NULL AS VARCHAR) AS day_type, {_TOL} FROM kpi
  UNION ALL SELECT 'shift', shift, NULL, {_TOL} FROM kpi GROUP BY shift UNION ALL SELECT 'shift_day_type', shift, day_type, {_TOL} FROM kpi GROUP BY shift, day_type
  UNION ALL SELECT 'overall_without_low_volume', NULL, NULL, {_TOL} FROM kpi WHERE entity NOT IN (SELECT entity FROM kpi GROUP BY entity HAVING avg(actual) < 30)"""


@query("agg_grouping_kpi3", with_(_TOLQ, "kpi"))
def agg_grouping_kpi3(spark, sf):
    return rounded(kpi.tolerance(_kpi(spark, sf)), "hit_pct", "mae")


@query("kp_tolerance", with_(f"SELECT section, shift, day_type, hit_pct, round(100 - hit_pct, 4) AS miss_pct FROM ({_TOLQ})", "kpi"))
def kp_tolerance(spark, sf):
    t = rounded(kpi.tolerance(_kpi(spark, sf)), "hit_pct")
    return t.select("section", "shift", "day_type", "hit_pct", F.round(100 - F.col("hit_pct"), 4).alias("miss_pct"))


@query(
    "kp_wrong",
    with_(
        """SELECT CAST(run_date AS VARCHAR) AS run_date, entity, CAST(date AS VARCHAR) AS date, weekday, shift, pred, actual, diff, abs_diff,
        round(error_pct, 4) AS error_pct FROM kpi WHERE hit_15 = 0""",
        "kpi",
    ),
)
def kp_wrong(spark, sf):
    return rounded(kpi.wrong_rows(_kpi(spark, sf)), "error_pct")


@query(
    "srt_report",
    with_(
        """SELECT CAST(run_date AS VARCHAR) AS run_date, entity, CAST(date AS VARCHAR) AS date, shift, abs_diff FROM kpi WHERE hit_15 = 0
        ORDER BY kpi.run_date DESC, abs_diff DESC""",
        "kpi",
    ),
)
def srt_report(spark, sf):
    w = kpi.wrong_rows(_kpi(spark, sf)).select("run_date", "entity", "date", "shift", "abs_diff")
    return w.orderBy(F.desc("run_date"), F.desc("abs_diff"))


cte(
    "wrong_list",
    """SELECT run_date, string_agg(entity, ', ' ORDER BY entity) AS wrong_list FROM (SELECT run_date, entity, row_number() OVER (PARTITION BY run_date ORDER BY entity) AS rn
  FROM (SELECT DISTINCT run_date, entity FROM kpi WHERE hit_15 = 0)) WHERE rn <= 20 GROUP BY run_date""",
    ["kpi"],
)


@query(
    "kp_run_errors",
    with_(
        """SELECT CAST(run_date AS VARCHAR) AS run_date, n, n_right, entities, entities_wrong, coalesce(wrong_list, '') AS wrong_list, n - n_right AS n_wrong,
        round(n_right / n * 100, 4) AS right_pct, round(entities_wrong / entities * 100, 4) AS entities_wrong_pct FROM (
        SELECT run_date, count(*) AS n, CAST(sum(hit_15) AS BIGINT) AS n_right, count(DISTINCT entity) AS entities, count(DISTINCT entity) FILTER (hit_15 = 0) AS entities_wrong
        FROM kpi GROUP BY run_date) LEFT JOIN wrong_list USING (run_date)""",
        "kpi", "wrong_list",
    ),
)
def kp_run_errors(spark, sf):
    return rounded(kpi.run_errors(_kpi(spark, sf)), "right_pct", "entities_wrong_pct")


@query("agg_string_list", with_("SELECT CAST(run_date AS VARCHAR) AS run_date, wrong_list FROM wrong_list", "wrong_list"))
def agg_string_list(spark, sf):
    return kpi.wrong_list(_kpi(spark, sf))


@query(
    "agg_tolerance_bins",
    with_(
        """SELECT shift, total, unnest(['<=5', '5-10', '10-15', '>15']) AS level, unnest([a, b, c, d]) AS n, round(unnest([a, b, c, d]) / total * 100, 4) AS pct FROM (
        SELECT coalesce(shift, 'ALL') AS shift, count(*) AS total, count(*) FILTER (abs_diff <= 5) AS a, count(*) FILTER (abs_diff > 5 AND abs_diff <= 10) AS b,
        count(*) FILTER (abs_diff > 10 AND abs_diff <= 15) AS c, count(*) FILTER (abs_diff > 15) AS d FROM kpi GROUP BY GROUPING SETS ((), (shift)))""",
        "kpi",
    ),
)
def agg_tolerance_bins(spark, sf):
    return rounded(kpi.tolerance_bins(_kpi(spark, sf)), "pct")


@query(
    "kp_run_record",
    with_(
        f"""SELECT n, mae, wmape, rmse, bias, hit_rate, (a + b) / 2 AS score, CASE WHEN (a + b) / 2 >= 4.5 THEN 'EXCELLENT' WHEN (a + b) / 2 >= 3.5 THEN 'GOOD'
        WHEN (a + b) / 2 >= 2.5 THEN 'AVERAGE' WHEN (a + b) / 2 >= 1.5 THEN 'WEAK' ELSE 'POOR' END AS grade FROM (SELECT *,
        CASE WHEN wmape <= 15 THEN 5 WHEN wmape <= 25 THEN 4 WHEN wmape <= 35 THEN 3 WHEN wmape <= 50 THEN 2 ELSE 1 END AS a,
        CASE WHEN hit_rate >= 75 THEN 5 WHEN hit_rate >= 60 THEN 4 WHEN hit_rate >= 45 THEN 3 WHEN hit_rate >= 30 THEN 2 ELSE 1 END AS b FROM (SELECT {msql()} FROM pairs))""",
        "pairs",
    ),
)
def kp_run_record(spark, sf):
    return rm(kpi.run_record(M.metrics(ledger(spark, sf))))


# -- evaluation -------------------------------------------------------------------------------------

cte(
    "ev",
    """SELECT *, dayname(date) AS weekday, CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, CAST(year(date) AS INTEGER) AS year,
  CAST(weekofyear(date) AS INTEGER) AS week, strftime(date, '%Y-%m') AS year_month FROM pairs""",
    ["pairs"],
)


def _ev(spark, sf):
    return E.prepare(ledger(spark, sf))


@query(
    "ev_prepare",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, shift, error, CASE WHEN ae <= 15 THEN 1 ELSE 0 END AS hit, weekday, day_type, year, week, year_month FROM ev""",
        "ev",
    ),
)
def ev_prepare(spark, sf):
    return _ev(spark, sf).select("entity", "date", "shift", "error", "hit", "weekday", "day_type", "year", "week", "year_month")


def _evq(name, *keys):
    cols = ", ".join(keys)

    @query(name, with_(f"SELECT {cols}, {msql(FULL)} FROM ev GROUP BY {cols}", "ev"))
    def run(spark, sf):
        return rm(E.by(_ev(spark, sf), *keys), FULL)

    return run


_evq("ev_shift", "shift")
_evq("ev_shift_daytype", "shift", "day_type")
_evq("ev_weekday", "weekday")
_evq("ev_weekday_shift", "weekday", "shift")
_evq("ev_weekly", "year", "week")


@query(
    "agg_err_hist",
    with_(
        """SELECT bin, ['<=5', '6-10', '11-15', '16-20', '21-30', '31-50', '>50'][bin + 1] AS error_range, n, round(pct, 4) AS pct,
        round(sum(pct) OVER (ORDER BY bin), 4) AS cumulative_pct FROM (SELECT bin, n, n / sum(n) OVER () * 100 AS pct FROM (
        SELECT CASE WHEN ae <= 5 THEN 0 WHEN ae <= 10 THEN 1 WHEN ae <= 15 THEN 2 WHEN ae <= 20 THEN 3 WHEN ae <= 30 THEN 4 WHEN ae <= 50 THEN 5 ELSE 6 END AS bin,
        count(*) AS n FROM pairs GROUP BY 1))""",
        "pairs",
    ),
)
def agg_err_hist(spark, sf):
    return rounded(E.histogram(_ev(spark, sf)), "pct", "cumulative_pct")


cte(
    "abl_rows",
    f"""SELECT w AS window_days, segment, layer, actual, p AS pred, p - actual AS error, abs(p - actual) AS ae FROM (
  SELECT *, {_SEG} AS segment, unnest(['FINAL', 'PRE', 'AI']) AS layer, unnest([pred, pre_system, ai_raw]) AS p FROM ledger WHERE actual > 0)
  JOIN (SELECT unnest([7, 14, 30]) AS w) ON date > (SELECT max(date) FROM ledger) - w WHERE p IS NOT NULL""",
    ["ledger"],
)
cte(
    "abl",
    f"""SELECT window_days, layer, CASE WHEN grouping(segment) = 1 THEN 'ALL' ELSE segment END AS segment, count(*) AS samples, avg(ae) AS mae, avg(ae / actual) * 100 AS mape,
  avg(error) AS bias, avg({_HS}) * 100 AS hit_rate FROM abl_rows GROUP BY GROUPING SETS ((window_days, layer), (window_days, layer, segment))""",
    ["abl_rows"],
)
_AB = ["mae", "mape", "bias", "hit_rate"]
_ABQ = "SELECT window_days, layer, segment, samples, " + ", ".join(f"round({m}, 4) AS {m}" for m in _AB) + ", " + ", ".join(
    f"round(max({m}) FILTER (layer = 'FINAL') OVER w - max({m}) FILTER (layer = 'PRE') OVER w, 4) AS {m}_final_minus_pre" for m in _AB
) + " FROM abl WINDOW w AS (PARTITION BY window_days, segment)"
_ABR = _AB + [f"{m}_final_minus_pre" for m in _AB]


def _abl(spark, sf):
    return rounded(E.ablation(ledger(spark, sf), {"FINAL": "pred", "PRE": "pre_system", "AI": "ai_raw"}), *_ABR)


@query("ev_ablation", with_(_ABQ, "abl"))
def ev_ablation(spark, sf):
    return _abl(spark, sf)


@query("jn_delta_pivot", with_(f"SELECT window_days, segment, layer, mae, mae_final_minus_pre FROM ({_ABQ}) WHERE mae_final_minus_pre IS NOT NULL", "abl"))
def jn_delta_pivot(spark, sf):
    return _abl(spark, sf).where("mae_final_minus_pre is not null").select("window_days", "segment", "layer", "mae", "mae_final_minus_pre")


@query(
    "top_segment_regress",
    with_(
        f"""SELECT * FROM ({_ABQ}) WHERE window_days = 7 AND layer = 'FINAL' AND segment <> 'ALL'
        ORDER BY mae_final_minus_pre DESC NULLS LAST, mae DESC, segment LIMIT 10""",
        "abl",
    ),
)
def top_segment_regress(spark, sf):
    return E.top_regressions(_abl(spark, sf))


# -- backtest ---------------------------------------------------------------------------------------

BT = ("2000-01-01", "2001-06-30", 60, 360, 14)
cte(
    "bt_split",
    """SELECT s.entity, s.shift, s.guests, s.date, sim_date, CASE WHEN s.date < sim_date THEN 'train' ELSE 'test' END AS role FROM shift_day s
  JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2001-06-30', INTERVAL 60 DAY)) AS DATE) AS sim_date) x
   ON s.date >= sim_date - 360 AND s.date < sim_date + 14""",
    ["shift_day"],
)
cte(
    "bt_pairs",
    """SELECT t.sim_date, t.entity, t.date, t.shift, m.pred, t.guests AS actual, m.pred - t.guests AS error, abs(m.pred - t.guests) AS ae FROM bt_split t
  JOIN (SELECT sim_date, entity, shift, isodow(date) AS wd, median(guests) AS pred FROM bt_split WHERE role = 'train' GROUP BY ALL) m
   ON m.sim_date = t.sim_date AND m.entity = t.entity AND m.shift = t.shift AND m.wd = isodow(t.date)
  JOIN (SELECT sim_date, entity FROM bt_split WHERE role = 'train' GROUP BY ALL HAVING count(DISTINCT date) >= 7) k ON k.sim_date = t.sim_date AND k.entity = t.entity
  WHERE t.role = 'test'""",
    ["bt_split"],
)


def bt_pairs(spark, sf):
    return E.backtest_median(E.backtest_split(I.shift_day(spark, sf), *BT))


@query(
    "jn_backtest_split",
    with_("SELECT CAST(sim_date AS VARCHAR) AS sim_date, role, entity, count(*) AS n, sum(guests) AS guests FROM bt_split GROUP BY bt_split.sim_date, role, entity", "bt_split"),
)
def jn_backtest_split(spark, sf):
    s = E.backtest_split(I.shift_day(spark, sf), *BT)
    return s.groupBy("sim_date", "role", "entity").agg(F.count("*").alias("n"), F.sum("guests").alias("guests"))


@query(
    "bt_run_median",
    with_("SELECT CAST(sim_date AS VARCHAR) AS sim_date, entity, CAST(date AS VARCHAR) AS date, shift, pred, actual FROM bt_pairs", "bt_pairs"),
)
def bt_run_median(spark, sf):
    return bt_pairs(spark, sf)


cte("bt_day", "SELECT entity, date, sum(guests) AS guests, sum(CASE WHEN shift = 'MORNING' THEN guests ELSE 0 END) AS morning FROM shift_day GROUP BY ALL", ["shift_day"])
cte(
    "bt_win",
    """SELECT d.*, sim_date, CASE WHEN date - lag(date) OVER w >= 7 THEN date - lag(date) OVER w END AS gap FROM bt_day d
  JOIN (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2001-06-30', INTERVAL 60 DAY)) AS DATE) AS sim_date) x
   ON d.date >= sim_date - 360 AND d.date < sim_date WINDOW w AS (PARTITION BY entity, sim_date ORDER BY date)""",
    ["bt_day"],
)
cte(
    "bt_prof",
    """SELECT *, CASE WHEN a > 0 THEN (b - a) / nullif(a, 0) * 100 WHEN b = 0 THEN 0.0 ELSE 100.0 END AS growth_30d,
   CASE WHEN span <= 0 THEN 'SINGLE_DAY_DATA' WHEN gap_days / nullif(span::DOUBLE, 0) > 0.5 THEN 'HIGH_GAP_RATIO' WHEN active_days < 7 THEN 'LOW_ACTIVE_DAYS'
    WHEN gap_end >= sim_date - 4 THEN 'CURRENTLY_IN_GAP' ELSE 'OK' END AS exclude_reason,
   CASE WHEN active_days < 7 THEN 'NEW' WHEN active_days < 45 THEN 'YOUNG' WHEN coalesce(sd / nullif(avg_daily, 0), 999) > 0.5 THEN 'VOLATILE'
    WHEN avg_daily > 200 THEN 'HIGH_VOLUME' ELSE 'STANDARD' END AS category,
   CASE WHEN avg_daily < 20 THEN 'LOW_VOLUME' WHEN avg_daily < 80 THEN 'MEDIUM_VOLUME' ELSE 'HIGH_VOLUME' END AS volume_segment FROM (
  SELECT entity, sim_date, count(*) AS active_days, avg(guests) AS avg_daily, coalesce(stddev_samp(guests), 0) AS sd, max(date) AS last_date, max(date) - min(date) AS span,
   count(gap) AS gaps, coalesce(sum(gap), 0)::BIGINT AS gap_days, max(CASE WHEN gap IS NOT NULL THEN date END) AS gap_end,
   coalesce(avg(guests) FILTER (date >= sim_date - 31 AND date < sim_date - 16), 0) AS a, coalesce(avg(guests) FILTER (date >= sim_date - 16), 0) AS b
  FROM bt_win GROUP BY entity, sim_date)""",
    ["bt_win"],
)
cte("bt_wd", "SELECT entity, sim_date, isodow(date) AS wd, avg(guests) AS avg, sum(morning) / nullif(sum(guests), 0) AS share FROM bt_win GROUP BY ALL", ["bt_win"])


@query(
    "bt_profiles",
    with_(
        """SELECT entity, CAST(sim_date AS VARCHAR) AS sim_date, active_days, round(avg_daily, 4) AS avg_daily, round(sd, 4) AS std_daily, round(growth_30d, 4) AS growth_30d,
        gaps AS total_gaps, gap_days AS total_gap_days, exclude_reason, category, volume_segment, CAST(last_date AS VARCHAR) AS last_date FROM bt_prof""",
        "bt_prof",
    ),
)
def bt_profiles(spark, sf):
    p = asof.profiles(asof.day_totals(I.shift_day(spark, sf)), *BT[:4])
    cols = ["avg_daily", "std_daily", "growth_30d"]
    return rounded(p.select("entity", "sim_date", "active_days", *cols, "total_gaps", "total_gap_days", "exclude_reason", "category", "volume_segment", "last_date"), *cols)


_CURVE = "CASE volume_segment " + " ".join(
    f"WHEN '{s}' THEN CASE days_to_holiday " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in c.items()) + " END" for s, c in rules.HOLIDAY_CURVES.items()
) + " END"
cte(
    "bt_real",
    f"""SELECT *, CASE WHEN NOT is_holiday AND NOT is_special_event AND d1 > 0 AND base > 0 AND (d1 > hi OR d1 < lo) AND NOT (avg_daily >= 100 AND d1 > base)
    THEN greatest(0, round_even(f1 * (least(greatest(d1, lo), hi) / d1), 0)) ELSE f1 END AS pred FROM (
   SELECT *, sum(f1) OVER (PARTITION BY entity, sim_date, date) AS d1, CASE WHEN avg_daily >= 100 THEN base * 0.80 ELSE base * 0.85 END AS lo,
    CASE WHEN avg_daily >= 100 THEN base * 1.35 ELSE base * 1.20 END AS hi FROM (
   SELECT *, greatest(0, round_even(c4 * coalesce(CASE WHEN shift = 'MORNING' THEN share ELSE 1 - share END, CASE WHEN shift = 'MORNING' THEN 0.45 ELSE 0.55 END), 0)) AS f1 FROM (
   SELECT *, CASE WHEN busy OR NOT is_holiday THEN c2 * CASE WHEN busy AND holiday_impact <> 1 THEN greatest(1, holiday_impact)
     WHEN is_holiday_window AND {_CURVE} IS NOT NULL THEN {_CURVE} WHEN holiday_impact <> 1 AND NOT is_holiday THEN holiday_impact ELSE 1.0 END ELSE c2 END AS c4 FROM (
   SELECT p.entity, p.sim_date, p.avg_daily, p.volume_segment, c.*, s.shift, w.share, coalesce(w.avg, p.avg_daily) AS base,
    coalesce(w.avg, p.avg_daily) * least(greatest(1 + least(greatest(growth_30d, -100), 100) / 2000 * ((c.date - p.sim_date + 1) / 7), 0.85), 1.15) AS c2,
    coalesce(is_holiday AND holiday_type IN ('LIBERATION_DAY', 'LABOR_DAY', 'NATIONAL_DAY', 'HUNG_KINGS', 'TET_DUONG_LICH') AND NOT closed_likely, false) AS busy
   FROM bt_prof p JOIN cal c ON c.date >= p.sim_date AND c.date < p.sim_date + 14 LEFT JOIN bt_wd w ON w.entity = p.entity AND w.sim_date = p.sim_date AND w.wd = isodow(c.date)
    CROSS JOIN (SELECT unnest(['MORNING', 'EVENING']) AS shift) s
   WHERE exclude_reason = 'OK' AND active_days >= 7 AND last_date >= p.sim_date - 30))))""",
    ["bt_prof", "bt_wd", "cal"],
)


@query(
    "bt_run",
    with_(
        """SELECT CAST(r.sim_date AS VARCHAR) AS sim_date, r.entity, CAST(r.date AS VARCHAR) AS date, r.shift, r.pred, s.guests AS actual
        FROM bt_real r JOIN shift_day s ON s.entity = r.entity AND s.date = r.date AND s.shift = r.shift""",
        "bt_real", "shift_day",
    ),
)
def bt_run(spark, sf):
    return asof.walk_forward(I.shift_day(spark, sf), I.calendar(spark, sf), *BT)


@query(
    "win_horizon_day",
    with_("SELECT CAST(date - sim_date + 1 AS INTEGER) AS horizon_day, count(*) AS n, sum(pred) AS pred FROM bt_pairs GROUP BY 1", "bt_pairs"),
)
def win_horizon_day(spark, sf):
    return E.horizon_day(bt_pairs(spark, sf)).groupBy("horizon_day").agg(F.count("*").alias("n"), F.sum("pred").alias("pred"))


cte(
    "bt_vol",
    """SELECT *, CASE WHEN avg(actual) OVER (PARTITION BY entity) < 30 THEN 'LOW_VOLUME' WHEN avg(actual) OVER (PARTITION BY entity) < 80 THEN 'MEDIUM_VOLUME'
  ELSE 'HIGH_VOLUME' END AS vol FROM bt_pairs""",
    ["bt_pairs"],
)


def _bts(name, key, where="true", need=1):
    return f"SELECT '{name}' AS section, {key} AS key, {msql()}, {_HY} FROM bt_vol WHERE {where} GROUP BY 2 HAVING count(*) >= {need}"


@query(
    "bt_report",
    with_(
        " UNION ALL ".join([
            f"SELECT 'overall' AS section, 'all' AS key, {msql()}, {_HY} FROM bt_vol", _bts("entity", "entity"), _bts("weekday", "dayname(date)"),
            _bts("horizon", "CAST(date - sim_date + 1 AS VARCHAR)"), _bts("simulation", "CAST(sim_date AS VARCHAR)"), _bts("shift", "shift"),
            _bts("shift_weekend", "shift || '_WEEKEND'", "isodow(date) >= 6", 3), _bts("shift_weekday", "shift || '|' || dayname(date)", need=2),
            _bts("volume", "vol"), _bts("volume_shift", "vol || '_' || shift", need=2),
        ]),
        "bt_vol",
    ),
)
def bt_report(spark, sf):
    return rounded(E.backtest_report(bt_pairs(spark, sf)), *HYB)


@query(
    "bt_holdout",
    with_(
        """SELECT entity, count(*) AS n, round(avg(ae), 4) AS mae, round(sqrt(avg(ae * ae)), 4) AS rmse, round(avg(actual), 4) AS avg_daily,
        round(coalesce(1 - sum(ae * ae) / nullif(var_pop(actual) * count(*), 0), 0), 4) AS r2, CASE WHEN avg(actual) < 30 THEN 'SMAPE' ELSE 'MAPE' END AS metric_type,
        round(CASE WHEN avg(actual) < 30 THEN avg(2 * ae / greatest(pred + actual, 1)) * 100 ELSE avg(ae / greatest(actual, 1)) * 100 END, 4) AS mape,
        round(avg(ae) / greatest(avg(actual), 1), 4) AS weighted_mae FROM (
        SELECT entity, guests AS actual, pred, abs(pred - guests) AS ae FROM (SELECT *, coalesce(avg(guests) FILTER (rn > 30) OVER (PARTITION BY entity, isodow(date)),
          avg(guests) FILTER (rn > 30) OVER (PARTITION BY entity)) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn,
          count(*) OVER (PARTITION BY entity) AS n FROM day)) WHERE n >= 60 AND rn <= 30) GROUP BY entity""",
        "day",
    ),
)
def bt_holdout(spark, sf):
    return rounded(E.holdout(I.daily(spark, sf)), "mae", "rmse", "avg_daily", "r2", "mape", "weighted_mae")




_FACT = "CASE holiday_type WHEN 'LIBERATION_DAY' THEN 1.7::DOUBLE WHEN 'LABOR_DAY' THEN 1.7::DOUBLE WHEN 'NATIONAL_DAY' THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END"
cte("asof_tot", "SELECT entity, date, sum(pred) AS total FROM ledger GROUP BY ALL HAVING sum(pred) > 0", ["ledger"])


@query(
    "jn_asof_baseline",
    with_(
        f"""SELECT l.entity, CAST(l.date AS VARCHAR) AS date, l.shift, CASE WHEN k.k IS NOT NULL THEN round_even(l.pred * k.k, 0) ELSE l.pred END AS pred FROM ledger l LEFT JOIN (
        SELECT h.entity, h.date, coalesce(coalesce(a.total, b.total, c.total) * f, h.total * f / 0.883::DOUBLE) / h.total AS k FROM (SELECT t.*, {_FACT} AS f FROM asof_tot t JOIN cal c ON c.date = t.date AND c.holiday_type IS NOT NULL) h
          LEFT JOIN asof_tot a ON a.entity = h.entity AND a.date = h.date - 7 LEFT JOIN asof_tot b ON b.entity = h.entity AND b.date = h.date + 7 LEFT JOIN asof_tot c ON c.entity = h.entity AND c.date = h.date - 14) k
        ON k.entity = l.entity AND k.date = l.date""",
        "ledger", "asof_tot", "cal",
    ),
)
def jn_asof_baseline(spark, sf):
    t = F.col("holiday_type")
    f = F.when(t.isin("LIBERATION_DAY", "LABOR_DAY"), 1.7).when(t == "NATIONAL_DAY", 1.5).otherwise(0.5)
    factors = I.calendar(spark, sf).where(t.isNotNull()).select("date", f.alias("factor"))
    return L.asof_baseline(ledger(spark, sf).select("entity", "date", "shift", "pred"), factors, 0.883)
