"""Queries: features, statistical forecasts, adjustment chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast import rules
from tidecast.operators import facts, horizon, profile
from tidecast.operators import features as X
from tidecast.operators import forecast as P
from tidecast.operators import metrics as M
from tidecast.plans import inputs as I
from tidecast.plans.q_facts import item_facts
from tidecast.plans.q_ledger import ledger
from tidecast.plans.q_profile import H_START, closed_dates, hz, rounded, shift_flags
from tidecast.plans.q_sources import month_derived
from tidecast.plans.registry import cte, query, with_
from tidecast.session import dealt, parts

D = "CAST(date AS VARCHAR) AS date"


def rsel(cols, n=4):
    return ", ".join(f"round({c}, {n}) AS {c}" for c in cols)


# -- features -----------------------------------------------------------------------------

_CYC = """CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month, CAST(month(date) AS INTEGER) AS month,
  CAST(weekofyear(date) AS INTEGER) AS week_of_year, CAST(quarter(date) AS INTEGER) AS quarter, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  round(sin(2 * pi() * (isodow(date) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(date) - 1) / 7), 6) AS dow_cos,
  round(sin(2 * pi() * month(date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(date) / 12), 6) AS month_cos,
  CASE WHEN day(date) <= 5 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN day(date) >= 25 THEN 1 ELSE 0 END AS is_month_end,
  CAST(date - min(date) OVER (PARTITION BY entity) AS INTEGER) AS days_since_start"""
_CYCC = ["day_of_week", "day_of_month", "month", "week_of_year", "quarter", "is_weekend", "dow_sin", "dow_cos", "month_sin",
         "month_cos", "is_month_start", "is_month_end", "days_since_start"]


@query("prj_cyclic", with_(f"SELECT entity, CAST(date AS VARCHAR) AS date_text, {_CYC} FROM day", "day"))
def prj_cyclic(spark, sf):
    c = X.cyclic(I.daily(spark, sf)).select("entity", F.col("date").cast("string").alias("date_text"), *_CYCC)
    return rounded(c, "dow_sin", "dow_cos", "month_sin", "month_cos", n=6)


_LJ = " ".join(f"LEFT JOIN shift_day l{n} ON l{n}.entity = s.entity AND l{n}.shift = s.shift AND l{n}.date = s.date - {n}" for n in (7, 14, 28, 364, 365))
cte(
    "lags",
    f"""SELECT s.entity, s.date, s.shift, s.guests, l365.guests AS raw_365d, med, """
    + ", ".join(f"coalesce(l{n}.guests, med) AS lag_{n}d" for n in (7, 14, 28, 364, 365))
    + f" FROM shift_day s JOIN (SELECT entity, median(guests) AS med FROM shift_day GROUP BY entity) m ON m.entity = s.entity {_LJ}",
    ["shift_day"],
)


@query("jn_lag_lookup", with_(f"SELECT entity, {D}, shift, guests, lag_7d, lag_14d, lag_28d, lag_364d, lag_365d FROM lags", "lags"))
def jn_lag_lookup(spark, sf):
    lag = X.lag_lookup(I.shift_day(spark, sf))
    return lag.select("entity", "date", "shift", "guests", "lag_7d", "lag_14d", "lag_28d", "lag_364d", "lag_365d")


@query(
    "win_weighted_lag",
    with_(f"SELECT entity, {D}, shift, round(0.6 * lag_7d + 0.3 * lag_14d + 0.1 * lag_28d, 4) AS weighted_lag, guests - lag_7d AS delta_7d FROM lags", "lags"),
)
def win_weighted_lag(spark, sf):
    w = X.weighted_lag(X.lag_lookup(I.shift_day(spark, sf)))
    return rounded(w.select("entity", "date", "shift", "weighted_lag", "delta_7d"), "weighted_lag")


_W = "(PARTITION BY entity ORDER BY day.date)"
_LAGS = ", ".join(f"lag(guests, {n}) OVER w AS guests_lag{n}" for n in (1, 2, 3, 7, 14, 21, 28))


@query("win_lag_rows", with_(f"SELECT entity, {D}, {_LAGS} FROM day WINDOW w AS {_W}", "day"))
def win_lag_rows(spark, sf):
    return X.lag_rows(I.daily(spark, sf), ["entity"], "guests").drop("guests")


def _roll(ns):
    return ", ".join(
        f"avg(guests) OVER (PARTITION BY entity ORDER BY day.date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS guests_mean_{n}, "
        f"stddev_samp(guests) OVER (PARTITION BY entity ORDER BY day.date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS guests_std_{n}" for n in ns
    )


_RN = (3, 7, 14, 28, 56)
cte("roll", f"SELECT entity, date, guests, {_roll(_RN)} FROM day", ["day"])
_RC = [f"guests_{k}_{n}" for n in _RN for k in ("mean", "std")]


@query("win_roll", with_(f"SELECT entity, {D}, {rsel(_RC, 3)} FROM roll", "roll"))
def win_roll(spark, sf):
    return rounded(X.rolling(I.daily(spark, sf), ["entity"], "guests").drop("guests"), *_RC, n=3)


@query(
    "win_yoy_rows",
    with_(
        f"""SELECT entity, {D}, y AS guests_yoy, round((guests - y) / nullif(y, 0), 4) AS guests_yoy_growth FROM (
        SELECT *, lag(guests, 364) OVER w AS y FROM day WINDOW w AS {_W})""",
        "day",
    ),
)
def win_yoy_rows(spark, sf):
    return rounded(X.yoy_rows(I.daily(spark, sf), ["entity"], "guests").drop("guests"), "guests_yoy_growth")


cte(
    "trends",
    """SELECT entity, date, guests, guests_mean_7 AS rolling_7d_mean, coalesce(guests_mean_7 / nullif(guests_mean_14, 0), 1) AS trend_7d,
  coalesce(guests_mean_3 / nullif(guests_mean_7, 0), 1) AS momentum,
  CASE WHEN guests_mean_3 > guests_mean_7 * 1.2 THEN 1 WHEN guests_mean_3 < guests_mean_7 * 0.8 THEN -1 ELSE 0 END AS trend_signal FROM roll""",
    ["roll"],
)


@query("win_trend", with_(f"SELECT entity, {D}, {rsel(['rolling_7d_mean', 'trend_7d', 'momentum'], 6)} FROM trends", "trends"))
def win_trend(spark, sf):
    t = X.day_trends(I.daily(spark, sf)).select("entity", "date", "rolling_7d_mean", "trend_7d", "momentum")
    return rounded(t, "rolling_7d_mean", "trend_7d", "momentum", n=6)


@query("win_trend_signal", with_("SELECT trend_signal, count(*) AS n FROM trends GROUP BY trend_signal", "trends"))
def win_trend_signal(spark, sf):
    return X.day_trends(I.daily(spark, sf)).groupBy("trend_signal").agg(F.count("*").alias("n"))


cte("sday", "SELECT entity, date, sum(guests) AS guests FROM shift_day GROUP BY ALL", ["shift_day"])
cte(
    "yoy",
    """SELECT entity, least(greatest(coalesce(CASE WHEN n > 60 AND pts >= 20 THEN CASE WHEN f28 > 0 THEN l28 / greatest(f28, 1) END
   WHEN n >= 60 THEN CASE WHEN p30 > 0 THEN l30 / greatest(p30, 1) END END, 1.0), 0.5), 2.0) AS yoy_growth_rate FROM (
  SELECT entity, count(*) AS n, avg(guests) FILTER (b <= 28) AS l28, avg(guests) FILTER (f <= 28) AS f28, avg(guests) FILTER (b <= 30) AS l30,
    avg(guests) FILTER (b > 30 AND b <= 60) AS p30 FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS b,
    row_number() OVER (PARTITION BY entity ORDER BY date) AS f FROM sday) GROUP BY entity)
  JOIN (SELECT entity, count(raw_365d) AS pts FROM lags GROUP BY entity) USING (entity)""",
    ["sday", "lags"],
)


@query("win_yoy_rate", with_("SELECT entity, round(yoy_growth_rate, 4) AS yoy_growth_rate FROM yoy", "yoy"))
def win_yoy_rate(spark, sf):
    s = I.shift_day(spark, sf)
    day = s.groupBy("entity", "date").agg(F.sum("guests").alias("guests"))
    pts = X.lag_lookup(s, (365,)).groupBy("entity").agg(F.count("raw_365d").alias("points"))
    return rounded(X.yoy_rate(day, pts), "yoy_growth_rate")


cte(
    "inter",
    """SELECT entity, date + CAST(k AS INTEGER) AS date, CASE WHEN k = 0 THEN guests ELSE guests + (nv - guests) * least(k, 3) / gap END AS guests, k > 0 AS filled FROM (
  SELECT *, unnest(range(0, coalesce(gap, 1))) AS k FROM (SELECT *, lead(guests) OVER w AS nv, lead(date) OVER w - date AS gap FROM day
  WINDOW w AS (PARTITION BY entity ORDER BY day.date)))""",
    ["day"],
)


@query("win_interpolate", with_(f"SELECT entity, {D}, round(guests, 4) AS guests, filled FROM inter", "inter"))
def win_interpolate(spark, sf):
    return rounded(X.interpolate(I.daily(spark, sf)), "guests")


@query(
    "win_residual_lag",
    with_(
        f"""SELECT entity, {D}, shift, actual - pred AS residual, lag(actual - pred, 1) OVER w AS lag_rows_1, lag(actual - pred, 2) OVER w AS lag_rows_2,
        lag(actual - pred, 4) OVER w AS lag_rows_4, round(CASE WHEN count(*) OVER x >= 2 THEN avg(actual - pred) OVER x END, 4) AS mean_rows_4
        FROM pairs WINDOW w AS (PARTITION BY entity, shift ORDER BY pairs.date), x AS (PARTITION BY entity, shift ORDER BY pairs.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
        "pairs",
    ),
)
def win_residual_lag(spark, sf):
    r = X.residual_lags(M.valid_pairs(ledger(spark, sf)))
    return rounded(r.select("entity", "date", "shift", "residual", "lag_rows_1", "lag_rows_2", "lag_rows_4", "mean_rows_4"), "mean_rows_4")


@query(
    "win_slide_pairs",
    with_(
        """SELECT entity, rn AS start_row, array_to_string(list_transform(g[1:14], lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), ',') AS history,
        array_to_string(list_transform(g[15:21], lambda v: CAST(CAST(v AS INTEGER) AS VARCHAR)), ',') AS target FROM (
        SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn,
          list(guests) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING) AS g FROM day) WHERE (rn - 1) % 3 = 0 AND len(g) = 21""",
        "day",
    ),
)
def win_slide_pairs(spark, sf):
    text = lambda c: F.array_join(F.transform(c, lambda x: x["guests"].cast("int").cast("string")), ",")
    s = X.slide_pairs(I.daily(spark, sf))
    return s.select("entity", F.col("start_row").cast("long").alias("start_row"), text("history").alias("history"), text("target").alias("target"))


@query(
    "win_last_n_hist",
    with_(
        """SELECT entity, array_to_string(list(CAST(CAST(guests AS INTEGER) AS VARCHAR) ORDER BY date), ',') AS history FROM (
        SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM day) WHERE rn <= 30 GROUP BY entity""",
        "day",
    ),
)
def win_last_n_hist(spark, sf):
    h = X.last_history(I.daily(spark, sf), 30)
    return h.select("entity", F.array_join(F.transform("history", lambda x: x.cast("int").cast("string")), ",").alias("history"))


@query(
    "win_mom",
    with_(
        """SELECT year, month, round(avg_daily_guests - lag(avg_daily_guests) OVER w, 4) AS mom_change,
        round((avg_daily_guests - lag(avg_daily_guests) OVER w) / nullif(lag(avg_daily_guests) OVER w, 0) * 100, 4) AS mom_pct
        FROM month_derived WINDOW w AS (ORDER BY year, month)""",
        "month_derived",
    ),
)
def win_mom(spark, sf):
    m = X.month_change(month_derived(spark, sf), "avg_daily_guests")
    return rounded(m.select("year", "month", "mom_change", "mom_pct"), "mom_change", "mom_pct")


cte(
    "bookf",
    """SELECT d.entity, d.date, CAST(coalesce(b.booking_guests, 0) AS DOUBLE) AS booking_count,
  coalesce(b.booking_guests, 0) / avg(d.guests) OVER (PARTITION BY d.entity) AS booking_ratio FROM day d LEFT JOIN booking_day b ON b.entity = d.entity AND b.date = d.date""",
    ["day", "booking_day"],
)


@query(
    "jn_booking_features",
    with_(f"SELECT entity, {D}, booking_count, round(booking_ratio, 4) AS booking_ratio, CASE WHEN booking_ratio > 0.3 THEN 1 ELSE 0 END AS booking_flag FROM bookf", "bookf"),
)
def jn_booking_features(spark, sf):
    b = X.booking(I.daily(spark, sf), facts.booking_day(I.booking(spark, sf)))
    return rounded(b.drop("guests"), "booking_ratio")


@query(
    "jn_semi_siblings",
    with_("SELECT transaction_id, entity, guests FROM txn WHERE entity IN (SELECT entity FROM day GROUP BY entity HAVING count(*) >= 30)", "txn", "day"),
)
def jn_semi_siblings(spark, sf):
    t = I.txn(spark, sf)
    sib = facts.daily(t).groupBy("entity").agg(F.count("*").alias("n")).where("n >= 30")
    return t.join(sib, "entity", "left_semi").select("transaction_id", "entity", "guests")


cte("strends", """SELECT entity, date, m7 AS rolling_7d_mean, coalesce(m7 / nullif(m14, 0), 1) AS trend_7d, coalesce(m3 / nullif(m7, 0), 1) AS momentum,
        CASE WHEN m3 > m7 * 1.2 THEN 1 WHEN m3 < m7 * 0.8 THEN -1 ELSE 0 END AS trend_signal FROM (SELECT *, avg(guests) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3,
        avg(guests) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7, avg(guests) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS m14
        FROM sday WINDOW w AS (PARTITION BY entity ORDER BY date))""", ["sday"])
_FS = ["holiday_impact", "rolling_7d_mean", "trend_7d", "momentum", "weighted_lag", "yoy_growth_rate", "booking_ratio"]


_CODES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.EVENT_CODES.items())
_FLAGS = ["is_pre_holiday", "is_post_holiday", "is_holiday_window", "is_special_event", "is_veg"]
_NEAR = {"is_t_minus_1": -1, "is_t_minus_2": -2, "is_t_plus_1": 1}
_PART = {"month": "month(l.date)", "day_of_month": "day(l.date)", "lunar_day": "c.lunar_day", "lunar_month": "c.lunar_month"}
_DOW = {"is_weekend": "IN (6, 7)", "is_friday": "= 5", "is_saturday": "= 6", "is_sunday": "= 7"}
_FC = ", ".join(
    [f"CASE c.event_type {_CODES} ELSE 0 END AS event_code", "CASE WHEN c.holiday_type = 'TET_NGUYEN_DAN' THEN 1 ELSE 0 END AS is_tet"]
    + [f"CAST(c.{k} AS INTEGER) AS {k}" for k in _FLAGS]
    + [f"CAST(c.days_to_holiday = {v} AS INTEGER) AS {k}" for k, v in _NEAR.items()]
    + [f"CAST({v} AS INTEGER) AS {k}" for k, v in _PART.items()]
    + [f"CAST(isodow(l.date) {v} AS INTEGER) AS {k}" for k, v in _DOW.items()]
    + [f"lag_{k}d" for k in (7, 14, 28)]
)
_FN = ["event_code", "is_tet", *_FLAGS, *_NEAR, *_PART, *_DOW, "lag_7d", "lag_14d", "lag_28d"]


@query(
    "fc_features_shift",
    with_(
        f"""SELECT l.entity, CAST(l.date AS VARCHAR) AS date, l.shift, CASE l.shift WHEN 'MORNING' THEN 0 ELSE 1 END AS shift_id, CAST(isodow(l.date) - 1 AS INTEGER) AS weekday,
        CASE WHEN c.is_holiday THEN 1 ELSE 0 END AS is_holiday, CAST(c.days_to_holiday AS INTEGER) AS days_to_holiday, lag_365d, lag_364d AS same_weekday_last_year, trend_signal,
        {_FC},
        l.guests - lag_7d AS delta_7d, CASE WHEN booking_ratio > 0.3 THEN 1 ELSE 0 END AS booking_flag, g.is_outlier_day, g.outlier_weight,
        round(holiday_impact, 6) AS holiday_impact, round(rolling_7d_mean, 6) AS rolling_7d_mean, round(trend_7d, 6) AS trend_7d, round(momentum, 6) AS momentum,
        round(0.6 * lag_7d + 0.3 * lag_14d + 0.1 * lag_28d, 6) AS weighted_lag, round(yoy_growth_rate, 6) AS yoy_growth_rate, round(booking_ratio, 6) AS booking_ratio
        FROM lags l JOIN shift_flag g ON g.entity = l.entity AND g.date = l.date AND g.shift = l.shift JOIN cal c ON c.date = l.date
        JOIN strends t ON t.entity = l.entity AND t.date = l.date JOIN yoy y ON y.entity = l.entity
        JOIN (SELECT s.entity, s.date, coalesce(b.booking_guests, 0) / avg(s.guests) OVER (PARTITION BY s.entity) AS booking_ratio FROM sday s
          LEFT JOIN booking_day b ON b.entity = s.entity AND b.date = s.date) b ON b.entity = l.entity AND b.date = l.date""",
        "lags", "shift_flag", "cal", "yoy", "booking_day", "sday", "strends",
    ),
)
def fc_features_shift(spark, sf):
    f = shift_features(spark, sf)
    cols = ["entity", "date", "shift", "shift_id", "weekday", "is_holiday", "days_to_holiday", "lag_365d", "same_weekday_last_year",
            "trend_signal", "delta_7d", "booking_flag", "is_outlier_day", "outlier_weight", *_FN, *_FS]
    return rounded(f.select(*cols), *_FS, n=6)


def shift_features(spark, sf):
    s = I.once(spark, sf, "shift-facts", lambda: shift_flags(spark, sf))
    booked = dealt(I.booking(spark, sf), parts(I.table(spark, sf, "orders")), "entity", "date")
    return X.shift_frame(s, I.calendar(spark, sf), facts.booking_day(booked))


def _series(name, keys, value, src_sql, needs, src):
    """Item-line feature frames share one query shape."""
    part = ", ".join(keys)
    w = f"PARTITION BY {part} ORDER BY f.date"
    k = ", ".join(f"f.{c}" for c in keys)

    @query(
        name,
        with_(
            f"""SELECT {k}, CAST(f.date AS VARCHAR) AS date, {value}, CAST(isodow(f.date) - 1 AS INTEGER) AS day_of_week,
            CAST(f.date - min(f.date) OVER (PARTITION BY {part}) AS INTEGER) AS days_since_start, lag({value}, 1) OVER (w) AS lag1, lag({value}, 7) OVER (w) AS lag7,
            round(avg({value}) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS mean7, round(avg({value}) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 4) AS mean28
            FROM ({src_sql}) f WINDOW w AS ({w})""",
            *needs,
        ),
    )
    def run(spark, sf):
        f = X.series_frame(src(spark, sf), list(keys), value)
        return rounded(
            f.select(*keys, "date", value, "day_of_week", "days_since_start", F.col(f"{value}_lag1").alias("lag1"),
                     F.col(f"{value}_lag7").alias("lag7"), F.col(f"{value}_mean_7").alias("mean7"), F.col(f"{value}_mean_28").alias("mean28")),
            "mean7", "mean28",
        )

    return run


def item_day(spark, sf):
    return item_facts(spark, sf)


_series("fc_features_guest", ("entity",), "guests", "SELECT * FROM day", ("day",), lambda s, f: I.daily(s, f))
_series("fc_features_item", ("entity", "item"), "quantity", "SELECT * FROM item_day", ("item_day",), item_day)
_series("fc_features_group", ("entity", "item_group"), "quantity", "SELECT entity, date, item_group, sum(quantity) AS quantity FROM item_day GROUP BY ALL",
        ("item_day",), lambda s, f: facts.group_facts(item_day(s, f)))
_series("fc_features_guest_shift", ("entity", "shift"), "guests", "SELECT * FROM shift_day", ("shift_day",), lambda s, f: I.shift_day(s, f))


@query(
    "fc_future_frame",
    with_(
        f"""SELECT h.entity, CAST(h.date AS VARCHAR) AS date, l.lag1 AS guests_lag1, round(l.m7, 4) AS guests_mean_7 FROM hz h JOIN (
        SELECT entity, arg_max(lag1, date) AS lag1, arg_max(m7, date) AS m7 FROM (SELECT entity, date, lag(guests) OVER (w) AS lag1,
          avg(guests) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7 FROM day WINDOW w AS {_W}) WHERE lag1 IS NOT NULL GROUP BY entity) l ON l.entity = h.entity""",
        "hz", "day",
    ),
)
def fc_future_frame(spark, sf):
    f = X.series_frame(I.daily(spark, sf), ["entity"], "guests").where("guests_lag1 is not null")
    out = X.future_frame(f, ["entity"], hz(spark, sf).select("entity", "date"), ["guests_lag1", "guests_mean_7"])
    return rounded(out, "guests_mean_7")


cte("wd_med", "SELECT entity, isodow(date) AS wd, median(guests) AS m2 FROM shift_day GROUP BY ALL", ["shift_day"])


@query(
    "fc_lag_fallback",
    with_(
        """SELECT h.entity, CAST(h.date AS VARCHAR) AS date, x.shift, coalesce(a.guests, m1, m2 / 2, m3) AS lag_7d, coalesce(b.guests, m1, m2 / 2, m3) AS lag_14d, coalesce(c.guests, m1, m2 / 2, m3) AS lag_28d
        FROM hz h CROSS JOIN (SELECT unnest(['MORNING', 'EVENING']) AS shift) x
        LEFT JOIN shift_day a ON a.entity = h.entity AND a.shift = x.shift AND a.date = h.date - 7 LEFT JOIN shift_day b ON b.entity = h.entity AND b.shift = x.shift AND b.date = h.date - 14
        LEFT JOIN shift_day c ON c.entity = h.entity AND c.shift = x.shift AND c.date = h.date - 28
        LEFT JOIN (SELECT entity, isodow(date) AS wd, shift, median(guests) AS m1 FROM shift_day GROUP BY ALL) p ON p.entity = h.entity AND p.shift = x.shift AND p.wd = isodow(h.date)
        LEFT JOIN wd_med q ON q.entity = h.entity AND q.wd = isodow(h.date) LEFT JOIN (SELECT entity, median(guests) AS m3 FROM shift_day GROUP BY entity) r ON r.entity = h.entity""",
        "hz", "shift_day", "wd_med",
    ),
)
def fc_lag_fallback(spark, sf):
    return X.lag_fallback(hz(spark, sf, True).select("entity", "date", "shift"), I.shift_day(spark, sf))


@query(
    "fc_sample_weight",
    with_(
        """SELECT sample_weight, count(*) AS n FROM (SELECT round(least(greatest(outlier_weight, 0.2), 1.0) * CASE WHEN isodow(date) >= 6 AND shift = 'EVENING'
        THEN CASE WHEN guests > 15 THEN 5.0 ELSE 3.0 END ELSE 1.0 END, 4) AS sample_weight FROM shift_flag) GROUP BY 1""",
        "shift_flag",
    ),
)
def fc_sample_weight(spark, sf):
    s = shift_flags(spark, sf).withColumn("is_weekend", (F.weekday("date") >= 5).cast("int"))
    return P.sample_weight(s).groupBy(F.round("sample_weight", 4).alias("sample_weight")).agg(F.count("*").alias("n"))


# -- simple forecasts ---------------------------------------------------------------------------

_SH = "CASE x.shift WHEN 'MORNING' THEN 0.45::DOUBLE ELSE 0.55::DOUBLE END"
cte("two_shifts", "SELECT unnest(['MORNING', 'EVENING']) AS shift")


@query(
    "fc_baseline_median",
    with_(
        f"""SELECT h.entity, CAST(h.date AS VARCHAR) AS date, x.shift, greatest(0.0, round_even(coalesce(m, ma) * {_SH} * CASE WHEN h.is_holiday THEN 1.0 ELSE h.holiday_impact END, 0)) AS forecast
        FROM hz h CROSS JOIN two_shifts x JOIN (SELECT entity, median(guests) AS ma FROM day GROUP BY entity) a ON a.entity = h.entity
        LEFT JOIN (SELECT entity, isodow(date) AS wd, median(guests) AS m FROM day GROUP BY ALL) b ON b.entity = h.entity AND b.wd = isodow(h.date)""",
        "hz", "two_shifts", "day",
    ),
)
def fc_baseline_median(spark, sf):
    return P.baseline_median(I.daily(spark, sf), hz(spark, sf)).select("entity", "date", "shift", "forecast")


cte(
    "item_recent",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, item ORDER BY date DESC) AS rn FROM item_day) WHERE rn <= 28",
    ["item_day"],
)
cte("ih", "SELECT DISTINCT entity, item, CAST(unnest(generate_series(TIMESTAMP '2001-08-02', TIMESTAMP '2001-08-08', INTERVAL 1 DAY)) AS DATE) AS date FROM item_day", ["item_day"])
cte(
    "item_pred",
    """SELECT h.entity, h.item, h.date, greatest(0, coalesce(m, ma)) AS forecast FROM ih h JOIN (SELECT entity, item, avg(quantity) AS ma FROM item_recent GROUP BY ALL) a
   ON a.entity = h.entity AND a.item = h.item LEFT JOIN (SELECT entity, item, isodow(date) AS wd, avg(quantity) AS m FROM item_recent GROUP BY ALL) b
   ON b.entity = h.entity AND b.item = h.item AND b.wd = isodow(h.date)""",
    ["ih", "item_recent"],
)


def item_pred(spark, sf):
    """Forecasts of the week per item series, in one row each."""
    s = F.lit("2001-08-02").cast("date")
    means = P.weekday_means(item_day(spark, sf), ["entity", "item"], "quantity")
    days = F.transform(F.sequence(s, F.date_add(s, 6)), lambda d: F.struct(d.alias("date"), P.of_weekday(d).alias("forecast")))
    return means.select("entity", "item", days.alias("days"))


@query(
    "fc_weekday_avg",
    with_(f"SELECT entity, item, {D}, round(forecast, 4) AS forecast FROM item_pred", "item_pred"),
)
def fc_weekday_avg(spark, sf):
    return rounded(item_pred(spark, sf).select("entity", "item", F.inline("days")), "forecast")


@query(
    "fc_item_shift",
    with_(
        f"""SELECT p.entity, p.item, CAST(p.date AS VARCHAR) AS date, x.shift, greatest(0.0, round_even(p.forecast * coalesce(r.ratio, {_SH}), 0)) AS forecast
        FROM item_pred p CROSS JOIN two_shifts x LEFT JOIN item_shift_ratio r ON r.entity = p.entity AND r.item = p.item AND r.shift = x.shift""",
        "item_pred", "two_shifts", "item_shift_ratio",
    ),
)
def fc_item_shift(spark, sf):
    ratios = facts.item_shift_ratio(item_facts(spark, sf, by_shift=True))
    n = parts(I.items(spark, sf))
    return P.item_shift(item_pred(spark, sf).repartition(n, "entity", "item"), ratios)


cte("gs28", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, shift ORDER BY date DESC) AS rn FROM shift_day) WHERE rn <= 28", ["shift_day"])
cte("gd28", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM sday) WHERE rn <= 28", ["sday"])


@query(
    "fc_guest_shift",
    with_(
        f"""SELECT entity, {D}, shift, own, round_even(v, 0) AS forecast, round_even(round_even(v, 0) / greatest(per_txn, 1), 0) AS transactions FROM (
        SELECT h.entity, h.date, x.shift, c.own, c.per_txn, CASE WHEN c.own THEN coalesce(a.m, b.m) ELSE coalesce(d.m, e.m) * coalesce(r.ratio, {_SH}) END AS v
        FROM hz h CROSS JOIN two_shifts x JOIN (SELECT entity, count(*) FILTER (shift = 'MORNING') >= 14 AND count(*) FILTER (shift = 'EVENING') >= 14 AS own, sum(guests) / sum(transactions) AS per_txn
          FROM guest_shift GROUP BY entity) c ON c.entity = h.entity
        LEFT JOIN (SELECT entity, shift, isodow(date) AS wd, avg(guests) AS m FROM gs28 GROUP BY ALL) a ON a.entity = h.entity AND a.shift = x.shift AND a.wd = isodow(h.date)
        LEFT JOIN (SELECT entity, shift, avg(guests) AS m FROM gs28 GROUP BY ALL) b ON b.entity = h.entity AND b.shift = x.shift
        LEFT JOIN (SELECT entity, isodow(date) AS wd, avg(guests) AS m FROM gd28 GROUP BY ALL) d ON d.entity = h.entity AND d.wd = isodow(h.date)
        LEFT JOIN (SELECT entity, avg(guests) AS m FROM gd28 GROUP BY ALL) e ON e.entity = h.entity
        LEFT JOIN hist_shift_ratio r ON r.entity = h.entity AND r.weekday = dayname(h.date) AND r.shift = x.shift)""",
        "hz", "two_shifts", "guest_shift", "hist_shift_ratio", "gs28", "gd28",
    ),
)
def fc_guest_shift(spark, sf):
    g = facts.guest_facts(I.txn(spark, sf), by_shift=True)
    out = P.guest_shift(g, hz(spark, sf).select("entity", "date"), facts.hist_shift_ratio(g))
    return out.select("entity", "date", "shift", "own", "forecast", "transactions")


# -- the chain ------------------------------------------------------------------------------------

TODAY = "2001-01-04"
PROF = ["entity", "strategy", "volume_segment", "category", "confidence", "active_days", "cv", "avg_daily", "trend_score", "trend_short",
        "max_daily_normal", "max_daily_normal_weekday", "max_daily_normal_weekend", "min_daily_normal_weekday", "min_daily_normal_weekend",
        "max_by_special", "should_exclude", "mean_7d"]


def prof(spark, sf):
    return I.once(spark, sf, "profile", lambda: profile.report(I.daily(spark, sf), I.calendar(spark, sf), I.AS_OF).select(*PROF))


def chain_input(spark, sf):
    """Horizon with calendar, profile, four forecast sources and bookings."""
    d = I.daily(spark, sf).withColumn("wd", F.weekday("date"))
    wd = d.groupBy("entity", "wd").agg(F.avg("guests").alias("ml"), F.median("guests").alias("seasonal"))
    every = d.groupBy("entity").agg(F.avg("guests").alias("mean_all"))
    h = hz(spark, sf).join(P.strategy_weights(prof(spark, sf)), "entity").withColumn("wd", F.weekday("date"))
    h = h.join(wd, ["entity", "wd"], "left").join(every, "entity")
    h = h.withColumns({"neural": F.when(F.col("active_days") >= 100, F.col("mean_all")), "ai": F.col("mean_7d")})
    return P.booking_ratio(h, facts.booking_day(I.booking(spark, sf)))


_SW = "CASE strategy " + " ".join(f"WHEN '{k}' THEN {{}}" for k in rules.STRATEGY_WEIGHTS) + " END"
_MLW = _SW.format(*[f"{v[0]}::DOUBLE" for v in rules.STRATEGY_WEIGHTS.values()])
_AIW = _SW.format(*[f"{v[1]}::DOUBLE" for v in rules.STRATEGY_WEIGHTS.values()])
cte(
    "chain0",
    f"""SELECT h.*, p.* EXCLUDE entity, {_MLW} AS ml_weight, {_AIW} AS ai_weight, w.ml, w.seasonal, CASE WHEN p.active_days >= 100 THEN p.avg_daily END AS neural, p.mean_7d AS ai,
   coalesce(b.booking_guests / p.avg_daily, 0) AS booking_ratio,
   (SELECT max_daily FROM caps_type t WHERE t.entity = h.entity AND t.special_type = h.holiday_type) AS own_h,
   (SELECT max_daily FROM caps_type t WHERE t.entity = h.entity AND t.special_type = h.event_type) AS own_e
  FROM hz h JOIN (SELECT entity, strategy, volume_segment, category, confidence, active_days, cv, avg_daily, trend_score, trend_short, mean_7d, exclude_reason,
     max_daily_normal, max_daily_normal_weekday, max_daily_normal_weekend, min_daily_normal_weekday, min_daily_normal_weekend FROM report) p ON p.entity = h.entity
  LEFT JOIN (SELECT entity, isodow(date) AS wd, avg(guests) AS ml, median(guests) AS seasonal FROM day GROUP BY ALL) w ON w.entity = h.entity AND w.wd = isodow(h.date)
  LEFT JOIN booking_day b ON b.entity = h.entity AND b.date = h.date""",
    ["hz", "report", "caps_type", "day", "booking_day"],
)
_PARTS = [("ml", "ml_weight * 0.6::DOUBLE"), ("neural", "ml_weight * 0.2::DOUBLE"), ("seasonal", "ml_weight * 0.2::DOUBLE"), ("ai", "ai_weight")]
_TOT = " + ".join(f"CASE WHEN {c} >= 0 THEN {w} ELSE 0 END" for c, w in _PARTS)
_VAL = " + ".join(f"CASE WHEN {c} >= 0 THEN {c} * {w} ELSE 0 END" for c, w in _PARTS)
cte("chain1", f"SELECT *, CASE WHEN {_TOT} > 0 THEN greatest(0, ({_VAL}) / nullif({_TOT}, 0)) END AS c1 FROM chain0", ["chain0"])
cte(
    "chain2",
    f"""SELECT *, CASE WHEN date > DATE '{TODAY}' THEN c1 * least(greatest(1 + trend_score / 2000 * ((date - DATE '{TODAY}') / 7), 0.85), 1.15) ELSE c1 END AS c2
  FROM (SELECT * REPLACE (coalesce(c1, 0) AS c1) FROM chain1)""",
    ["chain1"],
)
cte(
    "chain3",
    """SELECT *, c2 * CASE WHEN trend_short > 1.1 THEN least(greatest(trend_short, 1.05), 1.15) WHEN trend_short < 0.9 THEN least(greatest(trend_short, 0.85), 0.95) ELSE 1.0 END AS c3,
  coalesce(is_holiday AND holiday_type IN ('LIBERATION_DAY', 'LABOR_DAY', 'NATIONAL_DAY', 'HUNG_KINGS', 'TET_DUONG_LICH') AND NOT closed_likely, false) AS busy FROM chain2""",
    ["chain2"],
)
_CURVE = "CASE volume_segment " + " ".join(
    f"WHEN '{s}' THEN CASE days_to_holiday " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in c.items()) + " END" for s, c in rules.HOLIDAY_CURVES.items()
) + " END"
_HF = f"""CASE WHEN busy AND holiday_impact <> 1 THEN greatest(1, holiday_impact) WHEN is_holiday_window AND booking_ratio > 1.5 THEN greatest(1, booking_ratio * 0.8)
  WHEN is_holiday_window AND {_CURVE} IS NOT NULL THEN {_CURVE} WHEN holiday_impact <> 1 AND NOT is_holiday THEN holiday_impact ELSE 1.0 END"""


def _tail(src, col):
    return f"""SELECT *, CASE WHEN cap > 0 THEN least(c4, cap) ELSE c4 END AS c5a,
   greatest(CASE WHEN cap > 0 THEN least(c4, cap) ELSE c4 END, coalesce(floor_v, CASE WHEN cap > 0 THEN least(c4, cap) ELSE c4 END)) AS c5 FROM (
   SELECT *, coalesce(CASE WHEN is_holiday THEN own_h END, CASE WHEN is_special_event THEN own_e END,
     CASE WHEN isodow(date) >= 6 THEN max_daily_normal_weekend ELSE max_daily_normal_weekday END * CASE WHEN busy THEN greatest(1, holiday_factor) ELSE 1 END) AS cap,
     CASE WHEN NOT is_holiday AND NOT is_special_event AND CASE WHEN isodow(date) >= 6 THEN min_daily_normal_weekend ELSE min_daily_normal_weekday END > 0
       THEN CASE WHEN isodow(date) >= 6 THEN min_daily_normal_weekend ELSE min_daily_normal_weekday END END AS floor_v FROM (
   SELECT *, CASE WHEN busy OR NOT is_holiday THEN {col} * holiday_factor ELSE {col} END AS c4 FROM (SELECT *, {_HF} AS holiday_factor FROM {src})))"""


cte("chain5", _tail("chain3", "c3"), ["chain3"])
cte("chain5l", _tail("chain3", "c2"), ["chain3"])
KEYS = f"entity, {D}"


@query("fc_strategy_weights", with_(f"SELECT entity, strategy, CASE WHEN entity = 'R0' THEN 0.9::DOUBLE ELSE {_MLW} END AS ml_weight, CASE WHEN entity = 'R0' THEN 0.1::DOUBLE ELSE {_AIW} END AS ai_weight FROM report", "report"))
def fc_strategy_weights(spark, sf):
    p = profile.classify(I.daily(spark, sf)).select("entity", "strategy")
    learned = p.where("entity = 'R0'").select("entity", F.lit(0.9).alias("ml_weight"), F.lit(0.1).alias("ai_weight"))
    return P.strategy_weights(p, learned)


@query("fc_blend", with_(f"SELECT {KEYS}, round(c1, 4) AS combined FROM chain1", "chain1"))
def fc_blend(spark, sf):
    return rounded(P.blend(chain_input(spark, sf)).select("entity", "date", "combined"), "combined")


@query("fc_growth_adj", with_(f"SELECT {KEYS}, round(c2, 4) AS combined FROM chain2", "chain2"))
def fc_growth_adj(spark, sf):
    d = P.growth_adjust(P.blend_or_zero(chain_input(spark, sf)), TODAY)
    return rounded(d.select("entity", "date", "combined"), "combined")


@query("fc_trend_adj", with_(f"SELECT {KEYS}, round(c3, 4) AS combined FROM chain3", "chain3"))
def fc_trend_adj(spark, sf):
    d = P.trend_adjust(P.growth_adjust(P.blend_or_zero(chain_input(spark, sf)), TODAY))
    return rounded(d.select("entity", "date", "combined"), "combined")


@query("fc_holiday_factor", with_(f"SELECT {KEYS}, round(holiday_factor, 4) AS holiday_factor, round(c4, 4) AS combined FROM chain5", "chain5"))
def fc_holiday_factor(spark, sf):
    d = P.trend_adjust(P.growth_adjust(P.blend_or_zero(chain_input(spark, sf)), TODAY))
    return rounded(P.holiday_factor(d).select("entity", "date", "holiday_factor", "combined"), "holiday_factor", "combined")


@query("fc_cap_floor", with_(f"SELECT {KEYS}, round(c5, 4) AS combined FROM chain5", "chain5"))
def fc_cap_floor(spark, sf):
    return rounded(P.chain(chain_input(spark, sf), TODAY).select("entity", "date", "combined"), "combined")


@query("fc_daily_only", with_(f"SELECT {KEYS}, round_even(c5, 0) AS forecast FROM chain5l", "chain5l"))
def fc_daily_only(spark, sf):
    return P.daily_only(chain_input(spark, sf), TODAY).select("entity", "date", "forecast")


cte("p_shift", "SELECT entity, isodow(date) AS wd, shift, quantile_cont(guests, 0.20) AS p20, quantile_cont(guests, 0.95) AS p95 FROM shift_day GROUP BY ALL HAVING count(*) >= 3", ["shift_day"])
cte("p_day", "SELECT entity, isodow(date) AS wd, quantile_cont(guests, 0.95) AS day_p95 FROM sday GROUP BY ALL HAVING count(*) >= 3", ["sday"])


@query(
    "fc_p95_clip",
    with_(f"SELECT h.entity, CAST(h.date AS VARCHAR) AS date, round(CASE WHEN day_p95 > 0 THEN least(h.ai, day_p95) ELSE h.ai END, 4) AS ai FROM chain0 h LEFT JOIN p_day p ON p.entity = h.entity AND p.wd = isodow(h.date)", "chain0", "p_day"),
)
def fc_p95_clip(spark, sf):
    by_day, _ = P.percentiles(I.shift_day(spark, sf))
    return rounded(P.p95_clip(chain_input(spark, sf), by_day, "ai").select("entity", "date", "ai"), "ai")


def split(spark, sf):
    s = I.shift_day(spark, sf)
    ml = s.groupBy("entity", F.weekday("date").alias("wd")).agg(
        F.avg(F.when(F.col("shift") == "MORNING", F.col("guests"))).alias("ml_morning"),
        F.avg(F.when(F.col("shift") == "EVENING", F.col("guests"))).alias("ml_evening"),
    )
    d = P.chain(chain_input(spark, sf), TODAY).withColumn("wd", F.weekday("date")).join(ml, ["entity", "wd"], "left").drop("wd")
    return P.shift_split(d, facts.weekday_shift_ratio(I.txn(spark, sf)), P.percentiles(s)[1])


cte(
    "split1",
    """SELECT d.*, a.mm / (a.mm + a.me) AS mm, h.hm AS hm0, h.he AS he0, coalesce(h.hm, h.he) IS NOT NULL AS have_h FROM chain5 d
  LEFT JOIN (SELECT entity, isodow(date) AS wd, avg(guests) FILTER (shift = 'MORNING') AS mm, avg(guests) FILTER (shift = 'EVENING') AS me FROM shift_day GROUP BY ALL) a
   ON a.entity = d.entity AND a.wd = isodow(d.date)
  LEFT JOIN (SELECT entity, weekday, max(ratio) FILTER (shift = 'MORNING') AS hm, max(ratio) FILTER (shift = 'EVENING') AS he FROM wd_shift_ratio GROUP BY ALL) h
   ON h.entity = d.entity AND h.weekday = dayname(d.date)""",
    ["chain5", "shift_day", "wd_shift_ratio"],
)
cte(
    "split2",
    """SELECT *, CASE WHEN mm IS NOT NULL AND have_h THEN (al * mm + (1 - al) * hm) / (al * mm + (1 - al) * hm + al * (1 - mm) + (1 - al) * he) WHEN mm IS NOT NULL THEN mm WHEN have_h THEN hm ELSE 0.45 END AS sm,
   CASE WHEN mm IS NOT NULL AND have_h THEN (al * (1 - mm) + (1 - al) * he) / (al * mm + (1 - al) * hm + al * (1 - mm) + (1 - al) * he) WHEN mm IS NOT NULL THEN 1 - mm WHEN have_h THEN he ELSE 0.55 END AS se FROM (
  SELECT *, coalesce(hm0, 0.5) AS hm, coalesce(he0, 0.5) AS he, CASE WHEN abs(mm - 0.5) / 0.5 < 0.15 THEN 0.7 WHEN abs(mm - 0.5) / 0.5 > 0.3 THEN 0.3
    ELSE 0.7 * (1 - (abs(mm - 0.5) / 0.5 - 0.15) / 0.15) + 0.3 * ((abs(mm - 0.5) / 0.5 - 0.15) / 0.15) END AS al FROM split1)""",
    ["split1"],
)
cte(
    "split3",
    """SELECT *, CASE WHEN NOT is_holiday AND NOT is_special_event AND p20 > 0 AND v1 < p20 THEN floor(p20) ELSE v1 END AS forecast FROM (
  SELECT *, CASE WHEN px > 0 AND v0 > px THEN floor(px) ELSE v0 END AS v1 FROM (
  SELECT d.*, x.shift, CASE x.shift WHEN 'MORNING' THEN sm ELSE se END AS share, greatest(0, round_even(c5 * CASE x.shift WHEN 'MORNING' THEN sm ELSE se END, 0)) AS v0, p20,
   p95 * CASE WHEN busy THEN greatest(1, holiday_factor) ELSE 1 END AS px FROM split2 d CROSS JOIN two_shifts x
   LEFT JOIN p_shift p ON p.entity = d.entity AND p.shift = x.shift AND p.wd = isodow(d.date)))""",
    ["split2", "two_shifts", "p_shift"],
)


@query("fc_shift_split", with_(f"SELECT {KEYS}, shift, round(share, 4) AS share, forecast FROM split3", "split3"))
def fc_shift_split(spark, sf):
    return rounded(split(spark, sf).select("entity", "date", "shift", "share", "forecast"), "share")


@query(
    "fc_route",
    with_(
        f"""SELECT {KEYS}, CASE WHEN category = 'NEW' OR active_days < 7 THEN 'chain_blend' WHEN volume_segment = 'LOW_VOLUME' THEN 'baseline' ELSE 'ensemble' END AS route,
        CASE WHEN date - DATE '{H_START}' < 30 THEN 'short' ELSE 'long' END AS span FROM chain0 WHERE exclude_reason = 'OK' OR category = 'NEW'""",
        "chain0",
    ),
)
def fc_route(spark, sf):
    return P.route(prof(spark, sf), hz(spark, sf).select("entity", "date"), H_START)


@query(
    "fc_confidence",
    with_(
        """SELECT entity, round(least(greatest(0.5 + CASE WHEN n >= 4 THEN 0.15 WHEN n >= 2 THEN 0.10 WHEN n >= 1 THEN 0.05 ELSE 0 END
          + CASE confidence WHEN 'HIGH' THEN 0.15 WHEN 'MEDIUM' THEN 0.05 WHEN 'LOW' THEN -0.10 ELSE 0 END
          + CASE WHEN active_days > 60 THEN 0.10 WHEN active_days > 30 THEN 0.05 WHEN active_days < 14 THEN -0.15 ELSE 0 END
          + CASE WHEN cv > 0.8 THEN -0.10 WHEN cv > 0.5 THEN -0.05 ELSE 0 END, 0), 1)::DOUBLE, 4) AS confidence_score
        FROM (SELECT *, CASE WHEN active_days >= 100 THEN 4 ELSE 3 END AS n FROM klass)""",
        "klass",
    ),
)
def fc_confidence(spark, sf):
    p = profile.classify(I.daily(spark, sf)).withColumn("n_models", F.when(F.col("active_days") >= 100, 4).otherwise(3))
    return rounded(P.confidence(p).select("entity", "confidence_score"), "confidence_score")


def _pre(spark, sf):
    """Shift forecasts pushed around a little, as if corrected."""
    up = F.when(F.dayofmonth("date") % 4 == 0, 3.0).when(F.dayofmonth("date") % 4 == 1, 0.4).otherwise(1.0)
    return split(spark, sf).withColumn("forecast", F.bround(F.col("forecast") * up, 0))


cte(
    "pre",
    """SELECT *, sum(f0) OVER (PARTITION BY entity, date) AS d0 FROM (SELECT *, round_even(forecast * CASE day(date) % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 0.4 ELSE 1.0 END, 0) AS f0 FROM split3)""",
    ["split3"],
)
cte(
    "fcap",
    """SELECT *, CASE WHEN k IS NOT NULL THEN greatest(0, round_even(f0 * k, 0)) ELSE f0 END AS f1 FROM (
  SELECT *, CASE WHEN cap2 > 0 AND d0 > cap2 THEN cap2 / d0 WHEN d0 > 0 AND d0 < floor_v THEN floor_v / greatest(d0, 1) END AS k FROM (
  SELECT *, coalesce(CASE WHEN is_holiday THEN own_h END, CASE WHEN is_special_event THEN own_e END, max_daily_normal * CASE WHEN coalesce(is_holiday AND holiday_type IN
    ('LIBERATION_DAY', 'LABOR_DAY', 'NATIONAL_DAY', 'HUNG_KINGS', 'TET_DUONG_LICH'), false) THEN greatest(1, holiday_impact) ELSE 1 END) AS cap2 FROM pre))""",
    ["pre"],
)


@query("fc_final_cap", with_(f"SELECT {KEYS}, shift, f1 AS forecast FROM fcap", "fcap"))
def fc_final_cap(spark, sf):
    return P.final_cap(_pre(spark, sf)).select("entity", "date", "shift", "forecast")


cte(
    "guard",
    """SELECT *, CASE WHEN NOT is_holiday AND NOT is_special_event AND d1 > 0 AND b > 0 AND (d1 > hi OR d1 < lo) AND NOT (avg_daily >= 100 AND d1 > b)
   THEN greatest(0, round_even(f1 * (least(greatest(d1, lo), hi) / d1), 0)) ELSE f1 END AS f2 FROM (
  SELECT *, CASE WHEN avg_daily >= 100 THEN b * 0.80 ELSE b * 0.85 END AS lo, CASE WHEN avg_daily >= 100 THEN b * 1.35 ELSE b * 1.20 END AS hi FROM (
  SELECT f.*, sum(f1) OVER (PARTITION BY f.entity, f.date) AS d1, coalesce(w.avg, f.avg_daily) AS b FROM fcap f LEFT JOIN wd_stats w ON w.entity = f.entity AND w.weekday = dayname(f.date)))""",
    ["fcap", "wd_stats"],
)


def _guarded(spark, sf):
    wd = profile.weekday_stats(I.daily(spark, sf)).select("entity", "weekday", "avg")
    return P.guardrail(P.final_cap(_pre(spark, sf)), wd)


@query("fc_guardrail", with_(f"SELECT {KEYS}, shift, f2 AS forecast FROM guard", "guard"))
def fc_guardrail(spark, sf):
    return _guarded(spark, sf).select("entity", "date", "shift", "forecast")


@query(
    "fc_half_day",
    with_(
        """SELECT s.entity, CAST(s.date AS VARCHAR) AS date, s.shift, c.state, CASE c.state WHEN 'CLOSED' THEN 0.0 WHEN 'HALF_DAY' THEN round_even(s.guests * 0.5, 0) ELSE s.guests END AS forecast
        FROM (SELECT entity, date + 28 AS date, shift, guests FROM shift_day) s LEFT JOIN closed_dates c ON c.entity = s.entity AND c.date = s.date""",
        "shift_day", "closed_dates",
    ),
)
def fc_half_day(spark, sf):
    f = I.shift_day(spark, sf).select(
        "entity", F.date_add("date", 28).alias("date"), "shift", F.col("guests").alias("forecast")
    )
    return P.half_day(f, closed_dates(spark, sf))


# -- chains and new entities ------------------------------------------------------------------------


def chain_dim(spark, sf):
    return I.entity_dim(spark, sf).select(F.col("merge_key").alias("entity"), F.split("restaurant_name", "-")[0].alias("chain"))


cte("chain_dim", "SELECT merge_key AS entity, split_part(restaurant_name, '-', 1) AS chain FROM dim", ["dim"])
cte(
    "sib",
    """SELECT c.entity, c.chain, coalesce(n, 0) AS days, coalesce(n, 0) >= 30 AS is_sibling FROM chain_dim c LEFT JOIN (SELECT entity, count(*) AS n FROM day GROUP BY entity) d ON d.entity = c.entity""",
    ["chain_dim", "day"],
)


@query("fc_siblings", with_("SELECT * FROM sib", "sib"))
def fc_siblings(spark, sf):
    return P.siblings(I.daily(spark, sf), chain_dim(spark, sf))


def _hourly(spark, sf):
    return I.txn(spark, sf).groupBy("entity", "date", "hour").agg(F.sum("guests").alias("guests"))


def _patterns(spark, sf):
    return P.chain_patterns(_hourly(spark, sf), P.siblings(I.daily(spark, sf), chain_dim(spark, sf)))


cte("lvl", "SELECT chain, median(m) AS chain_avg, count(*) AS n_siblings FROM (SELECT chain, s.entity, avg(guests) AS m FROM day d JOIN sib s ON s.entity = d.entity AND is_sibling GROUP BY 1, 2) GROUP BY chain", ["day", "sib"])
cte(
    "mult",
    """SELECT chain, wd, m / sum(m) OVER (PARTITION BY chain) * 7 AS multiplier FROM (SELECT chain, isodow(date) AS wd, median(guests) AS m FROM day d JOIN sib s ON s.entity = d.entity AND is_sibling GROUP BY 1, 2)""",
    ["day", "sib"],
)
cte(
    "chours",
    """SELECT chain, day_kind, hour, r / sum(r) OVER (PARTITION BY chain, day_kind) AS ratio FROM (SELECT *, v / sum(v) OVER (PARTITION BY chain, day_kind) AS r FROM (
  SELECT chain, CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_kind, hour, sum(guests) AS v FROM txn t JOIN sib s ON s.entity = t.entity AND is_sibling GROUP BY 1, 2, 3)) WHERE r > 0.005""",
    ["txn", "sib"],
)


@query(
    "fc_chain_patterns",
    with_(
        """SELECT 'level' AS part, chain, CAST(n_siblings AS VARCHAR) AS key, round(chain_avg, 4) AS value FROM lvl UNION ALL SELECT 'weekday', chain, CAST(wd - 1 AS VARCHAR), round(multiplier, 4) FROM mult
        UNION ALL SELECT day_kind, chain, CAST(hour AS VARCHAR), round(ratio, 4) FROM chours""",
        "lvl", "mult", "chours",
    ),
)
def fc_chain_patterns(spark, sf):
    level, mult, hours = _patterns(spark, sf)
    a = level.select(F.lit("level").alias("part"), "chain", F.col("n_siblings").cast("string").alias("key"), F.col("chain_avg").alias("value"))
    b = mult.select(F.lit("weekday").alias("part"), "chain", F.col("wd").cast("string").alias("key"), F.col("multiplier").alias("value"))
    c = hours.select(F.col("day_kind").alias("part"), "chain", F.col("hour").cast("string").alias("key"), F.col("ratio").alias("value"))
    return rounded(a.unionByName(b).unionByName(c), "value")


cte(
    "own_hours",
    """SELECT entity, unnest(CASE WHEN count(DISTINCT day_kind) OVER (PARTITION BY entity) = 1 THEN ['weekday', 'weekend'] ELSE [day_kind] END) AS day_kind,
  hour, ratio FROM hour_share""",
    ["hour_share"],
)
cte(
    "tg",
    """SELECT n.entity, n.chain, n.own_avg, least(1.0, n.days / 7) AS w, v.chain_avg FROM (SELECT s.entity, s.chain, s.days, avg(d.guests) AS own_avg
  FROM sib s JOIN day d ON d.entity = s.entity GROUP BY ALL) n LEFT JOIN lvl v ON v.chain = n.chain WHERE n.days < 45""",
    ["sib", "day", "lvl"],
)


@query(
    "fc_chain_blend",
    with_(
        """SELECT h.entity, t.chain, CAST(h.date AS VARCHAR) AS date, s.hour, round(t.w, 4) AS own_weight, round(daily, 4) AS daily, greatest(0.0, round_even(daily * s.ratio, 0)) AS forecast, method FROM (
         SELECT e.*, CASE WHEN chain_avg IS NOT NULL THEN w * own_avg + (1 - w) * chain_avg * coalesce(m.multiplier, 1) ELSE own_avg END * CASE WHEN e.is_holiday THEN e.holiday_impact ELSE 1 END AS daily,
           CASE WHEN chain_avg IS NOT NULL THEN 'CHAIN_BLEND' ELSE 'OWN_DATA_ONLY' END AS method FROM (SELECT z.entity, z.date, z.is_holiday, z.holiday_impact, tg.chain, tg.own_avg, tg.w, tg.chain_avg FROM hz z JOIN tg ON tg.entity = z.entity) e
           LEFT JOIN mult m ON m.chain = e.chain AND m.wd = isodow(e.date)) h JOIN tg t ON t.entity = h.entity
        JOIN (SELECT entity, day_kind, hour, coalesce(x / nullif(sum(x) OVER (PARTITION BY entity, day_kind), 0), 1.0 / 15) AS ratio FROM (
          SELECT tg.entity, k.day_kind, hr.hour, w * coalesce(o.ratio, 0) + (1 - w) * coalesce(c.ratio, 0) AS x FROM tg CROSS JOIN (SELECT unnest(['weekday', 'weekend']) AS day_kind) k
          CROSS JOIN (SELECT CAST(unnest(range(0, 24)) AS INTEGER) AS hour) hr LEFT JOIN chours c ON c.chain = tg.chain AND c.day_kind = k.day_kind AND c.hour = hr.hour
          LEFT JOIN own_hours o ON o.entity = tg.entity AND o.day_kind = k.day_kind AND o.hour = hr.hour)) s
         ON s.entity = h.entity AND s.day_kind = CASE WHEN isodow(h.date) >= 6 THEN 'weekend' ELSE 'weekday' END AND s.hour BETWEEN 8 AND 22""",
        "hz", "mult", "chours", "own_hours", "tg",
    ),
)
def fc_chain_blend(spark, sf):
    d = I.daily(spark, sf)
    own = d.groupBy("entity").agg(F.avg("guests").alias("own_avg"), F.count("*").alias("own_days"))
    targets = chain_dim(spark, sf).join(own.where("own_days < 45"), "entity", "left_semi")
    level, mult, hours = _patterns(spark, sf)
    out = P.chain_blend(targets, own, level.drop("n_siblings"), mult, hours, facts.hour_ratio(I.txn(spark, sf)),
                        hz(spark, sf).select("entity", "date", "is_holiday", "holiday_impact"))
    return rounded(out, "own_weight", "daily")


@query(
    "fc_future_open",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, CAST(opening_date AS VARCHAR) AS opening_date, graduate FROM (
        SELECT o.entity, c.date, o.opening_date, d.entity IS NOT NULL AS graduate FROM (SELECT key AS entity, min(from_date) AS opening_date FROM open_close WHERE output = 'future_open' GROUP BY key) o
        JOIN cal c ON c.date >= DATE '2001-08-02' AND c.date < DATE '2001-10-01' AND c.date >= o.opening_date LEFT JOIN (SELECT DISTINCT 'E' || substr(entity, 2) AS entity FROM day) d ON d.entity = o.entity)""",
        "open_close", "cal", "day",
    ),
)
def fc_future_open(spark, sf):
    from tidecast.plans.q_sources import open_close

    o = open_close(spark, sf).where("output = 'future_open'").groupBy(F.col("key").alias("entity")).agg(F.min("from_date").alias("opening_date"))
    h = horizon.skeleton(o.select("entity"), I.calendar(spark, sf).select("date"), "2001-08-02", 60)
    d = I.daily(spark, sf).select(F.concat(F.lit("E"), F.expr("substr(entity, 2)")).alias("entity"))
    return P.future_open(o, d, h).select("entity", "date", "opening_date", "graduate")


