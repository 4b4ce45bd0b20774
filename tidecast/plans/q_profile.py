"""Queries: calendar, entity profiles, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast import rules
from tidecast.functions.clean import norm_key
from tidecast.operators import calendar as C
from tidecast.operators import calibrate as K
from tidecast.operators import facts, horizon, profile
from tidecast.plans import inputs as I
from tidecast.plans.registry import cte, query, with_

TODAY = f"DATE '{I.AS_OF}'"


def rounded(df, *cols, n=4):
    return df.withColumns({c: F.round(c, n) for c in cols})


# -- calendar -----------------------------------------------------------------------------

_RULES = ", ".join(
    f"('{d}', '{t}', CAST({f} AS DOUBLE), {p}, CAST({pf} AS DOUBLE))" for d, (t, f, p, pf) in rules.SPECIAL_EVENTS.items()
)
cte("ev_rules", f"SELECT * FROM (VALUES {_RULES}) AS t(md, type, factor, pre_days, pre_factor)")
cte(
    "cal_typed",
    """SELECT *, CASE WHEN holiday_name IS NULL THEN NULL
  WHEN regexp_matches(lower(holiday_name), 'nguyên đán|giao thừa|mùng') THEN 'TET_NGUYEN_DAN'
  WHEN contains(lower(holiday_name), 'hùng vương') THEN 'HUNG_KINGS'
  WHEN regexp_matches(lower(holiday_name), 'chiến thắng|giải phóng') THEN 'LIBERATION_DAY'
  WHEN contains(lower(holiday_name), 'lao động') THEN 'LABOR_DAY'
  WHEN contains(lower(holiday_name), 'quốc khánh') THEN 'NATIONAL_DAY' ELSE 'TET_DUONG_LICH' END AS holiday_type FROM raw_cal""",
    ["raw_cal"],
)
cte(
    "cal_ev",
    """SELECT c.*, coalesce(a.type, 'PRE_' || b.type, 'PRE_' || d.type,
    CASE WHEN lunar_month = 8 AND lunar_day = 15 THEN 'MID_AUTUMN' END) AS event_type,
  coalesce(a.factor, b.pre_factor, d.pre_factor, CASE WHEN lunar_month = 8 AND lunar_day = 15 THEN 1.30 END, 1.0) AS event_impact,
  a.type AS event_on
  FROM cal_typed c LEFT JOIN ev_rules a ON a.md = strftime(c.date, '%m-%d')
  LEFT JOIN ev_rules b ON b.md = strftime(c.date + 1, '%m-%d') AND b.pre_days >= 1
  LEFT JOIN ev_rules d ON d.md = strftime(c.date + 2, '%m-%d') AND d.pre_days >= 2""",
    ["cal_typed", "ev_rules"],
)
cte(
    "cal_near",
    """SELECT c.date, CAST(min(h.date - c.date) FILTER (h.date > c.date AND h.date - c.date <= CASE WHEN h.holiday_type = 'TET_NGUYEN_DAN' THEN 14 ELSE 5 END) AS INTEGER) AS ahead,
  CAST(min(c.date - h.date) FILTER (h.date < c.date AND c.date - h.date <= CASE WHEN h.holiday_type = 'TET_NGUYEN_DAN' THEN 7 ELSE 5 END) AS INTEGER) AS behind
  FROM cal_typed c JOIN cal_typed h ON h.holiday_type IS NOT NULL AND h.date BETWEEN c.date - 7 AND c.date + 14 GROUP BY c.date""",
    ["cal_typed"],
)
cte(
    "cal_pos",
    """SELECT c.*, c.holiday_type IS NOT NULL AS is_holiday,
  c.holiday_type IS NULL AND n.ahead IS NOT NULL AS is_pre_holiday,
  c.holiday_type IS NULL AND n.ahead IS NULL AND n.behind IS NOT NULL AS is_post_holiday,
  CASE WHEN c.holiday_type IS NULL THEN coalesce(n.ahead, n.behind) END AS o,
  (SELECT t.holiday_type FROM cal_typed t WHERE t.date = c.date + CASE WHEN n.ahead IS NOT NULL THEN n.ahead ELSE -n.behind END) = 'TET_NGUYEN_DAN' AS tet
  FROM cal_ev c LEFT JOIN cal_near n USING (date)""",
    ["cal_ev", "cal_near"],
)
_HOL_FACTOR = "CASE holiday_type " + " ".join(
    f"WHEN '{k}' THEN CAST({v[0]} AS DOUBLE)" for k, v in rules.HOLIDAY_TYPES.items()
) + " END"
cte(
    "cal",
    f"""SELECT date, holiday_name, holiday_type, lunar_day, lunar_month, event_type, event_on, CAST(event_impact AS DOUBLE) AS event_impact,
  is_holiday, is_pre_holiday, is_post_holiday,
  CASE WHEN is_pre_holiday THEN CASE WHEN tet THEN 'PRE_TET' ELSE 'PRE_HOLIDAY' END
       WHEN is_post_holiday THEN CASE WHEN tet THEN 'POST_TET' ELSE 'POST_HOLIDAY' END END AS pre_post_type,
  CASE WHEN is_pre_holiday THEN -o WHEN is_post_holiday THEN o ELSE 0 END AS days_to_holiday,
  is_holiday OR coalesce((is_pre_holiday OR is_post_holiday) AND o <= 3, false) AS is_holiday_window,
  event_type IS NOT NULL AS is_special_event, coalesce(holiday_type = 'TET_NGUYEN_DAN', false) AS closed_likely,
  lunar_day IN (1, 15) AS is_veg,
  CAST(CASE WHEN is_holiday THEN {_HOL_FACTOR}
   WHEN is_pre_holiday AND tet THEN CASE WHEN o <= 3 THEN 1.25 - (o - 1) * 0.05 WHEN o <= 7 THEN 0.85 + (o - 4) * 0.033 ELSE 0.90 + (o - 8) * 0.01 END
   WHEN is_post_holiday AND tet THEN CASE WHEN o <= 2 THEN 0.50 + (o - 1) * 0.05 WHEN o <= 5 THEN 0.65 + (o - 3) * 0.075 ELSE 0.85 + (o - 6) * 0.05 END
   WHEN event_type IS NOT NULL THEN event_impact
   WHEN is_pre_holiday THEN CASE WHEN o <= 2 THEN 1.15 ELSE 1.0 + (5 - o) * 0.025 END
   WHEN is_post_holiday THEN CASE WHEN o <= 2 THEN 0.90 ELSE 0.90 + (o - 1) * 0.025 END ELSE 1.0 END AS DOUBLE) AS holiday_impact
  FROM cal_pos""",
    ["cal_pos"],
)


@query(
    "cal_classify_holiday",
    with_(
        """SELECT holiday_type, count(DISTINCT date) AS days, sum(guests) AS guests FROM day JOIN cal_typed USING (date)
        WHERE holiday_type IS NOT NULL GROUP BY holiday_type""",
        "day", "cal_typed",
    ),
)
def cal_classify_holiday(spark, sf):
    cal = C.classify(I.raw_calendar(spark, sf)).where("holiday_type is not null")
    return I.daily(spark, sf).join(F.broadcast(cal), "date").groupBy("holiday_type").agg(
        F.count_distinct("date").alias("days"), F.sum("guests").alias("guests")
    )


@query(
    "cal_events",
    with_(
        """SELECT event_type, round(event_impact, 4) AS event_impact, count(DISTINCT date) AS days, sum(guests) AS guests
        FROM day JOIN cal USING (date) WHERE event_type IS NOT NULL GROUP BY 1, 2""",
        "day", "cal",
    ),
)
def cal_events(spark, sf):
    cal = C.events(C.classify(I.raw_calendar(spark, sf))).where("event_type is not null")
    return I.daily(spark, sf).join(F.broadcast(cal), "date").groupBy(
        "event_type", F.round("event_impact", 4).alias("event_impact")
    ).agg(F.count_distinct("date").alias("days"), F.sum("guests").alias("guests"))


_CAL_OUT = """CAST(cal.date AS VARCHAR) AS date, holiday_type, event_type, is_holiday, is_pre_holiday, is_post_holiday, pre_post_type,
  CAST(days_to_holiday AS INTEGER) AS days_to_holiday, is_holiday_window, is_special_event, closed_likely, is_veg,
  CAST(lunar_day AS INTEGER) AS lunar_day, CAST(lunar_month AS INTEGER) AS lunar_month,
  round(event_impact, 4) AS event_impact, round(holiday_impact, 4) AS holiday_impact"""
CAL_COLS = [
    "date", "holiday_type", "event_type", "is_holiday", "is_pre_holiday", "is_post_holiday", "pre_post_type",
    "days_to_holiday", "is_holiday_window", "is_special_event", "closed_likely", "is_veg", "lunar_day", "lunar_month",
    "event_impact", "holiday_impact",
]
cte("by_day", "SELECT date, sum(guests) AS guests FROM txn GROUP BY date", ["txn"])


@query(
    "cal_day_info",
    with_(f"SELECT {_CAL_OUT}, guests FROM cal LEFT JOIN by_day USING (date)", "cal", "by_day"),
)
def cal_day_info(spark, sf):
    total = I.txn(spark, sf).groupBy("date").agg(F.sum("guests").alias("guests"))
    c = I.calendar(spark, sf).select(*CAL_COLS).join(total, "date", "left")
    return rounded(c, "event_impact", "holiday_impact")


@query(
    "jn_calendar",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, guests, is_holiday, pre_post_type, round(holiday_impact, 4) AS holiday_impact
        FROM day JOIN cal USING (date)""",
        "day", "cal",
    ),
)
def jn_calendar(spark, sf):
    cal = I.calendar(spark, sf).select("date", "is_holiday", "pre_post_type", "holiday_impact")
    return rounded(I.daily(spark, sf).join(F.broadcast(cal), "date"), "holiday_impact")


H_START, H_DAYS = "2001-01-05", 120
cte("entities", "SELECT DISTINCT entity FROM txn", ["txn"])
cte(
    "hz",
    f"""SELECT entity, cal.* FROM entities, cal WHERE date >= DATE '{H_START}' AND date < DATE '{H_START}' + {H_DAYS}""",
    ["entities", "cal"],
)


def entities(spark, sf):
    return I.txn(spark, sf).select("entity").distinct()


def hz(spark, sf, shifts=False):
    return horizon.skeleton(entities(spark, sf), I.calendar(spark, sf), H_START, H_DAYS, shifts)


@query(
    "cal_forecast_days",
    with_(
        """SELECT CAST(c.date AS VARCHAR) AS date, c.is_holiday, c.is_veg, round(c.holiday_impact, 4) AS holiday_impact,
        count(p.entity) AS entities, coalesce(sum(p.guests), 0.0) AS guests_last_year
        FROM cal c LEFT JOIN day p ON p.date = c.date - 364 WHERE c.date >= DATE '2001-08-02' AND c.date < DATE '2001-10-01' GROUP BY ALL""",
        "cal", "day",
    ),
)
def cal_forecast_days(spark, sf):
    c = C.forecast_days(I.calendar(spark, sf), "2001-08-02", 60)
    last = I.daily(spark, sf).groupBy(F.date_add("date", 364).alias("date")).agg(
        F.count("*").alias("entities"), F.sum("guests").alias("guests_last_year")
    )
    out = c.join(last, "date", "left").select("date", "is_holiday", "is_veg", "holiday_impact", "entities", "guests_last_year")
    return rounded(out.fillna(0, ["entities", "guests_last_year"]), "holiday_impact")


@query(
    "jn_horizon",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, unnest(['MORNING', 'EVENING']) AS shift, is_holiday,
        round(holiday_impact, 4) AS holiday_impact FROM hz""",
        "hz",
    ),
)
def jn_horizon(spark, sf):
    return rounded(hz(spark, sf, True).select("entity", "date", "shift", "is_holiday", "holiday_impact"), "holiday_impact")


@query(
    "cal_horizon_end",
    with_(
        """SELECT CAST(date AS VARCHAR) AS date, count(*) AS n,
        CAST(last_day(CAST(date + INTERVAL 3 MONTH AS DATE)) AS VARCHAR) AS horizon_end FROM txn GROUP BY txn.date""",
        "txn",
    ),
)
def cal_horizon_end(spark, sf):
    d = I.txn(spark, sf).groupBy("date").agg(F.count("*").alias("n"))
    return d.withColumn("horizon_end", C.horizon_end(F.col("date")))


cte(
    "per_dates",
    """SELECT year, date, holiday_type, CASE WHEN g = 'PAIR' THEN 'LIBERATION_DAY' ELSE holiday_type END AS period_type,
  min(date) OVER (PARTITION BY year, island) AS start, max(date) OVER (PARTITION BY year, island) AS fin FROM (
  SELECT *, sum(brk) OVER (PARTITION BY year ORDER BY date) AS island FROM (
  SELECT *, CASE WHEN lag(g) OVER w = g AND date - lag(date) OVER w <= 2 THEN 0 ELSE 1 END AS brk FROM (
    SELECT date, year(date) AS year, holiday_type, CASE WHEN holiday_type IN ('LIBERATION_DAY', 'LABOR_DAY') THEN 'PAIR' ELSE holiday_type END AS g
    FROM cal WHERE holiday_type IS NOT NULL) WINDOW w AS (PARTITION BY year ORDER BY date)))""",
    ["cal"],
)


@query(
    "set_group_holidays",
    with_(
        """SELECT period_type, CAST(p.year AS INTEGER) AS year, CAST(p.start AS VARCHAR) AS start, CAST(fin AS VARCHAR) AS "end",
        count(DISTINCT p.date) AS n_dates, CAST(fin - p.start + 1 AS INTEGER) AS duration, coalesce(sum(guests), 0.0) AS guests
        FROM per_dates p LEFT JOIN day d ON d.date = p.date GROUP BY 1, 2, p.start, fin""",
        "per_dates", "day",
    ),
)
def set_group_holidays(spark, sf):
    cal = I.calendar(spark, sf)
    got = I.daily(spark, sf).join(F.broadcast(C.periods(cal)), "date").groupBy("period_type", "year", "start").agg(
        F.sum("guests").alias("guests")
    )
    return C.group_holidays(cal).join(got, ["period_type", "year", "start"], "left").fillna(0.0, ["guests"])


cte(
    "offs",
    """SELECT period_type, year, start, fin, 'holiday' AS phase, 0 AS o, date FROM per_dates
  UNION ALL SELECT period_type, year, start, fin, 'pre', o, start - o FROM (SELECT DISTINCT period_type, year, start, fin FROM per_dates),
    (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS o) WHERE o <= CASE WHEN period_type = 'TET_NGUYEN_DAN' THEN 14 ELSE 5 END
  UNION ALL SELECT period_type, year, start, fin, 'post', o, fin + o FROM (SELECT DISTINCT period_type, year, start, fin FROM per_dates),
    (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS o) WHERE o <= CASE WHEN period_type = 'TET_NGUYEN_DAN' THEN 10 ELSE 5 END""",
    ["per_dates"],
)


@query(
    "jn_holiday_offset",
    with_(
        """SELECT period_type, CAST(o.year AS INTEGER) AS year, phase, o AS "offset", CAST(o.date AS VARCHAR) AS date, sum(guests) AS guests
        FROM offs o JOIN day d ON d.date = o.date GROUP BY ALL""",
        "offs", "day",
    ),
)
def jn_holiday_offset(spark, sf):
    off = C.holiday_offsets(I.calendar(spark, sf))
    return I.daily(spark, sf).join(F.broadcast(off), "date").groupBy("period_type", "year", "phase", "offset", "date").agg(
        F.sum("guests").alias("guests")
    )


cte(
    "ranges",
    """SELECT entity, date AS start, date + CAST(1 + hour % 9 AS INTEGER) AS fin FROM txn""",
    ["txn"],
)


@query(
    "set_merge_ranges",
    with_(
        """SELECT entity, CAST(min(start) AS VARCHAR) AS start, CAST(max(fin) AS VARCHAR) AS "end" FROM (
        SELECT *, sum(brk) OVER (PARTITION BY entity ORDER BY start, fin ROWS UNBOUNDED PRECEDING) AS i FROM (
          SELECT *, CASE WHEN start <= max(fin) OVER (PARTITION BY entity ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
            THEN 0 ELSE 1 END AS brk FROM ranges)) GROUP BY entity, i""",
        "ranges",
    ),
)
def set_merge_ranges(spark, sf):
    t = I.txn(spark, sf)
    per_day = t.groupBy("entity", F.col("date").alias("start")).agg(
        F.max(F.expr("date_add(date, 1 + hour % 9)")).alias("end")
    )
    return C.merge_ranges(per_day, ["entity"])


@query(
    "set_minus_codes",
    with_(
        """SELECT DISTINCT entity FROM day WHERE entity NOT IN (SELECT entity FROM day WHERE date >= DATE '2001-07-01')""",
        "day",
    ),
)
def set_minus_codes(spark, sf):
    d = I.daily(spark, sf)
    return d.select("entity").distinct().join(d.where("date >= date'2001-07-01'"), "entity", "left_anti")


# -- profiles -------------------------------------------------------------------------------

cte(
    "gaps",
    """SELECT *, CASE WHEN gap_days > 60 THEN 'LONG_CLOSURE' WHEN gap_days > 30 THEN 'RENOVATION' WHEN gap_days > 14 THEN 'EXTENDED_CLOSURE'
  ELSE 'TEMPORARY_CLOSURE' END AS reason FROM (SELECT entity, lag(date) OVER (PARTITION BY entity ORDER BY date) AS gap_start,
  date AS gap_end, CAST(date - lag(date) OVER (PARTITION BY entity ORDER BY date) AS INTEGER) AS gap_days FROM day) WHERE gap_days >= 7""",
    ["day"],
)


@query(
    "win_gap",
    with_("SELECT entity, CAST(gap_start AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end, gap_days, reason FROM gaps", "gaps"),
)
def win_gap(spark, sf):
    return profile.gaps(I.daily(spark, sf))


def _half(w):
    h = w // 2
    return f"""coalesce(avg(guests) FILTER (ago <= {w} AND ago > {h}), 0.0) AS a{w}, coalesce(avg(guests) FILTER (ago <= {h} AND ago >= 0), 0.0) AS b{w},
    count(*) FILTER (ago <= {w} AND ago > {h}) AS na{w}, count(*) FILTER (ago <= {h} AND ago >= 0) AS nb{w}"""


cte(
    "growth0",
    f"""SELECT entity, {_half(30)}, {_half(60)}, {_half(90)} FROM (
  SELECT *, greatest(max(date) OVER (PARTITION BY entity), {TODAY}) - date AS ago FROM day) GROUP BY entity""",
    ["day"],
)
_G = ", ".join(
    f"CASE WHEN a{w} > 0 THEN (b{w} - a{w}) / nullif(a{w}, 0) * 100 WHEN b{w} = 0 THEN 0.0 ELSE 100.0 END AS growth_{w}d" for w in (30, 60, 90)
)
cte(
    "growth",
    f"""SELECT *, CASE WHEN growth_30d > 10 THEN 'STRONG_GROWTH' WHEN growth_30d > 3 THEN 'MILD_GROWTH' WHEN growth_30d > -3 THEN 'STABLE'
  WHEN growth_30d > -10 THEN 'MILD_DECLINE' ELSE 'STRONG_DECLINE' END AS trend, least(greatest(growth_30d, -100), 100) AS trend_score
  FROM (SELECT *, {_G} FROM growth0)""",
    ["growth0"],
)
_GROWTH_OUT = ", ".join(
    f"""round(a{w}, 4) AS avg_first_{w}d, round(b{w}, 4) AS avg_second_{w}d, na{w} AS sample_first_{w}d, nb{w} AS sample_second_{w}d,
    round(growth_{w}d, 4) AS growth_{w}d""" for w in (30, 60, 90)
)


@query("win_growth", with_(f"SELECT entity, {_GROWTH_OUT}, trend, round(trend_score, 4) AS trend_score FROM growth", "growth"))
def win_growth(spark, sf):
    g = profile.growth(I.daily(spark, sf), I.AS_OF)
    return rounded(g, *[c for c in g.columns if c.startswith(("avg", "growth", "trend_score"))])


cte(
    "excl",
    f"""SELECT entity, active_days, span, coalesce(total_gaps, 0) AS total_gaps, coalesce(total_gap_days, 0) AS total_gap_days,
  coalesce(coalesce(total_gap_days, 0) / nullif(CAST(span AS DOUBLE), 0), 0.0) AS gap_ratio,
  CASE WHEN span <= 0 THEN 'SINGLE_DAY_DATA' WHEN coalesce(total_gap_days, 0) / CAST(span AS DOUBLE) > 0.5 THEN 'HIGH_GAP_RATIO'
   WHEN active_days < 7 THEN 'LOW_ACTIVE_DAYS' WHEN last_end >= {TODAY} - 3 THEN 'CURRENTLY_IN_GAP since ' || CAST(last_start AS VARCHAR)
   ELSE 'OK' END AS exclude_reason
  FROM (SELECT entity, count(*) AS active_days, max(date) - min(date) AS span FROM day GROUP BY entity)
  LEFT JOIN (SELECT entity, count(*) AS total_gaps, CAST(sum(gap_days) AS BIGINT) AS total_gap_days, max(gap_end) AS last_end,
    arg_max(gap_start, gap_end) AS last_start FROM gaps GROUP BY entity) USING (entity)""",
    ["day", "gaps"],
)
_EXCL_OUT = "entity, active_days, total_gaps, total_gap_days, round(gap_ratio, 6) AS gap_ratio, exclude_reason, exclude_reason <> 'OK' AS should_exclude"


@query("an_exclude", with_(f"SELECT {_EXCL_OUT} FROM excl", "excl"))
def an_exclude(spark, sf):
    return rounded(profile.exclude(I.daily(spark, sf), I.AS_OF), "gap_ratio", n=6)


cte(
    "tagged",
    """SELECT entity, date, guests, t AS outlier_type, CASE WHEN ok THEN lo END AS lower, CASE WHEN ok THEN hi END AS upper,
  CASE WHEN t IS NULL THEN 0 ELSE 1 END AS is_outlier_day, CASE t WHEN 'HIGH' THEN 0.7 WHEN 'LOW' THEN 0.4 ELSE 1.0 END AS outlier_weight
  FROM (SELECT *, CASE WHEN ok AND guests < lo THEN 'LOW' WHEN ok AND guests > hi THEN 'HIGH' END AS t FROM (
    SELECT d.*, n >= 4 AND q3 <> q1 AS ok, greatest(0.0, q1 - 2.5 * (q3 - q1)) AS lo, q3 + 2.5 * (q3 - q1) AS hi
    FROM day d JOIN (SELECT entity, isodow(date) AS wd, count(*) AS n, quantile_cont(guests, 0.25) AS q1, quantile_cont(guests, 0.75) AS q3
      FROM day GROUP BY 1, 2) q ON q.entity = d.entity AND q.wd = isodow(d.date)))""",
    ["day"],
)


@query(
    "win_outlier_iqr",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, guests, outlier_type, round(lower, 4) AS lower, round(upper, 4) AS upper,
        is_outlier_day, CAST(outlier_weight AS DOUBLE) AS outlier_weight FROM tagged""",
        "tagged",
    ),
)
def win_outlier_iqr(spark, sf):
    return rounded(profile.outliers(I.daily(spark, sf)), "lower", "upper")


cte(
    "shift_flag",
    f"""SELECT t.entity, t.date, {I.SHIFT_SQL} AS shift, sum(t.guests) AS guests, max(is_outlier_day) AS is_outlier_day,
  CAST(min(outlier_weight) AS DOUBLE) AS outlier_weight FROM txn t JOIN tagged g ON g.entity = t.entity AND g.date = t.date
  WHERE hour >= 8 GROUP BY 1, 2, 3""",
    ["txn", "tagged"],
)


def shift_flags(spark, sf):
    """Shift facts with the flags of their days."""
    return facts.tagged_shifts(I.txn(spark, sf), profile.outliers)


@query(
    "agg_shift",
    with_("SELECT entity, CAST(date AS VARCHAR) AS date, shift, guests, is_outlier_day, outlier_weight FROM shift_flag", "shift_flag"),
)
def agg_shift(spark, sf):
    return shift_flags(spark, sf)


_RECENT = "date >= DATE '2001-08-01' - 90"
cte(
    "day_norm",
    "SELECT d.*, isodow(d.date) >= 6 AS we, c.holiday_type IS NULL AND c.event_on IS NULL AS normal FROM day d LEFT JOIN cal c USING (date)",
    ["day", "cal"],
)
_F = f"normal AND {_RECENT}"
cte(
    "caps",
    f"""SELECT entity, max_daily, coalesce(mx, mxa, max_daily) AS max_daily_normal, coalesce(mn, mna, 0) AS min_daily_normal,
  coalesce(mxd, mx, mxa, max_daily) AS max_daily_normal_weekday, coalesce(mxe, mx, mxa, max_daily) AS max_daily_normal_weekend,
  coalesce(mnd, mn, mna, 0) AS min_daily_normal_weekday, coalesce(mne, mn, mna, 0) AS min_daily_normal_weekend
  FROM (SELECT entity, max(guests) AS max_daily, max(guests) FILTER ({_F}) AS mx, min(guests) FILTER ({_F}) AS mn,
   max(guests) FILTER (normal) AS mxa, min(guests) FILTER (normal) AS mna,
   max(guests) FILTER ({_F} AND NOT we) AS mxd, min(guests) FILTER ({_F} AND NOT we) AS mnd,
   max(guests) FILTER ({_F} AND we) AS mxe, min(guests) FILTER ({_F} AND we) AS mne FROM day_norm GROUP BY entity)""",
    ["day_norm"],
)


@query("an_smart_caps", with_("SELECT * FROM caps", "caps"))
def an_smart_caps(spark, sf):
    return profile.smart_caps(I.daily(spark, sf), I.calendar(spark, sf), I.AS_OF)


cte(
    "caps_type",
    """SELECT entity, special_type, max(guests) AS max_daily FROM (
  SELECT entity, guests, holiday_type AS special_type FROM day JOIN cal USING (date) WHERE holiday_type IS NOT NULL
  UNION ALL SELECT entity, guests, event_on FROM day JOIN cal USING (date) WHERE event_on IS NOT NULL) GROUP BY ALL""",
    ["day", "cal"],
)


@query("an_smart_caps_by_type", with_("SELECT * FROM caps_type", "caps_type"))
def an_smart_caps_by_type(spark, sf):
    return profile.caps_by_type(I.daily(spark, sf), I.calendar(spark, sf))


cte(
    "recent",
    """SELECT entity, m3 AS mean_3d, m7 AS mean_7d, CASE WHEN n >= 14 THEN m14 ELSE m7 END AS mean_14d,
  CASE WHEN n >= 7 THEN m3 / greatest(m7, 1.0) ELSE 1.0 END AS trend_short,
  CASE WHEN n >= 7 THEN m7 / greatest(CASE WHEN n >= 14 THEN m14 ELSE m7 END, 1.0) ELSE 1.0 END AS trend_medium
  FROM (SELECT entity, count(*) AS n, avg(guests) FILTER (rn <= 3) AS m3, avg(guests) FILTER (rn <= 7) AS m7, avg(guests) FILTER (rn <= 14) AS m14
    FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM day) GROUP BY entity)""",
    ["day"],
)
_RM = ["mean_3d", "mean_7d", "mean_14d", "trend_short", "trend_medium"]


@query("win_recent_mean", with_("SELECT entity, " + ", ".join(f"round({c}, 4) AS {c}" for c in _RM) + " FROM recent", "recent"))
def win_recent_mean(spark, sf):
    return rounded(profile.recent_means(I.daily(spark, sf)), *_RM)


cte(
    "klass",
    """SELECT *, CASE category WHEN 'NEW' THEN 'AI_ONLY' WHEN 'YOUNG' THEN 'AI_PRIMARY_ML_SECONDARY' ELSE
    CASE volume_segment WHEN 'LOW_VOLUME' THEN 'BASELINE_ONLY' WHEN 'MEDIUM_VOLUME' THEN 'ENSEMBLE_WEIGHTED' ELSE 'HIGH_VOLUME_ML' END END AS strategy,
  CASE WHEN category = 'NEW' THEN 'LOW' WHEN category = 'YOUNG' OR volume_segment = 'LOW_VOLUME' THEN 'MEDIUM'
    WHEN volume_segment = 'HIGH_VOLUME' THEN 'HIGH' WHEN category = 'VOLATILE' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM (
  SELECT *, CASE WHEN active_days < 7 THEN 'NEW' WHEN active_days < 45 THEN 'YOUNG' WHEN cv > 0.5 THEN 'VOLATILE' WHEN avg_daily > 200 THEN 'HIGH_VOLUME'
    ELSE 'STANDARD' END AS category, CASE WHEN avg_daily < 20 THEN 'LOW_VOLUME' WHEN avg_daily < 80 THEN 'MEDIUM_VOLUME' ELSE 'HIGH_VOLUME' END AS volume_segment
  FROM (SELECT entity, count(*) AS active_days, avg(guests) AS avg_daily, coalesce(stddev_samp(guests), 0) AS std_daily,
    min(guests) AS min_daily, median(guests) AS median_daily, coalesce(coalesce(stddev_samp(guests), 0) / nullif(avg(guests), 0), 999.0) AS cv
    FROM day GROUP BY entity))""",
    ["day"],
)
_KL = """active_days, round(avg_daily, 4) AS avg_daily, round(std_daily, 4) AS std_daily, min_daily, round(median_daily, 4) AS median_daily,
  round(cv, 4) AS cv, category, volume_segment, strategy, confidence"""


@query("an_classify", with_(f"SELECT entity, {_KL} FROM klass", "klass"))
def an_classify(spark, sf):
    return rounded(profile.classify(I.daily(spark, sf)), "avg_daily", "std_daily", "median_daily", "cv")


cte(
    "wd_stats",
    """SELECT entity, dayname(date) AS weekday, avg(guests) AS avg, coalesce(stddev_samp(guests), 0) AS std, min(guests) AS min,
  max(guests) AS max, count(*) AS count FROM day GROUP BY ALL""",
    ["day"],
)
cte(
    "wd_ratio",
    """SELECT entity, coalesce(coalesce(sum(avg) FILTER (weekday IN ('Saturday', 'Sunday')), 0) / 2 /
  nullif(coalesce(sum(avg) FILTER (weekday NOT IN ('Saturday', 'Sunday')), 0) / 5, 0), 1.0) AS weekend_weekday_ratio FROM wd_stats GROUP BY entity""",
    ["wd_stats"],
)


@query(
    "agg_weekday_stats",
    with_(
        """SELECT entity, weekday, round(avg, 4) AS avg, round(std, 4) AS std, min, max, count,
        round(weekend_weekday_ratio, 4) AS weekend_weekday_ratio FROM wd_stats JOIN wd_ratio USING (entity)""",
        "wd_stats", "wd_ratio",
    ),
)
def agg_weekday_stats(spark, sf):
    p = profile.weekday_patterns(I.daily(spark, sf))
    e = p.select("entity", "weekend_weekday_ratio", F.explode("weekday_patterns").alias("weekday", "s"))
    return rounded(e.select("entity", "weekday", "s.*", "weekend_weekday_ratio"), "avg", "std", "weekend_weekday_ratio")


REPORT_COLS = [
    "entity", "trend", "total_gaps", "total_gap_days", "should_exclude", "exclude_reason", "outlier_count", "category",
    "strategy", "confidence", "volume_segment", "active_days", "max_daily", "max_daily_normal_weekday",
    "max_daily_normal_weekend", "min_daily_normal_weekday", "min_daily_normal_weekend",
]
REPORT_ROUND = ["trend_score", "avg_daily", "cv", "trend_short", "trend_medium", "weekend_weekday_ratio"]
cte(
    "report",
    """SELECT * FROM growth JOIN (SELECT * EXCLUDE active_days FROM excl) USING (entity) JOIN (SELECT entity, CAST(sum(is_outlier_day) AS BIGINT) AS outlier_count FROM tagged
  GROUP BY entity) USING (entity) JOIN klass USING (entity) JOIN caps USING (entity) JOIN recent USING (entity) JOIN wd_ratio USING (entity)""",
    ["growth", "excl", "tagged", "klass", "caps", "recent", "wd_ratio"],
)


@query(
    "an_report",
    with_(
        "SELECT " + ", ".join("exclude_reason <> 'OK' AS should_exclude" if c == "should_exclude" else c for c in REPORT_COLS)
        + ", " + ", ".join(f"round({c}, 4) AS {c}" for c in REPORT_ROUND)
        + ", (SELECT max(max_daily) FROM caps_type t WHERE t.entity = report.entity AND special_type = 'TET_NGUYEN_DAN') AS max_tet FROM report",
        "report", "caps_type",
    ),
)
def an_report(spark, sf):
    r = profile.report(I.daily(spark, sf), I.calendar(spark, sf), I.AS_OF)
    tet = F.try_element_at("max_by_special", F.lit("TET_NGUYEN_DAN")).alias("max_tet")
    return rounded(r.select(*REPORT_COLS, *REPORT_ROUND, tet), *REPORT_ROUND)


@query(
    "an_chain_outlier",
    with_(
        """SELECT entity, round(avg_daily, 4) AS avg_daily, round(upper_bound, 4) AS upper_bound FROM (
        SELECT entity, avg_daily, CASE WHEN q3 = q1 THEN med * 10 ELSE q3 + 0.5 * (q3 - q1) END AS upper_bound, n FROM klass,
          (SELECT quantile_cont(avg_daily, 0.25) AS q1, median(avg_daily) AS med, quantile_cont(avg_daily, 0.75) AS q3, count(*) AS n FROM klass))
        WHERE n >= 5 AND avg_daily > upper_bound""",
        "klass",
    ),
)
def an_chain_outlier(spark, sf):
    return rounded(profile.chain_outliers(I.daily(spark, sf), mult=0.5), "avg_daily", "upper_bound")


@query(
    "an_batch_summary",
    with_(
        """SELECT 'category' AS section, category AS key, count(*) AS n FROM report GROUP BY 2
        UNION ALL SELECT 'strategy', strategy, count(*) FROM report GROUP BY 2
        UNION ALL SELECT 'excluded', regexp_replace(exclude_reason, ' since .*', ''), count(*) FROM report GROUP BY 2""",
        "report",
    ),
)
def an_batch_summary(spark, sf):
    d = I.daily(spark, sf)
    return profile.batch_summary(profile.classify(d).join(profile.exclude(d, I.AS_OF).drop("active_days"), "entity"))


# -- calibration --------------------------------------------------------------------------------

cte(
    "base",
    """SELECT period_type, year, start, entity, wd, base FROM (
  SELECT p.period_type, p.year, p.start, d.entity, isodow(d.date) AS wd, median(guests) AS base, count(*) AS n
  FROM day d JOIN cal c ON c.date = d.date AND c.holiday_type IS NULL
  JOIN (SELECT DISTINCT period_type, year, start, fin, CASE WHEN period_type = 'TET_NGUYEN_DAN' THEN 14 ELSE 5 END AS pre,
     CASE WHEN period_type = 'TET_NGUYEN_DAN' THEN 10 ELSE 5 END AS post FROM per_dates) p
   ON d.date BETWEEN p.start - 400 AND p.fin + 400 AND (d.date < p.start - p.pre OR d.date > p.fin + p.post)
  GROUP BY ALL) WHERE n >= 3 AND base >= 5""",
    ["day", "cal", "per_dates"],
)
_P = "period_type, CAST(year AS INTEGER) AS year, CAST(start AS VARCHAR) AS start"


@query("cal_baseline", with_(f"SELECT {_P}, entity, CAST(wd - 1 AS INTEGER) AS wd, base FROM base", "base"))
def cal_baseline(spark, sf):
    return K.baselines(I.daily(spark, sf), I.calendar(spark, sf)).drop("days")


cte(
    "ratios",
    f"""SELECT b.period_type, b.year, b.start, phase, o.o AS "offset", o.date, b.entity, coalesce(d.guests, 0.0) / b.base AS ratio
  FROM offs o JOIN base b ON b.period_type = o.period_type AND b.year = o.year AND b.start = o.start AND b.wd = isodow(o.date)
  LEFT JOIN day d ON d.entity = b.entity AND d.date = o.date
  WHERE o.date <= {TODAY} AND o.start <= {TODAY} AND o.date IN (SELECT date FROM day)""",
    ["offs", "base", "day"],
)


def _ratios(spark, sf):
    d, c = I.daily(spark, sf), I.calendar(spark, sf)
    return K.ratios(d, K.baselines(d, c), c, I.AS_OF)


@query(
    "cal_ratio",
    with_(f'SELECT {_P}, phase, "offset", CAST(date AS VARCHAR) AS date, entity, round(ratio, 4) AS ratio FROM ratios', "ratios"),
)
def cal_ratio(spark, sf):
    return rounded(_ratios(spark, sf), "ratio")


@query(
    "jn_missing_entities",
    with_(f'SELECT {_P}, phase, "offset", count(*) AS closed FROM ratios WHERE ratio = 0 GROUP BY ALL', "ratios"),
)
def jn_missing_entities(spark, sf):
    return _ratios(spark, sf).where("ratio = 0").groupBy("period_type", "year", "start", "phase", "offset").agg(
        F.count("*").alias("closed")
    )


cte(
    "rsum",
    """SELECT *, n_total - n_open AS n_closed, (n_total - n_open) / n_total * 100 AS pct_closed, coalesce(impact_open, impact_all) AS impact FROM (
  SELECT period_type, year, start, phase, "offset", avg(ratio) AS mean_all, stddev_pop(ratio) AS std, count(*) AS n_total,
   count(*) FILTER (ratio >= 0.1) AS n_open, quantile_cont(ratio, 0.25) AS p25, median(ratio) AS impact_all, quantile_cont(ratio, 0.75) AS p75,
   median(ratio) FILTER (ratio >= 0.1) AS impact_open FROM ratios GROUP BY ALL)""",
    ["ratios"],
)
_RS = ["mean_all", "std", "p25", "impact_all", "p75", "impact_open", "pct_closed", "impact"]


@query(
    "cal_ratio_summary",
    with_(f'SELECT {_P}, phase, "offset", n_total, n_open, n_closed, ' + ", ".join(f"round({c}, 4) AS {c}" for c in _RS) + " FROM rsum", "rsum"),
)
def cal_ratio_summary(spark, sf):
    return rounded(K.ratio_summary(_ratios(spark, sf)), *_RS)


cte(
    "hol_agg",
    """SELECT period_type AS holiday_type, phase, "offset", sum(impact * n_total) / sum(n_total) AS impact FROM rsum r
  WHERE NOT EXISTS (SELECT 1 FROM rsum x WHERE x.period_type = r.period_type AND x.year = r.year AND x.start = r.start
    AND x.phase = 'holiday' AND x.pct_closed >= 99 AND x.impact_open IS NULL) GROUP BY ALL""",
    ["rsum"],
)


@query("cal_holiday_agg", with_('SELECT holiday_type, phase, "offset", round(impact, 4) AS impact FROM hol_agg', "hol_agg"))
def cal_holiday_agg(spark, sf):
    return rounded(K.holiday_aggregate(K.ratio_summary(_ratios(spark, sf))), "impact")


cte(
    "hol_entity",
    """SELECT entity, period_type AS holiday_type, phase, "offset", arg_max(ratio, start) AS impact FROM ratios WHERE phase <> 'holiday' GROUP BY ALL""",
    ["ratios"],
)


@query(
    "cal_holiday_per_entity",
    with_(
        """SELECT e.entity, o.holiday_type, o.phase, o."offset", round(coalesce(x.impact, g.impact), 4) AS impact
        FROM entities e CROSS JOIN (SELECT DISTINCT period_type AS holiday_type, phase, o AS "offset" FROM offs) o
        LEFT JOIN hol_entity x USING (entity, holiday_type, phase, "offset") LEFT JOIN hol_agg g USING (holiday_type, phase, "offset")""",
        "entities", "offs", "hol_entity", "hol_agg",
    ),
)
def cal_holiday_per_entity(spark, sf):
    r = I.once(spark, sf, "holiday-ratios", lambda: _ratios(spark, sf))
    agg = K.holiday_aggregate(K.ratio_summary(r))
    slots = C.holiday_offsets(I.calendar(spark, sf)).select(
        F.col("period_type").alias("holiday_type"), "phase", "offset"
    ).distinct()
    packed = slots.agg(F.collect_list(F.struct("holiday_type", "phase", "offset"))).scalar()
    wanted = entities(spark, sf).select("entity", F.inline(packed))
    return rounded(K.impact_lookup(K.holiday_per_entity(r), agg, wanted), "impact")


@query(
    "cal_apply_holiday",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, round(h.holiday_impact, 4) AS holiday_impact_default,
        round(coalesce(g.impact, h.holiday_impact), 4) AS holiday_impact,
        CASE WHEN g.impact <> h.holiday_impact THEN 'calibrated' ELSE 'default' END AS holiday_impact_source
        FROM hz h LEFT JOIN hol_agg g ON g.holiday_type = CASE WHEN h.holiday_type = 'LABOR_DAY' THEN 'LIBERATION_DAY'
           WHEN is_holiday THEN h.holiday_type WHEN pre_post_type IN ('PRE_TET', 'POST_TET') THEN 'TET_NGUYEN_DAN' END
         AND g.phase = CASE WHEN is_holiday THEN 'holiday' WHEN is_pre_holiday THEN 'pre' WHEN is_post_holiday THEN 'post' END
         AND g."offset" = abs(days_to_holiday)""",
        "hz", "hol_agg",
    ),
)
def cal_apply_holiday(spark, sf):
    agg = K.holiday_aggregate(K.ratio_summary(_ratios(spark, sf)))
    cal = C.apply_impacts(I.calendar(spark, sf), agg)
    h = horizon.skeleton(entities(spark, sf), cal, H_START, H_DAYS)
    return rounded(
        h.select("entity", "date", "holiday_impact", "holiday_impact_default", "holiday_impact_source"),
        "holiday_impact", "holiday_impact_default",
    )


cte(
    "ev_imp",
    """SELECT d.entity, d.date, c.event_on AS event, d.guests, n.normal_avg, d.guests / n.normal_avg AS impact
  FROM day d JOIN cal c ON c.date = d.date AND c.event_on IS NOT NULL
  JOIN (SELECT entity, isodow(date) AS wd, avg(guests) AS normal_avg FROM day JOIN cal USING (date)
    WHERE event_on IS NULL AND coalesce(event_type, '') NOT LIKE 'PRE_%' GROUP BY 1, 2) n
   ON n.entity = d.entity AND n.wd = isodow(d.date) AND n.normal_avg > 0""",
    ["day", "cal"],
)
cte(
    "ev_agg",
    """SELECT *, CASE WHEN n >= 100 AND cv < 0.5 THEN 'HIGH' WHEN n >= 50 AND cv < 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM (
  SELECT event, count(*) AS n, avg(normal_avg) AS normal_avg, avg(guests) AS event_avg, quantile_cont(impact, 0.25) AS p25,
   median(impact) AS factor, quantile_cont(impact, 0.75) AS p75, stddev_pop(impact) / median(impact) AS cv FROM ev_imp GROUP BY event)
  WHERE n >= 10""",
    ["ev_imp"],
)
cte(
    "ev_ent",
    """SELECT entity, event, avg(impact) AS factor, count(*) AS n_years, arg_max(guests, date) AS latest_guests,
  CASE WHEN count(*) >= 3 THEN 'HIGH' WHEN count(*) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ev_imp GROUP BY ALL""",
    ["ev_imp"],
)
_EA = ["normal_avg", "event_avg", "p25", "factor", "p75", "cv"]


def _ev(spark, sf):
    return K.event_impacts(I.daily(spark, sf), I.calendar(spark, sf))


@query("cal_event", with_("SELECT event, n, confidence, " + ", ".join(f"round({c}, 4) AS {c}" for c in _EA) + " FROM ev_agg", "ev_agg"))
def cal_event(spark, sf):
    return rounded(K.event_aggregate(_ev(spark, sf)), *_EA)


@query(
    "cal_event_per_entity",
    with_("SELECT entity, event, round(factor, 4) AS factor, n_years, latest_guests, confidence FROM ev_ent", "ev_ent"),
)
def cal_event_per_entity(spark, sf):
    return rounded(K.event_per_entity(_ev(spark, sf)), "factor")


_MAIN = "CASE e.ev " + " ".join(f"WHEN '{t}' THEN CAST({f} AS DOUBLE)" for t, f in {v[0]: v[1] for v in reversed(rules.SPECIAL_EVENTS.values())}.items()) + " END"
_PRE = "CASE e.ev " + " ".join(f"WHEN '{v[0]}' THEN CAST({v[3]} AS DOUBLE)" for v in rules.SPECIAL_EVENTS.values() if v[0] != "CHRISTMAS") + " ELSE 1.0 END"


@query(
    "cal_apply_event",
    with_(
        f"""SELECT e.entity, CAST(e.date AS VARCHAR) AS date, e.event_type, CASE WHEN x.factor IS NOT NULL THEN 'per_entity' WHEN g.factor IS NOT NULL
          THEN 'aggregate' ELSE 'default' END AS holiday_impact_source,
        round(CASE WHEN coalesce(x.factor, g.factor) IS NULL THEN e.holiday_impact WHEN e.event_type LIKE 'PRE_%'
          THEN 1.0 + ({_PRE} - 1.0) * coalesce(x.factor, g.factor) / ({_MAIN}) ELSE coalesce(x.factor, g.factor) END, 4) AS holiday_impact
        FROM (SELECT *, replace(event_type, 'PRE_', '') AS ev FROM hz) e LEFT JOIN ev_ent x ON x.entity = e.entity AND x.event = e.ev
        LEFT JOIN ev_agg g ON g.event = e.ev""",
        "hz", "ev_ent", "ev_agg",
    ),
)
def cal_apply_event(spark, sf):
    imp = _ev(spark, sf)
    h = hz(spark, sf).select("entity", "date", "event_type", "holiday_impact")
    return rounded(K.apply_events(h, K.event_per_entity(imp), K.event_aggregate(imp)), "holiday_impact")


cte("near_rows", "SELECT DISTINCT p.period_type, p.year, p.start, d.entity FROM day d JOIN (SELECT DISTINCT period_type, year, start, fin FROM per_dates) p ON (d.date BETWEEN p.start - 7 AND p.start - 1) OR (d.date BETWEEN p.fin + 1 AND p.fin + 7)", ["day", "per_dates"])
cte("in_rows", "SELECT p.period_type, p.year, p.start, d.entity, avg(guests) AS hol_avg FROM day d JOIN per_dates p ON p.date = d.date GROUP BY ALL", ["day", "per_dates"])
cte(
    "no_data",
    """SELECT * FROM near_rows n WHERE NOT EXISTS (SELECT 1 FROM in_rows i WHERE i.entity = n.entity AND i.period_type = n.period_type AND i.start = n.start)
  AND EXISTS (SELECT 1 FROM in_rows i WHERE i.period_type = n.period_type AND i.start = n.start)""",
    ["near_rows", "in_rows"],
)


@query("jn_closed_no_data", with_(f"SELECT {_P}, entity FROM no_data", "no_data"))
def jn_closed_no_data(spark, sf):
    return K.closed_no_data(I.daily(spark, sf), I.calendar(spark, sf))


cte(
    "closures",
    """SELECT DISTINCT period_type AS holiday_type, entity FROM (SELECT period_type, entity FROM no_data UNION ALL
  SELECT i.period_type, i.entity FROM in_rows i JOIN (SELECT entity, avg(guests) AS norm FROM day_norm WHERE date NOT IN
    (SELECT date FROM per_dates) GROUP BY entity) n USING (entity) WHERE norm > 0 AND (hol_avg / norm <= 0.1 OR hol_avg <= 1))""",
    ["no_data", "in_rows", "day_norm", "per_dates"],
)


@query("cal_closures", with_("SELECT * FROM closures", "closures"))
def cal_closures(spark, sf):
    return K.closures(I.daily(spark, sf), I.calendar(spark, sf))


CH_START, CH_DAYS = "2001-08-02", 60


def closed_dates(spark, sf):
    """Closed horizon days: store list, schedule, earlier closures and closure rates."""
    d, cal = I.daily(spark, sf), I.calendar(spark, sf)
    h = horizon.skeleton(entities(spark, sf), cal, CH_START, CH_DAYS)
    last = d.groupBy("entity").agg(F.max("date").alias("last"))
    gone = last.where("last < date'2001-07-20'").select("entity", F.lit("2001-09-20").cast("date").alias("future_close_date"))
    sched = schedule_by_entity(spark, sf)
    r = K.ratios(d, K.baselines(d, cal), cal, I.AS_OF)
    return K.closed_dates(h, gone, sched, K.closures(d, cal), K.closure_rates(r))


def schedule_by_entity(spark, sf):
    """Schedule of each entity: the strictest status of its stores."""
    from tidecast.plans.q_sources import schedule

    return schedule(spark, sf).groupBy("entity", "date").agg(F.min("status").alias("status"))


cte(
    "closed_dates",
    """SELECT entity, date, state, reason FROM (SELECT h.entity, h.date,
   CASE WHEN h.date >= gone OR s.status = 'CLOSED' THEN 'CLOSED' WHEN s.status = 'HALF_DAY' THEN 'HALF_DAY'
     WHEN c.entity IS NOT NULL OR r.closure_rate > 0.8 THEN 'CLOSED' END AS state,
   CASE WHEN h.date >= gone THEN 'future_close' WHEN s.status IS NOT NULL THEN 'schedule' WHEN c.entity IS NOT NULL THEN 'pattern'
     WHEN r.closure_rate > 0.8 THEN 'rate' END AS reason
  FROM (SELECT entity, cal.date, holiday_type FROM entities, cal WHERE cal.date >= DATE '2001-08-02' AND cal.date < DATE '2001-10-01') h
  LEFT JOIN (SELECT entity, DATE '2001-09-20' AS gone FROM day GROUP BY entity HAVING max(date) < DATE '2001-07-20') USING (entity)
  LEFT JOIN (SELECT entity, date, min(status) AS status FROM schedule GROUP BY ALL) s ON s.entity = h.entity AND s.date = CAST(h.date AS VARCHAR)
  LEFT JOIN closures c ON c.entity = h.entity AND c.holiday_type = h.holiday_type
  LEFT JOIN (SELECT entity, period_type, avg(CASE WHEN ratio < 0.1 THEN 1.0 ELSE 0.0 END) AS closure_rate FROM ratios WHERE phase = 'holiday'
    GROUP BY ALL) r ON r.entity = h.entity AND r.period_type = h.holiday_type) WHERE state IS NOT NULL""",
    ["entities", "cal", "day", "schedule", "closures", "ratios"],
)


@query("cal_closed_dates", with_("SELECT entity, CAST(date AS VARCHAR) AS date, state, reason FROM closed_dates", "closed_dates"))
def cal_closed_dates(spark, sf):
    return closed_dates(spark, sf)


cte(
    "win_days",
    """SELECT DISTINCT entity, CAST(unnest(generate_series(s, e - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM (
  SELECT entity, CAST(gap_end AS TIMESTAMP) AS s, gap_end + INTERVAL 5 DAY AS e FROM gaps WHERE gap_days > 30)""",
    ["gaps"],
)


@query(
    "jn_window_exclude",
    with_("SELECT entity, transaction_id, guests FROM txn WHERE (entity, date) NOT IN (SELECT (entity, date) FROM win_days)", "txn", "win_days"),
)
def jn_window_exclude(spark, sf):
    t = I.txn(spark, sf)
    g = profile.gaps(facts.daily(t)).where("gap_days > 30")
    windows = g.select("entity", F.col("gap_end").alias("from_date"), F.date_add("gap_end", 5).alias("to_date"))
    return horizon.exclude_windows(t, windows).select("entity", "transaction_id", "guests")


@query(
    "jn_entity_info",
    with_(
        """SELECT d.entity, CAST(d.date AS VARCHAR) AS date, d.guests, m.sap_code, m.restaurant_name FROM day d LEFT JOIN dim m ON m.merge_key = d.entity""",
        "day", "dim",
    ),
)
def jn_entity_info(spark, sf):
    dim = I.entity_dim(spark, sf)
    d = I.daily(spark, sf)
    return d.join(dim, norm_key(d["entity"]) == dim["merge_key"], "left").drop("merge_key")
