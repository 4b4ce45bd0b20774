"""Queries: macro analysis, texts, knowledge documents, example pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import calibrate as K
from tidecast.operators import knowledge as B
from tidecast.operators import learn as N
from tidecast.operators import macro as C
from tidecast.operators import profile
from tidecast.operators import text as T
from tidecast.plans import inputs as I
from tidecast.plans.q_learn import keys2, rows, state
from tidecast.plans.q_ledger import ledger
from tidecast.plans.q_profile import _ratios, rounded
from tidecast.plans.q_sources import month_dedup
from tidecast.plans.registry import cte, query, with_
from tidecast.session import fresh_path

# -- macro ------------------------------------------------------------------------------


def macro(spark, sf):
    """Stand-in indicators per shipping month; the last one is constant."""
    li = I.table(spark, sf, "lineitem")
    return li.groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(
        F.round(F.avg("l_extendedprice") / 1000, 3).alias("gold"), F.round(F.avg("l_discount") * 1000, 3).alias("gas"),
        F.round(F.avg("l_tax") * 100, 3).alias("deposit_rate"), F.lit(5.0).alias("lending_rate"),
    )


cte(
    "joined",
    """SELECT m.*, gold, gas, deposit_rate, 5.0::DOUBLE AS lending_rate FROM month_dedup m JOIN (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
  round(avg(l_extendedprice) / 1000, 3) AS gold, round(avg(l_discount) * 1000, 3) AS gas, round(avg(l_tax) * 100, 3) AS deposit_rate FROM lineitem GROUP BY 1, 2) x USING (year, month)""",
    ["month_dedup"],
)


def joined(spark, sf):
    return I.once(spark, sf, "month-macro", lambda: C.join_macro(month_dedup(spark, sf), macro(spark, sf)))


@query("jn_macro", with_("SELECT year, month, guests, round(revenue, 2) AS revenue, gold, gas, deposit_rate, lending_rate FROM joined", "joined"))
def jn_macro(spark, sf):
    return rounded(joined(spark, sf).select("year", "month", "guests", "revenue", "gold", "gas", "deposit_rate", "lending_rate"), "revenue", n=2)


_CORR = " UNION ALL ".join(
    f"SELECT '{t}' AS target, '{f}' AS factor, count(*) AS n, " + ("0.0::DOUBLE" if f == "lending_rate" else f"corr({t}, {f})") + " AS r FROM joined"
    for t in ("guests", "revenue") for f in C.FACTORS
)


@query(
    "agg_corr",
    with_(
        f"""SELECT target, factor, n, round(r, 4) AS r, CASE WHEN factor = 'lending_rate' THEN 'N/A' WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'medium' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'negligible' END AS strength,
        CASE WHEN factor = 'lending_rate' THEN 'N/A' WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({_CORR})""",
        "joined",
    ),
)
def agg_corr(spark, sf):
    return rounded(C.correlations(joined(spark, sf)), "r")


PERIODS = [("rise", 1996, 2, 1997, 5), ("flat", 1997, 6, 1999, 6), ("fall", 1999, 6, 2001, 6)]
_PV = ", ".join(f"('{n}', {a * 12 + b - 1}, {c * 12 + d - 1})" for n, a, b, c, d in PERIODS)
_RP = ["rate_start", "rate_end", "rate_change", "avg_guests", "guests_change_pct", "avg_revenue", "revenue_change_pct"]


@query(
    "mc_rate_periods",
    with_(
        f"""SELECT name, round(arg_min(deposit_rate, ym), 4) AS rate_start, round(arg_max(deposit_rate, ym), 4) AS rate_end, round(arg_max(deposit_rate, ym) - arg_min(deposit_rate, ym), 4) AS rate_change, round(avg(guests), 4) AS avg_guests,
        round((arg_max(guests, ym) / arg_min(guests, ym) - 1) * 100, 4) AS guests_change_pct, round(avg(revenue), 2) AS avg_revenue, round((arg_max(revenue, ym) / arg_min(revenue, ym) - 1) * 100, 4) AS revenue_change_pct
        FROM (SELECT *, year * 12 + month - 1 AS ym FROM joined) j JOIN (VALUES {_PV}) p(name, a, b) ON ym BETWEEN a AND b GROUP BY name""",
        "joined",
    ),
)
def mc_rate_periods(spark, sf):
    p = spark.createDataFrame(PERIODS, "name string, from_year int, from_month int, to_year int, to_month int")
    r = C.rate_periods(joined(spark, sf), p)
    return rounded(rounded(r, *[c for c in _RP if c != "avg_revenue"]), "avg_revenue", n=2)


cte(
    "moves",
    """SELECT *, deposit_rate - lag(deposit_rate) OVER w AS rate_move, (guests - lag(guests) OVER w) / lag(guests) OVER w * 100 AS guests_mom, (revenue - lag(revenue) OVER w) / lag(revenue) OVER w * 100 AS revenue_mom
  FROM joined WINDOW w AS (ORDER BY year, month)""",
    ["joined"],
)


@query(
    "mc_rate_direction",
    with_(
        """SELECT direction, count(*) AS months, round(avg(guests_mom), 4) AS guests_mom, round(avg(revenue_mom), 4) AS revenue_mom,
        round(avg(CASE WHEN direction = 'up' THEN CASE WHEN guests_mom < 0 THEN 1.0 ELSE 0.0 END WHEN direction = 'down' THEN CASE WHEN guests_mom > 0 THEN 1.0 ELSE 0.0 END END) * 100, 4) AS opposite_pct
        FROM (SELECT *, CASE WHEN rate_move > 0.05 THEN 'up' WHEN rate_move < -0.05 THEN 'down' ELSE 'stable' END AS direction FROM moves WHERE rate_move IS NOT NULL) GROUP BY direction""",
        "moves",
    ),
)
def mc_rate_direction(spark, sf):
    return rounded(C.rate_direction(joined(spark, sf)), "guests_mom", "revenue_mom", "opposite_pct")


@query(
    "mc_month_comment",
    with_(
        """SELECT year, month, round(rate_move, 4) AS rate_move, round(guests_mom, 4) AS guests_mom, coalesce(CASE WHEN abs(rate_move) > 0.2 THEN CASE WHEN rate_move > 0 AND guests_mom < 0 THEN 'rate up, guests down' WHEN rate_move > 0 AND guests_mom >= 0 THEN 'rate up, guests up'
        WHEN rate_move < 0 AND guests_mom > 0 THEN 'rate down, guests up' WHEN rate_move < 0 AND guests_mom < 0 THEN 'rate down, guests down' END END, '') AS comment FROM moves""",
        "moves",
    ),
)
def mc_month_comment(spark, sf):
    return rounded(C.month_comment(joined(spark, sf)).select("year", "month", "rate_move", "guests_mom", "comment"), "rate_move", "guests_mom")


_TR = " UNION ALL ".join(
    f"SELECT '{c}' AS series, round(arg_min({c}, (year, month)), 2) AS first, round(arg_max({c}, (year, month)), 2) AS last, round((arg_max({c}, (year, month)) / arg_min({c}, (year, month)) - 1) * 100, 4) AS change_pct FROM joined"
    for c in [*C.FACTORS, "guests", "revenue"]
)


@query("mc_trend", with_(_TR, "joined"))
def mc_trend(spark, sf):
    return rounded(rounded(C.trend(joined(spark, sf)), "first", "last", n=2), "change_pct")


# -- texts ----------------------------------------------------------------------------------


@query(
    "tx_history",
    with_(
        """SELECT entity, string_agg('- ' || CAST(date AS VARCHAR) || ' (' || dayname(date) || '): ' || CAST(CAST(guests AS INTEGER) AS VARCHAR) || CASE WHEN is_holiday THEN ' HOLIDAY' ELSE '' END, chr(10) ORDER BY date) AS text
        FROM (SELECT d.*, c.is_holiday, row_number() OVER (PARTITION BY entity ORDER BY d.date DESC) AS rn FROM day d LEFT JOIN cal c ON c.date = d.date) WHERE rn <= 21 GROUP BY entity""",
        "day", "cal",
    ),
)
def tx_history(spark, sf):
    return T.history(I.daily(spark, sf), I.calendar(spark, sf))


_SPAN = " UNION ALL ".join(
    f"SELECT entity, '{n}' AS span, isodow(date) AS o, dayname(date) AS weekday, avg(guests) AS mean FROM day WHERE date >= DATE '2001-08-01' - {d} AND date < DATE '2001-08-01' GROUP BY ALL"
    for n, d in (("mean_30d", 30), ("mean_60d", 60), ("mean_90d", 90))
)


@query(
    "tx_prompt",
    with_(
        f"""SELECT k.entity, concat_ws(chr(10), 'PROFILE', concat_ws(', ', k.category, k.strategy, g.trend, 'active days ' || CAST(k.active_days AS VARCHAR)), 'WEEKDAY MEANS', w.t, 'LAST 7 DAYS', l.t) AS text
        FROM klass k JOIN growth g ON g.entity = k.entity JOIN (SELECT entity, string_agg(CAST(date AS VARCHAR) || ': ' || CAST(CAST(guests AS INTEGER) AS VARCHAR), chr(10) ORDER BY date) AS t FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM day) WHERE rn <= 7 GROUP BY entity) l ON l.entity = k.entity
        LEFT JOIN (SELECT entity, string_agg(span || ' ' || weekday || ': ~' || CAST(CAST(floor(mean) AS BIGINT) AS VARCHAR), chr(10) ORDER BY span, o) AS t FROM ({_SPAN}) WHERE mean <> 0 GROUP BY entity) w ON w.entity = k.entity""",
        "klass", "growth", "day",
    ),
)
def tx_prompt(spark, sf):
    d = I.daily(spark, sf)
    p = profile.classify(d).join(profile.growth(d, I.AS_OF).select("entity", "trend"), "entity")
    return T.prompt(d, p, I.AS_OF)


_INT = "CAST(CAST(round_even(abs({0}), 0) AS INTEGER) AS VARCHAR)"


@query(
    "tx_state_context",
    with_(
        f"""SELECT s.entity, concat_ws(chr(10), CASE WHEN abs(overall_bias) >= 2 THEN 'forecasts are ' || CASE WHEN overall_bias > 0 THEN 'high' ELSE 'low' END || ' by ' || {_INT.format('overall_bias')} END, 'weekdays: ' || w.t,
        CASE WHEN abs(h.v) >= 3 THEN 'holidays are ' || CASE WHEN h.v > 0 THEN 'high' ELSE 'low' END || ' by ' || {_INT.format('h.v')} END,
        CASE WHEN last_mape > 0 THEN 'accuracy is ' || CASE WHEN last_mape < 15 THEN 'good' WHEN last_mape < 30 THEN 'moderate' ELSE 'poor' END END,
        CASE WHEN abs(correction_factor - 1) >= 0.05 THEN 'scale forecasts ' || CASE WHEN correction_factor > 1 THEN 'up' ELSE 'down' END END) AS text FROM state s
        LEFT JOIN (SELECT entity, string_agg(key || ': ' || CASE WHEN value > 0 THEN 'reduce' ELSE 'increase' END || ' by ' || {_INT.format('value')}, '; ' ORDER BY rn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(value) DESC, key) AS rn
          FROM keys2 WHERE scope = 'weekday' AND abs(value) >= 3) WHERE rn <= 4 GROUP BY entity) w ON w.entity = s.entity
        LEFT JOIN (SELECT entity, max(value) AS v FROM keys2 WHERE scope = 'holiday' GROUP BY entity) h ON h.entity = s.entity""",
        "state", "keys2",
    ),
)
def tx_state_context(spark, sf):
    return T.state_context(state(spark, sf), keys2(spark, sf))


_PC = "CAST(CAST(round_even(({0} - 1) * 100, 0) AS INTEGER) AS VARCHAR)"


@query(
    "tx_holiday_guide",
    with_(
        f"""SELECT string_agg(l, chr(10) ORDER BY l) AS text FROM (SELECT '- ' || holiday_type || ' ' || phase || ': ' || {_PC.format('min(impact)')} || '% to ' || {_PC.format('max(impact)')} || '% (' || CAST(count(*) AS VARCHAR) || ' days)' AS l FROM hol_agg GROUP BY holiday_type, phase)""",
        "hol_agg",
    ),
)
def tx_holiday_guide(spark, sf):
    return T.holiday_guide(K.holiday_aggregate(K.ratio_summary(_ratios(spark, sf))))


def answers(spark, sf):
    """Conversation texts with a model answer inside: an array, single objects or none."""
    c = I.table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    n = F.length("text").cast("string")
    plain = F.regexp_replace("text", r"[\[\]{}]", " ")
    a = F.concat(plain, F.lit(' ok [{"date": "2001-08-02", "forecast": '), n, F.lit('}, {"date": "2001-08-03", "forecast": 5}] bye '), plain)
    b = F.concat(plain, F.lit(' first {"date": "2001-08-02", "forecast": '), n, F.lit('} and {"note": "none"} '), plain)
    k = (F.col("conv_id") + F.col("turn")) % 3
    return c.select("id", F.when(k == 0, a).when(k == 1, b).otherwise(plain).alias("answer"), F.length("text").alias("len"))


cte("ans", "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, (conv_id + turn) % 3 AS k, length(text)::DOUBLE AS n FROM conversations")
cte("parsed", "SELECT id, '2001-08-02' AS date, n AS forecast FROM ans WHERE k < 2 UNION ALL SELECT id, '2001-08-03', 5.0 FROM ans WHERE k = 0", ["ans"])


@query("tx_parse", with_("SELECT id, date, forecast FROM parsed", "parsed"))
def tx_parse(spark, sf):
    return T.parse_answer(answers(spark, sf).select("id", "answer"), "answer").drop("answer")


# -- knowledge ----------------------------------------------------------------------------------


def _flat(df):
    return df.select("id", "text", F.try_element_at("metadata", F.lit("type")).alias("type"), F.try_element_at("metadata", F.lit("restaurant")).alias("restaurant"))


def _id(*p):
    return "substr(md5(concat_ws('|', " + ", ".join(p) + ")), 1, 16)"


_SG = "CASE WHEN round_even({0}, 0) >= 0 THEN '+' ELSE '' END || CAST(CAST(round_even({0}, 0) AS INTEGER) AS VARCHAR)"


@query(
    "kb_docs_state",
    with_(
        f"""SELECT {_id("'bias'", 'entity')} AS id, 'Entity ' || entity || ': bias ' || {_SG.format('overall_bias')} || ' guests, strategy ' || coalesce(best_strategy, 'ENSEMBLE_EQUAL') AS text, 'restaurant_bias' AS type, entity AS restaurant FROM state
        UNION ALL SELECT {_id("'issue'", 'entity', 'CAST(date AS VARCHAR)', 'type')}, 'Entity ' || entity || ' on ' || CAST(date AS VARCHAR) || ': ' || type, 'issue', entity FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC, type) AS rn FROM i2) WHERE rn <= 10""",
        "state", "i2",
    ),
)
def kb_docs_state(spark, sf):
    return _flat(B.docs_state(state(spark, sf), N.issues(rows(spark, sf, 2), I.AS_OF)))


cte("fbd", "SELECT entity, date, sum(pred) AS pred, sum(actual) AS actual, abs(sum(pred) - sum(actual)) AS abs_error FROM ledger WHERE pred IS NOT NULL AND actual >= 0 GROUP BY ALL", ["ledger"])


def _fb(src):
    return f"""SELECT {_id("'fb'", 'entity', 'CAST(date AS VARCHAR)')} AS id, 'Entity ' || entity || ' ' || CAST(date AS VARCHAR) || ' ' || dayname(date) || ': forecast ' || CAST(CAST(round_even(pred, 0) AS INTEGER) AS VARCHAR) || ', actual ' || CAST(CAST(round_even(actual, 0) AS INTEGER) AS VARCHAR)
    || ', ' || CASE WHEN abs(pred - actual) <= actual * 0.1 THEN 'accurate' WHEN pred > actual THEN 'too high' ELSE 'too low' END AS text, 'feedback' AS type, entity AS restaurant FROM {src}"""


@query("kb_docs_feedback", with_(_fb("fbd"), "fbd"))
def kb_docs_feedback(spark, sf):
    return _flat(B.docs_feedback(B.feedback_days(ledger(spark, sf))))


@query("top_feedback", with_("SELECT entity, CAST(date AS VARCHAR) AS date, pred, actual, abs_error FROM fbd ORDER BY abs_error DESC, entity, fbd.date LIMIT 2000", "fbd"))
def top_feedback(spark, sf):
    return B.top_feedback(B.feedback_days(ledger(spark, sf)), 2000)


_R0 = "CAST(CAST(round_even({0}, 0) AS INTEGER) AS VARCHAR)"


@query(
    "kb_docs_pattern",
    with_(
        f"""SELECT {_id("'wd'", 'entity', 'weekday')} AS id, 'Entity ' || entity || ' on ' || weekday || ': mean ' || {_R0.format('avg')} || ', from ' || {_R0.format('min')} || ' to ' || {_R0.format('max')} AS text, 'pattern' AS type, entity AS restaurant FROM wd_stats""",
        "wd_stats",
    ),
)
def kb_docs_pattern(spark, sf):
    return _flat(B.docs_pattern(profile.weekday_stats(I.daily(spark, sf))))


cte("lrn", "SELECT entity, date, arg_min(ai_raw, shift) AS pred, sum(actual) AS actual FROM ledger WHERE ai_raw IS NOT NULL AND actual >= 0 AND date >= DATE '2001-08-01' - 14 GROUP BY ALL", ["ledger"])


@query(
    "kb_learn",
    with_(f"SELECT * FROM ({_fb('lrn')}) UNION ALL SELECT * FROM ({_fb('fbd')}) WHERE id NOT IN (SELECT id FROM ({_fb('lrn')}))", "lrn", "fbd"),
)
def kb_learn(spark, sf):
    old = B.docs_feedback(B.feedback_days(ledger(spark, sf)))
    return _flat(B.upsert(old, B.learn(ledger(spark, sf), I.AS_OF)))


_NEAREST = """WITH m AS (SELECT label, list(x ORDER BY pos) AS vector FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings) GROUP BY ALL) GROUP BY label)
    SELECT label AS query, vec_id AS id, CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY s DESC, vec_id) AS rank, s AS score FROM (
      SELECT e.label, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], m.vector) AS s FROM embeddings e JOIN m ON m.label = e.label) e) WHERE rank <= 5"""


@query("kb_retrieve", _NEAREST)
def kb_retrieve(spark, sf):
    d = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return rounded(B.retrieve(d, B.mean_vectors(d), 5), "score", n=5)


def _indexed(spark, sf):
    d = I.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    centres = B.cell_centres(d, I.CELLS)
    return B.build_index(d, centres, fresh_path(spark, "cells")), B.mean_vectors(d), centres


@query("kb_retrieve_cells", _NEAREST)
def kb_retrieve_cells(spark, sf):
    """The exact mode of the index: all cells probed."""
    index, queries, centres = _indexed(spark, sf)
    return rounded(B.probe(index, queries, 5, centres), "score", n=5)


@query("kb_retrieve_near")
def kb_retrieve_near(spark, sf):
    """The nearest cells of each query only; its recall is measured in the tests."""
    index, queries, centres = _indexed(spark, sf)
    return rounded(B.probe(index, queries, 5, centres, I.PROBED), "score", n=5)


# -- example pairs ---------------------------------------------------------------------------------


def examples(spark, sf):
    return T.pairs(I.daily(spark, sf), I.calendar(spark, sf), state=state(spark, sf))


cte(
    "pairs_ds",
    """SELECT entity, history_end, forecast_start, forecast_end, target_total, targets, ds, gs FROM (SELECT entity, list(date) OVER w AS ds, list(guests) OVER w AS gs, row_number() OVER (PARTITION BY entity ORDER BY date) AS rn, count(*) OVER (PARTITION BY entity) AS n, len(list(date) OVER w) AS k,
   (list(date) OVER w)[14] AS history_end, (list(date) OVER w)[15] AS forecast_start, (list(date) OVER w)[21] AS forecast_end, CAST(list_sum((list(guests) OVER w)[15:21]) AS BIGINT) AS target_total,
   list_zip((list(date) OVER w)[15:21], (list(guests) OVER w)[15:21]) AS targets
  FROM day WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)) WHERE (SELECT count(*) FROM day) >= 100 AND (rn - 1) % 3 = 0 AND k = 21""",
    ["day"],
)
_DP = "entity, CAST(history_end AS VARCHAR) AS history_end, CAST(forecast_start AS VARCHAR) AS forecast_start, CAST(forecast_end AS VARCHAR) AS forecast_end, target_total"


_T = T.PairTemplate()
_ROW = f"""CAST(ds[i] AS VARCHAR) || ';' || substr(dayname(ds[i]), 1, 3) || ';' || CASE WHEN i <= 14 THEN CAST(CAST(gs[i] AS INTEGER) AS VARCHAR) ELSE '{_T.asked}' END
  || ';' || CASE WHEN list_contains(hol, ds[i]) THEN '{_T.holiday}' ELSE '' END || CASE WHEN isodow(ds[i]) >= 6 THEN '{_T.weekend}' ELSE '' END"""
_ANS = """'{"date": "' || CAST(ds[i] AS VARCHAR) || '", "forecast": ' || CAST(CAST(gs[i] AS INTEGER) AS VARCHAR) || '}'"""
_NL = "' || chr(10) || '"
_START = lambda role: f"'<|im_start|>{role}{_NL}'"
_TEXT = f"""{_START('system')} || '{_T.system}<|im_end|>{_NL}<|im_start|>user{_NL}' || concat_ws(chr(10), '{_T.site}' || p.entity,
  CASE WHEN abs(b.overall_bias) > 2 THEN '{_T.tendency}' || CASE WHEN b.overall_bias > 0 THEN '{_T.high}' ELSE '{_T.low}' END END, '{_T.header}',
  array_to_string(list_transform(range(1, 22), lambda i: {_ROW}), chr(10))) || '<|im_end|>{_NL}<|im_start|>assistant{_NL}['
  || array_to_string(list_transform(range(15, 22), lambda i: {_ANS}), ', ') || ']<|im_end|>'"""


@query(
    "ds_pairs",
    with_(
        f"""SELECT p.{_DP}, {_TEXT} AS text FROM (SELECT * FROM pairs_ds, (SELECT list(date) AS hol FROM cal WHERE is_holiday)) p LEFT JOIN state b ON b.entity = p.entity""",
        "pairs_ds", "cal", "state",
    ),
)
def ds_pairs(spark, sf):
    return examples(spark, sf)


@query(
    "ds_split",
    with_(
        """SELECT entity, CAST(forecast_start AS VARCHAR) AS forecast_start, CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'eval' END AS part FROM (
        SELECT *, row_number() OVER (ORDER BY forecast_start, entity) AS rn, count(*) OVER () AS n FROM pairs_ds)""",
        "pairs_ds",
    ),
)
def ds_split(spark, sf):
    return T.split_pairs(examples(spark, sf), 0.9).select("entity", "forecast_start", "part")


@query(
    "ds_eval",
    with_(
        """SELECT (SELECT count(*) FROM ans) AS samples, round((SELECT count(*) FROM ans WHERE k < 2) / (SELECT count(*) FROM ans) * 100, 4) AS parse_rate, round(avg(pct), 4) AS avg_mape, round(avg(e), 4) AS avg_mae, count(*) AS days,
        round(median(pct), 4) AS median_mape FROM (SELECT abs(p.forecast - (a.n + 10)) AS e, abs(p.forecast - (a.n + 10)) / (a.n + 10) * 100 AS pct FROM parsed p JOIN ans a ON a.id = p.id)""",
        "parsed", "ans",
    ),
)
def ds_eval(spark, sf):
    a = answers(spark, sf)
    days = F.explode(F.array(F.lit("2001-08-02"), F.lit("2001-08-03"))).alias("date")
    truth = a.select("id", days, (F.col("len") + 10).cast("double").alias("forecast"))
    return rounded(T.evaluate_answers(truth, a.select("id", "answer")), "parse_rate", "avg_mape", "avg_mae", "median_mape")
