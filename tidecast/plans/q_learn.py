"""Queries: learning loop. Two halves of the ledger play two runs: the first starts from an
empty state, the second is smoothed into the first."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import facts, monitor, profile
from tidecast.operators import learn as N
from tidecast.operators import metrics as M
from tidecast.plans import inputs as I
from tidecast.plans.q_facts import item_facts
from tidecast.plans.q_ledger import _SEG, ledger, two_runs
from tidecast.plans.q_profile import rounded
from tidecast.plans.registry import cte, query, with_

SPLIT = "1998-07-01"
D = "CAST(date AS VARCHAR) AS date"


def rows(spark, sf, half=None):
    """Error rows each entity learns from, of one half or of all."""
    e = N.learning_rows(N.errors(ledger(spark, sf)))
    if half == 1:
        return N.learning_rows(N.errors(ledger(spark, sf).where(f"date < date'{SPLIT}'")))
    if half == 2:
        return N.learning_rows(N.errors(ledger(spark, sf).where(f"date >= date'{SPLIT}'")))
    return e


_ER = """SELECT p.*, ae / nullif(actual, 0) * 100 AS pct_error, error / nullif(actual, 0) * 100 AS signed_pct, dayname(date) AS weekday FROM pairs p"""
cte("er", _ER, ["pairs"])
for _h, _op in ((1, "<"), (2, ">=")):
    cte(f"e{_h}", f"SELECT * FROM er WHERE date {_op} DATE '{SPLIT}'", ["er"])
    cte(f"dm{_h}", f"SELECT entity, avg(abs(p - a) / a) * 100 AS mape FROM (SELECT entity, date, sum(pred) AS p, sum(actual) AS a FROM e{_h} GROUP BY ALL) WHERE a > 0 GROUP BY entity", [f"e{_h}"])
    cte(
        f"ob{_h}",
        f"""SELECT entity, count(*) AS n, avg(error) AS b, median(actual / nullif(pred, 0)) FILTER (pred > 0) AS r, count(*) FILTER (pred > 0) AS nr FROM e{_h} GROUP BY entity HAVING count(*) >= 10""",
        [f"e{_h}"],
    )
_AL = "CASE WHEN coalesce({0}, 0) > 80 THEN 0.5::DOUBLE WHEN coalesce({0}, 0) > 50 THEN 0.4::DOUBLE WHEN coalesce({0}, 0) > 25 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END"
cte(
    "st1",
    f"""SELECT entity, 0.2::DOUBLE * b AS bias, mape, CASE WHEN nr >= 10 THEN least(greatest(r, 0.5), 2.0) END AS anchor,
  coalesce(CASE WHEN nr >= 10 THEN {_AL.format('mape')} * least(greatest(r, 0.65), 1.35) + (1 - {_AL.format('mape')}) END, 1.0) AS cf FROM ob1 LEFT JOIN dm1 USING (entity)""",
    ["ob1", "dm1"],
)
cte(
    "st2",
    f"""SELECT *, CASE WHEN r IS NULL THEN a1 ELSE least(greatest(CASE WHEN a1 IS NULL THEN r ELSE al2 * r + (1 - al2) * a1 END, 0.5), 2.0) END AS anchor,
   coalesce(CASE WHEN r IS NULL THEN cf1 ELSE al2 * least(greatest(r, 0.65), 1.35) + (1 - al2) * coalesce(cf1, 1.0) END, 1.0) AS cf FROM (
  SELECT *, {_AL.format('mape')} AS al2 FROM (
  SELECT coalesce(s.entity, o.entity) AS entity, CASE WHEN o.b IS NULL THEN s.bias ELSE {_AL.format('s.mape')} * o.b + (1 - {_AL.format('s.mape')}) * coalesce(s.bias, 0) END AS bias,
   coalesce(m.mape, s.mape) AS mape, s.anchor AS a1, s.cf AS cf1, CASE WHEN o.nr >= 10 THEN o.r END AS r, s.bias AS b1, o.n
  FROM st1 s FULL JOIN ob2 o ON o.entity = s.entity LEFT JOIN dm2 m ON m.entity = o.entity))""",
    ["st1", "ob2", "dm2"],
)


def state1(spark, sf):
    r = rows(spark, sf, 1)
    return I.once(spark, sf, "learn-1", lambda: N.step_entity(r, N.empty_entity_state(r)))


def state2(spark, sf):
    return I.once(spark, sf, "learn-2", lambda: N.step_entity(rows(spark, sf, 2), state1(spark, sf)))


@query(
    "ln_rows",
    with_(
        """SELECT entity, g AS granularity, count(*) AS n FROM (SELECT *, CASE WHEN n1 >= 10 THEN 'shift_mode' WHEN n2 >= 10 THEN 'shift' ELSE 'mixed' END AS g FROM (
        SELECT *, shift IS NOT NULL AND mode = 'shift' AS m1, count(*) FILTER (shift IS NOT NULL AND mode = 'shift') OVER (PARTITION BY entity) AS n1,
        count(*) FILTER (shift IS NOT NULL) OVER (PARTITION BY entity) AS n2 FROM two_runs WHERE pred >= 0 AND actual >= 0)) WHERE CASE g WHEN 'shift_mode' THEN m1 WHEN 'shift' THEN shift IS NOT NULL ELSE true END GROUP BY ALL""",
        "two_runs",
    ),
)
def ln_rows(spark, sf):
    return N.learning_rows(N.errors(two_runs(spark, sf))).groupBy("entity", "granularity").agg(F.count("*").alias("n"))


@query("ln_alpha", with_(f"SELECT entity, round(mape, 4) AS last_mape, {_AL.format('mape')} AS alpha FROM st1", "st1"))
def ln_alpha(spark, sf):
    s = state1(spark, sf).select("entity", "last_mape", N.alpha_of(F.col("last_mape")).alias("alpha"))
    return rounded(s, "last_mape")


@query("ln_bias", with_("SELECT entity, round(bias, 4) AS overall_bias, CASE WHEN b1 IS NOT NULL AND n IS NOT NULL THEN 2 ELSE 1 END AS history_len FROM st2", "st2"))
def ln_bias(spark, sf):
    return rounded(state2(spark, sf).select("entity", "overall_bias", F.size("bias_history").alias("history_len")), "overall_bias")


@query("ln_factor", with_("SELECT entity, round(anchor, 4) AS anchor, round(cf, 4) AS correction_factor, round(mape, 4) AS last_mape FROM st2", "st2"))
def ln_factor(spark, sf):
    return rounded(state2(spark, sf).select("entity", "anchor", "correction_factor", "last_mape"), "anchor", "correction_factor", "last_mape")


def _obs_sql(h):
    e = f"e{h}"
    g = lambda scope, key, where="true": f"SELECT entity, '{scope}' AS scope, {key} AS key, avg(error) AS obs, count(*) AS n FROM {e} WHERE {where} GROUP BY ALL HAVING count(*) >= 3"
    return " UNION ALL ".join([
        g("weekday", "weekday"), g("shift", "shift"), g("weekday_shift", "weekday || '__' || shift"),
        g("context", "weekday || '__' || shift || '__' || CASE WHEN is_holiday THEN 'holiday' ELSE 'normal' END"), g("holiday", "'all'", "is_holiday"),
        f"SELECT entity, 'event' AS scope, key, avg(m) AS obs, CAST(sum(k) AS BIGINT) AS n FROM (SELECT entity, coalesce(c.event_on, c.holiday_type) AS key, e.date, avg(error) AS m, count(*) AS k FROM {e} e JOIN cal c ON c.date = e.date WHERE coalesce(c.event_on, c.holiday_type) IS NOT NULL GROUP BY ALL) GROUP BY ALL",
    ])


cte("k1", _obs_sql(1), ["e1", "cal"])
cte("k2", _obs_sql(2), ["e2", "cal"])
cte(
    "keys2",
    f"""SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.scope, b.scope) AS scope, coalesce(a.key, b.key) AS key,
   CASE WHEN b.obs IS NULL THEN 0.2::DOUBLE * a.obs ELSE al * b.obs + (1 - al) * coalesce(0.2::DOUBLE * a.obs, 0) END AS value, coalesce(a.n, 0) + coalesce(b.n, 0) AS count
  FROM k1 a FULL JOIN (SELECT k2.*, {_AL.format('s.mape')} AS al FROM k2 LEFT JOIN st1 s ON s.entity = k2.entity) b ON b.entity = a.entity AND b.scope = a.scope AND b.key = a.key""",
    ["k1", "k2", "st1"],
)


def keys2(spark, sf):
    def build():
        cal = I.calendar(spark, sf)
        r1, r2 = rows(spark, sf, 1), rows(spark, sf, 2)
        none = state1(spark, sf).where("false")
        obs = lambda r: N.observe_keys(r).unionByName(N.observe_events(r, cal))
        first = N.merge_keys(N.empty_keys(r1), obs(r1), none)
        return N.merge_keys(first, obs(r2), state1(spark, sf))

    return I.once(spark, sf, "learn-keys", build)


def _key_query(name, scopes):
    inn = ", ".join(f"'{s}'" for s in scopes)

    @query(name, with_(f"SELECT entity, scope, key, round(value, 7) AS value, count FROM keys2 WHERE scope IN ({inn})", "keys2"))
    def run(spark, sf):
        return rounded(keys2(spark, sf).where(F.col("scope").isin(*scopes)), "value", n=7)

    return run


_key_query("ln_bias_keys", ["weekday", "shift", "weekday_shift"])
_key_query("ln_holiday_bias", ["holiday"])
_key_query("ln_event_bias", ["event"])

for _h in (1, 2):
    cte(f"sea{_h}", f"SELECT entity, CAST(month(date) AS INTEGER) AS month, avg(actual) AS oa, avg(pred) AS op, avg(error) AS ob, count(*) AS n FROM e{_h} GROUP BY ALL HAVING count(*) >= 3", [f"e{_h}"])
_MX = "CASE WHEN b.{0} IS NULL THEN a.{0} ELSE al * b.{0} + (1 - al) * coalesce(a.{0}, b.{0}) END"
cte(
    "sea",
    f"""SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.month, b.month) AS month, {_MX.format('oa')} AS avg_actual, {_MX.format('op')} AS avg_pred, {_MX.format('ob')} AS bias,
  coalesce(a.n, 0) + coalesce(b.n, 0) AS count FROM sea1 a FULL JOIN (SELECT s2.*, {_AL.format('s.mape')} AS al FROM sea2 s2 LEFT JOIN st1 s ON s.entity = s2.entity) b ON b.entity = a.entity AND b.month = a.month""",
    ["sea1", "sea2", "st1"],
)


def seasonal2(spark, sf):
    def build():
        r1 = rows(spark, sf, 1)
        first = N.seasonal_step(r1, N.empty_seasonal(r1), state1(spark, sf).where("false"))
        return N.seasonal_step(rows(spark, sf, 2), first, state1(spark, sf))

    return I.once(spark, sf, "learn-seasonal", build)


@query("ln_seasonal", with_("SELECT entity, month, round(avg_actual, 4) AS avg_actual, round(avg_pred, 4) AS avg_pred, round(bias, 4) AS bias, count FROM sea", "sea"))
def ln_seasonal(spark, sf):
    return rounded(seasonal2(spark, sf), "avg_actual", "avg_pred", "bias")


_GB = "round(avg(error), 4) AS bias, round(avg(pct_error), 4) AS mape, round(avg(signed_pct), 4) AS signed_pct, round(avg(actual), 4) AS avg_actual, round(avg(pred), 4) AS avg_pred, count(*) AS n"


@query(
    "ln_global",
    with_(
        f"""SELECT 'all' AS scope, 'all' AS key, {_GB} FROM er UNION ALL SELECT 'weekend', 'all', {_GB} FROM er WHERE isodow(date) >= 6 UNION ALL SELECT 'weekday', weekday, {_GB} FROM er GROUP BY weekday
        UNION ALL SELECT 'holiday', 'all', {_GB} FROM er WHERE is_holiday UNION ALL SELECT 'month', CAST(month(date) AS VARCHAR), {_GB} FROM er GROUP BY month(date)""",
        "er",
    ),
)
def ln_global(spark, sf):
    g = N.global_patterns(N.errors(ledger(spark, sf)))
    return rounded(g, "bias", "mape", "signed_pct", "avg_actual", "avg_pred")


_SK = {"ml": "pre_system", "ai": "ai_raw"}


def _sk(h):
    one = lambda k, c: f"SELECT entity, '{k}' AS skill, avg(abs(p - a) / a) * 100 AS mape, count(*) AS days FROM (SELECT entity, date, sum({c}) AS p, sum(actual) AS a, count(*) AS k FROM e{h} WHERE actual > 0 AND {c} IS NOT NULL GROUP BY ALL) GROUP BY entity HAVING sum(k) >= 10"
    return f"SELECT *, least(greatest(1 - mape / 100, 0), 1) AS utility FROM ({' UNION ALL '.join(one(k, c) for k, c in _SK.items())})"


cte("sk1", _sk(1), ["e1"])
cte("sk2", _sk(2), ["e2"])
cte(
    "sk",
    f"""SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.skill, b.skill) AS skill, {_MX.format('mape')} AS mape, {_MX.format('utility')} AS utility, coalesce(b.days, a.days) AS days
  FROM sk1 a FULL JOIN (SELECT x.*, {_AL.format('s.mape')} AS al FROM sk2 x LEFT JOIN st1 s ON s.entity = x.entity) b ON b.entity = a.entity AND b.skill = a.skill""",
    ["sk1", "sk2", "st1"],
)


@query(
    "ln_skill",
    with_(
        """SELECT entity, round(m, 4) AS ml_mape, round(a, 4) AS ai_mape, round(least(greatest(w, 0.15), 0.85)::DOUBLE, 4) AS ml_weight FROM (SELECT *, (0.7 * mu + 0.3 * 0.4) / ((0.7 * mu + 0.3 * 0.4) + au) AS w FROM (
        SELECT entity, max(mape) FILTER (skill = 'ml') AS m, max(mape) FILTER (skill = 'ai') AS a, coalesce(max(utility) FILTER (skill = 'ml'), 0.5) AS mu, coalesce(max(utility) FILTER (skill = 'ai'), 0.3) AS au FROM sk GROUP BY entity))""",
        "sk",
    ),
)
def ln_skill(spark, sf):
    new = N.merge_skill(N.skill(rows(spark, sf, 1), _SK), N.skill(rows(spark, sf, 2), _SK), state1(spark, sf))
    w = N.dynamic_weights(new).drop("ai_weight")
    p = new.groupBy("entity").agg(
        F.max(F.when(F.col("skill") == "ml", F.col("mape"))).alias("ml_mape"), F.max(F.when(F.col("skill") == "ai", F.col("mape"))).alias("ai_mape")
    )
    return rounded(p.join(w, "entity"), "ml_mape", "ai_mape", "ml_weight")


cte(
    "strat",
    """SELECT *, CASE WHEN ml_mape < ai_mape * 0.7 THEN 'ML_PRIMARY_AI_VALIDATE' WHEN ai_mape < ml_mape * 0.7 THEN 'AI_PRIMARY_ML_SECONDARY' WHEN ml_mape < ai_mape THEN 'ENSEMBLE_WEIGHTED'
   WHEN ml_mape >= ai_mape THEN 'ENSEMBLE_EQUAL' END AS best_strategy FROM (
  SELECT entity, avg(abs(p - a) / a) * 100 AS ml_mape FROM (SELECT entity, date, sum(pre_system) AS p, sum(actual) AS a, count(*) AS k FROM er WHERE pre_system IS NOT NULL GROUP BY ALL) GROUP BY entity HAVING sum(k) >= 10 AND count(*) >= 5)
  FULL JOIN (SELECT entity, avg(abs(p - a) / a) * 100 AS ai_mape FROM (SELECT entity, date, arg_min(ai_raw, shift) AS p, sum(actual) AS a, count(*) AS k FROM er WHERE ai_raw IS NOT NULL GROUP BY ALL) GROUP BY entity
   HAVING sum(k) >= 10 AND count(*) >= 5) USING (entity)""",
    ["er"],
)


@query("ln_strategy", with_("SELECT entity, round(ml_mape, 4) AS ml_mape, round(ai_mape, 4) AS ai_mape, best_strategy FROM strat", "strat"))
def ln_strategy(spark, sf):
    return rounded(N.best_strategy(rows(spark, sf)), "ml_mape", "ai_mape")


# -- a state with history: monthly values play the runs ----------------------------------------

cte(
    "mon",
    """SELECT entity, ym, avg(e) FILTER (true) AS b, avg(abs(p - a) / a) * 100 AS m FROM (SELECT entity, strftime(date, '%Y-%m') AS ym, date, avg(error) AS e, sum(pred) AS p, sum(actual) AS a FROM er GROUP BY ALL) GROUP BY ALL""",
    ["er"],
)
cte(
    "state",
    """SELECT m.entity, bias_history, mape_history, bias_history[-1] AS overall_bias, mape_history[-1] AS last_mape, least(greatest(r, 0.65), 1.35) AS correction_factor, least(greatest(r, 0.5), 2.0) AS anchor,
   CAST(len(mape_history) % 3 AS INTEGER) AS escalation_level, hit AS monitoring_hit_rate, hit + 3 AS last_hit_rate, CAST(n % 4 AS INTEGER) AS hr_drops, s.ml_mape, s.ai_mape, s.best_strategy
  FROM (SELECT entity, list(b ORDER BY ym)[-10:] AS bias_history, list(m ORDER BY ym)[-30:] AS mape_history FROM mon GROUP BY entity) m
  JOIN (SELECT entity, count(*) AS n, median(actual / nullif(pred, 0)) FILTER (pred > 0) AS r, avg(CASE WHEN ae <= 15 THEN 1.0 ELSE 0.0 END) * 100 AS hit FROM er GROUP BY entity) x ON x.entity = m.entity
  LEFT JOIN strat s ON s.entity = m.entity""",
    ["mon", "er", "strat"],
)


def state(spark, sf):
    def build():
        e = N.errors(ledger(spark, sf)).withColumn("ym", F.date_format("date", "yyyy-MM"))
        d = e.groupBy("entity", "ym", "date").agg(F.avg("error").alias("e"), F.sum("pred").alias("p"), F.sum("actual").alias("a"))
        m = d.groupBy("entity", "ym").agg(F.avg("e").alias("b"), (F.avg(F.abs(F.col("p") - F.col("a")) / F.col("a")) * 100).alias("m"))
        arr = F.sort_array(F.collect_list(F.struct("ym", "b", "m")))
        tail = lambda a, n: F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)
        h = m.groupBy("entity").agg(arr.alias("x")).select(
            "entity", tail(F.transform("x", lambda v: v["b"]), 10).alias("bias_history"), tail(F.transform("x", lambda v: v["m"]), 30).alias("mape_history"))
        r = e.groupBy("entity").agg(
            F.count("*").alias("n"), F.median(F.when(F.col("pred") > 0, F.col("actual") / F.nullif("pred", F.lit(0.0)))).alias("r"),
            (F.avg(M.hit_abs().cast("double")) * 100).alias("hit"))
        j = h.join(r, "entity").join(N.best_strategy(rows(spark, sf)), "entity", "left")
        return j.select(
            "entity", "bias_history", "mape_history", F.element_at("bias_history", -1).alias("overall_bias"), F.element_at("mape_history", -1).alias("last_mape"),
            N.clip(F.col("r"), 0.65, 1.35).alias("correction_factor"), N.clip(F.col("r"), 0.5, 2.0).alias("anchor"),
            (F.size("mape_history") % 3).alias("escalation_level"), F.col("hit").alias("monitoring_hit_rate"), (F.col("hit") + 3).alias("last_hit_rate"),
            (F.col("n") % 4).cast("int").alias("hr_drops"), "ml_mape", "ai_mape", "best_strategy", F.lit(False).alias("needs_retune"))

    return I.once(spark, sf, "learn-state", build)


_DIR = """CASE WHEN len(bias_history) >= 5 THEN CASE WHEN len(list_filter(bias_history, lambda b: b > 2)) = len(bias_history) THEN 'CONSISTENT_OVER'
  WHEN len(list_filter(bias_history, lambda b: b < -2)) = len(bias_history) THEN 'CONSISTENT_UNDER' ELSE 'MIXED' END END"""


@query(
    "ln_context",
    with_(
        f"""SELECT k.entity, key, round(value, 7) AS value, s.dir AS bias_direction FROM keys2 k LEFT JOIN (SELECT entity, {_DIR} AS dir FROM state) s ON s.entity = k.entity WHERE scope = 'context'""",
        "keys2", "state",
    ),
)
def ln_context(spark, sf):
    s = state(spark, sf).select("entity", N.bias_direction(F.col("bias_history")).alias("bias_direction"))
    k = keys2(spark, sf).where("scope = 'context'").select("entity", "key", "value")
    return rounded(k.join(s, "entity", "left"), "value", n=7)


for _h in (1, 2):
    cte(
        f"sg{_h}",
        f"""SELECT entity, segment, n, ob, nm, nh, CASE WHEN segment LIKE '%LARGE' THEN least(greatest(r, 0.75), 1.45) ELSE least(greatest(r, 0.85), 1.25) END AS fo FROM (
      SELECT entity, {_SEG} AS segment, count(*) AS n, avg(error) AS ob, median(actual / pred) AS r, avg(ae / actual) * 100 AS nm,
        avg(CASE WHEN (actual < 100 AND ae <= 10) OR (actual >= 100 AND ae / actual <= 0.1) THEN 1.0 ELSE 0.0 END) AS nh FROM e{_h} WHERE actual > 0 AND pred > 0
        AND entity IN (SELECT entity FROM e{_h} WHERE actual > 0 AND pred > 0 GROUP BY entity HAVING count(*) >= 10) GROUP BY ALL HAVING count(*) >= 5)""",
        [f"e{_h}"],
    )
cte("seg1", "SELECT entity, segment, 0.2::DOUBLE * fo + (1 - 0.2::DOUBLE) * 1.0 AS factor, 0.2::DOUBLE * ob AS bias, nm AS mape, nh AS hit_rate, n AS samples, 0.48::DOUBLE AS confidence FROM sg1", ["sg1"])
_SD = "CASE WHEN bias > 2 THEN 'CONSISTENT_OVER' WHEN bias < -2 THEN 'CONSISTENT_UNDER' ELSE 'MIXED' END"
cte(
    "seg2",
    f"""SELECT *, {_SD} AS direction FROM (SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.segment, b.segment) AS segment,
   CASE WHEN b.fo IS NULL THEN a.factor ELSE al * b.fo + (1 - al) * coalesce(a.factor, 1.0) END AS factor, CASE WHEN b.ob IS NULL THEN a.bias ELSE al * b.ob + (1 - al) * coalesce(a.bias, 0) END AS bias,
   coalesce(b.nm, a.mape) AS mape, coalesce(b.nh, a.hit_rate) AS hit_rate, coalesce(b.n, a.samples) AS samples,
   CASE WHEN b.n IS NULL THEN a.confidence ELSE coalesce(a.confidence, 0.45) + 0.03 END AS confidence
  FROM seg1 a FULL JOIN (SELECT x.*, {_AL.format('s.mape')} AS al FROM sg2 x LEFT JOIN st1 s ON s.entity = x.entity) b ON b.entity = a.entity AND b.segment = a.segment)""",
    ["seg1", "sg2", "st1"],
)


def segments1(spark, sf):
    def build():
        r1 = rows(spark, sf, 1)
        return N.segment_step(r1, N.empty_segments(r1), state1(spark, sf).where("false"))

    return I.once(spark, sf, "learn-segments-1", build)


def segments2(spark, sf):
    return I.once(spark, sf, "learn-segments-2", lambda: N.segment_step(rows(spark, sf, 2), segments1(spark, sf), state1(spark, sf)))


_SGR = ["factor", "bias", "mape", "hit_rate", "confidence"]


@query("ln_segment", with_("SELECT entity, segment, direction, samples, " + ", ".join(f"round({c}, 4) AS {c}" for c in _SGR) + " FROM seg2", "seg2"))
def ln_segment(spark, sf):
    return rounded(segments2(spark, sf).drop("validated"), *_SGR)


_C = "correction_factor"
cte(
    "esc1",
    f"""SELECT *, CASE WHEN len(bias_history) < 5 THEN {_C} WHEN last_mape <= 25 THEN CASE WHEN abs({_C} - 1) > 0.01 THEN {_C} + (1 - {_C}) * 0.10 ELSE {_C} END
   WHEN len(list_filter(bias_history[-5:], lambda b: b > 2)) = 5 THEN greatest(0.65, {_C} - CASE WHEN last_mape > 50 THEN 0.02 ELSE 0.01 END)
   WHEN len(list_filter(bias_history[-5:], lambda b: b < -2)) = 5 THEN least(1.35, {_C} + CASE WHEN last_mape > 50 THEN 0.02 ELSE 0.01 END)
   ELSE CASE WHEN abs({_C} - 1) > 0.01 THEN {_C} + (1 - {_C}) * 0.05 ELSE {_C} END END AS c1,
   list_sum(mape_history[-3:]) / 3 AS rec, list_sum(mape_history[-6:-4]) / 3 AS old FROM state""",
    ["state"],
)
cte(
    "esc",
    """SELECT entity, CASE k WHEN 'none' THEN c1 WHEN 'good' THEN CASE WHEN abs(c1 - 1) > 0.01 THEN c1 + (1 - c1) * 0.10 ELSE c1 END
    WHEN 'flat' THEN CASE WHEN overall_bias <> 0 THEN least(greatest(dc - sign(overall_bias) * least(2, escalation_level + 1) * 0.005, 0.65), 1.35) ELSE dc END ELSE dc END AS correction_factor,
   CASE k WHEN 'good' THEN 0 WHEN 'better' THEN greatest(0, escalation_level - 1) WHEN 'flat' THEN least(2, escalation_level + 1) ELSE escalation_level END AS escalation_level FROM (
  SELECT *, CASE WHEN abs(c1 - 1) > 0.005 THEN c1 + (1 - c1) * 0.05 ELSE c1 END AS dc,
   CASE WHEN len(mape_history) < 10 THEN 'none' WHEN last_mape <= 25 THEN 'good' WHEN rec < old * 0.97 THEN 'better'
    WHEN len(bias_history) >= 3 AND NOT (len(list_filter(bias_history[-3:], lambda b: b > 0)) = 3 OR len(list_filter(bias_history[-3:], lambda b: b < 0)) = 3) THEN 'mixed'
    WHEN abs(rec - old) / greatest(old, 1) < 0.03 THEN 'flat' ELSE 'rest' END AS k FROM esc1)""",
    ["esc1"],
)


@query("ln_escalate", with_("SELECT entity, round(correction_factor, 4) AS correction_factor, escalation_level FROM esc", "esc"))
def ln_escalate(spark, sf):
    e = N.escalate(state(spark, sf)).select("entity", "correction_factor", "escalation_level")
    return rounded(e, "correction_factor")


@query(
    "ln_reset",
    with_(
        """SELECT entity, CASE WHEN z THEN 1.0 ELSE round(correction_factor, 4) END AS correction_factor, CASE WHEN z THEN 0.0 ELSE round(overall_bias, 4) END AS overall_bias, CASE WHEN z THEN 0 ELSE escalation_level END AS escalation_level,
        z AS needs_retune, CASE WHEN z THEN 'bulk' END AS reset_reason, CASE WHEN z THEN 0 ELSE (SELECT count(*) FROM keys2 k WHERE k.entity = s.entity) END AS keys_left FROM (SELECT *, hr_drops = 3 AS z FROM state) s""",
        "state", "keys2",
    ),
)
def ln_reset(spark, sf):
    s = state(spark, sf)
    hit = F.col("hr_drops") == 3
    r = N.hard_reset(s, hit, "bulk", I.AS_OF)
    k = N.clear_keys(keys2(spark, sf), s.where(hit)).groupBy("entity").agg(F.count("*").alias("keys_left"))
    out = r.join(k, "entity", "left").fillna(0, ["keys_left"])
    return rounded(out.select("entity", "correction_factor", "overall_bias", "escalation_level", "needs_retune", "reset_reason", "keys_left"), "correction_factor", "overall_bias")


def _iss(src, today):
    return f"""SELECT entity, date, type, error_pct FROM (SELECT entity, date, CASE WHEN hol THEN 'HOLIDAY_SPIKE' WHEN pct > 50 THEN 'EXTREME_ERROR' WHEN signed > 25 THEN 'OVERPREDICT' WHEN signed < -25 THEN 'UNDERPREDICT'
      WHEN isodow(date) >= 6 THEN 'WEEKEND_ANOMALY' ELSE 'HIGH_ERROR' END AS type, pct AS error_pct FROM ({src}) WHERE pct > 25)
    UNION ALL SELECT entity, DATE '{today}', unnest(['CONSISTENT_OVERPREDICT', 'CONSISTENT_UNDERPREDICT']) AS type, m FROM (
      SELECT entity, count(*) FILTER (signed > 10) AS o, count(*) FILTER (signed < -10) AS u, avg(signed) AS m FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM ({src})) WHERE rn <= 7 GROUP BY entity HAVING count(*) = 7)
      WHERE o >= 5 OR u >= 5"""


_DS = "SELECT entity, date, abs(sum(error)) / sum(actual) * 100 AS pct, sum(error) / sum(actual) * 100 AS signed, bool_or(is_holiday) AS hol FROM {} GROUP BY entity, date"


def _iss_sql(e, today):
    return f"SELECT * FROM ({_iss(_DS.format(e), today)}) i WHERE i.type NOT LIKE 'CONSISTENT%' OR (i.type = 'CONSISTENT_OVERPREDICT' AND (SELECT count(*) FILTER (signed > 10) FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM ({_DS.format(e)}) z WHERE z.entity = i.entity) WHERE rn <= 7) >= 5) OR (i.type = 'CONSISTENT_UNDERPREDICT' AND (SELECT count(*) FILTER (signed < -10) FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM ({_DS.format(e)}) z WHERE z.entity = i.entity) WHERE rn <= 7) >= 5)"


cte("i1", _iss_sql("e1", SPLIT), ["e1"])
cte("i2", _iss_sql("e2", I.AS_OF), ["e2"])


@query(
    "ln_issues",
    with_(
        f"""SELECT entity, CAST(date AS VARCHAR) AS date, type, round(error_pct, 4) AS error_pct FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC, type) AS rn FROM (
        SELECT * FROM i2 UNION ALL SELECT * FROM i1 WHERE date >= DATE '{I.AS_OF}' - 60)) WHERE rn <= 100""",
        "i1", "i2",
    ),
)
def ln_issues(spark, sf):
    m = N.merge_issues(N.issues(rows(spark, sf, 1), SPLIT), N.issues(rows(spark, sf, 2), I.AS_OF), I.AS_OF)
    return rounded(m, "error_pct")


# -- monitoring feedback ---------------------------------------------------------------------------

cte(
    "trend",
    """SELECT coalesce((s - f) / nullif(f, 0) * 100, 0) AS pct FROM (SELECT list_avg(m[1:3]) AS f, list_avg(m[4:7]) AS s FROM (SELECT list(w ORDER BY date) AS m FROM (
  SELECT date, sum(ae) / sum(actual) * 100 AS w FROM pairs GROUP BY date ORDER BY date DESC LIMIT 7)))""",
    ["pairs"],
)
cte(
    "pe",
    """SELECT entity, sum(ae) / sum(actual) * 100 AS wmape, avg(CASE WHEN ae <= 15 THEN 1.0 ELSE 0.0 END) * 100 - 5 AS hit, count(*) >= 30 AND sum(ae) / sum(actual) * 100 > 40 AS ret FROM pairs GROUP BY entity""",
    ["pairs"],
)


def _lim(x):
    return f"least(greatest({x}, 0.65), 1.35)"


cte("ab0", "SELECT s.*, p.wmape, p.hit AS hr, s.monitoring_hit_rate AS prev, coalesce(p.ret, false) AS ret, (SELECT pct FROM trend) AS tp, dr.* FROM state s CROSS JOIN (SELECT mape_change_pct AS chg, mape_alert AS ma, hit_alert AS ha FROM drift_flags) dr LEFT JOIN pe p ON p.entity = s.entity", ["state", "pe", "trend", "drift_flags"])
cte("ab1", f"SELECT *, CASE WHEN ma AND chg > 0 AND overall_bias > 2 THEN {_lim('correction_factor - least(0.05, chg / 1000)')} WHEN ma AND chg > 0 AND overall_bias < -2 THEN {_lim('correction_factor + least(0.05, chg / 1000)')} ELSE correction_factor END AS c1, CASE WHEN ha AND hr < prev - 2 THEN hr_drops + 1 WHEN ha AND hr >= prev THEN 0 ELSE hr_drops END AS d1 FROM ab0", ["ab0"])
cte("ab2", "SELECT *, CASE WHEN ha AND d1 >= 3 THEN 1.0 ELSE c1 END AS c2, CASE WHEN ha AND d1 >= 3 THEN 0.0 ELSE overall_bias END AS b2, CASE WHEN ha AND d1 >= 3 THEN 0 ELSE escalation_level END AS l2, ha AND NOT d1 >= 3 AND hr < 50 AS weak FROM ab1", ["ab1"])
cte("ab3", f"SELECT *, CASE WHEN weak THEN {_lim('c2 - CASE WHEN b2 > 2 THEN 1 WHEN b2 < -2 THEN -1 ELSE 0 END * least(0.08, (50 - hr) / 500)')} ELSE c2 END AS c3, CASE WHEN weak THEN least(5, l2 + 1) ELSE l2 END AS l3 FROM ab2", ["ab2"])
cte("ab4", f"SELECT *, CASE WHEN ret THEN {_lim('c3 - sign(b2) * least(0.15, greatest(0.03, wmape / 1000))')} ELSE c3 END AS c4, CASE WHEN ret THEN least(5, l3 + 2) ELSE l3 END AS l4 FROM ab3", ["ab3"])
cte("ab5", f"SELECT *, CASE WHEN tp > 10 AND b2 > 2 THEN {_lim('c4 - least(0.03, tp / 500)')} WHEN tp > 10 AND b2 < -2 THEN {_lim('c4 + least(0.03, tp / 500)')} ELSE c4 END AS c5 FROM ab4", ["ab4"])


@query(
    "ln_absorb",
    with_(
        """SELECT entity, round(c5, 4) AS correction_factor, round(b2, 4) AS overall_bias, l4 AS escalation_level, ret AS needs_retune, CASE WHEN ha AND d1 >= 3 THEN 0 ELSE d1 END AS hr_drops, round(hr, 4) AS monitoring_hit_rate, round(prev, 4) AS last_hit_rate FROM ab5""",
        "ab5",
    ),
)
def ln_absorb(spark, sf):
    led = ledger(spark, sf)
    m = M.metrics(led, ["entity"])
    per = m.select("entity", "wmape", "mae", "bias", (F.col("hit_rate") - 5).alias("hit_rate"), ((F.col("n") >= 30) & (F.col("wmape") > 40)).alias("retune"))
    hist = M.metrics(led, ["date"]).select("date", F.col("wmape").alias("mape"))
    a = N.absorb(state(spark, sf), per, monitor.drift(led, I.AS_OF), N.accuracy_trend(hist), I.AS_OF)
    cols = ["entity", "correction_factor", "overall_bias", "escalation_level", "needs_retune", "hr_drops", "monitoring_hit_rate", "last_hit_rate"]
    return rounded(a.select(*cols), "correction_factor", "overall_bias", "monitoring_hit_rate", "last_hit_rate")


# -- applying -----------------------------------------------------------------------------------------

cte(
    "ap0",
    f"""SELECT l.*, s.overall_bias, s.last_mape, s.correction_factor, s.anchor, s.escalation_level, CASE WHEN s.last_mape > 80 OR s.escalation_level >= 2 THEN 4 WHEN s.last_mape > 50 OR s.escalation_level >= 1 THEN 3 WHEN s.last_mape > 25 THEN 2 ELSE 1 END AS t,
   g.factor AS sf, g.bias AS sb, g.confidence AS sc, CASE WHEN m.count >= 30 THEN m.bias END AS mb,
   (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'context' AND key = l.weekday || '__' || l.shift || '__' || CASE WHEN l.is_holiday THEN 'holiday' ELSE 'normal' END) AS ctx,
   (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'weekday_shift' AND key = l.weekday || '__' || l.shift) AS ws,
   (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'weekday' AND key = l.weekday) AS wd, (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'shift' AND key = l.shift) AS sh,
   CASE WHEN l.is_holiday THEN (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'holiday') END AS hb,
   (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'event' AND key = l.event_type) AS eb, (SELECT value FROM keys2 k WHERE k.entity = l.entity AND scope = 'event' AND key = l.holiday_type) AS eb2
  FROM (SELECT p.entity, p.date, p.shift, p.pred AS forecast, p.is_holiday, c.holiday_type, c.is_special_event, c.event_type, kl.avg_daily, dayname(p.date) AS weekday, CAST(month(p.date) AS INTEGER) AS month,
     p.shift || '|' || CASE WHEN p.is_holiday THEN 'HOLIDAY' WHEN isodow(p.date) >= 6 THEN 'WEEKEND' ELSE 'WEEKDAY' END || '|' || CASE WHEN kl.avg_daily >= 100 THEN 'LARGE' ELSE 'SMALL' END AS segment
    FROM ledger p JOIN cal c ON c.date = p.date JOIN klass kl ON kl.entity = p.entity WHERE p.pred IS NOT NULL) l
  LEFT JOIN state s ON s.entity = l.entity LEFT JOIN seg2 g ON g.entity = l.entity AND g.segment = l.segment LEFT JOIN sea m ON m.entity = l.entity AND m.month = l.month""",
    ["ledger", "cal", "klass", "state", "seg2", "sea", "keys2"],
)
cte(
    "ap1",
    """SELECT *, forecast * CASE WHEN abs(correction_factor - 1) >= 0.01 THEN correction_factor ELSE 1 END AS a1,
   CASE segment WHEN 'MORNING|WEEKDAY|LARGE' THEN least(least(greatest(sc, 0.25), 0.85), 0.35) WHEN 'MORNING|WEEKDAY|SMALL' THEN least(least(greatest(sc, 0.25), 0.85), 0.20) ELSE least(greatest(sc, 0.25), 0.85) END AS st,
   CASE WHEN segment = 'MORNING|WEEKDAY|LARGE' AND sf > 1 THEN 1 + (sf - 1) * 0.45 WHEN segment = 'MORNING|WEEKDAY|SMALL' AND sf > 1 THEN 1.0 ELSE sf END AS f1,
   CASE WHEN segment = 'MORNING|WEEKDAY|LARGE' AND sb < 0 THEN sb * 0.45 WHEN segment = 'MORNING|WEEKDAY|SMALL' AND sb < 0 THEN 0.0 ELSE sb END AS b1,
   [0.5, 0.7, 0.8, 0.9][t]::DOUBLE AS bs, [0.4, 0.6, 0.7, 0.8][t]::DOUBLE AS ss, [0.5, 0.7, 0.8, 0.9][t]::DOUBLE AS es FROM ap0""",
    ["ap0"],
)
cte(
    "ap2",
    """SELECT *, CASE WHEN sf IS NULL THEN a1 ELSE a1 * CASE WHEN abs(f1 - 1) >= 0.01 THEN 1 + (f1 - 1) * st ELSE 1 END - CASE WHEN abs(b1) >= 1 THEN b1 * least(0.75, st) ELSE 0 END END AS a2 FROM ap1""",
    ["ap1"],
)
cte(
    "ap3",
    """SELECT *, a2 - CASE WHEN abs(overall_bias) >= 2 THEN overall_bias * bs ELSE 0 END
    - CASE WHEN abs(ctx) >= 1 THEN ctx * ss WHEN ws IS NOT NULL THEN CASE WHEN abs(ws) >= 0.5 THEN ws * ss ELSE 0 END
       ELSE coalesce(CASE WHEN abs(wd) >= 0.5 THEN wd * ss ELSE 0 END, 0) + coalesce(CASE WHEN abs(sh) >= 0.5 THEN sh * ss ELSE 0 END, 0) END
    - CASE WHEN abs(hb) >= 1 THEN hb * ss ELSE 0 END
    - CASE WHEN coalesce(eb, CASE WHEN is_special_event AND is_holiday THEN eb2 END) IS NULL THEN 0 WHEN abs(coalesce(eb, eb2)) >= 0.5 THEN coalesce(eb, eb2) * es ELSE 0 END
    - CASE WHEN abs(mb) >= 1.5 THEN mb * least(0.4, bs * 0.5) ELSE 0 END AS a6 FROM ap2""",
    ["ap2"],
)
cte(
    "ap4",
    """SELECT *, CASE WHEN correction_factor IS NOT NULL AND forecast > 0 THEN greatest(0.0, round_even(least(greatest(a7, forecast * (1 - sp)), forecast * (1 + sp)), 0)) ELSE forecast END AS corrected FROM (
  SELECT *, CASE WHEN abs(anchor - 1) > 0.05 AND abs(correction_factor - 1) < 0.03 THEN a6 * (1 - least(0.3, last_mape / 300)) + forecast * anchor * least(0.3, last_mape / 300) ELSE a6 END AS a7,
   CAST(CASE WHEN last_mape > 200 THEN 0.85 WHEN is_special_event THEN 0.50 WHEN last_mape > 100 THEN 0.70 WHEN last_mape > 50 THEN 0.35 ELSE 0.40 END AS DOUBLE) AS sp FROM ap3)""",
    ["ap3"],
)


@query("ln_apply", with_(f"SELECT entity, {D}, shift, forecast, round(a2, 4) AS a2, round(a6, 4) AS a6, corrected FROM ap4", "ap4"))
def ln_apply(spark, sf):
    avg = profile.classify(I.daily(spark, sf)).select("entity", "avg_daily")
    cal = I.calendar(spark, sf).select("date", "holiday_type", "is_special_event", "event_type")
    p = ledger(spark, sf).where("pred is not null").select("entity", "date", "shift", "hour", F.col("pred").alias("forecast"), "is_holiday")
    p = p.join(F.broadcast(cal), "date").join(avg, "entity")
    out = N.apply(p, state(spark, sf), keys2(spark, sf), segments2(spark, sf), seasonal2(spark, sf))
    return rounded(out.select("entity", "date", "shift", "forecast", "a2", "a6", "corrected"), "a2", "a6")


_MH = "mape_history"


@query(
    "ln_diagnose",
    with_(
        f"""SELECT entity, CASE WHEN x = '' THEN 'none found' ELSE x END AS causes, CASE WHEN last_mape <= 25 THEN 'GOOD' WHEN last_mape <= 40 THEN 'FAIR' ELSE 'POOR' END AS grade FROM (SELECT s.entity, s.last_mape,
        concat_ws('; ', CASE WHEN abs(overall_bias) >= 5 THEN 'systematic ' || CASE WHEN overall_bias > 0 THEN 'over' ELSE 'under' END END, 'weekday ' || w.k,
          CASE WHEN ml_mape < ai_mape * 0.6 THEN 'ai much worse' WHEN ai_mape < ml_mape * 0.6 THEN 'ml much worse' END, CASE WHEN abs(h.v) > 5 THEN 'holiday ' || CASE WHEN h.v > 0 THEN 'over' ELSE 'under' END END,
          CASE WHEN i.n >= 3 THEN 'extreme errors' END, CASE WHEN {_MH}[-1] >= {_MH}[-2] AND {_MH}[-2] >= {_MH}[-3] AND NOT ({_MH}[-1] <= {_MH}[-2] AND {_MH}[-2] <= {_MH}[-3]) THEN 'mape rising' END) AS x FROM state s
        LEFT JOIN (SELECT entity, arg_max(key, (abs(value), key)) AS k FROM keys2 WHERE scope = 'weekday' AND abs(value) > 3 GROUP BY entity) w ON w.entity = s.entity
        LEFT JOIN (SELECT entity, max(value) AS v FROM keys2 WHERE scope = 'holiday' GROUP BY entity) h ON h.entity = s.entity
        LEFT JOIN (SELECT entity, count(*) AS n FROM i2 WHERE type = 'EXTREME_ERROR' GROUP BY entity) i ON i.entity = s.entity)""",
        "state", "keys2", "i2",
    ),
)
def ln_diagnose(spark, sf):
    return N.diagnose(state(spark, sf), keys2(spark, sf), N.issues(rows(spark, sf, 2), I.AS_OF))


@query(
    "ln_insights",
    with_(
        f"""SELECT entity, round(last_mape, 4) AS last_mape, last_mape > 25 AS high_mape, CASE WHEN len({_MH}) >= 3 AND {_MH}[-1] < {_MH}[-3] * 0.85 THEN 'improving' WHEN len({_MH}) >= 3 AND {_MH}[-1] > {_MH}[-3] * 1.15 THEN 'degrading' ELSE 'steady' END AS trend,
        best_strategy AS override FROM state""",
        "state",
    ),
)
def ln_insights(spark, sf):
    return rounded(N.insights(state(spark, sf)), "last_mape")


@query(
    "ln_summary",
    with_(
        f"""SELECT entity, round(correction_factor, 4) AS correction_factor, round(overall_bias, 4) AS overall_bias, round(last_mape, 4) AS last_mape, CAST(n AS INTEGER) AS cycles,
        CASE WHEN n < 3 THEN 'N/A' WHEN r < o * 0.95 THEN 'improving' WHEN r > o * 1.05 THEN 'worsening' ELSE 'stable' END AS mape_trend FROM (SELECT *, len({_MH}) AS n, list_sum({_MH}[-3:]) / 3 AS r,
        CASE WHEN len({_MH}) >= 6 THEN list_sum({_MH}[1:3]) / 3 ELSE list_avg({_MH}[1:len({_MH}) // 2 + 1]) END AS o FROM state)""",
        "state",
    ),
)
def ln_summary(spark, sf):
    return rounded(N.correction_summary(state(spark, sf)), "correction_factor", "overall_bias", "last_mape")


_SEGM = """SELECT entity, segment, CAST(sum(s) AS BIGINT) AS samples, sum(ae) / sum(s) AS mae, avg(abs(p - a) / a) * 100 AS mape_daily, sum(e) / sum(s) AS bias, sum(h) / sum(s) AS hit_rate FROM (
  SELECT entity, {seg} AS segment, date, sum(pred) AS p, sum(actual) AS a, count(*) AS s, sum(ae) AS ae, sum(error) AS e, sum(CASE WHEN (actual < 100 AND ae <= 10) OR (actual >= 100 AND ae / actual <= 0.1) THEN 1 ELSE 0 END) AS h
  FROM pairs WHERE actual > 0 AND date >= DATE '{since}' GROUP BY ALL) GROUP BY ALL"""
cte("ck30", _SEGM.format(seg=_SEG, since="2001-02-02"), ["pairs"])
cte(
    "ckpt",
    """SELECT s.entity, s.segment, s.factor AS after_factor, s.bias AS after_bias, c.samples, c.mae, c.mape_daily, c.bias, c.hit_rate FROM seg2 s JOIN ck30 c ON c.entity = s.entity AND c.segment = s.segment
  WHERE c.samples >= 5 AND s.segment NOT LIKE '%HOLIDAY%'""",
    ["seg2", "ck30"],
)
_CKR = ["after_factor", "after_bias", "mae", "mape_daily", "bias", "hit_rate"]


def _ck(spark, sf):
    pending = segments2(spark, sf).where("segment like '%HOLIDAY%'").select("entity", "segment")
    return N.checkpoints(ledger(spark, sf), segments2(spark, sf), pending, I.AS_OF, 180)


@query("ln_checkpoint", with_("SELECT entity, segment, samples, '2001-08-01' AS recorded_at, '2001-08-08' AS validate_after, 'PENDING' AS status, " + ", ".join(f"round({c}, 4) AS {c}" for c in _CKR) + " FROM ckpt", "ckpt"))
def ln_checkpoint(spark, sf):
    return rounded(_ck(spark, sf), *_CKR)


cte("ck60", _SEGM.format(seg=_SEG, since="2001-06-09"), ["pairs"])
cte(
    "val",
    """SELECT *, CASE WHEN good AND NOT bad THEN 'CONFIRM' WHEN bad AND NOT good THEN 'ROLLBACK' ELSE 'HOLD' END AS decision FROM (SELECT *, (ma - mae) / greatest(mae, 1) <= -0.03 OR ha - hit_rate >= 0.03 AS good,
   (ma - mae) / greatest(mae, 1) >= 0.05 OR ha - hit_rate <= -0.03 AS bad FROM (SELECT c.*, k.samples AS samples_after, k.mae AS ma, k.hit_rate AS ha FROM ckpt c JOIN ck60 k ON k.entity = c.entity AND k.segment = c.segment WHERE k.samples >= 5))""",
    ["ckpt", "ck60"],
)


@query(
    "ln_validate",
    with_(
        """SELECT s.entity, s.segment, v.decision, round(CASE WHEN v.decision = 'ROLLBACK' THEN b.factor ELSE s.factor END, 4) AS factor, coalesce(v.decision = 'CONFIRM', false) AS validated,
        round(CASE WHEN v.decision = 'CONFIRM' THEN least(1.0, s.confidence + 0.1) ELSE s.confidence END, 4) AS confidence FROM seg2 s LEFT JOIN val v ON v.entity = s.entity AND v.segment = s.segment
        LEFT JOIN seg1 b ON b.entity = s.entity AND b.segment = s.segment""",
        "seg2", "val", "seg1",
    ),
)
def ln_validate(spark, sf):
    v = N.validate(_ck(spark, sf), ledger(spark, sf), "2001-08-08", 60)
    before = segments1(spark, sf).select("entity", "segment", F.col("factor").alias("before_factor"), F.col("bias").alias("before_bias"))
    done = N.settle(segments2(spark, sf), v.join(before, ["entity", "segment"], "left"))
    return rounded(done.select("entity", "segment", "decision", "factor", "validated", "confidence"), "factor", "confidence")


_AU = ["mae", "mape_daily", "bias", "hit_rate"]
_AUD = lambda sec, name, where, extra="": f"""SELECT '{sec}' AS section, {name} AS name, CAST(sum(s) AS BIGINT) AS samples, sum(ae) / sum(s) AS mae, avg(abs(p - a) / a) * 100 AS mape_daily, sum(e) / sum(s) AS bias, sum(h) / sum(s) AS hit_rate FROM (
  SELECT {name} AS name, date, sum(pred) AS p, sum(actual) AS a, count(*) AS s, sum(ae) AS ae, sum(error) AS e, sum(CASE WHEN (actual < 100 AND ae <= 10) OR (actual >= 100 AND ae / actual <= 0.1) THEN 1 ELSE 0 END) AS h
  FROM (SELECT *, {_SEG} AS seg, CASE WHEN (SELECT max(date) FROM ledger) - date <= 6 THEN 'latest_7_days' ELSE 'previous_7_days' END AS win FROM pairs) WHERE actual > 0 AND {where} GROUP BY 1, 2) x GROUP BY 2 {extra}""".replace(f"{name} AS name, CAST", "name, CAST", 1)  # noqa: E731
cte("au_w", _AUD("WINDOW", "win", "date >= (SELECT max(date) FROM ledger) - 13"), ["pairs", "ledger"])
cte("au_s", _AUD("SEGMENT_LATEST_7", "seg", "date >= (SELECT max(date) FROM ledger) - 6", "HAVING sum(s) >= 5"), ["pairs", "ledger"])


@query(
    "ln_audit",
    with_(
        "SELECT section, name, samples, " + ", ".join(f"round({c}, 4) AS {c}" for c in _AU) + """ FROM (SELECT * FROM au_w UNION ALL SELECT * FROM au_s UNION ALL
        SELECT 'DELTA', 'latest_vs_previous', a.samples, a.mae - b.mae, a.mape_daily - b.mape_daily, a.bias - b.bias, a.hit_rate - b.hit_rate FROM au_w a, au_w b WHERE a.name = 'latest_7_days' AND b.name = 'previous_7_days')""",
        "au_w", "au_s",
    ),
)
def ln_audit(spark, sf):
    return rounded(N.audit(ledger(spark, sf)), *_AU)


# -- item line ---------------------------------------------------------------------------------------------

def group_ledger(spark, sf):
    """Item-group ledger: forecast = previous quantity of the group."""
    from pyspark.sql import Window as W

    g = facts.group_facts(item_facts(spark, sf))
    w = W.partitionBy("entity", "item_group").orderBy("date")
    led = g.select("entity", "date", F.col("item_group").alias("item"), F.lag("quantity").over(w).alias("pred"), F.col("quantity").alias("actual"))
    return I.once(spark, sf, "group-ledger", lambda: N.errors(led))


cte("grp_led", "SELECT entity, date, item_group AS item, lag(quantity) OVER (PARTITION BY entity, item_group ORDER BY date) AS pred, quantity AS actual FROM (SELECT entity, date, item_group, sum(quantity) AS quantity FROM item_day GROUP BY ALL)", ["item_day"])


def _it(h, op):
    cte(
        f"it{h}",
        f"""SELECT entity, item, count(*) AS n, avg(pred - actual) AS ob, avg(abs(pred - actual) / nullif(actual, 0)) * 100 AS om, sum(actual) FILTER (pred > 0 AND actual > 0) / sum(pred) FILTER (pred > 0 AND actual > 0) AS r,
     count(*) FILTER (pred > 0 AND actual > 0) AS np FROM grp_led WHERE pred >= 0 AND actual >= 0 AND date {op} DATE '{SPLIT}' GROUP BY ALL HAVING count(*) >= 3""",
        ["grp_led"],
    )


_it(1, "<")
_it(2, ">=")
cte(
    "itst",
    """SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.item, b.item) AS item, CASE WHEN b.ob IS NULL THEN a.bias ELSE 0.3 * b.ob + 0.7 * coalesce(a.bias, 0) END AS overall_bias,
   CASE WHEN b.np >= 3 THEN least(greatest(0.3 * b.r + 0.7 * coalesce(a.cf, 1), 0.5), 1.5) ELSE a.cf END AS correction_factor, coalesce(b.om, a.om) AS last_mape
  FROM (SELECT *, 0.3 * ob AS bias, CASE WHEN np >= 3 THEN least(greatest(0.3 * r + 0.7, 0.5), 1.5) END AS cf FROM it1) a FULL JOIN it2 b ON b.entity = a.entity AND b.item = a.item""",
    ["it1", "it2"],
)


def item_state(spark, sf):
    g = group_ledger(spark, sf)
    keys = ["entity", "item"]
    empty = spark.createDataFrame([], "entity string, item string, overall_bias double, correction_factor double, last_mape double")
    first = N.item_step(g.where(f"date < date'{SPLIT}'"), keys, empty, 0.5, 1.5)
    return I.once(spark, sf, "item-state", lambda: N.item_step(g.where(f"date >= date'{SPLIT}'"), keys, first, 0.5, 1.5))


@query("ln_item", with_("SELECT entity, item, round(overall_bias, 7) AS overall_bias, round(correction_factor, 7) AS correction_factor, round(last_mape, 7) AS last_mape FROM itst", "itst"))
def ln_item(spark, sf):
    return rounded(item_state(spark, sf), "overall_bias", "correction_factor", "last_mape", n=7)


@query(
    "ln_item_apply",
    with_(
        f"""SELECT g.entity, CAST(g.date AS VARCHAR) AS date, g.item, g.pred AS forecast, CASE WHEN s.correction_factor IS NOT NULL AND g.pred > 0 THEN greatest(0.0, round_even(least(greatest(
          g.pred * s.correction_factor - CASE WHEN abs(w.value) > 2 THEN w.value * 0.5 ELSE 0 END, g.pred * 0.7::DOUBLE), g.pred * 1.3::DOUBLE), 0)) ELSE g.pred END AS corrected
        FROM grp_led g LEFT JOIN itst s ON s.entity = g.entity AND s.item = g.item LEFT JOIN (SELECT entity, dayname(date) AS weekday, 0.3 * avg(pred - actual) AS value FROM grp_led WHERE pred >= 0 GROUP BY ALL HAVING count(*) >= 3) w
        ON w.entity = g.entity AND w.weekday = dayname(g.date) WHERE g.pred IS NOT NULL""",
        "grp_led", "itst",
    ),
)
def ln_item_apply(spark, sf):
    g = group_ledger(spark, sf)
    wd = N.item_weekday(g, spark.createDataFrame([], "entity string, weekday string, value double"))
    p = g.select("entity", "date", "item", F.col("pred").alias("forecast"))
    return N.item_apply(p, item_state(spark, sf), ["entity", "item"], wd).select("entity", "date", "item", "forecast", "corrected")

