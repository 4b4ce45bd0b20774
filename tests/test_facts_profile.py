import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions import stats
from tidecast.functions.stats import grouped_quantiles
from tidecast.operators import facts, features, profile
from tidecast.operators import calendar as C

D = dt.date


def test_daily_totals(sample_history):
    d = facts.daily(sample_history).withColumn("we", F.weekday("date") >= 5)
    got = {(r["entity"], r["we"]): (r["lo"], r["hi"]) for r in d.groupBy("entity", "we").agg(F.min("guests").alias("lo"), F.max("guests").alias("hi")).collect()}
    assert got == {("R001", False): (100, 100), ("R001", True): (160, 160), ("R002", False): (30, 30), ("R002", True): (48, 48)}
    assert profile.gaps(facts.daily(sample_history)).count() == 0


def test_new_entity(new_history):
    r = profile.classify(facts.daily(new_history)).first()
    assert (r["active_days"], r["category"], r["strategy"]) == (5, "NEW", "AI_ONLY")


def test_gap_reasons(spark):
    start, rows = D(2024, 1, 1), []
    for n, gap in enumerate([6, 7, 14, 15, 30, 31, 60, 61]):
        rows += [(f"E{n}", start, 1.0), (f"E{n}", start + dt.timedelta(days=gap), 1.0)]
    g = profile.gaps(spark.createDataFrame(rows, "entity string, date date, guests double"))
    got = {r["gap_days"]: r["reason"] for r in g.collect()}
    assert got == {7: "TEMPORARY_CLOSURE", 14: "TEMPORARY_CLOSURE", 15: "EXTENDED_CLOSURE", 30: "EXTENDED_CLOSURE",
                   31: "RENOVATION", 60: "RENOVATION", 61: "LONG_CLOSURE"}


def test_outliers_need_four_days_and_spread(spark):
    mondays = [D(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(8)]
    rows = [("few", d, v) for d, v in zip(mondays, (1.0, 1.0, 900.0))] + [("flat", d, 5.0) for d in mondays]
    rows += [("odd", d, v) for d, v in zip(mondays, (10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 900.0))]
    o = profile.outliers(spark.createDataFrame(rows, "entity string, date date, guests double"))
    assert [(r["entity"], r["guests"], r["outlier_weight"]) for r in o.where("is_outlier_day = 1").collect()] == [("odd", 900.0, 0.7)]


def test_dedup_keeps_highest_and_is_idempotent(spark):
    rows = [("A", 0.0, 1), ("A", 5.0, 2), ("B", 3.0, 2), ("B", 3.0, 1)]
    t = spark.createDataFrame(rows, "transaction_id string, guests double, source int")
    once = facts.dedup_highest(t)
    assert sorted(map(tuple, once.select("transaction_id", "guests", "source").collect())) == [("A", 5.0, 2), ("B", 3.0, 1)]
    assert sorted(facts.dedup_highest(once).collect()) == sorted(once.collect())
    assert {r["transaction_id"]: r["source"] for r in facts.dedup_priority(t).collect()} == {"A": 1, "B": 1}


@pytest.mark.parametrize("fn,keys", [
    (facts.hour_ratio, ["entity", "day_kind"]), (facts.weekday_hour_ratio, ["entity", "weekday"]),
    (facts.shift_ratio, ["entity", "day_kind"]), (facts.weekday_shift_ratio, ["entity", "weekday"]),
])
def test_shares_sum_to_one(sample_history, fn, keys):
    sums = [r["s"] for r in fn(sample_history).groupBy(*keys).agg(F.sum("ratio").alias("s")).collect()]
    assert sums and all(abs(s - 1) < 1e-9 for s in sums)


def test_caps_not_below_floors(spark, sample_history):
    cal = spark.sql("select explode(sequence(date'2024-12-01', date'2025-05-01')) as date, cast(null as string) as holiday_type")
    c = profile.smart_caps(facts.daily(sample_history), cal, "2025-03-31").collect()
    assert all(r["max_daily_normal_weekday"] >= r["min_daily_normal_weekday"] and r["max_daily_normal_weekend"] >= r["min_daily_normal_weekend"] for r in c)


def test_interpolation(spark):
    rows = [("E", D(2024, 1, 1), 10.0), ("E", D(2024, 1, 7), 70.0), ("E", D(2024, 1, 8), 5.0)]
    f = features.interpolate(spark.createDataFrame(rows, "entity string, date date, guests double")).orderBy("date")
    assert [round(r["guests"], 6) for r in f.collect()] == [10, 20, 30, 40, 40, 40, 70, 5]


def test_holiday_groups(spark):
    cal = spark.createDataFrame(
        [(D(2025, 4, 30), "LIBERATION_DAY"), (D(2025, 5, 1), "LABOR_DAY"), (D(2025, 9, 2), "NATIONAL_DAY"), (D(2025, 9, 3), None)],
        "date date, holiday_type string")
    got = sorted((r["period_type"], str(r["start"]), r["duration"]) for r in C.group_holidays(cal).collect())
    assert got == [("LIBERATION_DAY", "2025-04-30", 2), ("NATIONAL_DAY", "2025-09-02", 1)]


@pytest.mark.parametrize("hot", [False, True])
def test_grouped_quantiles_equal_numpy(spark, hot):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=301), "b": np.full(7, 2.5), "c": rng.exponential(size=2) * 1e6}
    if hot:
        data["a"] = np.concatenate([np.zeros(5000), data["a"], [1e9]])
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    q = grouped_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p5": 0.05, "p50": 0.5, "p95": 0.95})
    for r in q.collect():
        for name, p in (("p5", 5), ("p50", 50), ("p95", 95)):
            assert r[name] == pytest.approx(np.percentile(data[r["k"]], p), rel=1e-9, abs=1e-12)


def test_no_cell_is_crowded_by_outliers_and_heavy_tails(spark):
    """Exact ranks, and no task orders more than a small share of a key's values."""
    rng = np.random.default_rng(1)
    sets = {
        "outlier": np.append(rng.random(20_000) * 3, 5000.0),
        "tail": np.exp(rng.normal(0, 4, 20_000)),
        "repeated": np.append(np.full(20_000, 7.0), rng.random(500)),
    }
    rows = [(k, float(v)) for k, x in sets.items() for v in x]
    df = spark.createDataFrame(rows, "k string, v double")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    got = stats.grouped_quantiles(df, ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9})
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for r in got.collect():
        assert np.allclose([r.q1, r.m, r.q9], np.quantile(sets[r.k], [0.25, 0.5, 0.9]), rtol=1e-12)
    for r in stats.deal_out(df, ["k"], "v", 128).groupBy("k", "__cell").count().collect():
        assert r["count"] <= 0.03 * len(np.unique(sets[r.k])) + 2


def test_entity_impacts_make_the_holiday_ratios_once(spark, monkeypatch):
    from tidecast.plans import catalog
    from tidecast.plans import q_profile as Q

    made, paths = [], Q._ratios
    monkeypatch.setattr(Q, "_ratios", lambda *a: made.append(paths(*a)) or made[-1])
    out = catalog.QUERIES["cal_holiday_per_entity"](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "percentile(" not in plan and not out.isEmpty()
