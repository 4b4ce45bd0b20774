"""As-of profiles against profiles of facts cut by hand; nothing later reaches a forecast."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import asof, profile
from tidecast.plans import inputs as I

SF = "/root/testdata/sf0.001"
START, END, STEP, LOOKBACK, HORIZON = "2000-01-01", "2001-06-30", 60, 360, 14


@pytest.fixture(scope="module")
def shift_day(spark):
    """The given facts, and entities with pauses, one day, a young and a closed one."""
    rows, d0 = [], dt.date(1999, 1, 1)
    for k in range(900):
        d = d0 + dt.timedelta(days=k)
        if k % 40 < 28:
            rows.append(("GAPS", d, "MORNING", float(5 + k % 7)))
        if k % 100 < 8:
            rows.append(("RARE", d, "EVENING", 30.0))
        if k > 360 + 20:
            rows.append(("YOUNG", d, "EVENING", float(k % 11)))
        if k < 700:
            rows.append(("SHUT", d, "MORNING", 40.0 + k % 3))
            rows.append(("SHUT", d, "EVENING", 60.0 + (k * 7) % 13))
    rows.append(("ONCE", d0 + dt.timedelta(days=400), "MORNING", 9.0))
    own = spark.createDataFrame(rows, "entity string, date date, shift string, guests double")
    return I.shift_day(spark, SF).unionByName(own).persist()


def test_profiles_equal_those_of_cut_facts(spark, shift_day):
    day = asof.day_totals(shift_day)
    got = {(r.entity, r.sim_date): r for r in asof.profiles(day, START, END, STEP, LOOKBACK).collect()}
    sim, seen = dt.date.fromisoformat(START), 0
    while sim <= dt.date.fromisoformat(END):
        cut = day.where((F.col("date") < F.lit(sim)) & (F.col("date") >= F.lit(sim - dt.timedelta(days=LOOKBACK))))
        today = str(sim - dt.timedelta(days=1))
        want = profile.classify(cut).join(profile.exclude(cut, today).drop("active_days"), "entity").join(
            profile.growth(cut, today).select("entity", "growth_30d", "trend_score"), "entity")
        means = cut.groupBy("entity").agg(*[F.avg(F.when(F.weekday("date") == i, F.col("guests"))).alias(f"w{i}") for i in range(7)])
        for w in want.join(means, "entity").collect():
            g, seen = got.pop((w.entity, sim)), seen + 1
            same = ["active_days", "category", "volume_segment", "total_gaps", "total_gap_days", "should_exclude"]
            assert [g[c] for c in same] == [w[c] for c in same], (w, g)
            assert g.exclude_reason == w.exclude_reason.split(" since")[0]
            for c in ("avg_daily", "std_daily", "cv", "growth_30d", "trend_score", "gap_ratio"):
                assert g[c] == pytest.approx(w[c], abs=1e-6), (c, w, g)
            assert g.wd_mean == pytest.approx([w[f"w{i}"] for i in range(7)])
        sim += dt.timedelta(days=STEP)
    assert seen > 50 and not got


def test_no_later_row_reaches_a_forecast(spark, shift_day):
    cal = I.calendar(spark, SF)
    run = lambda d: {tuple(r)[:4]: r.pred for r in asof.walk_forward(d, cal, START, END, STEP, LOOKBACK, HORIZON).collect()}
    clean = run(shift_day)
    late = dt.date(2000, 12, 26)  # the seventh simulation
    poisoned = run(shift_day.withColumn("guests", F.when(F.col("date") >= F.lit(late), F.col("guests") * 1000 + 77).otherwise(F.col("guests"))))
    before = {k: v for k, v in clean.items() if k[0] <= late}
    assert len(before) > 50 and all(poisoned[k] == v for k, v in before.items())
    assert any(poisoned[k] != v for k, v in clean.items() if k[0] > late)


def test_simulations_share_one_pass(spark, shift_day):
    """Twice the simulations are the same plan: no scan, join or window more."""
    count = lambda step: asof.profiles(asof.day_totals(shift_day), START, END, step, LOOKBACK)._jdf.queryExecution().executedPlan().toString()
    a, b = count(60), count(30)
    for node in ("Exchange", "Window", "Join", "Scan"):
        assert a.count(node) == b.count(node)


def test_an_empty_history(spark, shift_day):
    cal = I.calendar(spark, SF)
    assert asof.walk_forward(shift_day.limit(0), cal, START, END, STEP, LOOKBACK, HORIZON).collect() == []
