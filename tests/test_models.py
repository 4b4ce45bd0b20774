"""Closed-form fits, stacking weights and tuning; every model on empty and one-date inputs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import features as X
from tidecast.operators import linear
from tidecast.operators import models as D

DAY = "entity string, date date, guests double"
D0 = dt.date(2024, 1, 1)


def series(n, f, entity="A"):
    return [(entity, D0 + dt.timedelta(days=k), float(f(k))) for k in range(n)]


def test_solve_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, k = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    y = x @ [1, -2, 0.5, 0, 3] + rng.normal(size=60)
    rows = [(int(g), *map(float, r), float(v)) for g, r, v in zip(k, x, y, strict=True)]
    names = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names) + ", y double")
    ridge = [0.1, 0.2, 0.3, 0.4, 0.5]
    for r in linear.gram(df, ["k"], names, "y").select("k", "n", linear.solve(F.col("m"), ridge).alias("c")).collect():
        part = x[k == r.k]
        assert r.n == len(part)
        assert np.allclose(r.c, np.linalg.solve(part.T @ part + np.diag(ridge), part.T @ y[k == r.k]))


def test_non_negative_weights_beat_any_others():
    rng = np.random.default_rng(5)
    for trial in range(40):
        x = rng.normal(size=(30, 3)) + (1 if trial % 2 else 0)
        y = x @ rng.normal(size=3) + rng.normal(size=30)
        w = linear.non_negative(x.T @ x, x.T @ y)
        assert (w >= 0).all()
        error = lambda v: ((x @ v - y) ** 2).sum()
        assert all(error(w) <= error(np.abs(rng.normal(size=3)) * rng.integers(0, 2, 3) * s) + 1e-9 for s in (0.3, 1, 2) for _ in range(50))
    same = np.ones((3, 3))
    assert np.isclose(linear.non_negative(same, np.array([2.0, 2.0, 2.0])).sum(), 2)


def test_season_of_each_entity_is_its_own(spark):
    """Two entities with opposite weekly patterns and trends, forecast eight weeks ahead."""
    a = lambda k: 100 + 0.05 * k + 30 * math.sin(2 * math.pi * (D0.toordinal() + k) / 7)
    b = lambda k: 60 - 0.02 * k - 20 * math.sin(2 * math.pi * (D0.toordinal() + k) / 7)
    day = spark.createDataFrame(series(730, a) + series(730, b, "B") + series(10, a, "C"), DAY)
    h = [(e, D0 + dt.timedelta(days=k)) for e in "ABC" for k in range(730, 786)]
    got = D.seasonal_forecast(day, spark.createDataFrame(h, "entity string, date date")).collect()
    assert {r.entity for r in got} == {"A", "B"} and len(got) == 112
    for r in got:
        assert r.forecast == pytest.approx({"A": a, "B": b}[r.entity]((r.date - D0).days), rel=0.04)


def test_autoregression_serves_what_it_learned(spark):
    """A level shift on the last day moves the next days only as far as the days learned say."""
    rng = random.Random(1)
    rows = [r for e in "ABCDEF" for r in series(300, lambda k, e=e: 50 + 20 * (k % 7 >= 5) + rng.gauss(0, 3), e)]
    jump = [(e, d, v + 60 if e == "A" and d == D0 + dt.timedelta(days=299) else v) for e, d, v in rows]
    cal = spark.createDataFrame([(D0 + dt.timedelta(days=k), False, 1.0) for k in range(400)], "date date, is_holiday boolean, holiday_impact double")
    h = spark.createDataFrame([(e, D0 + dt.timedelta(days=k)) for e in "AB" for k in range(290, 330)], "entity string, date date")
    run = lambda x: {(r.entity, r.date): r.forecast for r in D.global_forecast(spark.createDataFrame(x, DAY), cal, h).collect()}
    plain, moved = run(rows), run(jump)
    assert min(d for _, d in plain) == D0 + dt.timedelta(days=300) and len(plain) == 60
    for (e, d), v in plain.items():
        k = (d - D0).days
        assert v == pytest.approx(50 + 20 * (k % 7 >= 5), abs=8)
        if e == "A" and k > 305:
            assert abs(moved[e, d] - v) < 12  # one odd day does not set the whole horizon


EMPTY = "entity string, date date, shift string, guests double"


@pytest.mark.parametrize("rows", [[], [("A", D0, "MORNING", 5.0), ("A", D0, "EVENING", 7.0)]])
def test_models_without_history(spark, rows):
    cols = ["shift_id", "x1"]
    f = spark.createDataFrame(rows, EMPTY).withColumns({c: F.lit(1.0) for c in ["shift_id", "x1", "weekday", "is_weekend", "is_holiday", "holiday_impact"]})
    h = f.withColumn("date", F.date_add("date", 1))
    stacked = D.stack_forecast(f, h, cols).collect()
    assert len(stacked) == len(rows)
    assert all(r.w_gbt + r.w_forest + r.w_linear == pytest.approx(1) and r.forecast is not None for r in stacked)
    item = f.withColumn("quantity", F.col("guests"))
    assert len(D.meta_forecast(item, item, cols, ["weekday"]).collect()) == len(rows)
    assert len(D.gbt_forecast(f, h, cols, None).collect()) == len(rows)
    tuned = D.tune(f, cols, [{"iters": 2, "depth": 2}, {"iters": 3, "depth": 2}]).collect()
    assert all(r.mae is None and not r.best for r in tuned)
    day = f.groupBy("entity", "date").agg(F.sum("guests").alias("guests"))
    assert D.seasonal_forecast(day, h.select("entity", "date")).collect() == []
    cal = spark.createDataFrame([(D0, False, 1.0)], "date date, is_holiday boolean, holiday_impact double")
    assert D.global_forecast(day, cal, h.select("entity", "date")).collect() == []
    feats = day.select("entity", F.col("guests").alias("avg_daily"), F.lit(1.0).alias("weekend_ratio"), F.lit(1.0).alias("volatility"))
    assert len(D.clusters(feats, 2)[0].collect()) == feats.count()


def _learnable(spark):
    rng = random.Random(3)
    rows = [("A", D0 + dt.timedelta(days=k), "MORNING", float(20 + 10 * (k % 7) + rng.gauss(0, 1)), float(k % 7)) for k in range(200)]
    return spark.createDataFrame(rows, EMPTY + ", x1 double").withColumn("shift_id", F.lit(0.0))


def test_no_fold_learns_from_itself(spark):
    """Rows from the second origin on are poisoned: the predictions of the fold before stay."""
    f = _learnable(spark)
    late = D0 + dt.timedelta(days=159)
    bad = f.withColumn("guests", F.when(F.col("date") >= F.lit(late), 1e6).otherwise(F.col("guests")))
    make = {"p": lambda: D.gbt(iters=3, depth=3)}
    run = lambda x: {r.date: r.p for r in D.cross_fitted(D._assemble(x, ["x1"]), make, "guests", [0.6, 0.8]).collect()}
    a, b = run(f), run(bad)
    assert min(a) == D0 + dt.timedelta(days=119) and len(a) == 81
    assert all(a[d] == pytest.approx(b[d]) for d in a)


def test_halving_finds_the_winner_of_the_full_grid(spark):
    f = _learnable(spark)
    grid = [{"iters": 1, "depth": 1}, {"iters": 8, "depth": 3}, {"iters": 1, "depth": 2}, {"iters": 2, "depth": 1}]
    full = {r.params: r for r in D.tune(f, ["x1"], grid, halve=False).collect()}
    half = {r.params: r for r in D.tune(f, ["x1"], grid).collect()}
    win = [i for i, r in full.items() if r.best]
    assert win == [i for i, r in half.items() if r.best] == [1]
    assert [half[i].folds for i in range(4)].count(1) == 2 and half[1].folds == 3
    assert half[1].mae == pytest.approx(full[1].mae)


def test_sums_of_the_autoregression_equal_its_rows(spark):
    """Entities that begin and end anywhere: the sums by date are those of a row per day and entity."""
    rng = random.Random(6)
    rows = [(e, D0 + dt.timedelta(days=k), rng.uniform(0, 3), n) for e, (a, n) in {"A": (0, 60), "B": (9, 33), "C": (40, 14), "D": (3, 15)}.items() for k in range(a, a + n)]
    df = spark.createDataFrame(rows, "entity string, date date, y double, n long")
    got = D.ar_gram(D.ar_moments(df).withColumn("one", F.lit(1.0)).withColumn("t", F.unix_date("date") / 1e4), ["one", "t"]).first()
    x, y = [], []
    for e in "ABCD":
        s = [(r[1], r[2]) for r in rows if r[0] == e]
        for k in range(D.LAGS, len(s)):
            x.append([s[k - i][1] for i in range(1, D.LAGS + 1)] + [1.0, (s[k][0] - dt.date(1970, 1, 1)).days / 1e4])
            y.append(s[k][1])
    x, y = np.array(x), np.array(y)
    m = np.array(got["m"], float)
    assert got["n"] == len(y) == 46 + 19 + 0 + 1
    assert np.allclose(m[:, :-1], x.T @ x) and np.allclose(m[:, -1], x.T @ y)
