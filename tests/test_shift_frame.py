"""Shift features: facts are summed once and read twice, and one training table serves both fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import facts, models, profile
from tidecast.operators import features as X
from tidecast.plans import inputs as I
from tidecast.plans.q_forecast import shift_features
from tidecast.plans.registry import SHARED

SF = "/root/testdata/sf0.001"


def test_shifts_of_one_sum_equal_sums_of_their_own(spark):
    i = F.col("id")
    txn = spark.range(3000).select(
        F.concat(F.lit("R"), i % 3).alias("entity"), F.date_add(F.lit("2001-01-01").cast("date"), (i % 97).cast("int")).alias("date"),
        (i * 7 % 24).cast("int").alias("hour"), F.when(i % 11 > 0, (i * i % 89).cast("double")).alias("guests"))
    want = facts.shift_daily(txn, profile.outliers(facts.daily(txn)))
    got = facts.tagged_shifts(txn, profile.outliers)
    assert got.columns == want.columns and got.count() == want.count() > 500
    assert got.exceptAll(want).isEmpty() and not got.where("is_outlier_day = 1").isEmpty()


def test_features_read_the_shifts_twice(spark):
    SHARED.clear()
    f = shift_features(spark, SF)
    f.write.format("noop").mode("overwrite").save()
    lines = [x for x in f._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation [" in x]
    assert sum("o_orderkey" in x for x in lines) == 1 and sum("is_outlier_day" in x for x in lines) == 2
    SHARED.clear()


def test_pruned_fit_learns_from_the_rows_of_the_first(spark, monkeypatch):
    made, deal = [], models._training
    monkeypatch.setattr(models, "_training", lambda df, cols, *kept: made.append(cols) or deal(df, cols, *kept))
    i = F.col("id")
    cols = [f"x{k}" for k in range(8)]
    df = spark.range(400).select(
        F.lit("R0").alias("entity"), F.date_add(F.lit("2001-01-01").cast("date"), i.cast("int")).alias("date"), F.lit("MORNING").alias("shift"),
        *[(F.lit(0.0) if k else i % 9).cast("double").alias(c) for k, c in enumerate(cols)], (i % 9 * 3).cast("double").alias("guests"))
    got = models.gbt_forecast(df, df, cols, None)
    assert made == [cols]
    assert got.where("abs(forecast - guests) > 3").isEmpty()


def test_large_fits_run_one_after_another(spark, monkeypatch):
    df = spark.range(4000)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for factor, want in ((1, 4), (2, 2), (9, 1)):
        monkeypatch.setattr(models, "parts", lambda d, f=factor: n * f)
        assert models.side_by_side(df) == want
