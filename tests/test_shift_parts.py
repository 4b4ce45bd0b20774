"""Shuffles of shift facts and their features have partitions in proportion to the rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidecast.operators import facts, models, profile
from tidecast.operators import features as X
from tidecast.plans import inputs as I
from tidecast.plans import q_forecast
from tidecast.plans.registry import SHARED

SF = "/root/testdata/sf0.001"


def numbers(df):
    p = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\((?:[^()]|\([^()]*\))*, (\d+)\)", p)}


def test_shift_facts_and_features_grow_with_their_rows(spark, monkeypatch):
    for m in (facts, X, q_forecast):
        monkeypatch.setattr(m, "parts", lambda *a: 37)
    assert numbers(facts.tagged_shifts(I.txn(spark, SF), profile.outliers)) == {37}
    SHARED.clear()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert numbers(q_forecast.shift_features(spark, SF)) == {37}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        SHARED.clear()


def test_wide_training_rows_have_more_partitions(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(models, "parts", lambda *a: asked.append(a[1:]) or 3)
    cols = [f"x{k}" for k in range(36)]
    df = spark.range(9).select(F.col("id").alias("entity"), *[F.lit(1.0).alias(c) for c in cols], F.lit(1.0).alias("guests"))
    for some in (cols, cols[:12]):
        models._training(df, some, "guests").unpersist()
    assert asked == [(models.PART_ROWS // 3,), ()]
