"""Item fits on many rows run one after another."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import models


def test_large_item_fits_run_one_after_another(spark, monkeypatch):
    at_once, most, fit = [0], [0], models.fit_or_none

    def watched(estimator, rows):
        at_once[0] += 1
        most[0] = max(most[0], at_once[0])
        try:
            return fit(estimator, rows)
        finally:
            at_once[0] -= 1

    monkeypatch.setattr(models, "fit_or_none", watched)
    monkeypatch.setattr(models, "side_by_side", lambda rows: 1)
    df = spark.range(200).select(F.lit("R0").alias("entity"), F.col("id").alias("item"), F.lit("2001-01-01").cast("date").alias("date"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("quantity"))
    assert models.item_forecast(df, df, ["x"]).count() == 200
    assert most == [1]
