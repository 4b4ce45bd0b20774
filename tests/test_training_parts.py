"""Training rows: only the columns a fit reads, in partitions of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.operators import models


def test_training_rows_are_dealt_out(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(0, 6000, 1, 1).select(
        F.lit("R0").alias("entity"), F.date_add(F.lit("2001-01-01").cast("date"), (i % 700).cast("int")).alias("date"),
        (i % 90).alias("item"), i.cast("double").alias("x"), (i % 7).cast("double").alias("quantity"), F.lit("wide").alias("other"))
    monkeypatch.setattr(models, "parts", lambda d: -(-d.count() // 500))
    got = models._training(df, ["x"], "quantity")
    assert got.columns == ["quantity", "features"]
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 12 and max(r["count"] for r in sizes) < 1000
    assert got.agg(F.sum("quantity")).first()[0] == df.agg(F.sum("quantity")).first()[0]
    got.unpersist()


def test_boosted_item_models_learn_from_groups_of_equal_rows(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(0, 4000, 1, 4).select(
        F.lit("R0").alias("entity"), i.alias("item"), F.lit("2001-01-01").cast("date").alias("date"),
        (i % 7).cast("double").alias("x"), F.when(i % 5 > 0, i % 5).alias("z"), (i % 7 + i % 3 + (i % 5) * (i % 2)).cast("double").alias("quantity"))
    seen, fit = [], models.fit_together
    monkeypatch.setattr(models, "fit_together", lambda pairs: seen.extend(t.count() for _, t in pairs) or fit(pairs))
    got = models.item_forecast(df, df, ["x", "z"], label="quantity")
    assert seen == [35, 35, 4000]
    plain = models.gbt("quantity", iters=15, depth=5, seed=11).fit(models._assemble(df, ["x", "z"]))
    want = models.predict(plain, models._assemble(df, ["x", "z"]), "want").select("item", "want")
    both = got.join(want, "item")
    assert both.count() == 4000 and both.where("abs(m2 - want) > 1e-6").isEmpty()
