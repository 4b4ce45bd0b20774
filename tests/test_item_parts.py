"""Shuffles of item lines have partitions in proportion to the lines, and lines are read once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidecast.operators import facts
from tidecast.plans import catalog
from tidecast.plans import inputs as I
from tidecast.session import PART_ROWS, parts

SF = "/root/testdata/sf0.001"


def exchanges(df):
    p = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", p)], p


def lines(spark, n):
    i = F.col("id")
    txn = spark.range(n // 4).select(
        (i % 3).cast("string").alias("entity"), i.cast("string").alias("transaction_id"),
        F.date_add(F.lit("2001-01-01").cast("date"), (i % 50).cast("int")).alias("date"), (9 + i % 9).cast("int").alias("hour"))
    items = spark.range(n).select((i % (n // 4)).cast("string").alias("transaction_id"), (i % 90).alias("item"), F.lit(1.0).alias("quantity"))
    names = spark.range(90).select(i.alias("item"), F.lit("n").alias("item_name"), F.lit("g").alias("item_group"))
    return txn, items, names


def test_partitions_grow_with_the_lines(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in (4_000, (few + 3) * PART_ROWS):
            t, i, c = lines(spark, n)
            want = max(few, n // PART_ROWS)
            assert parts(i) == want
            for shift in (False, True):
                assert set(exchanges(facts.item_facts(t, i, c, shift))[0]) == {want}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_grow_with_the_lines(spark, monkeypatch):
    assert I.buckets(spark, SF) == I.BUCKETS
    monkeypatch.setattr(I, "parts", lambda df: 40)
    assert I.buckets(spark, SF) == 40


def test_item_forecast_reads_the_lines_once(spark):
    p = exchanges(catalog.QUERIES["fc_weekday_avg"](spark, SF))[1]
    assert p.count("lineitem.parquet") == 1
