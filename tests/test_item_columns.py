"""The item models learn from every numeric column with data but the identifiers."""

from __future__ import annotations

import datetime as dt

from tidecast.operators import features as X
from tidecast.operators import models
from tidecast.plans import q_models
from tidecast.plans.registry import QUERIES, SHARED

D0 = dt.date(2000, 12, 1)


def test_columns_are_numbers_with_data(spark):
    df = spark.createDataFrame([("A", 7, D0, 1.0, 2, None, "x", True)], "entity string, item long, date date, quantity double, n int, gone double, name string, flag boolean")
    assert models.feature_columns(df, ["entity", "item", "quantity"]) == ["n"]
    assert models.feature_columns(df.where("n > 2"), ["entity", "item", "quantity"]) == []


def test_item_models_read_the_whole_frame(spark, monkeypatch):
    rows = [("A", i, f"n{i}", "g", D0 + dt.timedelta(days=k), float(k % 7 + i), 1) for i in (1, 2) for k in range(60)]
    item = spark.createDataFrame(rows, "entity string, item long, item_name string, item_group string, date date, quantity double, orders long")
    monkeypatch.setattr(q_models, "item_day", lambda s, d: item)
    seen, fit = [], models.item_forecast
    monkeypatch.setattr(models, "item_forecast", lambda t, f, cols, *a: seen.append((t.count(), cols)) or fit(t, f, cols, *a))
    SHARED.clear()
    got = QUERIES["fc_item_models"](spark, "")
    assert got.count() == 58 and got.where("forecast is null").isEmpty()
    (n, cols), = seen
    frame = X.series_frame(item, ["entity", "item"], "quantity")
    left = {"entity", "item", "item_name", "item_group", "date", "quantity", "orders"}
    # 31 days have no row 56 days or a year before
    assert n == 62 and set(cols) == set(frame.columns) - left - {"quantity_yoy", "quantity_yoy_growth"}
    assert {"quantity_std_14", "quantity_lag28", "momentum", "dow_sin", "week_of_year"} < set(cols)
    SHARED.clear()
