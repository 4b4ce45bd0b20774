"""Item groups are counted on every line joined with its whole transaction and its catalog row."""

from __future__ import annotations

import datetime as dt

from tidecast.operators import facts
from tidecast.plans import inputs as I
from tidecast.plans import q_facts
from tidecast.plans.registry import QUERIES

LINES = "transaction_id string, item long, quantity double"
D0 = dt.date(2001, 1, 1)


def test_query_joins_lines_with_whole_transactions(spark, monkeypatch):
    txn = spark.createDataFrame([("R0", "T1", D0, 9), ("R1", "T2", D0, 18)], "entity string, transaction_id string, date date, hour int")
    lines = spark.createDataFrame([("T1", 1, 2.0), ("T1", 1, 2.0), ("T2", 2, 1.0)], LINES)
    names = spark.createDataFrame([(1, "a", "g"), (2, "b", "h")], "item long, item_name string, item_group string")
    for k, v in (("txn", txn), ("items", lines), ("catalog", names)):
        monkeypatch.setattr(I, k, lambda s, d, v=v: v)
    seen, join = [], facts.join_items
    monkeypatch.setattr(facts, "join_items", lambda *a: seen.append(join(*a)) or seen[-1])
    got = {tuple(r) for r in QUERIES["jn_txn_items"](spark, "").collect()}
    assert got == {("g", 2, 4.0, 1), ("h", 1, 1.0, 1)}
    assert len(seen) == 1 and seen[0].count() == 3
    assert set(seen[0].columns) == {"entity", "transaction_id", "date", "hour", "item", "quantity", "item_name", "item_group"}
    assert q_facts.item_txn(spark, "").count() == 3


def test_totals_of_repeated_and_missing_values(spark):
    rows = [("T1", "g", 1.0), ("T1", "g", None), ("T1", None, 2.0), ("T2", "g", 1.0), ("T2", "g", 1.0), ("T3", "h", None)]
    sold = spark.createDataFrame(rows, "transaction_id string, item_group string, quantity double")
    got = {tuple(r) for r in facts.group_totals(sold, 3).collect()}
    assert got == {("g", 4, 3.0, 2), (None, 1, 2.0, 1), ("h", 1, None, 1)}
