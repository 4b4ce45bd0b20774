from __future__ import annotations

import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidecast.plans import daily
from tidecast.plans import inputs as I
from tidecast.plans.q_daily import run_inputs

SF = "/root/testdata/sf0.001"


def test_announced_closings_and_long_dates(spark):
    """Days from an announced closing on are zero; the ensemble's dates beyond 30 days come by day."""
    inp = run_inputs(spark, SF)
    gone = dt.date(2001, 8, 20)
    some = inp.txn.select("entity").distinct().withColumn("future_close_date", F.lit(gone))
    inp = replace(inp, future_close=some)
    rows = daily.forecast_rows(inp, I.AS_OF, 33).select("entity", "date", "shift", "forecast", "route").collect()
    assert {r.forecast for r in rows if r.date >= gone} == {0.0}
    assert any(r.forecast > 0 for r in rows if r.date < gone)
    last = dt.date(2001, 8, 31)
    assert all((r.shift is None) == (r.route == "ensemble" and r.date > last) for r in rows)
    assert any(r.shift is None for r in rows)
    assert len({(r.entity, r.date, r.shift) for r in rows}) == len(rows)


def test_facts_behind_the_day_are_cut_first(spark, monkeypatch):
    """The first thing the run makes of its transactions, from which all else follows."""

    class Seen(Exception):
        pass

    def capture(txn):
        raise Seen(txn.agg(F.max("date")).first()[0])

    monkeypatch.setattr(daily.facts, "daily", capture)
    inp = replace(run_inputs(spark, SF), entity_state=None)
    for call in (daily.forecast_rows, daily.run):
        with pytest.raises(Seen) as seen:
            call(inp, "2001-02-01", 10)
        assert seen.value.args[0] <= dt.date(2001, 2, 1)


@pytest.mark.skipif("TIDECAST_ALL" not in os.environ, reason="two whole runs")
def test_a_replay_of_an_earlier_day_sees_no_later_row(spark):
    """Half a year before the facts end: what comes after that day changes nothing."""
    day = "2001-02-01"
    inp = replace(run_inputs(spark, SF), booking=None, entity_state=None, schedule=None)
    later = F.col("date") > F.lit(day).cast("date")
    poisoned = replace(inp, txn=inp.txn.withColumn("guests", F.when(later, F.col("guests") * 100 + 7).otherwise(F.col("guests"))))
    run = lambda x: sorted(map(tuple, daily.forecast_rows(x, day, 10).select("entity", "date", "shift", "forecast", "route").collect()), key=str)
    clean = run(inp)
    assert clean and clean == run(poisoned)
