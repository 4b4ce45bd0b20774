"""Keyed bias state of a stream against the same days folded at once."""

import datetime as dt
import random

import pandas as pd
import pytest

from tidecast.session import fresh_path
from tidecast.streaming import jobs, state

D0 = dt.date(2024, 3, 1)


def plain(rows):
    """(bias, days) per entity."""
    by = {}
    for e, d, x in rows:
        if x is not None:
            by.setdefault(e, {}).setdefault(d, []).append(x)
    out = {}
    for e, days in by.items():
        bias = 0.0
        for d in sorted(days):
            bias = 0.3 * sum(days[d]) / len(days[d]) + 0.7 * bias
        out[e] = (pytest.approx(bias), len(days))
    return out


def run(spark, deliveries, delay, **how):
    """One file and one batch for each delivery."""
    staged, out = fresh_path(spark, "errors"), fresh_path(spark, "bias")
    for k, rows in enumerate(deliveries):
        df = spark.createDataFrame(rows, "entity string, date date, error double").coalesce(1)
        df.write.mode("append").parquet(f"{staged}")
        stream = jobs.file_stream(spark, staged, df.schema, files_per_batch=1)
        state.track(stream, out, f"{out}-checkpoint", delay, **how)
    return {r.entity: r for r in state.newest(spark, out).collect()}


def rows_of(n, seed=1):
    rng = random.Random(seed)
    return [(e, D0 + dt.timedelta(days=k), rng.choice([rng.uniform(-9, 9), rng.uniform(-9, 9), None])) for k in range(n) for e in "ABB" if rng.random() < 0.8]


def test_shuffled_deliveries_equal_the_batch_twin(spark):
    rows = rows_of(24)
    random.Random(2).shuffle(rows)
    got = run(spark, [rows[k::3] for k in range(3)], "400 days")
    assert {e: (r.bias, r.days) for e, r in got.items()} == plain(rows)
    assert all(r.closed == 0 for r in got.values())


def test_days_close_at_the_watermark_and_late_rows_do_not_count(spark):
    rows = rows_of(30)
    cut = [D0 + dt.timedelta(days=k) for k in (10, 20, 30)]
    deliveries = [[r for r in rows if (cut[k - 1] if k else D0) <= r[1] < cut[k]] for k in range(3)]
    late = ("A", D0 + dt.timedelta(days=2), 1000.0)
    got = run(spark, [*deliveries[:2], deliveries[2] + [late]], "3 days")
    want = plain(rows)
    assert {e: (r.bias, r.days) for e, r in got.items()} == want
    assert all(r.days - r.closed <= 15 and r.closed >= 10 for r in got.values())


def test_an_idle_entity_leaves_the_state(spark):
    rows = [("A", D0, 4.0), ("B", D0, 2.0)]
    later = [[("B", D0 + dt.timedelta(days=k), 2.0)] for k in (1, 60, 61)]
    again = [("A", D0 + dt.timedelta(days=62), 10.0)]
    got = run(spark, [rows, *later, again], "1 day", idle_days=20)
    assert got["A"].days == 1 and got["A"].bias == pytest.approx(3.0)


class Calls:
    """Stands for the handle and its one value; counts what would be sent to the state store."""

    def __init__(self):
        self.n, self.value = 0, None

    def getValueState(self, name, schema):
        return self

    getMapState = getValueState

    def registerTimer(self, at):
        self.n += 1

    def exists(self):
        return self.value is not None

    def get(self):
        self.n += 1
        return self.value

    def update(self, value):
        self.n, self.value = self.n + 1, value

    def containsKey(self, key):
        self.n += 1
        return False

    def updateValue(self, key, value):
        self.n += 1

    def iterator(self):
        return iter(())


def test_calls_to_the_state_do_not_grow_with_the_days():
    def calls(days):
        got, p = Calls(), state.BiasProcessor(0.3, 400)
        p.init(got)
        for k in range(2):
            part = pd.DataFrame({"day": range(k * days, (k + 1) * days), "error": [1.0] * days})
            list(p.handleInputRows(("A",), iter([part]), None))
        return got.n

    assert calls(300) == calls(3)
