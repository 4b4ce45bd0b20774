"""Values next to a rounding half: the same bits on every run, and as the SQL computes them."""

from __future__ import annotations

import datetime as dt


from tidecast.operators import calendar as C
from tidecast.operators import facts
from tidecast.operators import forecast as P


def test_blend_multiplies_from_the_left(spark):
    row = (55.0, None, 55.0, 45.285714285714285, 0.3, 0.7)
    df = spark.createDataFrame([row], "ml double, neural double, seasonal double, ai double, ml_weight double, ai_weight double")
    value = 55.0 * 0.3 * 0.6 + 55.0 * 0.3 * 0.2 + 45.285714285714285 * 0.7
    assert P.blend(df).first()["combined"] == value / (0.3 * 0.6 + 0.3 * 0.2 + 0.7)


def test_holiday_factors_are_decimals(spark):
    days = [(dt.date(1999, 8, 20) + dt.timedelta(i), "Quốc khánh" if i == 13 else None, 5, 1) for i in range(25)]
    cal = C.events(C.classify(spark.createDataFrame(days, "date date, holiday_name string, lunar_day int, lunar_month int")))
    got = {r["date"].day: r["holiday_impact"] for r in C.day_info(cal).where("is_post_holiday and not is_special_event").collect()}
    assert {d: got[d] for d in (5, 6, 7)} == {5: 0.95, 6: 0.975, 7: 1.0}


def test_hour_shares_are_added_by_the_hour(spark):
    rows = [(f"E{e}", "T", float(1 + (h * h * 7 + e * 13) % 29), dt.date(1999, 8, 20), h) for e in range(40) for h in reversed(range(6, 24))]
    txn = spark.createDataFrame(rows, "entity string, transaction_id string, guests double, date date, hour int")
    got = {(r["entity"], r["hour"]): r["ratio"] for r in facts.hour_ratio(txn).where("day_kind = 'weekday'").collect()}
    for e in range(40):
        v = {h: g for x, _, g, _, h in rows if x == f"E{e}"}
        r = {h: v[h] / sum(v.values()) for h in sorted(v)}
        r = {h: x for h, x in r.items() if x > 0.01}
        total = 0.0
        for x in r.values():  # sum() would compensate
            total += x
        assert {h: x / total for h, x in r.items()} == {h: x for (n, h), x in got.items() if n == f"E{e}"}
