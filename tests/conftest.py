from __future__ import annotations

import datetime as dt

import pytest

from tidecast.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("tidecast-tests", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_history(spark):
    """Two entities, 90 days, two shifts: base 100 and 30, weekend x1.6, shares .4/.6."""
    rows = []
    for code, base in (("R001", 100), ("R002", 30)):
        for i in range(90):
            d = dt.date(2025, 1, 1) + dt.timedelta(days=i)
            f = 1.6 if d.weekday() >= 5 else 1.0
            for hour, share in ((10, 0.4), (18, 0.6)):
                rows.append((code, f"{code}-{i}-{hour}", float(round(base * f * share)), d, hour))
    return spark.createDataFrame(rows, "entity string, transaction_id string, guests double, date date, hour int")


@pytest.fixture(scope="session")
def new_history(spark):
    """Five evenings of one new entity."""
    rows = [("R999", f"n{i}", float(20 + i), dt.date(2025, 6, 1) + dt.timedelta(days=i), 18) for i in range(5)]
    return spark.createDataFrame(rows, "entity string, transaction_id string, guests double, date date, hour int")
