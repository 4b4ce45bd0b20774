"""Skeletons of future rows and joins that shape them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFTS = ["MORNING", "EVENING"]


def skeleton(entities: DataFrame, cal: DataFrame, start: str, days: int, shifts: bool = False) -> DataFrame:
    """entity x future date (x shift), with the calendar attributes of the date.

    Each entity row unfolds its own dates, so nothing but the small calendar is joined."""
    s = F.lit(start).cast("date")
    h = entities.select("entity", F.explode(F.sequence(s, F.date_add(s, days - 1))).alias("date"))
    h = h.join(F.broadcast(cal), "date")
    if shifts:
        h = h.withColumn("shift", F.explode(F.array(*[F.lit(x) for x in SHIFTS])))
    return h


def exclude_windows(txn: DataFrame, windows: DataFrame) -> DataFrame:
    """Drop facts inside an entity's closure windows [from_date, to_date).

    Windows unfold to (entity, date) rows, so this is an anti join on equal keys."""
    days = windows.select(
        "entity", F.explode(F.sequence("from_date", F.date_sub("to_date", 1))).alias("date")
    ).distinct()
    return txn.join(days, ["entity", "date"], "left_anti")
