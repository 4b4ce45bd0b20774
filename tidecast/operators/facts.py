"""Transactions to facts: cleaning, dedupe, hourly / shift / daily / item aggregates.

Raw rows are only ever grouped (partial aggregation runs before each shuffle, so a hot
entity or a repeated id does not pile up in one task). Windows run on facts that are
already one row per entity and day, whose group size is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions.clean import (
    clean_id, norm_key, not_cancelled, num_coerce, parse_hour, shift_of,
)
from tidecast.functions.stats import is_weekend, ratio
from tidecast.operators.horizon import SHIFTS
from tidecast.session import dealt, parts

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def in_range(df: DataFrame, col: str, start: str, end: str) -> DataFrame:
    """Half-open date range; on a scan this is pushed to the files or the database."""
    return df.where((F.col(col) >= F.lit(start).cast("date")) & (F.col(col) < F.lit(end).cast("date")))


def normalise_source(
    df: DataFrame, source: int, entity: str, txn_id: str, guests: str, opened: str, day: str,
    revenue: str | None = None,
) -> DataFrame:
    """One delivered transaction table to the common schema."""
    cols = [
        norm_key(F.col(entity)).alias("entity"),
        clean_id(F.col(txn_id)).alias("transaction_id"),
        num_coerce(F.col(guests)).alias("guests"),
        F.try_to_timestamp(F.col(opened).cast("string")).alias("open_time"),
        F.col(day).alias("date"),
        F.lit(source).alias("source"),
    ]
    if revenue:
        cols.insert(3, num_coerce(F.col(revenue)).alias("revenue"))
    return df.select(*cols)


def source_a(raw: DataFrame, revenue: bool = False) -> DataFrame:
    return normalise_source(
        raw, 1, "restaurant_code", "order_guid", "guest_count", "pos_open_transaction_time",
        "shift_date", "total_pay_sum" if revenue else None,
    )


def source_b(raw: DataFrame, revenue: bool = False) -> DataFrame:
    return normalise_source(
        raw, 2, "restaurant_code", "transaction_id", "guest_count", "open_time", "shiftdate",
        "paysum" if revenue else None,
    )


def union_txn(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def _keep_one(df: DataFrame, key: str, order: list[Column], names: list[str]) -> DataFrame:
    """Row with the greatest ``order`` per key, as an aggregate: copies of one id are
    reduced map-side instead of meeting in one window."""
    rest = [c for c in df.columns if c != key]
    best = F.max(F.struct(*[o.alias(n) for o, n in zip(order, names)], F.struct(*rest).alias("row")))
    return df.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.row.{c}").alias(c) for c in rest])


def dedup_highest(txn: DataFrame) -> DataFrame:
    """One row per transaction id: highest measure, then first source."""
    return _keep_one(txn, "transaction_id", [F.col("guests"), -F.col("source")], ["g", "s"])


def dedup_priority(txn: DataFrame) -> DataFrame:
    """One row per transaction id: first source wins."""
    return _keep_one(txn, "transaction_id", [-F.col("source"), F.col("guests")], ["s", "g"])


def with_open_time(txn: DataFrame) -> DataFrame:
    """Drops rows without a readable time; date and hour follow the opening time."""
    t = F.col("open_time")
    return txn.where(t.isNotNull()).withColumns(
        {"date": F.to_date(t), "hour": F.hour(t), "weekday": F.date_format(t, "EEEE")}
    )


def drop_cancelled(raw: DataFrame) -> DataFrame:
    return raw.where(not_cancelled(F.col("cancelled_reason")))


def clean_booking(raw: DataFrame) -> DataFrame:
    """Typed bookings with a positive number of guests; the hour may stay null."""
    d = F.to_date(F.try_to_timestamp(F.col("shift_date").cast("string")))
    return (
        raw.select(
            norm_key(F.col("restaurant")).alias("entity"),
            d.alias("date"),
            F.date_format(d, "EEEE").alias("weekday"),
            parse_hour(F.col("start_time")).alias("hour"),
            num_coerce(F.col("total_guest")).cast("int").alias("guests"),
        )
        .where(F.col("date").isNotNull() & (F.col("guests") > 0))
    )


def clean_entity_dim(raw: DataFrame) -> DataFrame:
    """One row per normalised key; the smallest code and name stand for a repeated key."""
    first = F.min(F.struct("sap_code", "restaurant_name")).alias("f")
    return (
        raw.groupBy(norm_key(F.col("restaurant_code")).alias("merge_key")).agg(first)
        .select("merge_key", "f.sap_code", "f.restaurant_name")
    )


# -- aggregates ---------------------------------------------------------------------


def daily(txn: DataFrame) -> DataFrame:
    return txn.groupBy("entity", "date").agg(F.sum("guests").alias("guests"))


def with_weekday(df: DataFrame) -> DataFrame:
    return df.withColumn("weekday", F.date_format("date", "EEEE"))


def shift_daily(txn: DataFrame, tagged_day: DataFrame) -> DataFrame:
    """Per entity, date and shift with the day's outlier flag and weight; OTHER left out. The flags
    meet the sums, not the transactions."""
    sums = (
        txn.withColumn("shift", shift_of(F.col("hour")))
        .where(F.col("shift") != "OTHER")
        .groupBy("entity", "date", "shift")
        .agg(F.sum("guests").alias("guests"))
    )
    flags = tagged_day.select("entity", "date", "is_outlier_day", "outlier_weight")
    return sums.join(flags, ["entity", "date"], "left").fillna({"is_outlier_day": 0, "outlier_weight": 1.0})


def tagged_shifts(txn: DataFrame, tag) -> DataFrame:
    """Rows of :func:`shift_daily` from one sum: days carry the sums of their shifts while ``tag`` flags them.
    Transactions and days are dealt out in partitions that grow with them."""
    shift, n = shift_of(F.col("hour")), parts(txn)
    sums = {x: (F.count_if(shift == x).alias(f"n_{x}"), F.sum(F.when(shift == x, F.col("guests"))).alias(f"g_{x}")) for x in SHIFTS}
    day = dealt(txn, n, "entity", "date").groupBy("entity", "date").agg(F.sum("guests").alias("guests"), *[c for pair in sums.values() for c in pair])
    day = tag(dealt(day, n, "entity"))
    rows = [F.when(F.col(f"n_{x}") > 0, F.struct(F.lit(x).alias("shift"), F.col(f"g_{x}").alias("guests"))) for x in SHIFTS]
    return day.select("entity", "date", F.inline(F.array_compact(F.array(*rows))), "is_outlier_day", "outlier_weight")


def guest_facts(txn: DataFrame, by_shift: bool = False) -> DataFrame:
    """Distinct transactions and guests per entity and date (and shift)."""
    keys = ["entity", "date"] + (["shift"] if by_shift else [])
    if by_shift:
        txn = txn.withColumn("shift", shift_of(F.col("hour"))).where(F.col("shift") != "OTHER")
    return with_weekday(
        txn.groupBy(*keys).agg(
            F.count_distinct("transaction_id").alias("transactions"), F.sum("guests").alias("guests")
        )
    )


def join_items(txn: DataFrame, items: DataFrame, catalog: DataFrame, n: int | None = None) -> DataFrame:
    """Item lines with their transaction and catalog attributes; the shuffles have ``n`` partitions."""
    if n:
        items, txn, catalog = items.repartition(n, "transaction_id"), txn.repartition(n, "transaction_id"), catalog.repartition(n, "item")
    return items.join(txn, "transaction_id").join(catalog, "item")


def group_totals(sold: DataFrame, n: int) -> DataFrame:
    """Lines, quantity and distinct orders per item group from joined item lines (:func:`join_items`).

    Lines are summed per order and group first, in ``n`` partitions, so that orders are rows to count."""
    order = sold.repartition(n, "transaction_id").groupBy("transaction_id", "item_group").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity")
    )
    return order.groupBy("item_group").agg(
        F.sum("lines").alias("lines"), F.sum("quantity").alias("quantity"), F.count("transaction_id").alias("orders")
    )


def order_items(items: DataFrame) -> DataFrame:
    """Lines summed per transaction and item, dealt out as the join with transactions needs them."""
    return items.groupBy("transaction_id", "item").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("lines"))


def item_facts(txn: DataFrame, items: DataFrame, catalog: DataFrame, by_shift: bool = False, dealt: bool = False) -> DataFrame:
    """Quantity and distinct orders per entity, date, item (and shift).

    Lines are summed per transaction and item before the join, in the join's own partitioning, so
    that the orders of an item are rows to count; transactions are one row per id. The catalog
    meets the facts only. Every shuffle has partitions in proportion to the lines; ``dealt``: lines
    and transactions come from stores, in the same buckets.
    """
    n = parts(items)
    keys = ["entity", "date", "item"] + (["shift"] if by_shift else [])
    if by_shift:
        txn = txn.withColumn("shift", shift_of(F.col("hour"))).where(F.col("shift") != "OTHER")
    txn = txn.select("transaction_id", *[k for k in keys if k != "item"])
    if not dealt:
        items, txn = items.repartition(n, "transaction_id"), txn.repartition(n, "transaction_id")
    sold = order_items(items).join(txn, "transaction_id")
    sums = sold.repartition(n, "entity", "item").groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.count("transaction_id").alias("orders"))
    return sums.join(catalog.repartition(n, "item"), "item").select(*keys, "item_name", "item_group", "quantity", "orders")


def group_facts(item_day: DataFrame) -> DataFrame:
    """Item facts rolled up to item groups."""
    return item_day.groupBy("entity", "date", "item_group").agg(
        F.sum("quantity").alias("quantity"), F.sum("orders").alias("orders")
    )


def booking_hour(booking: DataFrame) -> DataFrame:
    """Booked guests by hour (a missing hour is a group of its own) with daily totals."""
    hourly = booking.groupBy("entity", "date", "weekday", "hour").agg(
        F.sum("guests").alias("booking_guests"), F.count("*").alias("booking_count")
    )
    day = W.partitionBy("entity", "date")
    return hourly.withColumns(
        {
            "booking_guests_daily": F.sum("booking_guests").over(day),
            "booking_count_daily": F.sum("booking_count").over(day),
        }
    )


def booking_day(booking: DataFrame) -> DataFrame:
    return booking.groupBy("entity", "date").agg(F.sum("guests").alias("booking_guests"))


def booking_top(booking_hourly: DataFrame, k: int = 5) -> DataFrame:
    """Totals plus the k entities and k dates with most booked guests, as report rows."""
    g = F.sum("booking_guests").cast("double").alias("value")
    total = booking_hourly.agg(
        F.sum("booking_guests").cast("double").alias("guests"),
        F.sum("booking_count").cast("double").alias("bookings"),
        F.count_distinct("entity").cast("double").alias("entities"),
        F.count_distinct("date").cast("double").alias("dates"),
    ).unpivot([], ["guests", "bookings", "entities", "dates"], "key", "value")
    parts = [total.select(F.lit("total").alias("section"), "key", "value")]
    for key in ("entity", "date"):
        top = booking_hourly.groupBy(F.col(key).cast("string").alias("key")).agg(g)
        top = top.orderBy(F.desc("value"), "key").limit(k)
        parts.append(top.select(F.lit(key).alias("section"), "key", "value"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# -- shares -------------------------------------------------------------------------


def day_kind() -> Column:
    return F.when(is_weekend(F.col("date")), "weekend").otherwise("weekday")


def _both_kinds(shares: DataFrame) -> DataFrame:
    """An entity with one day kind only uses its shares for the other kind too."""
    per = W.partitionBy("entity")
    kinds = F.collect_set("day_kind").over(per)
    return (
        shares.withColumn("__k", kinds)
        .withColumn("__as", F.when(F.size("__k") == 1, F.array(F.lit("weekday"), F.lit("weekend")))
                    .otherwise(F.array("day_kind")))
        .withColumn("day_kind", F.explode("__as"))
        .drop("__k", "__as")
    )


def hour_ratio(txn: DataFrame) -> DataFrame:
    """Share of guests per hour for weekdays and weekends, inactive hours left out."""
    hourly = txn.groupBy("entity", day_kind().alias("day_kind"), "hour").agg(
        F.sum("guests").alias("v"), F.avg("guests").alias("mean")
    )
    kind = W.partitionBy("entity", "day_kind")
    kept = hourly.withColumn("r", ratio(F.col("v"), F.sum("v").over(kind))).where(
        (F.col("r") > 0.01) & (F.col("mean") >= 0.5)
    )
    # added up by the hour, so that reruns agree to the last bit
    total = F.sum("r").over(kind.orderBy("hour").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return _both_kinds(kept.select("entity", "day_kind", "hour", (F.col("r") / total).alias("ratio")))


def _recent_weighted(txn: DataFrame, recency: int) -> DataFrame:
    """Daily-hour sums with 3x weight on the last ``recency`` days of each entity."""
    last = W.partitionBy("entity")
    facts = txn.groupBy("entity", "date", "hour").agg(
        F.sum("guests").alias("guests"), F.count("*").alias("n")
    )
    facts = facts.withColumn("__ago", F.datediff(F.max("date").over(last), "date"))
    w = F.when(F.col("__ago") <= recency, 3.0).otherwise(1.0)
    return facts.withColumn("weighted", F.col("guests") * w)


def weekday_hour_ratio(txn: DataFrame, recency: int = 30) -> DataFrame:
    """Share per hour for every weekday, recent days weighted three times."""
    hourly = (
        with_weekday(_recent_weighted(txn, recency)).groupBy("entity", "weekday", "hour")
        .agg(F.sum("weighted").alias("v"), F.sum("guests").alias("g"), F.sum("n").alias("n"))
    )
    wd = W.partitionBy("entity", "weekday")
    kept = hourly.withColumn("r", ratio(F.col("v"), F.sum("v").over(wd))).where(
        (F.col("r") > 0.01) & (F.col("g") / F.col("n") >= 0.5)
    )
    return kept.select("entity", "weekday", "hour", (F.col("r") / F.sum("r").over(wd)).alias("ratio"))


def shift_ratio(txn: DataFrame) -> DataFrame:
    """Share of each shift for weekdays and weekends."""
    s = (
        txn.withColumn("shift", shift_of(F.col("hour"))).where(F.col("shift") != "OTHER")
        .groupBy("entity", day_kind().alias("day_kind"), "shift").agg(F.sum("guests").alias("v"))
    )
    r = ratio(F.col("v"), F.sum("v").over(W.partitionBy("entity", "day_kind")))
    return _both_kinds(s.select("entity", "day_kind", "shift", r.alias("ratio")).where("ratio is not null"))


def weekday_shift_ratio(txn: DataFrame, recency: int = 30) -> DataFrame:
    """Shift share for every weekday, recent days weighted three times."""
    op = txn.withColumn("__s", shift_of(F.col("hour"))).where(F.col("__s") != "OTHER").drop("__s")
    s = (
        with_weekday(_recent_weighted(op, recency))
        .groupBy("entity", "weekday", shift_of(F.col("hour")).alias("shift"))
        .agg(F.sum("weighted").alias("v"))
    )
    r = ratio(F.col("v"), F.sum("v").over(W.partitionBy("entity", "weekday")))
    return s.select("entity", "weekday", "shift", r.alias("ratio")).where("ratio is not null")


def _two_shares(sums: DataFrame, keys: list[str]) -> DataFrame:
    tot = F.col("m") + F.col("e")
    morning = F.when(tot > 0, F.col("m") / tot).otherwise(0.45)
    evening = F.when(tot > 0, F.col("e") / tot).otherwise(0.55)
    return sums.select(*keys, morning.alias("MORNING"), evening.alias("EVENING")).unpivot(
        keys, ["MORNING", "EVENING"], "shift", "ratio"
    )


def hist_shift_ratio(guest_shift: DataFrame) -> DataFrame:
    """Shift share per entity and weekday; .45/.55 where nothing was sold."""
    g = guest_shift.groupBy("entity", "weekday").agg(
        F.sum(F.when(F.col("shift") == "MORNING", F.col("guests")).otherwise(0.0)).alias("m"),
        F.sum(F.when(F.col("shift") == "EVENING", F.col("guests")).otherwise(0.0)).alias("e"),
    )
    return _two_shares(g, ["entity", "weekday"])


def item_shift_ratio(item_shift: DataFrame) -> DataFrame:
    """Shift share per entity and item; .45/.55 where nothing was sold."""
    g = item_shift.groupBy("entity", "item").agg(
        F.sum(F.when(F.col("shift") == "MORNING", F.col("quantity")).otherwise(0.0)).alias("m"),
        F.sum(F.when(F.col("shift") == "EVENING", F.col("quantity")).otherwise(0.0)).alias("e"),
    )
    return _two_shares(g, ["entity", "item"])


def window_mean(day: DataFrame, ref: str, windows=(30, 60, 90)) -> DataFrame:
    """Weekday means in the last N days before ``ref``, all windows in one pass."""
    ref_d = F.lit(ref).cast("date")
    recent = day.where((F.col("date") >= F.date_sub(ref_d, max(windows))) & (F.col("date") < ref_d))
    return with_weekday(recent).groupBy("entity", "weekday").agg(
        *[
            F.avg(F.when(F.col("date") >= F.date_sub(ref_d, n), F.col("guests"))).alias(f"mean_{n}d")
            for n in windows
        ]
    )


def active_entities(txn: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Entities seen in the last ``days`` days."""
    last = txn.groupBy("entity").agg(F.max("date").alias("last_date"))
    return last.where(F.col("last_date") >= F.date_sub(F.lit(today).cast("date"), days))


def shift_report(ledger: DataFrame) -> DataFrame:
    """Ledger rows with a shift, summed per entity, date and shift; first flags in row order."""
    first = lambda c: F.min_by(c, F.struct("run_date", F.coalesce(F.col("hour"), F.lit(-1))))
    return (
        with_weekday(ledger.where(F.col("shift").isNotNull()))
        .groupBy("entity", "date", "weekday", "shift")
        .agg(
            F.sum("pred").alias("pred"),
            first("is_holiday").alias("is_holiday"),
            first("is_veg").alias("is_veg"),
        )
    )


# -- monthly ------------------------------------------------------------------------


def month_dedup(txn: DataFrame) -> DataFrame:
    """Monthly totals after first-source-wins dedupe on the transaction id."""
    day = dedup_priority(txn).groupBy("entity", "date").agg(
        F.sum("guests").alias("guests"), F.sum("revenue").alias("revenue"), F.count("*").alias("n")
    )
    return month_rollup(day)


def month_rollup(day: DataFrame) -> DataFrame:
    """Entity days (guests, revenue, n) to months; distinct counts run on the small facts."""
    return day.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("guests").alias("guests"),
        F.sum("revenue").alias("revenue"),
        F.sum("n").alias("transactions"),
        F.count_distinct("entity").alias("entities"),
        F.count_distinct("date").alias("active_days"),
    )


def month_derived(month: DataFrame, today: str, min_days: int = 25) -> DataFrame:
    """Averages per month; short months are dropped unless they are the current one."""
    t = F.lit(today).cast("date")
    current = (F.col("year") == F.year(t)) & (F.col("month") == F.month(t))
    days = F.greatest(F.col("active_days"), F.lit(1))
    return month.where((F.col("active_days") >= min_days) | current).withColumns(
        {
            "avg_daily_guests": F.col("guests") / days,
            "avg_guests_entity_day": F.col("guests") / (days * F.greatest(F.col("entities"), F.lit(1))),
            "revenue_per_guest": ratio(F.col("revenue"), F.col("guests")),
            "avg_daily_revenue": F.col("revenue") / days,
        }
    )


def daily_extract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Totals by business date over both sources, without dedupe on purpose."""
    def one(src):
        d = F.coalesce(F.to_date("open_time"), F.col("date"))
        return src.groupBy(d.alias("date"), "entity").agg(
            F.sum("guests").alias("guests"), F.count_distinct("transaction_id").alias("transactions")
        )

    both = one(a).unionByName(one(b))
    day = both.groupBy("date").agg(
        F.sum("guests").alias("guests"),
        F.sum("transactions").alias("transactions"),
        F.count_distinct("entity").alias("active_entities"),
    )
    return with_weekday(day).withColumns(
        {"month": F.month("date"), "year": F.year("date"), "day_of_week": F.weekday("date")}
    )
