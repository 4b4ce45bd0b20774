"""Operator inputs read from the given tables, each with the SQL that builds the same rows.

``orders`` plays the transaction fact. An entity is a block of a hundred customers, so the
number of entities grows with the data; every third customer belongs to one hot entity
``R0``, and a few customers are entities of their own with very little history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.clean import shift_of
from tidecast.operators import calendar as cal_ops
from tidecast.operators import facts
from tidecast.plans.registry import SHARED, cte
from tidecast.session import materialise, parts

AS_OF = "2001-08-01"
#: Buckets of stored facts, for the size of the test tables; larger ones get more.
BUCKETS = 16
#: Cells of the vector index, and how many of them a query looks into.
CELLS, PROBED = 24, 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _entity():
    k = F.col("o_custkey")
    return (
        F.when(k % 500 == 7, F.concat(F.lit("Y"), k.cast("string")))
        .when(k % 3 == 0, F.lit("R0"))
        .otherwise(F.concat(F.lit("R"), (F.floor(k / 100) + 1).cast("string")))
    )


def _guests():
    k = F.col("o_custkey")
    small = (F.floor(k / 100) % 4 == 1) & (k % 3 != 0) & (k % 500 != 7)
    return (F.floor(F.col("o_totalprice") / F.when(small, 30000.0).otherwise(5000.0)) + 1).cast("double")


ENTITY_SQL = """CASE WHEN o_custkey % 500 = 7 THEN 'Y' || CAST(o_custkey AS VARCHAR)
  WHEN o_custkey % 3 = 0 THEN 'R0' ELSE 'R' || CAST(o_custkey // 100 + 1 AS VARCHAR) END"""
GUESTS_SQL = """CAST(floor(o_totalprice / CASE WHEN (o_custkey // 100) % 4 = 1 AND o_custkey % 3 <> 0
  AND o_custkey % 500 <> 7 THEN 30000.0 ELSE 5000.0 END) + 1 AS DOUBLE)"""
_HOUR_SQL = "CAST(6 + o_orderkey % 18 AS INTEGER)"
_OPEN_SQL = f"o_orderdate + to_hours({_HOUR_SQL}) + to_minutes(CAST(o_orderkey % 60 AS INTEGER))"


def _hour():
    return (F.lit(6) + F.col("o_orderkey") % 18).cast("int")


def _open_time():
    return F.col("o_orderdate") + F.make_dt_interval(
        hours=_hour(), mins=(F.col("o_orderkey") % 60).cast("int")
    )


def txn(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned transactions."""
    return table(spark, sf, "orders").select(
        _entity().alias("entity"),
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("transaction_id"),
        _guests().alias("guests"),
        F.col("o_totalprice").alias("revenue"),
        _open_time().alias("open_time"),
        F.to_date("o_orderdate").alias("date"),
        _hour().alias("hour"),
    )


cte(
    "txn",
    f"""SELECT {ENTITY_SQL} AS entity, 'T' || CAST(o_orderkey AS VARCHAR) AS transaction_id,
  {GUESTS_SQL} AS guests, o_totalprice AS revenue, {_OPEN_SQL} AS open_time,
  CAST(o_orderdate AS DATE) AS date, {_HOUR_SQL} AS hour FROM orders""",
)


def raw_a(spark: SparkSession, sf: str) -> DataFrame:
    """First source as delivered: bracketed ids, padded codes, text measures."""
    k = F.col("o_orderkey")
    return (
        table(spark, sf, "orders")
        .where((k % 2 == 0) | (k % 10 == 3))
        .select(
            F.concat(F.lit(" 00"), F.lower(_entity()), F.lit(".0")).alias("restaurant_code"),
            F.concat(F.lit("{t"), k.cast("string"), F.lit("}")).alias("order_guid"),
            F.when(k % 10 == 3, "0").when(k % 50 == 4, "n/a")
            .otherwise(_guests().cast("int").cast("string")).alias("guest_count"),
            _open_time().cast("string").alias("pos_open_transaction_time"),
            F.to_date("o_orderdate").alias("shift_date"),
            F.col("o_totalprice").alias("total_pay_sum"),
        )
    )


def raw_b(spark: SparkSession, sf: str) -> DataFrame:
    """Second source; a slice of its ids is also in the first one."""
    k = F.col("o_orderkey")
    return (
        table(spark, sf, "orders")
        .where(k % 2 == 1)
        .select(
            _entity().alias("restaurant_code"),
            F.concat(F.lit(" T"), k.cast("string"), F.lit(" ")).alias("transaction_id"),
            _guests().cast("int").cast("string").alias("guest_count"),
            F.when(k % 101 != 5, _open_time().cast("string")).otherwise("unknown").alias("open_time"),
            F.to_date("o_orderdate").alias("shiftdate"),
            F.col("o_totalprice").alias("paysum"),
        )
    )


_ID = "trim(replace(replace(upper({0}), '{{', ''), '}}', ''))"
cte(
    "two_sources",
    f"""SELECT {ENTITY_SQL} AS entity, 'T' || CAST(o_orderkey AS VARCHAR) AS transaction_id,
  CASE WHEN o_orderkey % 10 = 3 OR o_orderkey % 50 = 4 THEN 0.0 ELSE {GUESTS_SQL} END AS guests,
  o_totalprice AS revenue, {_OPEN_SQL} AS open_time, CAST(o_orderdate AS DATE) AS date, 1 AS source
  FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 10 = 3
UNION ALL SELECT {ENTITY_SQL}, 'T' || CAST(o_orderkey AS VARCHAR), {GUESTS_SQL}, o_totalprice,
  CASE WHEN o_orderkey % 101 <> 5 THEN {_OPEN_SQL} END, CAST(o_orderdate AS DATE), 2
  FROM orders WHERE o_orderkey % 2 = 1""",
)


def raw_booking(spark: SparkSession, sf: str) -> DataFrame:
    """Bookings as delivered: mixed time texts and cancel reasons."""
    k = F.col("o_orderkey")
    h = _hour().cast("string")
    return table(spark, sf, "orders").select(
        F.concat(F.lower(_entity()), F.lit(".0")).alias("restaurant"),
        F.floor(F.col("o_totalprice") / 20000).cast("string").alias("total_guest"),
        F.col("o_orderdate").cast("string").alias("shift_date"),
        F.when(k % 5 == 0, F.concat(h, F.lit(":30"))).when(k % 5 == 1, F.concat(h, F.lit(".0")))
        .when(k % 5 == 2, F.concat(h, F.lit(":15:00"))).when(k % 5 == 3, F.lit("late"))
        .otherwise(F.lit(None)).alias("start_time"),
        F.when(F.col("o_orderstatus") == "F", "guest cancelled")
        .when(F.col("o_orderstatus") == "O", " ").when(k % 2 == 0, "NaN").alias("cancelled_reason"),
    )


cte(
    "booking",
    f"""SELECT {ENTITY_SQL} AS entity, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderkey % 5 IN (0, 1, 2) THEN {_HOUR_SQL} END AS hour,
  CAST(floor(o_totalprice / 20000) AS INTEGER) AS guests
  FROM orders WHERE o_orderstatus <> 'F' AND floor(o_totalprice / 20000) > 0""",
)


def booking(spark: SparkSession, sf: str) -> DataFrame:
    return facts.clean_booking(facts.drop_cancelled(raw_booking(spark, sf)))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return facts.daily(txn(spark, sf))


cte("day", "SELECT entity, date, sum(guests) AS guests FROM txn GROUP BY entity, date", ["txn"])

SHIFT_SQL = "CASE WHEN hour BETWEEN 8 AND 15 THEN 'MORNING' WHEN hour BETWEEN 16 AND 23 THEN 'EVENING' ELSE 'OTHER' END"


def shift_day(spark: SparkSession, sf: str) -> DataFrame:
    t = txn(spark, sf).withColumn("shift", shift_of(F.col("hour"))).where("shift <> 'OTHER'")
    return t.groupBy("entity", "date", "shift").agg(F.sum("guests").alias("guests"))


cte(
    "shift_day",
    f"""SELECT entity, date, {SHIFT_SQL} AS shift, sum(guests) AS guests FROM txn
  WHERE hour BETWEEN 8 AND 23 GROUP BY ALL""",
    ["txn"],
)


def entity_dim_raw(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer as delivered: padded codes that repeat per entity."""
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    k = F.col("o_custkey")
    return c.select(
        F.concat(F.lit("0"), F.lower(_entity()), F.lit(".0")).alias("restaurant_code"),
        F.lpad(k.cast("string"), 12, "0").alias("sap_code"),
        F.concat(F.initcap("c_mktsegment"), F.lit("-House "), k.cast("string")).alias("restaurant_name"),
    )


cte(
    "dim_raw",
    f"""SELECT {ENTITY_SQL} AS merge_key, lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS sap_code,
  upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-House ' || CAST(o_custkey AS VARCHAR) AS restaurant_name
  FROM (SELECT c_custkey AS o_custkey, c_mktsegment FROM customer)""",
)
cte(
    "dim",
    """SELECT merge_key, arg_min(sap_code, (sap_code, restaurant_name)) AS sap_code,
  arg_min(restaurant_name, (sap_code, restaurant_name)) AS restaurant_name FROM dim_raw GROUP BY merge_key""",
    ["dim_raw"],
)


def entity_dim(spark: SparkSession, sf: str) -> DataFrame:
    return facts.clean_entity_dim(entity_dim_raw(spark, sf))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Item lines: item and group come from the parts catalog."""
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("T"), F.col("l_orderkey").cast("string")).alias("transaction_id"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("quantity"),
    )
    return li


def buckets(spark: SparkSession, sf: str) -> int:
    """Buckets of stored facts in proportion to the item lines."""
    return max(BUCKETS, parts(items(spark, sf)))


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("item_name"),
        F.col("p_brand").alias("item_group"),
    )


cte(
    "item_txn",
    """SELECT t.entity, t.date, t.hour, t.transaction_id, l.l_partkey AS item, l.l_quantity AS quantity,
  p.p_name AS item_name, p.p_brand AS item_group
  FROM lineitem l JOIN txn t ON t.transaction_id = 'T' || CAST(l.l_orderkey AS VARCHAR)
  JOIN part p ON p.p_partkey = l.l_partkey""",
    ["txn"],
)

# Stand-in values of the input calendar: first day of the lunar year, 1995-2002.
LUNAR_NEW_YEAR = [
    "1994-02-10", "1995-01-31", "1996-02-19", "1997-02-07", "1998-01-28", "1999-02-16",
    "2000-02-05", "2001-01-24", "2002-02-12",
]
KINGS_DAY = [
    "1995-04-09", "1996-04-27", "1997-04-16", "1998-04-06", "1999-04-25", "2000-04-14",
    "2001-04-03",
]


def once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A table that parts of a query share is written to the shared folder once per query, so
    that changed inputs are seen by the next one."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in SHARED:
        SHARED[key] = materialise(build(), name)
    return SHARED[key]


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Input calendar over the range of the facts plus a horizon, with attributes added."""
    return once(
        spark, sf, "calendar",
        lambda: cal_ops.day_info(cal_ops.events(cal_ops.classify(raw_calendar(spark, sf)))).coalesce(1),
    )


def raw_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """date, holiday_name, lunar_day, lunar_month for every day the orders cover."""
    span = table(spark, sf, "orders").agg(
        F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi")
    )
    days = span.select(
        F.explode(F.sequence(F.date_sub("lo", 30), F.date_add("hi", 120))).alias("date")
    )
    tet = F.array(*[F.lit(d).cast("date") for d in LUNAR_NEW_YEAR])
    kings = [F.lit(d).cast("date") for d in KINGS_DAY]
    d = F.col("date")
    since = F.datediff(d, F.array_max(F.filter(tet, lambda t: t <= d)))
    until = F.datediff(F.array_min(F.filter(tet, lambda t: t > d)), d)
    md = F.date_format(d, "MM-dd")
    name = (
        F.when(until == 1, "Giao thừa Tết Nguyên Đán")
        .when(since == 0, "Tết Nguyên Đán")
        .when(since <= 3, F.concat(F.lit("Mùng "), (since + 1).cast("string"), F.lit(" Tết")))
        .when(d.isin(*kings), "Ngày Giỗ Tổ Hùng Vương")
        .when(md == "04-30", "Ngày Chiến thắng")
        .when(md == "05-01", "Ngày Quốc tế Lao động")
        .when(md == "09-02", "Quốc khánh")
        .when(md == "01-01", "Tết Dương lịch")
    )
    return days.select(
        d,
        name.alias("holiday_name"),
        (since % 30 + 1).cast("int").alias("lunar_day"),
        (F.floor(since / 30) + 1).cast("int").alias("lunar_month"),
    )


_TET = "[" + ", ".join(f"DATE '{d}'" for d in LUNAR_NEW_YEAR) + "]"
_KINGS = ", ".join(f"DATE '{d}'" for d in KINGS_DAY)
cte(
    "raw_cal",
    f"""SELECT date, CASE WHEN until = 1 THEN 'Giao thừa Tết Nguyên Đán' WHEN since = 0 THEN 'Tết Nguyên Đán'
   WHEN since <= 3 THEN 'Mùng ' || CAST(since + 1 AS VARCHAR) || ' Tết'
   WHEN date IN ({_KINGS}) THEN 'Ngày Giỗ Tổ Hùng Vương'
   WHEN month(date) = 4 AND day(date) = 30 THEN 'Ngày Chiến thắng'
   WHEN month(date) = 5 AND day(date) = 1 THEN 'Ngày Quốc tế Lao động'
   WHEN month(date) = 9 AND day(date) = 2 THEN 'Quốc khánh'
   WHEN month(date) = 1 AND day(date) = 1 THEN 'Tết Dương lịch' END AS holiday_name,
   since % 30 + 1 AS lunar_day, since // 30 + 1 AS lunar_month
  FROM (SELECT date, date_diff('day', list_max(list_filter({_TET}, lambda t: t <= date)), date) AS since,
          date_diff('day', date, list_min(list_filter({_TET}, lambda t: t > date))) AS until
        FROM (SELECT CAST(unnest(generate_series(min(o_orderdate) - INTERVAL 30 DAY,
                max(o_orderdate) + INTERVAL 120 DAY, INTERVAL 1 DAY)) AS DATE) AS date FROM orders))""",
)
