"""Queries: projections, predicates, fact aggregates, shares, transaction dedupe."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions import clean
from tidecast.operators import facts
from tidecast.plans import inputs as I
from tidecast.plans.inputs import SHIFT_SQL
from tidecast.plans.q_sources import _two
from tidecast.plans.registry import cte, query, with_
from tidecast.session import fresh_path, parts
from tidecast.sources import readers, store


# -- projections ----------------------------------------------------------------------


@query(
    "prj_clean_id",
    "SELECT event_id, upper(event_type) || '-' || CAST(event_id AS VARCHAR) AS clean FROM events",
)
def prj_clean_id(spark, sf):
    e = I.table(spark, sf, "events")
    raw = F.concat(F.lit(" {"), F.col("event_type"), F.lit("-"), F.col("event_id").cast("string"), F.lit("} "))
    return e.select("event_id", clean.clean_id(raw).alias("clean"))


@query(
    "prj_norm_key",
    """SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN '0' ELSE CAST(o_custkey AS VARCHAR) END AS merge_key FROM orders""",
)
def prj_norm_key(spark, sf):
    o = I.table(spark, sf, "orders")
    raw = F.concat(F.lit(" 00"), F.col("o_custkey").cast("string"),
                   F.when(F.col("o_orderkey") % 2 == 0, ".0 ").otherwise(" "))
    return o.select("o_orderkey", clean.norm_key(raw).alias("merge_key"))


@query(
    "prj_num_coerce",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN 0.0 ELSE 0.0 END AS number FROM events""",
)
def prj_num_coerce(spark, sf):
    e = I.table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(
        F.col("event_id") % 3 == 1, F.concat(F.col("value").cast("string"), F.lit(" pax"))
    )
    return e.select("event_id", clean.num_coerce(raw).alias("number"))


@query(
    "prj_time_parts",
    "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS weekday FROM events",
)
def prj_time_parts(spark, sf):
    return clean.time_parts(I.table(spark, sf, "events"), "ts").select("event_id", "date", "hour", "weekday")


@query(
    "prj_shift",
    f"SELECT shift, count(*) AS n FROM (SELECT {SHIFT_SQL} AS shift FROM (SELECT hour(ts) AS hour FROM events)) GROUP BY shift",
)
def prj_shift(spark, sf):
    e = I.table(spark, sf, "events")
    return e.groupBy(clean.shift_of(F.hour("ts")).alias("shift")).agg(F.count("*").alias("n"))


@query(
    "prj_shift_legacy",
    """SELECT CASE WHEN hour(ts) BETWEEN 9 AND 14 THEN 'MORNING' WHEN hour(ts) BETWEEN 15 AND 22 THEN 'EVENING'
    ELSE 'OTHER' END AS shift, count(*) AS n FROM events GROUP BY 1""",
)
def prj_shift_legacy(spark, sf):
    e = I.table(spark, sf, "events")
    return e.groupBy(clean.shift_legacy(F.hour("ts")).alias("shift")).agg(F.count("*").alias("n"))


@query(
    "prj_parse_hour",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(hour(ts) AS INTEGER) END AS hour,
    CASE WHEN event_id % 4 = 3 THEN 0 ELSE CAST(hour(ts) AS INTEGER) END AS hour_or_0 FROM events""",
)
def prj_parse_hour(spark, sf):
    e = I.table(spark, sf, "events")
    k, ts = F.col("event_id"), F.col("ts")
    raw = (
        F.when(k % 4 == 0, ts.cast("string")).when(k % 4 == 1, F.date_format(ts, "HH:mm"))
        .when(k % 4 == 2, F.concat(F.hour(ts).cast("string"), F.lit(".0"))).otherwise("25")
    )
    return e.select("event_id", clean.parse_hour(raw).alias("hour"), clean.parse_hour(raw, 0).alias("hour_or_0"))


@query(
    "prj_parse_date_multi",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders",
)
def prj_parse_date_multi(spark, sf):
    o = I.table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = (
        F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 4 == 2, F.date_format(d, "dd/MM/yyyy")).otherwise("soon")
    )
    return o.select("o_orderkey", clean.parse_date_multi(raw).alias("date"))


@query(
    "prj_closure_status",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 IN (1, 3) THEN 'CLOSED' WHEN c_custkey % 7 IN (2, 4, 5) THEN 'HALF_DAY'
    ELSE 'OPEN' END AS status FROM customer""",
)
def prj_closure_status(spark, sf):
    from tidecast.plans.q_sources import closure_wide

    w = closure_wide(spark, sf).select(
        F.regexp_extract("SAP", r"(\d+)\.", 1).cast("long").alias("c_custkey"), F.col("`10/08/2001`").alias("t")
    )
    return w.select("c_custkey", clean.closure_status(F.col("t")).alias("status"))


@query(
    "prj_ext_code",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR)
    ELSE right('9' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0'), 4) END AS code FROM orders""",
)
def prj_ext_code(spark, sf):
    o = I.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("01VN"), k.cast("string"))).otherwise(
        F.concat(F.lit("9"), F.lpad(k.cast("string"), 12, "0"))
    )
    return o.select("o_orderkey", clean.ext_code(raw).alias("code"))


@query(
    "prj_name_norm",
    """SELECT p_partkey, 'pho ' || lower(p_name) || ' king bbq duong' AS norm FROM part""",
)
def prj_name_norm(spark, sf):
    p = I.table(spark, sf, "part")
    raw = F.concat(F.lit("Phở-"), F.initcap("p_name"), F.lit("  kingBBQ Đường"))
    return p.select("p_partkey", clean.name_norm(raw).alias("norm"))


# Stand-in chain list and brand codes (parameters of the operator).
CHAINS = ["Red Widget", "Small-Ring", "blue gear", "Ring", "Widget"]
BRANDS = {"BRAND#1": "First House", "BRAND#2": "Second House"}
_CHAIN_SQL = """CASE WHEN p_brand = 'Brand#1' THEN 'First House' WHEN p_brand = 'Brand#2' THEN 'Second House'
  WHEN contains(lower(p_name), 'red widget') THEN 'Red Widget' WHEN contains(lower(p_name), 'small ring') THEN 'Small-Ring'
  WHEN contains(lower(p_name), 'blue gear') THEN 'blue gear' WHEN contains(lower(p_name), 'ring') THEN 'Ring'
  WHEN contains(lower(p_name), 'widget') THEN 'Widget' END"""


@query("prj_chain", f"SELECT p_partkey, {_CHAIN_SQL} AS chain FROM part")
def prj_chain(spark, sf):
    p = I.table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("restaurant_name"), F.col("p_brand").alias("brand_code")
    )
    return readers.chain_of(p, BRANDS, CHAINS).select("p_partkey", "chain")


@query(
    "prj_booking_clean",
    with_("SELECT entity, CAST(date AS VARCHAR) AS date, dayname(date) AS weekday, hour, guests FROM booking", "booking"),
)
def prj_booking_clean(spark, sf):
    return I.booking(spark, sf)


# -- transaction dedupe and unions -------------------------------------------------------


@query(
    "set_union_txn",
    with_("SELECT source, count(*) AS n, sum(guests) AS guests, count(open_time) AS timed FROM two_sources GROUP BY source", "two_sources"),
)
def set_union_txn(spark, sf):
    return _two(spark, sf).groupBy("source").agg(
        F.count("*").alias("n"), F.sum("guests").alias("guests"), F.count("open_time").alias("timed")
    )


@query(
    "win_dedup_txn",
    with_(
        """SELECT entity, transaction_id, guests, source, CAST(CAST(open_time AS DATE) AS VARCHAR) AS date,
        CAST(hour(open_time) AS INTEGER) AS hour, dayname(open_time) AS weekday FROM deduped WHERE open_time IS NOT NULL""",
        "deduped",
    ),
)
def win_dedup_txn(spark, sf):
    t = facts.with_open_time(facts.dedup_highest(_two(spark, sf, False)))
    return t.select("entity", "transaction_id", "guests", "source", "date", "hour", "weekday")


@query(
    "win_dedup_priority",
    with_(
        """SELECT entity, transaction_id, guests, source FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
        ORDER BY source, guests DESC) AS rn FROM two_sources) WHERE rn = 1""",
        "two_sources",
    ),
)
def win_dedup_priority(spark, sf):
    return facts.dedup_priority(_two(spark, sf, False)).select("entity", "transaction_id", "guests", "source")


def stored_txn(spark, sf):
    """Both sources appended to one store, bucketed by transaction id."""
    a, b = facts.source_a(I.raw_a(spark, sf)), facts.source_b(I.raw_b(spark, sf))
    path = fresh_path(spark, "txn-store")
    name = store.open_store(spark, path, a.schema, "transaction_id", I.buckets(spark, sf))
    for delivery in (a, b):
        store.append(delivery, name, "transaction_id", I.buckets(spark, sf))
    return spark.table(name)


@query(
    "win_dedup_stored",
    with_(
        """SELECT entity, transaction_id, guests, source, CAST(CAST(open_time AS DATE) AS VARCHAR) AS date,
        CAST(hour(open_time) AS INTEGER) AS hour, dayname(open_time) AS weekday FROM deduped WHERE open_time IS NOT NULL""",
        "deduped",
    ),
)
def win_dedup_stored(spark, sf):
    t = facts.with_open_time(store.dedup_highest(stored_txn(spark, sf)))
    return t.select("entity", "transaction_id", "guests", "source", "date", "hour", "weekday")


@query(
    "set_union_history",
    with_(
        """SELECT entity, transaction_id, guests, CAST(date AS VARCHAR) AS date, hour FROM txn""",
        "txn",
    ),
)
def set_union_history(spark, sf):
    t = I.txn(spark, sf).drop("revenue", "open_time")
    train = t.where(F.col("date") >= F.lit("1998-01-01").cast("date")).withColumn("source", F.lit(1))
    extra = t.where(F.col("date") < F.lit("1999-01-01").cast("date")).withColumn("source", F.lit(2))
    return facts.dedup_priority(facts.union_txn(train, extra)).drop("source")


# -- aggregates -----------------------------------------------------------------------------


@query("agg_daily", with_("SELECT entity, CAST(date AS VARCHAR) AS date, dayname(date) AS weekday, guests FROM day", "day"))
def agg_daily(spark, sf):
    return facts.with_weekday(I.daily(spark, sf))


cte(
    "guest_shift",
    f"""SELECT entity, date, {SHIFT_SQL} AS shift, count(DISTINCT transaction_id) AS transactions, sum(guests) AS guests
  FROM txn WHERE hour >= 8 GROUP BY ALL""",
    ["txn"],
)


@query(
    "agg_guest_day",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, count(DISTINCT transaction_id) AS transactions,
        sum(guests) AS guests, dayname(date) AS weekday FROM txn GROUP BY entity, txn.date""",
        "txn",
    ),
)
def agg_guest_day(spark, sf):
    return facts.guest_facts(I.txn(spark, sf))


@query(
    "agg_guest_shift",
    with_(
        "SELECT entity, CAST(date AS VARCHAR) AS date, shift, transactions, guests, dayname(date) AS weekday FROM guest_shift",
        "guest_shift",
    ),
)
def agg_guest_shift(spark, sf):
    return facts.guest_facts(I.txn(spark, sf), by_shift=True)


def item_txn(spark, sf):
    """Item lines with their transaction and catalog attributes, in partitions that grow with them."""
    items = I.items(spark, sf)
    return facts.join_items(I.txn(spark, sf), items, I.catalog(spark, sf), parts(items))


def item_facts(spark, sf, by_shift=False):
    return facts.item_facts(I.txn(spark, sf), I.items(spark, sf), I.catalog(spark, sf), by_shift)


cte(
    "item_day",
    """SELECT entity, date, item, item_name, item_group, sum(quantity) AS quantity,
  count(DISTINCT transaction_id) AS orders FROM item_txn GROUP BY ALL""",
    ["item_txn"],
)
cte(
    "item_shift",
    f"""SELECT entity, date, item, {SHIFT_SQL} AS shift, item_name, item_group, sum(quantity) AS quantity,
  count(DISTINCT transaction_id) AS orders FROM item_txn WHERE hour >= 8 GROUP BY ALL""",
    ["item_txn"],
)
_ITEM = "entity, CAST(date AS VARCHAR) AS date, item, item_name, item_group, quantity, orders"


@query("agg_item_day", with_(f"SELECT {_ITEM} FROM item_day", "item_day"))
def agg_item_day(spark, sf):
    return item_facts(spark, sf)


@query("agg_item_shift", with_(f"SELECT {_ITEM}, shift FROM item_shift", "item_shift"))
def agg_item_shift(spark, sf):
    return item_facts(spark, sf, by_shift=True)


@query(
    "jn_txn_items",
    with_(
        """SELECT item_group, CAST(count(*) AS BIGINT) AS lines, sum(quantity) AS quantity,
        count(DISTINCT transaction_id) AS orders FROM item_txn GROUP BY item_group""",
        "item_txn",
    ),
)
def jn_txn_items(spark, sf):
    return facts.group_totals(item_txn(spark, sf), parts(I.items(spark, sf)))


@query(
    "agg_group_day",
    with_(
        """SELECT entity, CAST(date AS VARCHAR) AS date, item_group, sum(quantity) AS quantity,
        CAST(sum(orders) AS BIGINT) AS orders FROM item_day GROUP BY entity, item_day.date, item_group""",
        "item_day",
    ),
)
def agg_group_day(spark, sf):
    return facts.group_facts(item_facts(spark, sf))


@query(
    "jn_items_stored",
    with_(
        """SELECT d.entity, CAST(CAST(d.open_time AS DATE) AS VARCHAR) AS date, l.l_partkey AS item, p.p_name AS item_name, p.p_brand AS item_group,
        sum(l.l_quantity) AS quantity, count(DISTINCT d.transaction_id) AS orders FROM deduped d JOIN lineitem l ON d.transaction_id = 'T' || CAST(l.l_orderkey AS VARCHAR)
        JOIN part p ON p.p_partkey = l.l_partkey WHERE d.open_time IS NOT NULL GROUP BY ALL""",
        "deduped",
    ),
)
def jn_items_stored(spark, sf):
    lines = store.stored(I.items(spark, sf), "lines", "transaction_id", I.buckets(spark, sf))
    txn = facts.with_open_time(store.dedup_highest(stored_txn(spark, sf)))
    return facts.item_facts(txn, lines, I.catalog(spark, sf), dealt=True)


cte(
    "booking_hour",
    """SELECT entity, date, dayname(date) AS weekday, hour, CAST(sum(guests) AS BIGINT) AS booking_guests,
  count(*) AS booking_count FROM booking GROUP BY entity, date, hour""",
    ["booking"],
)
_DAILY_BOOK = """SELECT entity, CAST(date AS VARCHAR) AS date, weekday, hour, booking_guests, booking_count,
  CAST(sum(booking_guests) OVER w AS BIGINT) AS booking_guests_daily,
  CAST(sum(booking_count) OVER w AS BIGINT) AS booking_count_daily
  FROM booking_hour WINDOW w AS (PARTITION BY entity, booking_hour.date)"""


@query(
    "agg_booking_hour",
    with_("SELECT entity, CAST(date AS VARCHAR) AS date, weekday, hour, booking_guests, booking_count FROM booking_hour", "booking_hour"),
)
def agg_booking_hour(spark, sf):
    return facts.booking_hour(I.booking(spark, sf)).drop("booking_guests_daily", "booking_count_daily")


@query("jn_booking_daily", with_(_DAILY_BOOK, "booking_hour"))
def jn_booking_daily(spark, sf):
    return facts.booking_hour(I.booking(spark, sf))


cte("booking_day", "SELECT entity, date, CAST(sum(guests) AS BIGINT) AS booking_guests FROM booking GROUP BY ALL", ["booking"])


@query(
    "agg_booking_day",
    with_("SELECT entity, CAST(date AS VARCHAR) AS date, booking_guests FROM booking_day", "booking_day"),
)
def agg_booking_day(spark, sf):
    return facts.booking_day(I.booking(spark, sf))


@query(
    "agg_booking_top",
    with_(
        """SELECT 'total' AS section, unnest(['guests', 'bookings', 'entities', 'dates']) AS key,
          unnest([g, b, e, d]) AS value FROM (SELECT CAST(sum(booking_guests) AS DOUBLE) AS g,
          CAST(sum(booking_count) AS DOUBLE) AS b, CAST(count(DISTINCT entity) AS DOUBLE) AS e,
          CAST(count(DISTINCT date) AS DOUBLE) AS d FROM booking_hour)
        UNION ALL SELECT * FROM (SELECT 'entity', entity, CAST(sum(booking_guests) AS DOUBLE) AS v FROM booking_hour
          GROUP BY entity ORDER BY v DESC, entity LIMIT 5)
        UNION ALL SELECT * FROM (SELECT 'date', CAST(date AS VARCHAR) AS k, CAST(sum(booking_guests) AS DOUBLE) AS v
          FROM booking_hour GROUP BY k ORDER BY v DESC, k LIMIT 5)""",
        "booking_hour",
    ),
)
def agg_booking_top(spark, sf):
    return facts.booking_top(facts.booking_hour(I.booking(spark, sf)))


# -- shares -----------------------------------------------------------------------------------

_KIND = "CASE WHEN isodow(date) >= 6 THEN 'weekend' ELSE 'weekday' END"


def _kinds(src: str, col: str) -> str:
    """Rows of an entity that has one day kind only stand for both kinds."""
    return f"""SELECT entity, unnest(CASE WHEN count(DISTINCT day_kind) OVER (PARTITION BY entity) = 1
    THEN ['weekday', 'weekend'] ELSE [day_kind] END) AS day_kind, {col}, round(ratio, 9) AS ratio FROM {src}"""


cte(
    "hour_share",
    f"""SELECT entity, day_kind, hour, r / sum(r) OVER (PARTITION BY entity, day_kind) AS ratio FROM (
  SELECT *, v / nullif(sum(v) OVER (PARTITION BY entity, day_kind), 0) AS r FROM (
    SELECT entity, {_KIND} AS day_kind, hour, sum(guests) AS v, avg(guests) AS mean FROM txn GROUP BY 1, 2, 3))
  WHERE r > 0.01 AND mean >= 0.5""",
    ["txn"],
)


@query("agg_hour_ratio", with_(_kinds("hour_share", "hour"), "hour_share"))
def agg_hour_ratio(spark, sf):
    return facts.hour_ratio(I.txn(spark, sf)).withColumn("ratio", F.round("ratio", 9))


cte(
    "weighted_txn",
    """SELECT *, dayname(date) AS weekday, guests * CASE WHEN max(date) OVER (PARTITION BY entity) - date <= 30
  THEN 3.0 ELSE 1.0 END AS wg FROM txn""",
    ["txn"],
)


@query(
    "agg_wd_hour_ratio",
    with_(
        """SELECT entity, weekday, hour, round(r / sum(r) OVER (PARTITION BY entity, weekday), 9) AS ratio FROM (
        SELECT *, v / nullif(sum(v) OVER (PARTITION BY entity, weekday), 0) AS r FROM (
          SELECT entity, weekday, hour, sum(wg) AS v, avg(guests) AS mean FROM weighted_txn GROUP BY ALL))
        WHERE r > 0.01 AND mean >= 0.5""",
        "weighted_txn",
    ),
)
def agg_wd_hour_ratio(spark, sf):
    return facts.weekday_hour_ratio(I.txn(spark, sf)).withColumn("ratio", F.round("ratio", 9))


cte(
    "shift_share",
    f"""SELECT entity, day_kind, shift, v / nullif(sum(v) OVER (PARTITION BY entity, day_kind), 0) AS ratio FROM (
  SELECT entity, {_KIND} AS day_kind, {SHIFT_SQL} AS shift, sum(guests) AS v FROM txn WHERE hour >= 8 GROUP BY 1, 2, 3)""",
    ["txn"],
)


@query("agg_shift_ratio", with_(_kinds("shift_share", "shift"), "shift_share"))
def agg_shift_ratio(spark, sf):
    return facts.shift_ratio(I.txn(spark, sf)).withColumn("ratio", F.round("ratio", 9))


cte(
    "wd_shift_ratio",
    f"""SELECT entity, weekday, shift, v / sum(v) OVER (PARTITION BY entity, weekday) AS ratio FROM (
  SELECT entity, weekday, {SHIFT_SQL} AS shift, sum(g) AS v FROM (
    SELECT entity, dayname(date) AS weekday, hour, guests * CASE WHEN max(date) OVER (PARTITION BY entity) - date <= 30
      THEN 3.0 ELSE 1.0 END AS g FROM txn WHERE hour >= 8) GROUP BY ALL)""",
    ["txn"],
)


@query("agg_wd_shift_ratio", with_("SELECT entity, weekday, shift, round(ratio, 9) AS ratio FROM wd_shift_ratio", "wd_shift_ratio"))
def agg_wd_shift_ratio(spark, sf):
    return facts.weekday_shift_ratio(I.txn(spark, sf)).withColumn("ratio", F.round("ratio", 9))


cte(
    "hist_shift_ratio",
    """SELECT entity, weekday, unnest(['MORNING', 'EVENING']) AS shift,
  unnest([CASE WHEN m + e > 0 THEN m / (m + e) ELSE 0.45 END, CASE WHEN m + e > 0 THEN e / (m + e) ELSE 0.55 END]) AS ratio
  FROM (SELECT entity, dayname(date) AS weekday, coalesce(sum(guests) FILTER (shift = 'MORNING'), 0) AS m,
    coalesce(sum(guests) FILTER (shift = 'EVENING'), 0) AS e FROM guest_shift GROUP BY ALL)""",
    ["guest_shift"],
)


@query("agg_hist_shift_ratio", with_("SELECT entity, weekday, shift, round(ratio, 9) AS ratio FROM hist_shift_ratio", "hist_shift_ratio"))
def agg_hist_shift_ratio(spark, sf):
    g = facts.guest_facts(I.txn(spark, sf), by_shift=True)
    return facts.hist_shift_ratio(g).withColumn("ratio", F.round("ratio", 9))


cte(
    "item_shift_ratio",
    """SELECT entity, item, unnest(['MORNING', 'EVENING']) AS shift, unnest([m / (m + e), e / (m + e)]) AS ratio
  FROM (SELECT entity, item, coalesce(sum(quantity) FILTER (shift = 'MORNING'), 0) AS m,
    coalesce(sum(quantity) FILTER (shift = 'EVENING'), 0) AS e FROM item_shift GROUP BY ALL)""",
    ["item_shift"],
)


@query("agg_item_shift_ratio", with_("SELECT entity, item, shift, round(ratio, 9) AS ratio FROM item_shift_ratio", "item_shift_ratio"))
def agg_item_shift_ratio(spark, sf):
    s = item_facts(spark, sf, by_shift=True)
    return facts.item_shift_ratio(s).withColumn("ratio", F.round("ratio", 9))


@query(
    "agg_window_mean",
    with_(
        """SELECT entity, dayname(date) AS weekday, round(avg(guests) FILTER (date >= DATE '2001-08-01' - 30), 4) AS mean_30d,
        round(avg(guests) FILTER (date >= DATE '2001-08-01' - 60), 4) AS mean_60d, round(avg(guests), 4) AS mean_90d
        FROM day WHERE date >= DATE '2001-08-01' - 90 AND date < DATE '2001-08-01' GROUP BY ALL""",
        "day",
    ),
)
def agg_window_mean(spark, sf):
    m = facts.window_mean(I.daily(spark, sf), I.AS_OF)
    return m.select("entity", "weekday", *[F.round(c, 4).alias(c) for c in m.columns[2:]])


@query(
    "agg_active",
    with_(
        """SELECT entity, CAST(max(date) AS VARCHAR) AS last_date FROM txn GROUP BY entity
        HAVING max(date) >= DATE '2001-08-01' - 30""",
        "txn",
    ),
)
def agg_active(spark, sf):
    return facts.active_entities(I.txn(spark, sf), I.AS_OF)


@query(
    "set_active_codes",
    with_("SELECT DISTINCT entity FROM txn ORDER BY entity", "txn"),
)
def set_active_codes(spark, sf):
    return I.txn(spark, sf).select("entity").distinct().orderBy("entity")
