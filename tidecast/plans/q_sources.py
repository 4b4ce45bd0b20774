"""Queries: scans, sources and sinks (not the ledger ones)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecast.functions.clean import shift_of  # noqa: F401
from tidecast.operators import facts
from tidecast.plans import inputs as I
from tidecast.plans.registry import cte, query, with_
from tidecast.session import fresh_path
from tidecast.sources import readers, sinks

START, END = "1997-01-01", "1999-01-01"
RANGE = f"date >= DATE '{START}' AND date < DATE '{END}'"


@query(
    "src_txn_range",
    with_(
        f"""SELECT entity, transaction_id, guests, CAST(open_time AS VARCHAR) AS open_time,
        CAST(date AS VARCHAR) AS date, source FROM two_sources WHERE {RANGE}""",
        "two_sources",
    ),
)
def src_txn_range(spark, sf):
    return readers.txn_range(I.raw_a(spark, sf), I.raw_b(spark, sf), START, END)


@query(
    "src_txn_revenue",
    with_(
        f"""SELECT entity, transaction_id, guests, revenue, CAST(open_time AS VARCHAR) AS open_time,
        CAST(date AS VARCHAR) AS date, source FROM two_sources WHERE {RANGE}""",
        "two_sources",
    ),
)
def src_txn_revenue(spark, sf):
    return readers.txn_range(I.raw_a(spark, sf), I.raw_b(spark, sf), START, END, revenue=True)


@query(
    "src_booking",
    with_(
        f"""SELECT entity, CAST(date AS VARCHAR) AS date, dayname(date) AS weekday, hour, guests
        FROM booking WHERE {RANGE}""",
        "booking",
    ),
)
def src_booking(spark, sf):
    return readers.bookings(I.raw_booking(spark, sf), START, END)


@query("src_entity_dim", with_("SELECT * FROM dim", "dim"))
def src_entity_dim(spark, sf):
    return I.entity_dim(spark, sf)


@query(
    "src_entity_by_name",
    with_(
        """SELECT DISTINCT merge_key AS entity FROM dim_raw
        WHERE lower(restaurant_name) LIKE '%build%' OR lower(restaurant_name) LIKE '%machin%'""",
        "dim_raw",
    ),
)
def src_entity_by_name(spark, sf):
    dim = facts.norm_key(F.col("restaurant_code"))
    d = I.entity_dim_raw(spark, sf).withColumn("merge_key", dim)
    return readers.entities_by_name(d, ["Build", "Machin"])


cte("codes", "SELECT DISTINCT merge_key AS entity FROM dim WHERE lower(restaurant_name) LIKE '%build%' OR merge_key = 'R0'", ["dim"])
cte(
    "deduped",
    """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id
  ORDER BY guests DESC, source) AS rn FROM two_sources) WHERE rn = 1""",
    ["two_sources"],
)


def _codes(spark, sf):
    d = I.entity_dim(spark, sf)
    return d.where(F.lower("restaurant_name").contains("build") | (F.col("merge_key") == "R0")).select(
        F.col("merge_key").alias("entity")
    )


def _two(spark, sf, revenue=True):
    return facts.union_txn(
        facts.source_a(I.raw_a(spark, sf), revenue), facts.source_b(I.raw_b(spark, sf), revenue)
    )


@query(
    "src_txn_filtered",
    with_(
        f"""SELECT entity, transaction_id, guests, CAST(date AS VARCHAR) AS date, source FROM deduped
        WHERE {RANGE} AND entity IN (SELECT entity FROM codes)""",
        "deduped", "codes",
    ),
)
def src_txn_filtered(spark, sf):
    out = readers.txn_filtered(_two(spark, sf, False), _codes(spark, sf), START, END)
    return out.drop("open_time")


@query(
    "src_items",
    with_(
        f"""SELECT entity, CAST(date AS VARCHAR) AS date, hour, transaction_id, item, quantity, item_name, item_group
        FROM item_txn WHERE {RANGE} AND entity IN (SELECT entity FROM codes) AND item_group LIKE 'Brand#1%'""",
        "item_txn", "codes",
    ),
)
def src_items(spark, sf):
    cat = I.catalog(spark, sf)
    wanted = cat.where(F.col("item_group").startswith("Brand#1")).select("item")
    out = readers.items_filtered(
        I.txn(spark, sf), I.items(spark, sf), cat, _codes(spark, sf), wanted, START, END
    )
    return out.select("entity", "date", "hour", "transaction_id", "item", "quantity", "item_name", "item_group")


_TEXTS = ["Mở", "Đóng ", "Bán nửa ngày", "convert", "Trực", "Bán sáng", ""]
_DAYS = ["2001-08-10", "2001-08-11", "2001-08-12"]


def closure_wide(spark, sf):
    k = F.col("c_custkey")
    texts = F.array(*[F.lit(t) for t in _TEXTS])
    cols = [
        F.get(texts, ((k + i) % len(_TEXTS)).cast("int")).alias(d if i else "10/08/2001")
        for i, d in enumerate(_DAYS)
    ]
    sap = F.concat(F.lit(" "), F.lpad(k.cast("string"), 12, "0"), F.lit(".0"))
    return I.table(spark, sf, "customer").select(sap.alias("SAP"), *cols)


_STATUS_SQL = "CASE (c_custkey + i) % 7 WHEN 1 THEN 'CLOSED' WHEN 3 THEN 'CLOSED' WHEN 2 THEN 'HALF_DAY' WHEN 4 THEN 'HALF_DAY' WHEN 5 THEN 'HALF_DAY' END"
cte(
    "schedule",
    f"""SELECT merge_key AS entity, sap_code, CAST(DATE '2001-08-10' + i AS VARCHAR) AS date, {_STATUS_SQL} AS status
  FROM customer CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS i)
  JOIN dim_raw ON sap_code = lpad(CAST(c_custkey AS VARCHAR), 12, '0') WHERE (c_custkey + i) % 7 BETWEEN 1 AND 5""",
    ["dim_raw"],
)


def dim_keys(spark, sf):
    d = I.entity_dim_raw(spark, sf)
    return d.select(facts.norm_key(F.col("restaurant_code")).alias("merge_key"), "sap_code")


def schedule(spark, sf):
    return readers.closure_long(closure_wide(spark, sf), dim_keys(spark, sf))


@query("src_closure_wide", with_("SELECT * FROM schedule", "schedule"))
def src_closure_wide(spark, sf):
    return schedule(spark, sf)


def open_close_rows(spark, sf):
    """Store list: codes, status and dates in mixed layouts, from the customers."""
    k = F.col("c_custkey")
    base = F.lit("2001-08-01").cast("date")
    n = (k % 400).cast("int")
    short = F.lpad(k.cast("string"), 9, "0")
    return I.table(spark, sf, "customer").select(
        F.concat(F.lit("01AB"), short).alias("code_budget"),
        F.concat(F.lit("REP"), k.cast("string")).alias("code_report"),
        F.element_at(F.array(*[F.lit(x) for x in ("Active", "closed ", "ACTIVE", "Not yet open", "Double code")]),
                     (k % 5 + 1).cast("int")).alias("status"),
        F.when(k % 3 != 2, F.date_format(F.date_sub(base, n), "yyyy-MM-dd")).alias("closing_date"),
        F.when(k % 4 < 2, F.date_format(F.date_add(F.date_sub(base, n), (k % 450).cast("int")), "yyyy-MM-dd HH:mm:ss"))
        .alias("reopening_date"),
        F.when(k % 11 == 0, F.date_format(F.date_add(base, 20), "dd/MM/yyyy"))
        .when(k % 5 == 3, F.date_format(F.date_add(base, (k % 60).cast("int") - 10), "yyyy-MM-dd")).alias("opening_date"),
        F.col("c_name").alias("store"),
    )


def open_close_dim(spark, sf):
    """Known codes: by budget, report, short or zero-stripped code; every ninth is unknown."""
    c = I.table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    k = F.col("o_custkey")
    short = F.lpad(k.cast("string"), 9, "0")
    code = (
        F.when(k % 4 == 0, F.concat(F.lit("01AB"), short)).when(k % 4 == 1, F.concat(F.lit("REP"), k.cast("string")))
        .when(k % 4 == 2, short).otherwise(F.concat(F.lit("00"), short))
    )
    return c.where(k % 9 != 4).select(code.alias("sap_code"), F.concat(F.lit("E"), k.cast("string")).alias("entity"))


cte(
    "store_list",
    """SELECT '01AB' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS code_budget, c_custkey AS k,
  ['ACTIVE', 'CLOSED', 'ACTIVE', 'NOT YET OPEN', 'DOUBLE CODE'][c_custkey % 5 + 1] AS listed,
  CASE WHEN c_custkey % 9 <> 4 THEN 'E' || CAST(c_custkey AS VARCHAR) END AS entity,
  CASE WHEN c_custkey % 9 <> 4 THEN c_custkey % 4 END AS match_rank,
  CASE WHEN c_custkey % 3 <> 2 THEN DATE '2001-08-01' - CAST(c_custkey % 400 AS INTEGER) END AS closing,
  CASE WHEN c_custkey % 4 < 2 THEN DATE '2001-08-01' - CAST(c_custkey % 400 AS INTEGER) + CAST(c_custkey % 450 AS INTEGER) END AS reopen,
  CASE WHEN c_custkey % 11 = 0 THEN DATE '2001-08-21' WHEN c_custkey % 5 = 3 THEN DATE '2001-08-01' + CAST(c_custkey % 60 - 10 AS INTEGER) END AS opening
  FROM customer""",
)
cte(
    "open_close",
    """SELECT code_budget, output, key, state, from_date, to_date FROM (
  SELECT code_budget, 'future_open' AS output,
    coalesce(CASE WHEN listed <> 'NOT YET OPEN' OR match_rank IN (0, 2) THEN entity END, code_budget) AS key,
    listed AS state, opening AS from_date, CAST(NULL AS DATE) AS to_date FROM store_list
    WHERE listed <> 'DOUBLE CODE' AND opening > DATE '2001-08-01'
  UNION ALL SELECT code_budget, 'temp_closed', entity, 'ACTIVE', closing, coalesce(reopen, DATE '2001-08-01') FROM store_list
    WHERE listed = 'ACTIVE' AND entity IS NOT NULL AND closing < coalesce(reopen, DATE '2001-08-01')
  UNION ALL SELECT code_budget, 'temp_closed', entity, 'ACTIVE', closing, reopen FROM store_list
    WHERE listed = 'CLOSED' AND entity IS NOT NULL AND reopen <= DATE '2001-08-01' AND closing < reopen
  UNION ALL SELECT code_budget, 'reopened', entity, 'ACTIVE', reopen, NULL FROM store_list
    WHERE entity IS NOT NULL AND reopen <= DATE '2001-08-01' AND (listed = 'CLOSED' OR (listed = 'ACTIVE' AND closing < reopen))
  UNION ALL SELECT code_budget, unnest(['closed', 'status']), entity, 'CLOSED', closing, CASE WHEN reopen > DATE '2001-08-01' THEN reopen END
    FROM store_list WHERE listed = 'CLOSED' AND entity IS NOT NULL AND (reopen IS NULL OR reopen > DATE '2001-08-01')
  UNION ALL SELECT code_budget, 'status', entity, 'ACTIVE', closing, reopen FROM store_list
    WHERE entity IS NOT NULL AND (listed = 'ACTIVE' OR (listed = 'CLOSED' AND reopen <= DATE '2001-08-01')))""",
    ["store_list"],
)


def open_close(spark, sf):
    return readers.open_close(open_close_rows(spark, sf), open_close_dim(spark, sf), I.AS_OF)


@query(
    "src_open_close",
    with_(
        """SELECT code_budget, output, key, state, CAST(from_date AS VARCHAR) AS from_date,
        CAST(to_date AS VARCHAR) AS to_date FROM open_close""",
        "open_close",
    ),
)
def src_open_close(spark, sf):
    return open_close(spark, sf)


@query(
    "jn_code_priority",
    with_("SELECT code_budget, entity, CAST(match_rank AS BIGINT) AS match_rank FROM store_list", "store_list"),
)
def jn_code_priority(spark, sf):
    from tidecast.functions.clean import ext_code

    rows = open_close_rows(spark, sf).withColumn("code_short", ext_code(F.col("code_budget")))
    out = readers.lookup_by_priority(
        rows, "code_budget", ["code_budget", "code_report", "code_short"], "code_short", open_close_dim(spark, sf)
    )
    return out.select("code_budget", "entity", F.col("match_rank").cast("long").alias("match_rank"))


@query(
    "src_daily_extract",
    with_(
        """SELECT CAST(date AS VARCHAR) AS date, sum(g) AS guests, CAST(sum(t) AS BIGINT) AS transactions,
        count(DISTINCT entity) AS active_entities, dayname(date) AS weekday, CAST(month(date) AS INTEGER) AS month,
        CAST(year(date) AS INTEGER) AS year, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week
        FROM (SELECT CAST(coalesce(open_time, date) AS DATE) AS date, entity, source, sum(guests) AS g,
          count(DISTINCT transaction_id) AS t FROM two_sources GROUP BY 1, 2, 3) GROUP BY date""",
        "two_sources",
    ),
)
def src_daily_extract(spark, sf):
    return facts.daily_extract(
        facts.source_a(I.raw_a(spark, sf)), facts.source_b(I.raw_b(spark, sf))
    )


_MONTH_COLS = "year, month, guests, round(revenue, 2) AS revenue, transactions, entities, active_days"


def _r2(df):
    return df.withColumn("revenue", F.round("revenue", 2))


@query(
    "src_store_sales_month",
    with_(
        """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(guests) AS guests,
        round(sum(revenue), 2) AS revenue, count(*) AS transactions, count(DISTINCT entity) AS entities,
        count(DISTINCT date) AS active_days FROM txn GROUP BY 1, 2 HAVING count(DISTINCT date) >= 25""",
        "txn",
    ),
)
def src_store_sales_month(spark, sf):
    sales = I.txn(spark, sf).select(
        F.col("date").cast("string").alias("Date"), F.col("revenue").cast("string").alias("Sales_Act"),
        F.col("guests").cast("string").alias("TC"), F.col("entity").alias("Store"),
    )
    return _r2(readers.store_sales_month(sales))


cte("by_date", "SELECT date, sum(guests) AS guests, count(*) AS n, count(DISTINCT entity) AS stores FROM txn GROUP BY date", ["txn"])


@query(
    "src_daily_csv_month",
    with_(
        """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(guests) AS guests,
        CAST(0.0 AS DOUBLE) AS revenue, CAST(sum(n) AS BIGINT) AS transactions, count(*) AS entities, count(*) AS active_days
        FROM by_date GROUP BY 1, 2 HAVING count(*) >= 25""",
        "by_date",
    ),
)
def src_daily_csv_month(spark, sf):
    path = fresh_path(spark, "daily-csv")
    day = I.txn(spark, sf).groupBy("date").agg(
        F.sum("guests").alias("guests"), F.count("*").alias("total_transactions")
    )
    sinks.write_report(day, path)
    return readers.daily_csv_month(spark, path)


cte(
    "month_dedup",
    """SELECT CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, sum(guests) AS guests,
  sum(revenue) AS revenue, count(*) AS transactions, count(DISTINCT entity) AS entities, count(DISTINCT date) AS active_days
  FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY source) AS rn FROM two_sources)
  WHERE rn = 1 GROUP BY 1, 2""",
    ["two_sources"],
)


def month_dedup(spark, sf):
    return facts.month_dedup(_two(spark, sf))


@query("agg_month_dedup", with_(f"SELECT {_MONTH_COLS} FROM month_dedup", "month_dedup"))
def agg_month_dedup(spark, sf):
    return _r2(month_dedup(spark, sf))


cte(
    "month_derived",
    """SELECT *, guests / active_days AS avg_daily_guests, guests / (active_days * entities) AS avg_guests_entity_day,
  revenue / nullif(guests, 0) AS revenue_per_guest, revenue / active_days AS avg_daily_revenue
  FROM month_dedup WHERE active_days >= 25 OR (year = 2001 AND month = 8)""",
    ["month_dedup"],
)


def month_derived(spark, sf):
    return facts.month_derived(month_dedup(spark, sf), I.AS_OF)


@query(
    "agg_month_derived",
    with_(
        f"""SELECT {_MONTH_COLS}, round(avg_daily_guests, 4) AS avg_daily_guests,
        round(avg_guests_entity_day, 4) AS avg_guests_entity_day, round(revenue_per_guest, 4) AS revenue_per_guest,
        round(avg_daily_revenue, 2) AS avg_daily_revenue FROM month_derived""",
        "month_derived",
    ),
)
def agg_month_derived(spark, sf):
    m = _r2(month_derived(spark, sf))
    for c in ("avg_daily_guests", "avg_guests_entity_day", "revenue_per_guest"):
        m = m.withColumn(c, F.round(c, 4))
    return m.withColumn("avg_daily_revenue", F.round("avg_daily_revenue", 2))


@query(
    "src_priority_fallback",
    with_(
        """SELECT m.year, m.month, 0 AS priority, m.guests FROM month_dedup m WHERE m.year < 1998
        UNION ALL SELECT s.year, s.month, 1, s.guests FROM (SELECT CAST(year(date) AS INTEGER) AS year,
          CAST(month(date) AS INTEGER) AS month, sum(guests) AS guests FROM txn GROUP BY 1, 2) s
        WHERE s.year >= 1998""",
        "month_dedup", "txn",
    ),
)
def src_priority_fallback(spark, sf):
    first = month_dedup(spark, sf).where("year < 1998").select("year", "month", "guests")
    t = I.txn(spark, sf)
    second = t.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("guests").alias("guests")
    )
    return readers.priority_fallback([first, second])


@query(
    "snk_state",
    with_("SELECT entity, 'all' AS scope, round(avg(guests), 6) AS value, count(*) AS count FROM day GROUP BY entity", "day"),
)
def snk_state(spark, sf):
    d = I.daily(spark, sf)
    state = d.groupBy("entity").agg(F.round(F.avg("guests"), 6).alias("value"), F.count("*").alias("count"))
    root = fresh_path(spark, "brain")
    sinks.save_state(state.select("entity", F.lit("old").alias("scope"), "value", "count"), root)
    sinks.save_state(state.select("entity", F.lit("all").alias("scope"), "value", "count"), root)
    return sinks.load_state(spark, root)


@query(
    "snk_history_90",
    with_(
        """SELECT CAST(date AS VARCHAR) AS date, guests FROM (
        SELECT date, CASE WHEN date = DATE '2001-08-01' THEN -1.0 ELSE guests END AS guests FROM by_date
        UNION SELECT DATE '2001-08-01', -1.0) ORDER BY date DESC LIMIT 90""",
        "by_date",
    ),
)
def snk_history_90(spark, sf):
    hist = I.txn(spark, sf).groupBy("date").agg(F.sum("guests").alias("guests"))
    today = hist.limit(1).select(F.lit(I.AS_OF).cast("date").alias("date"), F.lit(-1.0).alias("guests"))
    return sinks.history_keep(hist, today)


@query(
    "snk_run_history",
    with_(
        """SELECT CAST(run_date AS VARCHAR) AS run_date, CAST(max(date) AS VARCHAR) AS recorded_at,
        arg_max(guests, date) AS guests FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS run_date, date, guests FROM by_date)
        GROUP BY run_date""",
        "by_date",
    ),
)
def snk_run_history(spark, sf):
    hist = I.txn(spark, sf).groupBy("date").agg(F.sum("guests").alias("guests"))
    rec = hist.select(
        F.trunc("date", "week").alias("run_date"), F.col("date").alias("recorded_at"), "guests"
    )
    return sinks.run_history(rec)


@query(
    "snk_reports",
    with_("SELECT entity, CAST(date AS VARCHAR) AS date, CAST(guests AS BIGINT) AS guests FROM day", "day"),
)
def snk_reports(spark, sf):
    path = fresh_path(spark, "report-json")
    day = I.daily(spark, sf).withColumn("guests", F.col("guests").cast("long"))
    sinks.write_report(day, path, "json")
    return spark.read.schema("entity string, date date, guests long").json(path)
