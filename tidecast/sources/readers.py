"""Readers. Each returns one fixed schema whatever the store delivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.functions.clean import name_norm, num_coerce
from tidecast.operators import facts


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Any Spark source; ``fmt='jdbc'`` with url/dbtable options reads a database."""
    reader = spark.read.format(fmt).options(**options)
    return reader.load() if fmt == "jdbc" else reader.load(path)


def txn_range(a: DataFrame, b: DataFrame, start: str, end: str, revenue: bool = False) -> DataFrame:
    """Both transaction sources in ``[start, end)``, cleaned; the range filters the scans."""
    a = facts.in_range(a, "shift_date", start, end)
    b = facts.in_range(b, "shiftdate", start, end)
    return facts.union_txn(facts.source_a(a, revenue), facts.source_b(b, revenue))


def bookings(raw: DataFrame, start: str, end: str) -> DataFrame:
    """Bookings in range without the cancelled ones."""
    d = F.try_to_timestamp("shift_date").cast("date")
    in_time = (d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date"))
    return facts.clean_booking(facts.drop_cancelled(raw.where(in_time)))


def entities_by_name(dim: DataFrame, patterns: list[str]) -> DataFrame:
    """Distinct entities whose name contains one of the patterns, any case."""
    name = F.lower("restaurant_name")
    hit = F.lit(False)
    for p in patterns:
        hit = hit | name.contains(p.lower())
    return dim.where(hit).select(F.col("merge_key").alias("entity")).distinct()


def txn_filtered(txn: DataFrame, codes: DataFrame, start: str, end: str) -> DataFrame:
    """Transactions of a set of entities, one row per id."""
    kept = facts.in_range(txn, "date", start, end).join(codes, "entity", "left_semi")
    return facts.dedup_highest(kept)


def items_filtered(
    txn: DataFrame, items: DataFrame, catalog: DataFrame, codes: DataFrame, wanted: DataFrame,
    start: str, end: str,
) -> DataFrame:
    """Item lines of chosen items in the transactions of chosen entities."""
    t = facts.in_range(txn, "date", start, end).join(codes, "entity", "left_semi")
    i = items.join(wanted, "item", "left_semi")
    return facts.join_items(t, i, catalog)


def month_full(month: DataFrame, min_days: int = 25) -> DataFrame:
    return month.where(F.col("active_days") >= min_days)


def store_sales_month(sales: DataFrame) -> DataFrame:
    """Store-sales rows to months: positive rows only, full months only."""
    s = sales.select(
        F.try_to_timestamp("Date").cast("date").alias("date"),
        num_coerce(F.col("Sales_Act")).alias("revenue"),
        num_coerce(F.col("TC")).alias("guests"),
        F.col("Store").alias("entity"),
    ).where("date is not null and (revenue > 0 or guests > 0)")
    day = s.groupBy("entity", "date").agg(
        F.sum("guests").alias("guests"), F.sum("revenue").alias("revenue"), F.count("*").alias("n")
    )
    return month_full(facts.month_rollup(day))


def daily_csv_month(spark: SparkSession, path: str) -> DataFrame:
    """Daily totals in CSV to months; missing optional columns get their fallbacks."""
    df = spark.read.option("header", True).csv(path)
    has = set(df.columns)
    d = df.select(
        F.to_date(F.try_to_timestamp("date")).alias("date"),
        num_coerce(F.col("guests")).alias("guests"),
        (num_coerce(F.col("revenue")) if "revenue" in has else F.lit(0.0)).alias("revenue"),
        (num_coerce(F.col("total_transactions")) if "total_transactions" in has else F.lit(1.0)).alias("n"),
        (num_coerce(F.col("active_restaurants")) if "active_restaurants" in has else F.lit(None).cast("double"))
        .alias("stores"),
    ).where("guests > 0")
    m = d.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("guests").alias("guests"),
        F.sum("revenue").alias("revenue"),
        F.sum("n").cast("long").alias("transactions"),
        F.coalesce(F.max("stores"), F.count("*")).cast("long").alias("entities"),
        F.count_distinct("date").alias("active_days"),
    )
    return month_full(m)


def ledger_month(ledger: DataFrame) -> DataFrame:
    """Observed guests in the ledger to months."""
    return (
        ledger.where("actual > 0")
        .groupBy(F.year("date").alias("year"), F.month("date").alias("month"))
        .agg(
            F.sum("actual").alias("guests"),
            F.count("*").alias("transactions"),
            F.count_distinct("entity").alias("entities"),
            F.count_distinct("date").alias("active_days"),
        )
        .withColumn("revenue", F.lit(0.0))
    )


def priority_fallback(months: list[DataFrame]) -> DataFrame:
    """First source that has a month wins."""
    out = None
    for i, m in enumerate(months):
        tagged = m.withColumn("priority", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("year", "month", "priority")]
    best = out.groupBy("year", "month").agg(F.min(F.struct("priority", *rest)).alias("b"))
    return best.select("year", "month", "b.*")


def closure_long(wide: DataFrame, dim: DataFrame) -> DataFrame:
    """Wide schedule (one column per date) to entity, date, CLOSED or HALF_DAY."""
    from tidecast.functions.clean import closure_status

    dates = [c for c in wide.columns if c != "SAP"]
    sap = F.regexp_replace(F.trim("SAP"), r"\.0$", "")
    text = wide.select(sap.alias("sap_code"), *[F.col(f"`{c}`") for c in dates]).unpivot(
        ["sap_code"], [F.col(f"`{c}`") for c in dates], "day", "text"
    )
    day = F.coalesce(
        *[F.try_to_timestamp("day", F.lit(f)) for f in ("dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    ).cast("date")
    codes = dim.groupBy("sap_code").agg(F.min("merge_key").alias("entity"))
    return (
        text.select("sap_code", day.alias("date"), closure_status(F.col("text")).alias("status"))
        .where("date is not null and status <> 'OPEN'")
        .join(codes, "sap_code")
        .select("entity", "sap_code", "date", "status")
    )


def lookup_by_priority(rows: DataFrame, key: str, candidates: list[str], stripped: str, dim: DataFrame) -> DataFrame:
    """Adds ``entity``: first candidate code found in ``dim`` (sap_code, entity), else the
    ``stripped`` code compared without leading zeros; also the rank that matched."""
    arr = [F.struct(F.lit(i).alias("rank"), F.lit("raw").alias("kind"), F.col(c).alias("code"))
           for i, c in enumerate(candidates)]
    arr.append(F.struct(F.lit(len(candidates)).alias("rank"), F.lit("strip").alias("kind"),
                        F.ltrim(F.col(stripped), F.lit("0")).alias("code")))
    cand = rows.select(key, F.inline(F.array(*arr)))
    keys = dim.select(F.lit("raw").alias("kind"), F.col("sap_code").alias("code"), "entity").unionByName(
        dim.select(F.lit("strip").alias("kind"), F.ltrim(F.col("sap_code"), F.lit("0")).alias("code"), "entity")
    )
    keys = keys.groupBy("kind", "code").agg(F.min("entity").alias("entity"))
    found = cand.join(keys, ["kind", "code"]).groupBy(key).agg(
        F.min(F.struct("rank", "entity")).alias("m")
    )
    return rows.join(found, key, "left").select(
        *[F.col(c) for c in rows.columns], F.col("m.entity").alias("entity"), F.col("m.rank").alias("match_rank")
    )


def open_close(rows: DataFrame, dim: DataFrame, today: str) -> DataFrame:
    """Open/close list to its outputs, one row per (output, key): closed, reopened,
    temp_closed windows, future_open and the overall status."""
    from tidecast.functions.clean import ext_code, parse_date_multi

    t = F.lit(today).cast("date")
    r = rows.where(F.trim(F.coalesce("code_budget", F.lit(""))) != "").select(
        F.trim("code_budget").alias("code_budget"),
        F.trim("code_report").alias("code_report"),
        ext_code(F.col("code_budget")).alias("code_short"),
        F.upper(F.trim("status")).alias("listed"),
        parse_date_multi(F.col("closing_date")).alias("closing"),
        parse_date_multi(F.col("reopening_date")).alias("reopen"),
        parse_date_multi(F.col("opening_date")).alias("opening"),
        F.col("store"),
    )
    r = lookup_by_priority(r, "code_budget", ["code_budget", "code_report", "code_short"], "code_short", dim)
    listed, ent = F.col("listed"), F.col("entity")
    waiting = listed.isin("NOT YET OPEN", "WAITING FOR OPEN")
    running = listed.isin("ACTIVE", "CLOSED")
    # Waiting stores are looked up by budget and short code only.
    known = F.when(running | F.col("match_rank").isin(0, 2), ent)
    r = r.withColumn("entity", known)
    ent = F.col("entity")
    closing, reopen, opening = F.col("closing"), F.col("reopen"), F.col("opening")
    back = reopen <= t
    active = running & ent.isNotNull() & (listed == "ACTIVE")
    closed = running & ent.isNotNull() & (listed == "CLOSED")
    wend = F.coalesce(reopen, t)
    has_window = (active & (closing < wend)) | (closed & back & (closing < reopen))
    none = F.lit(None).cast("date")

    def out(when, name, status, a=none, b=none):
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("output"),
                F.coalesce(ent, F.col("code_budget")).alias("key"),
                status.alias("state"),
                a.alias("from_date"),
                b.alias("to_date"),
            ),
        )

    outs = F.array(
        out((waiting | running) & (opening > t), "future_open", listed, opening),
        out(has_window, "temp_closed", F.lit("ACTIVE"), closing, F.when(active, wend).otherwise(reopen)),
        out((active & has_window & back) | (closed & back), "reopened", F.lit("ACTIVE"), reopen),
        out(closed & ~F.coalesce(back, F.lit(False)), "closed", F.lit("CLOSED"), closing, F.when(reopen > t, reopen)),
        out(active | (closed & F.coalesce(back, F.lit(False))), "status", F.lit("ACTIVE"), closing, reopen),
        out(closed & ~F.coalesce(back, F.lit(False)), "status", F.lit("CLOSED"), closing, F.when(reopen > t, reopen)),
    )
    return r.select("code_budget", F.inline(F.filter(outs, lambda x: x.isNotNull())))


def chain_of(dim: DataFrame, brand_codes: dict[str, str], chains: list[str]) -> DataFrame:
    """Adds ``chain``: brand code first, else the first listed chain whose normalised name
    is inside the normalised store name."""
    codes = F.create_map(*[F.lit(x) for kv in brand_codes.items() for x in kv])
    name = name_norm(F.col("restaurant_name"))
    by_name = F.coalesce(
        *[F.when(F.contains(name, name_norm(F.lit(c))), F.lit(c)) for c in chains]
    )
    return dim.withColumn("chain", F.coalesce(F.try_element_at(codes, F.upper(F.trim("brand_code"))), by_name))
