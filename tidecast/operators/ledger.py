"""Forecast ledger: actuals, merge of runs, dedupe, append, summaries.

Ledger rows: run_date, entity, date, hour, shift, pred, actual, mode and flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidecast.functions.clean import norm_key, parse_date_multi, shift_of

DAY_KEYS = ["entity", "date"]


def load(raw: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Stored rows to ledger rows: normalised keys, readable dates only, every column of
    ``columns`` (name -> type) present."""
    d = parse_date_multi(F.col("date"))
    out = raw.select(
        norm_key(F.coalesce(F.col("entity").cast("string"), F.lit("0"))).alias("entity"), d.alias("date"),
        *[
            (F.col(c).cast("string").try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c)
            for c, t in columns.items() if c not in ("entity", "date")
        ],
    )
    return out.where("date is not null")


def quality(raw: DataFrame, important=("entity", "date", "pred")) -> DataFrame:
    """One row: rows, missing important cells, and whether the ledger may be used."""
    missing = sum((F.col(c).isNull().cast("int") for c in important), F.lit(0))
    q = raw.agg(F.count("*").alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))
    return q.withColumn("usable", (F.col("rows") > 10) & (F.col("missing") < F.col("rows") * 0.5))


class UnusableLedger(ValueError):
    """The loaded ledger lacks too much to be used."""


def load_checked(raw: DataFrame, columns: dict, path: str, important=("entity", "date", "pred"), strict: bool = True) -> tuple[DataFrame, bool]:
    """Loads a delivered ledger into ``path`` and judges it by what the one pass over it counted.

    Rows and missing cells are observed on the rows as delivered, while they are written. With
    ``strict`` an unusable ledger raises after the write, and nothing points to the folder.
    """
    missing = sum((F.col(c).isNull().cast("int") for c in important), F.lit(0))
    seen = Observation()
    counted = raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing"))
    load(counted, columns).write.parquet(path)
    rows, lacking = seen.get["rows"], seen.get["missing"]
    usable = rows > 10 and lacking < rows * 0.5
    if strict and not usable:
        raise UnusableLedger(f"{lacking} missing cells in {rows} rows")
    return raw.sparkSession.read.parquet(path), usable


def _slot(shift: Column, hour: Column) -> Column:
    """Which kind of fact a row is compared with: a shift, an hour or the day."""
    return (
        F.when(shift.isNotNull(), F.concat(F.lit("S"), shift))
        .when(hour.isNotNull(), F.concat(F.lit("H"), hour.cast("string"))).otherwise("D")
    )


def actuals_by_slot(txn: DataFrame, kinds=("H", "S", "D")) -> DataFrame:
    """Observed guests per entity, date and slot, from one scan of the facts."""
    hourly = txn.groupBy("entity", "date", "hour").agg(F.sum("guests").alias("guests"))
    slots = []
    if "H" in kinds:
        slots.append(F.concat(F.lit("H"), F.col("hour").cast("string")))
    if "S" in kinds:
        slots.append(F.concat(F.lit("S"), shift_of(F.col("hour"))))
    if "D" in kinds:
        slots.append(F.lit("D"))
    return (
        hourly.select("entity", "date", "guests", F.explode(F.array(*slots)).alias("slot"))
        .groupBy("entity", "date", "slot").agg(F.sum("guests").alias("real"))
    )


def fill_actuals(ledger: DataFrame, txn: DataFrame, today: str, kinds=("H", "S", "D")) -> DataFrame:
    """Actual, difference and error of hourly, shift and daily rows dated up to today."""
    led = ledger.withColumn("slot", _slot(F.col("shift"), F.col("hour")))
    j = led.join(actuals_by_slot(txn, kinds), [*DAY_KEYS, "slot"], "left")
    known = (F.col("date") <= F.lit(today).cast("date")) & F.col("real").isNotNull()
    j = j.withColumn("actual", F.when(known, F.col("real")).otherwise(F.col("actual")))
    diff = F.col("pred") - F.col("actual")
    return j.withColumns(
        {"diff": diff, "error_pct": diff / F.when(F.col("actual") > 0, F.col("actual")) * 100}
    ).drop("slot", "real")


def fill_guest_actuals(guest_ledger: DataFrame, guest_shift: DataFrame, today: str) -> DataFrame:
    """Guests and distinct transactions of a shift into the guest ledger."""
    real = guest_shift.select(*DAY_KEYS, "shift", F.col("guests").alias("rg"), F.col("transactions").alias("rt"))
    j = guest_ledger.join(real, [*DAY_KEYS, "shift"], "left")
    ok = F.col("date") <= F.lit(today).cast("date")
    j = j.withColumns({"actual": F.when(ok, F.col("rg")), "actual_transactions": F.when(ok, F.col("rt"))})
    diff = F.col("pred") - F.col("actual")
    return j.withColumns(
        {"diff": diff, "error_pct": diff / F.when(F.col("actual") > 0, F.col("actual")) * 100}
    ).drop("rg", "rt")


def fill_item_actuals(item_ledger: DataFrame, item_shift: DataFrame, today: str) -> DataFrame:
    """Quantities of an item in a shift into the item ledger."""
    real = item_shift.groupBy(*DAY_KEYS, "shift", "item").agg(F.sum("quantity").alias("rq"))
    j = item_ledger.join(real, [*DAY_KEYS, "shift", "item"], "left")
    j = j.withColumn("actual", F.when(F.col("date") <= F.lit(today).cast("date"), F.col("rq")))
    diff = F.col("pred") - F.col("actual")
    return j.withColumns(
        {"diff": diff, "error_pct": diff / F.when(F.col("actual") > 0, F.col("actual")) * 100}
    ).drop("rq")


def drop_superseded(prev: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier rows of an entity and date that the new run forecasts again are removed."""
    return prev.join(new.select(*DAY_KEYS).distinct(), DAY_KEYS, "left_anti")


def merge(ledger: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Earlier runs without the superseded rows, past rows of no run, and the new run."""
    t = F.lit(today).cast("date")
    new = new.where(F.col("date") >= t)
    prev = drop_superseded(ledger.where(F.col("run_date") < t), new)
    orphan = ledger.where(F.col("run_date").isNull() & (F.col("date") < t))
    return prev.unionByName(orphan).unionByName(new)


def one_mode(ledger: DataFrame) -> DataFrame:
    """An entity and date with several forecast modes keeps the mode of its latest run."""
    w = W.partitionBy(*DAY_KEYS)
    d = ledger.withColumn("__last", F.max("run_date").over(w))
    d = d.withColumn("__keep", F.mode(F.when(F.col("run_date") == F.col("__last"), F.col("mode")), True).over(w))
    return d.where("mode is null or __keep is null or mode = __keep").drop("__last", "__keep")


def dedup(ledger: DataFrame) -> DataFrame:
    """Newest run per entity, date, hour and shift; missing hour or shift are key values."""
    w = W.partitionBy(
        *DAY_KEYS, F.coalesce("hour", F.lit(-999)), F.coalesce("shift", F.lit("__NONE__"))
    ).orderBy(F.desc_nulls_last("run_date"), F.desc_nulls_last("pred"), F.asc_nulls_last("mode"),
        F.desc_nulls_last("actual"))
    return ledger.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def append_run(ledger: DataFrame, pred: DataFrame, run_date: str, keys: list[str]) -> DataFrame:
    """Rows of the same run and keys are replaced; other runs stay for comparison."""
    new = pred.withColumn("run_date", F.lit(run_date).cast("date"))
    kept = ledger.join(new.select("run_date", *keys).distinct(), ["run_date", *keys], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_item_run(ledger: DataFrame, pred: DataFrame, run_date: str, year: int, keys: list[str]) -> DataFrame:
    """Item variant: only dates of ``year`` stay, new rows from the run date on."""
    in_year = F.year("date") == year
    new = pred.where(in_year & (F.col("date") >= F.lit(run_date).cast("date")))
    return append_run(ledger.where(in_year), new, run_date, keys)


def only_shifts(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("shift").isin("MORNING", "EVENING"))


def attach_booking(ledger: DataFrame, booking_day: DataFrame) -> DataFrame:
    return ledger.drop("booking_guests").join(booking_day, DAY_KEYS, "left")


def summary(ledger: DataFrame, today: str | None = None, entity: str | None = None) -> DataFrame:
    """Daily totals per entity with error and accuracy; ``today`` keeps future dates only."""
    d = ledger
    if today:
        d = d.where(F.col("date") >= F.lit(today).cast("date"))
    if entity:
        d = d.where(F.col("entity") == entity.strip().upper())
    g = d.groupBy(*DAY_KEYS).agg(
        F.sum("pred").alias("predicted_total"), F.sum("actual").alias("__a"), F.count("hour").alias("hours"),
        *([F.avg("confidence").alias("confidence")] if "confidence" in d.columns else []),
    )
    a = F.when(F.col("__a") > 0, F.col("__a"))
    err = F.when(F.col("predicted_total") > 0, F.abs(F.col("predicted_total") - a) / a * 100)
    return g.withColumns(
        {"actual_total": a, "error_pct": err, "accuracy": F.greatest(F.lit(0.0), 100 - err)}
    ).withColumn("accuracy", F.when(F.col("error_pct").isNotNull(), F.col("accuracy"))).drop("__a")


def upcoming(ledger: DataFrame, today: str, entity: str | None = None) -> DataFrame:
    d = ledger.where(F.col("date") >= F.lit(today).cast("date"))
    return d if entity is None else d.where(F.col("entity") == entity)


def detail(ledger: DataFrame, entity: str, n: int = 200) -> DataFrame:
    """Newest ``n`` rows of one entity."""
    return ledger.where(F.col("entity") == entity).orderBy(
        F.desc("date"), F.asc_nulls_last("shift"), F.asc_nulls_last("hour"), F.desc("run_date")
    ).limit(n)



def asof_baseline(ledger: DataFrame, factors: DataFrame, divisor: float) -> DataFrame:
    """Holiday rows rebuilt from a nearby normal day times the holiday factor.

    The baseline is the day total of the same weekday one week before, else one week after,
    else two weeks before; without one, the current total is scaled by factor / divisor.
    factors: date, factor. Candidate days unfold into rows, so the lookup is an equi join."""
    total = ledger.groupBy(*DAY_KEYS).agg(F.sum("pred").alias("total")).where("total > 0")
    hol = total.join(F.broadcast(factors), "date")
    offs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(o).alias("o")) for i, o in enumerate((-7, 7, -14))])
    cand = hol.select("entity", "date", F.inline(offs)).withColumn("base_date", F.expr("date_add(date, o)"))
    near = total.select("entity", F.col("date").alias("base_date"), F.col("total").alias("base"))
    best = cand.join(near, ["entity", "base_date"]).groupBy(*DAY_KEYS).agg(F.min_by("base", "rank").alias("base"))
    new = hol.join(best, DAY_KEYS, "left").select(
        *DAY_KEYS, (F.coalesce(F.col("base") * F.col("factor"), F.col("total") * F.col("factor") / divisor) / F.col("total")).alias("k"),
    )
    j = ledger.join(new, DAY_KEYS, "left")
    return j.withColumn("pred", F.when(F.col("k").isNotNull(), F.bround(F.col("pred") * F.col("k"), 0)).otherwise(F.col("pred"))).drop("k")
