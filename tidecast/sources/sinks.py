"""Sinks: ledger, learned state, accuracy history, run records, report files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.session import fresh_path


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Ledger partitioned by run date; only the run dates in ``ledger`` are replaced."""
    w = ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w.partitionBy("run_date").parquet(path)


def ledger_summaries(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Booking and shift summaries written next to the ledger."""
    booking = ledger.groupBy("entity", "date").agg(F.max("booking_guests").alias("booking_guests"))
    shift = ledger.where("shift is not null").groupBy("entity", "date", "shift").agg(
        F.sum("pred").alias("pred")
    )
    return booking, shift


def save_state(state: DataFrame, root: str) -> str:
    """Write a new state version, then move the pointer: readers see old or new, never half.

    The pointer is a table of versions whose highest number wins, so it needs no rename and no
    clock. The state has one writer at a time.
    """
    spark = state.sparkSession
    version = fresh_path(spark, "state").rsplit("/", 1)[1]
    state.write.parquet(f"{root}/versions/{version}")
    number = 1 + (_newest(spark, root) or (0, ""))[0]
    spark.createDataFrame([(number, version)], "number long, version string").write.mode("append").parquet(f"{root}/pointer")
    return version


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Highest number and its version; None before the first."""
    try:
        seen = spark.read.parquet(f"{root}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return tuple(seen.agg(F.max("number"), F.max_by("version", "number")).first())


def load_state(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/versions/{_newest(spark, root)[1]}")


def history_keep(history: DataFrame, today_rows: DataFrame, keep: int = 90) -> DataFrame:
    """Replace rows of today's date and keep the last ``keep`` dates."""
    old = history.join(today_rows.select("date").distinct(), "date", "left_anti")
    both = old.unionByName(today_rows)
    dates = both.select("date").distinct().orderBy(F.desc("date")).limit(keep)
    return both.join(dates, "date", "left_semi")


def run_history(records: DataFrame) -> DataFrame:
    """Newest record per run date."""
    rest = [c for c in records.columns if c not in ("run_date", "recorded_at")]
    newest = F.max(F.struct("recorded_at", *rest)).alias("r")
    return records.groupBy("run_date").agg(newest).select("run_date", "r.*")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Report rows as CSV with a header, or JSON lines."""
    w = df.write.mode("errorifexists")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))
