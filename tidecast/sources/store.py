"""Fact tables stored in buckets of their transaction id.

A store is a table of Parquet files in the shared folder, cut into buckets by one key and sorted by
it in each file. Deliveries are appended, a file for each bucket they touch. What groups or joins by
the key afterwards reads bucket by bucket: deduplication and the join of item lines with their
transactions need no shuffle, however often they run. The number of buckets is chosen once, for the
size the table is to have; tables that are joined take the same number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.session import fresh_path

BUCKETS = 64


def _id(path: str) -> str:
    """Table name of a folder, the same in every session."""
    return f"store_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"


def open_store(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS) -> str:
    """Name of the table on that folder, declared in the session's catalog where it is not yet."""
    name = _id(path)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({cols}) USING parquet OPTIONS (path '{path}') CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS"
        )
    return name


def append(df: DataFrame, name: str, key: str, buckets: int = BUCKETS) -> None:
    """Adds a delivery: one shuffle by the key, one file per bucket."""
    spark = df.sparkSession
    df.select(*spark.table(name).columns).repartition(buckets, key).write.insertInto(name)


def stored(df: DataFrame, stem: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The rows as a new store."""
    name = open_store(df.sparkSession, fresh_path(df.sparkSession, stem), df.schema, key, buckets)
    append(df, name, key, buckets)
    return df.sparkSession.table(name)


def first_of_key(table: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """First row of each key by ``order`` (ties by the whole row); null is a key of its own.

    A window that looks one row back: rows of a key stand together after one sort within the
    bucket, and only one of them is held at a time.
    """
    rest = F.struct(*[c for c in table.columns if c != key])
    before = F.lag(F.lit(1)).over(W.partitionBy(key).orderBy(*order, F.desc(rest)))
    return table.withColumn("__before", before).where("__before is null").drop("__before")


def dedup_highest(table: DataFrame) -> DataFrame:
    """One row per transaction id: highest measure, then first source."""
    return first_of_key(table, "transaction_id", [F.desc("guests"), F.asc("source")])


def dedup_priority(table: DataFrame) -> DataFrame:
    """One row per transaction id: first source wins."""
    return first_of_key(table, "transaction_id", [F.asc("source"), F.desc("guests")])
