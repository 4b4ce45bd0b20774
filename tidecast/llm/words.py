"""Words, word windows and reading shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space between words besides the blank itself: \\x09-\\x0D.
BREAKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of all ``[^\\x20\\x09-\\x0D]+`` of the text."""
    return F.array_remove(F.split(F.translate(text, BREAKS, " " * len(BREAKS)), " "), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def window_hashes(words_col: str, width: int = 5) -> Column:
    """64-bit hash of every window of ``width`` words, in order; empty with fewer words.

    ``words_col`` names a column, so that the array is made once per row.
    """
    w = F.col(words_col)
    n = F.size(w)
    one = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)])
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), one)).otherwise(
        F.array().cast("array<bigint>")
    )


#: DuckDB: one row with ``t``, the 256 values of the reflected crc32 polynomial.
CRC_TABLE = """
crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c
  FROM range(256) r(i)))"""


def crc32_sql(text: str, table: str) -> str:
    """DuckDB: unsigned crc32 of an ASCII text, ``table`` being ``t`` of ``CRC_TABLE``."""
    chars = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    step = f"lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), {step}), 4294967295::BIGINT)"
