"""Cleaning expressions. All are built-in expressions, so they stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column) -> Column:
    """Upper case, trimmed, without curly brackets."""
    return F.regexp_replace(F.trim(F.upper(c)), "[{}]", "")


def norm_key(c: Column) -> Column:
    """Join key: upper, trimmed, no ``.0`` tail, no leading zeros, empty -> '0'."""
    s = F.regexp_replace(F.trim(F.upper(c)), r"\.0$", "")
    s = F.regexp_replace(s, "^0+", "")
    return F.when(s == "", F.lit("0")).otherwise(s)


def num_coerce(c: Column, default: float = 0.0) -> Column:
    """Text or number to double; anything unreadable becomes ``default``."""
    v = c.cast("string").try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(v)


def shift_of(hour: Column) -> Column:
    """MORNING 8-15, EVENING 16-23, OTHER for the rest."""
    return (
        F.when(hour.between(8, 15), "MORNING")
        .when(hour.between(16, 23), "EVENING")
        .otherwise("OTHER")
    )


def shift_legacy(hour: Column) -> Column:
    """Older shift limits, kept for the KPI fallback on hourly rows."""
    return (
        F.when(hour.between(9, 14), "MORNING")
        .when(hour.between(15, 22), "EVENING")
        .otherwise("OTHER")
    )


def parse_hour(c: Column, default: int | None = None) -> Column:
    """Hour 0-23 from a timestamp text, ``HH:MM[:SS]`` or a number; else ``default``."""
    s = F.trim(c.cast("string"))
    clock = F.regexp_extract(s, r"^(?:\d{4}-\d{2}-\d{2}[ T])?(\d{1,2}):\d", 1)
    h = F.coalesce(
        F.when(clock != "", clock).try_cast("int"),
        F.floor(s.try_cast("double")).cast("int"),
    )
    ok = F.when(h.between(0, 23), h)
    return ok if default is None else F.coalesce(ok, F.lit(default))


def parse_date_multi(c: Column) -> Column:
    """First of four layouts that reads the leading 19 characters."""
    s = F.substring(F.trim(c.cast("string")), 1, 19)
    fmts = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in fmts]).cast("date")


def not_cancelled(c: Column) -> Column:
    """A booking counts when its cancel reason is empty, null or 'nan'."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return t.isin("", "nan")


def ext_code(budget: Column) -> Column:
    """Short store code in a budget code: behind the four-letter prefix, else last four."""
    b = F.trim(budget)
    return F.when(b.rlike(r"^..[\p{L}]{2}."), F.substr(b, F.lit(5))).otherwise(
        F.substring(b, -4, 4)
    )


def closure_status(c: Column) -> Column:
    """Free Vietnamese schedule text to CLOSED / HALF_DAY / OPEN."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    half = F.lit(False)
    for word in HALF_DAY_WORDS:
        half = half | v.contains(word)
    return F.when(v.isin(*CLOSED_WORDS), "CLOSED").when(half, "HALF_DAY").otherwise("OPEN")


# Words of the closure schedule.
CLOSED_WORDS = ["đóng", "convert"]
HALF_DAY_WORDS = ["nửa ngày", "bán sáng", "bán chiều", "đóng 0.5", "mở0.5", "trực"]

# Vietnamese letters and their plain forms.
_MARKED = {
    "a": "àáạảãâầấậẩẫăằắặẳẵ",
    "e": "èéẹẻẽêềếệểễ",
    "i": "ìíịỉĩ",
    "o": "òóọỏõôồốộổỗơờớợởỡ",
    "u": "ùúụủũưừứựửữ",
    "y": "ỳýỵỷỹ",
    "d": "đ",
}


def name_norm(c: Column) -> Column:
    """Comparable store name: no diacritics or hyphens, camel case split, lower."""
    lower = "".join(_MARKED.values())
    plain = "".join(k * len(v) for k, v in _MARKED.items())
    s = F.translate(c, lower + lower.upper() + "-", plain + plain.upper() + " ")
    s = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def time_parts(df, ts: str = "open_time"):
    """Adds date, hour and English weekday name."""
    t = F.col(ts)
    return df.withColumns(
        {"date": F.to_date(t), "hour": F.hour(t), "weekday": F.date_format(t, "EEEE")}
    )
