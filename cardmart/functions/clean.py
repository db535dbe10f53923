"""Cleaning and key functions on columns. Bad input gives null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def upper_trim(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def lower_trim(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def blank_to(c: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(default))


def category(c: Column, allowed: Sequence[str], default: str | None = None) -> Column:
    """The upper-case value if it is allowed, else the default (null by default)."""
    value = upper_trim(c)
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def currency(c: Column) -> Column:
    """Text such as $1,234.50 or $-77.00 as money."""
    return F.regexp_replace(F.trim(c), r"[$,]", "").try_cast(MONEY)


def bounded_int(c: Column, low: int | None = None, high: int | None = None) -> Column:
    value = F.trim(c.cast("string")).try_cast("int")
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.when(ok, value)


def flag(c: Column) -> Column:
    """TRUE or FALSE in any case, else null."""
    return F.when(upper_trim(c) == "TRUE", True).when(upper_trim(c) == "FALSE", False)


def timestamp(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))


def month_year(c: Column) -> Column:
    """MM/yyyy as the first day of the month."""
    return F.expr("NULL").cast("date") if c is None else F.try_to_date(F.concat(F.lit("01/"), c), "dd/MM/yyyy")


def code_list(c: Column, allowed: Sequence[str], strict: bool = False) -> Column:
    """Comma-separated codes as an array; unknown ones become UNKNOWN, a blank text null. strict: elements are not trimmed."""
    parts = F.filter(F.split(F.upper(c), ","), lambda x: (F.trim(x) != "") | F.lit(strict))
    known = F.transform(parts, lambda x: F.when((x if strict else F.trim(x)).isin(*allowed), x if strict else F.trim(x)).otherwise("UNKNOWN"))
    return F.when(blank_to_null(c).isNotNull(), known)


def zip_code(c: Column, width: int = 0) -> Column:
    """Digits, perhaps with a zero fraction, as whole-number text; width: keep leading zeros up to it."""
    digits = F.regexp_extract(F.trim(c), r"^([0-9]+)(?:\.0+)?$", 1)
    value = F.when(digits != "", digits.try_cast("long").cast("string"))
    return F.when(value.isNotNull(), F.lpad(value, width, "0")) if width else value


def masked_pan(c: Column, shown: int = 4) -> Column:
    """All but the last characters as stars; short values are hidden whole."""
    n = F.length(c)
    return F.when(n > shown, F.concat(F.repeat(F.lit("*"), n - shown), F.right(c, F.lit(shown)))).otherwise(F.repeat(F.lit("*"), n))


def has_digits_only(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).rlike("^[0-9]+$"), F.lit(False))


def without_leading_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^[0-9]+\s+", "")


def md5_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("||", *(p.cast("string") for p in parts)))


def sha_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("||", *(p.cast("string") for p in parts)), 256)


def short_key(c: Column) -> Column:
    """A key from 1 to 32767; different values may share one."""
    return (F.pmod(F.xxhash64(c), F.lit(32767)) + 1).cast("short")


def short_md5_key(c: Column) -> Column:
    return (F.pmod(F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long"), F.lit(32767)) + 1).cast("short")


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def time_key(c: Column) -> Column:
    return F.date_format(c, "HHmmss").cast("int")


def key_date(c: Column) -> Column:
    return F.to_date(c.cast("string"), "yyyyMMdd")


def calendar_parts(day: Column) -> dict[str, Column]:
    """Parts of a date: day_of_week is 1 on Sundays, week_of_year is the ISO week."""
    return {
        "date_key": date_key(day), "day_of_week": F.dayofweek(day), "day_of_month": F.dayofmonth(day), "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day), "month": F.month(day), "quarter": F.quarter(day), "year": F.year(day), "is_weekend": F.dayofweek(day).isin(1, 7),
    }


def day_part(hour: Column) -> Column:
    return F.when(hour < 6, "NIGHT").when(hour < 12, "MORNING").when(hour < 18, "AFTERNOON").otherwise("EVENING")


def time_bucket(second: Column, minutes: int) -> Column:
    """HHmm of the bucket that a second of the day falls in."""
    start = F.floor(second / F.lit(60 * minutes)).cast("int") * minutes
    return (F.floor(start / F.lit(60)) * 100 + start % 60).cast("int")


def clock_parts(second: Column) -> dict[str, Column]:
    hour = F.floor(second / F.lit(3600)).cast("int")
    minute = (F.floor(second / F.lit(60)) % 60).cast("int")
    rest = (second % 60).cast("int")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = {
        "time_key": hour * 10000 + minute * 100 + rest, "time_24h": F.concat_ws(":", two(hour), two(minute), two(rest)), "hour_24": hour,
        "hour_12": F.when(hour % 12 == 0, 12).otherwise(hour % 12), "am_pm": F.when(hour < 12, "AM").otherwise("PM"), "minute": minute, "second": rest, "day_part": day_part(hour),
    }
    for n in (15, 30, 60):
        b = time_bucket(second, n)
        parts[f"bucket_{n}"] = b
        parts[f"bucket_{n}_text"] = F.concat_ws(":", two(F.floor(b / F.lit(100)).cast("int")), two(b % 100))
    return parts


def bracket(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, "LOW").when(c <= high, "MIDDLE").when(c.isNotNull(), "HIGH").otherwise("UNKNOWN")


def chip_segment(c: Column) -> Column:
    return F.when(c, "CHIP").when(~c, "NON_CHIP").otherwise("UNKNOWN")


def age_at(ts: Column, birth_year: Column) -> Column:
    return F.year(ts) - birth_year


def retirement_segment(age: Column, at: int = 65) -> Column:
    return F.when(age >= at, "RETIRED").when(age < at, "WORKING").otherwise("UNKNOWN")


def safe_ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"), digits)


def month_end(c: Column) -> Column:
    return F.last_day(c)


def days_in_month(c: Column) -> Column:
    return F.dayofmonth(F.last_day(c))
