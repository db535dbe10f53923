"""Raw card, user and transaction tables (all text) as typed, cleaned columns; and change feeds.

Bad values become null, never an error; columns that are not named here fall away.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators.dedup import latest_per_key
from ..operators.marts import nearest_place

# fixed values: what the raw tables may hold
CHANNELS = ("SWIPE TRANSACTION", "CHIP TRANSACTION", "ONLINE TRANSACTION")
BRANDS = ("VISA", "MASTERCARD", "AMEX", "DISCOVER")
GENDERS = ("MALE", "FEMALE")


def _text(c: Column) -> Column:
    return c.cast("string")


def _whole(low: int, high: int) -> Callable[[Column], Column]:
    return lambda c: clean.bounded_int(c, low, high)


def _projected(df: DataFrame, columns: dict[str, tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    return df.select(*(f(F.col(source)).alias(name) for name, (source, f) in columns.items()))


def transactions(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    """codes: the error codes that are known."""
    out = _projected(df, {
        "transaction_id": ("id", _text), "timestamp": ("date", clean.timestamp), "client_id": ("client_id", _text), "card_id": ("card_id", _text), "amount": ("amount", clean.currency),
        "transaction_channel": ("use_chip", lambda c: clean.category(c, CHANNELS)), "merchant_id": ("merchant_id", _text), "merchant_city": ("merchant_city", clean.lower_trim),
        "merchant_state": ("merchant_state", clean.upper_trim), "zip": ("zip", clean.zip_code), "mcc": ("mcc", _text), "errors": ("errors", lambda c: clean.code_list(c, codes)),
    })
    ts = F.col("timestamp")
    return out.withColumns({"is_error": F.col("errors").isNotNull(), "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})


def cards(df: DataFrame) -> DataFrame:
    return _projected(df, {
        "card_id": ("id", _text), "client_id": ("client_id", _text), "card_brand": ("card_brand", lambda c: clean.category(c, BRANDS)), "card_type": ("card_type", _text),
        "mask_card_number": ("card_number", clean.masked_pan), "expires": ("expires", clean.month_year), "has_a_cvv": ("cvv", clean.has_digits_only), "has_chip": ("has_chip", _yes),
        "num_cards_issued": ("num_cards_issued", clean.bounded_int), "credit_limit": ("credit_limit", clean.currency), "acct_open_date": ("acct_open_date", clean.month_year),
        "year_pin_last_changed": ("year_pin_last_changed", _whole(1990, 2026)), "card_on_dark_web": ("card_on_dark_web", _yes),
    })


def _yes(c: Column) -> Column:
    """Flags are written as yes and no, or as true and false."""
    word = clean.upper_trim(c)
    return F.when(word.isin("YES", "TRUE"), True).when(word.isin("NO", "FALSE"), False)


def users(df: DataFrame, places: DataFrame) -> DataFrame:
    """places: place (struct of city and state), plat, plon; each user gets the nearest one."""
    at = df.select(F.col("id").cast("string").alias("id"), F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"))
    near = nearest_place(at, places).select(F.col("id").alias("user_id"), F.col("place.city").alias("city"), F.col("place.state").alias("state"))
    out = _projected(df, {
        "user_id": ("id", _text), "retirement_age": ("retirement_age", _whole(50, 100)), "birth_year": ("birth_year", _whole(1900, 2026)), "birth_month": ("birth_month", _whole(1, 12)),
        "gender": ("gender", lambda c: clean.category(c, GENDERS)), "per_capita_income": ("per_capita_income", clean.currency), "yearly_income": ("yearly_income", clean.currency),
        "total_debt": ("total_debt", clean.currency), "credit_score": ("credit_score", _whole(300, 850)), "num_credit_cards": ("num_credit_cards", _whole(0, 100)),
    })
    return out.join(near, "user_id", "left")


def latest_changes(feed: DataFrame, keys: Sequence[str], order: Sequence[str], operation: str = "op") -> tuple[DataFrame, DataFrame]:
    """A change feed as the latest state of each key, and the keys whose last operation (I, U or D) deletes them."""
    last = latest_per_key(feed, keys, order)
    return last.where(F.col(operation) != "D").drop(operation), last.where(F.col(operation) == "D").select(*keys)
