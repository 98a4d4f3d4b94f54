"""Display texts, as Column functions and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tiffin.functions import rules

DEFAULT_RATING = 5


def format_ts(at: Column) -> Column:
    """``2024-12-01 14:30:00`` in the session time zone."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def format_vnd(amount: Column) -> Column:
    """``68.000 ₫``: dots between thousands, a no-break space before the sign."""
    return F.concat(F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")), F.lit("\u00a0₫"))


def display_rating(rating: Column) -> Column:
    """A missing or zero rating shows as 5."""
    return F.coalesce(F.nullif(rating, F.lit(0)), F.lit(DEFAULT_RATING))


def register(spark: SparkSession) -> None:
    """Offer the row rules and texts to SQL as temporary functions (no Python at run time)."""
    octets = rules.PHONE_OCTETS
    bodies = {
        "is_email(s STRING) RETURNS BOOLEAN": f"s RLIKE r'{rules.EMAIL}'",
        "is_phone(s STRING) RETURNS BOOLEAN": f"octet_length(s) = {octets} AND s RLIKE r'{rules.PHONE}'",
        "is_password(s STRING) RETURNS BOOLEAN": f"octet_length(s) >= {rules.PASSWORD_OCTETS}",
        "is_restaurant_name(s STRING) RETURNS BOOLEAN": f"s RLIKE r'{rules.RESTAURANT_NAME}'",
        "is_item_name(s STRING) RETURNS BOOLEAN": f"s RLIKE r'{rules.ITEM_NAME}'",
        "format_ts(t TIMESTAMP) RETURNS STRING": "date_format(t, 'yyyy-MM-dd HH:mm:ss')",
        "format_vnd(n BIGINT) RETURNS STRING":
            "concat(replace(format_number(n, 0), ',', '.'), '\u00a0₫')",
        "display_rating(n INT) RETURNS INT": f"coalesce(nullif(n, 0), {DEFAULT_RATING})",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
