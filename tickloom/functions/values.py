"""Validity of numbers, filling, sides of trades, and hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(value: Column) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def as_number(value: Column) -> Column:
    """A double if the value is a finite number (text included), else null."""
    number = value.try_cast("double")
    return F.when(is_finite(number), number)


def invalid_flag(value: Column) -> Column:
    """1 where the value is null, not a number, or not finite; else 0."""
    return as_number(value).isNull().cast("int")


def replacement(special: float | int | str) -> float:
    """The number that stands for invalid values: finite numbers as they are, text that is no number as 0."""
    if isinstance(special, bool):
        raise TypeError("a truth value is no replacement")
    if isinstance(special, str):
        try:
            special = float(special)
        except ValueError:
            return 0.0
        return special if math.isfinite(special) else 0.0
    if not math.isfinite(special):
        raise ValueError("the replacement must be finite")
    return float(special)


def fill_invalid(value: Column, special: float | int | str) -> Column:
    return F.coalesce(as_number(value), F.lit(replacement(special)))


def is_buy(side: Column) -> Column:
    return F.upper(side) == "BUY"


def is_sell(side: Column) -> Column:
    return F.upper(side) == "SELL"


def normal_side(side: Column) -> Column:
    """buy or sell by the first letter, empty means buy, anything else in lower case."""
    text = F.lower(F.trim(F.coalesce(side, F.lit(""))))
    first = F.substring(text, 1, 1)
    return F.when((text == "") | (first == "b"), "buy").when(first == "s", "sell").otherwise(text)


def joined_hash(*parts: Column) -> Column:
    """SHA-256 in hex of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts), 256)
