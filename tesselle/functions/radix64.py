"""Whole numbers as text of base 64, most significant digit first; zero is the empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits 0 to 63.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz/."


def encode(n: Column) -> Column:
    """Text of a long; a minus sign precedes the digits of a negative one."""
    size = F.abs(n)
    places = F.sequence(F.lit(60), F.lit(0), F.lit(-6))
    digits = F.transform(places, lambda p: F.substr(F.lit(DIGITS), F.call_function("shiftright", size, p).bitwiseAND(F.lit(63)).cast("int") + 1, F.lit(1)))
    text = F.ltrim(F.array_join(digits, ""), F.lit("0"))
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def decode(text: Column) -> Column:
    """Number of a text; null where it holds anything but digits behind an optional minus sign."""
    digits = F.regexp_replace(text, "^-", "")
    value = F.aggregate(
        F.split(digits, ""),
        F.lit(0).cast("long"),
        lambda acc, c: F.when(c == "", acc).otherwise(acc * 64 + F.instr(F.lit(DIGITS), c) - 1),
    )
    return F.when(text.rlike("^-?[0-9A-Za-z/.]*\\z"), F.when(F.startswith(text, F.lit("-")), -value).otherwise(value))
