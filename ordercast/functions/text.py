"""Parsing of the raw text columns. Text that cannot be read becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """``yyyy/mm/dd`` (one- or two-digit month and day) to a date.

    A shape check and a cast; this is several times cheaper per line than a date formatter.
    """
    day = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    return F.when(text.rlike(r"^ *\d{4}/\d{1,2}/\d{1,2} *$"), day.try_cast("date"))


def parse_accounting_number(text: Column) -> Column:
    """``(1000)`` to -1000.0, plain numbers to themselves.

    No letter but the exponent's is allowed: the cast alone would also take type suffixes
    (``100d``) and words (``NaN``, ``Infinity``), which are not demand.
    """
    signed = F.replace(F.replace(text, F.lit("("), F.lit("-")), F.lit(")"))
    return finite(F.when(~text.rlike("[A-DF-Za-df-z]"), signed.try_cast("double")))


def finite(number: Column) -> Column:
    """The number, or null if it is NaN or infinite."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)
