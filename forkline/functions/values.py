"""Query result values as comparable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_value(value: Column) -> Column:
    """Text of a number such that 1 and 1.0 agree and whole numbers stay exact."""
    as_double = value.cast("double")
    whole = (as_double == F.floor(as_double)) & (F.abs(as_double) < 9.0e18)
    text = F.when(whole, value.cast("decimal(38,0)").cast("string")).otherwise(
        as_double.cast("string")
    )
    return F.concat(F.lit("n"), text)


def text_value(value: Column) -> Column:
    """Text stays apart from numbers: '1' is not 1."""
    return F.concat(F.lit("s"), value)


def result_values(**kinds: str) -> Column:
    """``vals`` of ``result_rows`` from named columns of kind 'number' or 'text'."""
    encode = {"number": number_value, "text": text_value}
    return F.array(*[encode[kind](F.col(name)) for name, kind in kinds.items()])
