"""Equality across types, as SQL clients expect it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = ["tinyint", "smallint", "int", "bigint"]


def eq_coerced(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> Column:
    """``left.column = right.column`` where a boolean meets a number as 0 or 1, and numbers widen."""
    a, b = left[left_column], right[right_column]
    kind_a, kind_b = dict(left.dtypes)[left_column], dict(right.dtypes)[right_column]
    if kind_a == "boolean" and kind_b != "boolean":
        a = a.cast("tinyint").cast(kind_b if kind_b in _WHOLE else "double")
    elif kind_b == "boolean" and kind_a != "boolean":
        b = b.cast("tinyint").cast(kind_a if kind_a in _WHOLE else "double")
    elif kind_a in _WHOLE and kind_b in _WHOLE and kind_a != kind_b:
        wide = max(kind_a, kind_b, key=_WHOLE.index)
        a, b = a.cast(wide), b.cast(wide)
    elif {kind_a, kind_b} & {"float", "double"}:
        a, b = a.cast("double"), b.cast("double")
    return a == b


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)
