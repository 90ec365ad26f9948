"""Partitioned reads: one Spark partition per predicate, in one scan, and no row lost.

The type of the partition column chooses the predicates: whole numbers, fractions, or dates and times
between two bounds; any other type, or a column without bounds, goes by hash. Bounds that don't read as
the column's type are an error. Ranges are open at both ends and null keys have a place of their own,
so the predicates together cover every row once. Explicit predicates are taken as they are: a row that
several of them hold for is read as often, a row that none holds for isn't read.

The table is scanned once. Each row is given the numbers of its predicates and dealt by them, so there
is one shuffle instead of one scan for each predicate, and filters above still reach the scan.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 6

# The accepted date and time forms, tried in this order.
FORMATS = [
    "%Y-%m-%d %H:%M:%S",
    "%Y/%m/%d %H:%M:%S",
    "%m/%d/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S.%f%z",
    "%Y.%m.%d %H:%M:%S",
    "%Y%m%d %H:%M:%S",
    "%Y-%m-%d",
    "%Y/%m/%d",
    "%m/%d/%Y",
    "%d/%m/%Y",
    "%Y%m%d",
]


def parse_date(text: str) -> dt.datetime:
    for form in FORMATS:
        try:
            found = dt.datetime.strptime(text.strip(), form)
        except ValueError:
            continue
        return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found
    raise ValueError(f"not a date: {text!r}")


def hash_predicates(column: str, size: int = SIZE) -> list[Column]:
    """Remainders of a hash; a null key hashes like any value, so it is in one of them."""
    return [F.pmod(F.hash(F.col(column)), F.lit(size)) == i for i in range(size)]


def _between(column: str, bounds: list[Column]) -> list[Column]:
    c = F.col(column)
    if not bounds:
        return [F.lit(True)]
    parts = [(c < bounds[0]) | c.isNull()]
    parts += [(c >= a) & (c < b) for a, b in zip(bounds, bounds[1:], strict=False)]
    return [*parts, c >= bounds[-1]]


def long_predicates(column: str, lower: int, upper: int, size: int = SIZE) -> list[Column]:
    """Steps of equal width from lower to upper; the outer ones take what lies beyond."""
    if lower > upper:
        raise ValueError("the lower bound is above the upper")
    size = min(size, max(1, upper - lower))
    return _between(column, [F.lit(lower + (upper - lower) * k // size) for k in range(1, size)])


def double_predicates(column: str, lower: float, upper: float, size: int = SIZE) -> list[Column]:
    if lower > upper:
        raise ValueError("the lower bound is above the upper")
    return _between(column, [F.lit(lower + (upper - lower) * k / size) for k in range(1, size if upper > lower else 1)])


def date_predicates(column: str, lower: str, upper: str, size: int = SIZE, kind: str = "timestamp_ntz") -> list[Column]:
    a, b = parse_date(lower), parse_date(upper)
    if a > b:
        raise ValueError("the lower bound is above the upper")
    steps = [a + (b - a) * k / size for k in range(1, size if b > a else 1)]
    return _between(column, [F.lit(s.isoformat(sep=" ")).cast(kind) for s in steps])


def split_predicates(text: str) -> list[str]:
    """Predicates out of one text, at ; or | or top-level commas."""
    out, depth, quoted, part = [], 0, False, ""
    for c in text:
        if c == "'":
            quoted = not quoted
        if not quoted:
            depth += (c == "(") - (c == ")")
            if (c in ";|") or (c == "," and depth == 0):
                out.append(part)
                part = ""
                continue
        part += c
    return [p.strip() for p in [*out, part] if p.strip()]


def read_by(df: DataFrame, predicates: list[Column | str]) -> DataFrame:
    """The rows of each predicate in a partition of its own."""
    conditions = [F.expr(p) if isinstance(p, str) else p for p in predicates]
    if len(conditions) == 1:
        return df.where(conditions[0]).coalesce(1)
    either = conditions[0]
    for c in conditions[1:]:
        either = either | c
    mark = "__part"
    while mark in df.columns:
        mark += "_"
    numbers = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(conditions)]))
    numbered = df.where(either).withColumn(mark, F.explode(numbers))
    return numbered.repartitionById(len(conditions), F.col(mark)).drop(mark)


def _numbered(df: DataFrame, number: Column, size: int) -> DataFrame:
    return df.repartitionById(size, number) if size > 1 else df.coalesce(1)


_WHOLE, _FRACTIONS, _TIMES = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}, {"date", "timestamp", "timestamp_ntz"}


def column_predicates(df: DataFrame, column: str, lower: str | None, upper: str | None, size: int = SIZE) -> list[Column]:
    """Predicates over a column by its type."""
    named = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    if column.lower() not in named:
        raise ValueError(f"no column {column!r} to partition by")
    kind = named[column.lower()]
    if lower is None or upper is None:
        return hash_predicates(column, size)
    plain = [b.replace(",", "").strip() for b in (lower, upper)]
    if kind in _WHOLE and all(re.fullmatch(r"[+-]?\d+", b) for b in plain):
        return long_predicates(column, int(plain[0]), int(plain[1]), size)
    if kind in _WHOLE | _FRACTIONS or kind.startswith("decimal"):
        return double_predicates(column, float(plain[0]), float(plain[1]), size)
    if kind in _TIMES:
        return date_predicates(column, lower, upper, size, kind)
    return hash_predicates(column, size)


def partition_predicates(df: DataFrame, options: dict[str, str]) -> list[Column | str] | None:
    """Predicates from reader options: partition.predicates, partition.predicate*, or a column with bounds."""
    listed = [v for k, v in sorted(options.items()) if re.fullmatch(r"partition\.predicate\d*", k)]
    if options.get("partition.predicates"):
        listed += split_predicates(options["partition.predicates"])
    if listed:
        return listed
    column = options.get("partition.byColumn")
    if not column:
        return None
    size = int(options.get("partition.size", SIZE))
    if size < 1:
        raise ValueError("a read has one partition or more")
    return column_predicates(df, column, options.get("partition.lowerBound"), options.get("partition.upperBound"), size)


def read_partitioned(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """``df`` dealt as the options say, or as it is if they say nothing."""
    predicates = partition_predicates(df, options)
    if predicates is None:
        return df
    if isinstance(predicates[0], str):
        return read_by(df, predicates)
    # predicates of a column hold for one part each, so the first that does is the row's
    number = F.coalesce(*[F.when(p, F.lit(k)) for k, p in enumerate(predicates)], F.lit(0))
    return _numbered(df, number, len(predicates))
