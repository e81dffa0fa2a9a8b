"""Column selectors and expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.ranges import MANY, value_facts

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
OUTLIER_FLAG = "is_outlier"


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (*INTEGERS, *FLOATS)):
        return "numeric"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "datetime"
    return "categorical" if isinstance(t, T.StringType) else "other"


def of_kind(df: DataFrame, kind: str, exclude: tuple[str, ...] = (OUTLIER_FLAG,)) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind and f.name not in exclude]


def finite(c: Column) -> Column:
    """The value as a double, null where it is null, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def nearest_fraction(q: float, n: int) -> float:
    """The fraction for which percentile_disc gives the element nearest to place q x (n - 1), halves upwards."""
    return (math.floor(q * (n - 1) + 0.5) + 0.5) / n if n else 0.5


def disc(name: str, fraction: float) -> Column:
    return F.expr(f"percentile_disc({fraction!r}) WITHIN GROUP (ORDER BY `{name}`)")


def nearest_quantiles(df: DataFrame, columns: list[str], fractions: tuple[float, ...]) -> dict[str, list[float | None]]:
    """Exact nearest-element quantiles of several columns: one pass for the counts, one for the elements."""
    if not columns:
        return {}
    row = df.agg(*(a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")))).first()
    places = {c: [math.floor(q * (row[f"n{i}"] - 1) + 0.5) for q in fractions] if row[f"n{i}"] else [] for i, c in enumerate(columns)}
    facts = value_facts(df, columns, places, {c for i, c in enumerate(columns) if row[f"d{i}"] > MANY}, top=False)
    return {c: facts[c]["at"] or [None] * len(fractions) for c in columns}


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians, the mean of the two middle values of an even number."""
    if not columns:
        return {}
    row = df.agg(*(a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")))).first()
    places = {c: [(row[f"n{i}"] - 1) // 2, row[f"n{i}"] // 2] if row[f"n{i}"] else [] for i, c in enumerate(columns)}
    facts = value_facts(df, columns, places, {c for i, c in enumerate(columns) if row[f"d{i}"] > MANY}, top=False)
    return {c: (facts[c]["at"][0] + facts[c]["at"][1]) / 2 if facts[c]["at"] else None for c in columns}


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Different values by column; null counts as one."""
    if not columns:
        return {}
    row = df.agg(*(F.max(F.col(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(columns))).first()
    facts = value_facts(df, columns)
    return {c: facts[c]["distinct"] + (row[f"n{i}"] or 0) for i, c in enumerate(columns)}


def more_than_two(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns with more than two different values, null counting as one; two cheap aggregates, no distinct."""
    if not columns:
        return []
    ends = df.agg(*(a for i, c in enumerate(columns) for a in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.max(F.col(c).isNull().cast("int")).alias(f"z{i}")))).first()
    between = df.agg(*(F.count_if((F.col(c) != F.lit(ends[f"a{i}"])) & (F.col(c) != F.lit(ends[f"b{i}"]))).alias(f"m{i}") for i, c in enumerate(columns))).first()
    out = []
    for i, c in enumerate(columns):
        ends_differ = ends[f"a{i}"] is not None and ends[f"a{i}"] != ends[f"b{i}"]
        if between[f"m{i}"] or (ends_differ and ends[f"z{i}"]):
            out.append(c)
    return out
