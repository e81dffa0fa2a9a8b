"""Narrowing of physical types. Spark has no unsigned types: the logical name is kept in the column's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.audit import StepReport
from quern.config import CleanConfig
from quern.functions.columns import INTEGERS, OUTLIER_FLAG
from quern.functions.ranges import value_facts

#: (logical name, lowest, highest, Spark type), narrowest first.
UNSIGNED = [("UInt8", 0, 2**8 - 1, "smallint"), ("UInt16", 0, 2**16 - 1, "int"), ("UInt32", 0, 2**32 - 1, "bigint"), ("UInt64", 0, 2**64 - 1, "bigint")]
SIGNED = [("Int8", -(2**7), 2**7 - 1, "tinyint"), ("Int16", -(2**15), 2**15 - 1, "smallint"), ("Int32", -(2**31), 2**31 - 1, "int"), ("Int64", -(2**63), 2**63 - 1, "bigint")]
CATEGORY_LEVELS, CATEGORY_SHARE = 1024, 0.5
FLOAT32_MAX = 3.4028235e38


def narrowest_integer(low: int, high: int) -> tuple[str, str]:
    """(logical name, Spark type)."""
    ladder = UNSIGNED if low >= 0 else SIGNED
    return next((name, spark) for name, a, b, spark in ladder if a <= low and high <= b)


def float32_error(c: Column) -> Column:
    """Greatest relative error of the 32-bit form over finite values (absolute at 0); infinite where it overflows."""
    d = c.cast("double")
    whole = ~F.isnan(d) & (F.abs(d) != float("inf"))
    error = F.when(F.abs(d) > FLOAT32_MAX, F.lit(float("inf"))).otherwise(F.abs(d.cast("float").cast("double") - d) / F.when(d != 0, F.abs(d)).otherwise(1.0))
    return F.max(F.when(whole, error))


def plan(df: DataFrame, config: CleanConfig | None = None) -> dict[str, tuple[str, str]]:
    """(logical name, Spark type) of every column that can be narrower; one aggregate over the table."""
    config = config or CleanConfig()
    aggs, fields = [F.count("*").alias("n")], [f for f in df.schema.fields if f.name not in (OUTLIER_FLAG, "_row_id")]
    for i, f in enumerate(fields):
        if isinstance(f.dataType, INTEGERS):
            aggs += [F.min(f.name).alias(f"a{i}"), F.max(f.name).alias(f"b{i}")]
        elif isinstance(f.dataType, T.DoubleType) and config.downcast_floats:
            aggs += [float32_error(F.col(f.name)).alias(f"e{i}"), F.count(f.name).alias(f"c{i}")]
        elif isinstance(f.dataType, T.StringType):
            aggs.append(F.approx_count_distinct(f.name).alias(f"d{i}"))
            aggs.append(F.max(F.col(f.name).isNull().cast("int")).alias(f"z{i}"))
    row, out = df.agg(*aggs).first().asDict(), {}
    # exact counts only where the levels can be few enough
    few = [f.name for i, f in enumerate(fields) if f"d{i}" in row and row[f"d{i}"] <= 2 * CATEGORY_LEVELS]
    exact = value_facts(df, few) if few else {}
    for i, f in enumerate(fields):
        if row.get(f"a{i}") is not None:
            name, spark = narrowest_integer(row[f"a{i}"], row[f"b{i}"])
            if name not in ("Int64", "UInt64"):
                out[f.name] = (name, spark)
        elif row.get(f"c{i}") and (row[f"e{i}"] or 0.0) <= config.float32_rel_tolerance:
            out[f.name] = ("Float32", "float")
        elif f"d{i}" in row and row["n"]:
            levels = exact[f.name]["distinct"] + (row[f"z{i}"] or 0) if f.name in exact else CATEGORY_LEVELS + 1
            if 0 < levels <= CATEGORY_LEVELS and levels / row["n"] <= CATEGORY_SHARE:
                out[f.name] = ("Categorical", "string")
    return out


WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4, "timestamp_ntz": 8, "timestamp": 8}


def memory_bytes(df: DataFrame, rows: int | None = None) -> int:
    """Bytes of a columnar form: logical widths by rows, strings by their length, categories by their codes."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (f.metadata or {}).get("logical") != "Categorical"]
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(c)).alias(f"s{i}") for i, c in enumerate(strings))).first()
    logical = {"UInt8": 1, "UInt16": 2, "UInt32": 4, "Categorical": 4}
    fixed = sum(logical.get((f.metadata or {}).get("logical"), WIDTH.get(f.dataType.simpleString(), 8)) for f in df.schema.fields if f.name not in strings)
    return row["n"] * (fixed + 4 * len(strings)) + sum(row[f"s{i}"] or 0 for i in range(len(strings)))


def downcast(df: DataFrame, config: CleanConfig | None = None) -> tuple[DataFrame, StepReport]:
    config, report = config or CleanConfig(), StepReport("downcast")
    before = memory_bytes(df)
    if config.downcast:
        narrow = plan(df, config)
        df = df.select(*(F.col(c).cast(narrow[c][1]).alias(c, metadata={"logical": narrow[c][0]}) if c in narrow else F.col(c) for c in df.columns))
        for c, (name, _) in narrow.items():
            report.act(f"{c}: {name}")
    report.measure("memory_before", before)
    report.measure("memory_after", memory_bytes(df))
    return df, report
