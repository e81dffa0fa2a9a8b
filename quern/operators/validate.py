"""Source, frame, schema and contract checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ValidationError(ValueError):
    pass


@dataclass
class ValidationReport:
    issues: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.issues


#: Contract names of types and the Spark types they accept.
DTYPES = {
    "Int8": ("tinyint",), "Int16": ("smallint",), "Int32": ("int",), "Int64": ("bigint",),
    "UInt8": ("smallint",), "UInt16": ("int",), "UInt32": ("bigint",), "UInt64": ("bigint", "decimal(20,0)"),
    "Float32": ("float",), "Float64": ("double",), "Utf8": ("string",), "String": ("string",), "Categorical": ("string",),
    "Boolean": ("boolean",), "Date": ("date",), "Datetime": ("timestamp_ntz", "timestamp"),
}


def validate_source(path: str) -> None:
    """Raises for a missing or empty local file; folders and paths of other stores are left to Spark's readers."""
    if path == ":memory:" or "://" in path or any(c in path for c in "*?["):
        return
    if not os.path.exists(path):
        raise ValidationError(f"no such source: {path}")
    if os.path.isfile(path) and os.path.getsize(path) == 0:
        raise ValidationError(f"empty source: {path}")


def validate_frame(df: DataFrame) -> ValidationReport:
    report = ValidationReport()
    if not df.columns:
        raise ValidationError("no columns")
    twice = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if twice:
        report.issues.append(f"duplicate column names: {', '.join(twice)}")
        return report
    row = df.agg(F.count("*").alias("n"), *(F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    if row["n"] == 0:
        raise ValidationError("no rows")
    report.issues += [f"{c} is entirely null" for i, c in enumerate(df.columns) if row[f"c{i}"] == 0]
    if row["n"] == 1:
        report.issues.append("a single row")
    return report


def enforce_schema(df: DataFrame, expected: dict[str, str] | T.StructType) -> None:
    want = {f.name: f.dataType.simpleString() for f in expected.fields} if isinstance(expected, T.StructType) else expected
    have = dict(df.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')} instead of {t}" for c, t in want.items() if have.get(c) not in (t, *DTYPES.get(t, ()))]
    if wrong:
        raise ValidationError("; ".join(wrong))


def load_contract(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def enforce_contract(df: DataFrame, contract: dict) -> ValidationReport:
    """All constraints in one aggregate; values outside an allowed list are looked up only where there are any."""
    report, rules = ValidationReport(), contract.get("columns", contract) or {}
    missing = [c for c, r in rules.items() if c not in df.columns and (r or {}).get("required", False)]
    if missing:
        raise ValidationError(f"required columns are missing: {', '.join(missing)}")
    present = {c: r or {} for c, r in rules.items() if c in df.columns}
    aggs = [F.count("*").alias("n")]
    for i, (c, r) in enumerate(present.items()):
        aggs.append(F.count(F.col(c)).alias(f"c{i}"))
        aggs += [f(F.col(c)).alias(f"{k}{i}") for k, f in (("min", F.min), ("max", F.max)) if k in r]
        if "allowed" in r:
            odd = F.col(c).isNotNull() & ~F.col(c).cast("string").isin([str(v) for v in r["allowed"]])
            aggs.append(F.count_if(odd).alias(f"odd{i}"))
    row = df.agg(*aggs).first()
    for i, (c, r) in enumerate(present.items()):
        have = dict(df.dtypes)[c]
        logical = (df.schema[c].metadata or {}).get("logical")
        if "dtype" in r and r["dtype"] not in (have, logical) and have not in DTYPES.get(r["dtype"], ()):
            report.issues.append(f"{c}: type {have} instead of {r['dtype']}")
        if "max_null_pct" in r and row["n"] and 100 * (1 - row[f"c{i}"] / row["n"]) > r["max_null_pct"]:
            report.issues.append(f"{c}: {100 * (1 - row[f'c{i}'] / row['n']):.2f} % null, {r['max_null_pct']} % allowed")
        if "min" in r and row[f"min{i}"] is not None and row[f"min{i}"] < r["min"]:
            report.issues.append(f"{c}: min {row[f'min{i}']} below {r['min']}")
        if "max" in r and row[f"max{i}"] is not None and row[f"max{i}"] > r["max"]:
            report.issues.append(f"{c}: max {row[f'max{i}']} above {r['max']}")
        if "allowed" in r and row[f"odd{i}"]:
            seen = df.select(F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull() & ~F.col("v").isin([str(v) for v in r["allowed"]])).distinct().orderBy("v").limit(5).collect()
            report.issues.append(f"{c}: unexpected values {', '.join(x['v'] for x in seen)}")
    return report
