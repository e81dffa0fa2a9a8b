"""Outliers: bounds from two small aggregates, then one expression over each row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.audit import StepReport
from quern.config import CleanConfig
from quern.functions.columns import OUTLIER_FLAG, medians, more_than_two, nearest_quantiles, of_kind

#: Rows an isolation tree is grown on, and the number of trees.
FOREST_SAMPLE, FOREST_TREES = 256, 100


def candidates(df: DataFrame) -> list[str]:
    return more_than_two(df, of_kind(df, "numeric", (OUTLIER_FLAG, "_row_id")))


def iqr_bounds(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> dict[str, tuple[float, float]]:
    out = {}
    for c, (q1, q3) in nearest_quantiles(df, columns, (0.25, 0.75)).items():
        if q1 is not None:
            out[c] = (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
    return out


def zscore_bounds(df: DataFrame, columns: list[str], threshold: float = 3.0) -> dict[str, tuple[float, float]]:
    if not columns:
        return {}
    row = df.agg(*(a for i, c in enumerate(columns) for a in (F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}")))).first()
    return {c: (row[f"m{i}"] - threshold * row[f"s{i}"], row[f"m{i}"] + threshold * row[f"s{i}"]) for i, c in enumerate(columns) if row[f"s{i}"]}


def outside(c: str, low: float, high: float) -> Column:
    """Whether a value breaches its bounds; null and NaN do not."""
    d = F.col(c).cast("double")
    return F.coalesce(~F.isnan(d) & ((d < low) | (d > high)), F.lit(False))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int):
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth >= limit or len(x) <= 1 or not len(spread):
        return len(x)
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth + 1, limit), _grow(x[~left], rng, depth + 1, limit)


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _depths(tree, x: np.ndarray) -> np.ndarray:
    out, todo = np.zeros(len(x)), [(tree, np.arange(len(x)), 0)]
    while todo:
        node, at, depth = todo.pop()
        if isinstance(node, int):
            out[at] = depth + _mean_path(node)
        else:
            left = x[at, node[0]] < node[1]
            todo += [(node[2], at[left], depth + 1), (node[3], at[~left], depth + 1)]
    return out


def isolation_scores(df: DataFrame, columns: list[str], seed: int = 7, name: str = "_isolation") -> DataFrame:
    """Adds the isolation forest's anomaly score. Trees grow on bounded samples, rows are scored where they are."""
    middle = medians(df, columns)
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(float(middle[c] or 0))).alias(c) for c in columns]
    # by a hash of the values, so that it depends on neither partitions nor order
    sample = df.select(*filled).orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(FOREST_SAMPLE * 16).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    n = min(FOREST_SAMPLE, len(sample))
    trees = [_grow(sample[rng.choice(len(sample), n, replace=False)], rng, 0, math.ceil(math.log2(max(n, 2)))) for _ in range(FOREST_TREES)]
    sent, norm = df.sparkSession.sparkContext.broadcast(trees), _mean_path(n)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in xs])
        return pd.Series(2 ** (-sum(_depths(t, x) for t in sent.value) / len(sent.value) / norm))

    return df.withColumn(name, score(*filled))


def handle_outliers(df: DataFrame, config: CleanConfig | None = None) -> tuple[DataFrame, StepReport]:
    config, report = config or CleanConfig(), StepReport("outliers")
    columns = candidates(df)
    if not columns or not config.outlier_methods:
        return df, report
    bounds: dict[str, list[tuple[float, float]]] = {c: [] for c in columns}
    if "iqr" in config.outlier_methods:
        for c, b in iqr_bounds(df, columns, config.iqr_multiplier).items():
            bounds[c].append(b)
    if "zscore" in config.outlier_methods:
        for c, b in zscore_bounds(df, columns, config.zscore_threshold).items():
            bounds[c].append(b)
    flag = F.lit(False)
    for c, pairs in bounds.items():
        for low, high in pairs:
            flag = flag | outside(c, low, high)
    forest = "isolation_forest" in config.outlier_methods and len(columns) >= 2
    if forest:
        df = isolation_scores(df, columns, config.random_seed)
        odd = F.col("_isolation") > 0.5
        if config.iforest_contamination != "auto":
            cut = df.agg(F.percentile("_isolation", 1 - float(config.iforest_contamination)).alias("c")).first()["c"]
            odd = F.col("_isolation") > cut
        every = flag | odd
    else:
        odd, every = F.lit(False), flag
    counts = df.agg(F.count_if(every).alias("rows"), *(F.count_if(_any_of(c, p)).alias(f"c{i}") for i, (c, p) in enumerate(bounds.items()))).first()
    report.measure("outlier_rows", counts["rows"])
    for i, c in enumerate(bounds):
        if counts[f"c{i}"]:
            report.act(f"{c}: {counts[f'c{i}']} values out of bounds")
    if config.outlier_action == "flag":
        df = df.withColumn(OUTLIER_FLAG, every)
    elif config.outlier_action == "drop":
        df = df.where(~every)
        report.measure("rows_dropped", counts["rows"])
    elif config.outlier_action == "cap":
        caps = {}
        for c, pairs in bounds.items():
            if pairs:
                low, high = max(p[0] for p in pairs), min(p[1] for p in pairs)
                d = F.col(c).cast("double")
                caps[c] = F.when(F.isnan(d), d).otherwise(F.greatest(F.lit(low), F.least(d, F.lit(high))))
                caps[c] = F.when(d.isNotNull(), caps[c])
        if forest:
            caps[OUTLIER_FLAG] = odd
        df = df.withColumns(caps)
    return (df.drop("_isolation") if forest else df), report


def _any_of(c: str, pairs: list[tuple[float, float]]) -> Column:
    out = F.lit(False)
    for low, high in pairs:
        out = out | outside(c, low, high)
    return out
