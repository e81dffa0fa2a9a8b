"""Imputation. Fills come from one fused aggregate; time fills from a window in two passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.audit import StepReport
from quern.config import CleanConfig
from quern.functions.columns import medians, of_kind
from quern.functions.ranges import MANY, crowded_columns, ranged, value_facts

#: Column of a stable row order; see add_row_id().
ROW_ID = "_row_id"


def add_row_id(df: DataFrame) -> DataFrame:
    """A number that follows the order of the files read; Spark itself keeps no row order."""
    return df if ROW_ID in df.columns else df.withColumn(ROW_ID, F.monotonically_increasing_id())


def sorted_time_index(df: DataFrame, order: str = ROW_ID) -> str | None:
    """The first date or time column without nulls, 90 % different at least, that never falls in row order."""
    times = of_kind(df, "datetime")
    if not times:
        return None
    # whether a column never falls in the order: within each range of it by the lag, between ranges by their ends
    df = add_row_id(df) if order == ROW_ID else df
    sliced = ranged(df.select(F.col(order).alias("_o"), *times), "_o")
    w = Window.partitionBy("_p").orderBy("_o")
    falls = sliced.select("_o", "_p", *times, *(F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False)).alias(f"f_{i}") for i, c in enumerate(times)))
    ends = falls.groupBy("_p").agg(*(a for i, c in enumerate(times) for a in (F.max(f"f_{i}").alias(f"f_{i}"), F.min_by(c, "_o").alias(f"a_{i}"), F.max_by(c, "_o").alias(f"b_{i}"))))
    between = Window.orderBy("_p")  # a row for each range
    joined = ends.select(*(F.coalesce(F.col(f"a_{i}") < F.lag(f"b_{i}").over(between), F.lit(False)).__or__(F.col(f"f_{i}")).alias(f"g_{i}") for i in range(len(times))))
    facts = df.agg(F.count("*").alias("n"), *(a for i, c in enumerate(times) for a in (F.count(c).alias(f"c{i}"), F.approx_count_distinct(c, 0.02).alias(f"e{i}")))).first()
    # only columns that can pass are looked at row by row
    times = [c for i, c in enumerate(times) if facts["n"] >= 3 and facts[f"c{i}"] == facts["n"] and facts[f"e{i}"] >= 0.8 * facts["n"]]
    if not times:
        return None
    different = value_facts(df, times, many=set(times) if facts["n"] > MANY else frozenset())
    bad = joined.agg(*(F.max(f"g_{i}").alias(f"g_{i}") for i in range(len(joined.columns)))).first()
    n = facts["n"]
    for i, c in enumerate(of_kind(df, "datetime")):
        if c in different and different[c]["distinct"] / n >= 0.9 and not bad[f"g_{i}"]:
            return c
    return None


def carry_fill(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Forward, then backward fill in the order of a column, without one window over all rows.

    Rows are cut into ranges of `order` by fixed bounds; running windows, one in each direction, fill within a range,
    and a table with one row for each range carries the last (first) values across ranges.
    """
    if not columns:
        return df
    cut = ranged(df, order)
    past = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # the same frame over the falling order: a frame that ends at the last row would be summed anew for each row
    future = Window.partitionBy("_p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    keys = {c: F.when(F.col(c).isNotNull(), F.col(order)) for c in columns}
    ends = cut.groupBy("_p").agg(*(a for i, c in enumerate(columns) for a in (F.max_by(c, keys[c]).alias(f"l{i}"), F.min_by(c, keys[c]).alias(f"f{i}"))))
    every = Window.orderBy("_p")
    before, after = every.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_p").alias("_q"), *(a for i in range(len(columns)) for a in (F.last(f"l{i}", True).over(before).alias(f"_l{i}"), F.last(f"f{i}", True).over(after).alias(f"_f{i}"))))
    within = cut.withColumns({f"_a{i}": F.last(c, True).over(past) for i, c in enumerate(columns)})
    within = within.withColumns({f"_b{i}": F.last(c, True).over(future) for i, c in enumerate(columns)})
    joined = within.join(F.broadcast(carried), F.col("_p") == F.col("_q"))
    filled = {c: F.coalesce(f"_a{i}", f"_l{i}", f"_b{i}", f"_f{i}") for i, c in enumerate(columns)}
    return joined.select(*(filled[c].alias(c) if c in filled else F.col(c) for c in df.columns))


def statistical_fills(df: DataFrame, columns: list[str], how: str, skew_threshold: float) -> dict[str, tuple[str, float]]:
    """(statistic, value) for each column with nulls: the mean, or the median where the data are skewed."""
    if not columns:
        return {}
    holes = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(columns))).first()
    columns = [c for i, c in enumerate(columns) if holes[f"z{i}"]]
    if not columns:
        return {}
    row = df.agg(*(a for i, c in enumerate(columns) for a in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.skewness(c).alias(f"s{i}")))).first()
    out: dict[str, tuple[str, float]] = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"]:
            skew = row[f"s{i}"]
            median = how == "median" or (how == "auto" and skew is not None and abs(skew) > skew_threshold)
            out[c] = ("median", 0.0) if median else ("mean", row[f"m{i}"])
    found = medians(df, [c for c, (name, _) in out.items() if name == "median"])
    return {c: (name, found.get(c, v)) for c, (name, v) in out.items()}


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The most frequent value of each column; of equals the smallest."""
    return {c: f["top"] for c, f in value_facts(df, columns, many=crowded_columns(df, columns)).items()}


def knn_fill(df: DataFrame, columns: list[str], k: int, max_rows: int = 20_000) -> DataFrame:
    """Each missing number from the mean of its k nearest donors, by the Euclidean distance over the columns both
    have, scaled up for those missing. The donor matrix goes to every task, so it is bounded: of more than max_rows
    rows those with the smallest hash are donors."""
    donors_ = df.select(*(F.col(c).cast("double") for c in columns))
    matrix = donors_.orderBy(F.xxhash64(*columns), *columns).limit(max_rows).toPandas().to_numpy(float)
    sent = df.sparkSession.sparkContext.broadcast(matrix)
    means = np.nanmean(matrix, axis=0) if len(matrix) else np.zeros(len(columns))
    kept, schema = df.columns, df.withColumns({c: F.col(c).cast("double") for c in columns}).schema

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        donors = sent.value
        known = ~np.isnan(donors)
        zeroed = np.where(known, donors, 0.0)
        for batch in batches:
            x = batch[columns].to_numpy(float)
            for r in np.flatnonzero(np.isnan(x).any(axis=1)):
                have = ~np.isnan(x[r])
                both = known & have
                n = both.sum(axis=1)
                d = (np.where(both, zeroed - np.where(have, x[r], 0.0), 0.0) ** 2).sum(axis=1) * len(columns) / np.maximum(n, 1)
                d[n == 0] = np.inf
                for j in np.flatnonzero(~have):
                    usable = np.flatnonzero(known[:, j] & np.isfinite(d))
                    near = usable[np.argsort(d[usable], kind="stable")[:k]]
                    x[r, j] = donors[near, j].mean() if len(near) else means[j]
            yield batch.assign(**{c: x[:, j] for j, c in enumerate(columns)})[kept]

    return df.withColumns({c: F.col(c).cast("double") for c in columns}).mapInPandas(fill, schema)


def null_total(df: DataFrame) -> int:
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns))).first()
    return sum(row)


def impute_missing(df: DataFrame, config: CleanConfig | None = None, order: str = ROW_ID) -> tuple[DataFrame, StepReport]:
    config, report = config or CleanConfig(), StepReport("impute")
    report.measure("nulls_before", null_total(df))
    numbers = [c for c in of_kind(df, "numeric") if c != ROW_ID]
    time = sorted_time_index(df, order) if config.detect_timeseries and (order in df.columns or order == ROW_ID) else None
    if time:
        df = carry_fill(df, time, [c for c in numbers if c != time])
        report.act(f"numbers carried forward, then backward, along {time}")
    near = config.impute_numeric == "knn" and numbers and df.limit(config.knn_max_rows + 1).count() <= config.knn_max_rows
    if config.impute_numeric == "knn" and numbers and not near:
        report.warn(f"more than {config.knn_max_rows} rows: filled by mean or median instead of nearest neighbours")
    if near:
        df = knn_fill(df, numbers, config.knn_neighbors)
        report.act(f"nearest-neighbour fill over {len(numbers)} columns")
    elif config.impute_numeric != "none":
        how = "auto" if config.impute_numeric == "knn" else config.impute_numeric
        fills = statistical_fills(df, numbers, how, config.skew_threshold)
        wide: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v)) for c, (_, v) in fills.items()}
        df = df.withColumns(wide) if wide else df
        for c, (name, v) in fills.items():
            report.act(f"{c}: {name} {v:.6g}")
        if numbers:
            row = df.agg(*(F.count(c).alias(f"n{i}") for i, c in enumerate(numbers))).first()
            for i, c in enumerate(numbers):
                if row[f"n{i}"] == 0:
                    report.warn(f"{c} is entirely null and stays so")
    words = of_kind(df, "categorical")
    if config.impute_categorical == "mode" and words:
        holes = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in words)).first().asDict()
        found = {c: v for c, v in modes(df, [c for c in words if holes[c]]).items() if v is not None}
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in found.items()}) if found else df
        report.act(f"most frequent value in {len(found)} text columns")
    elif config.impute_categorical == "constant" and words:
        df = df.fillna(config.categorical_fill_value, words)
        report.act(f"{config.categorical_fill_value!r} in {len(words)} text columns")
    report.measure("nulls_after", null_total(df))
    return df, report
