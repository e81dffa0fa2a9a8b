"""How far a cleaning step moved each column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import finite, of_kind
from quern.functions.ranges import ranged

#: (share of cells, shift in standard deviations, KS): a step is material from the first, negligible below the second.
MATERIAL, NEGLIGIBLE = (0.10, 0.10, 0.15), (0.01, 0.02, 0.05)
KS_LEAST = 8


@dataclass
class ColumnImpact:
    column: str
    cells_changed: int
    change_share: float
    mean_before: float | None
    mean_after: float | None
    std_before: float | None
    std_after: float | None
    mean_shift_sd: float | None
    ks_stat: float | None
    verdict: str

    def describe(self) -> str:
        moved = "" if self.mean_shift_sd is None else f", mean moved {self.mean_shift_sd:.3f} sd"
        return f"{self.column}: {self.cells_changed} cells ({100 * self.change_share:.1f} %) changed{moved} — {self.verdict}"


def verdict(share: float, shift: float | None, ks: float | None) -> str:
    values = (share, shift or 0.0, ks or 0.0)
    if any(v >= m for v, m in zip(values, MATERIAL)):
        return "material"
    return "negligible" if all(v < m for v, m in zip(values, NEGLIGIBLE)) else "minor"


def changed(before: Column, after: Column) -> Column:
    """Null that got a value, or a value that became another."""
    return after.isNotNull() & ~before.eqNullSafe(after)


def ks_statistic(a: DataFrame, b: DataFrame, column_a: str, column_b: str | None = None) -> DataFrame:
    """(n_a, n_b, ks): greatest distance of the two empirical distribution functions.

    Values are counted first, so the windows run over different values only; the running counts go in two
    levels, by ranges of values and within each, so that no task holds all of them.
    """
    va = a.select(finite(F.col(column_a)).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    vb = b.select(finite(F.col(column_b or column_a)).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = va.unionAll(vb).where("v IS NOT NULL")
    counts = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    cut = ranged(counts, "v", values=both.agg(F.approx_count_distinct("v")).first()[0])
    within = Window.partitionBy("_p").orderBy("v")
    part = cut.select("_p", F.sum("a").over(within).alias("ca"), F.sum("b").over(within).alias("cb"))
    ends = part.groupBy("_p").agg(F.max("ca").alias("ta"), F.max("cb").alias("tb"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(F.col("_p").alias("_q"), F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("ob"))
    totals = ends.agg(F.sum("ta").alias("n_a"), F.sum("tb").alias("n_b"))
    gap = F.abs((F.col("ca") + F.col("oa")) / F.col("n_a") - (F.col("cb") + F.col("ob")) / F.col("n_b"))
    return part.join(F.broadcast(offsets), F.col("_p") == F.col("_q")).crossJoin(F.broadcast(totals)).agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max(gap).alias("ks"))


def measure_impact(before: DataFrame, after: DataFrame, key: str = "_row_id", rows_dropped: int | None = None) -> list[ColumnImpact]:
    """Impact on each numeric column both have. Rows are matched by key; where rows were dropped, each counts as a change."""
    columns = [c for c in of_kind(before, "numeric", ("is_outlier", key)) if c in after.columns]
    if not columns:
        return []
    n = before.count()
    b = before.select(F.col(key), *(F.col(c).cast("double").alias(f"b{i}") for i, c in enumerate(columns)))
    a = after.select(F.col(key), *(F.col(c).cast("double").alias(f"a{i}") for i, c in enumerate(columns)))
    stats = b.join(a, key).agg(*(F.count_if(changed(F.col(f"b{i}"), F.col(f"a{i}"))).alias(f"c{i}") for i in range(len(columns)))).first()
    moments = lambda df: df.agg(*(x for i, c in enumerate(columns) for x in (F.avg(finite(F.col(c))).alias(f"m{i}"), F.stddev_samp(finite(F.col(c))).alias(f"s{i}"), F.count(finite(F.col(c))).alias(f"n{i}")))).first()
    mb, ma, out = moments(before), moments(after), []
    for i, c in enumerate(columns):
        cells = rows_dropped if rows_dropped else stats[f"c{i}"]
        share = cells / n if n else 0.0
        shift = abs(ma[f"m{i}"] - mb[f"m{i}"]) / mb[f"s{i}"] if mb[f"s{i}"] and ma[f"m{i}"] is not None else None
        ks = None
        if cells and min(mb[f"n{i}"], ma[f"n{i}"]) >= KS_LEAST:
            ks = ks_statistic(before, after, c).first()["ks"]
        out.append(ColumnImpact(c, cells, share, mb[f"m{i}"], ma[f"m{i}"], mb[f"s{i}"], ma[f"s{i}"], shift, ks, verdict(share, shift, ks)))
    return out
