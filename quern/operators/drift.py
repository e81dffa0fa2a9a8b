"""Drift between two tables: PSI with Kolmogorov-Smirnov for numbers, PSI with chi-square for categories."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import finite, kind_of
from quern.functions.ranges import MANY, value_facts
from quern.functions.special import chi2_sf, ks_two_sample_p
from quern.operators.impact import ks_statistic

FLOOR = 1e-6
LEAST = 5
#: (from, level)
LEVELS = [(0.25, "major drift"), (0.10, "moderate drift"), (0.0, "stable")]


@dataclass
class DriftResult:
    feature: str
    kind: str
    psi: float
    test: str
    p_value: float | None
    level: str
    statistic: float | None = None


@dataclass
class DriftReport:
    n_a: int
    n_b: int
    results: list[DriftResult] = field(default_factory=list)

    def n_drifted(self) -> int:
        return sum(r.level != "stable" for r in self.results)


def level_of(psi: float) -> str:
    return next(name for least, name in LEVELS if psi >= least)


def _psi_sum(counts: DataFrame) -> DataFrame:
    """psi of counts (key, a, b)."""
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    e = F.greatest(F.col("a") / F.col("ta"), F.lit(FLOOR))
    f = F.greatest(F.col("b") / F.col("tb"), F.lit(FLOOR))
    return counts.crossJoin(F.broadcast(totals)).agg(F.sum((f - e) * F.ln(f / e)).alias("psi"))


def bin_counts(a: DataFrame, b: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(key, a, b) by the bins between edges, the last one closed; values beyond the edges are left out."""
    v = F.col("v")
    at = F.when(v == edges[-1], len(edges) - 2)
    for i in range(len(edges) - 1):
        at = at.when((v >= edges[i]) & (v < edges[i + 1]), i)
    both = a.select(finite(F.col(column)).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(finite(F.col(column)), F.lit(0), F.lit(1)))
    found = both.select(at.alias("key"), "a", "b").where("key IS NOT NULL").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    bins = a.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("key"))
    return bins.join(found, "key", "left").na.fill(0, ["a", "b"])


def decile_edges(a: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Different deciles of the baseline, by linear interpolation."""
    x = a.select(finite(F.col(column)).alias("x")).where("x IS NOT NULL")
    row = x.agg(F.count("*").alias("n"), F.approx_count_distinct("x").alias("d")).first()
    if not row["n"]:
        return []
    at = [i / bins * (row["n"] - 1) for i in range(bins + 1)]
    places = sorted({p for v in at for p in (math.floor(v), math.ceil(v))})
    found = dict(zip(places, value_facts(x, ["x"], {"x": places}, {"x"} if row["d"] > MANY else frozenset())["x"]["at"]))
    return sorted({found[math.floor(v)] + (found[math.ceil(v)] - found[math.floor(v)]) * (v - math.floor(v)) for v in at})


def psi_numeric(a: DataFrame, b: DataFrame, column: str, bins: int = 10) -> float:
    edges = decile_edges(a, column, bins)
    return 0.0 if len(edges) < 3 else float(_psi_sum(bin_counts(a, b, column, edges)).first()["psi"] or 0.0)


def level_counts(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(key, a, b) over the levels of both tables."""
    one = lambda df, name: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias(name))
    return one(a, "a").join(one(b, "b"), "key", "full_outer").na.fill(0, ["a", "b"])


def chi_square(counts: DataFrame, yates: bool = True) -> tuple[float, int]:
    """(statistic, degrees of freedom) of the levels x 2 table; continuity-corrected at one degree of freedom."""
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("k"))
    joined = counts.crossJoin(F.broadcast(totals))
    n = F.col("ta") + F.col("tb")
    terms = []
    for side, total in (("a", "ta"), ("b", "tb")):
        e = (F.col("a") + F.col("b")) * F.col(total) / n
        d = F.abs(F.col(side) - e)
        d = F.when((F.col("k") == 2) & F.lit(yates), F.greatest(d - F.least(F.lit(0.5), d), F.lit(0.0))).otherwise(d)
        terms.append(d * d / e)
    row = joined.agg(F.sum(terms[0] + terms[1]).alias("x"), F.first("k").alias("k")).first()
    return float(row["x"] or 0.0), max(0, (row["k"] or 1) - 1)


def compute_drift(a: DataFrame, b: DataFrame) -> DriftReport:
    report = DriftReport(a.count(), b.count())
    kinds_b = {f.name: kind_of(f.dataType) for f in b.schema.fields}
    for f in a.schema.fields:
        kind = kind_of(f.dataType)
        if f.name in ("is_outlier", "_row_id") or kinds_b.get(f.name) != kind:
            continue
        if kind == "numeric":
            row = ks_statistic(a, b, f.name).first()
            if min(row["n_a"] or 0, row["n_b"] or 0) < LEAST:
                continue
            psi = psi_numeric(a, b, f.name)
            report.results.append(DriftResult(f.name, kind, psi, "Kolmogorov-Smirnov", ks_two_sample_p(row["ks"], row["n_a"], row["n_b"]), level_of(psi), row["ks"]))
        elif kind in ("categorical", "boolean"):
            counts = level_counts(a, b, f.name).cache()
            sizes = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
            if min(sizes["a"] or 0, sizes["b"] or 0) >= LEAST:
                psi = float(_psi_sum(counts).first()["psi"] or 0.0)
                x, df = chi_square(counts)
                report.results.append(DriftResult(f.name, "categorical", psi, "chi-square", chi2_sf(x, df) if df else None, level_of(psi), x))
            counts.unpersist()
    report.results.sort(key=lambda r: -r.psi)
    return report
