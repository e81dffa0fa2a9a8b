"""Power transforms and distribution fits by maximum likelihood, from Spark aggregates."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.audit import StepReport
from quern.functions.columns import finite
from quern.operators.relations import varying

#: Grid of lambdas; all their likelihoods come from one aggregate.
LAMBDAS = [i / 20 for i in range(-40, 41)]


@dataclass
class TransformSuggestion:
    feature: str
    method: str
    suffix: str
    lam: float
    skew_before: float
    skew_after: float


def box_cox(x: Column, lam: float) -> Column:
    return F.ln(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def best_lambda(x: DataFrame, method: str) -> float:
    """The grid's most likely lambda, refined once around it."""
    f = box_cox if method == "box-cox" else yeo_johnson
    v = F.col("x")
    jacobian = F.avg(F.ln(v)) if method == "box-cox" else F.avg(F.signum(v) * F.log1p(F.abs(v)))
    grid = LAMBDAS
    for _ in range(2):
        row = x.agg(jacobian.alias("j"), *(F.var_pop(f(v, lam)).alias(f"v{i}") for i, lam in enumerate(grid))).first()
        like = [-0.5 * math.log(row[f"v{i}"]) + (lam - 1) * row["j"] if row[f"v{i}"] and math.isfinite(row[f"v{i}"]) and row[f"v{i}"] > 0 else -math.inf for i, lam in enumerate(grid)]
        best = grid[max(range(len(grid)), key=like.__getitem__)]
        step = grid[1] - grid[0]
        grid = [best + step * i / 20 for i in range(-20, 21)]
    return best


def suggest_transforms(df: DataFrame, columns: list[str] | None = None, threshold: float = 1.0) -> list[TransformSuggestion]:
    out = []
    for c in columns or varying(df):
        x = df.select(finite(F.col(c)).alias("x")).where("x IS NOT NULL")
        row = x.agg(F.skewness("x").alias("s"), F.min("x").alias("low")).first()
        if row["s"] is None or abs(row["s"]) <= threshold:
            continue
        method = "box-cox" if row["low"] > 0 else "yeo-johnson"
        lam = best_lambda(x, method)
        after = x.agg(F.skewness((box_cox if method == "box-cox" else yeo_johnson)(F.col("x"), lam))).first()[0]
        if after is not None and abs(after) < abs(row["s"]):
            out.append(TransformSuggestion(c, method, method.replace("-", ""), lam, row["s"], after))
    return out


def apply_transforms(df: DataFrame, suggestions: list[TransformSuggestion]) -> tuple[DataFrame, StepReport]:
    report = StepReport("transforms")
    new = {}
    for s in suggestions:
        x = F.col(s.feature).cast("double")
        v = F.when(x > 0, box_cox(x, s.lam)) if s.method == "box-cox" else yeo_johnson(x, s.lam)
        new[f"{s.feature}__{s.suffix}"] = v
        report.act(f"{s.feature}: {s.method}, lambda {s.lam:.3f}, skewness {s.skew_before:+.2f} to {s.skew_after:+.2f}")
    return (df.withColumns(new) if new else df), report


def fit_distributions(df: DataFrame, column: str) -> dict | None:
    """Fits without a location parameter, by AIC; every fit needs only sums that one aggregate gives."""
    v = F.col("x")
    x = df.select(finite(F.col(column)).alias("x")).where("x IS NOT NULL")
    r = x.agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.min("x").alias("low"), F.approx_count_distinct("x").alias("d"), F.avg(F.when(v > 0, F.ln(v))).alias("ml"), F.var_pop(F.when(v > 0, F.ln(v))).alias("vl")).first()
    n = r["n"]
    if n < 20 or r["d"] <= 5 or not r["v"]:
        return None
    fits: dict[str, tuple[int, float, tuple]] = {"norm": (2, -n / 2 * (math.log(2 * math.pi * r["v"]) + 1), (r["m"], math.sqrt(r["v"])))}
    if r["low"] >= 0 and r["m"] > 0:
        fits["expon"] = (1, -n * (math.log(r["m"]) + 1), (r["m"],))
    if r["low"] > 0:
        fits["lognorm"] = (2, -n * r["ml"] - n / 2 * (math.log(2 * math.pi * r["vl"]) + 1), (r["ml"], math.sqrt(r["vl"])))
        k = _gamma_shape(math.log(r["m"]) - r["ml"])
        scale = r["m"] / k
        fits["gamma"] = (2, n * ((k - 1) * r["ml"] - r["m"] / scale - k * math.log(scale) - math.lgamma(k)), (k, scale))
        rate = r["ml"] - math.log(r["low"])
        if rate > 0:
            fits["pareto"] = (2, n * (math.log(1 / rate) + math.log(r["low"]) / rate - (1 / rate + 1) * r["ml"]), (1 / rate, r["low"]))
        k, lam = _weibull(x, r["ml"], math.pi / math.sqrt(6 * r["vl"]))
        fits["weibull_min"] = (2, n * (math.log(k) - k * math.log(lam) + (k - 1) * r["ml"] - 1), (k, lam))
    ranked = sorted((2 * p - 2 * ll, name) for name, (p, ll, _) in fits.items())
    best = ranked[0][1]
    p, ll, params = fits[best]
    return {"feature": column, "best_distribution": best, "aic": ranked[0][0], "bic": p * math.log(n) - 2 * ll, "params": params, "candidates": [(name, aic) for aic, name in ranked]}


def _gamma_shape(s: float) -> float:
    """Solves ln k - digamma(k) = s by Newton's method."""

    def digamma(v: float) -> float:
        out = 0.0
        while v < 10:
            out -= 1 / v
            v += 1
        f = 1 / (v * v)
        return out + math.log(v) - 0.5 / v - f * (1 / 12 - f * (1 / 120 - f / 252))

    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        slope = 1 / k - (digamma(k + 1e-5) - digamma(k - 1e-5)) / 2e-5
        step = (math.log(k) - digamma(k) - s) / slope
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * k:
            break
    return k


def _weibull(x: DataFrame, mean_log: float, k: float) -> tuple[float, float]:
    """Newton on the profile likelihood of the shape; each step is one aggregate."""
    v = F.col("x")
    for _ in range(30):
        p = F.pow(v, F.lit(k))
        a = x.agg(F.avg(p).alias("a"), F.avg(p * F.ln(v)).alias("b"), F.avg(p * F.ln(v) ** 2).alias("c")).first()
        g = a["b"] / a["a"] - 1 / k - mean_log
        slope = a["c"] / a["a"] - (a["b"] / a["a"]) ** 2 + 1 / (k * k)
        new = max(k - g / slope, k / 2)
        done, k = abs(new - k) < 1e-10 * k, new
        if done:
            break
    return k, x.agg(F.avg(F.pow(v, F.lit(k)))).first()[0] ** (1 / k)
