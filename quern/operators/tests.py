"""Hypothesis tests and effect sizes from moments and ranks; no rows leave the executors."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import finite, of_kind
from quern.functions.ranges import SMALL, ranged
from quern.functions.special import chi2_sf, f_sf, normal_cdf, normal_two_sided, t_two_sided

ALPHA = 0.05
#: Anderson-Darling 5 % point for the normal with both parameters estimated: A / (1 + 4/n - 25/n^2).
ANDERSON_5PCT = 0.787


def moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """(level, n, mean, var) by group, levels in order."""
    return df.select(F.col(group).cast("string").alias("level"), finite(F.col(value)).alias("v")).where("level IS NOT NULL AND v IS NOT NULL").groupBy("level").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var")).orderBy("level")


@dataclass
class TestResult:
    value: str
    group: str
    test: str
    statistic: float
    p_value: float
    n_groups: int
    significant: bool
    effect_name: str | None
    effect_value: float | None


def welch_t(a, b) -> tuple[float, float]:
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    t = (a["mean"] - b["mean"]) / math.sqrt(va + vb)
    return t, (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))


def cohens_d(a, b) -> float:
    pooled = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / (a["n"] + b["n"] - 2)
    return (a["mean"] - b["mean"]) / math.sqrt(pooled) if pooled else 0.0


def sums_of_squares(groups) -> tuple[float, float, int, int]:
    """(between, within, n, k)."""
    n = sum(g["n"] for g in groups)
    grand = sum(g["n"] * g["mean"] for g in groups) / n
    return sum(g["n"] * (g["mean"] - grand) ** 2 for g in groups), sum((g["n"] - 1) * (g["var"] or 0.0) for g in groups), n, len(groups)


def anova_f(groups) -> float:
    between, within, n, k = sums_of_squares(groups)
    return (between / (k - 1)) / (within / (n - k)) if within else math.inf


def eta_squared(groups) -> float:
    between, within, _, _ = sums_of_squares(groups)
    return between / (between + within) if between + within else 0.0


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """df's columns with their average ranks as rank_<column>. Values are counted first; the ranks' running counts
    go in two levels (ranges of values, then within each), so that no task holds them all. Ranks of few different
    values meet the rows by broadcast, so that rows aren't shuffled for them."""
    out = df
    sizes = df.agg(*(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns))).first()
    for i, c in enumerate(columns):
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n"))
        cut = ranged(counts, "_v", values=sizes[f"d{i}"])
        upto = cut.withColumn("_c", F.sum("_n").over(Window.partitionBy("_p").orderBy("_v")))
        ends = upto.groupBy("_p").agg(F.max("_c").alias("_t"))
        before = ends.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
        ranks = upto.join(F.broadcast(before), F.col("_p") == F.col("_q")).select("_v", (F.col("_c") + F.col("_o") - (F.col("_n") - 1) / 2).alias(f"rank_{c}"))
        out = out.join(F.broadcast(ranks) if sizes[f"d{i}"] <= SMALL else ranks, out[c] == ranks["_v"], "left").drop("_v")
    return out


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[list, float]:
    """(level, n, ranks) by group, and the tie correction 1 - sum(t^3 - t) / (n^3 - n)."""
    base = df.select(F.col(group).cast("string").alias("level"), finite(F.col(value)).alias("v")).where("level IS NOT NULL AND v IS NOT NULL")
    groups = average_ranks(base, ["v"]).groupBy("level").agg(F.count("*").alias("n"), F.sum("rank_v").alias("ranks")).orderBy("level").collect()
    ties = base.groupBy("v").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("s")).first()["s"] or 0.0
    n = sum(g["n"] for g in groups)
    return groups, 1 - ties / (n**3 - n) if n > 1 else 1.0


def kruskal_h(df: DataFrame, value: str, group: str) -> tuple[float, int]:
    groups, correction = rank_sums(df, value, group)
    n = sum(g["n"] for g in groups)
    h = 12 / (n * (n + 1)) * sum(g["ranks"] ** 2 / g["n"] for g in groups) - 3 * (n + 1)
    return h / correction if correction else 0.0, len(groups) - 1


def mann_whitney(df: DataFrame, value: str, group: str) -> tuple[float, float, float]:
    """(U of the first level, p by the normal form with ties and continuity, Cliff's delta)."""
    (a, b), correction = rank_sums(df, value, group)
    n, m = a["n"], b["n"]
    u = a["ranks"] - n * (n + 1) / 2
    sd = math.sqrt(n * m * (n + m + 1) / 12 * correction)
    z = (abs(u - n * m / 2) - 0.5) / sd if sd else 0.0
    return u, min(1.0, normal_two_sided(max(z, 0.0))), 2 * u / (n * m) - 1


def jarque_bera(n: int, skew: float, kurt: float) -> tuple[float, float]:
    jb = n / 6 * (skew**2 + kurt**2 / 4)
    return jb, math.exp(-jb / 2)


def dagostino(n: int, skew: float, kurt: float) -> float:
    """p of D'Agostino and Pearson's K^2 from population skewness and excess kurtosis."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    zs = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
    e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt + 3 - e) / math.sqrt(v)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    t = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    zk = (1 - 2 / (9 * a) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2 / (9 * a))
    return chi2_sf(zs**2 + zk**2, 2)


def anderson_darling(sample: list[float]) -> float:
    """A^2 for the normal with estimated parameters, of a bounded sample."""
    n = len(sample)
    mean = sum(sample) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in sample) / (n - 1))
    z = [min(max(normal_cdf((x - mean) / sd), 1e-300), 1 - 1e-16) for x in sorted(sample)]
    return -n - sum((2 * i + 1) * (math.log(z[i]) + math.log1p(-z[n - 1 - i])) for i in range(n)) / n


def shapiro_p(sample: list[float]) -> float:
    """Royston's (1995) approximation of the Shapiro-Wilk p-value, for 12 values or more of a bounded sample."""
    from quern.functions.special import normal_quantile

    n, x = len(sample), sorted(sample)
    m = [normal_quantile((i + 1 - 0.375) / (n + 0.25)) for i in range(n)]
    mm = sum(v * v for v in m)
    u = 1 / math.sqrt(n)
    a_n = -2.706056 * u**5 + 4.434685 * u**4 - 2.071190 * u**3 - 0.147981 * u**2 + 0.221157 * u + m[-1] / math.sqrt(mm)
    a_m = -3.582633 * u**5 + 5.682633 * u**4 - 1.752461 * u**3 - 0.293762 * u**2 + 0.042981 * u + m[-2] / math.sqrt(mm)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a_n**2 - 2 * a_m**2)
    a = [-a_n, -a_m, *(v / math.sqrt(phi) for v in m[2:-2]), a_m, a_n]
    mean = sum(x) / n
    w = sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)
    ln = math.log(n)
    mu = 0.0038915 * ln**3 - 0.083751 * ln**2 - 0.31082 * ln - 1.5861
    sigma = math.exp(0.0030302 * ln**2 - 0.082676 * ln - 0.4803)
    return 1 - normal_cdf((math.log(max(1 - w, 1e-300)) - mu) / sigma)


def bounded_sample(df: DataFrame, column: str, n: int = 5000, seed: int = 7) -> list[float]:
    """At most n finite values, chosen by a hash of row content and seed, so that reruns agree."""
    v = finite(F.col(column)).alias("v")
    return [r["v"] for r in df.select(v, F.xxhash64(*df.columns, F.lit(seed)).alias("h")).where("v IS NOT NULL").orderBy("h", "v").limit(n).select("v").collect()]


def normality_tests(df: DataFrame, columns: list[str] | None = None, seed: int = 7) -> list[dict]:
    columns = columns or of_kind(df, "numeric", ("is_outlier", "_row_id"))
    if not columns:
        return []
    row = df.agg(*(a for i, c in enumerate(columns) for a in (F.count(finite(F.col(c))).alias(f"n{i}"), F.skewness(finite(F.col(c))).alias(f"s{i}"), F.kurtosis(finite(F.col(c))).alias(f"k{i}"), F.approx_count_distinct(c).alias(f"d{i}")))).first()
    out = []
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n < 8 or row[f"d{i}"] < 3 or row[f"s{i}"] is None:
            continue
        sample = bounded_sample(df, c, seed=seed)
        r = {"feature": c, "n": n, "shapiro_p": shapiro_p(sample) if len(sample) >= 12 else None, "dagostino_p": dagostino(n, row[f"s{i}"], row[f"k{i}"]) if n >= 20 else None, "jarque_bera_p": jarque_bera(n, row[f"s{i}"], row[f"k{i}"])[1], "anderson_stat": anderson_darling(sample), "anderson_crit_5pct": ANDERSON_5PCT / (1 + 4 / len(sample) - 25 / len(sample) ** 2)}
        votes = [r[p] > ALPHA for p in ("shapiro_p", "dagostino_p", "jarque_bera_p") if r[p] is not None] + [r["anderson_stat"] < r["anderson_crit_5pct"]]
        r["is_normal"] = sum(votes) * 2 >= len(votes)
        out.append(r)
    return out


def group_test(df: DataFrame, value: str, group: str, parametric: bool | None = None) -> TestResult | None:
    """Welch's t or Mann-Whitney for two groups, ANOVA or Kruskal-Wallis for more; levels in order fix the signs."""
    groups = [g for g in moments(df, value, group).collect() if g["n"] >= 5]
    if len(groups) < 2:
        return None
    df = df.where(F.col(group).cast("string").isin([g["level"] for g in groups]))
    if parametric is None:
        normal = [normality_tests(df.where(F.col(group).cast("string") == g["level"]), [value]) for g in groups]
        parametric = all(r and r[0]["is_normal"] for r in normal)
    if len(groups) == 2 and parametric:
        t, dof = welch_t(*groups)
        test, stat, p, name, effect = "Welch t", t, t_two_sided(t, dof), "Cohen's d", cohens_d(*groups)
    elif len(groups) == 2:
        stat, p, effect = mann_whitney(df, value, group)
        test, name = "Mann-Whitney U", "Cliff's delta"
    else:
        _, _, n, k = sums_of_squares(groups)
        name, effect = "eta squared", eta_squared(groups)
        if parametric:
            test, stat = "ANOVA", anova_f(groups)
            p = f_sf(stat, k - 1, n - k)
        else:
            test, (stat, dof) = "Kruskal-Wallis", kruskal_h(df, value, group)
            p = chi2_sf(stat, dof)
    return TestResult(value, group, test, stat, p, len(groups), p < ALPHA, name, round(effect, 3))


def adjusted(df: DataFrame, p: str = "p_value", name: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, over a table of tests (bounded by pairs of columns)."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    ranked = df.withColumn("_n", n).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(p)))
    falling = Window.partitionBy(F.lit(0)).orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.min(F.col(p) * F.col("_n") / F.col("_r")).over(falling), F.lit(1.0))).drop("_n", "_r")


def correlation_significance(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(a, b, r, n, p_value, p_adj, significant) of all pairs, pairwise complete, most significant first."""
    columns = (columns or of_kind(df, "numeric", ("is_outlier", "_row_id")))[:30]
    pairs = list(combinations(columns, 2))
    schema = "a string, b string, r double, n bigint, p_value double"
    if not pairs:
        return adjusted(df.sparkSession.createDataFrame([], schema)).withColumn("significant", F.col("p_adj") < ALPHA)
    row = df.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}")))).first()
    rows = []
    for i, (a, b) in enumerate(pairs):
        r, n = row[f"r{i}"], row[f"n{i}"]
        if r is None or n < 3 or math.isnan(r):
            continue
        p = 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)
        rows.append((a, b, float(r), n, p))
    return adjusted(df.sparkSession.createDataFrame(rows, schema)).withColumn("significant", F.col("p_adj") < ALPHA).orderBy("p_adj", "a", "b")


def bootstrap_mean_ci(df: DataFrame, column: str, resamples: int = 2000, seed: int = 7) -> tuple[float, float, float] | None:
    """(mean, low, high): percentile interval of a Poisson bootstrap, all resamples in one pass.

    Values are first folded into 1,000 slices by a hash; each resample weighs slices' sums by Poisson(1) draws of
    their own, so the pass costs slices x resamples rather than rows x resamples.
    """
    v = df.select(finite(F.col(column)).alias("v"), F.pmod(F.xxhash64(*df.columns), F.lit(1000)).alias("s")).where("v IS NOT NULL")
    n = v.limit(5).count()
    if n < 5:
        return None
    import numpy as np

    slices = v.groupBy("s").agg(F.sum("v").alias("t"), F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("q")).collect()  # at most 1,000 rows
    rng = np.random.default_rng(seed)
    t, c = np.array([r["t"] for r in slices]), np.array([r["n"] for r in slices], float)
    w = rng.poisson(1.0, (resamples, len(t)))
    w[w.sum(axis=1) == 0, 0] = 1
    means = (w @ t) / (w @ c)
    return float(t.sum() / c.sum()), float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5))
