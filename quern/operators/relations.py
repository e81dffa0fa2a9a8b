"""Multicollinearity, associations and feature relevance, from correlation matrices and counts."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import distinct_counts, finite, more_than_two, of_kind
from quern.functions.special import f_sf
from quern.operators.tests import average_ranks

SPEARMAN_LEAST, KENDALL_LEAST, PARTIAL_LEAST, CRAMER_LEAST, ETA_LEAST = 0.5, 0.4, 0.3, 0.3, 0.4


def correlation_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, int]:
    """Listwise correlation matrix of k columns and the rows used; one aggregate, k x k numbers on the driver."""
    base = df.select(*(finite(F.col(c)).alias(c) for c in columns)).na.drop()
    pairs = list(combinations(range(len(columns)), 2))
    row = base.agg(F.count("*").alias("n"), *(F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i, j in pairs)).first()
    m = np.eye(len(columns))
    for i, j in pairs:
        r = row[f"r{i}_{j}"]
        m[i, j] = m[j, i] = 0.0 if r is None or math.isnan(r) else r
    return m, row["n"]


def varying(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    return more_than_two(df, columns or of_kind(df, "numeric", ("is_outlier", "_row_id")))


def vif_scores(df: DataFrame, columns: list[str] | None = None) -> list[tuple[str, float]]:
    """(feature, VIF), largest first; the pseudo-inverse stands in where the matrix is singular."""
    columns = columns or varying(df)
    if len(columns) < 2:
        return []
    m, n = correlation_matrix(df, columns)
    if n < len(columns) + 2:
        return []
    try:
        inverse = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(m)
    return sorted(zip(columns, np.abs(np.diag(inverse)).tolist()), key=lambda x: -x[1])


def pca_summary(df: DataFrame, columns: list[str] | None = None) -> dict | None:
    columns = columns or varying(df)
    if len(columns) < 2:
        return None
    m, n = correlation_matrix(df, columns)
    if n < 3:
        return None
    ratio = np.sort(np.clip(np.linalg.eigvalsh(m), 0, None))[::-1]
    ratio = ratio / ratio.sum()
    total = np.cumsum(ratio)
    enough = lambda share: int(np.searchsorted(total, share - 1e-12) + 1)
    return {"explained_variance_ratio": ratio.tolist(), "cumulative": total.tolist(), "n_components_90": enough(0.90), "n_components_95": enough(0.95)}


def spearman_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho): Pearson's correlation of average ranks, over rows complete in all columns."""
    base = df.select(*(finite(F.col(c)).alias(c) for c in columns)).na.drop()
    ranked = average_ranks(base, columns)
    pairs = list(combinations(columns, 2))
    wide = ranked.agg(*(F.corr(f"rank_{a}", f"rank_{b}").alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("rho")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def kendall_tau(x: np.ndarray, y: np.ndarray) -> float:
    """tau-b in n log n by counting exchanges of a merge sort."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    ties = lambda v: int(sum(n * (n - 1) // 2 for n in np.unique(v, return_counts=True, axis=0)[1]))

    def swaps(v: np.ndarray) -> tuple[np.ndarray, int]:
        if len(v) < 2:
            return v, 0
        (a, n), (b, m) = swaps(v[: len(v) // 2]), swaps(v[len(v) // 2 :])
        return np.sort(np.concatenate([a, b]), kind="stable"), n + m + int((len(a) - np.searchsorted(a, b, side="right")).sum())

    n = len(x)
    pairs = n * (n - 1) // 2
    tx, ty, txy = ties(x), ties(y), ties(np.column_stack([x, y]))
    discordant = swaps(y)[1]
    scale = math.sqrt(float(pairs - tx) * float(pairs - ty))
    return (pairs - tx - ty + txy - 2 * discordant) / scale if scale else 0.0


def partial_correlations(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    m, _ = correlation_matrix(df, columns)
    p = np.linalg.pinv(m)
    return [(a, b, float(-p[i, j] / math.sqrt(p[i, i] * p[j, j]))) for (i, a), (j, b) in combinations(enumerate(columns), 2)]


def cramers_v(df: DataFrame, a: str, b: str) -> float:
    """Bias-corrected (Bergsma) V of two columns; chi-square without continuity correction."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o")).cache()
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    n, r, k = cells.agg(F.sum("o")).first()[0] or 0, rows.count(), cols.count()
    if n < 2 or min(r, k) < 2:
        cells.unpersist()
        return 0.0
    # cells that don't occur add their expected count; sum(o^2/e) - n covers them
    x = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("o") ** 2 / (F.col("ra") * F.col("cb") / n))).first()[0] - n
    cells.unpersist()
    phi = max(0.0, x / n - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) ** 2 / (n - 1), k - (k - 1) ** 2 / (n - 1)
    return math.sqrt(phi / max(min(kc - 1, rc - 1), 1e-12))


def correlation_ratio(df: DataFrame, category: str, value: str) -> float:
    from quern.operators.tests import eta_squared, moments

    groups = moments(df, value, category).collect()
    return math.sqrt(eta_squared(groups)) if len(groups) > 1 else 0.0


def associations(df: DataFrame, max_rows: int = 5000) -> dict[str, list]:
    """Pairs above the reporting thresholds; Kendall's tau on a bounded sample."""
    numbers = varying(df)[:20]
    strings = of_kind(df, "categorical")
    levels = distinct_counts(df, strings)
    cats = [c for c in strings if 2 <= levels[c] <= 30]
    out: dict[str, list] = {"spearman": [], "kendall": [], "partial": [], "cramers_v": [], "eta": []}
    if len(numbers) >= 2:
        out["spearman"] = [(r["a"], r["b"], r["rho"]) for r in spearman_matrix(df, numbers).collect() if r["rho"] is not None and abs(r["rho"]) >= SPEARMAN_LEAST]
        x = df.select(*(finite(F.col(c)).alias(c) for c in numbers)).na.drop().orderBy(F.xxhash64(*numbers)).limit(max_rows).toPandas().to_numpy(float)
        for i, j in combinations(range(len(numbers)), 2):
            t = kendall_tau(x[:, i], x[:, j]) if len(x) > 2 else 0.0
            if abs(t) >= KENDALL_LEAST:
                out["kendall"].append((numbers[i], numbers[j], t))
        out["partial"] = [p for p in partial_correlations(df, numbers) if abs(p[2]) >= PARTIAL_LEAST]
    out["cramers_v"] = [(a, b, v) for a, b in combinations(cats, 2) if (v := cramers_v(df, a, b)) >= CRAMER_LEAST]
    out["eta"] = [(c, v, e) for c in cats[:10] for v in numbers[:15] if (e := correlation_ratio(df, c, v)) >= ETA_LEAST]
    for k in out:
        out[k].sort(key=lambda r: -abs(r[2]))
    return out


def infer_task(df: DataFrame, target: str) -> str:
    """classification for text, booleans and integers of at most 20 values, else regression."""
    kind = dict(df.dtypes)[target]
    if kind in ("string", "boolean"):
        return "classification"
    return "classification" if kind in ("tinyint", "smallint", "int", "bigint") and distinct_counts(df, [target])[target] <= 20 else "regression"


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 16) -> float:
    """Plug-in estimate, in nats; numbers are cut at quantiles."""

    def code(c: str):
        if dict(df.dtypes)[c] in ("string", "boolean"):
            return F.coalesce(F.col(c).cast("string"), F.lit(""))
        cuts = sorted(set(df.agg(F.percentile_approx(finite(F.col(c)), [i / bins for i in range(1, bins)], 1000)).first()[0] or []))
        out = F.lit(0)
        for cut in cuts:
            out = out + F.coalesce((F.col(c) > cut).cast("int"), F.lit(0))
        return out.cast("string")

    cells = df.groupBy(code(a).alias("a"), code(b).alias("b")).agg(F.count("*").alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n")).first()[0] or 1
    return float(cells.join(ra, "a").join(rb, "b").agg(F.sum(F.col("n") / total * F.ln(F.col("n") * float(total) / (F.col("na") * F.col("nb"))))).first()[0] or 0.0)


def feature_relevance(df: DataFrame, target: str) -> list[dict]:
    """Mutual information, F and correlation of each feature with the target, most informative first."""
    from quern.operators.tests import anova_f, moments, sums_of_squares

    task, numbers = infer_task(df, target), set(of_kind(df, "numeric"))
    strings = of_kind(df, "categorical")
    levels, out = distinct_counts(df, strings), []
    for c in [*numbers, *strings]:
        if c == target or c in ("_row_id",) or levels.get(c, 0) > 50:
            continue
        r = {"feature": c, "mutual_info": mutual_information(df, c, target), "f_stat": None, "p_value": None, "target_corr": None}
        if c in numbers and task == "classification":
            groups = moments(df, c, target).collect()
            if len(groups) > 1:
                _, _, n, k = sums_of_squares(groups)
                r["f_stat"] = anova_f(groups)
                r["p_value"] = f_sf(r["f_stat"], k - 1, n - k)
        elif c in numbers:
            x = df.agg(F.corr(c, target).alias("r"), F.count(c).alias("n")).first()
            if x["r"] is not None and abs(x["r"]) < 1:
                r["target_corr"] = x["r"]
                r["f_stat"] = x["r"] ** 2 / (1 - x["r"] ** 2) * (x["n"] - 2)
                r["p_value"] = f_sf(r["f_stat"], 1, x["n"] - 2)
        out.append(r)
    out.sort(key=lambda r: (-r["mutual_info"], r["feature"]))
    return [r | {"rank": i + 1} for i, r in enumerate(out)]
