"""Time series: a grid of means by time in Spark, diagnostics and forecasts on the bounded grid."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import of_kind
from quern.functions.ranges import ranged
from quern.functions.special import chi2_sf, normal_two_sided

#: A grid of more points than this is averaged to equal steps before it goes to the driver.
GRID_POINTS = 20_000
PERIODS = (7, 12, 24, 30, 52, 365)


def time_grid(df: DataFrame, time: str, columns: list[str], bucket: str | None = None) -> DataFrame:
    """Means of the columns by time (or by hour, day ...), rows with a null left out."""
    at = F.date_trunc(bucket, F.col(time)) if bucket else F.col(time)
    return df.groupBy(at.alias("t")).agg(*(F.avg(c).alias(c) for c in columns)).na.drop()


def acf(grid: DataFrame, column: str, lags: int = 40, time: str = "t") -> DataFrame:
    """(lag, r): autocorrelations over the grid, all lags from one pass.

    The series' centred values meet their lags by their place in time; places come from a range-wise count.
    """
    cut = ranged(grid.select(F.col(time).alias("t"), F.col(column).alias("x")), "t")
    ends = cut.groupBy("_p").agg(F.count("*").alias("n"))
    before = ends.select(F.col("_p").alias("_q"), F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    placed = cut.join(F.broadcast(before), F.col("_p") == F.col("_q")).select((F.row_number().over(Window.partitionBy("_p").orderBy("t")) + F.col("o")).alias("i"), "x")
    centre = placed.agg(F.avg("x").alias("m"))
    centred = placed.crossJoin(F.broadcast(centre)).select("i", (F.col("x") - F.col("m")).alias("c"))
    shifted = centred.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), (F.col("i") + F.col("lag")).alias("i"), F.col("c").alias("d"))
    sums = centred.join(shifted, "i").groupBy("lag").agg(F.sum(F.col("c") * F.col("d")).alias("s"))
    zero = sums.where("lag = 0").select(F.col("s").alias("s0"))
    return sums.where("lag > 0").crossJoin(F.broadcast(zero)).select("lag", (F.col("s") / F.col("s0")).alias("r"))


def ljung_box(acf_rows: list, n: int, lags: int = 10) -> tuple[float, float]:
    q = n * (n + 2) * sum(r["r"] ** 2 / (n - r["lag"]) for r in acf_rows if r["lag"] <= lags)
    return q, chi2_sf(q, lags)


def bounded_series(grid: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(times, values): the grid in order; longer ones averaged to GRID_POINTS equal slices of rows by time."""
    n = grid.count()
    if n > GRID_POINTS:
        cuts = grid.select(F.col("t").cast("timestamp").cast("double").alias("s"), *columns)
        ends = cuts.agg(F.min("s").alias("a"), F.max("s").alias("b")).first()
        width = (ends["b"] - ends["a"]) / GRID_POINTS or 1.0
        grid = cuts.groupBy(F.floor((F.col("s") - ends["a"]) / width).alias("t")).agg(*(F.avg(c).alias(c) for c in columns))
    pdf = grid.orderBy("t").toPandas()
    return pdf["t"].to_numpy(), pdf[columns].to_numpy(float)


def mann_kendall(x: np.ndarray) -> tuple[int, float, str]:
    """(S, p, trend), in blocks."""
    n, s = len(x), 0
    for i in range(n - 1):
        s += int(np.sign(x[i + 1 :] - x[i]).sum())
    _, t = np.unique(x, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - (t * (t - 1) * (2 * t + 5)).sum()) / 18
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    p = normal_two_sided(float(z))
    return s, p, "no trend" if p >= 0.05 else "increasing" if s > 0 else "decreasing"


def _ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ b
    return b, e, float(e @ e)


def adf(x: np.ndarray) -> tuple[float, float]:
    """(statistic, p) with a constant; lags by AIC; p by interpolation of MacKinnon's asymptotic points."""
    n = len(x)
    most = min(int(12 * (n / 100) ** 0.25), n // 2 - 2)
    d, best = np.diff(x), None
    for k in range(most + 1):
        y = d[most:]
        z = np.column_stack([x[most:-1], np.ones(len(y)), *(d[most - j : len(d) - j] for j in range(1, k + 1))])
        b, e, ss = _ols(z, y)
        aic = len(y) * math.log(max(ss, 1e-300) / len(y)) + 2 * z.shape[1]
        if best is None or aic < best[0]:
            cov = np.linalg.pinv(z.T @ z) * ss / max(len(y) - z.shape[1], 1)
            best = (aic, b[0] / math.sqrt(max(cov[0, 0], 1e-300)))
    stat = best[1]
    points = [(-5.0, 0.0001), (-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-1.62, 0.47), (-0.44, 0.90), (-0.07, 0.95), (0.60, 0.99)]
    return stat, float(np.interp(stat, [p[0] for p in points], [p[1] for p in points]))


def kpss(x: np.ndarray) -> tuple[float, float]:
    e = x - x.mean()
    n, lags = len(x), int(4 * (len(x) / 100) ** 0.25)
    s2 = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / n
    stat = float((np.cumsum(e) ** 2).sum() / n**2 / s2) if s2 > 0 else 0.0
    return stat, float(np.interp(stat, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))


def decompose(x: np.ndarray, period: int) -> tuple[float, float]:
    """(seasonal, trend) strength of a moving-average decomposition."""
    kernel = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = len(kernel) // 2
    trend = np.convolve(x, kernel, "valid")
    rest = x[half : half + len(trend)] - trend
    phase = (np.arange(len(rest)) + half) % period
    means = np.array([rest[phase == p].mean() if (phase == p).any() else 0.0 for p in range(period)])
    seasonal = (means - means.mean())[phase]
    r = rest - seasonal
    strength = lambda part: max(0.0, 1 - r.var() / (part + r).var()) if (part + r).var() > 0 else 0.0
    return strength(seasonal), strength(trend)


def timeseries_analysis(df: DataFrame, time: str, columns: list[str] | None = None) -> list[dict]:
    columns = [c for c in (columns or of_kind(df, "numeric", ("is_outlier", "_row_id"))) if c != time][:20]
    if not columns:
        return []
    _, values = bounded_series(time_grid(df, time, columns), columns)
    out = []
    for i, c in enumerate(columns):
        x = values[:, i]
        if len(x) < 20 or x.std() == 0:
            continue
        e = x - x.mean()
        r = [float(e[k:] @ e[:-k] / (e @ e)) for k in range(1, min(40, len(x) - 1) + 1)]
        adf_p, kpss_p = adf(x)[1], kpss(x)[1]
        period = max((p for p in PERIODS if 2 * p <= len(x)), key=lambda p: decompose(x, p)[0], default=None)
        seasonal, trend = decompose(x, period) if period else (None, None)
        s, p, mk = mann_kendall(x)
        q, lb = ljung_box([{"lag": k + 1, "r": v} for k, v in enumerate(r)], len(x))
        out.append({"feature": c, "n": len(x), "adf_p": adf_p, "kpss_p": kpss_p, "stationary": adf_p < 0.05 and kpss_p > 0.05, "top_acf_lags": sorted((k + 1 for k, v in enumerate(r) if v > 0.3), key=lambda k: -r[k - 1])[:5], "seasonal_period": period, "seasonal_strength": seasonal, "trend_strength": trend, "mk_trend": mk, "mk_p": p, "ljung_box_p": lb})
    return out


def arma(y: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, int] | None:
    """(constant, AR, MA, residuals, residuals that count): conditional least squares by Hannan and Rissanen's steps.

    A long autoregression gives first residuals, a regression on lags of both the coefficients; residuals are then
    computed anew and the regression repeated. None where the series is short or the fit isn't invertible.
    """
    n = len(y)
    if n < 8 + 2 * (p + q):
        return None
    e = y - y.mean()
    if q:
        k = min(max(4, p + q + 2), n // 4)
        z = np.column_stack([np.ones(n - k), *(y[k - j : n - j] for j in range(1, k + 1))])
        e = np.r_[np.zeros(k), _ols(z, y[k:])[1]]
    lag = max(p, q)
    b = np.zeros(1 + p + q)
    for _ in range(1 + 4 * bool(q)):
        z = np.column_stack([np.ones(n - lag), *(y[lag - j : n - j] for j in range(1, p + 1)), *(e[lag - j : n - j] for j in range(1, q + 1))])
        b, *_ = np.linalg.lstsq(z, y[lag:], rcond=None)
        ar, ma = b[1 : 1 + p], b[1 + p :]
        if q and np.abs(np.roots(np.r_[1.0, ma])).max(initial=0.0) >= 1:
            return None
        e = np.zeros(n)
        for i in range(lag, n):
            e[i] = y[i] - b[0] - sum(ar[j] * y[i - j - 1] for j in range(p)) - sum(ma[j] * e[i - j - 1] for j in range(q))
    return float(b[0]), b[1 : 1 + p], b[1 + p :], e, n - lag


def _holt(x: np.ndarray, alpha: float, beta: float) -> tuple[np.ndarray, float, float]:
    level, trend, errors = x[0], x[1] - x[0], np.empty(len(x))
    for i, v in enumerate(x):
        errors[i] = v - level - trend
        level, trend = level + trend + alpha * errors[i], trend + alpha * beta * errors[i]
    return errors, level, trend


def forecast(x: np.ndarray, horizon: int = 12) -> dict:
    """The best by AIC of Holt's additive trend and ARIMA(p, d, q) with p, q up to 2 and d up to 1; 95 % intervals."""
    n = len(x)
    grid = [(a, b) for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9) for b in (0.01, 0.05, 0.1, 0.3)]
    ss, a, b = min((float((_holt(x, a, b)[0] ** 2).sum()), a, b) for a, b in grid)
    errors, level, trend = _holt(x, a, b)
    aic = lambda ss, k, m: m * math.log(max(ss, 1e-300) / m) + 2 * k
    best = {"model": "ETS(A,A,N)", "aic": aic(ss, 4, n), "forecast": [level + (h + 1) * trend for h in range(horizon)], "sd": [float(errors.std(ddof=1))] * horizon}
    for d in (0, 1):
        y = np.diff(x) if d else x
        for p in range(3):
            for q in range(3):
                fit = arma(y, p, q)
                if fit is None:
                    continue
                constant, ar, ma, e, used = fit
                ss = float(e[-used:] @ e[-used:])
                if (score := aic(ss, p + q + 2, used) * n / used) < best["aic"]:
                    past, shocks, path = list(y), list(e), []
                    for _ in range(horizon):
                        v = constant + sum(c * past[-j - 1] for j, c in enumerate(ar)) + sum(c * shocks[-j - 1] for j, c in enumerate(ma))
                        past.append(v)
                        shocks.append(0.0)
                        path.append(v)
                    psi = [1.0]
                    for h in range(1, horizon):
                        psi.append((ma[h - 1] if h <= q else 0.0) + sum(ar[j] * psi[h - j - 1] for j in range(min(h, p))))
                    weights = np.cumsum(psi) if d else np.array(psi)
                    sd = np.sqrt(np.cumsum(weights**2) * ss / max(used - p - q, 1))
                    best = {"model": f"ARIMA({p},{d},{q})", "aic": score, "forecast": (x[-1] + np.cumsum(path) if d else np.array(path)).tolist(), "sd": sd.tolist()}
    f, sd = np.array(best["forecast"]), np.array(best.pop("sd"))
    return best | {"horizon": horizon, "last_value": float(x[-1]), "forecast": np.round(f, 4).tolist(), "lower": np.round(f - 1.96 * sd, 4).tolist(), "upper": np.round(f + 1.96 * sd, 4).tolist()}


def forecast_series(df: DataFrame, time: str, columns: list[str] | None = None, horizon: int = 12) -> list[dict]:
    columns = [c for c in (columns or of_kind(df, "numeric", ("is_outlier", "_row_id"))) if c != time][:10]
    _, values = bounded_series(time_grid(df, time, columns), columns)
    return [{"feature": c} | forecast(values[:, i], horizon) for i, c in enumerate(columns) if len(values) >= 20]


def run_fda(df: DataFrame, time: str, columns: list[str] | None = None) -> dict | None:
    """Modes of variation across the columns' curves: standardise, smooth (quadratic, 11 points), decompose."""
    columns = [c for c in (columns or of_kind(df, "numeric", ("is_outlier", "_row_id"))) if c != time]
    if len(columns) < 3:
        return None
    _, values = bounded_series(time_grid(df, time, columns), columns)
    if len(values) < 7:
        return None
    sd = values.std(axis=0)
    z = (values - values.mean(axis=0)) / np.where(sd > 0, sd, 1)
    w = min(11, len(z) if len(z) % 2 else len(z) - 1)
    half = w // 2
    fit = np.linalg.pinv(np.vander(np.arange(-half, half + 1), 3, increasing=True))
    smooth = np.column_stack([np.convolve(z[:, i], fit[0][::-1], "same") for i in range(z.shape[1])])
    for i in range(z.shape[1]):  # ends from the fits of the outermost windows
        for ends, offset in ((slice(0, w), 0), (slice(len(z) - w, len(z)), len(z) - w)):
            c = fit @ z[ends, i]
            for j in range(w):
                if (offset + j < half) or (offset + j >= len(z) - half):
                    smooth[offset + j, i] = c @ np.array([1, j - half, (j - half) ** 2])
    curves = smooth.T - smooth.T.mean(axis=0)
    s = np.linalg.svd(curves, compute_uv=False) ** 2
    ratio = s / s.sum() if s.sum() else s
    return {"time_index": time, "n_curves": len(columns), "n_points": len(z), "variance_ratio": ratio.tolist(), "n_modes_90": int(np.searchsorted(np.cumsum(ratio), 0.90 - 1e-12) + 1)}
