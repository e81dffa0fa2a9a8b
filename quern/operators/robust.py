"""Robust and weighted location, and scale reliability."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import disc, distinct_counts, finite, of_kind
from quern.functions.ranges import ranged
from quern.functions.special import chi2_quantile

WEIGHT_HINTS = ("weight", "wt", "wgt", "weights", "sample_weight", "pweight")
HUBER_K = 1.345


def robust_summary(df: DataFrame, column: str, trim: float = 0.10) -> dict | None:
    """Means and medians of one column; three passes: moments, cut points, deviations."""
    x = df.select(finite(F.col(column)).alias("x")).where("x IS NOT NULL")
    a = x.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("low"), F.avg(F.when(F.col("x") > 0, F.ln("x"))).alias("ln"), F.sum(F.when(F.col("x") > 0, 1 / F.col("x"))).alias("inv"), F.median("x").alias("median")).first()
    n = a["n"]
    if not n:
        return None
    g = int(trim * n)
    lo, hi = x.agg(disc("x", (g + 0.5) / n).alias("lo"), disc("x", (n - g - 0.5) / n).alias("hi")).first()
    v = F.col("x")
    b = x.agg(F.sum(F.when((v > lo) & (v < hi), v)).alias("inner"), F.count_if(v < lo).alias("below"), F.count_if(v == lo).alias("at_lo"), F.count_if(v > hi).alias("above"), F.count_if(v == hi).alias("at_hi"), F.avg(F.greatest(F.least(v, F.lit(hi)), F.lit(lo))).alias("winsor"), F.median(F.abs(v - a["median"])).alias("mad")).first()
    # of the values equal to a cut point, only as many as aren't trimmed count
    if lo == hi:
        trimmed = lo
    else:
        keep_lo, keep_hi = b["at_lo"] - (g - b["below"]), b["at_hi"] - (g - b["above"])
        trimmed = ((b["inner"] or 0.0) + lo * keep_lo + hi * keep_hi) / (n - 2 * g)
    positive = a["low"] > 0
    return {"feature": column, "arithmetic_mean": a["mean"], "geometric_mean": math.exp(a["ln"]) if positive else None, "harmonic_mean": n / a["inv"] if positive else None, "trimmed_mean_10": trimmed, "winsorized_mean_10": b["winsor"], "median": a["median"], "mad": b["mad"], "huber_location": huber(x, a["median"], b["mad"])}


def huber(x: DataFrame, start: float, mad: float, rounds: int = 30) -> float:
    """Huber's location: values beyond 1.345 scaled MADs count less; each round is one aggregate."""
    scale, at = mad / 0.6744897501960817, start
    if not scale:
        return start
    for _ in range(rounds):
        w = F.least(F.lit(1.0), HUBER_K * scale / F.greatest(F.abs(F.col("x") - at), F.lit(1e-300)))
        new = x.agg((F.sum(w * F.col("x")) / F.sum(w)).alias("m")).first()["m"]
        if abs(new - at) < 1e-8 * scale:
            return new
        at = new
    return at


def weighted_means(df: DataFrame, weight: str, columns: list[str]) -> DataFrame:
    """(column, mean, weighted_mean), over rows with a weight."""
    w = F.col(weight)
    wide = df.agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"m{i}"), (F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"w{i}"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"w{i}").alias("weighted_mean")) for i, c in enumerate(columns)))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def weight_column(df: DataFrame) -> str | None:
    return next((c for c in of_kind(df, "numeric") if set(re.split(r"[^a-z]+", c.lower())) & set(WEIGHT_HINTS)), None)


def cronbach_alpha(df: DataFrame, items: list[str]) -> dict:
    """alpha with a normal-theory interval; rows complete in all items."""
    base = df.select(*(F.col(c).cast("double").alias(c) for c in items)).na.drop()
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    row = base.agg(F.count("*").alias("n"), F.var_samp(total).alias("total"), *(F.var_samp(c).alias(f"v{i}") for i, c in enumerate(items))).first()
    k, n = len(items), row["n"]
    alpha = k / (k - 1) * (1 - sum(row[f"v{i}"] for i in range(k)) / row["total"]) if row["total"] else None
    if alpha is None or n < 3:
        return {"n": n, "alpha": alpha, "low": None, "high": None}
    # 1 - alpha times an F variate; chi-square quantiles stand in for F at these degrees of freedom
    d = (n - 1) * (k - 1)
    f = lambda p: (chi2_quantile(p, n - 1) / (n - 1)) / (chi2_quantile(1 - p, d) / d)
    return {"n": n, "alpha": alpha, "low": 1 - (1 - alpha) * f(0.975), "high": 1 - (1 - alpha) * f(0.025)}


def likert_items(df: DataFrame) -> list[str]:
    numbers = [f for f in of_kind(df, "numeric") if dict(df.dtypes)[f] in ("tinyint", "smallint", "int", "bigint")]
    levels = distinct_counts(df, numbers)
    few = [c for c in numbers if 2 < levels[c] <= 7]
    low = df.agg(*(F.min(c).alias(c) for c in few)).first().asDict() if few else {}
    return [c for c in few if low[c] is not None and low[c] >= 0]


def survey_analysis(df: DataFrame) -> dict | None:
    items, weight = likert_items(df), weight_column(df)
    out: dict = {"cronbach_items": items, "weight_column": weight}
    if len(items) >= 3:
        out["cronbach"] = cronbach_alpha(df, items)
    if weight:
        out["weighted_means"] = [tuple(r) for r in weighted_means(df, weight, [c for c in of_kind(df, "numeric") if c != weight]).collect()]
    return out if "cronbach" in out or weight else None


#: Words in the names of columns that hold durations and events.
DURATION_HINTS, EVENT_HINTS = ("duration", "time", "tenure", "survival", "days", "months"), ("event", "status", "death", "died", "churn", "failed", "observed")


def survival_columns(df: DataFrame) -> tuple[str, str] | None:
    """(duration, event): a number whose name has a word of a duration, and a column of 0 and 1 whose name has one of
    an event; names are matched by whole words."""
    words = lambda c: set(re.split(r"[^a-z]+", c.lower()))
    numbers = of_kind(df, "numeric")
    events = [c for c in numbers if words(c) & set(EVENT_HINTS)]
    if events:
        row = df.agg(*(x for i, c in enumerate(events) for x in (F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.count_if((F.col(c) != 0) & (F.col(c) != 1)).alias(f"o{i}")))).first()
        events = [c for i, c in enumerate(events) if row[f"o{i}"] == 0 and (row[f"a{i}"], row[f"b{i}"]) == (0, 1)]
    durations = [c for c in numbers if words(c) & set(DURATION_HINTS) and c not in events]
    return (durations[0], events[0]) if durations and events else None


def kaplan_meier(df: DataFrame, duration: str, event: str) -> DataFrame:
    """(time, at_risk, events, survival) for each time with an event.

    Times are counted first; products run over different times, in two levels by ranges of time.
    """
    base = df.select(F.col(duration).cast("double").alias("time"), F.col(event).cast("int").alias("e")).where("time IS NOT NULL AND e IS NOT NULL")
    counts = base.groupBy("time").agg(F.sum("e").alias("events"), F.count("*").alias("n"))
    cut = ranged(counts, "time", values=base.agg(F.approx_count_distinct("time")).first()[0])
    back = Window.partitionBy("_p").orderBy(F.desc("time"))
    cut = cut.withColumn("_r", F.sum("n").over(back))
    ends = cut.groupBy("_p").agg(F.sum("n").alias("t"))
    later = Window.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    risk = cut.join(F.broadcast(ends.select(F.col("_p").alias("_q"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("o"))), F.col("_p") == F.col("_q")).withColumn("at_risk", F.col("_r") + F.col("o")).where("events > 0")
    # where all at risk fail survival is 0 from there on, and ln(0) would be null
    step = risk.withColumn("_l", F.when(F.col("events") < F.col("at_risk"), F.ln(1 - F.col("events") / F.col("at_risk"))).otherwise(0.0)).withColumn("_z", (F.col("events") == F.col("at_risk")).cast("int"))
    forth = Window.partitionBy("_p").orderBy("time")
    step = step.withColumn("_s", F.sum("_l").over(forth)).withColumn("_d", F.max("_z").over(forth))
    tops = step.groupBy("_p").agg(F.sum("_l").alias("l"), F.max("_z").alias("z"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(F.col("_p").alias("_w"), F.coalesce(F.sum("l").over(earlier), F.lit(0.0)).alias("ol"), F.coalesce(F.max("z").over(earlier), F.lit(0)).alias("oz"))
    done = step.join(F.broadcast(offsets), F.col("_p") == F.col("_w"))
    return done.select("time", "at_risk", "events", F.when((F.col("_d") == 1) | (F.col("oz") == 1), 0.0).otherwise(F.exp(F.col("_s") + F.col("ol"))).alias("survival"))


def median_survival(curve: DataFrame) -> float | None:
    return curve.where("survival <= 0.5").agg(F.min("time")).first()[0]


def cox_model(df: DataFrame, duration: str, event: str, covariates: list[str], penalty: float = 0.1, max_rows: int = 20_000) -> dict:
    """Penalised Cox regression (Breslow ties) on a bounded sample: coefficients, hazard ratios, p, concordance."""
    import numpy as np

    from quern.functions.special import normal_two_sided

    cols = [duration, event, *covariates]
    x = df.select(*(finite(F.col(c).cast("double")).alias(c) for c in cols)).na.drop().orderBy(F.xxhash64(*cols)).limit(max_rows).toPandas().to_numpy(float)
    order = np.argsort(-x[:, 0], kind="stable")
    t, e, z = x[order, 0], x[order, 1], x[order, 2:]
    mean, sd = z.mean(axis=0), z.std(axis=0)
    z = (z - mean) / np.where(sd > 0, sd, 1)
    beta = np.zeros(z.shape[1])
    last = np.searchsorted(-t, -t, side="right") - 1  # ties are at risk together
    for _ in range(50):
        w = np.exp(np.clip(z @ beta, -50, 50))
        s0, s1 = np.cumsum(w)[last], np.cumsum(w[:, None] * z, axis=0)[last]
        s2 = np.cumsum(w[:, None, None] * z[:, :, None] * z[:, None, :], axis=0)[last]
        m = s1 / s0[:, None]
        g = (e[:, None] * (z - m)).sum(axis=0) - penalty * beta
        h = (e[:, None, None] * (s2 / s0[:, None, None] - m[:, :, None] * m[:, None, :])).sum(axis=0) + penalty * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    risk = z @ beta
    some = np.random.default_rng(7).integers(0, len(t), (200_000, 2))
    i, j = some[:, 0], some[:, 1]
    usable = (t[i] < t[j]) & (e[i] == 1)
    c = ((risk[i] > risk[j])[usable].sum() + 0.5 * (risk[i] == risk[j])[usable].sum()) / max(usable.sum(), 1)
    scale = np.where(sd > 0, sd, 1)
    return {"concordance": float(c), "terms": [(name, float(b / s), float(math.exp(b / s)), normal_two_sided(b / q)) for name, b, s, q in zip(covariates, beta, scale, se)]}
