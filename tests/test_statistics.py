import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import special
from quern.operators import drift, fit, models, multivariate, profile, relations, robust, tests, timeseries
from quern.operators.validate import ValidationError, enforce_contract, validate_frame


def test_special_functions():
    assert special.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert special.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05)
    assert special.chi2_quantile(0.975, 2) == pytest.approx(7.377758908227871)


def golden(spark):
    amount = [10, 11, 9.5, None, 10.5, 11.5, 9, 10, 250, None] * 3
    segment = ["retail", "corp", "retail", "corp", None] * 6
    touches = [1, 2, 1, 3, 2, 1, 2, 3, 1, 2] * 3
    return spark.createDataFrame([(i, None if a is None else float(a), s, t) for i, (a, s, t) in enumerate(zip(amount, segment, touches))], "_row_id bigint, amount double, segment string, touches bigint").coalesce(1)


def test_golden_profile(spark):
    from quern.config import CleanConfig
    from quern.plans.pipeline import clean

    out, steps = clean(golden(spark), CleanConfig())
    p = profile.profile_dataset(out.drop("_row_id"))
    amount = next(c for c in p.columns if c.name == "amount")
    assert p.duplicate_rows == 30 and p.n_cols == 4
    assert amount.skewness == pytest.approx(2.666, abs=1e-3) and amount.kurtosis == pytest.approx(5.11, abs=1e-2)
    assert out.agg(F.count_if("is_outlier")).first()[0] == 3
    assert out.where("segment = 'corp'").count() == 18
    assert p.quality_score == 66.0
    assert steps[1].metrics["nulls_after"] == 0


def test_collinear_pairs_are_reported(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, float(7 * i % 13)) for i in range(50)], "x double, y double, z double")
    assert [(a, b) for a, b, _ in profile.profile_dataset(df).collinear_pairs] == [("x", "y")]
    v = dict(relations.vif_scores(df))
    assert v["z"] < 5


def test_contract(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "a bigint, g string")
    assert enforce_contract(df, {"columns": {"a": {"dtype": "Int64", "min": 0}, "g": {"allowed": ["x", "y"]}}}).ok
    bad = enforce_contract(df, {"columns": {"a": {"min": 2}, "g": {"allowed": ["x"]}}}).issues
    assert any("min" in i for i in bad) and any("unexpected" in i for i in bad)
    with pytest.raises(ValidationError):
        enforce_contract(df, {"columns": {"b": {"required": True}}})
    assert any("entirely null" in i for i in validate_frame(spark.createDataFrame([(None, 1)] * 3, "a int, b int")).issues)


def test_robust(spark):
    r = robust.robust_summary(spark.createDataFrame([(float(i),) for i in [*range(1, 100), 10000]], "x double"), "x")
    assert r["median"] == 50.5 and r["arithmetic_mean"] > 149
    assert r["trimmed_mean_10"] == pytest.approx(50.5, abs=1) and r["mad"] == pytest.approx(25, abs=1)
    assert abs(r["winsorized_mean_10"] - r["trimmed_mean_10"]) < 6
    assert r["huber_location"] == pytest.approx(50.5, abs=3)


def test_associations(spark):
    df = spark.createDataFrame([(float(i), float(i**3), "abc"[i % 3], "abc"[i % 3]) for i in range(1, 61)], "x double, y double, u string, v string")
    out = relations.associations(df)
    assert out["spearman"][0][2] == pytest.approx(1.0) and out["kendall"][0][2] == pytest.approx(1.0)
    assert out["cramers_v"][0][2] == pytest.approx(1.0, abs=0.05)


def test_kendall_matches_pairs():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    c = d = tx = ty = 0
    for i in range(60):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c, d, tx, ty = c + (a * b > 0), d + (a * b < 0), tx + (a != 0), ty + (b != 0)
    assert relations.kendall_tau(x, y) == pytest.approx((c - d) / math.sqrt(tx * ty))


def test_distribution_fit(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.gauss(50, 5), rng.weibullvariate(2.0, 1.5)) for _ in range(800)], "g double, w double")
    assert fit.fit_distributions(df, "g")["best_distribution"] in ("norm", "gamma", "lognorm")
    w = fit.fit_distributions(df, "w")
    assert w["best_distribution"] in ("weibull_min", "gamma")


def test_transform_lowers_skewness(spark):
    rng = random.Random(6)
    s = fit.suggest_transforms(spark.createDataFrame([(rng.expovariate(0.5),) for _ in range(400)], "x double"))[0]
    assert abs(s.skew_after) < abs(s.skew_before)


def test_group_tests(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([("A", rng.gauss(0, 1)) for _ in range(60)] + [("B", rng.gauss(5, 1)) for _ in range(60)], "g string, v double")
    assert tests.group_test(df, "v", "g", True).significant
    assert tests.group_test(df, "v", "g", False).effect_value == pytest.approx(-1, abs=0.05)
    assert multivariate.bayesian_analysis(df, "g", ["v"])[0]["bf10"] > 30


def test_normality(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.expovariate(1)) for _ in range(300)], "x double, s double")
    got = {r["feature"]: r["is_normal"] for r in tests.normality_tests(df)}
    assert got == {"x": True, "s": False}


def test_drift(spark):
    rng = random.Random(9)
    a = spark.createDataFrame([(rng.gauss(0, 1), "xy"[i % 2]) for i in range(400)], "v double, c string")
    b = spark.createDataFrame([(rng.gauss(3, 1), "xy"[i % 2]) for i in range(400)], "v double, c string")
    r = {x.feature: x for x in drift.compute_drift(a, b).results}
    assert r["v"].psi > 0.25 and r["v"].level == "major drift" and r["c"].level == "stable"


def test_series():
    t = np.arange(72)
    x = 50 + 0.5 * t + 3 * np.sin(2 * np.pi * t / 12)
    assert timeseries.mann_kendall(x)[2] == "increasing"
    f = timeseries.forecast(x)
    assert len(f["forecast"]) == 12 and all(lo <= hi for lo, hi in zip(f["lower"], f["upper"])) and f["forecast"][0] > 50
    assert timeseries.decompose(x, 12)[0] > 0.9


def test_survival(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(rng.expovariate(1 / 12) + 0.1, int(rng.random() < 0.7), rng.gauss(0, 1)) for _ in range(200)], "t double, e int, z double")
    curve = robust.kaplan_meier(df, "t", "e")
    assert robust.median_survival(curve) > 0
    s = [r["survival"] for r in curve.orderBy("time").collect()]
    assert all(a >= b for a, b in zip(s, s[1:]))
    assert 0.3 < robust.cox_model(df, "t", "e", ["z"])["concordance"] < 0.7


def test_causal(spark):
    rng = random.Random(11)
    rows = []
    for i in range(500):
        t, x = i % 2, rng.gauss(0, 1)
        rows.append((t, x, t + 0.5 * x + rng.gauss(0, 0.5)))
    df = spark.createDataFrame(rows, "t int, x double, y double")
    r = models.causal_analysis(df, "t", "y")
    assert 0.5 < r["effect"] < 1.5 and r["ci_low"] < r["effect"] < r["ci_high"] and 0.5 < r["ipw_ate"] < 1.5
    assert models.causal_analysis(df.withColumn("t", F.col("y").cast("int")), "t", "y") is None


def test_bundle_round_trip(spark, tmp_path):
    rng = random.Random(12)
    df = spark.createDataFrame([((x := rng.gauss(0, 1)), "ab"[i % 2], 3 * x + i % 2) for i in range(120)], "x double, c string, y double")
    b = models.train_exportable(df, "y")
    b.save(str(tmp_path / "m"))
    out = models.predict_frame(models.Bundle.load(spark, str(tmp_path / "m")), df)
    assert out.agg(F.corr("y", "y_prediction")).first()[0] > 0.8


def test_bh():
    assert tests.jarque_bera(100, 0.0, 0.0)[1] == 1.0
