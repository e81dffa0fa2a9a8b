import datetime

import pytest

from quern.config import CleanConfig
from quern.operators.downcast import downcast, narrowest_integer
from quern.operators.impact import ks_statistic, measure_impact, verdict
from quern.operators.impute import carry_fill, impute_missing, knn_fill, sorted_time_index
from quern.operators.outliers import handle_outliers, isolation_scores
from quern.operators.standardize import standardize


def frame(spark, name, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"_row_id bigint, {name} {kind}").coalesce(1)


def column(df, name):
    return [r[name] for r in df.orderBy("_row_id").collect()] if "_row_id" in df.columns else [r[name] for r in df.collect()]


def test_whitespace_is_tidied_and_blank_is_null(spark):
    out, _ = standardize(frame(spark, "s", ["  hello  ", "wor \t ld", "   ", "x"], "string"))
    assert column(out, "s") == ["hello", "wor ld", None, "x"]


@pytest.mark.parametrize(("values", "want"), [(["$1,200.50", "$3,400.00", "$5,000.00", "$2,000.00"], 1200.5), (["45%", "50%", "55%", "60%"], 0.45)])
def test_numbers_in_strings(spark, values, want):
    out, _ = standardize(frame(spark, "v", values, "string"))
    assert column(out, "v")[0] == pytest.approx(want)


def test_iso_dates(spark):
    out, _ = standardize(frame(spark, "d", ["2021-01-01", "2021-02-15", "2021-03-20", "2021-04-25"], "string"))
    assert column(out, "d")[1] == datetime.date(2021, 2, 15)


def test_title_case(spark):
    out, _ = standardize(frame(spark, "s", ["ab-cd EF"], "string"), CleanConfig(categorical_case="title"))
    assert column(out, "s") == ["Ab-Cd Ef"]


def test_mean_fill(spark):
    out, report = impute_missing(frame(spark, "x", [1.0, 2.0, None, 4.0]), CleanConfig(impute_numeric="mean"))
    assert column(out, "x")[2] == pytest.approx(7 / 3)
    assert (report.metrics["nulls_before"], report.metrics["nulls_after"]) == (1, 0)


def test_mode_ties_take_the_smallest(spark):
    out, _ = impute_missing(frame(spark, "c", ["b", "a", None], "string"))
    assert column(out, "c")[2] == "a"


def test_entirely_null_column_warns(spark):
    _, report = impute_missing(frame(spark, "x", [None, None, None]))
    assert report.warnings


def test_carry_fill_crosses_partitions(spark):
    df = spark.createDataFrame([(i, float(i) if i in (5, 90) else None) for i in range(100)], "t bigint, v double").repartition(5)
    got = {r["t"]: r["v"] for r in carry_fill(df, "t", ["v"]).collect()}
    assert got == {i: 5.0 if i < 90 else 90.0 for i in range(100)}


def test_sorted_time_index(spark):
    day = datetime.datetime(2024, 1, 1)
    up = spark.createDataFrame([(i, day + datetime.timedelta(hours=i)) for i in range(40)], "_row_id bigint, ts timestamp_ntz")
    assert sorted_time_index(up) == "ts"
    down = spark.createDataFrame([(i, day - datetime.timedelta(hours=i)) for i in range(40)], "_row_id bigint, ts timestamp_ntz")
    assert sorted_time_index(down) is None


def test_knn_takes_the_nearest_rows(spark):
    df = spark.createDataFrame([(float(i), float(10 * i)) for i in range(20)] + [(5.1, None)], "a double, b double")
    assert [r["b"] for r in knn_fill(df, ["a", "b"], 1).collect()][-1] == 50.0


@pytest.mark.parametrize(("action", "check"), [("flag", lambda d: column(d, "is_outlier") == [False] * 20 + [True]), ("cap", lambda d: max(column(d, "v")) < 1000), ("drop", lambda d: d.count() == 20), ("none", lambda d: d.count() == 21)])
def test_outlier_actions(spark, action, check):
    out, _ = handle_outliers(frame(spark, "v", [float(i) for i in range(1, 21)] + [1000.0]), CleanConfig(outlier_action=action))
    assert check(out)


def test_nan_is_no_outlier(spark):
    out, _ = handle_outliers(frame(spark, "v", [float(i) for i in range(20)] + [float("nan")]), CleanConfig(outlier_methods=("zscore",)))
    assert not column(out, "is_outlier")[-1] if "is_outlier" in out.columns else True


def test_isolation_forest_ranks_the_far_point_first(spark):
    df = spark.createDataFrame([(float(i % 10), float(i % 7)) for i in range(200)] + [(100.0, 100.0)], "a double, b double")
    top = isolation_scores(df, ["a", "b"]).orderBy("_isolation", ascending=False).first()
    assert top["a"] == 100.0


def test_narrowing(spark):
    df = spark.createDataFrame([(1, -5, 1.5), (2, 0, 2.25), (3, 7, 3.125), (250, 1, 4.0)], "u bigint, s bigint, f double")
    out, report = downcast(df)
    assert {f.name: f.metadata.get("logical") for f in out.schema.fields} == {"u": "UInt8", "s": "Int8", "f": "Float32"}
    assert report.metrics["memory_after"] < report.metrics["memory_before"]
    assert narrowest_integer(0, 2**32 - 1)[0] == "UInt32"


def test_floats_that_would_change_stay(spark):
    df = spark.createDataFrame([(1.0, 0.1), (1e39, 0.2), (2.0, 0.3)], "x double, y double")
    out, _ = downcast(df, CleanConfig(float32_rel_tolerance=1e-9))
    assert dict(out.dtypes) == {"x": "double", "y": "double"}


def test_impact_verdicts(spark):
    tiny = frame(spark, "x", [float(i) for i in range(1, 200)] + [None])
    after, _ = impute_missing(tiny, CleanConfig(impute_numeric="median"))
    assert measure_impact(tiny, after)[0].verdict == "negligible"
    brutal = frame(spark, "x", [float(i) for i in range(1, 101)] + [None] * 50)
    r = measure_impact(brutal, brutal.fillna(0.0))[0]
    assert r.verdict == "material" and r.change_share > 0.3
    assert verdict(0.02, 0.0, 0.0) == "minor"


def test_ks_matches_the_definition(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [3.0, 4.0, 5.0, 6.0, 7.0]
    row = ks_statistic(frame(spark, "x", a), frame(spark, "x", b), "x").first()
    want = max(abs(sum(v <= t for v in a) / 4 - sum(v <= t for v in b) / 5) for t in a + b)
    assert row["ks"] == pytest.approx(want)
