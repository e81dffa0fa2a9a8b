"""Operators in two levels on tables large enough for several ranges, against pandas and plain counting."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions.columns import medians, nearest_quantiles
from quern.functions.ranges import ranged, value_facts
from quern.operators import impact, impute, profile, robust, tests, timeseries

N = 1_200_000


@pytest.fixture(scope="module")
def large(spark):
    """Rows in no order, with holes; computed anew at every use, over many partitions."""
    df = spark.range(0, N, 1, 24).select(F.pmod(F.col("id") * 7919, F.lit(N)).alias("o"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("x"))
    return df.withColumn("v", F.when((F.col("o") > 5000) & (F.pmod(F.xxhash64("o"), F.lit(3)) == 0) & ~F.col("o").between(400_000, 500_000), F.col("x")))


@pytest.fixture(scope="module")
def frame(large):
    return large.toPandas().sort_values("o", ignore_index=True)


def test_ranges_follow_the_order(large):
    ends = ranged(large, "o").groupBy("_p").agg(F.min("o").alias("a"), F.max("o").alias("b"), F.count("*").alias("n")).orderBy("_p").collect()
    assert len(ends) > 8 and all(x["b"] < y["a"] for x, y in zip(ends, ends[1:])) and max(r["n"] for r in ends) < N / 8


def test_carry_fill(large, frame):
    got = impute.carry_fill(large, "o", ["v"]).toPandas().sort_values("o", ignore_index=True)
    pd.testing.assert_series_equal(got["v"], frame["v"].ffill().bfill(), check_names=False)


def test_acf(large, frame):
    walk = large.select(F.col("o").alias("t"), (F.sin(F.col("o") / 5000.0) * 100 + F.col("x") / 100).alias("y")).where("t % 4 = 0")
    y = walk.toPandas().sort_values("t")["y"].to_numpy()
    e = y - y.mean()
    got = {r["lag"]: r["r"] for r in timeseries.acf(walk, "y", 3).collect()}
    assert all(got[k] == pytest.approx(float(e[k:] @ e[:-k] / (e @ e)), abs=1e-9) for k in (1, 2, 3))


def test_kaplan_meier(large, frame):
    df = large.select(F.round("x", 2).alias("time"), (F.pmod(F.xxhash64("x"), F.lit(4)) > 0).cast("int").alias("e"))
    got = {r["time"]: (r["at_risk"], r["survival"]) for r in robust.kaplan_meier(df, "time", "e").collect()}
    by_time = df.groupBy("time").agg(F.sum("e").alias("d"), F.count("*").alias("n")).toPandas().sort_values("time", ignore_index=True)
    risk = by_time["n"][::-1].cumsum()[::-1]
    survival = (1 - by_time["d"] / risk).cumprod()
    some = by_time["d"] > 0
    assert len(got) == some.sum()
    for t, r, s in list(zip(by_time["time"], risk, survival))[:: 997]:
        if t in got:
            assert got[t][0] == r and got[t][1] == pytest.approx(s, abs=1e-9)


def test_ranks_and_ks(large, frame):
    part = large.where("o % 5 = 0").select("o", "x")
    got = tests.average_ranks(part, ["x"]).toPandas().sort_values("o")
    assert (got["rank_x"].to_numpy() == frame[frame["o"] % 5 == 0]["x"].rank().to_numpy()).all()
    a, b = frame["x"][frame["o"] % 2 == 0].to_numpy(), frame["x"][frame["o"] % 2 == 1].to_numpy() ** 1.1
    r = impact.ks_statistic(large.where("o % 2 = 0"), large.where("o % 2 = 1").withColumn("x", F.pow("x", F.lit(1.1))), "x").first()
    grid = np.sort(np.concatenate([a, b]))
    want = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
    assert r["ks"] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("many", [set(), {"x", "v"}])
def test_value_facts(large, frame, many):
    places = {"x": [0, 17, N // 2, N - 1], "v": [3]}
    got = value_facts(large, ["x", "v", "o"], places, many)
    x, v = np.sort(frame["x"].to_numpy()), np.sort(frame["v"].dropna().to_numpy())
    assert got["x"]["at"] == [x[0], x[17], x[N // 2], x[-1]] and got["v"]["at"] == [v[3]]
    assert got["x"]["distinct"] == frame["x"].nunique() and got["o"]["distinct"] == N
    counts = frame["x"].value_counts()
    assert got["x"]["freq"] == counts.max() and got["x"]["top"] == counts[counts == counts.max()].index.min()


def test_quantiles_and_profile(large, frame):
    assert medians(large, ["x", "v"]) == {"x": frame["x"].median(), "v": frame["v"].median()}
    assert nearest_quantiles(large, ["x"], (0.25,))["x"][0] == np.sort(frame["x"].to_numpy())[int(0.25 * (N - 1) + 0.5)]
    p = {c.name: c for c in profile.column_profiles(large)}
    assert p["v"].nulls == frame["v"].isna().sum() and p["v"].n_unique == frame["v"].nunique() + 1 and p["x"].median == frame["x"].median()
    assert profile.duplicate_rows(large.select("x").where("o % 10 = 0")) == int(frame["x"][frame["o"] % 10 == 0].duplicated(keep=False).sum())


def test_time_index_follows_the_order_not_the_layout(spark):
    df = spark.range(0, 50_000, 1, 7).select(F.col("id").alias("k"), (F.lit("2020-01-01").cast("timestamp") + F.expr("make_dt_interval(0, 0, id)")).alias("ts"))
    shuffled = df.orderBy(F.xxhash64("k"))
    assert impute.sorted_time_index(shuffled, "k") == "ts"
    assert impute.sorted_time_index(shuffled.withColumn("ts", F.when(F.col("k") == 31_234, F.lit("2019-01-01").cast("timestamp")).otherwise(F.col("ts"))), "k") is None


def test_fills_where_nulls_are_all_or_none(spark):
    df = spark.createDataFrame([(i, None, float(i)) for i in range(20)], "o bigint, v double, w double")
    got = impute.carry_fill(df, "o", ["v", "w"]).orderBy("o").collect()
    assert all(r["v"] is None for r in got) and [r["w"] for r in got] == [float(i) for i in range(20)]
    assert impute.carry_fill(df.limit(0), "o", ["v"]).count() == 0


def test_many_columns_correlate_alike(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 14))
    x[:, 3] = x[:, 1] * 2 + 0.1 * x[:, 3]
    names = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    got = {(r["a"], r["b"]): (r["r"], r["cov"]) for r in profile.correlation_pairs(df, names).collect()}
    r, c = np.corrcoef(x.T), np.cov(x.T)
    assert all(got[names[i], names[j]] == (pytest.approx(r[i, j]), pytest.approx(c[i, j])) for i in range(14) for j in range(i + 1, 14))


def classic_netcdf() -> bytes:
    """time (unlimited, 2) x lat (3): a coordinate, a scaled grid of shorts by record, and a plain one."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = struct.pack(">II", 10, 2) + name("time") + struct.pack(">I", 0) + name("lat") + struct.pack(">I", 3)
    scale = struct.pack(">II", 12, 2) + name("scale_factor") + struct.pack(">IId", 6, 1, 0.5) + name("_FillValue") + struct.pack(">IIhh", 3, 1, -9, 0)
    none = struct.pack(">II", 0, 0)

    def header(lat_at, t_at):
        var = struct.pack(">II", 11, 2) + name("lat") + struct.pack(">II", 1, 1) + none + struct.pack(">III", 5, 12, lat_at)
        return b"CDF\x01" + struct.pack(">I", 2) + dims + none + var + name("temp") + struct.pack(">III", 2, 0, 1) + scale + struct.pack(">III", 3, 8, t_at)

    start = len(header(0, 0))
    lat = np.array([10, 20, 30], ">f4").tobytes()
    records = b"".join(np.array(r, ">i2").tobytes() for r in ([2, 4, -9], [8, 10, 12]))
    return header(start, start + len(lat)) + lat + records


def test_netcdf(spark, tmp_path):
    from quern.sources.readers import read_any

    path = tmp_path / "grid.nc"
    path.write_bytes(classic_netcdf())
    rows = [tuple(r) for r in read_any(spark, str(path))[0].select("time", "lat", "temp").orderBy("time", "lat").collect()]
    assert rows == [(0, 10, 1), (0, 20, 2), (0, 30, None), (1, 10, 4), (1, 20, 5), (1, 30, 6)]


def test_arma_recovers_coefficients():
    rng = np.random.default_rng(0)
    e = rng.normal(size=4000)
    y = np.zeros(4000)
    for i in range(1, 4000):
        y[i] = 1 + 0.6 * y[i - 1] + e[i] + 0.4 * e[i - 1]
    constant, ar, ma, _, _ = timeseries.arma(y, 1, 1)
    assert constant == pytest.approx(1, abs=0.15) and ar[0] == pytest.approx(0.6, abs=0.06) and ma[0] == pytest.approx(0.4, abs=0.06)
    assert timeseries.arma(y[:5], 2, 2) is None


def test_pdf_is_well_formed():
    from quern.pdf import pdf, table_lines

    data = pdf([("title", ["Report (draft)"]), ("text", ["word " * 400]), ("table", table_lines(["a", "b"], [["1", "x" * 300]] * 200))])
    assert data.startswith(b"%PDF-1.4") and data.endswith(b"%%EOF\n") and data.count(b"/Type /Page ") > 1 and b"Report \\(draft\\)" in data
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    table = data[start:].split(b"\n")
    for i, line in enumerate(table[3 : 2 + int(table[1].split()[1])]):
        assert data[int(line[:10]) :].startswith(b"%d 0 obj" % (i + 1))


def test_survival_columns(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 1, 7.0)], "id bigint, event_observed int, time_days double")
    assert robust.survival_columns(df) == ("time_days", "event_observed")
    assert robust.survival_columns(df.withColumn("event_observed", F.lit(3))) is None
