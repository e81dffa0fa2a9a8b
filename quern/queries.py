"""The registered queries over the driver's tables and their SQL.

Numbers are rounded (6 places, fewer for large sums) on both sides, since sums depend on the order of partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import streaming
from quern.config import CleanConfig
from quern.operators import downcast as narrow
from quern.operators import drift, fit, impact, impute, models, multivariate, outliers, profile, relations, robust, standardize, tests, timeseries
from quern.plans.specialize import detect_specialization

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rows(spark: SparkSession, values: list, schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ------------------------------------------------------------------ profile

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def nearest_sql(c: str, t: str, q: float) -> str:
    """The element nearest to place q (n - 1)."""
    return f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS p, count(*) OVER () AS n FROM {t}) WHERE p = floor({q} * (n - 1) + 0.5))"


def profile_sql(t: str, numbers: list[str], words: list[str]) -> str:
    out = []
    for c in numbers:
        out.append(f"""SELECT '{c}' AS name, 'numeric' AS kind, count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique,
  round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS std, round(min({c}), 7) AS minimum, round({nearest_sql(c, t, 0.25)}, 7) AS q25,
  round(median({c}), 7) AS median, round({nearest_sql(c, t, 0.75)}, 7) AS q75, round(max({c}), 7) AS maximum,
  round((SELECT sqrt(count(*)) * sum(pow({c} - m, 3)) / pow(sum(pow({c} - m, 2)), 1.5) FROM {t}, (SELECT avg({c}) AS m FROM {t})), 7) AS skewness,
  round(kurtosis_pop({c}), 7) AS kurtosis, NULL::VARCHAR AS top_value, NULL::BIGINT AS top_freq FROM {t}""")
    for c in words:
        top = f"(SELECT {c} AS v, count(*) AS f FROM {t} GROUP BY 1 ORDER BY f DESC, v LIMIT 1)"
        nothing = ", ".join(f"NULL::DOUBLE AS {k}" for k in ("mean", "std", "minimum", "q25", "median", "q75", "maximum", "skewness", "kurtosis"))
        out.append(f"SELECT '{c}' AS name, 'categorical' AS kind, count({c}) AS count, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_unique, {nothing}, (SELECT v FROM {top}) AS top_value, (SELECT f FROM {top}) AS top_freq FROM {t}")
    return "\nUNION ALL\n".join(out)


def profiled(df: DataFrame) -> DataFrame:
    return profile.profile_frame(df).drop("dtype", "null_pct")


@query(profile_sql("lineitem", LINE_NUMBERS, []))
def profile_lineitem(spark, d):
    return profiled(table(spark, d, "lineitem").select(*LINE_NUMBERS))


@query(profile_sql("orders", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]))
def profile_orders(spark, d):
    return profiled(table(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority"))


@query(profile_sql("part", ["p_size", "p_retailprice"], ["p_brand", "p_type"]))
def profile_part(spark, d):
    return profiled(table(spark, d, "part").select("p_size", "p_retailprice", "p_brand", "p_type"))


HOLED = "SELECT o_orderkey, nullif(o_custkey % 7, 0) AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS b, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderstatus END AS c FROM orders"


def holed(spark, d) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return spark.sql(HOLED)


@query(f"WITH t AS ({HOLED}) SELECT 'o_orderkey' AS \"column\", count(*) - count(o_orderkey) AS nulls, round(100.0 * (count(*) - count(o_orderkey)) / count(*), 3) AS null_pct FROM t" + "".join(f" UNION ALL SELECT '{c}', count(*) - count({c}), round(100.0 * (count(*) - count({c})) / count(*), 3) FROM t" for c in "abc"))
def missingness_unpivot(spark, d):
    return profile.missingness(holed(spark, d))


@query("SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity HAVING count(*) > 1)")
def duplicate_rows(spark, d):
    return rows(spark, [(profile.duplicate_rows(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")),)], "duplicate_rows bigint")


@query("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS excess")
def duplicate_excess(spark, d):
    df = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return df.agg(F.count("*").alias("n")).crossJoin(df.distinct().agg(F.count("*").alias("u"))).select((F.col("n") - F.col("u")).alias("excess"))


@query("SELECT o_orderpriority AS value, count(*) AS freq, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM orders GROUP BY 1")
def value_counts(spark, d):
    return profile.value_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT p_type AS value, count(*) AS freq, round(100.0 * count(*) / sum(count(*)) OVER (), 3) AS pct FROM part GROUP BY 1 ORDER BY freq DESC, value LIMIT 3")
def top_categories(spark, d):
    return profile.value_counts(table(spark, d, "part"), "p_type", 3)


PAIRS = [(a, b) for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1 :]]


@query("\nUNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r, round(covar_samp({a}, {b}), 4) + 0.0 AS cov FROM lineitem" for a, b in PAIRS))
def correlation_pairs(spark, d):
    out = profile.correlation_pairs(table(spark, d, "lineitem"), LINE_NUMBERS)
    return out.select("a", "b", (F.round("r", 6) + 0.0).alias("r"), (F.round("cov", 4) + 0.0).alias("cov"))


@query("SELECT a, b, r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS) + ") WHERE abs(r) >= 0.5")
def collinear_pairs(spark, d):
    return profile.correlation_pairs(table(spark, d, "lineitem"), LINE_NUMBERS).where("abs(r) >= 0.5").select("a", "b", F.round("r", 6).alias("r"))


@query("""WITH t AS (SELECT o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders),
d AS (SELECT coalesce(sum(n), 0) AS dup FROM (SELECT count(*) AS n FROM t GROUP BY o_orderstatus, o_orderpriority, p HAVING count(*) > 1)),
s AS (SELECT count(*) AS n, count(*) - count(p) AS nulls, (SELECT dup FROM d) AS dup FROM t)
SELECT round(100 * (0.40 * (1 - nulls / (3.0 * n)) + 0.25 * greatest(0, 1 - ((CASE WHEN 100.0 * nulls / n > 20 THEN 1 ELSE 0 END) + (CASE WHEN dup > 0 THEN 1 ELSE 0 END)) / 3.0) + 0.20 * (1 - dup / n) + 0.15), 1) AS quality_score FROM s""")
def quality_score(spark, d):
    df = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END").alias("p"))
    return rows(spark, [(profile.profile_dataset(df).quality_score,)], "quality_score double")


@query("SELECT least(floor((o_totalprice - a) / ((b - a) / 20)), 19)::INTEGER AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders) GROUP BY 1")
def histogram(spark, d):
    return profile.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "n")


# ------------------------------------------------------------------ cleaning

SPACED = "SELECT c_custkey, '  ' || replace(c_name, '#', '   ') || chr(9) || ' ' AS s, CASE WHEN c_custkey % 3 = 0 THEN '   ' ELSE c_mktsegment END AS m FROM customer"


@query(f"WITH t AS ({SPACED}) SELECT c_custkey, nullif(regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS s, nullif(regexp_replace(regexp_replace(m, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '') AS m FROM t")
def standardize_whitespace(spark, d):
    table(spark, d, "customer").createOrReplaceTempView("customer")
    return standardize.standardize(spark.sql(SPACED), CleanConfig(parse_numeric_strings=False, parse_datetimes=False))[0]


@query("SELECT p_partkey, p_retailprice AS price, p_size / 100.0::DOUBLE AS share FROM part")
def parse_numeric_strings(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.concat(F.lit("$ "), F.format_number("p_retailprice", 2)).alias("price"), F.concat(F.col("p_size").cast("string"), F.lit("%")).alias("share"))
    return standardize.standardize(df)[0]


@query("SELECT o_orderkey, o_orderdate::DATE AS iso, o_orderdate::DATE AS dotted FROM orders")
def parse_dates(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("dotted"))
    return standardize.standardize(df)[0]


@query("SELECT c_custkey, lower(c_mktsegment) AS c_mktsegment FROM customer")
def case_normalise(spark, d):
    return standardize.standardize(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), CleanConfig(categorical_case="lower"))[0]


def impute_sql(b: str) -> str:
    return f"WITH t AS ({HOLED}) SELECT o_orderkey, round(coalesce(a, (SELECT {{}}(a) FROM t)), 6) AS a, round(coalesce(b, (SELECT {b}(b) FROM t)), 4) AS b, c FROM t"


def imputed(spark, d, **changes) -> DataFrame:
    config = CleanConfig(detect_timeseries=False, **changes)
    return impute.impute_missing(holed(spark, d), config)[0].select("o_orderkey", F.round(F.col("a").cast("double"), 6).alias("a"), F.round("b", 4).alias("b"), "c")


@query(impute_sql("avg").format("avg"))
def impute_mean(spark, d):
    return imputed(spark, d, impute_numeric="mean", impute_categorical="none")


@query(impute_sql("median").format("median"))
def impute_median(spark, d):
    return imputed(spark, d, impute_numeric="median", impute_categorical="none")


@query(f"WITH t AS ({HOLED}), m AS (SELECT c AS v FROM t WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 1) SELECT o_orderkey, a::DOUBLE AS a, round(b, 4) AS b, coalesce(c, (SELECT v FROM m)) AS c FROM t")
def impute_mode(spark, d):
    return imputed(spark, d, impute_numeric="none")


@query(f"WITH t AS ({HOLED}) SELECT o_orderkey, a::DOUBLE AS a, round(b, 4) AS b, coalesce(c, 'Unknown') AS c FROM t")
def impute_constant(spark, d):
    return imputed(spark, d, impute_numeric="none", impute_categorical="constant")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, pow(l_extendedprice, 3) AS v FROM lineitem), h AS (SELECT CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE v END AS v FROM t),
s AS (SELECT sqrt(count(v)) * sum(pow(v - m, 3)) / pow(sum(pow(v - m, 2)), 1.5) AS k FROM h, (SELECT avg(v) AS m FROM h))
SELECT round((SELECT CASE WHEN abs(k) > 1 THEN (SELECT median(v) FROM h) ELSE (SELECT avg(v) FROM h) END FROM s) / 1e9, 3) AS fill, CASE WHEN (SELECT abs(k) FROM s) > 1 THEN 'median' ELSE 'mean' END AS statistic""")
def impute_auto(spark, d):
    df = table(spark, d, "lineitem").select(F.when(F.col("l_partkey") % 6 != 0, F.pow("l_extendedprice", F.lit(3))).alias("v"))
    name, value = impute.statistical_fills(df, ["v"], "auto", 1.0)["v"]
    return rows(spark, [(round(value / 1e9, 3), name)], "fill double, statistic string")


@query("""WITH t AS (SELECT event_id, ts, CASE WHEN event_id % 4 <> 0 AND event_id > 3 THEN value END AS v FROM events)
SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM t""")
def timeseries_fill(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", F.when((F.col("event_id") % 4 != 0) & (F.col("event_id") > 3), F.col("value")).alias("v"))
    return impute.carry_fill(df, "ts", ["v"]).select("event_id", "v")


@query("SELECT CASE WHEN count(*) >= 3 AND count(ts) = count(*) AND count(DISTINCT ts) >= 0.9 * count(*) AND bool_and(ok) THEN 'ts' END AS time_index FROM (SELECT ts, coalesce(ts >= lag(ts) OVER (ORDER BY event_id), true) AS ok FROM events)")
def time_index_check(spark, d):
    return rows(spark, [(impute.sorted_time_index(table(spark, d, "events"), "event_id"),)], "time_index string")


def iqr_sql(c: str, t: str) -> str:
    return f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT {nearest_sql(c, t, 0.25)} AS q1, {nearest_sql(c, t, 0.75)} AS q3))"


@query(f"SELECT event_id, value < lo OR value > hi AS is_outlier FROM events, {iqr_sql('value', 'events')}")
def outliers_iqr(spark, d):
    df = table(spark, d, "events").select("event_id", "value")
    b = outliers.iqr_bounds(df, ["value"])["value"]
    return df.select("event_id", outliers.outside("value", *b).alias("is_outlier"))


@query("SELECT o_orderkey, abs(o_totalprice - m) > 1.5 * s AS is_outlier FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders)")
def outliers_zscore(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    b = outliers.zscore_bounds(df, ["o_totalprice"], 1.5)["o_totalprice"]
    return df.select("o_orderkey", outliers.outside("o_totalprice", *b).alias("is_outlier"))


@query(f"SELECT e.event_type, round(greatest(least(e.value, hi), lo), 6) AS value FROM events e, {iqr_sql('value', 'events')}")
def outliers_cap(spark, d):
    out = outliers.handle_outliers(table(spark, d, "events").select("event_type", "value"), CleanConfig(outlier_action="cap"))[0]
    return out.select("event_type", F.round("value", 6).alias("value"))


@query(f"SELECT event_type, value FROM events, {iqr_sql('value', 'events')} WHERE NOT (value < lo OR value > hi)")
def outliers_drop(spark, d):
    return outliers.handle_outliers(table(spark, d, "events").select("event_type", "value"), CleanConfig(outlier_action="drop"))[0]


def ladder_sql(c: str, t: str) -> str:
    up = " ".join(f"WHEN min({c}) >= 0 AND max({c}) <= {hi} THEN '{n}'" for n, _, hi, _ in narrow.UNSIGNED[:3])
    down = " ".join(f"WHEN min({c}) >= {lo} AND max({c}) <= {hi} THEN '{n}'" for n, lo, hi, _ in narrow.SIGNED[:3])
    return f"SELECT '{c}' AS name, CASE {up} {down} END AS logical FROM {t}"


@query(" UNION ALL ".join([*(ladder_sql(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")), "SELECT 'l_quantity', 'Float32'", "SELECT 'l_returnflag', 'Categorical'", "SELECT 'l_linestatus', 'Categorical'"]))
def downcast_plan(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    return rows(spark, [(c, n) for c, (n, _) in narrow.plan(df).items()], "name string, logical string")


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, max(abs({c}::FLOAT::DOUBLE - {c}) / CASE WHEN {c} <> 0 THEN abs({c}) ELSE 1 END) <= 1e-6 AS safe FROM lineitem" for c in LINE_NUMBERS))
def float32_safe(spark, d):
    row = table(spark, d, "lineitem").agg(*(narrow.float32_error(F.col(c)).alias(c) for c in LINE_NUMBERS)).first()
    return rows(spark, [(c, row[c] <= 1e-6) for c in LINE_NUMBERS], "name string, safe boolean")


# ------------------------------------------------------------------ impact, drift

KS = """WITH c AS (SELECT v, sum(a) AS a, sum(b) AS b FROM ({both}) GROUP BY v), s AS (SELECT sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c WINDOW w AS (ORDER BY v))
SELECT max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, round(max(abs(ca / na - cb / nb)), 6) AS ks FROM s"""
SPLIT = "SELECT l_extendedprice AS v, (l_shipdate < TIMESTAMP '1996-01-01')::INTEGER AS a, (l_shipdate >= TIMESTAMP '1996-01-01')::INTEGER AS b FROM lineitem"


def split(spark, d) -> tuple[DataFrame, DataFrame]:
    df = table(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    return df.where(early), df.where(~early)


@query(KS.format(both=SPLIT))
def ks_two_sample(spark, d):
    return rounded(impact.ks_statistic(*split(spark, d), "l_extendedprice"))


IMPACT_BEFORE = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS x FROM orders"


@query(f"""WITH b AS ({IMPACT_BEFORE}), a AS (SELECT k, coalesce(x, (SELECT avg(x) FROM b)) AS y FROM b), j AS (SELECT count(*) AS n, count(CASE WHEN x IS NULL THEN 1 END) AS cells, avg(x) AS mb, stddev_samp(x) AS sb, avg(y) AS ma, stddev_samp(y) AS sa FROM b JOIN a USING (k))
SELECT 'x' AS "column", cells AS cells_changed, round(cells / n, 6) AS change_share, round(mb, 3) AS mean_before, round(ma, 3) AS mean_after, round(sb, 3) AS std_before, round(sa, 3) AS std_after, round(abs(ma - mb) / sb, 6) AS mean_shift_sd, 'material' AS verdict FROM j""")
def impact_summary(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    before = spark.sql(IMPACT_BEFORE)
    after = impute.impute_missing(before, CleanConfig(detect_timeseries=False, impute_numeric="mean"))[0]
    r = impact.measure_impact(before, after, key="k")[0]
    return rows(spark, [(r.column, r.cells_changed, round(r.change_share, 6), round(r.mean_before, 3), round(r.mean_after, 3), round(r.std_before, 3), round(r.std_after, 3), round(r.mean_shift_sd, 6), r.verdict)], "column string, cells_changed bigint, change_share double, mean_before double, mean_after double, std_before double, std_after double, mean_shift_sd double, verdict string")


DECILES = ", ".join(f"quantile_cont(v, {i / 10}) FILTER (a = 1) AS q{i}" for i in range(11))
BIN = "CASE WHEN v = q10 THEN 9 " + " ".join(f"WHEN v >= q{i} AND v < q{i + 1} THEN {i}" for i in range(10)) + " END"
PSI = "SELECT round(sum((f - e) * ln(f / e)), 6) AS psi FROM (SELECT greatest(a / sum(a) OVER (), 1e-6) AS e, greatest(b / sum(b) OVER (), 1e-6) AS f FROM c)"


@query(f"WITH t AS ({SPLIT}), q AS (SELECT {DECILES} FROM t), c AS (SELECT {BIN} AS k, sum(a) AS a, sum(b) AS b FROM t, q WHERE {BIN} IS NOT NULL GROUP BY 1) {PSI}")
def psi_numeric(spark, d):
    return rows(spark, [(round(drift.psi_numeric(*split(spark, d), "l_extendedprice"), 6),)], "psi double")


EVENT_LEVELS = "SELECT event_type AS k, count(*) FILTER (event_id % 2 = 0) AS a, count(*) FILTER (event_id % 2 = 1 AND NOT (event_type = 'click' AND event_id % 3 = 0)) AS b FROM events GROUP BY 1"


def event_levels(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return drift.level_counts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1 AND NOT (event_type = 'click' AND event_id % 3 = 0)"), "event_type")


@query(f"WITH c AS ({EVENT_LEVELS}) {PSI}")
def psi_categorical(spark, d):
    return rounded(drift._psi_sum(event_levels(spark, d)))


@query(f"WITH c AS ({EVENT_LEVELS}), t AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM c) SELECT round(sum(pow(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb)) + pow(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb))), 5) AS statistic, count(*) - 1 AS dof FROM t")
def chi_square(spark, d):
    x, dof = drift.chi_square(event_levels(spark, d))
    return rows(spark, [(round(x, 5), dof)], "statistic double, dof bigint")


DRIFT_LEVEL = "CASE WHEN psi >= 0.25 THEN 'major drift' WHEN psi >= 0.1 THEN 'moderate drift' ELSE 'stable' END AS level"


def numeric_drift_sql(c: str) -> str:
    t = SPLIT.replace("l_extendedprice", c)
    edges = f"(SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(v, {i / 10}) FILTER (a = 1)' for i in range(11))}])) AS e FROM ({t}))"
    at = "CASE WHEN v = e[len(e)] THEN len(e) - 2 ELSE len(list_filter(e, lambda x: x <= v)) - 1 END"
    bins = f"SELECT k, sum(a) AS a, sum(b) AS b FROM (SELECT {at} AS k, a, b FROM ({t}), {edges} WHERE v >= e[1] AND v <= e[len(e)] UNION ALL SELECT unnest(range(len(e) - 1)), 0, 0 FROM {edges}) GROUP BY 1"
    psi = f"(WITH c AS ({bins}) {PSI})"
    return f"SELECT '{c}' AS feature, 'numeric' AS kind, {psi} AS psi, 'Kolmogorov-Smirnov' AS test, (SELECT ks FROM ({KS.format(both=t)})) AS statistic"


def level_drift_sql(c: str) -> str:
    t = f"SELECT {c} AS k, count(*) FILTER (l_shipdate < TIMESTAMP '1996-01-01') AS a, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01') AS b FROM lineitem GROUP BY 1"
    e = "(a + b) * {0} / (ta + tb)"
    term = lambda x, total: f"pow(CASE WHEN n = 2 THEN greatest(abs({x} - {e.format(total)}) - 0.5, 0) ELSE {x} - {e.format(total)} END, 2) / ({e.format(total)})"
    chi = f"SELECT round(sum({term('a', 'ta')} + {term('b', 'tb')}), 6) FROM (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb, count(*) OVER () AS n FROM ({t}))"
    return f"SELECT '{c}' AS feature, 'categorical' AS kind, (WITH c AS ({t}) {PSI}) AS psi, 'chi-square' AS test, ({chi}) AS statistic"


DRIFTED = [numeric_drift_sql(c) for c in ("l_quantity", "l_extendedprice", "l_discount")] + [level_drift_sql(c) for c in ("l_returnflag", "l_linestatus")]


@query(f"SELECT *, {DRIFT_LEVEL} FROM ({' UNION ALL '.join(DRIFTED)})")
def drift_report(spark, d):
    a, b = split(spark, d)
    keep = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]
    r = drift.compute_drift(a.select(keep), b.select(keep))
    return rows(spark, [(x.feature, x.kind, round(x.psi, 6), x.test, round(x.statistic, 6), x.level) for x in r.results], "feature string, kind string, psi double, test string, statistic double, level string")


@query("SELECT 'l_discount' AS \"column\", max(l_discount) > 0.05 AS above, min(l_discount) < 0 AS below, bool_and(l_returnflag IN ('A', 'N', 'R')) AS allowed FROM lineitem")
def contract_check(spark, d):
    from quern.operators.validate import enforce_contract

    rules = {"l_discount": {"dtype": "Float64", "required": True, "min": 0, "max": 0.05, "max_null_pct": 0}, "l_returnflag": {"allowed": ["A", "N", "R"]}}
    issues = enforce_contract(table(spark, d, "lineitem"), {"columns": rules}).issues
    return rows(spark, [("l_discount", any("above" in i for i in issues), any("below" in i for i in issues), not any("unexpected" in i for i in issues))], "column string, above boolean, below boolean, allowed boolean")


# ------------------------------------------------------------------ tests and relations

MOMENTS = "SELECT o_orderpriority AS level, count(*) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS var FROM orders GROUP BY 1"
TWO = "SELECT l_linestatus AS level, l_extendedprice AS v FROM lineitem"


@query(f"SELECT level, n, round(mean, 4) AS mean, round(var / 1e6, 4) AS var FROM ({MOMENTS})")
def group_moments(spark, d):
    return tests.moments(table(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("level", "n", F.round("mean", 4).alias("mean"), F.round(F.col("var") / 1e6, 4).alias("var"))


TWO_MOMENTS = f"WITH g AS (SELECT level, count(*)::DOUBLE AS n, avg(v) AS mean, var_samp(v) AS var FROM ({TWO}) GROUP BY 1), a AS (SELECT * FROM g ORDER BY level LIMIT 1), b AS (SELECT * FROM g ORDER BY level DESC LIMIT 1)"


@query(f"{TWO_MOMENTS} SELECT round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t, round(pow(a.var / a.n + b.var / b.n, 2) / (pow(a.var / a.n, 2) / (a.n - 1) + pow(b.var / b.n, 2) / (b.n - 1)), 3) AS dof FROM a, b")
def welch_t(spark, d):
    t, dof = tests.welch_t(*tests.moments(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus").collect())
    return rows(spark, [(round(t, 6), round(dof, 3))], "t double, dof double")


@query(f"{TWO_MOMENTS} SELECT round((a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)), 6) AS d FROM a, b")
def cohens_d(spark, d):
    return rows(spark, [(round(tests.cohens_d(*tests.moments(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus").collect()), 6),)], "d double")


ANOVA = f"WITH g AS ({MOMENTS}), s AS (SELECT sum(n * pow(mean - (SELECT avg(o_totalprice) FROM orders), 2)) AS ssb, sum((n - 1) * var) AS ssw, sum(n) AS n, count(*) AS k FROM g)"


@query(f"{ANOVA} SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS f, round(ssb / (ssb + ssw), 9) AS eta_squared FROM s")
def anova_eta(spark, d):
    g = tests.moments(table(spark, d, "orders"), "o_totalprice", "o_orderpriority").collect()
    return rows(spark, [(round(tests.anova_f(g), 6), round(tests.eta_squared(g), 9))], "f double, eta_squared double")


RANKS = "SELECT level, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM ({})"


@query(f"""WITH t AS (SELECT l_returnflag AS level, l_quantity AS v FROM lineitem), r AS ({RANKS.format('SELECT * FROM t')}), g AS (SELECT level, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM t),
k AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM t GROUP BY v))
SELECT round((12 / (n.n * (n.n + 1)) * (SELECT sum(pow(s, 2) / n) FROM g) - 3 * (n.n + 1)) / (1 - k.t / (pow(n.n, 3) - n.n)), 5) AS h, (SELECT count(*) - 1 FROM g) AS dof FROM n, k""")
def kruskal_h(spark, d):
    h, dof = tests.kruskal_h(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return rows(spark, [(round(h, 5), dof)], "h double, dof bigint")


@query(f"WITH t AS ({TWO}), r AS ({RANKS.format('SELECT * FROM t')}), g AS (SELECT level, count(*)::DOUBLE AS n, sum(r) AS s FROM r GROUP BY 1), a AS (SELECT * FROM g ORDER BY level LIMIT 1), b AS (SELECT * FROM g ORDER BY level DESC LIMIT 1) SELECT round(a.s - a.n * (a.n + 1) / 2, 1) AS u, round(2 * (a.s - a.n * (a.n + 1) / 2) / (a.n * b.n) - 1, 6) AS cliffs_delta FROM a, b")
def mann_whitney_u(spark, d):
    u, _, delta = tests.mann_whitney(table(spark, d, "lineitem"), "l_extendedprice", "l_linestatus")
    return rows(spark, [(round(u, 1), round(delta, 6))], "u double, cliffs_delta double")


@query("""WITH p(name, p_value) AS (VALUES ('a', 0.01), ('b', 0.04), ('c', 0.03), ('d', 0.20), ('e', 0.005)), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS k, count(*) OVER () AS n FROM p)
SELECT name, p_value::DOUBLE AS p_value, round(least(min(p_value * n / k) OVER (ORDER BY k DESC), 1), 9)::DOUBLE AS p_adj FROM r""")
def bh_adjust(spark, d):
    return rounded(tests.adjusted(rows(spark, [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.20), ("e", 0.005)], "name string, p_value double")), 9)


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(r, 6) + 0.0 AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 3) + 0.0 AS t FROM (SELECT corr({a}, {b}) AS r, count(*) AS n FROM lineitem)" for a, b in PAIRS))
def correlation_significance(spark, d):
    out = tests.correlation_significance(table(spark, d, "lineitem"), LINE_NUMBERS)
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))
    return out.select("a", "b", (F.round("r", 6) + 0.0).alias("r"), "n", (F.round(t, 3) + 0.0).alias("t"))


@query("SELECT 'l_quantity' AS feature, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 6) FROM lineitem")
def vif(spark, d):
    return rows(spark, [(c, round(v, 6)) for c, v in relations.vif_scores(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])], "feature string, vif double")


@query("SELECT round((1 + abs(r)) / 2, 6) AS first, round((1 - abs(r)) / 2, 6) AS second FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)")
def pca_two(spark, d):
    p = relations.pca_summary(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return rows(spark, [tuple(round(v, 6) for v in p["explained_variance_ratio"])], "first double, second double")


def rank_sql(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}"


@query(f"WITH r AS (SELECT {', '.join(map(rank_sql, LINE_NUMBERS[:3]))} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(r_{a}, r_{b}), 6) AS rho FROM r" for a, b in [p for p in PAIRS if "l_tax" not in p]))
def spearman(spark, d):
    return rounded(relations.spearman_matrix(table(spark, d, "lineitem"), LINE_NUMBERS[:3]))


@query("""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL), m AS (SELECT o, sum(o) OVER (PARTITION BY a) AS ra, sum(o) OVER (PARTITION BY b) AS cb, sum(o) OVER () AS n FROM o),
x AS (SELECT (sum(o * o / (ra * cb / n)) - max(n)) / max(n) AS phi, max(n) AS n, (SELECT count(DISTINCT a) FROM o) AS r, (SELECT count(DISTINCT b) FROM o) AS k FROM m)
SELECT round(sqrt(greatest(0, phi - (k - 1) * (r - 1) / (n - 1)) / greatest(least(k - pow(k - 1, 2) / (n - 1) - 1, r - pow(r - 1, 2) / (n - 1) - 1), 1e-12)), 6) AS v FROM x""")
def cramers_v(spark, d):
    return rows(spark, [(round(relations.cramers_v(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 6),)], "v double")


@query("WITH g AS (SELECT count(*) AS n, avg(o_totalprice) AS m, var_pop(o_totalprice) AS v FROM orders GROUP BY o_orderpriority) SELECT round(sqrt(sum(n * pow(m - (SELECT avg(o_totalprice) FROM orders), 2)) / (sum(n * pow(m - (SELECT avg(o_totalprice) FROM orders), 2)) + sum(n * v))), 6) AS eta FROM g")
def correlation_ratio(spark, d):
    return rows(spark, [(round(relations.correlation_ratio(table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), 6),)], "eta double")


@query("WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round((ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)), 6) AS r FROM r UNION ALL SELECT 'l_quantity', 'l_discount', round((ac - ab * bc) / sqrt((1 - ab * ab) * (1 - bc * bc)), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_discount', round((bc - ab * ac) / sqrt((1 - ab * ab) * (1 - ac * ac)), 6) FROM r")
def partial_correlation(spark, d):
    return rows(spark, [(a, b, round(r, 6)) for a, b, r in relations.partial_correlations(table(spark, d, "lineitem"), LINE_NUMBERS[:3])], "a string, b string, r double")


@query("SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coef, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4), round(regr_r2(l_extendedprice, l_quantity), 6) FROM lineitem")
def ols_simple(spark, d):
    r = models.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rows(spark, [(t[0], round(t[1], 4), round(float(r["r2"]), 6)) for t in r["terms"]], "term string, coef double, r2 double")


@query("SELECT 'l_extendedprice' AS feature, count(*) AS n, round(count(*) / 6.0 * (pow(s, 2) + pow(k, 2) / 4), 4) AS jb FROM (SELECT l_extendedprice, (SELECT sqrt(count(*)) * sum(pow(l_extendedprice - m, 3)) / pow(sum(pow(l_extendedprice - m, 2)), 1.5) FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)) AS s, (SELECT kurtosis_pop(l_extendedprice) FROM lineitem) AS k FROM lineitem) GROUP BY s, k")
def jarque_bera(spark, d):
    r = table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.skewness("l_extendedprice").alias("s"), F.kurtosis("l_extendedprice").alias("k")).first()
    return rows(spark, [("l_extendedprice", r["n"], round(tests.jarque_bera(r["n"], r["s"], r["k"])[0], 4))], "feature string, n bigint, jb double")


# ------------------------------------------------------------------ robust, survey, survival, series

TRIMMED = "SELECT x, row_number() OVER (ORDER BY x) AS p, count(*) OVER () AS n, floor(0.1 * count(*) OVER ()) AS g FROM (SELECT o_totalprice AS x FROM orders)"


@query(f"""WITH t AS ({TRIMMED}), c AS (SELECT max(CASE WHEN p = g + 1 THEN x END) AS lo, max(CASE WHEN p = n - g THEN x END) AS hi FROM t)
SELECT 'o_totalprice' AS feature, round(avg(x), 3) AS arithmetic_mean, round(exp(avg(ln(x))), 3) AS geometric_mean, round(count(*) / sum(1 / x), 3) AS harmonic_mean, round(avg(CASE WHEN p > g AND p <= n - g THEN x END), 3) AS trimmed_mean_10, round(avg(greatest(least(x, hi), lo)), 3) AS winsorized_mean_10, round(median(x), 3) AS median, round(mad(x), 3) AS mad FROM t, c""")
def robust_means(spark, d):
    r = robust.robust_summary(table(spark, d, "orders"), "o_totalprice")
    keys = ["arithmetic_mean", "geometric_mean", "harmonic_mean", "trimmed_mean_10", "winsorized_mean_10", "median", "mad"]
    return rows(spark, [(r["feature"], *(round(r[k], 3) for k in keys))], "feature string, " + ", ".join(f"{k} double" for k in keys))


@query("SELECT 'l_discount' AS \"column\", round(avg(l_discount), 6) AS mean, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS weighted_mean FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(sum(l_quantity * l_tax) / sum(l_quantity), 6) FROM lineitem")
def weighted_mean(spark, d):
    return rounded(robust.weighted_means(table(spark, d, "lineitem"), "l_quantity", ["l_discount", "l_tax"]))


LIKERT = "SELECT (l_quantity % 5)::DOUBLE AS a, ((l_quantity + l_linenumber) % 5)::DOUBLE AS b, (l_linenumber % 5)::DOUBLE AS c FROM lineitem"


@query(f"SELECT count(*) AS n, round(1.5 * (1 - (var_samp(a) + var_samp(b) + var_samp(c)) / var_samp(a + b + c)), 6) AS alpha FROM ({LIKERT})")
def cronbach_alpha(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_quantity % 5 AS a", "(l_quantity + l_linenumber) % 5 AS b", "l_linenumber % 5 AS c")
    r = robust.cronbach_alpha(df, ["a", "b", "c"])
    return rows(spark, [(r["n"], round(r["alpha"], 6))], "n bigint, alpha double")


@query("""WITH t AS (SELECT p_size::DOUBLE AS time, (p_partkey % 3 <> 0)::INTEGER AS e FROM part), c AS (SELECT time, sum(e) AS events, count(*) AS n FROM t GROUP BY 1), r AS (SELECT time, events, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM c)
SELECT time, at_risk::BIGINT AS at_risk, events::BIGINT AS events, round(CASE WHEN bool_or(events = at_risk) OVER w THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END, 6) AS survival FROM r WHERE events > 0 WINDOW w AS (ORDER BY time)""")
def kaplan_meier(spark, d):
    return rounded(robust.kaplan_meier(table(spark, d, "part").withColumn("e", (F.col("p_partkey") % 3 != 0).cast("int")), "p_size", "e"))


@query("WITH g AS (SELECT l_linestatus AS t, count(*)::DOUBLE AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM g ORDER BY t DESC LIMIT 1), b AS (SELECT * FROM g ORDER BY t LIMIT 1) SELECT round(a.m - b.m, 4) AS effect, round(a.m - b.m - 1.96 * sqrt(a.v / a.n + b.v / b.n), 4) AS ci_low, round(a.m - b.m + 1.96 * sqrt(a.v / a.n + b.v / b.n), 4) AS ci_high FROM a, b")
def ab_test(spark, d):
    r = models.causal_analysis(table(spark, d, "lineitem").select("l_linestatus", "l_extendedprice"), "l_linestatus", "l_extendedprice")
    return rows(spark, [(round(r["effect"], 4), round(r["ci_low"], 4), round(r["ci_high"], 4))], "effect double, ci_low double, ci_high double")


GRID = "SELECT date_trunc('hour', ts) AS t, avg(value) AS x FROM events GROUP BY 1"


def hourly(spark, d) -> DataFrame:
    return timeseries.time_grid(table(spark, d, "events"), "ts", ["value"], "hour")


@query(f"SELECT t, round(x, 6) AS value FROM ({GRID})")
def time_grid(spark, d):
    return rounded(hourly(spark, d)).withColumn("t", F.col("t").cast("timestamp_ntz"))


ACF = f"WITH g AS ({GRID}), c AS (SELECT row_number() OVER (ORDER BY t) AS i, x - (SELECT avg(x) FROM g) AS c FROM g), r AS (SELECT k AS lag, sum(a.c * b.c) / (SELECT sum(c * c) FROM c) AS r FROM (SELECT unnest(range(1, 11)) AS k), c a, c b WHERE b.i = a.i + k GROUP BY k)"


@query(f"{ACF} SELECT lag::INTEGER AS lag, round(r, 6) AS r FROM r")
def acf_lags(spark, d):
    return rounded(timeseries.acf(hourly(spark, d), "value", 10))


@query(f"{ACF}, n AS (SELECT count(*)::DOUBLE AS n FROM g) SELECT round(max(n) * (max(n) + 2) * sum(r * r / (n - lag)), 5) AS q FROM r, n")
def ljung_box(spark, d):
    grid = hourly(spark, d)
    return rows(spark, [(round(timeseries.ljung_box(timeseries.acf(grid, "value", 10).collect(), grid.count())[0], 5),)], "q double")


@query(f"WITH g AS ({GRID}) SELECT sum(sign(b.x - a.x))::BIGINT AS s FROM g a, g b WHERE b.t > a.t")
def mann_kendall_s(spark, d):
    _, x = timeseries.bounded_series(hourly(spark, d), ["value"])
    return rows(spark, [(timeseries.mann_kendall(x[:, 0])[0],)], "s bigint")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, count(value) AS value_n, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_std, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY ALL")
def windowed_profile(spark, d):
    out = rounded(streaming.windowed_profile(table(spark, d, "events"), "ts", ["value"]))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


# ------------------------------------------------------------------ SQL pass-through, text, models


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def sql_passthrough(spark, d):
    from quern.sources.readers import read_sql

    for t in ("orders", "customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(t)
    return read_sql(spark, ":memory:", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")


@query("SELECT lang, count(*) AS docs, round(avg(length(text)), 4) AS mean_chars, round(avg(len(string_split_regex(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n]+'))), 4) AS mean_words FROM documents GROUP BY 1")
def text_profile(spark, d):
    words = F.size(F.split(F.regexp_replace("text", r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"[ \t\r\n]+"))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.round(F.avg(words), 4).alias("mean_words"))


@query()
def archetypes(spark, d):
    out = []
    for t in ("orders", "events", "documents", "customer"):
        s = detect_specialization(table(spark, d, t))
        out.append((t, s.primary, s.time_index, s.text_columns, s.id_columns))
    return rows(spark, out, "name string, archetype string, time_index string, text_columns array<string>, id_columns array<string>")


@query()
def normality(spark, d):
    return spark.createDataFrame(tests.normality_tests(table(spark, d, "lineitem"), LINE_NUMBERS[:2]))


@query("SELECT event_id, round((pow(value, 0.5) - 1) / 0.5, 6) AS boxed, round(CASE WHEN value - 50 >= 0 THEN (pow(value - 50 + 1, 0.3) - 1) / 0.3 ELSE -(pow(1 - (value - 50), 1.7) - 1) / 1.7 END, 6) AS yeo FROM events WHERE value > 0")
def power_transform_apply(spark, d):
    df = table(spark, d, "events").where("value > 0").select("event_id", "value", (F.col("value") - 50).alias("moved"))
    out = fit.apply_transforms(df, [fit.TransformSuggestion("value", "box-cox", "boxcox", 0.5, 0.0, 0.0), fit.TransformSuggestion("moved", "yeo-johnson", "yeojohnson", 0.3, 0.0, 0.0)])[0]
    return out.select("event_id", F.round("value__boxcox", 6).alias("boxed"), F.round("moved__yeojohnson", 6).alias("yeo"))


@query()
def power_transforms(spark, d):
    df = table(spark, d, "events").select(F.pow("value", F.lit(2)).alias("v"))
    return rows(spark, [(t.feature, t.method, t.lam, t.skew_before, t.skew_after) for t in fit.suggest_transforms(df, ["v"], 0.1)], "feature string, method string, lam double, skew_before double, skew_after double")


FITS = "SELECT count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v, min(x) AS low, avg(ln(x)) AS ml, var_pop(ln(x)) AS vl FROM (SELECT o_totalprice AS x FROM orders)"


@query(f"""WITH r AS ({FITS}), f AS (SELECT 'norm' AS distribution, 4 + n * (ln(2 * pi() * v) + 1) AS aic FROM r UNION ALL SELECT 'expon', 2 + 2 * n * (ln(m) + 1) FROM r
UNION ALL SELECT 'lognorm', 4 + 2 * n * ml + n * (ln(2 * pi() * vl) + 1) FROM r UNION ALL SELECT 'pareto', 4 - 2 * n * (ln(1 / (ml - ln(low))) + ln(low) / (ml - ln(low)) - (1 / (ml - ln(low)) + 1) * ml) FROM r)
SELECT 'o_totalprice' AS feature, distribution, round(aic, 2) AS aic FROM f""")
def distribution_fits(spark, d):
    """The fits that have a closed form; gamma and Weibull are compared in the tests."""
    r = fit.fit_distributions(table(spark, d, "orders"), "o_totalprice")
    return rows(spark, [(r["feature"], n, round(a, 2)) for n, a in r["candidates"] if n in ("norm", "expon", "lognorm", "pareto")], "feature string, distribution string, aic double")


@query()
def isolation_forest(spark, d):
    return outliers.isolation_scores(table(spark, d, "events").select("event_id", "value", "user_id"), ["value", "user_id"])


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS price FROM part),
n AS (SELECT h.p_partkey, o.price, row_number() OVER (PARTITION BY h.p_partkey ORDER BY abs(h.p_partkey - o.p_partkey), o.p_partkey) AS k FROM t h JOIN t o ON o.price IS NOT NULL AND abs(h.p_partkey - o.p_partkey) < 9 WHERE h.price IS NULL)
SELECT p_partkey::DOUBLE AS p_partkey, round(coalesce(price, (SELECT avg(n.price) FROM n WHERE n.p_partkey = t.p_partkey AND k <= 4)), 6) AS price FROM t""")
def knn_imputation(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").cast("double").alias("p_partkey"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("price"))
    return rounded(impute.knn_fill(df, ["p_partkey", "price"], 4))


@query("""WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_discount) AS mb, var_samp(l_quantity) AS va, var_samp(l_discount) AS vb, covar_samp(l_quantity, l_discount) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round((pow(l_quantity - ma, 2) * vb - 2 * (l_quantity - ma) * (l_discount - mb) * c + pow(l_discount - mb, 2) * va) / (va * vb - c * c), 6) AS mahalanobis_d2 FROM lineitem, s""")
def mahalanobis_distances(spark, d):
    out = multivariate.mahalanobis(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])[0]
    return out.select("l_orderkey", "l_linenumber", F.round("mahalanobis_d2", 6).alias("mahalanobis_d2"))


@query("""WITH g AS (SELECT o_orderpriority, count(*) * covar_pop(a, a) AS aa, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(b, b) AS bb FROM (SELECT o_orderpriority, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders) GROUP BY 1),
w AS (SELECT sum(aa) * sum(bb) - pow(sum(ab), 2) AS d FROM g), t AS (SELECT pow(count(*), 2) * (var_pop(o_totalprice) * var_pop(o_custkey) - pow(covar_pop(o_totalprice, o_custkey), 2)) AS d FROM orders)
SELECT round(w.d / t.d, 7) AS wilks_lambda FROM w, t""")
def wilks_lambda(spark, d):
    return rows(spark, [(round(multivariate.wilks_lambda(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], "o_orderpriority")[0], 7),)], "wilks_lambda double")


@query("""WITH p AS (SELECT p_size AS x, p_retailprice AS y, p_partkey AS k FROM part), n AS (SELECT count(*) * (count(*) - 1) / 2.0 AS pairs FROM p), s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM p a JOIN p b ON a.k > b.k),
t AS (SELECT (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM p GROUP BY x)) AS tx, (SELECT sum(c * (c - 1) / 2.0) FROM (SELECT count(*) AS c FROM p GROUP BY y)) AS ty)
SELECT round(s / sqrt((pairs - tx) * (pairs - ty)), 6) AS tau FROM n, s, t""")
def kendall_tau(spark, d):
    x = table(spark, d, "part").select("p_size", "p_retailprice").toPandas().to_numpy(float)
    return rows(spark, [(round(relations.kendall_tau(x[:, 0], x[:, 1]), 6),)], "tau double")


@query("WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c) SELECT round(sum(n / t * ln(n * t / (na * nb))), 6) AS mi FROM m")
def mutual_information(spark, d):
    return rows(spark, [(round(relations.mutual_information(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), 6),)], "mi double")


BINARY = "SELECT (l_linestatus = 'O')::INTEGER AS y, (l_quantity > 25)::INTEGER AS x FROM lineitem"


@query(f"""WITH c AS (SELECT count(*) FILTER (x = 1 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 1 AND y = 0)::DOUBLE AS b, count(*) FILTER (x = 0 AND y = 1)::DOUBLE AS c, count(*) FILTER (x = 0 AND y = 0)::DOUBLE AS d FROM ({BINARY}))
SELECT 'x' AS term, round(ln(a * d / (b * c)), 6) + 0.0 AS coef, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se FROM c UNION ALL SELECT 'const', round(ln(c / d), 6) + 0.0, round(sqrt(1 / c + 1 / d), 6) FROM c""")
def logit_binary(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    df = spark.sql("SELECT CAST(l_linestatus = 'O' AS INT) AS y, CAST(l_quantity > 25 AS INT) AS x FROM lineitem")
    r = models.logit(df, "y", ["x"])
    return rows(spark, [(n, round(c, 6) + 0.0, round(s, 6)) for n, c, s in zip(("x", "const"), r["coefficients"], r["standard_errors"])], "term string, coef double, se double")


@query(f"""WITH g AS (SELECT count(*) FILTER (x = 1)::DOUBLE AS n, count(*) FILTER (x = 0)::DOUBLE AS m, avg(y) FILTER (x = 1) AS p, avg(y) FILTER (x = 0) AS q FROM ({BINARY}))
SELECT round(p - q, 6) AS effect, round(p - q - 1.96 * sqrt(p * (1 - p) / n + q * (1 - q) / m), 6) AS ci_low, round(p - q + 1.96 * sqrt(p * (1 - p) / n + q * (1 - q) / m), 6) AS ci_high, round(p / q, 6) AS relative_risk FROM g""")
def ab_test_binary(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    df = spark.sql("SELECT CAST(l_linestatus = 'O' AS INT) AS y, CAST(l_quantity > 25 AS INT) AS x FROM lineitem")
    r = models.causal_analysis(df, "x", "y")
    return rows(spark, [tuple(round(r[k], 6) for k in ("effect", "ci_low", "ci_high", "effect_size"))], "effect double, ci_low double, ci_high double, relative_risk double")


def lexicon_sql(words: tuple[str, ...]) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))"


@query(f"WITH t AS (SELECT doc_id, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents), c AS (SELECT doc_id, {lexicon_sql(multivariate.POSITIVE)} AS p, {lexicon_sql(multivariate.NEGATIVE)} AS n FROM t) SELECT doc_id, round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0 END, 6)::DOUBLE AS sentiment FROM c")
def sentiment(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(multivariate.sentiment(F.col("text")).cast("double"), 6).alias("sentiment"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sniffed_csv(spark, d):
    """A table written with a preamble, another separator and encoding, and read back by what is sniffed."""
    import tempfile

    from quern.sources.readers import read_any

    values = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()
    with tempfile.NamedTemporaryFile("w", suffix=".csv", delete=False, encoding="cp1252") as f:
        f.write("# exported table\n# two lines of preamble\nn_nationkey;n_name;n_regionkey\n")
        f.writelines(f"{r[0]};{r[1]};{r[2]}\n" for r in values)
    out = read_any(spark, f.name)[0]
    return out.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("bigint").alias("n_regionkey"))


@query("SELECT 'o_totalprice' AS name, round(lo, 4) AS low, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, round(hi, 4) AS high FROM (SELECT (SELECT min(o_totalprice) FROM orders WHERE o_totalprice >= q1 - 1.5 * (q3 - q1)) AS lo, q1, q2, q3, (SELECT max(o_totalprice) FROM orders WHERE o_totalprice <= q3 + 1.5 * (q3 - q1)) AS hi FROM (SELECT " + f"{nearest_sql('o_totalprice', 'orders', 0.25)} AS q1, (SELECT median(o_totalprice) FROM orders) AS q2, {nearest_sql('o_totalprice', 'orders', 0.75)} AS q3))")
def box_plot(spark, d):
    from quern import reports

    (r,) = reports.box_numbers(table(spark, d, "orders"), ["o_totalprice"])
    return rows(spark, [(r[0], *(round(v, 4) for v in r[1:]))], "name string, low double, q1 double, median double, q3 double, high double")


@query()
def embeddings_geometry(spark, d):
    r = multivariate.embedding_geometry(table(spark, d, "embeddings"), "embedding")
    return rows(spark, [(r["n_docs"], r["dim"], r["pca_2d_variance"], r["best_k"], r["silhouette"])], "n_docs bigint, dim bigint, pca_2d_variance double, best_k bigint, silhouette double")


@query()
def baseline_models(spark, d):
    r = models.run_baseline_models(table(spark, d, "part").select("p_size", "p_brand", "p_type", "p_retailprice"), "p_retailprice")
    return rows(spark, [(m, k, float(v)) for m, s in r["scores"].items() for k, v in s.items()], "model string, metric string, score double")


@query()
def forecast(spark, d):
    r = timeseries.forecast_series(table(spark, d, "events").withColumn("ts", F.date_trunc("hour", "ts")), "ts", ["value"])[0]
    return rows(spark, list(zip(range(1, 13), r["forecast"], r["lower"], r["upper"])), "step bigint, forecast double, lower double, upper double")


BAYES = """WITH m AS (SELECT l_linestatus AS level, count(*)::DOUBLE AS n, avg({c}) AS mean, var_samp({c}) AS v FROM lineitem GROUP BY 1), a AS (SELECT * FROM m ORDER BY level LIMIT 1), b AS (SELECT * FROM m ORDER BY level DESC LIMIT 1),
t AS (SELECT (a.mean - b.mean) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t, a.n * b.n / (a.n + b.n) AS size, a.n + b.n - 2 AS dof FROM a, b),
g AS (SELECT i, -12.0 + i * (37.0 / 4000) AS u FROM (SELECT unnest(range(4001)) AS i)),
f AS (SELECT CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w, exp(-0.5 * ln(1 + size * exp(u) / 2) - (dof + 1) / 2 * ln(1 + t * t / ((1 + size * exp(u) / 2) * dof)) + (dof + 1) / 2 * ln(1 + t * t / dof) - 0.5 * ln(2 * pi()) - 1.5 * u - 1 / (2 * exp(u)) + u) AS y FROM g, t)
SELECT '{c}' AS value, 'l_linestatus' AS "group", round(ln(sum(w * y) * 37.0 / 4000 / 3), 4) AS ln_bf10 FROM f"""


@query(" UNION ALL ".join(f"SELECT * FROM ({BAYES.format(c=c)})" for c in ("l_quantity", "l_extendedprice")))
def bayes_factors(spark, d):
    r = multivariate.bayesian_analysis(table(spark, d, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice"])
    return rows(spark, [(x["value"], x["group"], round(math.log(x["bf10"]), 4)) for x in r], "value string, group string, ln_bf10 double")
