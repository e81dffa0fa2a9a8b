"""Dataset profile: one fused aggregate for each kind of statistic, one tidy row for each column."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.config import CleanConfig
from quern.functions.columns import kind_of, of_kind
from quern.functions.ranges import MANY, value_facts
from quern.operators.downcast import memory_bytes


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    kind: str
    count: int
    nulls: int
    null_pct: float
    n_unique: int
    mean: float | None = None
    std: float | None = None
    minimum: float | None = None
    q25: float | None = None
    median: float | None = None
    q75: float | None = None
    maximum: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    top_value: str | None = None
    top_freq: int | None = None


@dataclass
class DatasetProfile:
    n_rows: int
    n_cols: int
    memory_bytes: int
    duplicate_rows: int
    columns: list[ColumnProfile]
    numeric_columns: list[str]
    corr_labels: list[str] = field(default_factory=list)
    corr_matrix: list[list[float]] = field(default_factory=list)
    cov_matrix: list[list[float]] = field(default_factory=list)
    collinear_pairs: list[tuple[str, str, float]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    quality_score: float = 0.0

    def to_dict(self) -> dict:
        return asdict(self)


PROFILE_SCHEMA = "name string, dtype string, kind string, count bigint, nulls bigint, null_pct double, n_unique bigint, mean double, std double, minimum double, q25 double, median double, q75 double, maximum double, skewness double, kurtosis double, top_value string, top_freq bigint"


def column_profiles(df: DataFrame) -> list[ColumnProfile]:
    """One aggregate for counts and means of all columns, one for sums of powers about the means, one job for each
    type's value counts; all exact.

    Columns of more different values than MANY (about) are ranked by ranges, so that no task holds one's values.
    """
    fields = [f for f in df.schema.fields if f.name != "_row_id"]
    kinds = {f.name: kind_of(f.dataType) for f in fields}
    aggs = [F.count("*").alias("n")]
    for i, f in enumerate(fields):
        c = F.col(f.name)
        # distinct values of other types by their hash
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c if kinds[f.name] != "other" else F.xxhash64(c)).alias(f"u{i}")]
        if kinds[f.name] == "numeric":
            d = c.cast("double")
            aggs += [F.avg(d).alias(f"mean{i}"), F.min(d).alias(f"min{i}"), F.max(d).alias(f"max{i}")]
    row = df.agg(*aggs).first().asDict()
    powers = []
    for i, f in enumerate(fields):
        if row.get(f"mean{i}") is not None:
            d = F.col(f.name).cast("double") - row[f"mean{i}"]
            powers += [F.sum(d * d).alias(f"s2_{i}"), F.sum(d * d * d).alias(f"s3_{i}"), F.sum(d * d * d * d).alias(f"s4_{i}")]
    sums = df.agg(*powers).first().asDict() if powers else {}
    places = {}
    for i, f in enumerate(fields):
        if kinds[f.name] == "numeric" and (m := row[f"n{i}"]):
            places[f.name] = [math.floor(0.25 * (m - 1) + 0.5), (m - 1) // 2, m // 2, math.floor(0.75 * (m - 1) + 0.5)]
    plain = [f.name for f in fields if kinds[f.name] != "other"]
    facts = value_facts(df, plain, places, {f.name for i, f in enumerate(fields) if row[f"u{i}"] > MANY}, top=False)
    others = [f.name for f in fields if kinds[f.name] == "other"]
    if others:
        hashed = value_facts(df.select(*(F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias(c) for c in others)), others, many=set(others))
        facts |= {c: x | {"top": None, "freq": None} for c, x in hashed.items()}
    out, n = [], row["n"]
    for i, f in enumerate(fields):
        x, nulls = facts[f.name], n - row[f"n{i}"]
        p = ColumnProfile(f.name, (f.metadata or {}).get("logical") or f.dataType.simpleString(), kinds[f.name], row[f"n{i}"], nulls, round(100 * nulls / n, 3) if n else 0.0, x["distinct"] + (nulls > 0))
        if f"mean{i}" in row:
            p.mean, p.minimum, p.maximum = (row[f"{k}{i}"] for k in ("mean", "min", "max"))
            m, s2 = row[f"n{i}"], sums.get(f"s2_{i}")
            p.std = math.sqrt(s2 / (m - 1)) if s2 is not None and m > 1 else None
            if s2 and math.isfinite(s2):
                p.skewness, p.kurtosis = sums[f"s3_{i}"] / m / (s2 / m) ** 1.5, sums[f"s4_{i}"] / m / (s2 / m) ** 2 - 3
            if x["at"]:
                p.q25, p.median, p.q75 = float(x["at"][0]), (x["at"][1] + x["at"][2]) / 2, float(x["at"][3])
        elif kinds[f.name] in ("categorical", "boolean") and x["top"] is not None:
            p.top_value, p.top_freq = x["top"], x["freq"]
        out.append(p)
    return out


def profile_frame(df: DataFrame, columns: list[ColumnProfile] | None = None, digits: int = 7) -> DataFrame:
    """The column profiles as a table, a row for each column."""
    rows = []
    for p in columns if columns is not None else column_profiles(df):
        rows.append(tuple(round(float(v), digits) + 0.0 if k in ("mean", "std", "minimum", "q25", "median", "q75", "maximum", "skewness", "kurtosis") and v is not None else v for k, v in asdict(p).items()))
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def duplicate_rows(df: DataFrame) -> int:
    """Rows that have an equal, the first of them included.

    Hashes are counted first, so only rows whose hash occurs more than once are shuffled whole and compared.
    """
    df = df.drop("_row_id")
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    often = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1").select("_hash")
    return hashed.join(often, "_hash", "left_semi").groupBy(*df.columns).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]


#: Beyond so many columns the matrix comes from vectors instead of an aggregate for each pair.
WIDE = 24


def covariances(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray]:
    """(rows, sample covariance matrix) over rows complete in all columns.

    One aggregate for the means and one for the sums of products about them; many columns in one pass over vectors.
    """
    k = len(columns)
    base = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).na.drop()
    if k > WIDE:
        row = base.agg(F.count("*").alias("n"), *(F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(k))).first()
        if row["n"] < 2:
            return row["n"], np.zeros((k, k))
        vectors = VectorAssembler(inputCols=base.columns, outputCol="v").transform(base).select("v")
        sd = np.array([row[f"s{i}"] for i in range(k)])
        return row["n"], np.nan_to_num(Correlation.corr(vectors, "v").first()[0].toArray()) * np.outer(sd, sd)
    first = base.agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(k))).first()
    n = first["n"]
    if n < 2:
        return n, np.zeros((k, k))
    d = [F.col(f"x{i}") - first[f"m{i}"] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = base.agg(*(F.sum(d[i]).alias(f"s{i}") for i in range(k)), *(F.sum(d[i] * d[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((k, k))
    for i, j in pairs:
        out[i, j] = out[j, i] = (row[f"p{i}_{j}"] - row[f"s{i}"] * row[f"s{j}"] / n) / (n - 1)
    return n, out


def correlations(cov: np.ndarray) -> np.ndarray:
    """Pearson's r from covariances; 0 where a column doesn't vary."""
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.outer(sd, sd)
    return np.clip(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0), -1.0, 1.0)


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, listwise: bool = True) -> DataFrame:
    """(a, b, r, cov) of all pairs of numeric columns a < b by position.

    listwise leaves out rows with a null in any of the columns; else each pair uses the rows it has.
    """
    columns = columns or [c for c in of_kind(df, "numeric")]
    pairs = list(combinations(columns, 2))
    schema = "a string, b string, r double, cov double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    if listwise:
        n, cov = covariances(df, columns)
        r = correlations(cov)
        rows = [(a, b, float(r[i, j]), float(cov[i, j]) if n > 1 else None) for (i, a), (j, b) in combinations(enumerate(columns), 2)]
        return df.sparkSession.createDataFrame(rows, schema)
    base = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    wide = base.agg(*(x for i, (a, b) in enumerate(pairs) for x in (F.corr(a, b).alias(f"r{i}"), F.covar_samp(a, b).alias(f"c{i}"))))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(F.nanvl(f"r{i}", F.lit(0.0)), F.lit(0.0)).alias("r"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def health_warnings(p: DatasetProfile, config: CleanConfig) -> list[str]:
    out = []
    for c in p.columns:
        if c.null_pct > 100 * config.missing_warn_threshold:
            out.append(f"{c.name}: {c.null_pct:.1f} % missing")
        if c.n_unique <= 1:
            out.append(f"{c.name}: constant")
        if c.kind == "categorical" and c.n_unique > config.high_cardinality_warn:
            out.append(f"{c.name}: {c.n_unique} levels")
        if c.skewness is not None and abs(c.skewness) > config.skew_warn_threshold:
            out.append(f"{c.name}: skewness {c.skewness:+.2f}")
    out += [f"{a} and {b}: collinear (r {r:+.3f})" for a, b, r in p.collinear_pairs]
    if p.duplicate_rows:
        out.append(f"{p.duplicate_rows} duplicate rows")
    return out


def quality_score(n_rows: int, columns: list[ColumnProfile], duplicates: int, n_warnings: int, outliers: int) -> float:
    cells = n_rows * len(columns)
    complete = 1 - sum(c.nulls for c in columns) / cells if cells else 0.0
    valid = max(0.0, 1 - n_warnings / len(columns)) if columns else 0.0
    unique = 1 - duplicates / n_rows if n_rows else 0.0
    clean = 1 - outliers / n_rows if n_rows else 1.0
    return round(100 * (0.40 * complete + 0.25 * valid + 0.20 * unique + 0.15 * clean), 1)


def profile_dataset(df: DataFrame, config: CleanConfig | None = None) -> DatasetProfile:
    config = config or CleanConfig()
    columns = column_profiles(df)
    numbers = [c.name for c in columns if c.kind == "numeric"]
    n = columns[0].count + columns[0].nulls if columns else df.count()
    p = DatasetProfile(n, len(columns), memory_bytes(df), duplicate_rows(df), columns, numbers)
    if len(numbers) >= 2 and n >= 2:
        _, cov = covariances(df, numbers)
        r = correlations(cov)
        p.corr_labels = numbers
        p.corr_matrix = [[1.0 if i == j else round(float(r[i, j]), 4) for j in range(len(numbers))] for i in range(len(numbers))]
        p.cov_matrix = np.round(cov, 4).tolist()
        p.collinear_pairs = [(a, b, round(float(r[i, j]), 4)) for (i, a), (j, b) in combinations(enumerate(numbers), 2) if abs(r[i, j]) >= config.corr_threshold]
    p.warnings = health_warnings(p, config)
    outliers = df.agg(F.count_if("is_outlier")).first()[0] if "is_outlier" in df.columns else 0
    p.quality_score = quality_score(n, columns, p.duplicate_rows, len(p.warnings), outliers)
    return p


def missingness(df: DataFrame) -> DataFrame:
    """(column, nulls, null_pct), one aggregate unpivoted."""
    wide = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return wide.unpivot("_n", df.columns, "column", "nulls").select("column", "nulls", F.round(100 * F.col("nulls") / F.col("_n"), 3).alias("null_pct"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(value, freq, pct), most frequent first, ties by value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("freq"))
    total = counts.agg(F.sum("freq").alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).select("value", "freq", F.round(100 * F.col("freq") / F.col("_total"), 3).alias("pct")).orderBy(F.desc("freq"), "value")
    return out.limit(top) if top else out


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) over the finite range of a numeric column."""
    ends = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if ends["a"] is None or ends["a"] == ends["b"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n bigint")
    a, step = float(ends["a"]), (float(ends["b"]) - float(ends["a"])) / bins
    at = F.least(F.floor((F.col(column) - a) / step), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(a) + F.col("bin") * step).alias("low"), (F.lit(a) + (F.col("bin") + 1) * step).alias("high"), "n")
