"""Order in two levels: ranges by bounds that are computed once, then the order within each range.

A range is a function of a row's value alone. Both sides of a join on it therefore agree, however often Spark
computes them and however it deals them out; a partition's number wouldn't do, as sampled bounds differ between
two exchanges and small partitions are merged.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges for each shuffle partition.
RANGES = 4
#: A side of at most so many narrow rows may be broadcast.
SMALL = 1_000_000
#: Columns of more different values than this are ranked by ranges, others in one task for each column.
MANY = 2_000_000


def rank_key(c: Column, t: T.DataType) -> Column:
    """A double that never falls where the value rises; values may share one."""
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp").cast("double")
    return c.cast("double")


def ranged(df: DataFrame, column: str, name: str = "_p", values: int | None = None) -> DataFrame:
    """df with the number of the range that the column's value lies in; null's is -1, NaN's the highest.

    values: about how many rows there are, where that is known; up to SMALL one range will do.
    """
    if values is not None and values <= SMALL:
        return df.withColumn(name, F.lit(0))
    n = RANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = rank_key(F.col(column), df.schema[column].dataType)
    known = F.when(~F.isnan(key), key)
    cuts = df.agg(F.percentile_approx(known, [i / n for i in range(1, n)], 100 * n).alias("c")).first()["c"] if n > 1 else None
    splits = [float("-inf"), *sorted({c for c in cuts or [0.0] if abs(c) != float("inf")} or {0.0}), float("inf")]
    out = Bucketizer(splits=splits, inputCol="_x", outputCol="_b", handleInvalid="keep").transform(df.withColumn("_x", key))
    return out.withColumn(name, F.coalesce(F.col("_b").cast("int"), F.lit(-1))).drop("_x", "_b")


def _by_type(df: DataFrame, columns: list[str]) -> dict[str, list[tuple[str, Column]]]:
    """Columns by the type in which their values are counted."""
    out: dict[str, list[tuple[str, Column]]] = {}
    for c in columns:
        t, v = df.schema[c].dataType, F.col(c)
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            kind = "bigint"
        elif isinstance(t, (T.FloatType, T.DoubleType)):
            kind = "double"
        elif isinstance(t, T.DateType):
            kind, v = "bigint", F.unix_date(v)
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            kind, v = "bigint", F.unix_micros(v.cast("timestamp"))
        else:
            kind = "string"
        out.setdefault(kind, []).append((c, v.cast(kind)))
    return out


def value_facts(df: DataFrame, columns: list[str], places: dict[str, list[int]] | None = None, many: set[str] | frozenset = frozenset(), top: bool = True) -> dict[str, dict]:
    """Of each column: distinct (nulls aside), at (the values at the places in sorted order, from 0), top and freq
    (the most frequent value, of equals the smallest; without top only of strings). Exact.

    Values are counted where they are read and then once for each value and column, all columns of a type in one
    job; sorted counts give the places. Columns in `many` are ranked by ranges, so that no task holds one's values.
    """
    places, out = places or {}, {}

    def together(kind: str, some: list[tuple[str, Column]]) -> dict[str, dict]:
        pairs = [x for i, (_, v) in enumerate(some) for x in (F.lit(i), v)]
        counts = df.select(F.stack(F.lit(len(some)), *pairs).alias("i", "v")).where("v IS NOT NULL").groupBy("i", "v").agg(F.count("*").alias("n"))
        most = max((len(places.get(c, ())) for c, _ in some), default=0)
        upto = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumn("c", F.sum("n").over(upto)) if most else counts
        at = lambda j: F.element_at(F.array(*(F.lit((places.get(c) or [])[j] if j < len(places.get(c) or []) else -1).cast("long") for c, _ in some)), F.col("i") + 1)
        best = F.min_by("v", F.struct(-F.col("n"), "v")) if top or kind == "string" else F.lit(None).cast(kind)
        aggs = [F.count("*").alias("distinct"), best.alias("top"), F.max("n").alias("freq"), *(F.min(F.when(F.col("c") > at(j), F.col("v"))).alias(f"q{j}") for j in range(most))]
        rows = ranked.groupBy("i").agg(*aggs).collect()
        return {some[r["i"]][0]: {"distinct": r["distinct"], "top": r["top"], "freq": r["freq"], "at": [r[f"q{j}"] for j in range(len(places.get(some[r["i"]][0], ())))]} for r in rows}

    def alone(c: str, v: Column) -> dict[str, dict]:
        counts = df.select(v.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        row = counts.agg(F.count("*").alias("distinct"), F.min_by("v", F.struct(-F.col("n"), "v")).alias("top"), F.max("n").alias("freq")).first()
        return {c: row.asDict() | {"at": _at_places(counts, places[c]) if places.get(c) else []}}

    jobs = [lambda kind=kind, some=some: together(kind, some) for kind, some in _by_type(df, [c for c in columns if c not in many]).items()]
    jobs += [lambda c=c, v=v: alone(c, v) for some in _by_type(df, [c for c in columns if c in many]).values() for c, v in some]
    # few jobs of few tasks at their ends, so they are run side by side
    with ThreadPoolExecutor(max_workers=4) as pool:
        for found in pool.map(lambda job: job(), jobs):
            out |= found
    for c in columns:
        out.setdefault(c, {"distinct": 0, "top": None, "freq": None, "at": [None] * len(places.get(c, ()))})
    return out


def _at_places(counts: DataFrame, places: list[int]) -> list:
    """The values at places of sorted (v, n): ranges' sums go to the driver, and only ranges that hold a place are sorted."""
    cut = ranged(counts, "v")
    sums = sorted(tuple(r) for r in cut.groupBy("_p").agg(F.sum("n").alias("n")).collect())
    before, of = 0, {}
    for p, n in sums:
        of.update({k: (p, before) for k in places if before <= k < before + n})
        before += n
    upto = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = cut.where(F.col("_p").isin([p for p, _ in of.values()])).withColumn("c", F.sum("n").over(upto))
    row = held.agg(*(F.min(F.when((F.col("_p") == of[k][0]) & (F.col("c") > k - of[k][1]), F.col("v"))).alias(f"q{j}") for j, k in enumerate(places))).first()
    return list(row)


def crowded_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """The columns that have about more than MANY different values; one cheap aggregate."""
    if not columns:
        return set()
    row = df.agg(*(F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(columns))).first()
    return {c for i, c in enumerate(columns) if row[f"d{i}"] > MANY}
