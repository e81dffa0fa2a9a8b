"""What kind of data a table holds, told from names, types and one aggregate."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import of_kind
from quern.operators.impute import ROW_ID, sorted_time_index
from quern.operators.robust import likert_items

TIME_HINTS = ("time", "date", "timestamp", "year", "month", "day", "ts")
LAT_HINTS, LON_HINTS = ("lat", "latitude"), ("lon", "lng", "long", "longitude")
ID_HINTS = ("id", "uuid", "key", "code", "guid")
IMAGE_SUFFIX = r"(?i)\.(png|jpe?g|gif|bmp|tiff?|webp)$"


@dataclass
class Specialization:
    archetypes: list[tuple[str, float]] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)
    auto_modules: list[str] = field(default_factory=list)
    time_index: str | None = None
    geo: dict[str, str] | None = None
    text_columns: list[str] = field(default_factory=list)
    id_columns: list[str] = field(default_factory=list)
    image_columns: list[str] = field(default_factory=list)

    @property
    def primary(self) -> str:
        return self.archetypes[0][0] if self.archetypes else "generic"


def named(column: str, hints: tuple[str, ...]) -> bool:
    """Whether a word of the column's name is a hint; substrings of words don't count."""
    return bool(set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1_\2", column).lower())) & set(hints))


def detect_specialization(df: DataFrame) -> Specialization:
    out = Specialization()
    numbers = of_kind(df, "numeric", ("is_outlier", ROW_ID))
    strings = [f.name for f in df.schema.fields if f.name in of_kind(df, "categorical") and (f.metadata or {}).get("logical") != "Categorical"]
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(numbers):
        aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.count(c).alias(f"c{i}"), F.count_distinct(c).alias(f"d{i}")]
    for i, c in enumerate(strings):
        aggs += [F.avg(F.length(c)).alias(f"l{i}"), F.avg(F.contains(c, F.lit(" ")).cast("int")).alias(f"s{i}"), F.count_distinct(c).alias(f"u{i}"), F.count(c).alias(f"k{i}"), F.avg(F.col(c).rlike(IMAGE_SUFFIX).cast("int")).alias(f"g{i}")]
    row = df.agg(*aggs).first().asDict()
    n = row["n"]
    if not n:
        return Specialization([("generic", 0.6)])
    out.time_index = sorted_time_index(df)
    types = dict(df.dtypes)
    for i, c in enumerate(strings):
        unique = row[f"u{i}"] / row[f"k{i}"] if row[f"k{i}"] else 0.0
        length = row[f"l{i}"] or 0.0
        if length > 40 or (unique > 0.8 and length > 15 and (row[f"s{i}"] or 0) > 0.5):
            out.text_columns.append(c)
        if (row[f"g{i}"] or 0) > 0.5:
            out.image_columns.append(c)
        if row[f"u{i}"] / n > 0.98 and c not in out.text_columns:
            out.id_columns.append(c)
    lat = lon = None
    for i, c in enumerate(numbers):
        a, b, d = row[f"a{i}"], row[f"b{i}"], row[f"d{i}"]
        if a is None:
            continue
        if named(c, LAT_HINTS) and -90 <= a and b <= 90:
            lat = lat or c
        if named(c, LON_HINTS) and -180 <= a and b <= 360:
            lon = lon or c
        whole = types[c] in ("tinyint", "smallint", "int", "bigint")
        if whole and d / n > 0.98 and (named(c, ID_HINTS) or b - a + 1 == d == row[f"c{i}"]):
            out.id_columns.append(c)
    if lat and lon:
        out.geo = {"lat": lat, "lon": lon}
    p = len(numbers)
    found = [
        ("time-series", 0.9 if out.time_index else 0.0),
        ("geospatial", 0.85 if out.geo else 0.0),
        ("high-dimensional", min(0.6 + p / 500, 0.95) if p >= 50 else 0.0),
        ("wide", 0.8 if p > max(1.5 * n, n + 20) else 0.0),
        ("survey", 0.7 if len(likert_items(df)) >= 3 else 0.0),
        ("text", 0.75 if out.text_columns else 0.0),
        ("image", 0.7 if out.image_columns else 0.0),
        ("generic", 0.6),
    ]
    out.archetypes = sorted(((name, c) for name, c in found if c), key=lambda x: -x[1])
    modules = {"time-series": ["timeseries", "forecast", "fda"], "text": ["nlp"], "survey": ["survey"], "geospatial": ["geo"]}
    out.auto_modules = [m for name, _ in out.archetypes for m in modules.get(name, [])]
    out.recommendations = [f"{name} data: {', '.join(modules[name])}" for name, _ in out.archetypes if name in modules]
    return out
