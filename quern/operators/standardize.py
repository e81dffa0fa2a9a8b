"""Standardisation of strings: white space, numbers, dates, case. One pass of statistics, one projection for each rule."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.audit import StepReport
from quern.config import CleanConfig
from quern.functions.columns import of_kind

#: What counts as a number in a string: sign, currency, digits with thousands separators, fraction, exponent, percent.
NUMBER = r"^\s*[-+]?\s*[$€£]?\s*[-+]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)?(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?\s*%?\s*$"
HAS_DIGIT = "[0-9]"
#: What hints at a date in a string.
DATE_HINT = r"[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}|[0-9]{4}[0-9]{2}[0-9]{2}|[0-9]{1,2} [A-Za-z]{3} [0-9]{4}|[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}"
DATE_HINT_SHARE = 0.6
#: (pattern, has a time), tried in this order.
DATE_FORMATS = [
    ("yyyy-MM-dd HH:mm:ss", True),
    ("yyyy-MM-dd'T'HH:mm:ss", True),
    ("yyyy-MM-dd", False),
    ("yyyy/MM/dd", False),
    ("dd/MM/yyyy", False),
    ("MM/dd/yyyy", False),
    ("dd-MM-yyyy", False),
    ("dd.MM.yyyy", False),
    ("dd MMM yyyy", False),
    ("MMM dd, yyyy", False),
    ("yyyyMMdd", False),
]


def tidy_space(c: Column) -> Column:
    """Outer white space gone, inner runs one space, nothing left null."""
    out = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.when(F.length(out) > 0, out)


def parse_number(c: Column) -> Column:
    """The number in a string such as `$1,200.50` or `45%`, else null."""
    bare = F.regexp_replace(c, r"[,$€£%\s]", "").try_cast("double")
    return F.when(c.contains("%"), bare / 100).otherwise(bare)


#: What each letter group of a date pattern stands for.
DATE_FIELDS = [("yyyy", "[0-9]{4}"), ("MMM", "[A-Za-z]{3}"), ("MM", "[0-9]{2}"), ("dd", "[0-9]{2}"), ("HH", "[0-9]{2}"), ("mm", "[0-9]{2}"), ("ss", "[0-9]{2}"), ("'T'", "T"), (".", "[.]")]


def date_shape(pattern: str) -> str:
    """A regular expression that every string of the pattern matches."""
    return "^" + re.sub("|".join(re.escape(f) for f, _ in DATE_FIELDS), lambda m: dict(DATE_FIELDS)[m.group()], pattern) + "$"


def parse_date(c: Column, pattern: str) -> Column:
    """A timestamp without zone, null where the pattern doesn't fit. Only strings of its shape are parsed, as a
    failed parse costs an exception."""
    return F.when(c.rlike(date_shape(pattern)), F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz"))


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0)), lambda w: F.initcap(w)), "")


def fix_case(c: Column, case: str) -> Column:
    return {"lower": F.lower, "upper": F.upper, "title": title_case}.get(case, lambda x: x)(c)


def standardize(df: DataFrame, config: CleanConfig | None = None) -> tuple[DataFrame, StepReport]:
    config, report = config or CleanConfig(), StepReport("standardize")
    strings = of_kind(df, "categorical")
    if config.strip_whitespace and strings:
        df = df.withColumns({c: tidy_space(F.col(c)) for c in strings})
        report.act(f"white space tidied in {len(strings)} text columns")
    if strings and (config.parse_numeric_strings or config.parse_datetimes):
        aggs = []
        for i, c in enumerate(strings):
            col = F.col(c)
            aggs += [F.count(col).alias(f"n{i}"), F.count_if(col.rlike(NUMBER) & col.rlike(HAS_DIGIT)).alias(f"num{i}"), F.count_if(col.rlike(DATE_HINT)).alias(f"hint{i}")]
        seen, dated = df.agg(*aggs).first(), []
        changes: dict[str, Column] = {}
        for i, c in enumerate(strings):
            n = seen[f"n{i}"]
            if n and config.parse_numeric_strings and seen[f"num{i}"] / n >= config.numeric_string_min_success:
                changes[c] = parse_number(F.col(c))
                report.act(f"{c}: read as numbers")
            elif n and config.parse_datetimes and seen[f"hint{i}"] / n >= DATE_HINT_SHARE:
                dated.append((i, c))
        if dated:  # failed parses are dear, so only columns that look like dates are tried
            fits = df.agg(*(F.count(parse_date(F.col(c), p)).alias(f"d{i}_{j}") for i, c in dated for j, (p, _) in enumerate(DATE_FORMATS))).first()
            for i, c in dated:
                good = [j for j in range(len(DATE_FORMATS)) if fits[f"d{i}_{j}"] / seen[f"n{i}"] >= config.datetime_parse_min_success]
                if good:
                    pattern, has_time = DATE_FORMATS[good[0]]
                    when = parse_date(F.col(c), pattern)
                    changes[c] = when if has_time else when.cast("date")
                    report.act(f"{c}: read as dates ({pattern})")
        if changes:
            df = df.withColumns(changes)
    strings = of_kind(df, "categorical")
    if config.standardize_categoricals and config.categorical_case != "none" and strings:
        df = df.withColumns({c: fix_case(F.col(c), config.categorical_case) for c in strings})
        report.act(f"{config.categorical_case} case in {len(strings)} text columns")
    return df, report
