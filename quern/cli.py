"""Command line: `python -m quern.cli -i data.csv -o clean.parquet`, and `predict` for scoring."""

from __future__ import annotations

import argparse
import logging
import sys

from quern.config import CleanConfig

METHODS = ("iqr", "zscore", "isolation_forest")


def outlier_methods(raw: str) -> tuple[str, ...]:
    names = tuple(x.strip() for x in raw.split(",") if x.strip() and x.strip() != "none")
    if wrong := [n for n in names if n not in METHODS]:
        raise argparse.ArgumentTypeError(f"unknown outlier methods: {', '.join(wrong)}")
    return names


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern")
    for flags in (("-o", "--output"), ("--report-html",), ("--report-md",), ("--query",), ("--table",), ("--sheet",), ("--compare",), ("--contract",), ("--title",), ("--target",), ("--treatment",), ("--outcome",)):
        p.add_argument(*flags)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("--profile", choices=["fast", "standard", "full"], default="full")
    p.add_argument("--impute", choices=["auto", "median", "mean", "knn", "none"], default="auto")
    p.add_argument("--impute-categorical", choices=["mode", "constant", "none"], default="mode")
    p.add_argument("--knn-neighbors", type=int, default=5)
    p.add_argument("--outliers", type=outlier_methods, default=("iqr",))
    p.add_argument("--outlier-action", choices=["flag", "cap", "drop", "none"], default="flag")
    p.add_argument("--iqr-multiplier", type=float, default=1.5)
    p.add_argument("--zscore-threshold", type=float, default=3.0)
    p.add_argument("--categorical-case", choices=["none", "lower", "upper", "title"], default="none")
    p.add_argument("--corr-threshold", type=float, default=0.9)
    p.add_argument("--missing-threshold", type=float, default=0.2)
    p.add_argument("--tune-trials", type=int, default=30)
    p.add_argument("--seed", type=int, default=7)
    for flag in ("no-downcast", "no-parse-dates", "no-charts", "no-png", "no-pdf", "no-json", "no-advanced", "no-inference", "no-modeling", "no-fda", "no-specialize", "no-save-model", "apply-transforms", "tune", "streaming"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


#: flag -> the setting it turns off
OFF = {"no_downcast": "downcast", "no_parse_dates": "parse_datetimes", "no_charts": "make_charts", "no_png": "export_png", "no_pdf": "make_pdf", "no_json": "make_json", "no_advanced": "advanced", "no_inference": "inference", "no_modeling": "modeling", "no_fda": "fda", "no_specialize": "auto_specialize", "no_save_model": "save_model"}


def config_of(a: argparse.Namespace) -> CleanConfig:
    changes = {name: False for flag, name in OFF.items() if getattr(a, flag)}
    return CleanConfig.preset(a.profile).with_overrides(
        impute_numeric=a.impute, impute_categorical=a.impute_categorical, knn_neighbors=a.knn_neighbors, outlier_methods=a.outliers, outlier_action=a.outlier_action,
        iqr_multiplier=a.iqr_multiplier, zscore_threshold=a.zscore_threshold, categorical_case=a.categorical_case, corr_threshold=a.corr_threshold,
        missing_warn_threshold=a.missing_threshold, target=a.target, treatment=a.treatment, outcome=a.outcome, apply_transforms=a.apply_transforms, tune=a.tune,
        tune_trials=a.tune_trials, streaming=a.streaming, random_seed=a.seed, excel_sheet=a.sheet, verbose=not a.quiet, **changes,
    )


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv[:1] == ["predict"]:
        return predict(argv[1:])
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING if a.quiet else logging.INFO)
    try:
        from quern.plans.pipeline import run_pipeline

        result = run_pipeline(session(), a.input, a.output, config_of(a), query=a.query, table=a.table, compare=a.compare, contract=a.contract, report_html=a.report_html, report_markdown=a.report_md, title=a.title)
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return 2
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print(result.summary())
    return 0


def predict(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="quern predict")
    for flags in (("-m", "--model"), ("-i", "--input"), ("-o", "--output")):
        p.add_argument(*flags, required=True)
    a = p.parse_args(argv)
    try:
        from quern.operators.models import Bundle, predict_frame
        from quern.sources.readers import read_any, write_output

        spark = session()
        write_output(predict_frame(Bundle.load(spark, a.model), read_any(spark, a.input)[0]), a.output)
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
