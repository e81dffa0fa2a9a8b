"""The whole run: read, check, standardise, impute, outliers, narrow, profile, analyse, write, report."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field, is_dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from quern import reports
from quern.audit import StepReport, human_bytes, timed
from quern.config import CleanConfig
from quern.functions.columns import of_kind
from quern.operators import fit, models, multivariate, relations, robust, tests, timeseries
from quern.operators.downcast import downcast
from quern.operators.drift import compute_drift
from quern.operators.impact import measure_impact
from quern.operators.impute import impute_missing
from quern.operators.outliers import handle_outliers
from quern.operators.profile import DatasetProfile, profile_dataset
from quern.operators.standardize import standardize
from quern.operators.validate import enforce_contract, load_contract, validate_frame, validate_source
from quern.plans.specialize import detect_specialization
from quern.sources.readers import read_any, write_output


@dataclass
class PipelineResult:
    frame: DataFrame
    profile: DatasetProfile
    step_reports: list[StepReport]
    source: str
    rows_in: int
    rows_out: int
    memory_before: int
    memory_after: int
    elapsed_s: float
    output_path: str | None = None
    report_paths: dict[str, str] = field(default_factory=dict)
    advanced: dict[str, Any] = field(default_factory=dict)
    drift: Any = None

    def summary(self) -> str:
        return f"{self.source}: {self.rows_in} rows in, {self.rows_out} out; {human_bytes(self.memory_before)} to {human_bytes(self.memory_after)}; quality {self.profile.quality_score}; {sum(len(r.warnings) for r in self.step_reports)} warnings; {self.elapsed_s:.1f} s"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes from fewer files than there are cores; larger tables are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def clean(df: DataFrame, config: CleanConfig, impact: bool = True) -> tuple[DataFrame, list[StepReport]]:
    """The cleaning stages with their impact. The result is kept (persisted and computed); what steps were compared
    on is released."""
    kept = [spread(df).persist(StorageLevel.MEMORY_AND_DISK)]
    df, first = standardize(kept[0], config)
    out = [first]
    for step in (impute_missing, handle_outliers):
        kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        before = kept[-1]
        df, report = step(before, config)
        if impact and "_row_id" in df.columns:
            after = df.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(after)
            found = measure_impact(before, after, rows_dropped=report.metrics.get("rows_dropped"))
            report.measure("impact", found)
            for x in found:
                if x.verdict == "material":
                    report.warn(x.describe())
        out.append(report)
    df, last = downcast(df, config)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    for x in kept:
        x.unpersist()
    return df, [*out, last]


def analyse(df: DataFrame, config: CleanConfig) -> dict[str, Any]:
    out: dict[str, Any] = {"normality": tests.normality_tests(df), "transforms": fit.suggest_transforms(df), "vif": relations.vif_scores(df), "pca": relations.pca_summary(df)}
    if config.target and config.target in df.columns:
        out["relevance"] = relations.feature_relevance(df, config.target)
    if not config.auto_specialize:
        return out
    spec = out["specialization"] = detect_specialization(df)
    ids = tuple(spec.id_columns)
    numbers = [c for c in of_kind(df, "numeric", ("is_outlier", "_row_id")) if c not in ids]
    if config.inference:
        out["intervals"] = {c: tests.bootstrap_mean_ci(df, c, seed=config.random_seed) for c in numbers[:30]}
        out["correlations"] = [tuple(r) for r in tests.correlation_significance(df, numbers).collect()]
        if config.target in numbers and len(numbers) > 1:
            out["regression"] = models.ols(df, config.target, [c for c in numbers if c != config.target])
    if config.modeling and config.target:
        out["models"] = models.run_baseline_models(df, config.target, ids, config.random_seed)
    if config.tune and config.target:
        out["tuning"] = models.tune_model(df, config.target, config.tune_trials, ids, config.random_seed)
    if config.treatment and config.outcome:
        out["causal"] = models.causal_analysis(df, config.treatment, config.outcome, ids)
    if spec.time_index and config.fda:
        out["fda"] = timeseries.run_fda(df, spec.time_index, numbers)
    if config.extended_stats:
        out["robust"] = [robust.robust_summary(df, c) for c in numbers[:50]]
        out["distributions"] = [f for c in numbers[:30] if (f := fit.fit_distributions(df, c))]
        out["associations"] = relations.associations(df)
        out["multivariate"] = multivariate.multivariate_analysis(df, relations.varying(df, numbers)) if len(numbers) > 1 else None
        out["survey"] = robust.survey_analysis(df)
        out["nlp"] = multivariate.nlp_analysis(df, spec.text_columns)
        if spec.time_index:
            out["timeseries"] = timeseries.timeseries_analysis(df, spec.time_index, numbers)
            if config.forecast:
                out["forecasts"] = timeseries.forecast_series(df, spec.time_index, numbers, config.forecast_horizon)
    return out


def plain(x: Any) -> Any:
    """x as JSON can hold it."""
    if is_dataclass(x):
        return plain(asdict(x))
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


def run_pipeline(spark: SparkSession, source: str, output: str | None = None, config: CleanConfig | None = None, *, query: str | None = None, table: str | None = None, compare: str | None = None, contract: str | None = None, report_html: str | None = None, report_markdown: str | None = None, title: str | None = None) -> PipelineResult:
    config, began = config or CleanConfig(), time.perf_counter()
    validate_source(source)
    with timed("ingest", config.verbose):
        raw, first = read_any(spark, source, config, query=query, table=table)
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
        rows_in = raw.count()
    for issue in validate_frame(raw.drop("_row_id")).issues:
        first.warn(issue)
    if contract:
        for issue in enforce_contract(raw, load_contract(contract)).issues:
            first.warn(f"contract: {issue}")
    with timed("clean", config.verbose):
        df, steps = clean(raw, config)
    with timed("profile", config.verbose):
        profile = profile_dataset(df.drop("_row_id"), config)
    advanced: dict[str, Any] = {}
    if config.advanced:
        with timed("analyse", config.verbose):
            advanced = analyse(df, config)
            if config.apply_transforms and advanced["transforms"]:
                df, report = fit.apply_transforms(df, advanced["transforms"])
                steps.append(report)
                profile = profile_dataset(df.drop("_row_id"), config)
    narrow = next(r for r in steps if r.step == "downcast")
    result = PipelineResult(df, profile, [first, *steps], source, rows_in, profile.n_rows, narrow.metrics["memory_before"], narrow.metrics["memory_after"], 0.0, advanced=advanced)
    if output:
        result.output_path = write_output(df, output)
        if config.save_model and config.target:
            if bundle := models.train_exportable(df, config.target, seed=config.random_seed):
                result.report_paths["model"] = bundle.save(f"{output}.model")
    if compare:
        other, _ = read_any(spark, compare, config)
        for step in (standardize, impute_missing, downcast):
            other, _ = step(other, config)
        result.drift = compute_drift(df, other)
    result.elapsed_s = time.perf_counter() - began
    name = title or "Data report"
    charts = reports.charts(df, profile, config) if config.make_charts else []
    for path, text in ((report_markdown, lambda: reports.markdown(result, name)), (report_html, lambda: reports.html(result, name, charts))):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text())
            result.report_paths["html" if path == report_html else "markdown"] = path
    if config.make_pdf and (report_html or report_markdown):
        path = f"{report_html or report_markdown}.pdf"
        with open(path, "wb") as f:
            f.write(reports.pdf_report(result, name))
        result.report_paths["pdf"] = path
    if config.make_json and report_markdown:
        path = f"{report_markdown}.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump(plain(reports.results(result, config)), f, indent=2, default=str)
        result.report_paths["json"] = path
    return result
