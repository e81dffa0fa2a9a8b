"""Settings of a run. Names and defaults are fixed values shared with existing configuration files."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Any


@dataclass(frozen=True, slots=True)
class CleanConfig:
    # ingestion
    detection_sample_rows: int = 4096
    csv_null_values: tuple[str, ...] = ("", "na", "n/a", "nan", "null", "none", "nil", "-", "?", "#n/a", "***")
    excel_sheet: str | None = None
    # narrowing
    downcast: bool = True
    downcast_floats: bool = True
    float32_rel_tolerance: float = 1e-6
    # imputation
    impute_numeric: str = "auto"  # auto, median, mean, knn, none
    impute_categorical: str = "mode"  # mode, constant, none
    categorical_fill_value: str = "Unknown"
    skew_threshold: float = 1.0
    detect_timeseries: bool = True
    knn_neighbors: int = 5
    knn_max_rows: int = 20_000
    # outliers
    outlier_methods: tuple[str, ...] = ("iqr",)  # iqr, zscore, isolation_forest
    outlier_action: str = "flag"  # flag, cap, drop, none
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    iforest_contamination: float | str = "auto"
    # standardisation
    strip_whitespace: bool = True
    parse_datetimes: bool = True
    datetime_parse_min_success: float = 0.8
    standardize_categoricals: bool = True
    categorical_case: str = "none"  # none, lower, upper, title
    parse_numeric_strings: bool = True
    numeric_string_min_success: float = 0.9
    # profile
    missing_warn_threshold: float = 0.2
    corr_threshold: float = 0.9
    high_cardinality_warn: int = 50
    skew_warn_threshold: float = 2.0
    # outputs
    make_charts: bool = True
    export_png: bool = True
    make_pdf: bool = True
    make_json: bool = True
    save_model: bool = True
    chart_max_numeric: int = 12
    chart_max_scatter_cols: int = 6
    chart_scatter_sample: int = 5000
    chart_top_categories: int = 15
    # analyses
    advanced: bool = True
    target: str | None = None
    apply_transforms: bool = False
    vif_warn: float = 10.0
    auto_specialize: bool = True
    inference: bool = True
    modeling: bool = True
    fda: bool = True
    extended_stats: bool = True
    forecast: bool = True
    forecast_horizon: int = 12
    tune: bool = False
    tune_trials: int = 30
    treatment: str | None = None
    outcome: str | None = None
    use_transformer_embeddings: bool = False
    embedding_model: str = "all-MiniLM-L6-v2"
    streaming: bool = False
    random_seed: int = 7
    verbose: bool = True

    @classmethod
    def preset(cls, profile: str) -> CleanConfig:
        off = {
            "fast": ("advanced", "inference", "modeling", "fda", "extended_stats", "forecast", "auto_specialize", "make_charts", "export_png", "make_pdf"),
            "standard": ("extended_stats", "forecast", "fda"),
            "full": (),
        }
        if profile not in off:
            raise ValueError(f"unknown profile {profile!r}: choose fast, standard or full")
        return cls(**dict.fromkeys(off[profile], False))

    def with_overrides(self, **changes: Any) -> CleanConfig:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
