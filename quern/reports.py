"""Markdown, HTML and JSON reports of a run, with small inline SVG charts; nothing is fetched from elsewhere."""

from __future__ import annotations

import hashlib
import importlib.metadata
import os
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import medians, nearest_quantiles
from quern.operators.profile import DatasetProfile, histogram, value_counts
from quern.pdf import pdf, table_lines

COLUMNS = ("name", "dtype", "kind", "count", "nulls", "null_pct", "n_unique", "mean", "std", "minimum", "median", "maximum", "skewness")


def shown(v) -> str:
    return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)


def headlines(result) -> list[str]:
    """Score, first warnings, impact, outliers and normality, at most seven."""
    score = result.profile.quality_score
    out = [f"{'🟢' if score >= 85 else '🟡' if score >= 60 else '🔴'} quality score {score}/100"]
    out += [f"⚠ {w}" for w in result.profile.warnings[:3]]
    material = [x.describe() for r in result.step_reports for x in r.metrics.get("impact", []) if x.verdict == "material"]
    out += material[:2] or ["🟢 no cleaning step moved a column materially"]
    rows = next((r.metrics["outlier_rows"] for r in result.step_reports if "outlier_rows" in r.metrics), 0)
    if rows:
        out.append(f"{rows} rows hold outliers")
    odd = [r for r in result.advanced.get("normality", []) if not r["is_normal"]]
    if odd:
        out.append(f"{len(odd)} numeric columns are not normal")
    return out[:7]


def sections(result) -> list[tuple[str, list[str], list[list]]]:
    """(title, header, rows) of every table of the report."""
    p, a = result.profile, result.advanced
    out = [("Columns", list(COLUMNS), [[getattr(c, k) for k in COLUMNS] for c in p.columns])]
    if p.collinear_pairs:
        out.append(("Collinear pairs", ["a", "b", "r"], [list(x) for x in p.collinear_pairs]))
    impact = [[r.step, x.column, x.cells_changed, x.change_share, x.mean_shift_sd, x.ks_stat, x.verdict] for r in result.step_reports for x in r.metrics.get("impact", [])]
    if impact:
        out.append(("Cleaning impact", ["step", "column", "cells", "share", "shift (sd)", "KS", "verdict"], impact))
    if a.get("normality"):
        keys = list(a["normality"][0])
        out.append(("Normality", keys, [[r[k] for k in keys] for r in a["normality"]]))
    if a.get("transforms"):
        out.append(("Transforms", ["feature", "method", "lambda", "before", "after"], [[t.feature, t.method, t.lam, t.skew_before, t.skew_after] for t in a["transforms"]]))
    if a.get("vif"):
        out.append(("Variance inflation", ["feature", "VIF"], [list(x) for x in a["vif"]]))
    if a.get("pca"):
        out.append(("Principal components", ["component", "share", "cumulative"], [[i + 1, r, c] for i, (r, c) in enumerate(zip(a["pca"]["explained_variance_ratio"], a["pca"]["cumulative"]))]))
    for key in ("relevance", "robust", "distributions", "timeseries", "forecasts", "nlp"):
        rows = [r for r in a.get(key) or [] if r]
        if rows:
            keys = list(rows[0])
            out.append((key.capitalize(), keys, [[r.get(k) for k in keys] for r in rows[:30]]))
    for key in ("models", "regression", "causal", "tuning", "fda", "multivariate", "survey"):
        if a.get(key):
            out.append((key.capitalize(), ["item", "value"], [[k, v] for k, v in a[key].items()]))
    if result.drift:
        out.append(("Drift", ["feature", "kind", "PSI", "test", "p", "level"], [[r.feature, r.kind, r.psi, r.test, r.p_value, r.level] for r in result.drift.results]))
    return out


def tests_run(advanced: dict) -> int:
    """How many hypotheses the run tested by itself."""
    n = sum(sum(r.get(k) is not None for k in ("shapiro_p", "dagostino_p", "jarque_bera_p")) for r in advanced.get("normality") or [])
    n += len(advanced.get("correlations") or []) + sum(r.get("p_value") is not None for r in advanced.get("relevance") or [])
    n += sum(sum(r.get(k) is not None for k in ("adf_p", "kpss_p", "mk_p", "ljung_box_p")) for r in advanced.get("timeseries") or [])
    return n + len((advanced.get("regression") or {}).get("terms", [])) + bool((advanced.get("causal") or {}).get("p_value") is not None)


#: From so many tests on a report says that some are significant by chance.
MANY_TESTS = 10


def hygiene(advanced: dict) -> list[str]:
    n = tests_run(advanced)
    return [f"{n} hypotheses were tested automatically; at the 5 % level about {n * 0.05:.0f} would be significant by chance, so single ones are leads rather than findings"] if n >= MANY_TESTS else []


def pdf_report(result, title: str) -> bytes:
    """Summary, steps, highlights of the analyses and tables (at most 40 rows each), as PDF."""
    blocks = [("title", [title]), ("text", [result.summary(), *(f"- {h}" for h in headlines(result)), *hygiene(result.advanced)])]
    for r in result.step_reports:
        blocks += [("heading", [r.step]), ("text", [f"- {x}" for x in [*r.actions, *(f"! {w}" for w in r.warnings)]])]
    for name, header, rows in sections(result):
        blocks += [("heading", [name]), ("table", table_lines([str(h) for h in header], [[shown(v) for v in row] for row in rows[:40]]))]
    return pdf(blocks)


def markdown(result, title: str) -> str:
    lines = [f"# {title}", "", result.summary(), "", "## Summary", "", *(f"- {h}" for h in headlines(result)), *(f"- ⚠ {h}" for h in hygiene(result.advanced)), "", "## Steps", ""]
    for r in result.step_reports:
        lines += [f"### {r.step}", "", *(f"- {x}" for x in r.actions), *(f"- ⚠ {x}" for x in r.warnings), ""]
    for name, header, rows in sections(result):
        lines += [f"## {name}", "", "| " + " | ".join(header) + " |", "|" + "---|" * len(header), *("| " + " | ".join(shown(v).replace("|", "\\|") for v in row) + " |" for row in rows), ""]
    return "\n".join(lines)


def html(result, title: str, charts: list[tuple[str, str]] = ()) -> str:
    body = [f"<h1>{escape(title)}</h1><p>{escape(result.summary())}</p><ul>", *(f"<li>{escape(h)}</li>" for h in [*headlines(result), *hygiene(result.advanced)]), "</ul>"]
    for r in result.step_reports:
        body.append(f"<h2>{escape(r.step)}</h2><ul>" + "".join(f"<li>{escape(x)}</li>" for x in [*r.actions, *(f"⚠ {w}" for w in r.warnings)]) + "</ul>")
    for name, header, rows in sections(result):
        head = "".join(f"<th>{escape(h)}</th>" for h in header)
        cells = "".join("<tr>" + "".join(f"<td>{escape(shown(v))}</td>" for v in row) + "</tr>" for row in rows)
        body.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{cells}</table>")
    body += [f"<h3>{escape(name)}</h3>{svg}" for name, svg in charts]
    style = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;font-size:90%}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style></head><body>{''.join(body)}</body></html>"


def bars(labels: list[str], values: list[float], width: int = 480) -> str:
    top = max([*values, 1e-12])
    rows = "".join(f"<text x='0' y='{16 * i + 12}' font-size='11'>{escape(str(label)[:24])}</text><rect x='160' y='{16 * i + 2}' width='{(width - 220) * v / top:.1f}' height='12' fill='#4878a8'/><text x='{165 + (width - 220) * v / top:.1f}' y='{16 * i + 12}' font-size='11'>{shown(float(v))}</text>" for i, (label, v) in enumerate(zip(labels, values)))
    return f"<svg width='{width}' height='{16 * len(labels) + 8}' role='img'>{rows}</svg>"


def box_numbers(df: DataFrame, columns: list[str]) -> list[tuple]:
    """(name, low whisker, q1, median, q3, high whisker); whiskers end at the outermost values within 1.5 boxes."""
    quartiles, middle = nearest_quantiles(df, columns, (0.25, 0.75)), medians(df, columns)
    some = [c for c in columns if quartiles[c][0] is not None]
    if not some:
        return []
    reach = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])) for c, q in quartiles.items() if c in some}
    row = df.agg(*(x for i, c in enumerate(some) for x in (F.min(F.when(F.col(c) >= reach[c][0], F.col(c))).alias(f"a{i}"), F.max(F.when(F.col(c) <= reach[c][1], F.col(c))).alias(f"b{i}")))).first()
    return [(c, float(row[f"a{i}"]), float(quartiles[c][0]), float(middle[c]), float(quartiles[c][1]), float(row[f"b{i}"])) for i, c in enumerate(some)]


def boxes(numbers: list[tuple], width: int = 480) -> str:
    """A box for each column, each on its own scale."""
    out = []
    for i, (name, low, q1, mid, q3, high) in enumerate(numbers):
        x = lambda v: 160 + (width - 180) * ((v - low) / (high - low) if high > low else 0.5)  # noqa: E731, B023
        y = 22 * i
        out.append(f"<text x='0' y='{y + 15}' font-size='11'>{escape(name[:24])}</text><line x1='{x(low):.1f}' x2='{x(high):.1f}' y1='{y + 11}' y2='{y + 11}' stroke='#444'/><rect x='{x(q1):.1f}' y='{y + 3}' width='{max(x(q3) - x(q1), 1):.1f}' height='16' fill='#a8c4e0' stroke='#444'/><line x1='{x(mid):.1f}' x2='{x(mid):.1f}' y1='{y + 3}' y2='{y + 19}' stroke='#a33' stroke-width='2'/>")
    return f"<svg width='{width}' height='{22 * len(numbers) + 6}' role='img'>{''.join(out)}</svg>"


def heatmap(labels: list[str], matrix: list[list[float]], cell: int = 34) -> str:
    """A square for each pair, blue for negative and red for positive correlations."""
    out = [f"<text x='0' y='{cell * (i + 1) + 22}' font-size='11'>{escape(n[:18])}</text><text x='{130 + cell * i}' y='12' font-size='9'>{escape(n[:6])}</text>" for i, n in enumerate(labels)]
    for i, row in enumerate(matrix):
        for j, r in enumerate(row):
            pale = int(255 * (1 - min(abs(r), 1.0)))
            colour = f"rgb(255,{pale},{pale})" if r >= 0 else f"rgb({pale},{pale},255)"
            out.append(f"<rect x='{130 + cell * j}' y='{cell * (i + 1) - 16}' width='{cell - 1}' height='{cell - 1}' fill='{colour}'/><text x='{134 + cell * j}' y='{cell * (i + 1) + 5}' font-size='9'>{r:.2f}</text>")
    side = 140 + cell * len(labels)
    return f"<svg width='{side}' height='{cell * (len(labels) + 1)}' role='img'>{''.join(out)}</svg>"


def scatter_matrix(df: DataFrame, columns: list[str], most: int, side: int = 110) -> str:
    """Each pair of columns on a sample of at most `most` rows, those with the smallest hash of their values."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop().orderBy(F.xxhash64(*columns), *columns).limit(most).collect()
    if not rows:
        return ""
    ends = [(min(r[i] for r in rows), max(r[i] for r in rows)) for i in range(len(columns))]
    at = lambda v, i: 4 + (side - 8) * ((v - ends[i][0]) / (ends[i][1] - ends[i][0]) if ends[i][1] > ends[i][0] else 0.5)
    out = []
    for i, a in enumerate(columns):
        for j, _ in enumerate(columns):
            x, y = side * j, side * i
            dots = f"<text x='{x + 6}' y='{y + side // 2}' font-size='10'>{escape(a[:16])}</text>" if i == j else "".join(f"<circle cx='{x + at(r[j], j):.1f}' cy='{y + side - at(r[i], i):.1f}' r='1' fill='#4878a8' fill-opacity='0.5'/>" for r in rows)
            out.append(f"<rect x='{x}' y='{y}' width='{side}' height='{side}' fill='none' stroke='#ccc'/>{dots}")
    return f"<svg width='{side * len(columns)}' height='{side * len(columns)}' role='img'>{''.join(out)}</svg>"


def charts(df: DataFrame, profile: DatasetProfile, config) -> list[tuple[str, str]]:
    """Missingness, histograms, boxes, frequencies, correlations and a scatter matrix; only aggregates and one
    bounded sample reach the driver."""
    out = []
    gaps = [(c.name, c.null_pct) for c in profile.columns if c.nulls]
    if gaps:
        out.append(("Missing values (%)", bars([g[0] for g in gaps], [g[1] for g in gaps])))
    numbers = [c.name for c in profile.columns if c.kind == "numeric" and c.n_unique > 1][: config.chart_max_numeric]
    for c in numbers:
        rows = histogram(df, c).orderBy("bin").collect()
        out.append((c, bars([f"{r['low']:.4g}" for r in rows], [r["n"] for r in rows])))
    if numbers:
        out.append(("Box plots", boxes(box_numbers(df, numbers))))
    for c in [c for c in profile.columns if c.kind == "categorical" and c.n_unique <= 50]:
        rows = value_counts(df, c.name, config.chart_top_categories).collect()
        out.append((f"{c.name}", bars([r["value"] for r in rows], [r["freq"] for r in rows])))
    if len(profile.corr_labels) > 1:
        out.append(("Correlations", heatmap(profile.corr_labels, profile.corr_matrix)))
    if len(numbers) > 1:
        out.append(("Scatter matrix", scatter_matrix(df, numbers[: config.chart_max_scatter_cols], config.chart_scatter_sample)))
    return out


def dataset_hash(source: str, most: int = 64 << 20) -> str | None:
    """SHA-256 of a local file's first 64 MB."""
    if not os.path.isfile(source):
        return None
    with open(source, "rb") as f:
        return hashlib.sha256(f.read(most)).hexdigest()


def results(result, config) -> dict:
    versions = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            continue
    return {"manifest": {"source": result.source, "sha256": dataset_hash(result.source), "versions": versions, "config": config.to_dict()}, "summary": {"rows_in": result.rows_in, "rows_out": result.rows_out, "memory_before": result.memory_before, "memory_after": result.memory_after, "elapsed_s": result.elapsed_s, "quality_score": result.profile.quality_score}, "columns": result.profile.columns, "steps": result.step_reports, "advanced": result.advanced, "drift": result.drift}
