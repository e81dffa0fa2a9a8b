"""Regression, baseline models, an exportable bundle, tuning and causal contrasts, on Spark ML and aggregates."""

from __future__ import annotations

import json
import math
import os
import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.columns import distinct_counts, finite, of_kind
from quern.functions.special import normal_two_sided, t_two_sided
from quern.operators.relations import infer_task
from quern.operators.tests import cohens_d, welch_t

LEVELS = 50
LEAKAGE = 0.98


def feature_columns(df: DataFrame, target: str, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numbers, categories with at most 50 levels)."""
    skip = {target, "is_outlier", "_row_id", *exclude}
    strings = [c for c in of_kind(df, "categorical") if c not in skip]
    levels = distinct_counts(df, strings)
    return [c for c in of_kind(df, "numeric") if c not in skip], [c for c in strings if 1 < levels[c] <= LEVELS]


def encoder_stages(numbers: list[str], cats: list[str]) -> list:
    stages = []
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"{c}__f" for c in numbers], strategy="median"))
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cats]
    return [*stages, VectorAssembler(inputCols=[f"{c}__f" for c in numbers] + [f"{c}__i" for c in cats], outputCol="features")]


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns}) if columns else df


def ols(df: DataFrame, target: str, features: list[str]) -> dict | None:
    """Least squares from the Gram matrix, which one aggregate gives: coefficients, errors, p, intervals, R2."""
    names = ["1", *features]
    base = df.select(F.lit(1.0).alias("x0"), *(finite(F.col(c)).alias(f"x{i + 1}") for i, c in enumerate(features)), finite(F.col(target)).alias("y")).na.drop()
    k = len(names)
    row = base.agg(F.count("*").alias("n"), F.sum(F.col("y") ** 2).alias("yy"), F.sum("y").alias("sy"), *(F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k))).first()
    n = row["n"]
    if k >= n:
        return None
    g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([row[f"b{i}"] for i in range(k)])
    inverse = np.linalg.pinv(g)
    beta = inverse @ b
    rss = max(float(row["yy"] - beta @ b), 0.0)
    tss = row["yy"] - row["sy"] ** 2 / n
    se = np.sqrt(np.maximum(np.diag(inverse) * rss / (n - k), 0))
    terms = [(name, c, s, t_two_sided(c / s, n - k) if s else 0.0, c - 1.96 * s, c + 1.96 * s) for name, c, s in zip(("const", *features), beta.tolist(), se.tolist())]
    return {"kind": "OLS", "target": target, "n": n, "r2": float(1 - rss / tss) if tss else None, "terms": terms}


def logit(df: DataFrame, target: str, features: list[str]) -> dict | None:
    """Logistic regression of the target's second level; coefficients, errors and p-values of the features, then of the constant."""
    levels = [r[0] for r in df.select(F.col(target).cast("string")).where(F.col(target).isNotNull()).distinct().orderBy(target).limit(3).collect()]
    if len(levels) != 2:
        return None
    x = VectorAssembler(inputCols=features, outputCol="features").transform(as_doubles(df, features).withColumn("label", (F.col(target).cast("string") == levels[1]).cast("double")).na.drop(subset=[*features, target]))
    model = GeneralizedLinearRegression(family="binomial", maxIter=50).fit(x.select("features", "label"))
    s = model.summary
    m = s.deviance, s.nullDeviance
    return {"kind": "Logit", "target": target, "n": s.numInstances, "r2": 1 - m[0] / m[1] if m[1] else None, "coefficients": [*model.coefficients.toArray().tolist(), model.intercept], "p_values": list(s.pValues), "standard_errors": list(s.coefficientStandardErrors)}


def run_baseline_models(df: DataFrame, target: str, exclude: tuple[str, ...] = (), seed: int = 7, folds: int = 3) -> dict | None:
    """Cross-validated dummy, linear and forest models; folds by a hash of the row, so that reruns agree."""
    task = infer_task(df, target)
    numbers, cats = feature_columns(df, target, exclude)
    if not numbers and not cats:
        return None
    data = as_doubles(df.where(F.col(target).isNotNull()), numbers)
    if task == "classification":
        label = StringIndexer(inputCol="_t", outputCol="label", stringOrderType="alphabetAsc").fit(data.withColumn("_t", F.col(target).cast("string")))
        data = label.transform(data.withColumn("_t", F.col(target).cast("string")))
        if len(label.labels) < 2:
            return None
        models = {"LogisticRegression": LogisticRegression(maxIter=50), "RandomForest": RandomForestClassifier(numTrees=50, seed=seed, maxBins=64)}
        metrics = {"Acc": MulticlassClassificationEvaluator(metricName="accuracy"), "F1": MulticlassClassificationEvaluator(metricName="f1")}
    else:
        data = data.withColumn("label", F.col(target).cast("double"))
        models = {"LinearRegression": LinearRegression(solver="normal"), "RandomForest": RandomForestRegressor(numTrees=50, seed=seed, maxBins=64), "GradientBoosting": GBTRegressor(maxIter=20, seed=seed, maxBins=64)}
        metrics = {"R2": RegressionEvaluator(metricName="r2"), "RMSE": RegressionEvaluator(metricName="rmse"), "MAE": RegressionEvaluator(metricName="mae")}
    x = Pipeline(stages=encoder_stages(numbers, cats)).fit(data).transform(data)
    x = x.select("features", "label", F.pmod(F.xxhash64("features", "label", F.lit(seed)), F.lit(folds)).alias("_fold")).cache()
    n = x.count()
    scores: dict[str, dict[str, float]] = {}
    if task == "regression":
        m = x.agg(F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
        scores["Dummy"] = {"R2": 0.0, "RMSE": m["s"] or 0.0, "MAE": x.agg(F.avg(F.abs(F.col("label") - m["m"]))).first()[0]}
    else:
        top = x.groupBy("label").count().agg(F.max("count")).first()[0]
        scores["Dummy"] = {"Acc": top / n}
    fitted = {}
    for name, model in models.items():
        per_fold = []
        for k in range(folds):
            fit = model.fit(x.where(F.col("_fold") != k))
            out = fit.transform(x.where(F.col("_fold") == k))
            per_fold.append({m: e.evaluate(out) for m, e in metrics.items()})
            fitted[name] = fit
        scores[name] = {m: float(np.mean([p[m] for p in per_fold])) for m in metrics}
    first = next(iter(metrics))
    best = max((m for m in scores if m != "Dummy"), key=lambda m: scores[m][first])
    weights = fitted["RandomForest"].featureImportances.toArray().tolist()
    importances = sorted(zip([*numbers, *cats], weights), key=lambda p: -p[1])
    leakage = []
    if task == "regression" and numbers:
        row = df.agg(*(F.corr(c, target).alias(f"r{i}") for i, c in enumerate(numbers))).first()
        leakage = [c for i, c in enumerate(numbers) if row[f"r{i}"] is not None and abs(row[f"r{i}"]) > LEAKAGE]
    x.unpersist()
    return {"task": task, "target": target, "n": n, "scores": scores, "best": best, "importances": importances, "leakage": leakage}


@dataclass
class Bundle:
    """A fitted pipeline with what scoring needs to know."""

    target: str
    task: str
    numbers: list[str]
    categories: list[str]
    model: PipelineModel
    labels: list[str] = field(default_factory=list)

    def save(self, path: str) -> str:
        self.model.write().overwrite().save(path)
        meta = json.dumps({"target": self.target, "task": self.task, "numbers": self.numbers, "categories": self.categories, "labels": self.labels})
        SparkSession.active().createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "quern"))
        return path

    @classmethod
    def load(cls, spark, path: str) -> Bundle:
        meta = json.loads(spark.read.text(os.path.join(path, "quern")).first()[0])
        return cls(model=PipelineModel.load(path), **meta)


def train_exportable(df: DataFrame, target: str, exclude: tuple[str, ...] = (), seed: int = 7) -> Bundle | None:
    task = infer_task(df, target)
    numbers, cats = feature_columns(df, target, exclude)
    data = as_doubles(df.where(F.col(target).isNotNull()), numbers)
    if data.count() < 20 or not (numbers or cats):
        return None
    labels: list[str] = []
    if task == "classification":
        index = StringIndexer(inputCol="_t", outputCol="label", stringOrderType="alphabetAsc").fit(data.withColumn("_t", F.col(target).cast("string")))
        labels = list(index.labels)
        data = index.transform(data.withColumn("_t", F.col(target).cast("string")))
        final = [RandomForestClassifier(numTrees=50, seed=seed, maxBins=64), IndexToString(inputCol="prediction", outputCol="_label", labels=labels)]
    else:
        data = data.withColumn("label", F.col(target).cast("double"))
        final = [GBTRegressor(maxIter=30, seed=seed, maxBins=64)]
    model = Pipeline(stages=[*encoder_stages(numbers, cats), *final]).fit(data)
    return Bundle(target, task, numbers, cats, model, labels)


def predict_frame(bundle: Bundle, df: DataFrame) -> DataFrame:
    """df with <target>_prediction; nulls get medians and unseen levels a level of their own."""
    out = bundle.model.transform(as_doubles(df, bundle.numbers))
    value = F.col("_label") if bundle.labels else F.col("prediction")
    return out.select(*df.columns, value.alias(f"{bundle.target}_prediction"))


def tune_model(df: DataFrame, target: str, trials: int = 30, exclude: tuple[str, ...] = (), seed: int = 7) -> dict | None:
    """Seeded random search over boosted trees (forests for classes), by two hashed folds."""
    task = infer_task(df, target)
    numbers, cats = feature_columns(df, target, exclude)
    data = as_doubles(df.where(F.col(target).isNotNull()), numbers)
    if data.count() < 30:
        return None
    if task == "classification":
        data = StringIndexer(inputCol="_t", outputCol="label").fit(data.withColumn("_t", F.col(target).cast("string"))).transform(data.withColumn("_t", F.col(target).cast("string")))
        metric, name = MulticlassClassificationEvaluator(metricName="accuracy"), "accuracy"
        make = lambda p: RandomForestClassifier(seed=seed, maxBins=64, numTrees=p["trees"], maxDepth=p["depth"], minInstancesPerNode=p["leaf"])
    else:
        data, metric, name = data.withColumn("label", F.col(target).cast("double")), RegressionEvaluator(metricName="r2"), "r2"
        make = lambda p: GBTRegressor(seed=seed, maxBins=64, maxIter=p["trees"], maxDepth=p["depth"], minInstancesPerNode=p["leaf"], stepSize=p["rate"])
    x = Pipeline(stages=encoder_stages(numbers, cats)).fit(data).transform(data).select("features", "label").withColumn("_f", F.pmod(F.xxhash64("features", "label"), F.lit(2))).cache()
    score = lambda p: float(np.mean([metric.evaluate(make(p).fit(x.where(F.col("_f") != k)).transform(x.where(F.col("_f") == k))) for k in (0, 1)]))
    rng = random.Random(seed)
    base = {"trees": 20, "depth": 5, "leaf": 1, "rate": 0.1}
    baseline = score(base)
    best, params = baseline, base
    for _ in range(trials):
        p = {"trees": rng.randint(10, 40), "depth": rng.randint(2, 6), "leaf": rng.choice([1, 2, 5, 10]), "rate": 10 ** rng.uniform(-2, -0.3)}
        if (s := score(p)) > best:
            best, params = s, p
    x.unpersist()
    return {"task": task, "target": target, "metric": name, "n_trials": trials, "baseline_cv": baseline, "best_cv": best, "improvement": best - baseline, "best_params": params}


def causal_analysis(df: DataFrame, treatment: str, outcome: str, exclude: tuple[str, ...] = ()) -> dict | None:
    """A/B contrast and inverse-propensity estimate of a two-level treatment's effect."""
    levels = [r[0] for r in df.where(F.col(treatment).isNotNull()).select(F.col(treatment).cast("string").alias("l")).distinct().orderBy("l").limit(3).collect()]
    if len(levels) != 2:
        return None
    t = (F.col(treatment).cast("string") == levels[1]).cast("double")
    seen = [r[0] for r in df.where(F.col(outcome).isNotNull()).select(F.col(outcome).cast("string").alias("l")).distinct().orderBy("l").limit(3).collect()]
    binary = len(seen) == 2
    if not binary and dict(df.dtypes)[outcome] in ("string", "boolean"):
        return None
    y = (F.col(outcome).cast("string") == seen[1]).cast("double") if binary else finite(F.col(outcome))
    data = df.withColumn("_y", y).withColumn("_treated", t).where("_y IS NOT NULL AND _treated IS NOT NULL")
    g = {r["_treated"]: r.asDict() for r in data.groupBy("_treated").agg(F.count("*").alias("n"), F.avg("_y").alias("mean"), F.var_samp("_y").alias("var")).collect()}
    if len(g) != 2 or min(x["n"] for x in g.values()) < 2:
        return None
    a, b = g[1.0], g[0.0]
    effect = a["mean"] - b["mean"]
    out = {"treatment": treatment, "outcome": outcome, "outcome_kind": "binary" if binary else "numeric", "n_treated": a["n"], "n_control": b["n"], "effect": effect}
    if binary:
        se = math.sqrt(a["mean"] * (1 - a["mean"]) / a["n"] + b["mean"] * (1 - b["mean"]) / b["n"])
        pooled = (a["mean"] * a["n"] + b["mean"] * b["n"]) / (a["n"] + b["n"])
        z = effect / math.sqrt(pooled * (1 - pooled) * (1 / a["n"] + 1 / b["n"])) if 0 < pooled < 1 else 0.0
        out |= {"effect_name": "risk difference", "test": "two-proportion z", "p_value": normal_two_sided(z), "effect_size_name": "relative risk", "effect_size": a["mean"] / b["mean"] if b["mean"] else None}
    else:
        se = math.sqrt(a["var"] / a["n"] + b["var"] / b["n"])
        stat, dof = welch_t(a, b)
        out |= {"effect_name": "mean difference", "test": "Welch t", "p_value": t_two_sided(stat, dof), "effect_size_name": "Cohen's d", "effect_size": cohens_d(a, b)}
    out |= {"ci_low": effect - 1.96 * se, "ci_high": effect + 1.96 * se, "ipw_ate": None, "propensity_auc": None}
    numbers, cats = feature_columns(df, treatment, (outcome, *exclude))
    if numbers or cats:
        x = as_doubles(data, numbers)
        x = Pipeline(stages=encoder_stages(numbers, cats)).fit(x).transform(x).select("features", F.col("_treated").alias("label"), "_y")
        scored = LogisticRegression(maxIter=100).fit(x).transform(x)
        e = F.greatest(F.least(vector_to_array("probability")[1], F.lit(0.95)), F.lit(0.05))
        out["ipw_ate"] = scored.agg(F.avg(F.col("label") * F.col("_y") / e - (1 - F.col("label")) * F.col("_y") / (1 - e))).first()[0]
        out["propensity_auc"] = BinaryClassificationEvaluator().evaluate(scored)
    return out
