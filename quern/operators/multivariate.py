"""Multivariate structure: Mahalanobis distances, clusters, Wilks' lambda, embedding geometry, topics, Bayes factors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import finite
from quern.functions.special import chi2_quantile, chi2_sf
from quern.operators.relations import varying

SILHOUETTE_ROWS = 3000
#: A small lexicon; no larger one is at hand offline.
POSITIVE = ("good", "great", "excellent", "happy", "love", "best", "nice", "wonderful", "amazing", "perfect")
NEGATIVE = ("bad", "poor", "terrible", "sad", "hate", "worst", "awful", "horrible", "wrong", "broken")


def mahalanobis(df: DataFrame, columns: list[str], name: str = "mahalanobis_d2") -> tuple[DataFrame, float]:
    """df with squared distances, and the chi-square threshold; the inverse covariance goes in as literals."""
    base = df.select(*(finite(F.col(c)).alias(c) for c in columns)).na.drop()
    k = len(columns)
    row = base.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    inverse = np.linalg.pinv(np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))
    d = [finite(F.col(c)) - row[f"m{i}"] for i, c in enumerate(columns)]
    total = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            total = total + d[i] * d[j] * float(inverse[i, j])
    return df.withColumn(name, total), chi2_quantile(0.975, k)


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    x = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.select(*(finite(F.col(c)).alias(c) for c in columns)).na.drop())
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(x).transform(x).select("features")


def best_clusters(x: DataFrame, ks=range(2, 7), seed: int = 7) -> dict:
    """k by silhouette on a bounded sample; sizes over all rows."""
    sample = x.orderBy(F.xxhash64(F.col("features").cast("string"))).limit(SILHOUETTE_ROWS).cache()
    n, found = sample.count(), []
    for k in ks:
        if k < n:
            found.append((ClusteringEvaluator().evaluate(KMeans(k=k, seed=seed).fit(sample).transform(sample)), k))
    sample.unpersist()
    if not found:
        return {"best_k": None, "silhouette": None, "cluster_sizes": []}
    silhouette, k = max(found, key=lambda f: (f[0], -f[1]))
    sizes = KMeans(k=k, seed=seed).fit(x).transform(x).groupBy("prediction").count().orderBy(F.desc("count")).collect()
    return {"best_k": k, "silhouette": silhouette, "cluster_sizes": [r["count"] for r in sizes]}


def wilks_lambda(df: DataFrame, columns: list[str], group: str) -> tuple[float, float]:
    """(lambda, p by Bartlett's approximation), from sums of squares and products."""
    base = df.select(F.col(group).cast("string").alias("g"), *(finite(F.col(c)).alias(c) for c in columns)).na.drop()
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count("*").alias("n"), *(F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)]

    def matrix(r) -> np.ndarray:
        return np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * r["n"]

    groups, total = base.groupBy("g").agg(*sums).collect(), base.agg(*sums).first()
    w, t = sum(matrix(g) for g in groups), matrix(total)
    value = float(np.linalg.det(w) / np.linalg.det(t))
    n, p = total["n"], len(groups)
    x = -(n - 1 - (k + p) / 2) * math.log(max(value, 1e-300))
    return value, chi2_sf(x, k * (p - 1))


def multivariate_analysis(df: DataFrame, columns: list[str] | None = None, group: str | None = None) -> dict | None:
    columns = columns or varying(df)
    if len(columns) < 2:
        return None
    scored, limit = mahalanobis(df, columns)
    x = standardised(df, columns).cache()
    out = {"n_numeric": len(columns), "mahalanobis_outliers": scored.where(F.col("mahalanobis_d2") > limit).count(), "mahalanobis_threshold": limit, **best_clusters(x)}
    out["pca_2d_variance"] = float(PCA(k=2, inputCol="features", outputCol="p").fit(x).explainedVariance.toArray().sum())
    out["manova_p"] = wilks_lambda(df, columns[:6], group)[1] if group else None
    x.unpersist()
    return out


def embedding_geometry(df: DataFrame, column: str) -> dict:
    x = df.where(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    return {"n_docs": x.count(), "dim": len(x.first()["features"]), "pca_2d_variance": float(PCA(k=2, inputCol="features", outputCol="p").fit(x).explainedVariance.toArray().sum()), **best_clusters(x)}


def sentiment(text):
    """(positive - negative) / (positive + negative) words of the lexicon, 0 without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    count = lambda some: F.size(F.filter(words, lambda w: w.isin(*some)))
    p, n = count(POSITIVE), count(NEGATIVE)
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def lda_topics(df: DataFrame, column: str, words: int = 8, seed: int = 7, max_docs: int = 5000) -> list[str]:
    docs = df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(max_docs)
    n = docs.count()
    if n < 10:
        return []
    tokens = StopWordsRemover(inputCol="_w", outputCol="_c").transform(RegexTokenizer(inputCol=column, outputCol="_w", pattern=r"[^\p{L}]+", minTokenLength=2).transform(docs))
    vocabulary = CountVectorizer(inputCol="_c", outputCol="features", vocabSize=500, minDF=2).fit(tokens)
    if not vocabulary.vocabulary:
        return []
    model = LDA(k=min(5, max(2, n // 10)), seed=seed, maxIter=10).fit(vocabulary.transform(tokens))
    return [", ".join(vocabulary.vocabulary[i] for i in r["termIndices"]) for r in model.describeTopics(words).collect()]


def nlp_analysis(df: DataFrame, columns: list[str]) -> list[dict]:
    out = []
    for c in columns:
        s = df.where(F.col(c).isNotNull()).select(sentiment(F.col(c)).alias("s")).agg(F.count("*").alias("n"), F.avg("s").alias("m"), F.avg((F.col("s") > 0.05).cast("int")).alias("p"), F.avg((F.col("s") < -0.05).cast("int")).alias("q")).first()
        if s["n"] >= 10:
            out.append({"column": c, "n_docs": s["n"], "topics": lda_topics(df, c), "sentiment_mean": s["m"], "positive_pct": 100 * s["p"], "negative_pct": 100 * s["q"]})
    return out


def jzs_bayes_factor(t: float, n: int, m: int, r: float = math.sqrt(2) / 2) -> float:
    """BF10 of a two-sample t with a Cauchy prior, by Simpson's rule over ln g."""
    size, dof = n * m / (n + m), n + m - 2
    null = -(dof + 1) / 2 * math.log1p(t * t / dof)

    def f(u: float) -> float:
        g = math.exp(u)
        a = 1 + size * g * r * r
        return math.exp(-0.5 * math.log(a) - (dof + 1) / 2 * math.log1p(t * t / (a * dof)) - null - 0.5 * math.log(2 * math.pi) - 1.5 * u - 1 / (2 * g) + u)

    lo, hi, steps = -12.0, 25.0, 4000
    h = (hi - lo) / steps
    return h / 3 * sum(f(lo + i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1))


#: (from, wording)
BAYES_WORDS = [(100, "decisive evidence for a difference"), (30, "very strong evidence for a difference"), (10, "strong evidence for a difference"), (3, "moderate evidence for a difference"), (1, "anecdotal evidence for a difference"), (1 / 3, "anecdotal evidence for no difference"), (0, "evidence for no difference")]


def interpret(bf10: float) -> str:
    return next(w for least, w in BAYES_WORDS if bf10 >= least)


def bayesian_analysis(df: DataFrame, group: str, values: list[str]) -> list[dict]:
    from quern.operators.tests import moments

    out = []
    for v in values[:8]:
        g = [x for x in moments(df, v, group).collect() if x["n"] >= 5]
        if len(g) == 2:
            a, b = g
            pooled = ((a["n"] - 1) * a["var"] + (b["n"] - 1) * b["var"]) / (a["n"] + b["n"] - 2)
            t = (a["mean"] - b["mean"]) / math.sqrt(pooled * (1 / a["n"] + 1 / b["n"])) if pooled else 0.0
            bf = jzs_bayes_factor(t, a["n"], b["n"])
            out.append({"value": v, "group": group, "bf10": bf, "interpretation": interpret(bf)})
    return out
