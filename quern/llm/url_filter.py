"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with the rule's; the
longest rule wins. The urls that rules decide are the labelled ones the trees learn from, at most TRAIN_ROWS of
them (those with the smallest hash). Features: length, host length, depth, digit ratio, entropy of the
characters, parameters, dots, hyphens, scheme, and the share and number of blocked labelled urls by suffix. A
labelled url's suffix statistics come from the other FOLDS - 1 folds (by a hash of the url, so that repeats of a
url share a fold), as its own label would tell itself otherwise; other urls' come from all. held_out_auc() grows
the trees without one fold and ranks that fold by them; the README states the figure. The trees can only learn
what the rules' verdicts teach.

Defined cases: repeated rows each give one; urls that tie in the hash are taken by page_id; a null url and one without `://` have an empty host and path and fit no rule; without labelled
urls of both verdicts the trees aren't grown and the method's verdict is the only one seen, or allow.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import stage, table, utf8_lower

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bounds of the labelled urls that are learnt from, and of the suffixes that have statistics.
TRAIN_ROWS = 50_000
SUFFIXES = 10_000
FOLDS = 5
#: Weight of the prior in a suffix's share, in urls.
PRIOR = 20.0
TREES, DEPTH = 20, 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return utf8_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def term(total, c):
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return total + F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(F.array_distinct(chars), F.lit(0.0), term))


FEATURES = ["f_length", "f_host", "f_depth", "f_digits", "f_entropy", "f_params", "f_dots", "f_hyphens", "f_secure", "f_suffix_share", "f_suffix_count"]


def lexical(pages: DataFrame) -> DataFrame:
    """pages (page_id, url) with host, path, rule, ruled, suffix and the lexical features."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    count = lambda c, what: (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))).cast("double")
    url = F.col("url")
    return df.withColumns(
        {
            "rule": rule,
            "ruled": verdict,
            "suffix": F.substring_index("host", ".", -1),
            "f_length": F.length(url).cast("double"),
            "f_host": F.length("host").cast("double"),
            "f_depth": count(F.col("path"), "/"),
            "f_digits": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
            "f_entropy": entropy(url),
            "f_params": F.when(F.instr(url, "?") > 0, count(F.substring_index(F.expr("substring(url, instr(url, '?') + 1)"), "#", 1), "&") + 1).otherwise(0.0),
            "f_dots": count(F.col("host"), "."),
            "f_hyphens": count(url, "-"),
            "f_secure": url.startswith("https").cast("double"),
        }
    )


def labelled(rows: DataFrame) -> DataFrame:
    """The urls that the trees learn from, with label (1.0: block) and fold."""
    sample = rows.where("ruled IS NOT NULL").orderBy(F.xxhash64("url"), "page_id").limit(TRAIN_ROWS)
    return sample.withColumns({"label": (F.col("ruled") == "block").cast("double"), "fold": F.pmod(F.crc32("url"), F.lit(FOLDS)).cast("int")})


class Suffixes:
    """Counts of labelled urls by suffix, at most SUFFIXES of them, the most frequent."""

    def __init__(self, known: DataFrame):
        total = known.agg(F.count("*").alias("n"), F.sum("label").alias("b"), *(F.sum(F.when(F.col("fold") != f, F.col("label"))).alias(f"b{f}") for f in range(FOLDS)), *(F.count_if(F.col("fold") != f).alias(f"n{f}") for f in range(FOLDS))).first()
        share = lambda b, n: (total[b] or 0.0) / total[n] if total[n] else 0.0
        self.prior, self.priors = share("b", "n"), [share(f"b{f}", f"n{f}") for f in range(FOLDS)]
        by_fold = known.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("b"))
        each = by_fold.groupBy("suffix").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("n", "b")))).alias("_own"))
        self.table = stage(each.orderBy(F.desc("_n"), "suffix").limit(SUFFIXES), "suffixes")

    def add(self, rows: DataFrame, fold: Column | None = None) -> DataFrame:
        """rows with the suffix statistics; of all folds, or of all but the row's own."""
        own = F.element_at("_own", fold) if fold is not None else F.lit(None).cast("struct<n:bigint,b:double>")
        prior = F.element_at(F.array(*map(F.lit, self.priors)), fold + 1) if fold is not None else F.lit(self.prior)
        n = F.coalesce("_n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))
        b = F.coalesce("_b", F.lit(0.0)) - F.coalesce(own["b"], F.lit(0.0))
        share = (b + PRIOR * prior) / (n + PRIOR)
        return rows.join(F.broadcast(self.table), "suffix", "left").withColumns({"f_suffix_share": share, "f_suffix_count": F.log1p(n.cast("double"))}).drop("_n", "_b", "_own")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def grown(known: DataFrame, suffixes: Suffixes):
    """The trees' model; known: labelled urls of both verdicts."""
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=42, checkpointInterval=-1)
    return trees.fit(_assembled(suffixes.add(known, F.col("fold"))).select("features", "label"))


def _scored(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows with score, the probability of block from trees grown on known."""
    ends = known.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
    if ends["low"] is None or ends["low"] == ends["high"]:
        return rows.withColumn("score", F.lit(float(ends["low"] or 0.0)))
    suffixes = Suffixes(known)
    return grown(known, suffixes).transform(_assembled(suffixes.add(rows))).withColumn("score", vector_to_array("probability")[1])


def held_out_auc(pages: DataFrame, fold: int = 0) -> float | None:
    """How well trees grown without a fold rank that fold's urls by their rules' verdicts: the share of pairs of a
    blocked and an allowed url in which the blocked one scores higher, ties half; null without such pairs."""
    known = stage(labelled(lexical(pages)), "labelled")
    scores = _scored(known.where(F.col("fold") == fold), known.where(F.col("fold") != fold)).select("label", "score")
    counts = scores.groupBy("score").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("a"))
    below = F.coalesce(F.sum("a").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    row = counts.withColumn("w", F.col("b") * (below + F.col("a") / 2)).agg(F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    return row["w"] / (row["a"] * row["b"]) if row["a"] and row["b"] else None


def judged(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the trees' probability of block."""
    rows = stage(lexical(pages), "urls")
    scored = _scored(rows, stage(labelled(rows), "labelled"))
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
