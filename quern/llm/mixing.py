"""Mixing sources to target weights by entropy balancing.

Of all rates that give every source its target of words, those lie nearest in relative entropy by word to taking
each document once that also keep the words' shares by language and by length near the corpus's: a document's rate
is min(MOST, exp(a + b + c)), a of its source, b of its language group and c of its length group. The multipliers
solve the convex dual. Sources' constraints hold exactly, languages' and lengths' softly: a multiplier b lets its
group's words come to (1 - SLACK x b) of the corpus's, so that targets that can't all be met don't run away.

Newton iterations are distributed. State is by source and cell (language group, length group), with counts of
words; for given b and c every source finds its own a where its row is, and one aggregate sums the gradient and the
Hessian of what is left (the Schur complement over sources), at most GROUPS x (GROUPS + 1) numbers whatever the
number of sources; only those reach the driver.

Rates then become whole copies: within a source, strata of equal size are settled from the longest documents to the
shortest, each taking the number of copies that comes nearest to what is due, with what it misses carried on; within
a stratum copies are dealt in proportion to the documents' rates. So a source's words come within about its
shortest documents' size of the target.

Sizes up to EXACT words are strata of their own, longer ones share STEPS strata for each doubling, which bounds
the strata of a source (about 4096 + 64 x 19). Defined cases: null text has size 0; documents of size 0 take 0
words and one copy; the null source is a source and the null language a language; repeated rows are documents of
their own; an empty table gives none; documents that tie in size and rate are dealt copies by a hash
of doc_id and text, and rows that share both by their place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import CROWDS, WORD, at_places, lasting, placed, row_numbers, shuffle_partitions, stage, table

WEIGHTS = (5, 2, 1)
#: A target's and a rate's bound.
MOST = 3
EXACT = 4096
STEPS = 64
#: Languages go to so many groups by hash, lengths to a group for each doubling.
LANGUAGES, LENGTHS = 16, 24
GROUPS = LANGUAGES + LENGTHS
SLACK = 0.25
#: Iterations at most, for all sources and within one, and the residual (as a share of all words) that ends them.
NEWTON_STEPS, SOURCE_STEPS = 30, 40
TOLERANCE = 1e-9


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (source, source_size) with target: sources in order have the weights in turn.

    What lies above `most` times a source's size is shared out again by weight, until nothing does: all targets
    are then min(most x size, weight x level) for one level, found by walking the sources in the order in which
    a rising level meets their bounds.
    """
    in_order = Window.orderBy(F.asc_nulls_last(F.col("source").cast("binary")))
    whole = Window.partitionBy(F.lit(0))
    of_rank = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", of_rank).withColumn("bound", F.col("source_size") * float(most)).withColumn("meets", F.col("bound") / F.col("w"))
    rising = Window.orderBy("meets", F.asc_nulls_last(F.col("source").cast("binary")))
    below, on = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("turn", F.row_number().over(rising))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(below), F.lit(0.0))) / F.sum("w").over(on))
    level = F.min(F.when(F.col("level") <= F.col("meets"), F.struct("turn", "level"))).over(whole)["level"]
    return s.select("source", "source_size", F.least("bound", F.col("w") * F.coalesce(level, F.lit(0.0))).alias("target"))


def stratum_of(size: Column) -> Column:
    return F.when(size <= EXACT, size).otherwise(EXACT + F.ceil(F.log2(size / float(EXACT)) * STEPS)).cast("long")


def cell_of(lang: Column, size: Column) -> Column:
    """language group x LENGTHS + length group; a length group depends on the stratum's doubling only."""
    length = F.least(F.floor(F.log2(F.greatest(size, F.lit(1)))), F.lit(LENGTHS - 1))
    return (F.pmod(F.xxhash64(lang), F.lit(LANGUAGES)) * LENGTHS + length).cast("int")


def _bound(value: Column, use) -> Column:
    """use(x) with x computed once."""
    return F.transform(F.array(value), use)[0]


def _tilts(cells: Column, beta: np.ndarray) -> Column:
    """cells (cell, words) with tilt, the sum of the language's and the length's multipliers."""
    # folded into one literal, so that iterations share their compiled code
    values = F.expr(f"array({', '.join(f'{b!r}D' for b in beta.tolist())})")
    tilt = lambda cell: F.element_at(values, (cell / LENGTHS).cast("int") + 1) + F.element_at(values, cell % LENGTHS + LANGUAGES + 1)
    return F.transform(cells, lambda c: F.struct(c["cell"].alias("cell"), c["words"].alias("words"), tilt(c["cell"]).alias("tilt")))


def _multiplier(cells: Column, target: Column, total: Column) -> Column:
    """The source's multiplier: Newton's method, steps bounded, on sum of words x min(MOST, exp(a + tilt)) = target."""

    def step(a, _):
        def add(acc, c):
            raw = F.exp(a + c["tilt"])
            return F.struct((acc["held"] + c["words"] * F.least(raw, F.lit(float(MOST)))).alias("held"), (acc["slope"] + F.when(raw < MOST, c["words"] * raw).otherwise(0.0)).alias("slope"))

        sums = F.aggregate(cells, F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("slope")), add)
        return _bound(sums, lambda s: a + F.least(F.greatest((target - s["held"]) / F.greatest(s["slope"], total * 1e-9), F.lit(-2.0)), F.lit(2.0)))

    start = F.ln(F.greatest(target / total, F.lit(1e-12)))
    return F.when((total > 0) & (target > 0), F.aggregate(F.sequence(F.lit(1), F.lit(SOURCE_STEPS)), start, step))


def _rated(sources: DataFrame, beta: np.ndarray) -> DataFrame:
    """sources with cells (cell, words, rate); rate 0 where the target is."""
    tilted = sources.withColumn("tilted", _tilts(F.col("cells"), beta))
    solved = tilted.withColumn("rated", _bound(_multiplier(F.col("tilted"), F.col("target"), F.col("source_size").cast("double")), lambda a: F.transform("tilted", lambda c: F.struct(c["cell"].alias("cell"), c["words"].alias("words"), F.coalesce(F.least(F.exp(a + c["tilt"]), F.lit(float(MOST))), F.lit(0.0)).alias("rate")))))
    return solved.drop("tilted")


def _derivatives(rated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(words taken by group, Schur complement of the Hessian) in one aggregate; at most GROUPS x (GROUPS + 1) rows."""
    taken = lambda c: c["words"] * c["rate"]
    slope = lambda c: F.when(c["rate"] < MOST, taken(c)).otherwise(0.0)
    language, length = lambda c: (c["cell"] / LENGTHS).cast("int"), lambda c: LANGUAGES + c["cell"] % LENGTHS
    entry = lambda i, j, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("double").alias("v"))
    own = F.flatten(F.transform("rated", lambda c: F.array(entry(language(c), F.lit(-1), taken(c)), entry(length(c), F.lit(-1), taken(c)), entry(language(c), language(c), slope(c)), entry(length(c), length(c), slope(c)), entry(language(c), length(c), slope(c)), entry(length(c), language(c), slope(c)))))
    # of each source: its slopes by group, and their products over its whole slope
    by_group = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.struct(g.alias("g"), F.aggregate("rated", F.lit(0.0), lambda t, c: t + F.when((language(c) == g) | (length(c) == g), slope(c)).otherwise(0.0)).alias("v")))
    whole = F.aggregate("rated", F.lit(0.0), lambda t, c: t + slope(c))
    some = F.filter("by_group", lambda x: x["v"] > 0)
    shared = F.flatten(F.transform("some", lambda x: F.transform("some", lambda y: entry(x["g"], y["g"], -x["v"] * y["v"] / F.col("whole")))))
    rows = rated.withColumns({"by_group": by_group, "whole": whole}).withColumn("some", some).select(F.explode(F.concat(own, shared)).alias("e"))
    gradient, hessian = np.zeros(GROUPS), np.zeros((GROUPS, GROUPS))
    for r in rows.groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v")).collect():
        if r["j"] < 0:
            gradient[r["i"]] = r["v"]
        else:
            hessian[r["i"], r["j"]] = r["v"]
    return gradient, hessian


def balanced(sources: DataFrame, goal: np.ndarray) -> tuple[np.ndarray, int, float]:
    """(multipliers by group, iterations, last residual as a share of all words).

    sources: (source, source_size, target, cells), written. goal: the corpus's words by group.
    """
    beta, total = np.zeros(GROUPS), goal[:LANGUAGES].sum()
    used = goal > 0
    for step in range(NEWTON_STEPS):
        taken, hessian = _derivatives(_rated(sources, beta))
        residual = (taken - goal * (1 - SLACK * beta))[used]
        if not total or np.abs(residual).max() <= TOLERANCE * total:
            return beta, step, float(np.abs(residual).max(initial=0.0) / max(total, 1))
        curve = hessian[np.ix_(used, used)] + SLACK * np.diag(goal[used])
        beta[used] -= np.clip(np.linalg.solve(curve, residual), -1.0, 1.0)
    return beta, NEWTON_STEPS, float(np.abs(residual).max() / total)


def _copies(strata: Column) -> Column:
    """Copies due to each stratum (n, words, due, stratum), longest first, with the missing words carried on."""
    start = F.struct(F.lit(0.0).alias("due"), F.lit(0.0).alias("taken"), F.array().cast("array<struct<stratum:bigint,copies:bigint,due:double>>").alias("out"))

    def step(acc, s):
        due = acc["due"] + s["due"]
        mean = s["words"] / s["n"]
        k = F.least(F.greatest(F.round((due - acc["taken"]) / F.greatest(mean, F.lit(1e-9))), F.lit(0.0)), (s["n"] * MOST).cast("double")).cast("long")
        k = F.when(s["words"] == 0, s["n"]).otherwise(k)
        return _bound(k, lambda k: F.struct(due.alias("due"), (acc["taken"] + k * mean).alias("taken"), F.concat(acc["out"], F.array(F.struct(s["stratum"].alias("stratum"), k.alias("copies"), (s["due"] / F.greatest(mean, F.lit(1e-9))).alias("due")))).alias("out")))

    return F.aggregate(strata, start, step, lambda acc: acc["out"])


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken, file, at) for each row of docs (doc_id, text, source,
    lang; without lang, all are of one language)."""
    docs = lasting(docs)
    slices = max(64, min(1024, 4 * shuffle_partitions(docs.sparkSession)))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = placed(docs, doc_id=F.col("doc_id"), source=F.col("source"), lang=lang, h=F.xxhash64("doc_id", "text"), size=size_of(F.col("text")))
    rows = stage(rows.withColumns({"stratum": stratum_of(F.col("size")), "cell": cell_of(F.col("lang"), F.col("size"))}).drop("lang"), "sizes")
    strata = stage(rows.groupBy("source", "stratum", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "strata")
    goals = targets(strata.groupBy("source").agg(F.sum("words").alias("source_size")))
    # a source's cells and strata are bounded in number, whatever its documents
    listed = strata.groupBy("source", "cell").agg(F.sum("words").cast("double").alias("words")).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("cell", "words"))).alias("cells")).withColumnRenamed("source", "_source")
    sources = stage(goals.join(listed, _same(F.col("source"), F.col("_source"))).drop("_source"), "sources")
    goal = np.zeros(GROUPS)
    for r in strata.groupBy("cell").agg(F.sum("words").alias("words")).collect():
        goal[r["cell"] // LENGTHS] += r["words"]
        goal[LANGUAGES + r["cell"] % LENGTHS] += r["words"]
    beta, _, _ = balanced(sources, goal)
    rates = stage(_rated(sources, beta).select(F.col("source").alias("_s"), "source_size", "target", F.explode("rated").alias("r")).select("_s", "source_size", "target", F.col("r.cell").alias("_cell"), F.col("r.rate").alias("rate")), "rates")

    cells = strata.join(rates, _same(F.col("source"), F.col("_s")) & (F.col("cell") == F.col("_cell"))).drop("_s", "_cell")
    each = cells.groupBy("source", "stratum").agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.sum(F.col("words") * F.col("rate")).alias("due"))
    folded = each.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("stratum", "n", "words", "due")))).alias("strata"))
    plan = folded.select(F.col("source").alias("_s"), F.explode(_copies(F.col("strata"))).alias("p")).select("_s", F.col("p.stratum").alias("_stratum"), "p.copies", F.col("p.due").alias("asked"))
    # within a stratum every cell has a stretch of the copies in proportion to its documents' rates
    share = F.when(F.col("asked") > 0, F.least(F.col("rate") * F.col("copies") / F.col("asked"), F.lit(float(MOST)))).otherwise(F.when(F.col("copies") > 0, F.lit(1.0)).otherwise(0.0))
    cells = cells.join(plan, _same(F.col("source"), F.col("_s")) & (F.col("stratum") == F.col("_stratum"))).withColumn("each", share)
    # cells in an order of chance, as later ones gain what earlier ones' fractions leave
    before = Window.partitionBy("source", "stratum").orderBy(F.xxhash64("source", "stratum", "cell"), "cell").rowsBetween(Window.unboundedPreceding, -1)
    plan = cells.withColumn("start", F.coalesce(F.sum(F.col("each") * F.col("n")).over(before), F.lit(0.0)))
    plan = stage(plan.select(F.col("source").alias("_s"), F.col("stratum").alias("_stratum"), F.col("cell").alias("_cell"), "source_size", "target", "rate", "each", "start"), "plan")

    # slices by the content, so that files may be written anew; what many rows repeat is dealt by place
    total = rows.count()
    crowded = rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(1, total // CROWDS)).select("h", F.lit(1).alias("crowded"))
    rows = rows.join(F.broadcast(crowded), "h", "left").withColumn("spread", F.when(F.col("crowded") == 1, F.xxhash64("file", "at")).otherwise(F.col("h"))).drop("crowded")
    ranked = row_numbers(rows, ["source", "stratum", "cell"], [F.col("h"), F.col("file"), F.col("at")], slices, "rank", F.col("spread"))
    found = ranked.join(plan, _same(F.col("source"), F.col("_s")) & (F.col("stratum") == F.col("_stratum")) & (F.col("cell") == F.col("_cell")))
    upto = lambda rank: F.floor(F.col("start") + rank * F.col("each") + 1e-6)
    copies = F.least(upto(F.col("rank") + 1) - upto(F.col("rank")), F.lit(MOST)).cast("int")
    return found.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), "file", "at")


def repeated(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of whatever names, as often as the mix takes them.

    Whole rows are shuffled once to meet the copies of their places, and repeated after that.
    """
    docs = lasting(docs)
    times = mixed(docs).where("copies > 0").select("file", "at", "copies")
    return at_places(docs, times).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("turn")).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).drop("file", "at")
