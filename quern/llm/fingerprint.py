"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction (one in KEEP_ONE_IN) of the hash range, so its size
follows the document's, sketches of parts merge by union, and containment can be estimated between documents
of very unequal length. Beside those it keeps hashes above the fraction until it has its LEAST smallest, so that
short texts, which have few below the fraction, are compared by LEAST hashes too, or by all they have. A sketch is
complete up to a threshold that can be told from it: the fraction, or its LEAST-th hash if that is higher, or the
whole range if it has fewer. Two sketches are compared below the lower of their thresholds, so no hash meets a
sketch that wouldn't have kept it. The error is that of a sample of at least LEAST shingles of the union, about
0.05 at a resemblance of 0.8, and none for two texts of fewer shingles.

Defined cases: null text counts as empty; texts of fewer words than a shingle have one shingle, the whole
sequence; no words, no hashes, an empty fingerprint; two empty fingerprints are alike (1.0), an empty and a
filled one are not (0.0). Words are compared with A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import ship, shuffle_partitions, table, window_hashes, word_hashes

SHINGLE_WORDS = 5
KEEP_ONE_IN = 8
#: Hashes are kept by their upper 48 bits, 12 hex digits each.
_DIGITS = 12
_LIMIT = np.uint64(2**48 // KEEP_ONE_IN)
#: The smallest hashes that a sketch keeps wherever they lie.
LEAST = 64


def _kept(hashes: np.ndarray) -> np.ndarray:
    """hashes: sorted and distinct."""
    return hashes[: max(LEAST, int(np.searchsorted(hashes, _LIMIT)))]


def sketch(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 48-bit hashes."""
    return _kept(np.unique(window_hashes(word_hashes((text or "").encode().lower()), words) >> np.uint64(16)))


def to_string(s: np.ndarray) -> str:
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def from_string(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), np.uint8).reshape(-1, _DIGITS // 2)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).copy().view(">u8").astype(np.uint64).ravel()


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of the union of the shingle sets."""
    return _kept(np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches])))


def threshold(s: np.ndarray) -> np.uint64:
    """Up to which hash a sketch holds all of its text's, itself included."""
    return np.uint64(2**48) if s.size < LEAST else max(_LIMIT - np.uint64(1), s[LEAST - 1])


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Estimates of the resemblance, and of how much of the smaller set the larger one contains."""
    if not a.size or not b.size:
        same = float(a.size == b.size)
        return same, same
    upto = min(threshold(a), threshold(b))
    a, b = a[a <= upto], b[b <= upto]
    if not a.size or not b.size:
        return 0.0, 0.0
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both), both / min(a.size, b.size)


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text): ranges of doc_id in order, each ended by the first row of the next range.

    Rows are ordered by doc_id (nulls first), ties by a hash of the text and the text. The last range is ended by the
    very first row. Only one row for each range is read twice; a partition of the result holds whole ranges, sorted.
    A doc_id (or null) that many rows repeat has several ranges, by the hash, as many as it has quantiles.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ranges = 8 * parts
    low = F.lit(float("-inf"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), low).alias("_x"), F.xxhash64("text").alias("_h"))
    cuts = docs.agg(F.percentile_approx("_x", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("c")).first()["c"] or [0.0]
    splits = sorted({float("-inf"), *cuts, float("inf")})
    if len(splits) < 3:  # a Bucketizer needs three
        splits = [float("-inf"), 0.0, float("inf")]
    docs = Bucketizer(splits=splits, inputCol="_x", outputCol="_b").transform(docs)
    # a value that is several quantiles comes before the rest of its bucket, in that many ranges
    crowded = {x: n for x, n in Counter(cuts).items() if n > 1}
    turn, wide = F.lit(0), 1 + max(crowded.values(), default=0)
    if crowded:
        times = F.element_at(F.create_map(*(F.lit(v) for pair in crowded.items() for v in pair)), F.col("_x"))
        turn = F.coalesce(F.floor(F.shiftrightunsigned("_h", 12) / float(1 << 52) * times), F.lit(wide - 1))
    docs = docs.select((F.col("_b").cast("long") * wide + turn).alias("bucket"), "doc_id", "_h", "text")
    least = docs.groupBy("bucket").agg(F.min(F.struct("doc_id", "_h")).alias("_least")).select(F.col("bucket").alias("_k"), "_least")
    heads = docs.join(F.broadcast(least), (F.col("bucket") == F.col("_k")) & F.struct("doc_id", "_h").eqNullSafe(F.col("_least"))).groupBy("bucket", "doc_id", "_h").agg(F.min("text").alias("text"))
    # at most one row for each range from here to the union
    everywhere = Window.orderBy("bucket")
    ended = heads.select(F.coalesce(F.lag("bucket").over(everywhere), F.max("bucket").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"), F.lit(1).alias("guest"), "doc_id", "_h", "text")
    rows = docs.select("bucket", F.lit(0).alias("guest"), "doc_id", "_h", "text").union(ended)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), "_h", "text")


def _with_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    names = [f.name for f in _OUT]
    for batch in batches:
        rows = []
        for bucket, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text"))):
            own = sketch(text)
            if before is not None and before[0] == bucket:
                _, was_id, was, its = before
                half = len(was) // 2
                edited = was[: len(was) - half] + text[:half]
                new = sketch(edited)
                near, within = likeness(its, new)
                near_next, within_next = likeness(its, own)
                rows.append((was_id, len(was), hashlib.sha256(edited.encode()).hexdigest(), to_string(its), to_string(new), near, near_next, within, within_next))
            before = (bucket, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(names), _OUT)], names=names)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("contained_edited", pa.float64()), ("contained_next", pa.float64())])
_OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double, contained_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): its fingerprint, its edited text's and the likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's by doc_id; the last document's next is the first. Repeated rows each give a row.
    """
    ship(docs.sparkSession)
    return in_order(docs).mapInArrow(_with_edits, _OUT_SQL)


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
