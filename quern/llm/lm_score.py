"""LM scoring: cross-entropy difference of matched n-gram models.

A target model (documents labelled good) and a background model (all documents) are word bigrams interpolated with
unigrams. They share one vocabulary, every word that the corpus has at least twice (all others are one unknown
word), one smoothing and one size: the background's counts are scaled to the target's number of tokens. Nothing is
capped: counts of all words and pairs are kept by 64-bit hashes, so what is gathered grows with the corpus. A
document is scored with its own n-grams taken out of both models, so that the documents that trained a model don't
favour it.

Counts don't fit in memory, so documents meet them by blocks: a block is up to ROWS neighbouring rows of a file, or
one long text. (1) Each block sends its distinct keys, with counts, to the keys' buckets, one packed row for each
bucket that it reaches. (2) Each bucket sums its keys over all blocks and sends every block the totals of the
block's own keys, in their order. (3) Each block's texts meet its totals and are scored. No task holds more than a
block or a bucket, and the number of buckets follows the input; a hot word has one entry for each block.

Defined cases: null text counts as empty; a text without words has no tokens and a score of 0.0; without any
target document both losses are those of the background and every score is 0.0; repeated rows and rows that share a
doc_id are documents of their own; null doc_ids are never targets; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import lasting, mixed, placed, ship, shuffle_partitions, small_side, stage, table, word_hashes

#: Rows of a block; bytes beyond which a text is a block of its own; bytes of text for each bucket.
ROWS, LONG, BUCKET_BYTES = 4096, 1 << 16, 25_000_000
#: Keys that a task holds before it hands on what it has of a block.
HELD = 1 << 24
#: Weight of the bigram against the unigram, and of the prior in tokens.
BIGRAM_WEIGHT, PRIOR = 0.6, 1.0

_PAIR, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
#: What comes before a text's first word.
_START = np.array([0x5851F42D4C957F2D], np.uint64)


def keys_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the start and of each word, keys of each pair of neighbours, the start included), empty for no words.

    The lowest bit tells words (0) from pairs (1).
    """
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h, h
    h = np.concatenate([_START, h])
    return mixed(h) & ~_ONE, mixed(h[:-1] * _PAIR + h[1:]) | _ONE


START_KEY = (mixed(_START) & ~_ONE)[0]


def _packed(x: np.ndarray) -> bytes:
    """Counts as 32-bit numbers where they fit, else as 64-bit ones."""
    return x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u8" if n and len(data) == 8 * n else "<u4").astype(np.float64)


def _count(bits: int):
    """Of rows (file, part, text, target), the distinct keys of each block by bucket, the keys' upper bits."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, good, n = None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if not n:
                return
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            targets = np.zeros(len(keys), np.int64)
            if good:
                some, times = np.unique(np.concatenate(good), return_counts=True)
                targets[np.searchsorted(keys, some)] = times
            cuts = [0, *np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(keys)] if bits else [0, len(keys)]
            rows = [(b, *block, keys[s:e].tobytes(), _packed(counts[s:e]), _packed(targets[s:e])) for b, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64]), _KEYS)], schema=_KEYS)

        for batch in batches:
            for file, part, text, target in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "text", "target"))):
                if block != (file, part) or n > HELD:
                    yield from done()
                    block, held, good, n = (file, part), [], [], 0
                words, pairs = keys_of(text)
                held += [words, pairs]
                n += len(words) + len(pairs)
                if target:
                    good += [words, pairs]
        yield from done()

    return count


_KEYS = pa.schema([("bucket", pa.int32()), ("file", pa.binary()), ("part", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("t", pa.binary())])
_KEYS_SQL = "bucket int, file binary, part long, keys binary, n binary, t binary"


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket and block. Of each bucket the totals of every block's keys in order, and one row
    (file null) of sums: words at least twice, tokens of other words, all tokens; the same of the targets."""
    bucket, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        lengths = [len(r[2]) // 8 for r in held]
        keys, inverse = np.unique(np.concatenate([np.frombuffer(r[2], "<u8") for r in held]), return_inverse=True)
        n, t = (np.bincount(inverse, np.concatenate([_unpacked(r[c], k) for r, k in zip(held, lengths)]), len(keys)) for c in (3, 4))
        ends = np.cumsum([0, *lengths]).tolist()
        rows, i = [], 0
        while i < len(held):
            j = i + 1
            while j < len(held) and held[j][:2] == held[i][:2]:
                j += 1
            at = inverse[ends[i] : ends[j]]
            at = np.unique(at) if j > i + 1 else at
            rows.append((bucket, *held[i][:2], len(at), _packed(n[at]), _packed(t[at]), None, None, None, None, None))
            i = j
        word = ((keys & _ONE) == 0) & (keys != START_KEY)
        once = word & (n < 2)
        rows.append((bucket, None, None, 0, None, None, int((word & ~once).sum()), float(n[once].sum()), float(t[once].sum()), float(n[word].sum()), float(t[word].sum())))
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 64]), _TOTALS)], schema=_TOTALS)

    for batch in batches:
        for b, *row in zip(*(batch.column(c).to_pylist() for c in _KEYS.names)):
            if b != bucket:
                yield from done()
                bucket, held = b, []
            held.append(row)
    yield from done()


_SUMS = ["vocabulary", "rare", "rare_t", "tokens", "tokens_t"]
_TOTALS = pa.schema([("bucket", pa.int32()), ("file", pa.binary()), ("part", pa.int64()), ("keys", pa.int64()), ("n", pa.binary()), ("t", pa.binary()), ("vocabulary", pa.int64()), *((s, pa.float64()) for s in _SUMS[1:])])
_TOTALS_SQL = "bucket int, file binary, part long, keys long, n binary, t binary, vocabulary long, rare double, rare_t double, tokens double, tokens_t double"


def _own(x: np.ndarray) -> np.ndarray:
    """How often each element occurs, by element."""
    _, where, n = np.unique(x, return_inverse=True, return_counts=True)
    return n[where]


class Model:
    """Totals of one model with its scale; rare is the tokens of the words that are one unknown word."""

    def __init__(self, tokens: float, rare: float, vocabulary: int, scale: float):
        self.tokens, self.rare, self.outcomes, self.scale = tokens, rare, vocabulary + 1, scale

    def loss(self, words: np.ndarray, histories: np.ndarray, pairs: np.ndarray, unknown: np.ndarray, own: tuple[np.ndarray, ...] | None) -> float:
        """Mean negative log probability of a token, in nats. words, histories, pairs: the model's counts, by token;
        own: the document's counts of them, where they are in the model."""
        words = np.where(unknown, self.rare, words)
        total = self.tokens
        if own is not None:
            words = words - np.where(unknown, unknown.sum(), own[0])
            histories, pairs, total = histories - own[1], pairs - own[2], total - len(words)
        p1 = (self.scale * words + PRIOR) / (self.scale * total + PRIOR * self.outcomes)
        p2 = (self.scale * pairs + PRIOR * p1) / (self.scale * histories + PRIOR)
        return float(-np.log(BIGRAM_WEIGHT * p2 + (1 - BIGRAM_WEIGHT) * p1).mean())


def _score(sums: dict):
    """Rows come sorted by block, its totals first, in the order of buckets, and then its documents."""
    some = bool(sums["tokens_t"])
    scale = sums["tokens_t"] / sums["tokens"] if some else 1.0
    background = Model(sums["tokens"], sums["rare"], sums["vocabulary"], scale)
    target = Model(sums["tokens_t"], sums["rare_t"], sums["vocabulary"], 1.0) if some else background

    def scored(totals: list, docs: list) -> Iterator[pa.RecordBatch]:
        held = [k for _, _, words, pairs in docs for k in (words, pairs)]
        keys, inverse = np.unique(np.concatenate(held), return_inverse=True) if held else (np.zeros(0), np.zeros(0, np.int64))
        n, t = (np.concatenate([np.zeros(0), *(_unpacked(r[c], r[0]) for r in totals)]) for c in (1, 2))
        if len(n) != len(keys):
            raise RuntimeError("a block's texts and totals differ")
        rows, end = [], 0
        for doc_id, good, words, pairs in docs:
            begin, end = end, end + len(words) + len(pairs)
            if not len(words):
                rows.append((doc_id, 0, 0.0, 0.0, 0.0))
                continue
            one, two = inverse[begin : begin + len(words)], inverse[begin + len(words) : end]
            own, unknown = (_own(one[1:]), _own(one[:-1]), _own(two)), n[one[1:]] < 2
            b = background.loss(n[one[1:]], n[one[:-1]], n[two], unknown, own)
            of = t if some else n
            s = target.loss(of[one[1:]], of[one[:-1]], of[two], unknown, own if good or not some else None)
            rows.append((doc_id, len(two), s, b, s - b))
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096]), _OUT)], schema=_OUT)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, totals, docs = None, [], []
        for batch in batches:
            for file, part, keys, n, t, doc_id, text, good in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "keys", "n", "t", "doc_id", "text", "target"))):
                if block != (file, part):
                    yield from scored(totals, docs)
                    block, totals, docs = (file, part), [], []
                if keys is not None:
                    totals.append((keys, n, t))
                else:
                    docs.append((doc_id, good, *keys_of(text)))
        yield from scored(totals, docs)

    return score


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def scored(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row of docs (doc_id, text).

    targets: doc_id of the target documents. score is the target's loss less the background's, for a token;
    the lower, the more a document reads like the target.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    docs = lasting(docs)
    chosen = small_side(targets.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct())
    rows = placed(docs, doc_id=F.col("doc_id"), text=F.coalesce("text", F.lit("")))
    part = F.when(F.octet_length("text") > LONG, -1 - F.col("at")).otherwise(F.expr(f"at div {ROWS}"))
    rows = rows.join(chosen, F.col("doc_id") == F.col("_id"), "left").select("file", "at", part.alias("part"), "doc_id", "text", F.col("_id").isNotNull().alias("target"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(size / BUCKET_BYTES, 1)))))
    keys = rows.select("file", "part", "text", "target").mapInArrow(_count(bits), _KEYS_SQL)
    dealt = keys.repartition(parts, "bucket").sortWithinPartitions("bucket", "file", "part")
    totals = stage(dealt.mapInArrow(_total, _TOTALS_SQL), "totals")
    sums = totals.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in _SUMS)).first().asDict()
    none = lambda kind: F.lit(None).cast(kind)
    counts = totals.where("file IS NOT NULL").select("file", "part", F.lit(0).alias("kind"), F.col("bucket").cast("long").alias("turn"), "keys", "n", "t", none("long").alias("doc_id"), none("string").alias("text"), none("boolean").alias("target"))
    texts = rows.select("file", "part", F.lit(1).alias("kind"), F.col("at").alias("turn"), none("long").alias("keys"), none("binary").alias("n"), none("binary").alias("t"), F.col("doc_id").cast("long").alias("doc_id"), "text", "target")
    met = counts.union(texts).repartition(parts, "file", "part").sortWithinPartitions("file", "part", "kind", "turn")
    return met.mapInArrow(_score(sums), T.StructType.fromDDL("doc_id long, n_tokens long, target_loss double, background_loss double, score double"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return scored(table(spark, sf_dir, "documents"), good)
