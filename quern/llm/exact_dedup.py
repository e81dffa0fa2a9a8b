"""Exact dedup with a heavy-hitter split.

A Misra-Gries style frequent-items sketch (`approx_top_k`, merged over all tasks) finds candidates for frequent
digests. Exact counts verify them, and the winners, at most HEAVY of them, are broadcast: their copies are
settled where they are read. Only the remaining digests are shuffled; of those none has more than about one row
in TRACKED, as the sketch misses no digest beyond that.

Defined cases: null text counts as empty; runs of white space count as one space; of equal texts the row with
the smallest doc_id stays (a null doc_id only if there is no other); of rows that repeat one doc_id and text
one stays (by a hash of the text as it is, then by file and place), and the others count in group_size like any copy; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import GAP, at_places, lasting, placed, stage, table

#: Winners that are broadcast at most, the digests that a sketch tracks, and the rows that make a digest heavy.
HEAVY = 4096
TRACKED = 16384
HEAVY_ROWS = 100


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def digests(docs: DataFrame) -> DataFrame:
    """(file, at, doc_id, h, text_sha256) of docs, a result of lasting(); h is a hash of the text as it is."""
    return placed(docs, doc_id=F.col("doc_id"), h=F.xxhash64("text"), text_sha256=F.sha2(normalised(F.col("text")).cast("binary"), 256))


def _facts() -> list[Column]:
    """Of a group: its size, and doc_id and place of the row that stays."""
    return [F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "file", "at")).alias("stays")]


def verified_winners(rows: DataFrame) -> DataFrame:
    """(text_sha256, group_size, stays): heavy digests with exact counts; at most HEAVY rows, so safe to broadcast."""
    found = rows.agg(F.expr(f"approx_top_k(text_sha256, {HEAVY}, {TRACKED})").alias("top"))
    candidates = found.select(F.explode("top.item").alias("text_sha256"))
    return rows.join(F.broadcast(candidates), "text_sha256").groupBy("text_sha256").agg(*_facts()).where(F.col("group_size") >= HEAVY_ROWS)


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, winners, others): the digests of docs, written; the facts of heavy digests, written, and of the others."""
    rows = stage(digests(docs), "digests")
    winners = stage(verified_winners(rows), "winners")
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").groupBy("text_sha256").agg(*_facts())
    return rows, winners, others


def decided(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs (doc_id, text)."""
    rows, winners, others = grouped(lasting(docs))
    heavy = rows.join(F.broadcast(winners), "text_sha256")
    light = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").join(others, "text_sha256")
    stays = (F.col("file") == F.col("stays.file")) & (F.col("at") == F.col("stays.at"))
    return heavy.unionByName(light).select("doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, of whatever names; one row for each text.

    Digests decide which places stay; whole rows are then shuffled once to meet them.
    """
    docs = lasting(docs)
    _, winners, others = grouped(docs)
    return at_places(docs, winners.unionByName(others).select("stays.file", "stays.at")).select("doc.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""
