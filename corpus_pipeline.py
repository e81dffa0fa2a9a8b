"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet and read again.

Every stage has one plan at every size: decisions are made on narrow rows and met by whole rows at their places
(file and number), in one shuffle; nothing that grows with the corpus is broadcast. All stages take null in any
column, empty and very long texts, repeated rows, empty tables and extra columns of whatever names; all but the last
return the columns that they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup as exact
from quern.llm import mixing, packing, simhash, toxicity
from quern.llm.common import stage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score 0.5 or more) go.

    A null text counts as empty; without labels every score is 0.0 and all stay; a row is judged by its text alone, so
    repeated rows stay or go together and a null doc_id is no matter.
    """
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the row with the smallest doc_id stays.

    Null and empty texts are equal; a null doc_id stays only if its group has no other; of rows that tie in doc_id one
    stays, by a hash of the text as it is, then by place.
    """
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (fingerprints linked at 4 or fewer differing bits) the document with the smallest
    doc_id stays.

    A null text has fingerprint zero; a null doc_id stays only if its group has no other; of rows that tie in doc_id
    one stays, by a hash of the text, then by place; rows of one doc_id with unlinked texts all stay.
    """
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as the mix takes it, 0 to 3 times.

    The null source is a source and the null language a language; empty documents stay once; documents that tie in
    size and rate are taken by a hash of doc_id and text.
    """
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of at most 2,048 tokens.

    A null or empty text is its end token alone; repeated rows are documents of their own.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: A trained classifier and a tokenizer have no SQL; tests/llm/test_models.py tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
