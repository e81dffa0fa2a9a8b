"""Shared helpers of the training-data operators.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]``; ``bytes.split()`` splits at exactly
those bytes, and ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are split into words in pieces of about this many bytes, so that a huge text never becomes one list.
PIECE_BYTES = 1 << 22
#: Bytes of an Arrow batch, about.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 1 << 23
#: A side of at most so many (narrow) rows may be broadcast: 2 million rows of two longs are about 64 MB.
BROADCAST_ROWS = 2_000_000
#: A key that more than one row in so many has is crowded; there are at most so many crowded keys.
CROWDS = 1024

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ cluster


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, as in tests, a local session gets a
    folder of its own; on a cluster that is an error, as executors don't see one another's folders."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the written table: lineage is cut, and a lost
    executor costs nothing that was finished. The files go when the application ends, or with drop_stage()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def drop_stage(df: DataFrame) -> None:
    """Deletes a table of stage() that nothing reads any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quern_path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers (once for each application), and bounds what
    a worker is sent at a time by bytes, unless it was started with a bound: rows alone would let long texts fill its memory."""
    sc = spark.sparkContext
    if sc._conf.get(ARROW_BYTES) is None:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    if getattr(sc, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quern-code-")) / "quern_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._quern_shipped = True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted); else as it is, for an ordinary join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lasting(docs: DataFrame) -> DataFrame:
    """docs itself where it is a plain scan of Parquet files, whose rows keep their places; else docs written to the
    shared folder, as the places of computed rows change when executors are lost."""
    plan = docs._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    if kind(plan) == "LogicalRelation" and kind(plan.relation()) == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet":
        return docs
    return stage(docs, "rows")


def placed(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns of docs (a result of lasting()) and each row's place: its file (16 bytes) and its number
    there, `at`. A place tells rows apart that agree in everything else, and depends on neither splits nor executors."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(F.unhex(F.md5(meta["file_path"].cast("binary"))).alias("file"), meta["row_index"].alias("at"), *(c.alias(k) for k, c in columns.items()))


def at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc, ...): the rows of docs, as a struct, whose place is in places (file, at, ...), with places' other columns.

    One plan at every size: whole rows are shuffled once, by a key that no two share, and stream past hash tables
    of places; they are neither sorted nor broadcast.
    """
    return placed(docs, doc=F.struct("*")).join(places.hint("shuffle_hash"), ["file", "at"])


def met(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with facts (key, n: the rows that have it, ...); every key of rows is in facts, once.

    Keys that more than one row in CROWDS has, CROWDS at most, are met by broadcast, so that no task gets the rows
    of a crowded key; the others by a shuffle.
    """
    least = total // CROWDS
    crowded = F.broadcast(facts.where(F.col("n") > least))
    few = facts.where(F.col("n") <= least)
    rest = rows.join(F.broadcast(facts.where(F.col("n") > least).select(key)), key, "left_anti")
    return rows.join(crowded, key).unionByName(rest.join(few, key))


# ------------------------------------------------------------------ columns


def utf8_lower(c: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_numbers(df: DataFrame, group: list[str], order: list[Column], slices: int, name: str, by: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 within each group, without bringing a group into one task.

    Rows are dealt to `slices` slices of their group by a hash of `order`, or of `by`; a window numbers each slice, and the
    slices' counts (at most groups x slices rows) are summed before it. Rows that tie on `order` get any order.
    """
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*([by] if by is not None else order)), F.lit(slices)).cast("int"))
    keys = [*group, "_slice"]
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    match = [cut[k].eqNullSafe(sizes[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = cut.join(sizes, match).drop(*(f"_k{i}" for i in range(len(keys))))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, (F.col("_before") + within - 1).cast("long")).drop("_slice", "_before")


# ------------------------------------------------------------------ words


def word_pieces(data: bytes):
    """Lists of the words of data, in order, each from about PIECE_BYTES bytes."""
    at, end = 0, len(data)
    while end - at > PIECE_BYTES:
        gap = _SPACE.search(data, at + PIECE_BYTES)
        if gap is None:
            break
        yield data[at : gap.start()].split()
        at = gap.end()
    yield data[at:].split()


def word_hashes(data: bytes) -> np.ndarray:
    """XXH64 of each word."""
    return np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in word_pieces(data)])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values after which all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes; of the whole sequence where it is shorter; none for no words."""
    k = min(k, len(h))
    if not k:
        return h[:0]
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out = out * _MULTIPLIER + h[j : len(h) - k + 1 + j]
    return mixed(out + np.uint64(k))


# ------------------------------------------------------------------ components


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of the component, for every node with a link.

    Every round takes the smallest label among a node and its neighbours and then the label of that label, so
    long chains shorten as fast as they spread; rounds end when no label changes. State is a written table, so
    nothing is gathered on the driver. Links may repeat and may point either way. The minimum over neighbours is
    taken before the shuffle, and labels that many nodes share are met by broadcast.
    """
    both = stage(links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a))).where("node <> other").distinct(), "links")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    total = labels.count()
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("m"))
        low = stage(labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label")), "low")
        of = labels.select(F.col("node").alias("_n"), F.col("label").alias("beyond"))
        named = low.groupBy("label").agg(F.count("*").alias("n")).join(of, F.col("label") == F.col("_n")).drop("_n")
        new = stage(met(low, named, "label", total).select("node", "was", F.least("label", "beyond").alias("label")), "labels")
        moved = new.where("label <> was").limit(1).count()
        drop_stage(low)
        drop_stage(labels)
        path = new._quern_path
        labels = new.select("node", "label")
        labels._quern_path = path
        if not moved:
            drop_stage(both)
            return labels.select("node", F.col("label").alias("component"))
