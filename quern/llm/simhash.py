"""SimHash near-dedup with vantage-point trees.

Fingerprints that differ in at most RADIUS = 4 of 64 bits are linked; components of links are groups. Every tree
node has a vantage point v, a bound b and a radius r; of the points that reach it those with d(x, v) <= b go inside
and those with d(x, v) > b - r outside, so points near the boundary are in both shards. By the triangle bound two
points within r of each other then meet inside or outside, whatever their distances to v. Leaves are shards, and
each is searched exactly.

Distances of unrelated fingerprints have mean 32 and deviation 4, so over all 64 bits a boundary shell of radius 4
holds two fifths of the points, and a tree can't pay. The distance is therefore taken over blocks: 64 bits are
three blocks, two fingerprints that differ in 4 bits differ in at most one bit of some block, and there is a tree
for each block with r = 1 and a sixth of the points in a shell. Where a block's bits can't split a shard any more,
because its points agree in them, nodes go on over all 64 bits with r = 4.

Trees grow in one task on a sample chosen by hash, one point in SAMPLE_ONE_IN but within SAMPLE_LEAST and
SAMPLE_MOST; only their nodes go to the driver and are broadcast. Every point is routed through every tree. Shards
beyond FLAT points (dense groups) are searched by a tree of their own, whose branches the triangle bound prunes.
Nothing is capped, and a shard gives links that span rather than all pairs.

Defined cases: null text counts as empty; no words, fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of the whole sequence; repeated rows and equal texts share a fingerprint; an empty table
gives no rows; a component without any doc_id has a null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import at_places, connected_components, lasting, met, placed, ship, shuffle_partitions, stage, table, word_pieces

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: (mask, radius) of each tree's block: 4 differing bits leave at most one in one of three blocks.
BLOCKS = [(((1 << 21) - 1), 1), (((1 << 21) - 1) << 21, 1), (((1 << 22) - 1) << 42, 1)]
WHOLE = ((1 << 64) - 1, RADIUS)
#: Points of a shard that trees are grown for, and the sampled points that a leaf has at least.
SHARD, LEAST = 512, 8
SAMPLE_ONE_IN, SAMPLE_LEAST, SAMPLE_MOST = 64, 1 << 15, 1 << 22
#: Vantage points tried for a node, and the points that they are tried on.
TRIED, TRIED_ON = 4, 1024
#: A node must send at most this share of its points to each side.
PROGRESS = 0.8
#: Shards of at most so many points are searched flat, others by a tree.
FLAT = 4096
#: Points that a task routes at a time.
ROUTED = 1 << 18


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the word shingles, repeats included."""
    ones, total, tail = np.zeros(64, np.int64), 0, []
    for words in word_pieces((text or "").encode().lower()):
        words = tail + words
        tail = words[-(SHINGLE_WORDS - 1) :]
        n = len(words) - SHINGLE_WORDS + 1
        if n > 0:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            digest = xxhash.xxh64_intdigest
            hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[SHINGLE_WORDS - 1 :].tolist())], np.uint64)
            for at in range(0, n, 4096):
                ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += n
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found.view(np.int64))], names=[*kept, "bits"])


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows with bits, the fingerprint as a signed 64-bit integer, in place of text."""
    ship(rows.sparkSession)
    kept = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    return rows.mapInArrow(_prints, kept.add("bits", T.LongType()))


def _sides(points: np.ndarray, vantage: int, mask: int, radius: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(inside, outside, bound): which points go to which side; some go to both."""
    d = np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)
    bound = int(np.median(d)) if bound is None else bound
    return d <= bound, d > bound - radius, bound


def grown(points: np.ndarray, mask: int, radius: int, least: int) -> list[tuple[int, int, int, int, int, int]]:
    """Nodes (vantage, mask, radius, bound, inside, outside) of a tree; a child below 0 is the leaf -1 - child.

    The first node is the root; a tree without nodes is one leaf, 0.
    """
    nodes: list[list[int]] = []
    leaves = 0
    todo = [(points, -1, 0)]
    while todo:
        at, parent, side = todo.pop()
        best = None
        for m, r in ((mask, radius), WHOLE) if len(at) > least else ():
            some = at[:: max(1, len(at) // TRIED_ON)]
            for vantage in some[:: max(1, len(some) // TRIED)][:TRIED].tolist():
                inside, outside, bound = _sides(some, vantage, m, r)
                share = max(inside.mean(), outside.mean())
                if share <= PROGRESS and (best is None or share < best[0]):
                    best = (share, vantage, m, r, bound)
            if best is not None:
                break
        if best is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            _, vantage, m, r, bound = best
            me = len(nodes)
            nodes.append([vantage, m, r, bound, 0, 0])
            inside, outside, _ = _sides(at, vantage, m, r, bound)
            todo += [(at[inside], me, 4), (at[outside], me, 5)]
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def routed(nodes: list[tuple], points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indexes of points) for every leaf that points reach."""
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if node < 0:
            yield -1 - node, at
            continue
        vantage, mask, radius, bound, inner, outer = nodes[node]
        inside, outside, _ = _sides(points[at], vantage, mask, radius, bound)
        todo += [(inner, at[inside]), (outer, at[outside])]


class VantageTree:
    """Exact search for what lies within a radius, over distinct 64-bit fingerprints.

    Found fingerprints leave the tree, so that a dense group costs little more than its size.
    """

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None):
        index = np.arange(len(points)) if index is None else index
        self.points, self.inner, self.outer = points, None, None
        if len(index) > FLAT:
            d = np.bitwise_count(points[index] ^ points[index[0]])
            self.vantage, self.bound = points[index[0]], int(np.median(d))
            near, far = index[d <= self.bound], index[d > self.bound]
            if len(near) and len(far):
                self.inner, self.outer = VantageTree(points, near), VantageTree(points, far)
        self.left = index if self.inner is None else None

    def take(self, point: np.uint64, radius: int) -> list[np.ndarray]:
        """Removes and returns (as index arrays) what lies within the radius of the point."""
        if self.inner is None:
            if not len(self.left):
                return []
            hit = np.bitwise_count(self.points[self.left] ^ point) <= radius
            if not hit.any():
                return []
            out, self.left = self.left[hit], self.left[~hit]
            return [out]
        d = int(np.bitwise_count(self.vantage ^ point))
        found = self.inner.take(point, radius) if d - radius <= self.bound else []
        if d + radius > self.bound:
            found = found + self.outer.take(point, radius)
        return found


def spanning_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what is connected by links within the radius, fewer than there are points.

    A component's points are linked as a binary heap, so none gets more than three links however many there are.
    """
    tree, a, b = VantageTree(points), [], []
    seen = np.zeros(len(points), bool)
    for start in range(len(points)):
        if seen[start]:
            continue
        tree.take(points[start], 0)
        seen[start] = True
        members, at = [start], 0
        while at < len(members):
            for found in tree.take(points[members[at]], radius):
                seen[found] = True
                members.extend(found.tolist())
            at += 1
        if len(members) > 1:
            m = np.array(members)
            a.append(m[(np.arange(1, len(m)) - 1) // 2])
            b.append(m[1:])
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def shard_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a shard's distinct points that connect all within the radius: flat, or by a tree where there
    are many points or links."""
    a, b = [], []
    for at in range(0, len(points), 256) if len(points) <= FLAT else ():
        x, y = np.nonzero(np.bitwise_count(points[at : at + 256, None] ^ points[None, at:]) <= radius)
        if len(x) > 2048:
            return spanning_links(points, radius)
        a.append(at + x[y > x])
        b.append(at + y[y > x])
    if len(points) > FLAT:
        return spanning_links(points, radius)
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _grow(least: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.concatenate([np.zeros(0, np.uint64), *(b.column("bits").to_numpy(zero_copy_only=False).view(np.uint64) for b in batches)])
        for tree, (mask, radius) in enumerate(BLOCKS):
            nodes = grown(points, mask, radius, least)
            if nodes:
                vantage, masks, *rest = (np.array(c, np.uint64) for c in zip(*((n[0], n[1], n[2], n[3], n[4] % 2**64, n[5] % 2**64) for n in nodes)))
                columns = [np.full(len(nodes), tree, np.int64), np.arange(len(nodes)), *(c.view(np.int64) for c in (vantage, masks, *rest))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_NODE)

    return grow


_NODE = ["tree", "node", "vantage", "mask", "radius", "bound", "inside", "outside"]


def trees(points: DataFrame, n: int) -> list[list[tuple]]:
    """The nodes of each block's tree over the n points (bits); at most about SAMPLE_MOST / LEAST times a few."""
    want = max(SAMPLE_LEAST, min(SAMPLE_MOST, n // SAMPLE_ONE_IN))
    share = min(1.0, want / max(n, 1))
    order = F.xxhash64("bits")
    chosen = points.where(F.shiftrightunsigned(order, 12) < F.lit(int(share * (1 << 52)))).select("bits")
    grow = _grow(max(LEAST, int(SHARD * share)))
    rows = chosen.repartition(1).sortWithinPartitions(order).mapInArrow(grow, ", ".join(f"{c} long" for c in _NODE)).collect()
    out: list[list[tuple]] = [[] for _ in BLOCKS]
    for r in sorted(rows, key=lambda r: (r["tree"], r["node"])):
        out[r["tree"]].append((r["vantage"] % 2**64, r["mask"] % 2**64, r["radius"], r["bound"], r["inside"], r["outside"]))
    return out


def _route(sent):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in _and_end(batches):
            if batch is not None:
                held.append(batch.column("bits").to_numpy(zero_copy_only=False))
                n += len(held[-1])
            if held and (batch is None or n >= ROUTED):
                bits = np.concatenate(held)
                for tree, nodes in enumerate(sent.value):
                    shards, indexes = [], []
                    for leaf, at in routed(nodes, bits.view(np.uint64)):
                        shards.append(np.full(len(at), (tree << 48) | leaf, np.int64))
                        indexes.append(at)
                    shard, where = np.concatenate(shards), np.concatenate(indexes)
                    for i in range(0, len(shard), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(shard[i : i + (1 << 16)]), pa.array(bits[where[i : i + (1 << 16)]])], names=["shard", "bits"])
                held, n = [], 0

    return route


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard's rows are held until the next one begins."""
    shard, held = None, []

    def done() -> Iterator[pa.RecordBatch]:
        if held and (len(held) > 1 or len(held[0]) > 1):
            points = np.concatenate(held)
            a, b = shard_links(points.view(np.uint64), RADIUS)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(points[a]), pa.array(points[b])], names=["a", "b"])

    for batch in batches:
        shards, bits = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "bits"))
        starts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
        for s, e in zip(starts, [*starts[1:], len(shards)]):
            if shards[s] != shard:
                yield from done()
                shard, held = shards[s], []
            held.append(bits[s:e])
    yield from done()


def _and_end(batches):
    yield from batches
    yield None


def shards(points: DataFrame, n: int) -> DataFrame:
    """(shard, bits): every point in every shard that it reaches."""
    spark = points.sparkSession
    ship(spark)
    return points.select("bits").mapInArrow(_route(spark.sparkContext.broadcast(trees(points, n))), "shard long, bits long")


def near_links(points: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect all of the n distinct fingerprints (bits) within RADIUS."""
    dealt = shards(points, n).repartition(shuffle_partitions(points.sparkSession), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(_link, "a long, b long")


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(prints, groups, total): rows (id, text, ...) with bits in place of text, written; of each fingerprint
    (bits, n, component, least): its rows, its component, named by a fingerprint, and the least id there; and the
    number of rows. id is what decides in a group: its least value."""
    prints = stage(fingerprints(rows), "prints")
    points = stage(prints.groupBy("bits").agg(F.min("id").alias("low"), F.count("*").alias("n")), "points")
    size = points.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    parts = connected_components(near_links(points, size["k"]))
    named = points.join(parts, points["bits"] == parts["node"], "left").select("bits", "n", "low", F.coalesce("component", "bits").alias("component"))
    named = stage(named, "named")
    # of a component's fingerprints, however many, the least is taken before the shuffle
    least = named.groupBy("component").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    groups = met(named.select("bits", F.col("n").alias("rows"), "component"), least, "component", size["k"])
    return prints, stage(groups.select("bits", F.col("rows").alias("n"), "component", "least"), "groups"), size["n"] or 0


def dedup(docs: DataFrame) -> DataFrame:
    """One row of each group, with all columns, of whatever names: the one with the smallest doc_id (a null one only
    if there is no other), of rows that repeat it the one with the smallest hash of the text, of equal ones the first by file and place.

    Fingerprints decide which places stay; whole rows are then shuffled once to meet them.
    """
    docs = lasting(docs)
    rows = placed(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    rows = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"), "file", "at").alias("id"), "text")
    _, groups, _ = grouped(rows)
    stay = groups.groupBy("component").agg(F.min("least").alias("stays")).select("stays.file", "stays.at")
    return at_places(docs, stay).select("doc.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints, groups, total = grouped(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    out = met(prints, groups, "bits", total)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))
