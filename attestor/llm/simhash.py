"""SimHash near-duplicates, exact up to a Hamming distance, by vantage-point trees.

A tree over a bounded sample routes fingerprints to shards: at each node they
part by distance to a vantage point.  Two fingerprints at distance 2 have a
midpoint at distance 1 from both, so it is enough to follow every branch that a
ball of half the distance reaches; by the triangle bound all other branches are
pruned, and the shard of the midpoint holds both ends.  Inside a shard the same
splitting goes on until few are left, which are compared with each other.  A
shard gives a spanning forest of its links, never all pairs, and the forests
are joined to components.

Edge cases: null and empty texts have the fingerprint zero and are linked like
any other; equal rows share a fingerprint; rows with a null ``doc_id`` get the
component of their group, null if no row of the group has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.llm.common import annotated, hot_join, stored
from attestor.llm.components import components

SHINGLE, DISTANCE = 3, 2
#: Fingerprints that the routing tree is built from, at most, and at most an eighth of all.
SAMPLE = 1 << 20
#: Fingerprints of a shard before overlap.
SHARD = 2048
#: A group of at most this size is compared all with all.
SMALL = 256


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bits set in more than half of the shingles' XXH64 (seed 42)."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = (ends - [len(p) for p in parts]).tolist()
    last = min(words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[last:].tolist(), strict=False)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, *, text: str = "text", words: int = SHINGLE) -> DataFrame:
    """Each document as ``row``, with its fingerprint as the 64 bits of a long."""

    def work(texts: pa.Array) -> list:
        prints = np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64)
        return [pa.array(prints.view(np.int64))]

    return annotated(docs, text, work, "fp long")


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, radius and distances that halve the points best; none if no split makes both sides smaller."""
    best = None
    for vantage in points[rng.integers(0, len(points), 4)]:
        far = np.bitwise_count(points ^ vantage).astype(np.int64)
        upto = np.cumsum(np.bincount(far, minlength=66))
        inner, outer = upto[1:66], len(points) - np.append(0, upto)[:65]  # distances to m + 1, and from m
        larger = np.maximum(inner, outer)
        m = int(np.argmin(larger))
        if best is None or larger[m] < best[0]:
            best = (int(larger[m]), vantage, m, far)
    return best[1:] if best and best[0] <= 0.9 * len(points) else None


class Tree:
    """Nested nodes (vantage, radius, inside, outside); a leaf is a number."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.leaves = 0
        self.root = self._grow(sample, max(16, leaf), np.random.default_rng(7), 40)

    def _grow(self, points, leaf, rng, deep):
        cut = split(points, rng) if deep and len(points) > leaf else None
        if cut is None:
            self.leaves += 1
            return self.leaves - 1
        vantage, m, far = cut
        return vantage, m, self._grow(points[far <= m], leaf, rng, deep - 1), self._grow(points[far > m], leaf, rng, deep - 1)

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of a point, leaf) for every leaf that the ball of radius 1 around the point reaches."""
        at, leaves, todo = [], [], [(self.root, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if not isinstance(node, tuple):
                at.append(own)
                leaves.append(np.full(len(own), node))
                continue
            vantage, m, inside, outside = node
            far = np.bitwise_count(points[own] ^ vantage)
            for branch, mine in ((inside, own[far <= m + 1]), (outside, own[far >= m])):
                if len(mine):
                    todo.append((branch, mine))
        return np.concatenate(at), np.concatenate(leaves)


def close_pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at distance 2 or less that connect all such points; not every pair of a dense group."""
    rng, left, right = np.random.default_rng(11), [], []
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= SMALL:
            i, j = np.nonzero(np.triu(np.bitwise_count(points[own][:, None] ^ points[own][None, :]) <= DISTANCE, 1))
            left.append(own[i])
            right.append(own[j])
            continue
        cut = split(points[own], rng)
        if cut:
            _, m, far = cut
            todo += [own[far <= m + 1], own[far >= m]]
            continue
        # a dense group: points that share a midpoint are linked in a chain, in passes over the midpoints
        passes = 1 + len(own) // 100_000
        for k in range(passes):
            middle, owner = [], []
            for flip in [0, *(1 << b for b in range(64))]:
                z = points[own] ^ np.uint64(flip)
                mine = z % np.uint64(passes) == np.uint64(k)
                middle.append(z[mine])
                owner.append(own[mine])
            middle, owner = np.concatenate(middle), np.concatenate(owner)
            order = np.argsort(middle, kind="stable")
            same = middle[order][1:] == middle[order][:-1]
            left.append(owner[order][:-1][same])
            right.append(owner[order][1:][same])
    return np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])


def labels_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` points reaches."""
    label = np.arange(n)
    while True:
        was = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == was).all():
            return label


def shard_links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint that it reaches in the shard), without the smallest ones themselves."""
    points = np.unique(points)
    label = labels_of(len(points), *close_pairs(points))
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def fingerprint_links(prints: DataFrame, n: int, *, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(u, v) that connect all distinct fingerprints within the distance; ``prints`` has a column ``fp``."""
    rate = min(1 / 8, sample / max(n, 1))
    chosen = prints.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("fp").toPandas()["fp"]
    tree = Tree(np.sort(chosen.to_numpy(np.int64)).view(np.uint64), int(shard * rate))
    held = prints.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False)
            at, leaves = held.value.route(points.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int64)), pa.array(points[at])], names=["leaf", "fp"])

    def join(group: pa.Table) -> pa.Table:
        u, v = shard_links(group.column("fp").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return prints.select("fp").mapInArrow(route, "leaf long, fp long").groupBy("leaf").applyInArrow(join, "u long, v long")


def classes(printed: DataFrame, *, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row of ``printed`` (doc_id, fp), which is read several times."""
    prints = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    links = fingerprint_links(prints, prints.count(), sample=sample, shard=shard)
    roots = stored(components(links).select(F.col("node").alias("fp"), "root"), "roots")
    linked = prints.join(roots, "fp")
    heads = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    many = roots.join(heads, "root")
    facts = prints.join(many, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"), "n")
    return hot_join(printed, stored(facts, "facts"), "fp", "n")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits and component_id of every row."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    printed = stored(with_fingerprints(slim).select("row.doc_id", "fp"), "fingerprints")
    found = classes(printed, **options)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one whose id names the group; of equal ids and fingerprints one row."""
    full = stored(with_fingerprints(docs, text=text), "fingerprints")
    printed = full.select(F.col(f"row.`{doc_id}`").alias("doc_id"), "fp")
    heads = classes(printed, **options).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    heads = heads.groupBy("doc_id", "root").agg(F.min("fp").alias("fp")).select(F.col("doc_id").alias("head"), F.col("fp").alias("head_fp"))
    own = F.col(f"row.`{doc_id}`")
    first = F.row_number().over(W.partitionBy("head", "head_fp").orderBy(F.xxhash64(F.col(f"row.`{text}`")), F.xxhash64("row")))
    kept = full.join(heads, own.eqNullSafe(F.col("head")) & (F.col("fp") == F.col("head_fp")))
    return kept.withColumn("_first", first).filter("_first = 1").select("row.*")
