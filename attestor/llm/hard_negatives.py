"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors are dealt by ranges of their place on a Hilbert curve and written as
blocks of neighbouring vectors, each with the least and greatest value of every
dimension.  Interval arithmetic over these gives bounds for the inner product of
an anchor with any row of a block; an anchor reads a block only if the bounds
meet what it looks for: scores that can enter its best positives, or its
windows of negatives.  Three passes over the blocks: each anchor's own block
gives a first limit, then positives, then negatives.  The zone maps are read
first, by themselves, and folders of blocks that no anchor wants are not opened.

Edge cases: rows with a null id, label or vector, with null or non-finite
components, or with one of 2^17 or more in size take no part; of unequal
lengths the missing components count as zero; rows with an anchor's id are its
own; of several rows with an anchor's id the smallest label and vector ask;
other repeated rows count one by one; equal scores go to the smaller id; a
positive of score below zero has an empty window; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.llm.common import shared_folder, stored
from attestor.llm.maxscore import matrix
from attestor.llm.vectors import spans

#: Rows of a block, folders of blocks, bits of each dimension on the curve, anchors of one pass, anchors scored at a time.
BLOCK, FOLDERS, BITS, ANCHORS, STEP = 512, 256, 4, 65_536, 1024
#: Components of at least this size, times 256, take no part, so that no sum of products leaves 64 bits.
LARGEST = 1 << 25
LEAST = -(1 << 62)

#: The zone map of a block (kinds of labels, least and greatest values), its anchors, and its rows.
BLOCKS = "kinds array<long>, low array<int>, high array<int>, own array<long>, width int, ids array<long>, labels array<long>, rows binary"


def usable(rows: DataFrame, key: str, vector: str, label: str | Column) -> DataFrame:
    """(vec_id, label, v): rows that take part, scaled to integers."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    fits = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST / 256), F.lit(False)))
    label = F.col(label) if isinstance(label, str) else label
    found = rows.filter(fits & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(whole, lambda x: x.cast("int")).alias("v"))
    return found.filter("label is not null and v is not null")


def curve_places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell on the Hilbert curve, as big-endian bytes.

    ``cells`` has a row per point and a column per dimension, with values below
    2^bits.  From the highest bit down, each quadrant's orientation is undone
    by exchanging or inverting the lower bits; a Gray code gives the place.
    """
    x = cells.astype(np.uint32).T.copy()
    for bit in range(bits - 1, 0, -1):
        q, lower = np.uint32(1 << bit), np.uint32((1 << bit) - 1)
        for i in range(len(x)):
            inverted = (x[i] & q) > 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & lower)
            x[0] ^= np.where(inverted, lower, swap).astype(np.uint32)
            x[i] ^= swap.astype(np.uint32)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1] if len(x) else len(cells), np.uint32)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] & np.uint32(1 << bit), np.uint32((1 << bit) - 1), np.uint32(0)) if len(x) else np.uint32(0)
    x ^= turned
    planes = [(row >> np.uint32(bit)) & np.uint32(1) for bit in range(bits - 1, -1, -1) for row in x]
    return np.packbits(np.array(planes, np.uint8).reshape(len(planes), len(cells)), axis=0).T.copy()


def on_curve(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with ``place`` on the curve: dimensions with the greatest variance turn first, each cut into 2^bits equal cells."""
    found = spans(rows, "v")
    low = np.array([s.low for s in found], np.int64)
    width = np.array([s.high - s.low + 1 for s in found], np.int64)
    order = np.argsort([-s.variance for s in found], kind="stable")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), len(low))
            cells = np.clip((v - low) * (1 << bits) // width, 0, (1 << bits) - 1)
            place = curve_places(cells[:, order], bits) if len(low) else np.zeros((len(v), 1), np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p.tobytes() for p in place], pa.binary())], names=[*batch.schema.names, "place"])

    return rows.mapInArrow(placed, "vec_id long, label long, v array<int>, place binary")


def write_blocks(rows: DataFrame, folder: str, *, every: int, block: int = BLOCK, folders: int = FOLDERS) -> DataFrame:
    """Blocks of neighbours on the curve, in folders of neighbouring blocks; equal places are dealt by id."""
    order = ["place", "vec_id"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.least(F.floor(F.spark_partition_id() * F.lit(folders) / parts), F.lit(folders - 1)).cast("int").alias("folder")
    dealt = on_curve(rows).repartitionByRange(*order).sortWithinPartitions(*order).select(own, "vec_id", "label", "v")
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    types = [longs, ints, ints, longs, pa.int32(), longs, longs, pa.binary(), pa.int32()]
    names = ["kinds", "low", "high", "own", "width", "ids", "labels", "rows", "folder"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def one(some: pa.Table) -> pa.RecordBatch:
            some = some.combine_chunks()
            v = matrix(some.column("v")).astype(np.int32)
            ids = some.column("vec_id").to_numpy()
            labels = some.column("label").to_numpy()
            cells = [np.unique(labels), v.min(0, initial=LARGEST), v.max(0, initial=-LARGEST), ids[ids % every == 0], v.shape[1], ids, labels, v.tobytes(), some.column("folder")[0].as_py()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types, strict=True)], names=names)

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block:
                whole = pa.Table.from_batches(held)
                yield one(whole.slice(0, block))
                held = whole.slice(block).to_batches()
        if sum(b.num_rows for b in held):
            yield one(pa.Table.from_batches(held))

    dealt.mapInArrow(cut, BLOCKS + ", folder int").write.partitionBy("folder").parquet(folder)
    return rows.sparkSession.read.schema(BLOCKS + ", folder int").parquet(folder)


class Anchors:
    """Anchors of one pass, and what they look for: scores from ``least`` to ``most``, of their label or of others.

    ``of`` names the anchor of each thing looked for, ``tag`` the thing; the
    ``k`` best found so far in this task raise its ``least``.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, of: np.ndarray, tag: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.k, self.same = ids, labels, vectors, k, same
        order = np.argsort(of, kind="stable")
        self.of, self.tag, self.least, self.most = of[order], tag[order], least[order], most[order]
        self.plus, self.minus = np.maximum(vectors, 0).astype(float), np.minimum(vectors, 0).astype(float)
        self.size = (self.plus - self.minus).sum(1)
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.read = 0

    def bounds(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with any vector between ``low`` and ``high``."""
        slack = 1 + self.size * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * 1e-12  # of rounding
        return self.plus @ low + self.minus @ high - slack, self.plus @ high + self.minus @ low + slack

    def wanted(self, kinds: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places of what must read a block with this zone map."""
        if not len(self.of):
            return np.zeros(0, np.int64)
        width = self.vectors.shape[1]
        low, high = (np.pad(x[:width], (0, max(0, width - len(x)))).astype(float) for x in (low, high))
        fewest, most = self.bounds(low, high)
        fit = np.isin(self.labels, kinds) if self.same else np.full(len(self.ids), True) if len(kinds) > 1 else self.labels != kinds[0]
        return np.flatnonzero(fit[self.of] & (most[self.of] >= self.least) & (fewest[self.of] <= self.most))

    def look(self, names: np.ndarray, labels: np.ndarray, vectors: np.ndarray, targets: np.ndarray) -> None:
        """Score a block for the anchors of ``targets`` and keep their best."""
        self.read += len(targets)
        top = int(np.abs(vectors).max(initial=0)) * int(np.abs(self.vectors).max(initial=0)) * max(1, vectors.shape[1])
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64  # sums are exact
        lists = np.ascontiguousarray(vectors.T.astype(kind))
        asking = np.unique(self.of[targets])
        for at in range(0, len(asking), STEP):
            some = asking[at : at + STEP]
            scores = self.vectors[some].astype(kind) @ lists
            other = self.labels[some][:, None] != labels
            ok = (other != self.same) & (self.ids[some][:, None] != names)
            own = targets[(self.of[targets] >= some[0]) & (self.of[targets] <= some[-1])]
            row = np.searchsorted(some, self.of[own])
            least, most = self.least[own], self.most[own]
            for begin in range(0, len(own), STEP):
                part = slice(begin, begin + STEP)
                has = scores[row[part]]
                # bounds of up to 63 bits are compared as they are only where scores are too
                small = (lambda x: x) if kind is np.int64 else (lambda x: np.clip(x, -(1 << 60), 1 << 60).astype(np.float64))
                hits = ok[row[part]] & (has >= small(least[part])[:, None]) & (has <= small(most[part])[:, None])
                for i in np.flatnonzero(hits.any(1)):
                    self._keep(int(own[begin + i]), has[i][hits[i]].astype(np.int64), names[hits[i]])

    def _keep(self, target: int, scores: np.ndarray, names: np.ndarray) -> None:
        if target in self.best:
            had, held = self.best[target]
            scores, names = np.concatenate([had, scores]), np.concatenate([held, names])
        order = np.lexsort((names, -scores))[: self.k]
        self.best[target] = scores[order], names[order]
        if len(order) == self.k:
            self.least[target] = max(self.least[target], scores[order[-1]])

    def found(self) -> pa.RecordBatch:
        """(anchor_id, tag, vec_id, score)."""
        keys = sorted(self.best)
        sizes = [len(self.best[t][0]) for t in keys]
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        at = np.repeat(np.array(keys, np.int64), sizes)
        cells = [self.ids[self.of[at]], self.tag[at], join(self.best[t][1] for t in keys), join(self.best[t][0] for t in keys)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["anchor_id", "tag", "vec_id", "score"])


PAIRS = "anchor_id long, positive_id long, positive_score long"
FOUND = "anchor_id long, tag long, vec_id long, score long"


def _arrays(batch: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    return [batch.column(n)[i].values.to_numpy() for n in names]


def searched(blocks: DataFrame, held, own_only: bool = False) -> DataFrame:
    """Best rows of every task for the broadcast anchors; with ``own_only`` each anchor reads its own block."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*held.value)
        for batch in batches:
            keep = [i for i in range(batch.num_rows) if len(anchors.wanted(*_arrays(batch, i, "kinds", "low", "high")))]
            yield pa.RecordBatch.from_arrays([batch.column("folder").take(pa.array(keep, pa.int64()))], names=["folder"])

    if not own_only:  # at most as many folders as there are
        folders = [r[0] for r in blocks.select("folder", "kinds", "low", "high").mapInArrow(choose, "folder int").distinct().collect()]
        blocks = blocks.filter(F.col("folder").isin(folders) if folders else F.lit(False))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(*held.value)
        width = anchors.vectors.shape[1]
        for batch in batches:
            for i in range(batch.num_rows):
                names, labels, kinds, low, high, own = _arrays(batch, i, "ids", "labels", "kinds", "low", "high", "own")
                targets = np.flatnonzero(np.isin(anchors.ids[anchors.of], own)) if own_only else anchors.wanted(kinds, low, high)
                if len(targets):
                    v = np.frombuffer(batch.column("rows")[i].as_py() or bytes(4), np.int32, len(names) * batch.column("width")[i].as_py()).reshape(len(names), batch.column("width")[i].as_py())
                    v = np.pad(v[:, :width], ((0, 0), (0, max(0, width - v.shape[1])))).astype(np.int64)
                    anchors.look(names, labels, v, targets)
        yield anchors.found()

    return blocks.mapInArrow(look, FOUND)


def first_rows(found: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mined(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", every: int = 50, positives: int = 5, negatives: int = 3, anchors: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows with an id divisible by ``every``.  A positive is one of an
    anchor's ``positives`` best rows of its label; its negatives are the
    ``negatives`` best rows of other labels that score from 50 to 95 % of it.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector, label), "rows")
    blocks = write_blocks(rows, shared_folder(spark, "blocks"), every=every, block=block)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    passes = asked.count() // anchors + 1
    near, pairs = shared_folder(spark, "positives"), shared_folder(spark, "negatives")
    for part in range(passes):  # at most so many anchors as are broadcast at once
        some = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == part).select("vec_id", "a.*").toArrow()
        ids, labels = (some.column(n).to_numpy() for n in ("vec_id", "label"))
        shape = ids, labels, matrix(some.column("v")).astype(np.int32)
        one, none, least = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.full(len(ids), LEAST)

        def send(*target, shape=shape):
            return spark.sparkContext.broadcast((*shape, *target))

        # the last of the best positives in the anchor's own block, where there are enough
        seeds = searched(blocks, send(one, none, least, -least, positives, True), own_only=True)
        last = first_rows(seeds, positives, "anchor_id").filter(F.col("rank") == positives).select("anchor_id", "score").toArrow()
        known = dict(zip(*(c.to_pylist() for c in last.columns), strict=True))
        least = np.array([known.get(i, LEAST) for i in ids.tolist()], np.int64)
        best = first_rows(searched(blocks, send(one, none, least, none - LEAST, positives, True)), positives, "anchor_id")
        best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(f"{near}/pass={part}")
        # at most ``positives`` windows for each anchor of the pass, in the order of its anchors
        windows = spark.read.schema(PAIRS).parquet(f"{near}/pass={part}").select("anchor_id", "positive_score").distinct().toArrow()
        score, place = windows.column(1).to_numpy(), np.argsort(ids, kind="stable")
        of = place[np.searchsorted(ids[place], windows.column(0).to_numpy())] if len(ids) else place
        found = searched(blocks, send(of, score, -(-score // 2), score + (-score // 20), negatives, False))
        first_rows(found, negatives, "anchor_id", "tag").write.parquet(f"{pairs}/pass={part}")
    found = spark.read.schema(FOUND + ", rank int").parquet(pairs)
    joined = spark.read.schema(PAIRS).parquet(near).join(found.withColumnRenamed("tag", "positive_score"), ["anchor_id", "positive_score"])
    return joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
