"""Best-fit packing of documents into sequences under conflicts.

Documents are dealt at random to groups of a fixed number of tokens, so a hot
source or a large group of copies is spread evenly, and each group is packed by
itself, longest first.  Open bins are held by residual room, as bit sets of
bins; every source and every duplicate cluster has the bit set of the bins that
hold it.  A document asks for the smallest residual that fits and goes on to
the next one until a bin there has neither its source nor its cluster.

Clusters are the components of near copies (``near_clusters``); without them
only texts that differ in case and white space are known as copies.

Edge cases: a text without words (null, empty) is in no bin (null ``bin_id``);
a text longer than a bin is cut to pieces, of which all but the last fill bins
of their own; an unknown (null) source is in no conflict; equal rows are packed
one by one and, being copies, in different bins.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm import simhash
from attestor.llm.common import stored

CAPACITY = 2048
#: Tokens that are packed together in one task.
GROUP_TOKENS = 4_000_000

OUT = "doc_id long, piece int, start long, length int, bin_id long, position int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("bin_id", pa.int64()), ("position", pa.int32())])
_ROW = "[^ \\t\\n\\x0B\\f\\r]+"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_ROW)), F.lit(0)).cast("long")


def folded(text: str) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), "\\s+", " ")


def copy_cluster(text: str) -> Column:
    """Equal for texts that differ in case and white space only."""
    return F.xxhash64(folded(text))


def near_clusters(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, tokens, and as ``cluster`` the component of near copies of the folded text, so that copies by ``copy_cluster`` stay together."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("tokens"), folded(text).alias("text"))
    printed = stored(simhash.with_fingerprints(slim).select("row.doc_id", "row.source", "row.tokens", "fp"), "fingerprints")
    return simhash.classes(printed).select("doc_id", "source", "tokens", F.col("root").alias("cluster"))


class Bins:
    """Bins of one group, ordered by the room that is left."""

    def __init__(self, capacity: int):
        self.capacity, self.room, self.count = capacity, [], []
        self.levels = 0  # bit r: some bin has r tokens left
        self.at: dict[int, int] = {}  # residual -> bit set of bins
        self.source: dict[object, int] = {}
        self.cluster: dict[int, int] = {}

    def fitting(self, size: int, source, cluster) -> int:
        """The tightest bin that fits and has no conflict, or -1."""
        bad = self.cluster.get(cluster, 0) | (self.source.get(source, 0) if source is not None else 0)
        levels = self.levels >> size
        r = size
        while levels:
            step = (levels & -levels).bit_length() - 1
            r += step
            free = self.at[r] & ~bad
            if free:
                return (free & -free).bit_length() - 1
            levels >>= step + 1
            r += 1
        return -1

    def put(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, place in it) of a document, which is entered."""
        b = self.fitting(size, source, cluster)
        if b < 0:
            b = len(self.room)
            self.room.append(self.capacity)
            self.count.append(0)
        else:
            left = self.at[self.room[b]] & ~(1 << b)
            if left:
                self.at[self.room[b]] = left
            else:
                del self.at[self.room[b]]
                self.levels &= ~(1 << self.room[b])
        self.room[b] -= size
        r = self.room[b]
        if r:
            self.at[r] = self.at.get(r, 0) | 1 << b
            self.levels |= 1 << r
        if source is not None:
            self.source[source] = self.source.get(source, 0) | 1 << b
        self.cluster[cluster] = self.cluster.get(cluster, 0) | 1 << b
        self.count[b] += 1
        return b, self.count[b] - 1


def packed_group(group: pa.Table, capacity: int) -> pa.Table:
    """Pieces and bins of one group's documents, longest remainder first."""
    ids = group.column("doc_id").to_pylist()
    sizes = group.column("tokens").to_numpy()
    sources, clusters = group.column("source").to_pylist(), group.column("cluster").to_pylist()
    base = group.column("g")[0].as_py() << 32
    bins, out = Bins(capacity), []
    order = sorted(range(len(ids)), key=lambda i: (-(sizes[i] % capacity), clusters[i], ids[i] is None, ids[i]))
    for i in order:
        full, last = divmod(int(sizes[i]), capacity)
        for piece in range(full):
            b, place = bins.put(capacity, sources[i], clusters[i])
            out.append((ids[i], piece, piece * capacity, capacity, base + b, place))
        if last:
            b, place = bins.put(last, sources[i], clusters[i])
            out.append((ids[i], full, full * capacity, last, base + b, place))
        if not full and not last:
            out.append((ids[i], 0, 0, 0, None, None))
    return pa.table({f.name: pa.array(c, f.type) for f, c in zip(_ARROW, zip(*out, strict=True), strict=True)}, schema=_ARROW)


def packed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, start and length in tokens, bin_id and position in the bin."""
    tokens = word_count(text) if tokens is None else tokens
    cluster = copy_cluster(text) if cluster is None else cluster
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), tokens.cast("long").alias("tokens"), cluster.cast("long").alias("cluster"))
    total = docs.select(tokens.cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    dealt = slim.withColumn("g", F.pmod(F.xxhash64("doc_id", "cluster", "tokens"), F.lit(groups)).cast("long"))
    return dealt.groupBy("g").applyInArrow(lambda g: packed_group(g, capacity), OUT)


