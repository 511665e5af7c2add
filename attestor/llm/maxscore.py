"""Exact top-k by inner product with MaxScore.

A dimension is a term, and its column of a block of vectors is its posting
list.  What a term can add to a score lies between two bounds; terms whose
bounds together cannot lift a vector to the k-th best score so far are
non-essential.  The essential lists are summed for all vectors; the others are
probed in order of their bounds, only for vectors that can still compete.
Every task keeps its best k for each query, and Spark merges them.

Edge cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part; of unequal lengths the missing components
count as zero; rows with a query's id are its own; of several rows with the
same query id the smallest vector asks; equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.llm.common import shared_folder

#: Vectors of a block, queries of one pass over the vectors, terms probed at a time.
BLOCK, QUERIES, STEP = 4096, 65_536, 8


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): finite vectors scaled to integers."""
    v = F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one matrix, filled with zeros to the widest or cut to ``width``, which loses only products with zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < width], place[place < width]] = values[place < width]
    return out


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.probed = 0

    def add(self, names: np.ndarray, vectors: np.ndarray) -> None:
        """Score a block of vectors against all queries."""
        top = int(np.abs(vectors).max(initial=0)) * int(np.abs(self.queries).max(initial=0)) * max(1, vectors.shape[1])
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64  # sums are exact
        lists = np.ascontiguousarray(vectors.T.astype(kind))
        high, low = vectors.max(axis=0, initial=-(1 << 62)), vectors.min(axis=0, initial=1 << 62)
        for i, name in enumerate(self.ids):
            scores, held = self.found[i]
            query = self.queries[i]
            if len(held) < self.k:
                at, new = np.arange(len(names)), query.astype(kind) @ lists
            else:
                at, new = self._competitive(query, lists, high, low, int(scores[-1]), kind)
            own = names[at] != name
            at, new = at[own], new[own].astype(np.int64)
            if len(at) > self.k:  # ties at the k-th place stay
                least = np.partition(new, len(new) - self.k)[len(new) - self.k]
                at, new = at[new >= least], new[new >= least]
            scores, held = np.concatenate([scores, new]), np.concatenate([held, names[at]])
            order = np.lexsort((held, -scores))[: self.k]
            self.found[i] = scores[order], held[order]

    def _competitive(self, query, lists, high, low, least, kind) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose score can reach ``least``, and their scores."""
        a, b = query * high, query * low
        most, fewest = np.maximum(a, b), np.minimum(a, b)
        order = np.argsort(fewest - most, kind="stable")  # widest bounds first
        most, fewest = most[order], fewest[order]
        # rest[j]: the most that the terms from j on can add
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)
        # a vector at its lowest in the first j terms can't compete, whatever the others add
        floor = np.append(0, np.cumsum(fewest))
        essential = int(np.argmax(floor + rest < least)) if (floor + rest < least).any() else len(order)
        terms = order[:essential]
        score = query[terms].astype(kind) @ lists[terms] if essential else np.zeros(lists.shape[1], kind)
        at = np.arange(lists.shape[1])
        for j in range(essential, len(order) + 1, STEP):
            keep = score + rest[min(j, len(order))] >= least
            at, score = at[keep], score[keep]
            terms = order[j : j + STEP]
            if not len(at) or not len(terms):
                break
            score = score + query[terms].astype(kind) @ lists[np.ix_(terms, at)]
            self.probed += len(at) * len(terms)
        keep = score >= least
        return at[keep], score[keep]


def top_k(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, queries: int = QUERIES, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every query: rows with an id divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    passes = asked.count() // queries + 1
    folder = shared_folder(spark, "topk")
    for part in range(passes):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == part).toArrow()
        ids = own.column("vec_id").to_numpy()
        held = spark.sparkContext.broadcast((ids, matrix(own.column("v"))))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = Best(*held.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, block):
                    some = batch.slice(at, block)
                    best.add(some.column(0).to_numpy(), matrix(some.column(1), best.queries.shape[1]))
            sizes = [len(s) for s, _ in best.found]
            join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, sizes)), pa.array(join(h for _, h in best.found)), pa.array(join(s for s, _ in best.found))], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(search, "query_id long, vec_id long, score long")
        found.write.parquet(f"{folder}/pass={part}")
    found = spark.read.schema("query_id long, vec_id long, score long, pass int").parquet(folder)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", "vec_id", "score", rank.alias("rank")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
