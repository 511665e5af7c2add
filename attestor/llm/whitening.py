"""Whitening of vectors from exact, bit-sliced cross-products.

Every component becomes an integer.  Shifted to start at zero, the values of a
dimension are cut into bit planes, each packed across rows into 64-bit words.
The cross-product of two dimensions is the sum over pairs of planes of
2^(b+c) times the number of rows with both bits set, an AND and a popcount.
Tasks fold these counts into a few 64-bit limbs for each pair of dimensions,
Spark adds them up, and centring takes place in whole numbers of any size, so
the covariance is exact before the one rounding that eigh needs.

Edge cases: rows whose vector is null, or holds null or non-finite entries, or
one beyond 2^50 in size, take no part; the fit is over vectors of the most
common length (of equals the longer), the others take no part; rows without an
id are rows like others; repeated rows count one by one.  A component whose
variance is zero to double precision has a null ``whitened``, and where no
dimension varies ``explained`` is null; ``identity_error`` covers the other
components and is zero if there are none.  A deviation beyond 64 bits is null.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.llm.maxscore import matrix
from attestor.llm.vectors import spans

#: Scale and offset of a component's integer; greatest size of a component.
SCALE, OFFSET, LARGEST = 64.0, 1_000_000, float(1 << 50)
#: Rows sliced at a time, bits of a limb: counts of up to 2^40 rows fit.
ROWS, LIMB = 16_384, 16


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x): vectors that take part, as integers."""
    fits = F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST), F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long") + OFFSET)
    found = rows.filter(F.col(vector).isNotNull() & fits).select(F.col(key).alias("id"), whole.alias("x"))
    sizes = found.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    return found.filter(F.size("x") == (sizes[0]["size"] if sizes else 0))


def sliced(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Bit planes of the columns of ``y``, lowest bit first: a row of packed words for each."""
    planes = [np.packbits((y[:, d] >> np.uint64(b)) & np.uint64(1) != 0) for d, n in enumerate(bits) for b in range(n)]
    words = -(-len(y) // 64) * 8
    out = np.zeros((len(planes), words), np.uint8)
    for i, p in enumerate(planes):
        out[i, : len(p)] = p
    return out.view(np.uint64)


def plane_counts(planes: np.ndarray) -> np.ndarray:
    """Rows in which both planes have their bit, for each pair of planes p <= q."""
    out = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        out[p, p:] = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
    return out


def scattered(rows: DataFrame, low: np.ndarray, bits: np.ndarray) -> DataFrame:
    """(i, j, limb, total): parts of the cross-products of dimensions i <= j, and with j = -1 of the sums of dimension i."""
    dims = np.repeat(np.arange(len(bits)), bits)
    bit = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in bits]]).astype(np.int64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(dims), len(dims)), np.int64)
        for batch in batches:
            y = (matrix(batch.column(0)) - low).astype(np.uint64)
            for at in range(0, len(y), ROWS):
                counts += plane_counts(sliced(y[at : at + ROWS], bits))
        p, q = np.triu_indices(len(dims))
        power = bit[p] + bit[q]
        twice = (dims[p] == dims[q]) & (p != q)
        # pairs of planes, then planes alone
        i, j = np.append(dims[p], dims), np.append(dims[q], np.full(len(dims), -1))
        power = np.append(power + twice, bit)
        value = np.append(counts[p, q], counts.diagonal()) << (power % LIMB)
        keys, place = np.unique(np.stack([i, j, power // LIMB]), axis=1, return_inverse=True)
        total = np.zeros(keys.shape[1], np.int64)
        np.add.at(total, place.ravel(), value)
        yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in keys), pa.array(total)], names=["i", "j", "limb", "total"])

    found = rows.select("x").mapInArrow(partial, "i int, j int, limb int, total long")
    return found.groupBy("i", "j", "limb").agg(F.sum("total").alias("total"))


@dataclass
class Whitening:
    """Exact sums of the fit and its components, by falling variance."""

    n: int
    low: np.ndarray
    sums: list[int]  # of the shifted values
    covariance: np.ndarray
    values: np.ndarray
    axes: np.ndarray

    @property
    def total(self) -> float:
        return float(np.trace(self.covariance))

    def scaled_axes(self) -> np.ndarray:
        """An axis per column, over the root of its variance; nan where there is none."""
        least = 100 * np.finfo(float).eps * len(self.low) * max(self.values.max(initial=0.0), 0.0)
        fine = self.values > least
        return self.axes / np.sqrt(np.where(fine, self.values, np.nan))

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return ((x - self.low).astype(float) - mean) @ self.scaled_axes()

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of squares of n*x - S; those beyond 64 bits are null."""
        y = x - self.low
        about = ((self.n * y.astype(float) - np.array(self.sums, float)) ** 2).sum(1)
        wrapped = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in self.sums], np.int64)
        away = np.int64(self.n) * y - wrapped
        exact = (away * away).sum(1)  # right modulo 2^64, so right wherever the result fits
        bound, beyond = float(1 << 63), np.zeros(len(y), bool)
        beyond[about > bound * 1.001] = True
        for k in np.flatnonzero(~beyond & (about > bound * 0.999)):
            beyond[k] = sum((self.n * v - s) ** 2 for v, s in zip(y[k].tolist(), self.sums, strict=True)) >= 1 << 63
        return pa.array(exact, mask=beyond)


def fitted(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of ``rows`` (x); None without rows or dimensions."""
    found = spans(rows, "x")
    if not found:
        return None
    n, low = found[0].n, np.array([s.low for s in found], np.int64)
    bits = np.array([(s.high - s.low).bit_length() for s in found])
    cross, sums = np.zeros((len(low), len(low)), object), [0] * len(low)
    for r in scattered(rows, low, bits).toArrow().to_pylist():  # a few for each pair of dimensions
        part = r["total"] << (LIMB * r["limb"])
        if r["j"] < 0:
            sums[r["i"]] += part
        else:
            cross[r["i"], r["j"]] += part
    covariance = np.zeros(cross.shape)
    for i in range(len(low)):
        for j in range(i, len(low)):
            covariance[i, j] = covariance[j, i] = (n * cross[i, j] - sums[i] * sums[j]) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    return Whitening(n, low, sums, covariance, values[::-1][:components].copy(), axes[:, ::-1][:, :components].copy())


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened rows, less the identity."""
    fine = np.flatnonzero(~np.isnan(model.scaled_axes()).any(0))
    if not len(fine):
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fine) + 1, len(fine)))
        for batch in batches:
            w = model.project(matrix(batch.column(0)))[:, fine]
            total += np.vstack([w.T @ w, w.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "total"])

    cells = rows.select("x").mapInArrow(partial, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total")).orderBy("cell")
    total = np.array([r["total"] for r in cells.collect()]).reshape(len(fine) + 1, len(fine)) / model.n
    return float(np.abs(total[:-1] - np.outer(total[-1], total[-1]) - np.eye(len(fine))).max())


def whitened(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = usable(vectors, key, vector)
    model = fitted(rows, components)
    shape = T.StructType([rows.schema["id"], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if model is None:
        return rows.sparkSession.createDataFrame([], shape)
    error = identity_error(rows, model)
    count = len(model.values)
    explained = np.maximum(model.values, 0) / model.total if model.total else np.full(count, np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            at = pa.array(np.repeat(np.arange(len(x)), count))
            out = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), model.n)), model.deviations(x).take(at)]
            out += [pa.array(c, from_pandas=True) for c in (model.project(x).ravel(), np.tile(explained, len(x)), np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(out, names=shape.names)

    return rows.mapInArrow(project, shape)
