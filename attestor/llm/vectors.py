"""Helpers for tables of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.maxscore import matrix

MOST = np.iinfo(np.int64).max


@dataclass
class Span:
    """Least and greatest value, number of values and variance, to double precision, of one dimension."""

    low: int
    high: int
    n: int
    variance: float


def spans(rows: DataFrame, vector: str) -> list[Span]:
    """The span of each dimension, reduced in every task first; entries that a shorter vector lacks don't count."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            v = matrix(batch.column(0)).astype(np.int64)
            at = np.arange(v.shape[1])
            has = np.diff(batch.column(0).offsets.to_numpy())[:, None] > at
            wide = v.astype(float)
            new = pd.DataFrame({"place": at, "low": np.where(has, v, MOST).min(0, initial=MOST), "high": np.where(has, v, -MOST).max(0, initial=-MOST), "n": has.sum(0), "total": wide.sum(0), "squares": (wide**2).sum(0)})
            both = new if held is None else pd.concat([held, new])
            held = both.groupby("place", as_index=False).agg({"low": "min", "high": "max", "n": "sum", "total": "sum", "squares": "sum"})
        if held is not None:
            yield pa.RecordBatch.from_pandas(held.astype({"place": "int32", "n": "int64"}), preserve_index=False)

    parts = rows.select(vector).mapInArrow(partial, "place int, low long, high long, n long, total double, squares double")
    found = parts.groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    return [Span(r["low"], r["high"], r["n"], r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2) for r in sorted(found.collect(), key=lambda r: r["place"])]
