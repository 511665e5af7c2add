"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: its words and how they begin, so that a
word never seen is known by its stem.  Besides a weight, each term has a short
vector; the products of these vectors over all pairs of terms in a text let a
pair count more than its two words do.  The sum over pairs is worked out from
sums over single terms.

Training takes a bounded number of labelled texts (``TRAIN_DOCS`` by
expectation, of at most ``TRAIN_CHARS`` characters) and keeps the terms whose
presence depends most on the label; all texts are scored whole.

Edge cases: null and empty texts have no terms and get the score of the bias;
repeated labels of a document count as toxic if any of them does; without both
kinds of labels every score is the share of toxic ones (0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import ALNUM, annotated, hash_spans, mix, pieces, text_bytes, word_spans

BITS, TERMS, RANK = 20, 2048, 8
#: Leading bytes that are terms of their own.
STEMS = (4, 6)
TRAIN_DOCS, TRAIN_CHARS = 12_000, 50_000
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.1, 2e-4

ADDED = "score double"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def hashed_terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, buckets of terms, range of terms of each text) for pieces of the batch."""
    data, bounds = text_bytes(texts)
    for i, j in pieces(bounds):
        norm = ALNUM[data[bounds[i] : bounds[j]]]
        starts, _, ranges = word_spans(norm, bounds[i : j + 1] - bounds[i], norm)
        terms = [hash_spans(norm, starts), *(mix(hash_spans(norm, starts, k) + np.uint64(k)) for k in STEMS)]
        yield i, j, (np.column_stack(terms).ravel() >> np.uint64(64 - BITS)).astype(np.int64), ranges * len(terms)


class Machine:
    """Weights and vectors of the chosen terms; the last row stands for no term."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, seed: int = 5):
        """``sets``: the distinct hashed terms of each training text."""
        self.number = np.full(1 << BITS, -1, np.int32)
        share = float(labels.mean()) if len(labels) else 0.0
        self.only = share if share in (0.0, 1.0) else None
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        terms = np.concatenate([np.zeros(0, np.int64), *sets])
        chosen = self._informative(terms, labels[owner] if len(owner) else np.zeros(0), len(labels), share)
        self.number[chosen] = np.arange(len(chosen))
        rng = np.random.default_rng(seed)
        self.bias = float(np.log(share / (1 - share))) if self.only is None else 0.0
        self.w = np.zeros(len(chosen))
        self.v = rng.normal(0, 0.01, (len(chosen), RANK))
        if self.only is None:
            rows = [self.number[s] for s in sets]
            self._fit([r[r >= 0] for r in rows], labels.astype(float), rng)

    @staticmethod
    def _informative(terms: np.ndarray, toxic: np.ndarray, n: int, share: float) -> np.ndarray:
        """Terms by how far their share among toxic texts is from chance."""
        if share in (0.0, 1.0):
            return np.zeros(0, np.int64)
        texts = np.bincount(terms, minlength=1 << BITS).astype(float)
        with_label = np.bincount(terms, toxic, 1 << BITS)
        expected = texts * share
        far = (with_label - expected) ** 2 / np.maximum(expected * (1 - share) * np.maximum(1 - texts / n, 1e-6), 1e-9)
        far[texts < 3] = 0
        best = np.argsort(-far, kind="stable")[:TERMS]
        return np.sort(best[far[best] > 0])

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
        """Logistic loss, adaptive steps, weights shrunk a little; the rarer toxic texts weigh more."""
        heavy = max(1.0, float(np.sqrt((1 - labels.mean()) / labels.mean())))
        gw, gv, gb = np.full_like(self.w, 1e-3), np.full_like(self.v, 1e-3), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                mine = order[at : at + BATCH]
                terms = np.concatenate([rows[i] for i in mine])
                sizes = np.array([len(rows[i]) for i in mine])
                raw, sums = self._raw(terms, sizes)
                loss = (1 / (1 + np.exp(-raw)) - labels[mine]) * np.where(labels[mine] > 0, heavy, 1) / len(mine)
                each = np.repeat(loss, sizes)
                dw = np.bincount(terms, each, len(self.w)) + DECAY * self.w
                pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - self.v[terms])
                dv = np.column_stack([np.bincount(terms, pull[:, f], len(self.w)) for f in range(RANK)]) + DECAY * self.v
                db = loss.sum()
                gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= 0.3 * RATE * dv / np.sqrt(gv)
                self.bias -= RATE * db / np.sqrt(gb)

    def _raw(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text, and the sums of its vectors."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        linear = np.bincount(owner, self.w[terms], len(sizes))
        v = self.v[terms]
        sums = np.column_stack([np.bincount(owner, v[:, f], len(sizes)) for f in range(RANK)])
        squares = np.bincount(owner, (v**2).sum(axis=1), len(sizes))
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, found: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each text."""
        n = len(ranges) - 1
        if self.only is not None:
            return np.full(n, self.only)
        terms = self.number[found]
        owner = np.repeat(np.arange(n), np.diff(ranges))
        pairs = np.unique(owner[terms >= 0] * (len(self.w) + 1) + terms[terms >= 0])
        owner, terms = pairs // (len(self.w) + 1), pairs % (len(self.w) + 1)
        raw, _ = self._raw(terms, np.bincount(owner, minlength=n))
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


def trained(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Machine:
    """A machine for the labelled rows that are not held out."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = marks.count()
    span = 1 << 30
    marks = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < min(span, int(span * train_docs / max(n, 1))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull() & (F.length("text") <= train_chars))
    # the marks are bounded by train_docs
    rows = rows.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "y")

    def sets(texts: pa.Array) -> list:
        out = []
        for i, j, found, ranges in hashed_terms(texts):
            out += [np.unique(found[ranges[k] : ranges[k + 1]]).astype(np.int32) for k in range(j - i)]
        return [pa.array(out, pa.list_(pa.int32()))]

    found = annotated(rows, "text", sets, "terms array<int>").selectExpr("row.doc_id", "row.y", "terms").toArrow().sort_by("doc_id")
    terms = found.column("terms").combine_chunks()
    ends = terms.offsets.to_numpy()
    flat = terms.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return Machine([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], found.column("y").to_numpy().astype(np.int64).clip(0, 1))


def scored(docs: DataFrame, machine: Machine, *, text: str = "text") -> DataFrame:
    """Each document as ``row`` with its score from 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def work(texts: pa.Array) -> list:
        out = np.zeros(len(texts))
        for i, j, found, ranges in hashed_terms(texts):
            out[i:j] = held.value.scores(found, ranges)
        return [pa.array(out)]

    return annotated(docs, text, work, ADDED)
