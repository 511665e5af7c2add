"""Language identification by character models with interpolated Kneser-Ney smoothing.

A text becomes lower-case letters with single blanks between them.  Every
language has a model of four-letter sequences.  All languages share sorted
arrays of hashed sequences, with one column of log-probabilities for each
language, already interpolated with the shorter sequences; a sequence that no
language has seen falls back to the next shorter one, weighted by its context.
The language with the lowest cross-entropy per letter wins.  A text is rejected
if that cross-entropy lies far above what the language's own texts have, given
the text's length.

Training takes a bounded number of labelled texts for each language
(``TRAIN_DOCS`` by expectation; a text of over ``TRAIN_CHARS`` characters counts
as several, cut at that length); all texts are predicted whole.

Edge cases: a null text or one without letters is ``und``, rejected, score 0;
equal cross-entropies go to the first language by name; without any labelled
text every text is ``und`` and none is rejected; rows with a null ``doc_id`` are predicted but never
learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import annotated, mix

ORDER = 4
TRAIN_DOCS, TRAIN_CHARS = 400, 20_000
#: Characters that are scored at a time.
PIECE_CHARS = 2_000_000
#: How far above its language's mean a long text may lie, in nats for each letter, and in standard deviations more for a short one.
MARGIN, DEVIATIONS = 1.2, 6.0
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK = 1

ADDED = "lang_pred string, score double, cross_entropy double, rejected boolean"


@cache
def letters() -> np.ndarray:
    """For every code point: is it a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, each behind three marks; the bounds of each text; its number of letters."""
    lowered = [(t or "").lower() for t in texts]
    sizes = np.array([len(t) + ORDER - 1 for t in lowered], np.int64)
    starts = np.cumsum(sizes) - sizes
    joined = ("\x01" * (ORDER - 1)).join(["", *lowered])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    for k in range(ORDER - 1):
        codes[starts + k] = _MARK
    gap = codes == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    at = np.append(0, np.cumsum(keep))
    bounds = at[np.append(starts, len(codes))]
    n = np.append(0, np.cumsum(is_letter))
    ends = np.append(starts[1:], len(codes))
    return codes[keep].astype(np.uint64), bounds, n[ends] - n[starts]


def hash_ending(codes: np.ndarray, m: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the m codes that end at each place, or at the given places; the first places of all have none."""
    out, power = np.zeros(len(codes) if at is None else len(at), np.uint64), np.ones(1, np.uint64)
    for k in range(m):
        if at is None:
            out[k:] += codes[: len(codes) - k] * power
        else:
            out += codes[at - k] * power
        power = power * _STEP
    return mix(out + np.uint64(m))


class Hashes:
    """A sorted array of hashes, entered by the leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.shift = np.uint64(64 - max(1, min(22, 3 + len(keys).bit_length())))
        self.first = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        last = len(self.keys) - 1
        at = np.minimum(self.first[wanted >> self.shift], last)
        found = self.keys[at] == wanted
        other = np.flatnonzero(~found)
        at[other] = np.minimum(np.searchsorted(self.keys, wanted[other]), last)
        found[other] = self.keys[at[other]] == wanted[other]
        return at, found


class Model:
    """Sorted hash arrays of sequences and contexts, with a column for each language."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]]):
        """``grams``: for each language the four-code sequences, one a row, and their counts."""
        self.langs = langs
        self.mean, self.noise = np.zeros(len(langs)), np.ones(len(langs))
        known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g[:, -1] for g, _ in grams)]))
        self.base = 1.0 / (len(known) + 1)
        tables = [self._smoothed(g, c) for g, c in grams]
        self.grams, self.logp, self.contexts, self.weights = {}, {}, {}, {}
        for m in range(1, ORDER + 1):
            self.contexts[m] = Hashes(np.unique(np.concatenate([np.zeros(0, np.uint64), *(t[m][2] for t in tables)])))
            self.weights[m] = np.zeros((len(self.contexts[m].keys), len(langs)), np.float32)
            for k, t in enumerate(tables):
                self.weights[m][self.contexts[m].find(t[m][2])[0], k] = np.log(t[m][3])
            rows = np.unique(np.concatenate([np.zeros((0, m), np.uint64), *(t[m][0] for t in tables)]), axis=0)
            lower = self._lower(rows, m)
            self.grams[m] = Hashes(hash_rows(rows))
            place = self.grams[m].find(hash_rows(rows))[0]
            self.logp[m] = np.zeros((len(rows), len(langs)), np.float32)
            self.logp[m][place] = lower
            for k, t in enumerate(tables):
                own = self.grams[m].find(hash_rows(t[m][0]))[0]
                self.logp[m][own, k] = np.log(t[m][1] + np.exp(self.logp[m][own, k]))

    def _smoothed(self, grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple]:
        """For each order: sequences, their discounted share, context hashes, weight left for the lower order."""
        out = {}
        for m in range(ORDER, 0, -1):
            counts = counts.astype(np.float64)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            heads = hash_rows(grams[:, :-1])
            context, at = np.unique(heads, return_inverse=True)
            total = np.bincount(at, counts, len(context))
            kinds = np.bincount(at, minlength=len(context))
            out[m] = (grams, np.maximum(counts - discount, 0) / total[at], context, discount * kinds / total)
            grams, counts = np.unique(grams[:, 1:], axis=0, return_counts=True)  # how many letters stand before
        return out

    def _lower(self, rows: np.ndarray, m: int) -> np.ndarray:
        """What the context's weight and the lower order give each sequence, as logs."""
        weight = self._weight(m, hash_rows(rows[:, :-1]))
        if m == 1:
            return weight + np.float32(np.log(self.base))
        at, _ = self.grams[m - 1].find(hash_rows(rows[:, 1:]))
        return weight + self.logp[m - 1][at]

    def _weight(self, m: int, contexts: np.ndarray) -> np.ndarray:
        at, found = self.contexts[m].find(contexts)
        return self.weights[m][at] * found[:, None] if len(self.weights[m]) else np.zeros((len(contexts), len(self.langs)), np.float32)

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of each code, a column for each language; zero for marks."""
        at, found = self.grams[ORDER].find(hash_ending(codes, ORDER))
        out = self.logp[ORDER][at] if len(self.logp[ORDER]) else np.zeros((len(codes), len(self.langs)), np.float32)
        out[codes == _MARK] = 0
        left = np.flatnonzero(~found & (codes != _MARK))
        out[left] = 0
        for m in range(ORDER, 0, -1):
            out[left] += self._weight(m, hash_ending(codes, m - 1, left - 1))
            if m == 1:
                out[left] += np.float32(np.log(self.base))
                break
            at, found = self.grams[m - 1].find(hash_ending(codes, m - 1, left))
            out[left[found]] += self.logp[m - 1][at[found]]
            left = left[~found]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of each text under each language, its scored codes and its letters."""
        codes, bounds, n_letters = normalised(texts)
        logs = self.log_probabilities(codes)
        sums = np.add.reduceat(logs, bounds[:-1], axis=0, dtype=np.float64) if len(texts) else np.zeros((0, len(self.langs)))
        n = np.diff(bounds) - (ORDER - 1)
        return -sums / np.maximum(n, 1)[:, None], n, n_letters

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Mean cross-entropy of each language's own texts, and how much it varies for a single letter."""
        own = np.array([self.langs.index(x) for x in langs], np.int64)
        some = [self.entropies(texts[i : i + 128]) for i in range(0, len(texts), 128)]  # a few at a time, to hold little
        found, n = np.concatenate([x[0] for x in some] or [np.zeros((0, len(self.langs)))]), np.concatenate([x[1] for x in some] or [np.zeros(0, np.int64)])
        for k in range(len(self.langs)):
            mine = np.flatnonzero((own == k) & (n > 0))
            if not len(mine):
                continue
            e, size = found[mine, k], n[mine]
            self.mean[k] = np.average(e, weights=size)
            self.noise[k] = max(1.0, 1.48 * float(np.median(np.abs(e - self.mean[k]) * np.sqrt(size))))

    def judged(self, texts: list[str | None]) -> list[tuple]:
        """(language, score, cross-entropy, rejected) of each text."""
        if not self.langs:
            return [(UNKNOWN, 0.0, None, False)] * len(texts)
        found, n, n_letters = self.entropies(texts)
        best = found.argmin(axis=1)
        lowest = found[np.arange(len(texts)), best]
        odds = np.exp(-(found - lowest[:, None]) * np.minimum(n, 100)[:, None])
        score = 1.0 / odds.sum(axis=1)
        limit = self.mean[best] + MARGIN + DEVIATIONS * self.noise[best] / np.sqrt(np.maximum(n, 1))
        rows = zip(best.tolist(), score.tolist(), lowest.tolist(), (lowest > limit).tolist(), n_letters.tolist(), strict=True)
        return [(self.langs[b], s, e, r) if k else (UNKNOWN, 0.0, None, True) for b, s, e, r, k in rows]


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """The hash that ``hash_ending`` gives for the same codes."""
    out, power = np.zeros(len(rows), np.uint64), np.ones(1, np.uint64)
    for k in range(rows.shape[1] - 1, -1, -1):
        out = out + rows[:, k] * power
        power = power * _STEP
    return mix(out + np.uint64(rows.shape[1]))


def held_out(doc_id: str = "doc_id", of: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == part, F.lit(False))


def trained(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> Model:
    """A model of every language named in the rows that are not held out.

    Longer texts are read as pieces of ``train_chars``, so a language of long
    texts is learned like any other; about ``train_docs`` pieces of each are read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    pieces = F.greatest(F.ceil(F.length("text") / train_chars), F.lit(1)).cast("int")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(pieces).alias("n")).collect()}  # one row for each language
    langs = sorted(counts)
    if not langs:
        return Model([], [])
    span = 1 << 30
    limits = F.create_map(*[F.lit(x) for k in langs for x in (k, min(span, int(span * train_docs / counts[k])))])
    part = F.explode(F.filter(F.sequence(F.lit(0), pieces - 1), lambda k: F.pmod(F.when(k == 0, F.xxhash64("doc_id")).otherwise(F.xxhash64("doc_id", k)), F.lit(span)) < limits[F.col("lang")]))
    chosen = rows.select("lang", "text", part.alias("part")).select("lang", F.substring("text", F.col("part") * train_chars + 1, F.lit(train_chars)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in set(batch.column(0).to_pylist()):
                mine = batch.filter(pc.equal(batch.column(0), name))
                codes, _, _ = normalised(mine.column(1).to_pylist())
                if len(codes) < ORDER:
                    continue
                grams = np.column_stack([codes[k : len(codes) - ORDER + 1 + k] for k in range(ORDER)])
                grams, n = np.unique(grams[grams[:, -1] != _MARK], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), *(pa.array(grams[:, k].astype(np.int32)) for k in range(ORDER)), pa.array(n)], names=["lang", "a", "b", "c", "d", "n"])

    found = chosen.select("lang", "text").mapInArrow(count, "lang string, a int, b int, c int, d int, n long")
    found = found.groupBy("lang", "a", "b", "c", "d").agg(F.sum("n").alias("n")).orderBy("lang", "a", "b", "c", "d").toArrow()
    grams = []
    for k in langs:
        own = found.filter(pc.equal(found.column("lang"), k))
        grams.append((np.column_stack([own.column(c).to_numpy().astype(np.uint64) for c in "abcd"]), own.column("n").to_numpy()))
    model = Model(langs, grams)
    texts = chosen.select("text", "lang").collect()  # bounded by the two limits
    model.calibrate([r["text"] for r in texts], [r["lang"] for r in texts])
    return model


def identified(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Each document as ``row`` with its language, score, cross-entropy and whether it is rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list:
        out: list[tuple] = []
        some: list = []
        size = 0
        for t in texts:
            some.append(t.as_py())
            size += len(some[-1] or "") + ORDER
            if size >= PIECE_CHARS:
                out += held.value.judged(some)
                some, size = [], 0
        if some:
            out += held.value.judged(some)
        cols = list(zip(*out, strict=True)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]

    return annotated(docs, text, work, ADDED)


def accepted(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with their own columns only."""
    return identified(docs, model, text=text).filter(~F.col("rejected")).select("row.*")
