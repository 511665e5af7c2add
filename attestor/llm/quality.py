"""Quality by a word model with interpolated modified Kneser-Ney smoothing.

Models of three-word sequences are trained on trusted text: all words of all
documents labelled 1.  Documents fall into two halves by their id, and a model
is counted from each; a document is scored by the model of the other half, so
that no model has seen what it scores and every trusted document serves both
the counts and the thresholds.

Sequences are known by 64-bit keys.  Trusted text is counted slice by slice of
the keys, each sequence once with its first two words and once with its last
two; a model is a table of sorted, packed runs of keys and counts, dealt into
shards by the leading bits of the key and bucketed by shard.  Documents are
scored group by group: they lie in blocks, a block asks each shard once for the
keys of its distinct sequences, and the answers meet the block's texts again.
Neither the driver nor a task holds a model, and what a slice or a group sends
leaves the disk with it.  A document is kept if its perplexity does not exceed
a quantile of all trusted documents of its language, times a margin.

Edge cases: a null or empty text has no words, a null perplexity and is kept; a
language (null included) without trusted text has no threshold and its
documents are kept; repeated labels of a document count as trusted only if all
of them are 1; where the other half has no trusted text, the perplexity is null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import hashed_words, lowered_table, mix, shared_folder, stored

#: Words are anything between ASCII white space; case counts.
CASED = lowered_table(lambda b: b != 32 and not 9 <= b <= 13)
CASED[65:91] = np.arange(65, 91)

QUANTILE, MARGIN = 0.99, 1.25
#: Bytes of text of one block of documents, and for each shard of the models.
BLOCK, PER_SHARD = 4 << 20, 64 << 20
LEAST_SHARDS = 16
#: Parts in which trusted text is found, its sequences are counted and documents are scored; what a part sends is on disk meanwhile.
TEXT_GROUPS, SLICES, GROUPS = 2, 5, 9
#: Words or sequences that a task holds before it sends them.
HELD = 1 << 20
#: Hashes of one shard of the arrays.
SHARD = 1 << 18
_SPAN = 1 << 30
_BEGIN = 1  # stands in front of the first word


def combined(*hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


def with_history(words: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one and two places before each, within its text."""
    begin = np.uint64(_BEGIN)
    one, two = np.roll(words, 1), np.roll(words, 2)
    starts = ranges[:-1][np.diff(ranges) > 0]
    one[starts] = begin
    two[starts] = begin
    second = starts + 1
    two[second[second < len(words)]] = begin
    return one, two


class Shards:
    """Sorted hash arrays of (hash, values), dealt by the leading bits of the hash."""

    def __init__(self, hashes: np.ndarray, *values: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.bits = max(0, (len(hashes) // SHARD).bit_length())
        hashes = hashes[order]
        edges = np.searchsorted(hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits) if self.bits else np.zeros(1, np.uint64))
        edges = np.append(edges, len(hashes))
        self.parts = [(hashes[a:b], [v[order][a:b] for v in values]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.width = len(values)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which hashes are there, and their values (zero for the others)."""
        found, out = np.zeros(len(wanted), bool), [np.zeros(len(wanted), np.float32) for _ in range(self.width)]
        order = np.argsort(wanted)  # sorted probes stay in the processor's cache
        asked = wanted[order]
        if self.bits:
            edges = np.searchsorted(asked, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        else:
            edges = np.zeros(0, np.int64)
        for (hashes, values), mine in zip(self.parts, np.split(order, edges), strict=True):
            if not len(hashes) or not len(mine):
                continue
            at = np.minimum(np.searchsorted(hashes, wanted[mine]), len(hashes) - 1)
            same = hashes[at] == wanted[mine]
            found[mine] = same
            for o, v in zip(out, values, strict=True):
                o[mine] = np.where(same, v[at], 0)
        return found, out


class Model:
    """Discounted shares of sequences and weights of contexts, for three, two and one words."""

    def __init__(self, shares: dict[int, Shards], weights: dict[int, Shards], rest: float, kinds: int):
        self.shares, self.weights, self.rest, self.kinds = shares, weights, rest, kinds

    def probabilities(self, words: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        p = self.shares[1].find(words)[1][0] + self.rest / (self.kinds + 1)
        for order, context, gram in ((2, (one,), (one, words)), (3, (two, one), (two, one, words))):
            known, (weight,) = self.weights[order].find(combined(*context))
            (share,) = self.shares[order].find(combined(*gram))[1]
            p = np.where(known, share + weight * p, p)
        return p

    def log_probs(self, words: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """Summed natural log-probability of each text."""
        logs = np.log(self.probabilities(words, *with_history(words, ranges)).astype(np.float64)) if len(words) else np.zeros(0)
        sums = np.append(0, np.cumsum(logs))
        return sums[ranges[1:]] - sums[ranges[:-1]]


def trusted_ids(labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("q")).filter(F.col("doc_id").isNotNull() & F.col("q").isNotNull())
    return marks.groupBy("doc_id").agg(F.min("q").alias("q")).filter("q = 1").select("doc_id")


def chosen(n: int, train_docs: int) -> Column:
    """Whether a trusted document is one of about ``train_docs`` of ``n``, from the first half at most."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)) < min(_SPAN // 2, int(_SPAN * train_docs / max(n, 1)))


def half() -> Column:
    """0 or 1, by the id."""
    return (F.pmod(F.xxhash64("doc_id"), F.lit(_SPAN)) >= _SPAN // 2).cast("int")


def _counted(rows: DataFrame) -> dict[int, DataFrame]:
    """(part, words, n) of sequences of three, two and one words from (part, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, words, ranges in hashed_words(batch.column(1), CASED):
                one, two = with_history(words, ranges)
                part = np.repeat(batch.column(0).to_numpy()[i : i + len(ranges) - 1], np.diff(ranges))
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x.view(np.int64)) for x in (np.ascontiguousarray(two), one, words))], names=["part", "a", "b", "c"])

    grams = rows.select("part", "text").mapInArrow(count, "part int, a long, b long, c long")
    three = stored(grams.groupBy("part", "a", "b", "c").agg(F.count("*").alias("n")), "grams")
    two = stored(three.groupBy("part", "b", "c").agg(F.count("*").alias("n")), "pairs")
    return {3: three, 2: two, 1: two.groupBy("part", "c").agg(F.count("*").alias("n"))}


#: Words before the last one, and all words, of the sequences of each order.
LEVELS = {3: (["a", "b"], ["a", "b", "c"]), 2: (["b"], ["b", "c"]), 1: ([], ["c"])}


def _cuts(times: dict[int, int]) -> list[float]:
    """The three discounts of modified Kneser-Ney, from how many sequences occur once, twice, three and four times."""
    n1, n2, n3, n4 = (float(times.get(k, 0)) for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = min(0.95, max(0.05, 1 - 2 * y * n2 / n1)) if n1 else 0.5
    d2 = min(1.9, max(d1, 2 - 3 * y * n3 / n2)) if n2 else d1
    d3 = min(2.9, max(d2, 3 - 4 * y * n4 / n3)) if n3 else d2
    return [d1, d2, d3]


def _discounted(grams: DataFrame, context: list[str], gram: list[str]) -> tuple[DataFrame, DataFrame]:
    """(part, sequence, share) and (part, context, weight) from (part, sequence, n) by joins of the count tables."""
    times = {0: {}, 1: {}}
    for r in grams.filter("n <= 4").groupBy("part", "n").agg(F.count("*").alias("k")).collect():  # eight rows at most
        times[r["part"]][r["n"]] = r["k"]
    of = [F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3) for d1, d2, d3 in (_cuts(times[0]), _cuts(times[1]))]
    cut = F.when(F.col("part") == 0, of[0]).otherwise(of[1])
    on = ["part", *context]
    totals = grams.groupBy(*on).agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
    # totals of all words are a row for each half
    shares = grams.join(totals if context else F.broadcast(totals), on).select("part", *gram, (F.greatest(F.lit(0.0), F.col("n") - cut) / F.col("total")).cast("float").alias("share"))
    return shares, totals.select(*on, (F.col("cut") / F.col("total")).cast("float").alias("weight"))


def _trusted(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(ids, "doc_id")


def trained(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", train_docs: int) -> Model | None:
    """A model in memory, for texts at hand, of about ``train_docs`` trusted documents of the first half; None without any.

    ``judged`` does not use it: it takes all trusted text and holds no model.
    """
    ids = trusted_ids(labels)
    counts = _counted(_trusted(docs, ids.filter(chosen(ids.count(), train_docs)), doc_id, text).withColumn("part", F.lit(0)))
    cols = lambda t, names: [t.column(n).to_numpy().view(np.uint64) for n in names]
    shares, weights, rest, kinds = {}, {}, 1.0, 0
    for order, (context, gram) in LEVELS.items():
        share, weight = (x.toArrow() for x in _discounted(counts[order], context, gram))
        if not share.num_rows:
            return None
        keys = cols(share, gram)
        shares[order] = Shards(combined(*keys) if order > 1 else keys[0], share.column("share").to_numpy())
        if context:
            weights[order] = Shards(combined(*cols(weight, context)), weight.column("weight").to_numpy())
        else:
            rest, kinds = float(weight.column("weight")[0].as_py()), share.num_rows
    return Model(shares, weights, rest, kinds)


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _keys(part: int, *words: np.ndarray) -> np.ndarray:
    """Keys of words or pairs of words in the model of a half."""
    out = combined(np.full(1, part + 2, np.uint64))
    for w in words:
        out = mix(out * _GOLDEN + w)
    return out




def _triples(context: np.ndarray, pair: np.ndarray, bits: int) -> np.ndarray:
    """Keys of three words, from the keys of the first two, whose shard and slice they share, and of the last two."""
    lead = np.uint64(bits + 8)
    return (context >> (np.uint64(64) - lead) << (np.uint64(64) - lead)) | (combined(context, pair) >> lead)


def _slices(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slice of each key, from the eight bits behind those of its shard."""
    return ((keys >> np.uint64(56 - bits)) & np.uint64(255)).astype(np.uint8) % SLICES


_BACK = [np.uint64(pow(c, -1, 1 << 64)) for c in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def _before(part: int, words: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before each, and the keys of (two before, one before) and (one before, word)."""
    begin, starts = np.full(1, _BEGIN, np.uint64), ranges[:-1][np.diff(ranges) > 0]
    one = np.roll(words, 1)
    one[starts] = _BEGIN
    pair = mix(_keys(part, one) * _GOLDEN + words)
    context = np.roll(pair, 1)
    context[starts] = _keys(part, begin, begin)
    return one, context, pair


def _last_word(part: int, first: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The second word of a pair, from its key and its first word: ``mix`` has an inverse."""
    x = pair ^ (pair >> np.uint64(31)) ^ (pair >> np.uint64(62))
    x = x * _BACK[0]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _BACK[1]
    x = x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x - _keys(part, first) * _GOLDEN


def _pack(*columns: np.ndarray, rising: bool = False) -> bytes:
    """Columns of whole numbers as one compressed run of bytes; leading zero bytes take no room.  The first column may be ``rising``."""
    n, widths, planes = len(columns[0]), [], []
    for k, x in enumerate(columns):
        x = np.ascontiguousarray(x).astype("<u8", copy=False)
        if rising and not k:
            x = np.diff(x, prepend=np.uint64(0))
        widths.append((int(x.max()).bit_length() + 7) // 8 if n else 0)
        planes.append(x.view(np.uint8).reshape(n, 8)[:, : widths[-1]].T.tobytes())
    raw = np.array([rising, len(columns), n, *widths], "<i8").tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: pa.BinaryScalar) -> list[np.ndarray]:
    data = memoryview(data.as_buffer())
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    rising, width, n = np.frombuffer(raw, "<i8", 3)
    at, out = 8 * (3 + width), []
    for w in np.frombuffer(raw, "<i8", width, 24):
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = np.frombuffer(raw, np.uint8, w * n, at).reshape(w, n).T
        out.append(x.view("<u8")[:, 0])
        at += w * n
    if rising:
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _joined(blobs: pa.ChunkedArray, width: int) -> list[np.ndarray]:
    """The columns of packed runs, one after the other."""
    found = [_unpack(x) for x in blobs]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.uint64)] * width


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ones."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys; how many of their counts are one, two and more, and the sum of the latter; a row of each key."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = _firsts(keys)
    return keys[at], [_sums(x, at) for x in (counts == 1, counts == 2, counts > 2, np.where(counts > 2, counts, 0))], order[at]


def _merged(left: np.ndarray, n: np.ndarray, right: np.ndarray, stats: list[np.ndarray]) -> list[np.ndarray]:
    """(key, n, stats) of distinct keys that have an n, stats or both."""
    keys = np.union1d(left, right)
    out = [keys, *(np.zeros(len(keys), np.uint64) for _ in range(1 + len(stats)))]
    out[1][np.searchsorted(keys, left)] = n
    for x, s in zip(out[2:], stats, strict=True):
        x[np.searchsorted(keys, right)] = s
    return out


#: Kinds of packed rows: what is known of sequences of one, two and three words, how many of these occur n times, and what words add up to.
TIMES, WORDS = 0, 4
#: Columns behind a key or a word, the first of them for three words.  n is the count of a sequence; the others belong to those that it begins:
#: how many occur once, twice and more often, and the sum of the latter.
STATS = ["n", "ones", "twos", "more", "often"]
_ROW = "slice int, kind int, shard int, data binary"
_TEXTS = "words binary, numbers binary, lengths binary"


def _row(shard: int, slice_: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    n = len(rows)
    return pa.table([pa.array([slice_] * n, pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([shard] * n, pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["slice", "kind", "shard", "data"])


def _packed_texts(rows: DataFrame) -> DataFrame:
    """The words of (text) as packed runs: their distinct hashes, frequent ones first, the number of each word and the lengths of the texts."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        words, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
        words, number, times = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        data = [_pack(x) for x in (words[order], rank[number], lengths)]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], names=["words", "numbers", "lengths"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, _, words, ranges in hashed_words(batch.column(0), CASED):
                held.append((words, np.diff(ranges)))
                n += len(words)
                if n >= HELD:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    return rows.select("text").mapInArrow(work, _TEXTS)


def _slice_counts(texts: DataFrame, part: int, k: int, bits: int) -> DataFrame:
    """Packed rows of one slice of the keys, counted from all packed texts of a half.

    A sequence of three words goes to the shard of its first two, to be counted
    and summed up for them, and to that of its last two, whose count it adds to.
    """
    shift = np.uint64(64 - bits)

    def dealt(kind: int, key: np.ndarray, other: np.ndarray, first: np.ndarray | None) -> Iterator[tuple[int, int, bytes]]:
        # by shard, equal ones side by side
        order = np.argsort((key & np.uint64(0xFFFFFF << 40)) | (combined(key, other) >> np.uint64(24)))
        key, other = key[order], other[order]
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])))
        last = np.diff(np.append(at, len(key))) if first is None else first[order][at]
        key, other = key[at], other[at]
        shards = (key >> shift).astype(np.int32)
        edges = np.append(_firsts(shards), len(shards))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(shards[a]), kind, _pack(key[a:b], other[a:b], last[a:b])

    def flushed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        one, context, pair = (np.concatenate(x) for x in zip(*held, strict=True))
        begun, ended = (_slices(x, bits) == k for x in (context, pair))
        out = [*dealt(0, context[begun], pair[begun], None)] if begun.any() else []
        if ended.any():
            out += dealt(1, pair[ended], context[ended], one[ended])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["shard", "kind", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in zip(*(batch.column(i) for i in range(3)), strict=True):
                (words,), (numbers,), (lengths,) = (_unpack(x) for x in data)
                one, context, pair = _before(part, words[numbers.astype(np.int64)], np.append(0, np.cumsum(lengths.astype(np.int64))))
                own = (_slices(context, bits) == k) | (_slices(pair, bits) == k)
                held.append((one[own], context[own], pair[own]))
                n += len(held[-1][0])
                if n >= HELD:
                    yield flushed(held)
                    held, n = [], 0
        if n:
            yield flushed(held)

    def count(table: pa.Table) -> pa.Table:
        kinds, shard = table.column("kind").to_numpy(), table.column("shard")[0].as_py()
        blobs = lambda kind: table.column("data").filter(pa.array(kinds == kind))
        context, pair, n = _joined(blobs(0), 3)
        keys = _triples(context, pair, bits)
        order = np.argsort(keys)
        keys, at = keys[order], _firsts(keys[order])
        n, context, keys = _sums(n[order], at), context[order][at], keys[at]
        begun, stats, _ = _grouped(context, n)
        out = [(3, _pack(keys, n, rising=True))]
        pair, context, first = _joined(blobs(1), 3)
        _, at = np.unique(combined(pair, context), return_index=True)
        pair, first = pair[at], first[at]
        order = np.argsort(pair)
        at = _firsts(pair[order])
        pair, first, befores = pair[order][at], first[order][at], np.diff(np.append(at, len(order)))
        out.append((2, _pack(*_merged(pair, befores, begun, stats), rising=True)))
        for words, counts in ((3, n), (2, befores)):
            seen = np.bincount(counts[counts <= 4].astype(np.int64), minlength=5)[1:]
            out.append((TIMES, _pack(np.full(4, part), np.full(4, words), np.arange(1, 5), seen)))
        begun, stats, _ = _grouped(first, befores)
        own = _merged(*np.unique(_last_word(part, first, pair), return_counts=True), begun, stats)
        out.append((WORDS, _pack(*own)))
        return _row(shard, part * SLICES + k, out)

    sent = texts.mapInArrow(send, "shard int, kind int, data binary")
    return sent.groupBy("shard").applyInArrow(count, _ROW)


def _added(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the other columns for each distinct value of the first."""
    order = np.argsort(columns[0])
    at = _firsts(columns[0][order])
    return [columns[0][order][at], *(_sums(x[order], at) for x in columns[1:])]


def _word_entries(model: DataFrame, part: int, bits: int) -> DataFrame:
    """Packed rows of the single words of a half, and how many occur n times; n is 0 for all of them and 5 for their sum."""

    def flushed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        words, *stats = (np.concatenate(x) for x in zip(*held, strict=True))
        columns = _added([_keys(part, words), *stats])
        shards = (columns[0] >> np.uint64(64 - bits)).astype(np.int32)
        edges = np.append(_firsts(shards), len(shards))
        data = [_pack(*(x[a:b] for x in columns), rising=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(shards[edges[:-1]]), pa.array(data, pa.binary())], names=["shard", "data"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for x in batch.column(0):
                held.append(_unpack(x))
                n += len(held[-1][0])
                if n >= HELD:
                    yield flushed(held)
                    held, n = [], 0
        if n:
            yield flushed(held)

    def pack(table: pa.Table) -> pa.Table:
        own = _added(_joined(table.column("data"), 1 + len(STATS)))
        n = own[1][own[1] > 0]
        seen = np.bincount(n[n <= 4].astype(np.int64), minlength=5)
        times = _pack(np.full(6, part), np.full(6, 1), np.arange(6), np.array([len(n), *seen[1:], int(n.sum())]))
        return _row(table.column("shard")[0].as_py(), part * SLICES, [(1, _pack(*own, rising=True)), (TIMES, times)])

    sent = model.filter(F.col("kind") == WORDS).select("data").mapInArrow(deal, "shard int, data binary")
    return sent.groupBy("shard").applyInArrow(pack, _ROW)


def _times(model: DataFrame) -> DataFrame:
    """part, words, n, k: so many sequences of so many words occur n times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in _unpack(x)], names=["part", "words", "n", "k"])

    found = model.filter(F.col("kind") == TIMES).select("data").mapInArrow(work, "part long, words long, n long, k long")
    return found.groupBy("part", "words", "n").agg(F.sum("k").alias("k"))


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a written result go as soon as it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def _dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this run has written and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Counted:
    """Counts of both halves in packed rows, dealt by shard on disk; what is the same for all sequences is at hand."""

    def __init__(self, spark: SparkSession, bits: int):
        self.spark, self.bits = spark, bits
        self.folder = shared_folder(spark, "model")
        self.name = f"quality_{uuid.uuid4().hex}"
        self.buckets = min(1 << bits, max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def _add(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("kind").bucketBy(self.buckets, "shard").option("path", self.folder).option("compression", "uncompressed").format("parquet").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def fill(self, texts: DataFrame, part: int) -> None:
        """Count the packed texts of a half, one slice of the keys after the other: on disk are the rows sent for one slice."""
        for k in range(SLICES):
            self._add(_slice_counts(texts, part, k, self.bits))
        self._add(_word_entries(self.read(), part, self.bits))
        _dropped(self.spark, f"{self.folder}/kind={WORDS}")

    def sum_up(self) -> None:
        """Discounts of both halves, and the floor of each for an unknown word."""
        times = {(m, part): {} for m in LEVELS for part in (0, 1)}
        for r in _times(self.read()).collect():  # 28 rows at most
            times[r["words"], r["part"]][r["n"]] = r["k"]
        self.cuts = {at: np.array(_cuts(x)) for at, x in times.items()}
        self.total, self.floor = {}, {}
        for part in (0, 1):
            own, (d1, d2, d3) = times[1, part], self.cuts[1, part]
            if own.get(0):
                self.total[part] = own[5]
                cut = d1 * own[1] + d2 * own[2] + d3 * (own[0] - own[1] - own[2])
                self.floor[part] = float(np.float32(cut / own[5])) / (own[0] + 1)

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        _dropped(self.spark, self.folder)


def _block_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a block, and the range of words of each text."""
    words, ranges = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, w, r in hashed_words(texts, CASED):
        words.append(w)
        ranges.append(r[1:] + ranges[-1][-1])
    return np.concatenate(words), np.concatenate(ranges)


def _asked(part: int, words: np.ndarray, ranges: np.ndarray, bits: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Keys of all words, pairs and triples of a block, behind those of what begins a text; where the texts begin."""
    _, context, pair = _before(part, words, ranges)
    begin = np.full(1, _BEGIN, np.uint64)
    keys = {1: np.append(_keys(part, begin), _keys(part, words)), 2: np.append(_keys(part, begin, begin), pair), 3: _triples(context, pair, bits)}
    return keys, ranges[:-1][np.diff(ranges) > 0]


def perplexities(docs: DataFrame, model: Counted, blocks: int, k: int, groups: int) -> DataFrame:
    """doc_id, lang, n_words and log_prob of all words of (doc_id, lang, text) in a group of the blocks, each by the model of the other half."""
    place, bits = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)), model.bits
    cuts, total, floor = model.cuts, model.total, model.floor
    chosen_docs = docs.filter(F.pmod(place, F.lit(groups)) == k) if groups > 1 else docs
    dealt = chosen_docs.select((place * 2 + half()).cast("int").alias("block"), "doc_id", "lang", "text")
    other = lambda table: 1 - table.column("block")[0].as_py() % 2

    def ask(table: pa.Table) -> pa.Table:
        out = []
        for m, keys in _asked(other(table), *_block_words(table.column("text")), bits)[0].items():
            keys = np.sort(keys)
            keys = keys[_firsts(keys)]
            edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            out += [(s, m, _pack(x, rising=True)) for s, x in enumerate(np.split(keys, edges)) if len(x)]
        block = np.full(len(out), table.column("block")[0].as_py(), np.int32)
        return pa.table([pa.array(block), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["block", "shard", "kind", "keys"])

    def answer(asked: pa.Table, entries: pa.Table) -> pa.Table:
        blocks, kinds = asked.column("block").to_numpy(), asked.column("kind").to_numpy()
        runs = [(m, s, entries.column("data")[i]) for i, (m, s) in enumerate(zip(entries.column("kind").to_pylist(), entries.column("slice").to_pylist(), strict=True))]
        out, rows = [], []
        for m in LEVELS:
            own = np.flatnonzero(kinds == m)
            each = [_unpack(asked.column("keys")[i.item()])[0] for i in own]
            keys = np.concatenate([np.zeros(0, np.uint64), *each])
            edges = np.cumsum([0, *map(len, each)])
            of = np.repeat(np.where(blocks[own] % 2 == 0, SLICES, 0), np.diff(edges))
            if m > 1:
                of += _slices(keys, bits)
            found = [np.zeros(len(keys), np.uint64) for _ in STATS[: 1 if m == 3 else None]]
            for data, slice_ in [(x, s) for k, s, x in runs if k == m]:
                known, *values = _unpack(data)
                mine = np.flatnonzero(of == slice_)
                if not len(known) or not len(mine):
                    continue
                at = np.minimum(np.searchsorted(known, keys[mine]), len(known) - 1)
                same = known[at] == keys[mine]
                mine, at = mine[same], at[same]
                for f, v in zip(found, values, strict=True):
                    f[mine] = v[at]
            out += [_pack(*(f[a:b] for f in found)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            rows.append(own)
        rows = pa.array(np.concatenate(rows))
        return pa.table([*(asked.column(c).take(rows) for c in ("block", "shard", "kind")), pa.array(out, pa.binary())], names=["block", "shard", "kind", "found"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        words, ranges = _block_words(table.column("text"))
        part, logs = other(table), np.zeros(len(words))
        if len(words) and part in floor:
            asked, starts = _asked(part, words, ranges, bits)
            answers = answers.sort_by("shard")

            def shares(m: int, n: np.ndarray, of: np.ndarray | int) -> np.ndarray:
                cut = np.append(0, cuts[m, part])[np.minimum(n, 3)]
                return (np.maximum(0, n - cut) / of).astype(np.float32).astype(np.float64)

            p, sums, weight = None, None, None  # sums and weights of the contexts of the words, for the level at hand
            for m, keys in asked.items():
                order = np.argsort(keys)
                first = np.append(True, keys[order[1:]] != keys[order[:-1]])
                at = np.empty(len(keys), np.int64)
                at[order] = np.cumsum(first) - 1
                n, *stats = [x.astype(np.int64) for x in _joined(answers.column("found").filter(pa.array(answers.column("kind").to_numpy() == m)), 1 if m == 3 else len(STATS))]
                own = at if m == 3 else at[1:]
                if m == 1:
                    p = shares(1, n, total[part])[own] + floor[part]
                else:
                    p = np.where(sums > 0, shares(m, n[own], np.maximum(sums, 1)) + weight * p, p)
                if m < 3:
                    ones, twos, more, often = stats
                    all_sums = ones + 2 * twos + often
                    d1, d2, d3 = cuts[m + 1, part]
                    weights = ((d1 * ones + d2 * twos + d3 * more) / np.maximum(all_sums, 1)).astype(np.float32)
                    before = np.roll(own, 1)
                    before[starts] = at[0]
                    sums, weight = all_sums[before], weights[before].astype(np.float64)
            logs = np.log(p)
        sums = np.append(0, np.cumsum(logs))
        n = pa.array(np.diff(ranges))
        log_prob = pa.array(sums[ranges[1:]] - sums[ranges[:-1]], mask=np.full(len(n), part not in floor))
        return pa.table([table.column("doc_id"), table.column("lang"), n, log_prob], names=["doc_id", "lang", "n_words", "log_prob"])

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, shard int, kind int, keys binary")
    entries = model.read().filter(F.col("kind").isin(*LEVELS)).select("shard", "kind", "slice", "data")
    answers = asked.groupBy("shard").cogroup(entries.groupBy("shard")).applyInArrow(answer, "block int, shard int, kind int, found binary")
    added = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_words long, log_prob double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, added)


def _scored(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """doc_id, lang, n_words and perplexity of (doc_id, lang, text), written group by group: on disk is what one group sends."""
    spark = docs.sparkSession
    out = shared_folder(spark, "perplexity")
    perplexity = F.when(F.col("n_words") > 0, F.exp(-F.col("log_prob") / F.col("n_words"))).alias("perplexity")
    blocks = 1 + size // (2 * BLOCK)
    model = Counted(spark, (max(LEAST_SHARDS, -(-size // PER_SHARD)) - 1).bit_length())
    with _lean(spark):
        for part in (0, 1):
            trusted, n = shared_folder(spark, "trusted"), min(TEXT_GROUPS, blocks)
            for k in range(n):
                own = [df.filter((half() == part) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k)) for df in (docs, ids)]
                _packed_texts(_trusted(*own, "doc_id", "text")).write.mode("append").option("compression", "uncompressed").parquet(trusted)
            model.fill(spark.read.schema(_TEXTS).parquet(trusted), part)
            _dropped(spark, trusted)
        model.sum_up()
        for k in range(n := min(GROUPS, blocks)):
            perplexities(docs, model, blocks, k, n).select("doc_id", "lang", "n_words", perplexity).write.mode("append").option("compression", "zstd").parquet(out)
    model.drop()
    return spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_words long, perplexity double").parquet(out)


def judged(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold of the language, and whether the document is kept."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = trusted_ids(labels)
    found = _scored(slim, ids, size)
    limits = found.join(ids, "doc_id").groupBy("lang").agg((F.percentile_approx("perplexity", quantile, 10_000) * margin).alias("threshold"))
    limits = limits.select(F.col("lang").alias("of"), "threshold")
    out = found.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of")), "left")  # one row for each language
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_words", "perplexity", "threshold", kept.alias("keep"))
