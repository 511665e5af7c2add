"""Masked pseudo-likelihood: every word predicted from both sides by a small network.

The vocabulary comes from counts over the whole corpus: the most frequent words
each have a number, all others share buckets by hash.  The two words on either
side of a hidden one each add a vector of their own place; the sum, bent by
tanh, predicts first the class of the hidden word, then the word within its
class, so a prediction costs about twice the square root of the vocabulary.
For a word in a bucket, the probability of the bucket is multiplied by the
word's share in it: its count over the bucket's count and one, so that the
probabilities are those of words.  Shares come from a join of the documents'
words with the counts, whatever the size of the vocabulary.

Training predicts every word of every document: a hash deals the words to the
rounds, so each is the target in one of them.  Each task trains a copy on its documents;
the copies are averaged, weighted by their examples, in blocks that Spark adds
up in two steps, and the next round starts from the average.

Scoring predicts every word of every text and sums the log-probabilities; the
parts from counts are summed in fixed steps, so their order does not matter.

Edge cases: a null or empty text has no words, a sum of 0 and no mean; equal
texts have equal scores; the words that were never counted have one share
together in each bucket, that of a word counted once; an empty table trains
nothing and scores nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import annotated, hashed_words, hot_join, mix, shared_folder, stored

CLASSES, PER_CLASS, RARE = 32, 32, 64
WORDS = CLASSES * PER_CLASS
HIDDEN, SIDES = 32, (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 512, 0.08
#: Words whose neighbours are looked up at a time, and copies added up in one step.
SCORED, COPIES = 65_536, 512
#: Words scored at a time, so that their arrays stay in the processor's cache.
CACHED = 8192
#: Numbers no further apart than this can be lowered by one amount before they are exponents of single precision.
NARROW = 80
NOTHING = WORDS  # number of the place beyond either end

#: Logarithms of counts are summed as whole numbers of this part.
STEP = 2.0**-32

COUNTS = "word long, n long"
SCORED_PARTS = "n_words long, log_prob double, words array<long>, times array<long>"


class Vocabulary:
    """Numbers of words: the frequent ones by rank, the others by bucket.

    ``totals`` has the count of all other words of each bucket, ``counts`` the
    folder with the count of every word.
    """

    def __init__(self, frequent: np.ndarray, totals: np.ndarray | None = None, counts: str | None = None):
        self.totals = np.zeros(RARE, np.int64) if totals is None else totals
        self.counts = counts
        self.hashes = np.sort(frequent)
        self.number = np.empty(len(frequent), np.int32)
        # ranks are dealt over the classes so that each holds frequent and rare words
        self.number[np.argsort(np.argsort(frequent))] = RARE + np.arange(len(frequent))
        self.bits = np.uint64(64 - 16)
        self.first = np.searchsorted(self.hashes, np.arange(1 << 16, dtype=np.uint64) << self.bits)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        out = (words % np.uint64(RARE)).astype(np.int32)
        if len(self.hashes):
            last = len(self.hashes) - 1
            at = np.minimum(self.first[words >> self.bits], last)
            for _ in range(2):  # more than two words with the same leading bits are looked up below
                at = np.where(self.hashes[at] < words, np.minimum(at + 1, last), at)
            more = np.flatnonzero((self.hashes[at] < words) & (at < last))
            at[more] = np.minimum(np.searchsorted(self.hashes, words[more]), last)
            known = self.hashes[at] == words
            out[known] = self.number[at[known]]
        # class = number % CLASSES
        return out


def contexts(numbers: np.ndarray, ranges: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The words on either side of the given places, within their texts."""
    text = np.searchsorted(ranges, at, side="right") - 1
    low, high = ranges[text], ranges[text + 1]
    out = []
    for side in SIDES:
        place = at + side
        inside = (place >= low) & (place < high)
        out.append(np.where(inside, numbers[np.clip(place, 0, len(numbers) - 1)], NOTHING))
    return out


def round_of(words: np.ndarray, ranges: np.ndarray, rounds: int) -> np.ndarray:
    """The round in which each word is a target: by a hash of the word, its place and its text."""
    sums = np.append(np.zeros(1, np.uint64), np.cumsum(words, dtype=np.uint64))
    texts = mix(sums[ranges[1:]] - sums[ranges[:-1]])
    place = np.arange(len(words)) - np.repeat(ranges[:-1], np.diff(ranges))
    return mix(words + place.astype(np.uint64) + np.repeat(texts, np.diff(ranges))) % np.uint64(rounds)


SHAPES = {"sides": (len(SIDES), WORDS + 1, HIDDEN), "bend": (HIDDEN,), "class_w": (HIDDEN, CLASSES), "class_b": (CLASSES,), "word_w": (CLASSES, HIDDEN, PER_CLASS), "word_b": (CLASSES, PER_CLASS)}


class Network:
    """The parameters, their gradient steps and the log-probabilities they give."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        sizes = {k: int(np.prod(s)) for k, s in SHAPES.items()}
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = rng.normal(0, 0.1, sum(sizes.values())).astype(np.float32)
        self.flat, at = flat.astype(np.float32), 0
        for k, size in sizes.items():
            setattr(self, k, self.flat[at : at + size].reshape(SHAPES[k]))
            at += size
        self.squares = {k: np.full(s, 1e-6, np.float32) for k, s in SHAPES.items()}

    def hidden(self, near: list[np.ndarray]) -> np.ndarray:
        out = self.sides[0].take(near[0], axis=0)
        for side in range(1, len(SIDES)):
            out += self.sides[side].take(near[side], axis=0)
        out += self.bend
        return np.tanh(out, out=out)

    def log_probs(self, near: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Log-probability of each target: of its class, and of the word within it."""
        out = np.empty(len(target), np.float32)
        for k in range(0, len(target), CACHED):
            words, order, of, edges = by_class(target[k : k + CACHED])
            h, at = self.hidden([x[k : k + CACHED][order] for x in near]), np.arange(len(words))
            classes = h @ self.class_w
            classes += self.class_b
            chosen = classes[at, of]
            chosen -= log_sums(classes)
            inside = np.empty((len(words), PER_CLASS), np.float32)
            for c in range(CLASSES):
                np.matmul(h[edges[c] : edges[c + 1]], self.word_w[c], out=inside[edges[c] : edges[c + 1]])
            inside += self.word_b.take(of, axis=0)
            chosen += inside[at, words // CLASSES]
            chosen -= log_sums(inside)
            out[k + order] = chosen
        return out

    def _step(self, name: str, gradient: np.ndarray, rows=None) -> None:
        """A step along ``gradient``, which is used up; of some rows only, if given."""
        squares, value = self.squares[name], getattr(self, name)
        if rows is None:
            squares += gradient * gradient
            gradient /= np.sqrt(squares)
            gradient *= RATE
            value -= gradient
            return
        squares, value = squares.reshape(-1, HIDDEN), value.reshape(-1, HIDDEN)
        now = squares.take(rows, axis=0)
        now += gradient * gradient
        put_rows(squares, rows, now)
        gradient /= np.sqrt(now, out=now)
        gradient *= RATE
        put_rows(value, rows, value.take(rows, axis=0) - gradient)

    def learn(self, near: list[np.ndarray], target: np.ndarray) -> None:
        """One step on a batch, with step sizes that shrink by the gradients seen."""
        n, at = len(target), np.arange(len(target))
        target, order, of, edges = by_class(target)
        near = [x[order] for x in near]
        h = self.hidden(near)
        error = h @ self.class_w
        error += self.class_b
        error = softmax(error)
        error[at, of] -= 1
        error /= n
        back = error @ self.class_w.T
        self._step("class_w", h.T @ error)
        self._step("class_b", row_sums(error))
        # the targets of each class as a block of equal height, so that all classes go in one product
        high = int(np.diff(edges).max())
        place = of * high + at - edges[of]
        blocks, error = np.zeros((CLASSES, high, HIDDEN), np.float32), np.zeros((CLASSES, high, PER_CLASS), np.float32)
        put_rows(blocks.reshape(-1, HIDDEN), place, h)
        chances = (blocks @ self.word_w).reshape(-1, PER_CLASS).take(place, axis=0)
        chances += self.word_b.take(of, axis=0)
        chances = softmax(chances)
        chances[at, target // CLASSES] -= 1
        chances /= n
        put_rows(error.reshape(-1, PER_CLASS), place, chances)
        back += (error @ self.word_w.transpose(0, 2, 1)).reshape(-1, HIDDEN).take(place, axis=0)
        self._step("word_w", blocks.transpose(0, 2, 1) @ error)
        some = np.flatnonzero(edges[1:] > edges[:-1])
        error = np.zeros((CLASSES, PER_CLASS), np.float32)
        error[some] = np.add.reduceat(chances, edges[some], axis=0)
        self._step("word_b", error)
        h *= h
        back -= back * h
        self._step("bend", row_sums(back))
        rows, sums = group_sums(back, np.concatenate([numbers + side * (WORDS + 1) for side, numbers in enumerate(near)]).astype(np.int16))
        self._step("sides", sums, rows)


def by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Targets ordered by class, their order, their classes, and where each class begins and ends."""
    order = np.argsort((target % CLASSES).astype(np.int8), kind="stable")
    target = target[order]
    of = target % CLASSES
    return target, order, of, np.searchsorted(of, np.arange(CLASSES + 1))


def put_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``into[rows] = values`` for rows that lie in one piece each, copied whole."""
    kind = np.dtype((np.void, into.itemsize * into.shape[1]))
    into.view(kind)[:, 0][rows] = values.view(kind)[:, 0]


def row_sums(values: np.ndarray) -> np.ndarray:
    return np.ones(len(values), values.dtype) @ values


def group_sums(values: np.ndarray, groups: np.ndarray, few: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The distinct groups and the sums of their rows; row k of ``groups`` belongs to row k modulo the height of ``values``.

    The first rows of all groups are added at once, then the second ones of
    those that have two, and so on; what long groups have beyond ``few`` rows
    is added group by group.
    """
    order = np.argsort(groups, kind="stable")
    groups = groups[order]
    order %= len(values)
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    n = np.diff(np.append(first, len(groups)))
    high = np.minimum(n, few + 1).astype(np.int8)
    longest = np.argsort(-high, kind="stable")
    first, n, high = first[longest], n[longest], -high[longest]
    out = values.take(order[first], axis=0)
    for k in range(1, few):
        some = int(np.searchsorted(high, -k))  # those of more than k rows
        if not some:
            break
        out[:some] += values.take(order[first[:some] + k], axis=0)
    some = int(np.searchsorted(high, -few))
    if some:
        left = n[:some] - few
        starts = np.cumsum(left) - left
        at = np.arange(left.sum()) + np.repeat(first[:some] + few - starts, left)
        out[:some] += np.add.reduceat(values.take(order[at], axis=0), starts, axis=0)
    return groups[first].astype(np.intp), out


def lowered(x: np.ndarray) -> np.ndarray | np.float32:
    """Lowers each row of ``x`` in place so that its exponentials neither overflow nor vanish together, and returns by how much."""
    if not x.size:
        return np.float32(0)
    top = x.max()
    if top - x.min() > NARROW:
        top = x.max(axis=1)
        x -= top[:, None]
    else:
        x -= top
    return top


def softmax(x: np.ndarray) -> np.ndarray:
    """Of each row, in place."""
    lowered(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
    return x


def log_sums(x: np.ndarray) -> np.ndarray:
    """Logarithms of the summed exponentials of each row; ``x`` is used up."""
    top = lowered(x)
    np.exp(x, out=x)
    out = x @ np.ones(x.shape[1], x.dtype)
    np.log(out, out=out)
    out += top
    return out


def vocabulary(docs: DataFrame, *, text: str = "text") -> Vocabulary:
    """The most frequent words of the whole corpus, ties to the smaller hash, and the counts of all words, which are stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for _, _, w, _ in hashed_words(batch.column(0))]
            words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    folder = shared_folder(docs.sparkSession, "words")
    counts = stored(docs.select(text).mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "words", folder)
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS - RARE).collect()
    totals = np.zeros(RARE, np.int64)
    for r in counts.groupBy(F.col("word").bitwiseAND(RARE - 1).alias("bucket")).agg(F.sum("n").alias("n")).collect():  # at most RARE rows
        totals[r["bucket"]] = r["n"]
    for r in top:
        totals[r["word"] & RARE - 1] -= r["n"]
    return Vocabulary(np.array([r["word"] for r in top], np.int64).view(np.uint64), totals, folder)


def trained(docs: DataFrame, words: Vocabulary, *, text: str = "text", rounds: int = ROUNDS, batch: int = BATCH) -> Network:
    """A network trained on all words of all documents, each in one of the rounds."""
    context = docs.sparkSession.sparkContext
    network = Network()
    block = 1 << 14
    for turn in range(rounds):
        held = context.broadcast((words, network.flat))

        def learn(batches: Iterator[pa.RecordBatch], held=held, turn=turn) -> Iterator[pa.RecordBatch]:
            known, flat = held.value
            own, examples = Network(flat.copy()), 0
            for rows in batches:
                for _, _, found, ranges in hashed_words(rows.column(0)):
                    numbers = known.numbers(found)
                    at = np.flatnonzero(round_of(found, ranges, rounds) == turn)
                    for some in (at[k : k + SCORED] for k in range(0, len(at), SCORED)):
                        near, target = contexts(numbers, ranges, some), numbers[some]
                        for k in range(0, len(some), batch):
                            own.learn([x[k : k + batch] for x in near], target[k : k + batch])
                    examples += len(at)
            if examples:
                parts = [own.flat[k : k + block] * np.float32(examples) for k in range(0, len(own.flat), block)]
                part = TaskContext.get().partitionId() % COPIES
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([part] * len(parts), pa.int64()), pa.array([examples] * len(parts), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "part", "n", "sums"])

        shape = "block long, part long, n long, sums binary"
        copies = docs.select(text).mapInArrow(learn, shape)
        for keys in (["block", "part"], ["block"]):
            copies = copies.groupBy(*keys).applyInArrow(added, shape)
        sums = sorted(copies.collect(), key=lambda r: r["block"])  # one network
        if not sums:
            break
        network = Network(np.concatenate([np.frombuffer(r["sums"], np.float32) / r["n"] for r in sums]))
    return network


def added(group: pa.Table) -> pa.Table:
    """Copies of one block added up, in the order of their weights so that the sum is always the same."""
    rows = sorted(zip(group.column("n").to_pylist(), group.column("sums").to_pylist(), strict=True))
    total = np.sum([np.frombuffer(s, np.float32).astype(np.float64) for _, s in rows], axis=0).astype(np.float32)
    return pa.table({"block": [group.column("block")[0].as_py()], "part": [group.column("part")[0].as_py()], "n": [sum(n for n, _ in rows)], "sums": [total.tobytes()]}, schema=pa.schema([("block", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())]))


def rare_words(words: np.ndarray, numbers: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of buckets of each text, how often each is there, and how many each text has."""
    at = np.flatnonzero(numbers < RARE)
    text = np.searchsorted(ranges, at, side="right") - 1
    order = np.lexsort((words[at], text))
    word, text = words[at][order], text[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (text[1:] != text[:-1]))[: len(word)])
    return word[first], np.diff(np.append(first, len(word))), np.bincount(text[first], minlength=len(ranges) - 1)


def scored(docs: DataFrame, words: Vocabulary, network: Network, *, text: str = "text") -> DataFrame:
    """Each document without its text as ``row``, with its words and its pseudo-log-likelihood."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((words, network.flat))

    def work(texts: pa.Array) -> list:
        known, own = held.value[0], Network(held.value[1])
        out_of = np.log(known.totals + 1.0)
        n, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        rare, times, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for i, j, found, ranges in hashed_words(texts):
            n[i:j] = np.diff(ranges)
            numbers = known.numbers(found)
            each = np.zeros(len(found))
            for k in range(0, len(found), SCORED):
                at = np.arange(k, min(k + SCORED, len(found)))
                each[at] = own.log_probs(contexts(numbers, ranges, at), numbers[at])
            inside = numbers < RARE
            each[inside] -= out_of[numbers[inside]]
            sums = np.append(0, np.cumsum(each))
            logs[i:j] = sums[ranges[1:]] - sums[ranges[:-1]]
            for all_of, one in zip((rare, times, kinds), rare_words(found, numbers, ranges), strict=True):
                all_of.append(one)
        bounds = pa.array(np.cumsum(np.concatenate(kinds)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).view(np.int64))) for x in (rare, times)]
        return [pa.array(n), pa.array(logs), *lists]

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), others, F.col(f"`{text}`").alias("text"))
    parts = stored(annotated(keyed, "text", work, SCORED_PARTS).select("row.key", "row.row", "n_words", "log_prob", "words", "times"), "likelihood")
    if words.counts is None:
        return parts.select("row", "n_words", "log_prob")
    # a word counted once, or never, adds log 1
    counts = spark.read.schema(COUNTS).parquet(words.counts).filter((F.col("n") > 1) & ~F.col("word").isin(words.hashes.view(np.int64).tolist()))
    facts = stored(counts.select("word", F.round(F.log("n") / STEP).cast("long").alias("steps"), "n"), "rare")
    rows = parts.select("key", F.explode(F.arrays_zip("words", "times")).alias("w")).select("key", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    sums = hot_join(rows, facts, "word", "n").groupBy("key").agg(F.sum(F.col("times") * F.col("steps")).alias("steps"))
    log_prob = F.col("log_prob") + F.coalesce("steps", F.lit(0)) * STEP
    return parts.select("key", "row", "n_words", "log_prob").join(sums, "key", "left").select("row", "n_words", log_prob.alias("log_prob"))
