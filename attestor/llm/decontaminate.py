"""Benchmark decontamination by suffix arrays over the training text.

Each Arrow batch of documents is a shard.  Words become numbers of the test
vocabulary; a word outside it ends every match.  Runs too short for any window
are dropped, which loses no match, and the suffixes of the rest are sorted into
a suffix array by prefix doubling.  Every test suffix is then found by binary
search, which gives all places of its window at once.  From there the match is
followed through the suffix array of the test text itself, over all items that
still agree, to the longest verbatim match.

Edge cases: a null or empty text has no words and is clean; a null or empty
item matches nothing; equal items all count; an item without an id counts for
hit words and longest matches but is not named; rows with the same ``doc_id``
are judged one by one.  The test set is built in blocks of bounded size on the
driver and held whole by each worker, so it must fit the memory of both; a
shard is at most an Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import annotated, hashed_words

WINDOW = 10
#: Characters of test text that a task holds at a time.
BLOCK_CHARS = 4_000_000
#: Words of a shard's suffix array.
SHARD_WORDS = 2_000_000

ADDED = "n_words long, n_hit long, items array<string>, longest_match long, longest_at long"


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` in the order of the suffixes' first ``depth`` (or more) numbers."""
    rank, k = ids.astype(np.int64), 1
    while k < depth:
        follower = np.zeros_like(rank)
        follower[:-k] = rank[k:]
        _, rank = np.unique(rank * (int(rank.max()) + 2) + follower, return_inverse=True)
        rank = rank + 1
        k *= 2
    return np.argsort(rank, kind="stable")


def bound(text: np.ndarray, order: np.ndarray, patterns: np.ndarray, start: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of ``patterns[start : start + width]``, many at once, among the sorted suffixes of ``text``: the first not below it, or the first above it."""
    low, high = np.zeros(len(start), np.int64), np.full(len(start), len(order))
    while (low < high).any():
        mid = (low + high) // 2
        suffix = order[np.minimum(mid, len(order) - 1)]
        sign = np.zeros(len(low), np.int64)  # of suffix minus pattern
        for k in range(int(width.max())):
            p = np.minimum(suffix + k, len(text) - 1)
            diff = np.sign(text[p] - patterns[np.minimum(start + k, len(patterns) - 1)])
            sign = np.where((sign == 0) & (k < width), diff, sign)
        below = (sign < 0) | ((sign == 0) & after)
        active = low < high
        low = np.where(active & below, mid + 1, low)
        high = np.where(active & ~below, mid, high)
    return low


class TestBlock:
    """Windows of a block of test items, distinct, each with the items that hold it."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = pa.array([t for _, t in items], pa.string())
        self.names = [n for n, _ in items]
        hashes, sizes = [np.zeros(0, np.uint64)], []
        for _, _, words, ranges in hashed_words(texts):
            hashes.append(words)
            sizes.append(np.diff(ranges))
        words = np.concatenate(hashes)
        sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.vocabulary, ids = np.unique(words, return_inverse=True)
        ends = np.cumsum(sizes) + np.arange(len(sizes))  # a zero stands behind every item
        self.ids = np.zeros(len(ids) + len(sizes) + window, np.int64)
        self.ids[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids + 1
        owners: dict[tuple, set[int]] = {}
        first: dict[tuple, int] = {}
        for item, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            width = min(window, size)
            for at in range(end - size, end - width + 1 if width else 0):
                key = tuple(self.ids[at : at + width].tolist())
                owners.setdefault(key, set()).add(item)
                first.setdefault(key, at)
        groups: dict[frozenset, int] = {}
        self.group = np.array([groups.setdefault(frozenset(owners[k]), len(groups)) for k in first], np.int64)
        self.groups = [sorted(g) for g in groups]
        self.start = np.array(list(first.values()), np.int64)
        self.width = np.array([len(k) for k in first], np.int64)
        self.depth, self.least = (int(self.width.max()), int(self.width.min())) if len(self.width) else (1, 1)
        self.order = suffix_array(self.ids, int(sizes.max(initial=1)) + 1)
        self.low, self.high = (bound(self.ids, self.order, self.ids, self.start, self.width, after) for after in (False, True))

    def _longer(self, s: np.ndarray, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """How long the match of ``s`` at each place is, beginning with its window, in whichever item it is longest."""
        length, left = self.width[window].copy(), np.arange(len(at))
        low, high = self.low[window], self.high[window]
        while len(left):
            word = s[at[left] + length[left]]
            left, low, high, word = left[word > 0], low[word > 0], high[word > 0], word[word > 0]
            low = self._step(low, high, length[left], word, False)
            high = self._step(low, high, length[left], word, True)
            ok = low < high
            left, low, high = left[ok], low[ok], high[ok]
            length[left] += 1
        return length

    def _step(self, low: np.ndarray, high: np.ndarray, skip: np.ndarray, word: np.ndarray, after: bool) -> np.ndarray:
        """Within each range of sorted test suffixes, the first whose word behind ``skip`` is not below (or is above) the given one."""
        while (low < high).any():
            mid = (low + high) // 2
            found = self.ids[np.minimum(self.order[np.minimum(mid, len(self.order) - 1)] + skip, len(self.ids) - 1)]
            below = (found < word) | ((found == word) & after)
            active = low < high
            low, high = np.where(active & below, mid + 1, low), np.where(active & ~below, mid, high)
        return low

    def search(self, words: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in ``words`` where windows occur, the window of each, and the length of the match there."""
        none = (np.zeros(0, np.int64),) * 3
        if not len(self.start) or not len(words):
            return none
        near = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[near] == words, near + 1, 0)
        # runs of test words within a text, with a break in front of each
        fresh = np.zeros(len(ids) + 1, bool)
        fresh[ranges[:-1]] = True
        known = ids > 0
        begins = known & (fresh[:-1] | ~np.append(False, known[:-1]))
        run_at = np.flatnonzero(begins)
        if not len(run_at):
            return none
        run_len = np.add.reduceat(known.astype(np.int64), run_at)
        # a run stops at its first unknown word or text end; count known words from each begin to the next begin
        keep = run_len >= self.least
        run_at, run_len = run_at[keep], run_len[keep]
        if not len(run_at):
            return none
        offsets = np.cumsum(run_len + 1) - (run_len + 1)
        total = int((run_len + 1).sum()) + self.depth
        s, back = np.zeros(total, np.int64), np.full(total, -1, np.int64)
        spread = np.repeat(offsets, run_len) + (np.arange(run_len.sum()) - np.repeat(np.cumsum(run_len) - run_len, run_len))
        back[spread] = np.repeat(run_at, run_len) + (spread - np.repeat(offsets, run_len))
        s[spread] = ids[back[spread]]
        order = suffix_array(s, self.depth)
        low, high = (bound(s, order, self.ids, self.start, self.width, after) for after in (False, True))
        count = high - low
        if not count.sum():
            return none
        window = np.repeat(np.arange(len(count)), count)
        at = order[np.repeat(low, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))]
        return back[at], window, self._longer(s, at, window)


def shards(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch joined to shards of about ``SHARD_WORDS`` words."""
    held: list = []
    for piece in hashed_words(texts):
        held.append(piece)
        if sum(len(p[2]) for p in held) >= SHARD_WORDS:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[int, int, np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(p[2]) for p in held])
    ranges = np.concatenate([p[3][:-1] + s for p, s in zip(held, starts, strict=False)] + [starts[-1:]])
    return held[0][0], held[-1][1], np.concatenate([p[2] for p in held]), ranges


def judged(blocks, texts: pa.Array) -> list:
    """Counts, items and longest match of each text of a batch."""
    n = len(texts)
    n_words, n_hit, longest, longest_at = (np.zeros(n, np.int64) for _ in range(4))
    longest_at[:] = -1
    items: list[set] = [set() for _ in range(n)]
    for i, j, words, ranges in shards(texts):
        n_words[i:j] = np.diff(ranges)
        cover = np.zeros(len(words) + 1, np.int64)
        for held in blocks:
            block: TestBlock = held.value
            at, window, length = block.search(words, ranges)
            if not len(at):
                continue
            np.add.at(cover, at, 1)
            np.add.at(cover, at + block.width[window], -1)
            doc = np.searchsorted(ranges, at, side="right") - 1
            pairs = np.unique(doc * len(block.groups) + block.group[window])
            for d, g in zip((pairs // len(block.groups)).tolist(), (pairs % len(block.groups)).tolist(), strict=True):
                items[i + d].update(block.names[x] for x in block.groups[g] if block.names[x] is not None)
            order = np.lexsort((at, -length, doc))
            _, lead = np.unique(doc[order], return_index=True)
            lead = order[lead]
            d = doc[lead]
            better = length[lead] > longest[i + d]
            d, lead = d[better], lead[better]
            longest[i + d], longest_at[i + d] = length[lead], at[lead] - ranges[d]
        hit = np.append(0, np.cumsum(np.cumsum(cover[:-1]) > 0))
        n_hit[i:j] = hit[ranges[1:]] - hit[ranges[:-1]]
    return [pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(longest), pa.array(longest_at)]


def test_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_chars: int) -> list:
    """The test items as broadcasts of at most ``block_chars`` characters, or one item."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // block_chars + 1
    own = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    blocks = []
    for k in range(n):
        found = [(r["item"], r["text"]) for r in rows.filter(own == k).toLocalIterator()]
        blocks.append(spark.sparkContext.broadcast(TestBlock(found, window)))
    return blocks


test_blocks.__test__ = False


def matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document as ``row`` with its words, hit words, items found, and length and place of its longest match."""
    blocks = test_blocks(benchmark, item, item_text, window, block_chars)
    return annotated(docs, text, lambda texts: judged(blocks, texts), ADDED)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of a test item occurs, with their own columns only."""
    return matches(docs, benchmark, **options).filter(F.col("n_hit") == 0).select("row.*")


def items_digest(items: str = "items") -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
