"""Lines that many documents share, found by probing sharded minimal perfect hashes.

Distinct line hashes (128 bits) are counted in Spark.  Those of frequent lines
go to shards; each shard is a minimal perfect hash of nested bit arrays that
numbers its lines without gaps, plus compact arrays of fingerprints, counts and
last documents.  Documents probe the arrays, so no line is joined and no text
is shuffled.  The arrays are broadcast while they stay below a given size;
beyond it the frequent lines are joined by hash, with the same result.

Edge cases: a null or empty text is one empty line; rows with the same
``doc_id`` are one document; a row without an id counts for no line and never
keeps a frequent one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import hot_join, mix, packed, stored

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Lines of a shard, and bytes of all arrays up to which they are broadcast.
SHARD_LINES, BROADCAST_BYTES = 1 << 20, 128 << 20


def line_keys(text: str | None, least: int = LEAST_CHARS) -> tuple[list[bytes], list[int], np.ndarray]:
    """The lines, the places of those long enough, and their 128-bit hashes as two columns."""
    lines = (text or "").encode().split(b"\n")
    places, hashes = [], []
    for at, line in enumerate(lines):
        key = line.strip()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least):
            places.append(at)
            hashes.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, places, np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)


def seeded(keys: np.ndarray, level: int) -> np.ndarray:
    """64 bits of both halves of each key, other ones on each level."""
    halves = keys.view(np.uint64)
    return mix(mix(halves[:, 0] + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))) + halves[:, 1])


class PerfectHash:
    """Numbers n distinct keys of two 64-bit halves from 0 to n - 1.

    On each level the keys that are alone at their place of a bit array set its
    bit; the others go on to the next level.  A key's number is the count of
    bits set in front of its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # places, bits before, bits, bits before each byte
        before, left = 0, keys
        while len(left):  # two keys part on some level, as their halves differ
            places = max(64, 2 * len(left))
            at = (seeded(left, len(self.levels)) % np.uint64(places)).astype(np.int64)
            alone = np.bincount(at, minlength=places) == 1
            bits = np.packbits(alone, bitorder="little")
            ranks = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.uint32)[:-1]).astype(np.uint32)
            self.levels.append((places, before, bits, ranks))
            before += int(alone.sum())
            left = left[~alone[at]]

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; of a key that was not given, any number or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (places, before, bits, ranks) in enumerate(self.levels):
            if not len(left):
                break
            at = (seeded(keys[left], level) % np.uint64(places)).astype(np.int64)
            byte, bit = bits[at >> 3], (at & 7).astype(np.uint8)
            found = (byte >> bit) & 1 == 1
            low = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
            out[left[found]] = before + ranks[at >> 3][found].astype(np.int64) + low[found]
            left = left[~found]
        return out


class Shard:
    """Counts and last documents of frequent lines by their hash."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, last: np.ndarray):
        keys = np.column_stack([h1, h2])
        self.index = PerfectHash(keys)
        at = self.index.numbers(keys)
        self.prints, self.docs, self.last = np.empty_like(keys), np.empty(len(h1), np.int64), np.empty(len(h1), np.int64)
        self.prints[at], self.docs[at], self.last[at] = keys, docs, last

    def last_doc(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which lines are frequent, and the largest document of each."""
        at = self.index.numbers(keys)
        found = (at >= 0) & (self.prints[at] == keys).all(axis=1)
        return found, np.where(found, self.last[at], 0)


def frequent_lines(docs: DataFrame, doc_id: str, text: str, least_chars: int, least_docs: int) -> DataFrame:
    """(h1, h2, docs, last) of the lines found in enough documents, stored."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(_lines(slim, least_chars).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("docs"), F.max("doc_id").alias("last")).filter(F.col("docs") >= least_docs), "lines")


def _lines(slim: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, h1, h2) for the distinct long lines of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(line_keys(t.as_py(), least_chars)[2], axis=0) for t in batch.column(1)]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            both = np.concatenate([np.zeros((0, 2), np.int64), *found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "h1", "h2"])

    return slim.mapInArrow(work, "doc_id long, h1 long, h2 long")


def built_shards(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, arrays): each shard built in a task of its own, stored."""

    def build(group: pa.Table) -> pa.Table:
        col = lambda c: group.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        return pa.table({"shard": [group.column("shard")[0].as_py()], "arrays": [pickle.dumps(Shard(col("h1"), col("h2"), col("docs"), col("last")))]}, schema=pa.schema([("shard", pa.int64()), ("arrays", pa.binary())]))

    rows = frequent.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long"))
    return stored(rows.groupBy("shard").applyInArrow(build, "shard long, arrays binary"), "shards")


def _without(lines: list[bytes], places: list[int], drop: np.ndarray) -> tuple[int, int, str]:
    gone = {places[k] for k in np.flatnonzero(drop).tolist()}
    return len(lines), len(gone), b"\n".join(x for at, x in enumerate(lines) if at not in gone).decode()


def deduplicated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_lines: int = SHARD_LINES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each document as ``row`` with its lines before dropping, dropped lines and kept text."""
    frequent = frequent_lines(docs, doc_id, text, least_chars, least_docs)
    shards = max(1, -(-frequent.count() // shard_lines))
    built = built_shards(frequent, shards)
    if (built.agg(F.sum(F.octet_length("arrays"))).first()[0] or 0) > broadcast_bytes:
        return _joined(docs, frequent, doc_id, text, least_chars)
    arrays = {r["shard"]: r["arrays"] for r in built.toLocalIterator()}
    held = docs.sparkSession.sparkContext.broadcast({k: pickle.loads(v) for k, v in arrays.items()})
    at_id, at_text = docs.columns.index(doc_id), docs.columns.index(text)
    whole = packed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            ids = row.field(at_id).cast(pa.int64())
            read = [line_keys(t.as_py(), least_chars) for t in row.field(at_text)]
            sizes = [len(r[1]) for r in read]
            keys = np.concatenate([np.zeros((0, 2), np.int64), *(r[2] for r in read)])
            owner = np.repeat(np.arange(len(read)), sizes)
            named = np.array(ids.is_valid())[owner]
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)[owner]
            drop, of = np.zeros(len(keys), bool), keys[:, 0] % shards
            for k, shard in held.value.items():
                mine = np.flatnonzero(of == k)
                found, last = shard.last_doc(keys[mine])
                drop[mine] = found & ~(named[mine] & (ids[mine] == last))
            out = [_without(r[0], r[1], d) for r, d in zip(read, np.split(drop, np.cumsum(sizes)[:-1]) if sizes else [], strict=True)]
            n, gone, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([row, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept"])

    schema = whole.limit(0).selectExpr("row", "0L n_lines", "0L n_dropped", "'' kept").schema
    return whole.mapInArrow(run, schema)


def _joined(docs: DataFrame, frequent: DataFrame, doc_id: str, text: str, least_chars: int) -> DataFrame:
    """The same by joins on hashes, for arrays too large to broadcast; very frequent lines do not go through the shuffle."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    lines = _lines(slim, least_chars).select("doc_id", F.struct("h1", "h2").alias("key"))
    facts = frequent.select(F.struct("h1", "h2").alias("key"), "last", F.col("docs").alias("n"))
    hits = hot_join(lines, facts, "key", "n").filter("last is not null and (doc_id is null or doc_id <> last)")
    gone = hits.groupBy("doc_id").agg(F.collect_set("key").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    whole = packed(docs)
    found = whole.join(gone, F.col(f"row.`{doc_id}`").cast("long").eqNullSafe(F.col("gone_id")), "left").drop("gone_id")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, g in zip(batch.column(0).field(at), batch.column(1).to_pylist(), strict=True):
                lines, places, keys = line_keys(t.as_py(), least_chars)
                bad = {(x["h1"], x["h2"]) for x in g or ()}
                out.append(_without(lines, places, np.array([tuple(k) in bad for k in keys.tolist()], bool)))
            n, lost, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept"])

    return found.mapInArrow(run, whole.limit(0).selectExpr("row", "0L n_lines", "0L n_dropped", "'' kept").schema)


def cleaned(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with the kept lines as their text; ``n_chars`` follows if there is such a column."""
    found = deduplicated(docs, text=text, **options)
    own = []
    for c in docs.columns:
        col = F.col(f"row.`{c}`")
        if c == text:
            col = F.col("kept")
        elif c == "n_chars":
            col = F.length("kept").cast(docs.schema[c].dataType)
        own.append(col.alias(c))
    return found.select(*own)
