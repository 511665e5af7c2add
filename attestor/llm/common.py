"""Shared storage folder, Arrow batches of text, and hashed words.

Text crosses into Python as Arrow batches and is treated as one run of bytes
per batch, so words are found and hashed by whole-array operations.  Nulls are
read as empty texts everywhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are turned into arrays at a time; a longer text is one piece.
PIECE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a session on one machine may do without that setting, as tests do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder or shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """One struct column ``row`` holding all columns, so that added columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def annotated(df: DataFrame, text: str, work: Callable[[pa.Array], list], fields: str) -> DataFrame:
    """(row, added columns): ``work`` maps the texts of a batch to one list or array per added column."""
    rows = packed(df)
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*rows.schema.fields, *added.fields])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            new = work(row.field(at))
            yield pa.RecordBatch.from_arrays([row, *new], names=["row", *added.names])

    return rows.mapInArrow(run, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the bounds of each text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, bounds, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lowered_table(word_bytes: Callable[[int], bool]) -> np.ndarray:
    """256 entries: 0 for a byte outside words, else the byte with A-Z lower-cased."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if word_bytes(b):
            out[b] = b + 32 if 65 <= b <= 90 else b
    return out


#: Words of digits, ASCII letters and anything beyond ASCII.
ALNUM = lowered_table(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
#: Words of anything but ASCII white space.
PRINTED = lowered_table(lambda b: b != 32 and not 9 <= b <= 13)


def word_spans(data: np.ndarray, bounds: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the range of its words."""
    inside = norm > 0
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = bounds[:-1]
    before[firsts[firsts < len(data)]] = False
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = bounds[1:] - 1
    after[lasts[lasts >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[0] = 0
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words hashed at a time, so that their bytes stay in the processor's cache.
HASHED = 1 << 14


def hash_spans(norm: np.ndarray, starts: np.ndarray, leading: int | None = None) -> np.ndarray:
    """A 64-bit hash of each word, or of its leading bytes; bytes outside words are zero in ``norm`` and add nothing."""
    out, edges = np.zeros(len(starts), np.uint64), np.append(starts, len(norm))
    for k in range(0, len(starts), HASHED):
        own = edges[k : k + HASHED + 1]
        first, widths = own[0], np.diff(own)
        place = np.arange(own[-1] - first, dtype=np.int32)
        place -= np.repeat((own[:-1] - first).astype(np.int32), widths)
        each = _BYTE[norm[first : own[-1]]]
        each *= _POWER[place & 4095]
        if leading is not None:
            each[place >= leading] = 0
        out[k : k + HASHED] = np.add.reduceat(each, own[:-1] - first)
    return mix(out)


def hashed_words(texts: pa.Array, letters: np.ndarray = ALNUM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, past the last, word hashes, range of words of each text) for pieces of the batch."""
    data, bounds = text_bytes(texts)
    for i, j in pieces(bounds):
        own = bounds[i : j + 1] - bounds[i]
        norm = letters[data[bounds[i] : bounds[j]]]
        starts, _, ranges = word_spans(norm, own, norm)
        yield i, j, hash_spans(norm, starts), ranges


def hot_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one fact row per key, where a few keys may hold most rows.

    ``weight`` counts the rows of each key.  A key with more than 1/``share``
    of them all is hot; there are fewer than ``share`` such keys, whatever the
    size, so these facts are broadcast and only the others are shuffled.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    least = max(1000, total // share)
    hot = facts.filter(F.col(weight) > least).drop(weight)
    found = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    kept = found.filter("_hot").drop("_hot")
    rest = found.filter("_hot is null").select(*rows.columns).join(facts.filter(F.col(weight) <= least).drop(weight), key, "left")
    return kept.unionByName(rest.select(*kept.columns))
