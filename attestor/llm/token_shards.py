"""Token ids in training order, as shards of records of a fixed size.

Each input split is turned into one stream of tokens with an end mark behind
every document, cut into sequences, and stored.  A sequence's number is the
count of sequences in front of it.  A keyed Feistel permutation over the next
even power of two, walked until it falls below the number of sequences, gives
each its slot.  Slots are dealt in ranges to shards; a shard holds its records
in the order of slots, so training reads forward and resumes at any slot by
seeking.

A record is the slot (8 bytes), the number of tokens (4 bytes), the token ids
(filled with zeros to the full length) and one closing byte, all little-endian.
Spark's own writer commits the shards, so a lost executor leaves no half file.

Edge cases: a null or empty text gives its end mark only; an empty table gives
no shard; equal rows are written as often as they occur; strings of special
tokens inside a text are ordinary text; the pieces of the vocabulary can't be
matched over very long white space, so a text is cut behind every ``RUN`` such
characters in a row, and tokens don't reach across the cut (their bytes are
still the text's); ids that are no numbers become null.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from attestor.llm.common import mix, shared_folder, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer cuts a text into pieces before merging: a fixed value of the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_MARK = 50256
LENGTH, SHARD_ROWS, ROUNDS = 2048, 8192, 6
HEADER, CLOSING = 12, b"\n"
#: White space characters in a row behind which a text is cut before it is encoded.
RUN = 4096
_RUN = re.compile(rf"\s{{{RUN}}}")

_encoders: dict[str, object] = {}


def ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    rows = spark.read.text(path).collect()  # a vocabulary: its size is fixed
    return {base64.b64decode(a): int(b) for a, b in (r[0].split() for r in rows if r[0])}


def without_long_runs(text: str) -> list[str]:
    """The text, cut behind every ``RUN`` characters of white space in a row."""
    ends = [m.end() for m in _RUN.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def encoder(name: str, table: dict[bytes, int]):
    import tiktoken

    if name not in _encoders:
        _encoders[name] = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=table, special_tokens={})
    return _encoders[name]


class Feistel:
    """A keyed permutation of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64(int.from_bytes(np.random.SeedSequence([key & (1 << 63) - 1, r]).generate_state(2).tobytes(), "little")) for r in range(ROUNDS)]

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (right << bits) | left

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._once(np.asarray(x).astype(np.uint64), keys)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self._once(x[out], keys)
        return x.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: which sequence stands at a slot. The halves change places at the end of a pass, so the same passes with the keys reversed undo it."""
        return self._walk(slots, self.keys[::-1])


def sequences(docs: DataFrame, table: dict[bytes, int], *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_mark: int = END_MARK) -> DataFrame:
    """(part, pos, n_tokens, tokens, doc_ids): the sequences of each split, in order."""
    spark = docs.sparkSession
    kind = np.uint16 if max(end_mark, max(table.values(), default=0)) < 1 << 16 else np.uint32
    held = spark.sparkContext.broadcast(table)
    name = uuid.uuid4().hex

    def row(part, pos, stream, spans):
        ids = list(dict.fromkeys(spans))
        return part, pos, len(stream), stream.tobytes(), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        code = encoder(name, held.value)
        left, owners = np.zeros(0, kind), np.zeros(0, np.int64)

        def encoded(some: str) -> list[int]:
            pieces = without_long_runs(some)
            return code.encode_ordinary(some) if len(pieces) == 1 else [x for piece in pieces for x in code.encode_ordinary(piece)]

        names: list = []  # ids of the documents in the stream so far

        def cut(last: bool):
            nonlocal left, owners, pos, names
            rows = []
            stop = len(left) if last else len(left) // length * length
            for at in range(0, stop, length):
                own = owners[at : min(at + length, stop)]
                spans = [names[k] for k in own[np.append(True, own[1:] != own[:-1])]] if len(own) else []
                rows.append(row(part, pos, left[at : min(at + length, stop)], spans))
                pos += 1
            left, owners = left[stop:].copy(), owners[stop:].copy()
            if len(owners):
                names, owners = names[owners[0] :], owners - owners[0]
            else:
                names = []
            return rows

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "pos", "n_tokens", "tokens", "doc_ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [np.array([*encoded(t or ""), end_mark], kind) for t in some.column(1).to_pylist()]
                owners = np.concatenate([owners, np.repeat(np.arange(len(names), len(names) + len(found)), [len(f) for f in found])])
                names = names + some.column(0).to_pylist()
                left = np.concatenate([left, *found])
                yield batch_of(cut(False))
        if len(left):
            yield batch_of(cut(True))

    slim = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return slim.mapInArrow(run, "part long, pos long, n_tokens int, tokens binary, doc_ids array<bigint>")


def numbered(seqs: DataFrame) -> tuple[DataFrame, int]:
    """The sequences with the number of the first one of their split, and how many there are."""
    counts = seqs.groupBy("part").agg(F.count("*").alias("n"))
    first = (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("base")
    bases = counts.select("part", F.coalesce(first, F.lit(0)).alias("base"), "n")
    total = bases.agg(F.sum("n")).first()[0] or 0
    # one row of 16 bytes for each input split
    return seqs.join(F.broadcast(bases.drop("n")), "part"), total


def materialised(docs: DataFrame, folder: str, table: dict[bytes, int], *, key: int, length: int = LENGTH, shard_rows: int = SHARD_ROWS, end_mark: int = END_MARK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards below ``folder``; slot, shard, n_tokens and doc_ids of every sequence."""
    spark = docs.sparkSession
    kind = np.uint16 if max(end_mark, max(table.values(), default=0)) < 1 << 16 else np.uint32
    width = length * np.dtype(kind).itemsize
    seqs, total = numbered(stored(sequences(docs, table, doc_id=doc_id, text=text, length=length, end_mark=end_mark), "tokens"))
    order = Feistel(total, key)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            number = batch.column(0).to_numpy() + batch.column(1).to_numpy()
            slots = order.slots(number)
            shards = slots // shard_rows
            tokens = batch.column(2)
            out = []
            for shard in np.unique(shards).tolist():
                mine = np.flatnonzero(shards == shard)
                records = [slots[i].astype("<i8").tobytes() + (len(t := tokens[i].as_py()) // np.dtype(kind).itemsize).to_bytes(4, "little") + t.ljust(width, b"\0") for i in mine.tolist()]
                out.append((shard, press.compress(b"".join(records))))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        size = HEADER + width
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = press.decompress(blob.as_py())
                rows = [data[i : i + size] for i in range(0, len(data), size)]
                slots = [int.from_bytes(r[:8], "little") for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), pa.array(slots, pa.int64()), pa.array(rows, pa.binary())], names=["shard", "slot", "record"])

    n_shards = max(1, -(-total // shard_rows))
    blobs = seqs.select("base", "pos", "tokens").mapInArrow(deal, "shard long, blob binary")
    if total:
        rows = blobs.repartitionByRange(n_shards, "shard").mapInArrow(records, "shard long, slot long, record binary")
        rows = rows.sortWithinPartitions("shard", "slot").select("shard", F.col("record").cast("string").alias("value"))
        rows.write.partitionBy("shard").option("lineSep", CLOSING.decode()).text(f"{folder}/shards")
    layout = {"sequences": total, "length": length, "bytes": np.dtype(kind).itemsize, "shard_rows": shard_rows, "key": key, "record": HEADER + width + 1}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.text(f"{folder}/layout")
    slot = F.pandas_udf(lambda n: order_slots(order, n), "long")(F.col("base") + F.col("pos"))
    return seqs.select(slot.alias("slot"), "n_tokens", "doc_ids").withColumn("shard", F.floor(F.col("slot") / shard_rows)).select("slot", "shard", "n_tokens", "doc_ids")


def order_slots(order: Feistel, numbers):
    import pandas as pd

    return pd.Series(order.slots(numbers.to_numpy()))


def read_from(folder: str, slot: int = 0, count: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, tokens) in training order from any slot on: one seek in each shard, then forward reads."""
    store, path = pfs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pfs.LocalFileSystem(), folder)
    first = lambda d: sorted(f.path for f in store.get_file_info(pfs.FileSelector(d)) if f.base_name.startswith("part-"))
    with store.open_input_stream(first(f"{path}/layout")[0]) as f:
        layout = json.loads(f.read())
    end = layout["sequences"] if count is None else min(layout["sequences"], slot + count)
    kind = np.uint16 if layout["bytes"] == 2 else np.uint32
    while slot < end:
        shard, place = divmod(slot, layout["shard_rows"])
        with store.open_input_file(first(f"{path}/shards/shard={shard}")[0]) as f:
            f.seek(place * layout["record"])
            while slot < min(end, (shard + 1) * layout["shard_rows"]):
                record = f.read(layout["record"])
                n = int.from_bytes(record[8:HEADER], "little")
                yield int.from_bytes(record[:8], "little"), np.frombuffer(record, kind, n, HEADER)
                slot += 1
