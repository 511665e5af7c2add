"""Exact copies by progressive refinement, in DataFrame operations only.

Texts are told apart by length, then by the hash of a short prefix, and only
those that still have company are hashed whole.  One scan writes length and
prefix hash of every row; the keys that more than one row has become a bitmap
of fixed size, which a second scan probes.  A collision in the bitmap costs one
more hash and changes no result, and the bitmap is as large for any input.

Edge cases: a null text is an empty text, and all empty texts are copies of
each other; rows without an id are rows like others, and stay only where no
equal text has an id; of repeated rows with the largest id one stays; a table
without rows gives none; other columns are carried in ``row`` and can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.common import hot_join, packed, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of the prefix; bits of the bitmap (8 MB, the only thing broadcast but for facts of hot groups), bits of one of its rows.
PREFIX, BITS, ROW_BITS = 64, 1 << 26, 1 << 15


def normalised(text: str | Column) -> Column:
    """The text with A-Z lower-cased, null as empty."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # lower() changes other letters too, but texts of one byte a character have none
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))


def _signature(text: Column) -> list[Column]:
    """Length in bytes, which lower-casing A-Z leaves alone, and hash of the prefix."""
    whole = F.coalesce(text, F.lit(""))
    return [F.octet_length(whole).alias("size"), F.xxhash64(normalised(F.substring(whole, 1, PREFIX))).alias("prefix")]


def _bit(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BITS))


def shared_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """(slice, bitmap) of the keys that more than one row has: at most BITS / ROW_BITS rows of 4 KB."""
    many = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(_bit(*keys).alias("bit"))
    return many.groupBy(F.floor(F.col("bit") / ROW_BITS).cast("int").alias("slice")).agg(F.bitmap_construct_agg(F.col("bit") % ROW_BITS).alias("bitmap"))


def with_company(rows: DataFrame, bitmaps: DataFrame, *keys: str) -> DataFrame:
    """``rows`` and whether another row may have the same ``keys``, as ``company``."""
    names = [F.col(c) for c in rows.columns]
    found = rows.withColumn("bit", _bit(*keys)).withColumn("slice", F.floor(F.col("bit") / ROW_BITS).cast("int")).join(F.broadcast(bitmaps), "slice", "left")
    at = F.col("bit") % ROW_BITS
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.select(*names, F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False)).alias("company"))


def decided(docs: DataFrame, *, key: str = "doc_id", text: str = "text", digests: bool = False, carry: bool = False) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 and, on demand, the whole ``row``, for every row.

    The digest of the normalised text is null where a row was told apart
    without it, unless ``digests`` asks for all of them.
    """
    scan = packed(docs).select("row", F.col(f"row.`{key}`").alias("id"), F.col(f"row.`{text}`").alias("_text"))
    signatures = stored(scan.select(*_signature(F.col("_text"))), "signatures")
    lengths = shared_keys(signatures, "size")
    prefixes = stored(shared_keys(with_company(signatures, lengths, "size").filter("company"), "size", "prefix"), "prefixes")
    rows = with_company(scan.select("*", *_signature(F.col("_text"))), prefixes, "size", "prefix")
    whole = F.sha2(normalised("_text"), 256)
    digest = whole if digests else F.when(F.col("company"), whole)
    kept = ["row"] if carry else []
    rows = stored(rows.select(*kept, "id", "company", digest.alias("text_sha256"), F.monotonically_increasing_id().alias("place")), "hashed")
    first = F.max(F.struct(F.col("id").alias("keep_id"), F.col("place").alias("keep_place")))
    groups = rows.filter("company").groupBy("text_sha256").agg(F.count("*").alias("n"), first.alias("first"))
    groups = stored(groups.filter("n > 1").select("text_sha256", "n", F.col("n").alias("group_size"), "first.*"), "copies")
    out = [*kept, "id", "text_sha256"]
    grouped = hot_join(rows.filter("company"), groups, "text_sha256", "n")
    copy = F.col("group_size").isNotNull()
    grouped = grouped.select(*out, F.when(copy, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (~copy | (F.col("place") == F.col("keep_place"))).alias("kept"))
    alone = rows.filter("not company").select(*out, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return grouped.unionByName(alone)


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return decided(docs, key=key, text=text, carry=True).filter("kept").select("row.*")
