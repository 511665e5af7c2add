"""Readers of the corpus, the source registry, documents and known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions.suppliers import corpus_key
from attestor.schemas import CORPUS_ITEM, MAX_DOCUMENT_BYTES

FAMILY = T.StructType(
    [
        T.StructField("source_family_id", T.StringType()),
        T.StructField("institution", T.StringType()),
        T.StructField("evidence_mode", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("seed_urls", T.ArrayType(T.StringType())),
    ]
)
REGISTRY = T.StructType([T.StructField("source_families", T.ArrayType(FAMILY))])


def read_corpus(spark: SparkSession, path: str, form: str = "lines") -> DataFrame:
    """Corpus items from JSON; nothing is inferred.

    ``form`` is ``lines`` (one object per line, splittable, what ``write_corpus``
    gives) or ``document`` (each file holds one object or a list of them).
    """
    if form not in ("lines", "document"):
        raise ValueError(f"unknown form {form!r}; use 'lines' or 'document'")
    return spark.read.schema(CORPUS_ITEM).option("multiLine", form == "document").json(path)


def parse_corpus(lines: DataFrame, column: str = "value") -> DataFrame:
    """Corpus items from a column of JSON texts; other columns are kept."""
    others = [c for c in lines.columns if c != column]
    return lines.select(*others, F.from_json(column, CORPUS_ITEM).alias("item")).select(*others, "item.*")


def corpus_disclosures(items: DataFrame) -> DataFrame:
    """One row per disclosure; an item without any keeps one row of nulls."""
    return items.select("canonicalName", F.posexplode_outer("procurement").alias("position", "p")).select("canonicalName", "position", "p.*")


def document_key(family: Column, url: Column) -> Column:
    """``family:slug:hash`` of a document URL."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    slug = F.regexp_replace(F.substring(last, 1, 60), r"[^\p{L}\p{N}._-]", "-")
    return F.concat_ws(":", family, slug, F.substring(F.sha2(url, 256), 1, 16))


def registry_urls(registry: DataFrame) -> DataFrame:
    """Seed URLs of the active families (a family without the flag is active)."""
    families = registry.select(F.explode("source_families").alias("f")).select("f.*").filter(F.coalesce("active", F.lit(True)))
    urls = families.select("source_family_id", "institution", "evidence_mode", "adapter", F.explode("seed_urls").alias("source_url"))
    return urls.withColumn("document_key", document_key(F.col("source_family_id"), F.col("source_url")))


def read_source_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_urls(spark.read.schema(REGISTRY).option("multiLine", True).json(path))


def parse_registry(lines: DataFrame, column: str = "value") -> DataFrame:
    return registry_urls(lines.select(F.from_json(column, REGISTRY).alias("r")).select("r.*"))


def with_content_hash(documents: DataFrame, content: str = "content") -> DataFrame:
    """Documents with their size, hash, text and, if they are not evidence, the reason.

    ``too_large``: above the size limit; ``not_text``: the bytes are not UTF-8,
    so there is no text, but bytes and hash stay; ``missing``: no content.
    """
    size = F.octet_length(content)
    text = F.try_validate_utf8(F.col(content).cast("string"))
    reason = F.when(size.isNull(), "missing").when(size > MAX_DOCUMENT_BYTES, "too_large").when(text.isNull(), "not_text")
    return documents.withColumns({"bytes": size, "sha256": F.sha2(content, 256), "text": F.when(size <= MAX_DOCUMENT_BYTES, text), "reject_reason": reason})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files of a directory tree as documents; files above the size limit are rejected unread, from the listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    read = with_content_hash(files.filter(F.col("length") <= MAX_DOCUMENT_BYTES)).drop("bytes")
    large = files.filter(F.col("length") > MAX_DOCUMENT_BYTES).drop("content")
    large = large.withColumns({"sha256": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "reject_reason": F.lit("too_large")})
    columns = [F.col("path").alias("doc_id"), "modificationTime", F.col("length").alias("bytes"), "sha256", "text", "reject_reason"]
    return read.select(*columns).unionByName(large.select(*columns))


def existing_names(lines: DataFrame, column: str = "value") -> DataFrame:
    """Normalised names of known entities: the name column and the spelt-out slug."""
    parts = F.split(F.col(column), "\t")
    slug = F.replace(F.element_at(parts, 1), F.lit("-"), F.lit(" "))
    both = F.array_compact(F.array(slug, F.try_element_at(parts, F.lit(2))))
    rows = lines.filter(F.trim(column) != "").select(F.explode(both).alias("name"))
    return rows.select(corpus_key(F.col("name")).alias("name_key")).filter(F.col("name_key") != "").distinct()


def read_existing_names(spark: SparkSession, path: str) -> DataFrame:
    return existing_names(spark.read.text(path))
