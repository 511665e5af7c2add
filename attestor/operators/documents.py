"""Document tables: duplicates, changes, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import documents as DOC
from attestor.functions import names as N


def dedupe_documents(docs: DataFrame, key: str = "content_hash") -> DataFrame:
    """One evidence row per content hash: first document, copies and last sight.

    Expects ``doc_id``, ``seen_at`` and the hash.  A hash shared by a third of
    all rows is counted map-side, so it costs one row per task.
    """
    return docs.groupBy(key).agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("seen_at").alias("last_seen_at")
    )


def document_locations(docs: DataFrame, key: str = "content_hash") -> DataFrame:
    """Every URL a document was found at, once per (first document, URL)."""
    owner = docs.groupBy(key).agg(F.min("doc_id").alias("evidence_id"))
    places = docs.groupBy(key, "url").agg(F.max("seen_at").alias("last_seen_at"))
    return places.join(owner, key).select("evidence_id", "url", "last_seen_at")


def near_duplicate_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts that differ only in case and white space."""
    return (
        docs.select("doc_id", DOC.near_text_hash(F.col(text)).alias("normalized_hash"))
        .groupBy("normalized_hash")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def changed_documents(current: DataFrame, ledger: DataFrame) -> DataFrame:
    """State of each document against the ledger of the last import."""
    joined = current.select("document_key", "content_hash").join(
        ledger.select("document_key", "import_status", F.col("imported_content_hash").alias("known_hash")), "document_key", "left"
    )
    same = F.col("known_hash") == F.col("content_hash")
    status = (
        F.when(F.col("known_hash").isNull(), "new")
        .when((F.col("import_status") == "IMPORTED") & same, "unchanged")
        .when(~same, "changed")
        .otherwise("pending")
    )
    return joined.select("document_key", "content_hash", status.alias("status"))


def extract_links(pages: DataFrame) -> DataFrame:
    """Anchors of each page with absolute URL and text, in page order."""
    # An outer explode, so that the anchors are not read twice to infer a filter.
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode_outer(DOC.anchors(F.col("html"))).alias("position", "a"))
    return found.filter(F.col("a").isNotNull()).select(
        "page_id", "page_url", "position", escape_url(DOC.resolve_link(F.col("a.href"), F.col("page_url"))).alias("url"), F.col("a.text").alias("text")
    )


def escape_url(url: Column) -> Column:
    """Percent-encode spaces and non-ASCII characters, as a URL parser does."""
    encoded = F.array_join(
        F.transform(F.split(url, ""), lambda c: F.when(c == " ", "%20").when(c.rlike(r"[^\x00-\x7F]"), F.url_encode(c)).otherwise(c)), ""
    )
    return F.when(url.rlike(r"[^\x00-\x7F]| "), encoded).otherwise(url)


def link_candidate_filter(
    links: DataFrame, path_prefixes: list[str] | None = None, exclusions: list[str] | None = None, patterns: list[str] | None = None
) -> DataFrame:
    """Links worth fetching: same host, allowed path, wanted pattern or evidence-like."""
    url = F.col("url")
    ok = url.rlike("^https?://") & (N.url_host(url) == N.url_host(F.col("page_url")))
    if path_prefixes:
        path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
        allowed = F.lit(False)
        for p in path_prefixes:
            allowed = allowed | path.startswith(p)
        ok = ok & allowed
    for p in exclusions or []:
        ok = ok & ~url.contains(p)
    if patterns:
        wanted = DOC.evidence_likeness(url, F.lit(None).cast("string"), F.lit(None).cast("string")) > 0
        for p in patterns:
            wanted = wanted | url.contains(p)
        ok = ok & wanted
    return links.filter(F.coalesce(ok, F.lit(False)))


def disclosure_identity(df: DataFrame) -> DataFrame:
    """Add the identity hash of a disclosure (URL, tender, name, level, date)."""
    def folded(name: str) -> Column:
        return N.fold(F.coalesce(F.trim(F.col(name)) if name == "source_url" else F.col(name), F.lit("")))

    key = F.concat_ws(
        "|",
        F.lit("gpd:v1"),
        folded("source_url"),
        folded("tender_number"),
        N.normalize_name(F.col("canonical_name")),
        folded("bee_level"),
        F.coalesce("evidence_date", F.lit("")),
    )
    return df.withColumn("identity_hash", F.sha2(key, 256))


