"""Data-quality constraints as checks over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.common import is_valid
from attestor.schemas import EVIDENCE_TYPES, LIFECYCLE_STATES, LINK_STATES, PUBLICATION_STATES, REVIEW_TYPES, VISIBILITIES


def _duplicates(df: DataFrame, rule: str, keys: list[str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.groupBy(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(F.lit(rule).alias("rule"), "key", "n")


def check_unique_keys(tables) -> DataFrame:
    """Keys that break one of the uniqueness rules."""
    t = tables
    parts = [
        _duplicates(t["entities"], "live_registration", ["registration_number_normalized"], F.col("registration_number_normalized").isNotNull() & F.col("merged_into_id").isNull()),
        _duplicates(t["evidence_raw"], "evidence_hash", ["content_hash"], F.col("content_hash").isNotNull()),
        _duplicates(t["evidence_entity_links"], "evidence_entity", ["evidence_id", "entity_id"]),
        _duplicates(t["published_claims"], "published_claim", ["entity_id", "field_key"]),
        _duplicates(t["field_overrides"], "field_override", ["entity_id", "field_key"]),
        _duplicates(t["review_items"], "pending_review", ["type", "evidence_id"], (F.col("status") == "pending") & F.col("evidence_id").isNotNull()),
        _duplicates(t["entity_classifications"], "classification", ["entity_id", "sector_id", "classification_type"]),
        _duplicates(t["evidence_source_locations"], "source_location", ["evidence_id", "url"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_references(tables) -> DataFrame:
    """Rows of a child table whose parent does not exist, counted per rule."""
    def orphans(child: str, column: str, parent: str) -> DataFrame:
        rows = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias("id"))
        return rows.join(tables[parent].select("id"), "id", "left_anti").groupBy("id").agg(F.count("*").alias("n")).select(
            F.lit(f"{child}.{column}").alias("rule"), F.col("id").cast("string").alias("key"), "n"
        )

    parts = [
        orphans("evidence_entity_links", "evidence_id", "evidence_raw"),
        orphans("evidence_entity_links", "entity_id", "entities"),
        orphans("extraction_runs", "evidence_id", "evidence_raw"),
        orphans("extracted_claims", "extraction_run_id", "extraction_runs"),
        orphans("published_claims", "entity_id", "entities"),
        orphans("published_claims", "evidence_id", "evidence_raw"),
        orphans("evidence_raw", "verifier_agency_id", "verification_agencies"),
        orphans("evidence_raw", "signatory_id", "signatories"),
        orphans("entity_classifications", "sector_id", "sectors"),
        orphans("publication_events", "entity_id", "entities"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_enums(tables) -> DataFrame:
    """Values outside their vocabulary, and edges from an entity to itself."""
    def outside(table: str, column: str, allowed: list[str]) -> DataFrame:
        return tables[table].filter(~F.col(column).isin(allowed)).groupBy(column).agg(F.count("*").alias("n")).select(
            F.lit(f"{table}.{column}").alias("rule"), F.col(column).alias("key"), "n"
        )

    loops = tables["entity_relationships"].filter(F.col("source_entity_id") == F.col("target_entity_id"))
    out = outside("entities", "visibility", VISIBILITIES)
    for table, column, allowed in (
        ("evidence_raw", "evidence_type", EVIDENCE_TYPES),
        ("evidence_raw", "publication_state", PUBLICATION_STATES),
        ("evidence", "lifecycle_state", LIFECYCLE_STATES),
        ("evidence_entity_links", "link_state", LINK_STATES),
        ("review_items", "type", REVIEW_TYPES),
        ("review_items", "status", ["pending", "in_review", "approved", "rejected"]),
    ):
        out = out.unionByName(outside(table, column, allowed))
    return out.unionByName(
        loops.groupBy(F.col("source_entity_id").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("self_edge").alias("rule"), "key", "n")
    )


def check_validity(tables) -> DataFrame:
    """Current documents without expiry, and confidences outside 0 to 1."""
    undated = tables["evidence"].filter(is_valid() & F.col("expiry_date").isNull()).select(F.lit("current_without_expiry").alias("rule"), F.col("id").cast("string").alias("key"))
    claims = tables["extracted_claims"].filter(~F.col("confidence").between(0, 1)).select(F.lit("claim_confidence").alias("rule"), F.col("id").alias("key"))
    links = tables["evidence_entity_links"].filter(~F.col("confidence").between(0, 1)).select(F.lit("link_confidence").alias("rule"), F.col("id").cast("string").alias("key"))
    return undated.unionByName(claims).unionByName(links)
