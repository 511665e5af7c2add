"""Evidence ranks, latest evidence per entity, and top-k lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.operators.claims import latest_values
from attestor.operators.common import is_status, linked_evidence, live_entity, published, top_per_group
from attestor.schemas import PROCUREMENT, RANKED_DISCLOSURE_TYPES, Clock


def evidence_rank(clock: Clock) -> Column:
    """Directory rank 100 (current certificate) to 30 (anything else)."""
    kind, state = F.col("evidence_type"), F.col("lifecycle_state")
    recent = F.coalesce(F.col("issue_date") >= F.lit(clock.recent_from), F.lit(False))
    return (
        F.when(is_status() & (state == "current"), 100)
        .when(is_status() & (state == "expiring_soon"), 90)
        .when(kind.isin(RANKED_DISCLOSURE_TYPES) & recent, 80)
        .when((kind == PROCUREMENT) & recent, 70)
        .when(is_status() & (state == "unknown_validity"), 60)
        .when(is_status(), 50)
        .when(kind == PROCUREMENT, 40)
        .otherwise(30)
    )


LATEST_COLUMNS = [
    "evidence_type",
    "lifecycle_state",
    "issue_date",
    "issue_date_precision",
    "expiry_date",
    "title",
    "source_url",
    "document_issuer",
    "source_domain",
    "verifier_agency_id",
    "discovered_at",
]


def latest_evidence_per_entity(tables, clock: Clock) -> DataFrame:
    """Best published evidence of each entity, with agency and reported level."""
    pairs = linked_evidence(tables, LATEST_COLUMNS).withColumn("rank", evidence_rank(clock))
    # Carry only the key through the aggregate; the wide row is joined back.
    best = pairs.groupBy("entity_id").agg(F.max(F.struct("rank", "issue_date", "id")).alias("top")).select(
        "entity_id", F.col("top.id").alias("id"), F.col("top.rank").alias("rank")
    )
    agencies = tables["verification_agencies"].select(
        F.col("id").alias("verifier_agency_id"), F.col("name").alias("agency_name"), F.col("slug").alias("agency_slug")
    )
    levels = latest_values(tables, ["bee_level"]).select(
        F.col("evidence_id").alias("id"), F.col("bee_level").alias("reported_level")
    )
    evidence = tables["evidence"].filter(published()).select("id", *LATEST_COLUMNS)
    return (
        best.join(evidence, "id")
        .join(levels, "id", "left")
        .join(agencies, "verifier_agency_id", "left")
        .withColumnRenamed("id", "evidence_id")
    )


def latest_disclosure_per_entity(tables) -> DataFrame:
    """Newest procurement disclosure of each entity, with the newest level reported in one."""
    rows = linked_evidence(
        {**_pick(tables, "evidence_entity_links"), "evidence": tables["evidence_raw"]},
        ["evidence_type", "issue_date", "updated_at", "source_url", "title"],
    ).filter(F.col("evidence_type") == PROCUREMENT)
    newest = rows.groupBy("entity_id").agg(
        F.max(F.struct("issue_date", "updated_at", "id", "source_url", "title")).alias("top")
    )
    runs = tables["extraction_runs"].filter("success").select(F.col("id").alias("extraction_run_id"), "started_at")
    levels = (
        tables["extracted_claims"]
        .filter(F.col("field_key") == "bee_level")
        .select(
            F.col("evidence_id").alias("id"),
            "extraction_run_id",
            F.coalesce("edited_value", "normalized_value", "raw_value").alias("value"),
        )
        .join(runs, "extraction_run_id")
        .join(rows.select("entity_id", "id", "issue_date"), "id")
        .groupBy("entity_id")
        .agg(F.max(F.struct("issue_date", "started_at", "extraction_run_id", "value")).getField("value").alias("disclosure_level"))
    )
    return newest.join(levels, "entity_id", "left").select(
        "entity_id",
        F.col("top.id").alias("evidence_id"),
        F.col("top.issue_date").alias("disclosure_date"),
        F.col("top.source_url").alias("disclosure_url"),
        F.col("top.title").alias("disclosure_title"),
        "disclosure_level",
    )


def _pick(tables, *names: str) -> dict:
    return {n: tables[n] for n in names}


def confirmed_entity(tables, evidence: DataFrame) -> DataFrame:
    """Evidence with the public entity of each confirmed link; unlinked rows stay.

    Names go to the links first: after the join with the links most documents
    have no entity, and those would meet in one task.
    """
    links = tables["evidence_entity_links"].filter(F.col("link_state") == "confirmed").select(
        F.col("evidence_id").alias("id"), "entity_id"
    )
    public = tables["entities"].filter(F.col("visibility") == "public").select(
        F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"), F.col("slug").alias("entity_slug")
    )
    named = links.join(public, "entity_id", "left")
    return evidence.join(named, "id", "left").select("entity_id", *evidence.columns, "entity_name", "entity_slug")


def recent_updates(tables, page: int = 1, page_size: int = 25) -> DataFrame:
    events, entities = tables["publication_events"], tables["entities"]
    public = entities.filter(F.col("visibility") == "public").select(
        F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"), F.col("slug").alias("entity_slug")
    )
    return (
        events.join(public, "entity_id")
        .orderBy(F.desc("published_at"), F.desc("id"))
        .offset((max(1, page) - 1) * page_size)
        .limit(page_size)
    )


def expiring_or_expired(tables, mode: str, limit: int = 100) -> DataFrame:
    state = "expired" if mode == "expired" else "expiring_soon"
    rows = tables["evidence"].filter(published() & (F.col("lifecycle_state") == state)).select(
        "id", "title", "evidence_type", "expiry_date", "lifecycle_state"
    )
    order = F.desc_nulls_last("expiry_date") if mode == "expired" else F.asc_nulls_last("expiry_date")
    return confirmed_entity(tables, rows).orderBy(order, F.desc("id"), "entity_id").limit(limit)


def upcoming_expiries(tables, clock: Clock, limit: int = 8) -> DataFrame:
    return (
        tables["evidence_raw"]
        .filter(published() & (F.col("expiry_date") >= F.lit(clock.as_of)))
        .select("id", "title", "expiry_date")
        .orderBy("expiry_date", "id")
        .limit(limit)
    )


def recently_updated_companies(tables, limit: int = 8) -> DataFrame:
    state = tables["entity_current_state"].select(
        F.col("entity_id").alias("id"), "bee_level", "lifecycle_state", "published_at", "evidence_id"
    )
    top = (
        tables["entities"]
        .filter(live_entity())
        .join(state, "id", "left")
        .withColumn("changed_at", F.coalesce("published_at", "updated_at"))
        .orderBy(F.desc("changed_at"), F.desc("id"))
        .limit(limit)
    )
    disclosed = latest_disclosure_per_entity(tables).withColumnRenamed("entity_id", "id").drop("evidence_id")
    kinds = tables["evidence_raw"].select(F.col("id").alias("evidence_id"), F.col("evidence_type").alias("current_evidence_type"))
    return (
        top.select("id", "slug", "canonical_name", "bee_level", "lifecycle_state", "published_at", "changed_at", "evidence_id")
        .join(kinds, "evidence_id", "left")
        .join(disclosed, "id", "left")
        .withColumn("has_disclosure", F.col("disclosure_url").isNotNull())
    )


def home_evidence_feed(tables, clock: Clock, limit: int = 8) -> DataFrame:
    """Recent first: dated after the boundary, or a boundary-or-later year folder in the URL."""
    first_year = clock.recent_from.year
    years = "|".join(str(y) for y in range(first_year, first_year + 3))
    group = F.when(F.col("issue_date") >= F.lit(clock.recent_from), 0).when(
        F.col("source_url").rlike(f"/({years})(/|$)"), 0
    ).otherwise(1)
    rows = tables["evidence"].filter(published())
    return (
        confirmed_entity(tables, rows.select("id", "title", "evidence_type", "issue_date", "source_url", "lifecycle_state", "updated_at"))
        .withColumn("feed_group", group)
        .orderBy("feed_group", F.desc_nulls_last("issue_date"), F.desc("updated_at"), F.desc("id"), "entity_id")
        .limit(limit)
    )


def stale_sources(tables, limit: int = 8) -> DataFrame:
    return (
        tables["monitored_sources"]
        .filter("enabled")
        .select("id", "url", "last_checked_at")
        .orderBy(F.asc_nulls_first("last_checked_at"), "id")
        .limit(limit)
    )


def run_history(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def research_score() -> Column:
    """Priority of researching an entity, from ``entity_evidence_rollup`` columns."""
    def points(flag: Column, n: int) -> Column:
        return F.when(flag, n).otherwise(0)

    year, newest = F.col("latest_year"), F.col("newest_year")
    return (
        points(F.col("listed"), 40)
        + points(F.col("entity_type") == "group", 18)
        + points(~_blank("website"), 15)
        + points(~_blank("registration_number"), 8)
        + F.when(year == newest, 18).when(year == newest - 1, 12).when(year == newest - 2, 6).otherwise(0)
        + F.least(F.lit(25), F.col("procurement_count") * 3)
        + F.least(F.lit(16), F.greatest(F.lit(0), F.col("institution_count") - 1) * 4)
        + F.least(F.lit(10), F.col("evidence_count"))
        + F.when(F.col("certificate_count") == 0, 20).when(~F.col("has_current"), 12).otherwise(0)
        + points(F.col("has_parent"), 4)
    )


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def research_priority(rollup: DataFrame, eligible: DataFrame, newest_year: int, limit: int = 50) -> DataFrame:
    """Top entities by score; every eligible entity is scored, not a first slice."""
    return (
        rollup.join(eligible.select("id"), "id", "left_semi")
        .withColumn("newest_year", F.lit(newest_year))
        .withColumn("score", research_score())
        .orderBy(F.desc("score"), "canonical_name", "id")
        .limit(limit)
    )


def priority_queue(rollup: DataFrame, members: DataFrame, limit: int = 40) -> DataFrame:
    return (
        rollup.join(members.select("id"), "id", "left_semi")
        .orderBy(F.desc("evidence_count"), "canonical_name", "id")
        .limit(max(1, min(80, limit)))
    )


def cap_disclosures(disclosures: DataFrame, per_supplier: int = 8) -> DataFrame:
    """Best disclosures of each supplier: dated, then awarded, then oldest."""
    key = F.lower(F.trim(F.regexp_replace("supplier_name", r"\s+", " ")))
    unique = disclosures.withColumn("supplier_key", key).dropDuplicates(
        ["supplier_key", "source_url", "tender_number", "bee_level", "award_date"]
    )
    order = [
        F.col("award_date").isNull(),
        F.when(F.col("outcome") == "awarded", 0).otherwise(1),
        F.asc_nulls_last("award_date"),
        F.asc_nulls_last("tender_number"),
        F.asc("source_url"),
        F.asc_nulls_last("bee_level"),
    ]
    return top_per_group(unique, ["supplier_key"], order, per_supplier)


def page_after_key(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """Keyset page with the number of rows that remain behind it."""
    rest = df.filter(F.col(key) > F.lit(after))
    total = rest.select(F.count("*")).scalar()
    return rest.orderBy(key).limit(size).withColumn("remaining", F.greatest(total - F.lit(size), F.lit(0)))

