"""Directory, searches and paged lists."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.operators.common import live_entity
from attestor.operators.flags import category_condition, category_flags, queue_condition
from attestor.operators.ranking import latest_evidence_per_entity
from attestor.operators.reports import sector_names
from attestor.schemas import NON_INDUSTRY_SECTORS, Clock


@dataclass(frozen=True)
class DirectoryFilter:
    text: str | None = None
    level: str | None = None
    sector: str | None = None
    agency: str | None = None
    lifecycle: str | None = None
    category: str | None = None
    year: int | None = None
    page: int = 1
    page_size: int = 25


def _like(text: str) -> str:
    """``%`` and ``_`` of the user act as wildcards."""
    return f"%{text.strip()}%"


def company_search(tables, text: str) -> DataFrame:
    """Live entities whose names, aliases or registration contain the text."""
    pattern = _like(text)
    exact = "".join(ch for ch in text.strip().lower() if ch.isascii() and ch.isalnum())
    own = F.lit(False)
    for name in ("canonical_name", "legal_name", "trading_name", "registration_number"):
        own = own | F.coalesce(F.col(name).ilike(pattern), F.lit(False))
    own = own | F.coalesce(F.col("registration_number_normalized") == exact, F.lit(False))
    by_alias = (
        tables["entity_aliases"]
        .filter(F.col("alias").ilike(pattern) | F.col("normalized_alias").ilike(pattern))
        .select(F.col("entity_id").alias("id"))
        .distinct()
        .withColumn("_alias", F.lit(True))
    )
    return tables["entities"].filter(live_entity()).join(by_alias, "id", "left").filter(own | F.col("_alias").isNotNull()).drop("_alias")


def search_across(tables, text: str, limit: int = 20) -> DataFrame:
    """Companies and agencies that match, each ordered by name and limited."""
    pattern = _like(text)

    def hit(names: list[str]) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | F.coalesce(F.col(n).ilike(pattern), F.lit(False))
        return out

    alias = tables["entity_aliases"].filter(F.col("alias").ilike(pattern)).select(F.col("entity_id").alias("id")).distinct().withColumn("_alias", F.lit(True))
    companies = (
        tables["entities"]
        .filter(live_entity())
        .join(alias, "id", "left")
        .filter(hit(["canonical_name", "legal_name", "trading_name", "registration_number"]) | F.col("_alias").isNotNull())
        .select(F.lit("company").alias("kind"), "id", "slug", F.col("canonical_name").alias("name"), F.col("registration_number").alias("extra"))
        .orderBy("name", "id")
        .limit(limit)
    )
    agency_alias = tables["agency_aliases"].filter(F.col("alias").ilike(pattern)).select(F.col("agency_id").alias("id")).distinct().withColumn("_alias", F.lit(True))
    agencies = (
        tables["verification_agencies"]
        .filter(F.col("visibility") == "public")
        .join(agency_alias, "id", "left")
        .filter(hit(["name"]) | F.col("_alias").isNotNull())
        .select(F.lit("agency").alias("kind"), "id", "slug", "name", F.lit(None).cast("string").alias("extra"))
        .orderBy("name", "id")
        .limit(limit)
    )
    return companies.unionByName(agencies)


def company_directory(tables, clock: Clock, where: DirectoryFilter = DirectoryFilter()) -> DataFrame:
    """All matching directory rows, unpaged; see ``directory_page`` for one page."""
    entities = company_search(tables, where.text) if where.text and where.text.strip() else tables["entities"].filter(live_entity())
    if where.sector:
        in_sector = (
            tables["entity_classifications"]
            .filter(F.col("is_public") & (F.col("classification_type") == "sector"))
            .join(
                tables["sectors"].filter((F.col("slug") == where.sector) & ~F.col("id").isin(NON_INDUSTRY_SECTORS)).select(F.col("id").alias("sector_id")),
                "sector_id",
                "left_semi",
            )
            .select(F.col("entity_id").alias("id"))
        )
        entities = entities.join(in_sector, "id", "left_semi")
    state = tables["entity_current_state"].select(
        F.col("entity_id").alias("id"),
        "bee_level",
        F.col("expiry_date").alias("state_expiry"),
        F.col("lifecycle_state").alias("state"),
        F.col("verifier_agency_id").alias("state_agency_id"),
        F.col("evidence_id").alias("state_evidence_id"),
    )
    agencies = tables["verification_agencies"].select(
        F.col("id").alias("state_agency_id"), F.col("name").alias("state_agency"), F.col("slug").alias("state_agency_slug")
    )
    latest = latest_evidence_per_entity(tables, clock).select(
        F.col("entity_id").alias("id"),
        F.col("evidence_id").alias("latest_evidence_id"),
        F.col("evidence_type").alias("latest_evidence_type"),
        F.col("lifecycle_state").alias("latest_lifecycle"),
        F.col("issue_date").alias("latest_date"),
        F.col("expiry_date").alias("latest_expiry"),
        F.col("title").alias("latest_title"),
        F.col("source_url").alias("latest_url"),
        F.col("agency_name").alias("latest_agency"),
        F.col("agency_slug").alias("latest_agency_slug"),
        F.col("reported_level").alias("latest_level"),
    )
    rows = entities.join(state, "id", "left").join(agencies, "state_agency_id", "left").join(latest, "id", "left")
    if where.level:
        rows = rows.filter(F.coalesce("latest_level", "bee_level") == where.level)
    if where.lifecycle:
        rows = rows.filter(F.col("state") == where.lifecycle)
    if where.agency:
        rows = rows.filter((F.col("state_agency_slug") == where.agency) | (F.col("latest_agency_slug") == where.agency))
    if where.year:
        rows = rows.filter(F.year("latest_date") == where.year)
    flags = category_flags(tables, clock)
    if where.category:
        rows = rows.join(flags.filter(category_condition(where.category)).select("id", "has_disclosure"), "id")
    else:
        rows = rows.join(flags.select("id", "has_disclosure"), "id", "left")
    kinds = tables["evidence_raw"].select(F.col("id").alias("state_evidence_id"), F.col("evidence_type").alias("current_evidence_type"))
    names = sector_names(tables).withColumnRenamed("entity_id", "id")
    return (
        rows.join(names, "id", "left")
        .join(kinds, "state_evidence_id", "left")
        .select(
            "id",
            "slug",
            "canonical_name",
            "registration_number",
            "bee_level",
            "state_expiry",
            "state",
            "state_agency",
            "sector_names",
            F.coalesce("has_disclosure", F.lit(False)).alias("has_disclosure"),
            "current_evidence_type",
            "latest_evidence_id",
            "latest_evidence_type",
            "latest_lifecycle",
            "latest_level",
            "latest_date",
            "latest_expiry",
            "latest_title",
            "latest_url",
            "latest_agency",
        )
    )


def directory_page(tables, clock: Clock, where: DirectoryFilter = DirectoryFilter()) -> DataFrame:
    size = max(1, min(50, where.page_size))
    rows = company_directory(tables, clock, where)
    return rows.orderBy("canonical_name", "id").offset((max(1, where.page) - 1) * size).limit(size)


def _page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def admin_company_list(flags: DataFrame, text: str | None = None, visibility: str | None = None, queue: str | None = None, page: int = 1, size: int = 30) -> DataFrame:
    rows = flags.filter(F.col("merged_into_id").isNull())
    if text and text.strip():
        rows = rows.filter(F.col("canonical_name").ilike(_like(text)) | F.col("registration_number").ilike(_like(text)))
    if visibility:
        rows = rows.filter(F.col("visibility") == visibility)
    if queue:
        rows = rows.filter(queue_condition(queue))
    return _page(rows, [F.desc("updated_at"), F.desc("id")], page, size).select(
        "id", "slug", "canonical_name", "visibility", "automation_state", "registration_number", "updated_at"
    )


def evidence_list(tables, text: str | None = None, state: str | None = None, review: str | None = None, page: int = 1, size: int = 30) -> DataFrame:
    rows = tables["evidence"]
    if text and text.strip():
        p = _like(text)
        rows = rows.filter(F.col("title").ilike(p) | F.col("source_url").ilike(p) | F.col("id").cast("string").ilike(p))
    if state:
        rows = rows.filter(F.col("lifecycle_state") == state)
    if review:
        rows = rows.filter(F.col("review_state") == review)
    return _page(rows, [F.desc("created_at"), F.desc("id")], page, size).select(
        "id", "title", "evidence_type", "source_url", "lifecycle_state", "review_state", "publication_state", "issue_date", "expiry_date", "content_hash", "created_at"
    )


def review_list(tables, status: str = "pending", kind: str | None = None, page: int = 1, size: int = 30) -> DataFrame:
    rows = tables["review_items"].filter(F.col("status") == status)
    if kind:
        rows = rows.filter(F.col("type") == kind)
    top = _page(rows, [F.desc("generated_at"), F.desc("id")], page, size)
    evidence = tables["evidence_raw"].select(F.col("id").alias("evidence_id"), F.col("title").alias("evidence_title"))
    entities = tables["entities"].select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"))
    return top.join(evidence, "evidence_id", "left").join(entities, "entity_id", "left")


def source_health(tables, health: str, clock: Clock, text: str | None = None, limit: int = 200) -> DataFrame:
    rows = tables["monitored_sources"]
    if text and text.strip():
        rows = rows.filter(F.col("url").ilike(_like(text)) | F.col("domain").ilike(_like(text)))
    if health == "failed":
        rows = rows.filter(F.col("consecutive_error_count") > 0)
    elif health == "disabled":
        rows = rows.filter(~F.col("enabled"))
    elif health == "stale":
        cutoff = F.lit(clock.as_of - timedelta(days=14))
        rows = rows.filter(F.col("last_checked_at").isNull() | (F.col("last_checked_at") < cutoff))
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def audit_search(tables, text: str | None = None, limit: int = 150) -> DataFrame:
    rows = tables["audit_logs"]
    if text and text.strip():
        p = _like(text)
        rows = rows.filter(F.col("action").ilike(p) | F.col("target_id").ilike(p) | F.col("target_type").ilike(p))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def due_sources(tables, clock: Clock, limit: int = 8) -> DataFrame:
    now = F.lit(clock.as_of)
    return (
        tables["monitored_sources"]
        .filter(
            F.col("enabled")
            & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= now))
            & (F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))
            & (F.col("frequency") != "manual")
        )
        .orderBy(F.asc_nulls_first("next_check_at"), "id")
        .limit(limit)
    )


def source_next_check(sources: DataFrame, clock: Clock) -> DataFrame:
    """Next check by frequency and hours of backoff by consecutive errors."""
    errors = F.col("consecutive_error_count")
    days = F.when(F.col("frequency") == "daily", 1).when(F.col("frequency") == "weekly", 7).when(F.col("frequency") == "monthly", 30)
    return sources.select(
        "id",
        F.date_add(F.lit(clock.as_of), days).alias("next_check_at"),
        F.when(errors <= 0, 0).when(errors == 1, 1).when(errors == 2, 4).when(errors == 3, 12).otherwise(24).alias("backoff_hours"),
    )


def match_company_universe(tables, names: DataFrame) -> DataFrame:
    """(ordinal, name) rows against entities by name, else alias; public first."""
    wanted = names.select("ordinal", "name", N.normalize_name(F.col("name")).alias("key"))
    entities = tables["entities"].filter(F.col("merged_into_id").isNull()).select("id", "canonical_name", "visibility", "normalized_name")
    rank = F.struct((F.col("visibility") != "public").alias("hidden"), "canonical_name", "id", "visibility")
    by_name = entities.groupBy(F.col("normalized_name").alias("key")).agg(F.min(rank).alias("named"))
    aliases = tables["entity_aliases"].select(F.col("normalized_alias").alias("key"), F.col("entity_id").alias("id"))
    by_alias = aliases.join(entities, "id").groupBy("key").agg(F.min(rank).alias("aliased"))
    hit = F.coalesce("named", "aliased")
    return (
        wanted.join(by_name, "key", "left")
        .join(by_alias, "key", "left")
        .select(
            "ordinal",
            "name",
            hit["id"].alias("entity_id"),
            hit["canonical_name"].alias("canonical_name"),
            F.when(hit.isNull(), "missing").when(hit["hidden"], "hidden").otherwise("present").alias("state"),
        )
    )
