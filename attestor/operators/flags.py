"""Per-entity condition table and the queues, counts and audits read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.operators.common import any_where, count_where, is_status, is_valid, linked_evidence, live_entity, published
from attestor.schemas import COMPANY_DISCLOSURE_TYPES, NON_INDUSTRY_SECTORS, PROCUREMENT, Clock

QUEUES = [
    "procurement_only",
    "no_registration",
    "no_sector",
    "no_website",
    "no_current_certificate",
    "expired_certificate_only",
    "validity_unconfirmed",
    "review_required",
    "no_monitored_source",
    "multiple_evidence",
    "current_certificate",
    "expiring_soon",
    "certificate_enrichment",
    "identity_enrichment",
    "monitoring_setup",
    "expiry_replacement",
]
AUDITED_QUEUES = [
    "procurement_only",
    "no_registration",
    "no_sector",
    "no_website",
    "no_current_certificate",
    "expired_certificate_only",
    "certificate_enrichment",
    "identity_enrichment",
    "monitoring_setup",
    "expiry_replacement",
]
DISCLOSURE_ONLY_TYPES = ["company_disclosure", "company_webpage", "annual_report", "integrated_report", "transformation_report"]
CATEGORIES = [
    "current_certificate",
    "recent_evidence",
    "official_procurement_disclosure",
    "official_company_disclosure",
    "historical_evidence",
    "date_not_stated",
]


def evidence_conditions(tables, clock: Clock) -> DataFrame:
    """One aggregate over all linked evidence, whatever its link state."""
    rows = linked_evidence(
        tables,
        ["evidence_type", "lifecycle_state", "issue_date", "expiry_date", "publication_state", "verifier_agency_id", "document_issuer"],
        visible=False,
        only_published=False,
    )
    pub, kind, state = published(), F.col("evidence_type"), F.col("lifecycle_state")
    cert = pub & is_status()
    proc = kind == PROCUREMENT
    soon = F.col("expiry_date") <= F.date_add(F.lit(clock.as_of), 60)
    return rows.groupBy(F.col("entity_id").alias("id")).agg(
        count_where(pub).alias("evidence_count"),
        count_where(pub & proc).alias("procurement_count"),
        count_where(cert).alias("certificate_count"),
        any_where(cert & is_valid()).alias("valid_certificate"),
        any_where(cert & (state == "expired")).alias("expired_certificate"),
        any_where(cert & (state == "unknown_validity")).alias("unknown_certificate"),
        any_where(state == "unknown_validity").alias("unknown_evidence"),
        any_where(pub & kind.isin(DISCLOSURE_ONLY_TYPES)).alias("has_disclosure_type"),
        any_where(cert & ((state == "expired") | ((state == "expiring_soon") & soon))).alias("needs_replacement"),
        any_where(F.col("verifier_agency_id").isNotNull()).alias("has_verifier"),
        F.size(F.collect_set(F.when(pub, kind))).alias("type_count"),
        F.max(F.when(proc, F.year("issue_date"))).alias("latest_year"),
        any_where(pub & proc & (F.col("issue_date") >= F.add_months(F.lit(clock.recent_from), 12))).alias("recent_procurement"),
    )


def institution_counts(tables) -> DataFrame:
    """Distinct issuers per entity.

    The set of issuers of a hot entity is unbounded, so it is counted in two
    aggregates instead of in one collected set.
    """
    rows = linked_evidence(
        {"evidence_entity_links": tables["evidence_entity_links"], "evidence": tables["evidence_raw"]},
        ["document_issuer"],
        visible=False,
    )
    return (
        rows.filter(F.col("document_issuer").isNotNull())
        .select(F.col("entity_id").alias("id"), "document_issuer")
        .distinct()
        .groupBy("id")
        .agg(F.count("*").alias("institution_count"))
    )


def entity_flags(tables, clock: Clock) -> DataFrame:
    """Every entity with one column per condition the queues test."""
    entities = tables["entities"].select(
        "id", "slug", "canonical_name", "registration_number", "website", "visibility", "merged_into_id", "entity_type", "automation_state", "updated_at"
    )
    state = tables["entity_current_state"].select(F.col("entity_id").alias("id"), F.col("lifecycle_state").alias("current_state"))
    sector = tables["entity_classifications"].groupBy(F.col("entity_id").alias("id")).agg(
        any_where(
            F.col("is_public")
            & (F.col("classification_type") == "sector")
            & ~F.col("sector_id").isin(NON_INDUSTRY_SECTORS)
        ).alias("has_sector"),
        any_where(F.col("sector_id") == "sec_jse").alias("listed"),
    )
    relations = tables["entity_relationships"].groupBy(F.col("source_entity_id").alias("id")).agg(
        any_where(F.col("relationship_type") == "parent").alias("has_parent_edge"),
        any_where(F.col("relationship_type").isin("parent", "holding_company")).alias("has_parent"),
    )
    hosts = tables["entities"].select(F.col("id").alias("entity_id"), N.website_host(F.col("website")).alias("host"))
    sources = (
        tables["monitored_sources"]
        .select("entity_id", "domain")
        .join(hosts, "entity_id")
        .groupBy(F.col("entity_id").alias("id"))
        .agg(F.lit(True).alias("has_source"), any_where(F.col("domain") == F.col("host")).alias("has_official_source"))
    )
    reviews = (
        tables["review_items"].filter(F.col("status") == "pending").select(F.col("entity_id").alias("id")).distinct().withColumn("has_pending_review", F.lit(True))
    )
    joined = entities
    for part in (evidence_conditions(tables, clock), institution_counts(tables), state, sector, relations, sources, reviews):
        joined = joined.join(part, "id", "left")
    counts = ["evidence_count", "procurement_count", "certificate_count", "type_count", "institution_count"]
    booleans = [
        "valid_certificate",
        "expired_certificate",
        "unknown_certificate",
        "unknown_evidence",
        "has_disclosure_type",
        "needs_replacement",
        "has_verifier",
        "recent_procurement",
        "has_sector",
        "listed",
        "has_parent_edge",
        "has_parent",
        "has_source",
        "has_official_source",
        "has_pending_review",
    ]
    return joined.fillna(0, counts).fillna(False, booleans)


def queue_condition(queue: str) -> Column:
    """Predicate of a named work queue over ``entity_flags``."""
    public = F.col("visibility") == "public"
    no_reg, no_site = N.blank(F.col("registration_number")), N.blank(F.col("website"))
    procured, certified = F.col("procurement_count") > 0, F.col("certificate_count") > 0
    current = F.coalesce(F.col("current_state").isin("current", "expiring_soon"), F.lit(False))
    soon = F.coalesce(F.col("current_state") == "expiring_soon", F.lit(False))
    unknown = F.coalesce(F.col("current_state") == "unknown_validity", F.lit(False))
    return {
        "procurement_only": procured & ~certified,
        "no_registration": no_reg,
        "no_sector": ~F.col("has_sector"),
        "no_website": no_site,
        "no_current_certificate": ~current,
        "expired_certificate_only": F.col("expired_certificate") & ~F.col("valid_certificate"),
        "validity_unconfirmed": F.col("unknown_evidence") | unknown,
        "review_required": F.col("has_pending_review"),
        "no_monitored_source": ~F.col("has_source"),
        "multiple_evidence": F.col("evidence_count") >= 2,
        "current_certificate": current,
        "expiring_soon": soon,
        "certificate_enrichment": public & ~no_site & procured & ~certified,
        "identity_enrichment": public & no_reg & procured,
        "monitoring_setup": public & ~no_site & ~F.col("has_official_source"),
        "expiry_replacement": public & F.col("needs_replacement"),
    }[queue]


def enrichment_eligible() -> Column:
    """An entity with any gap that enrichment could fill."""
    names = [
        "procurement_only",
        "no_registration",
        "no_sector",
        "no_website",
        "no_current_certificate",
        "expired_certificate_only",
        "no_monitored_source",
    ]
    out = queue_condition(names[0])
    for n in names[1:]:
        out = out | queue_condition(n)
    return out


def research_queue(flags: DataFrame, queue: str) -> DataFrame:
    return flags.filter(live_entity() & queue_condition(queue))


def queue_counts(flags: DataFrame, queues: list[str] | None = None) -> DataFrame:
    queues = queues or QUEUES
    counts = flags.filter(live_entity()).agg(*[count_where(queue_condition(q)).alias(q) for q in queues])
    return counts.unpivot([], queues, "queue", "n")


def eligibility_counts(flags: DataFrame) -> DataFrame:
    live = flags.filter(live_entity())
    return live.agg(
        count_where(enrichment_eligible()).alias("eligible"),
        count_where(enrichment_eligible() & F.col("recent_procurement")).alias("high_priority"),
        *[
            count_where(queue_condition(q)).alias(q)
            for q in (
                "procurement_only",
                "no_registration",
                "no_sector",
                "no_website",
                "no_current_certificate",
                "expired_certificate_only",
                "no_monitored_source",
            )
        ],
    )


def enrichment_audit(flags: DataFrame, average: DataFrame) -> DataFrame:
    """Eighteen quality counts over live entities, in one pass."""
    q = queue_condition
    certified = F.col("certificate_count") > 0
    counts = flags.filter(live_entity()).agg(
        F.count("*").alias("published"),
        count_where(q("current_certificate")).alias("with_current_certificate"),
        count_where(q("expiring_soon")).alias("with_expiring_certificate"),
        count_where(q("expired_certificate_only")).alias("expired_certificate_only"),
        count_where(F.col("unknown_certificate")).alias("unknown_validity_certificate"),
        count_where(certified).alias("certificate_backed"),
        count_where(q("procurement_only")).alias("procurement_only"),
        count_where(F.col("has_disclosure_type") & ~certified & (F.col("procurement_count") == 0)).alias("disclosure_only"),
        count_where(F.col("type_count") >= 2).alias("multiple_evidence_types"),
        count_where(q("no_registration")).alias("missing_registration"),
        count_where(q("no_sector")).alias("missing_sector"),
        count_where(q("no_website")).alias("missing_website"),
        count_where(~F.col("has_parent_edge")).alias("missing_parent"),
        count_where(~certified).alias("missing_certificate"),
        count_where(~F.col("has_verifier")).alias("missing_verifier"),
        count_where(F.col("has_source")).alias("with_monitored_source"),
        count_where(F.col("has_official_source")).alias("with_official_domain_source"),
    )
    return counts.withColumn("average_evidence", average.scalar())


def avg_evidence_per_entity(tables) -> DataFrame:
    """Average number of link rows per live entity, whatever the evidence state."""
    live = tables["entities"].filter(live_entity())
    links = tables["evidence_entity_links"].join(live.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    n_links = links.select(F.count("*")).scalar()
    return live.agg(F.round(F.coalesce(n_links / F.count("*"), F.lit(0.0)), 2).alias("average_evidence"))


def entity_evidence_rollup(flags: DataFrame) -> DataFrame:
    current = F.coalesce(F.col("current_state").isin("current", "expiring_soon"), F.lit(False))
    return flags.filter(live_entity()).select(
        "id",
        "slug",
        "canonical_name",
        "registration_number",
        "website",
        "entity_type",
        "evidence_count",
        "procurement_count",
        "institution_count",
        "latest_year",
        "certificate_count",
        current.alias("has_current"),
        "listed",
        "has_parent",
    )


def category_flags(tables, clock: Clock) -> DataFrame:
    """Per entity: which directory categories its visible published evidence meets."""
    rows = linked_evidence(tables, ["evidence_type", "lifecycle_state", "issue_date"])
    recent_from = F.lit(clock.recent_from)
    dated, recent = F.col("issue_date").isNotNull(), F.col("issue_date") >= recent_from
    return rows.groupBy(F.col("entity_id").alias("id")).agg(
        any_where(is_status() & is_valid()).alias("valid"),
        any_where(recent).alias("recent"),
        any_where(recent & (F.col("evidence_type") == PROCUREMENT)).alias("recent_procurement"),
        any_where(recent & F.col("evidence_type").isin(COMPANY_DISCLOSURE_TYPES)).alias("recent_company"),
        any_where(F.col("issue_date") < recent_from).alias("old"),
        any_where(dated).alias("dated"),
        any_where(F.col("evidence_type") == PROCUREMENT).alias("has_disclosure"),
    )


def category_condition(category: str) -> Column:
    return {
        "current_certificate": F.col("valid"),
        "recent_evidence": F.col("recent"),
        "official_procurement_disclosure": F.col("recent_procurement"),
        "official_company_disclosure": F.col("recent_company"),
        "historical_evidence": F.col("old") & ~F.col("recent") & ~F.col("valid"),
        "date_not_stated": ~F.col("dated"),
    }[category]


def evidence_category_filter(tables, category: str, clock: Clock) -> DataFrame:
    """Live entities in a category (an entity without evidence is in none)."""
    return tables["entities"].filter(live_entity()).join(category_flags(tables, clock), "id").filter(category_condition(category))


def entities_with_evidence(tables, evidence_type: str) -> DataFrame:
    rows = linked_evidence(
        {"evidence_entity_links": tables["evidence_entity_links"], "evidence": tables["evidence_raw"]}, ["evidence_type"]
    ).filter(F.col("evidence_type") == evidence_type)
    return tables["entities"].filter(live_entity()).join(rows.select(F.col("entity_id").alias("id")), "id", "left_semi")


def entities_without_current(tables, clock: Clock) -> DataFrame:
    """Live entities with only historical or only undated evidence."""
    rows = tables["entities"].filter(live_entity()).select("id", "canonical_name").join(category_flags(tables, clock), "id")
    historical = category_condition("historical_evidence")
    undated = category_condition("date_not_stated") & ~F.col("valid")
    return rows.filter(historical | undated).select(
        "id", "canonical_name", F.when(historical, "historical_only").otherwise("undated").alias("reason")
    )


