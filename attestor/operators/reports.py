"""Headline counts and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.common import count_where, is_status, is_valid, linked_evidence, live_entity, published, top_per_group
from attestor.operators.flags import category_condition, category_flags, queue_condition
from attestor.schemas import NON_INDUSTRY_SECTORS, PAST_STATES, PROCUREMENT, Clock


def _row(*parts: DataFrame) -> DataFrame:
    """One-row aggregates side by side, read as scalar sub-queries."""
    first, *rest = parts
    for part in rest:
        first = first.withColumns({c: part.select(c).scalar() for c in part.columns})
    return first


def public_stats(tables, clock: Clock, years: list[int]) -> DataFrame:
    """Thirteen headline counts: one pass per fact table."""
    live = tables["entities"].filter(live_entity())
    evidence = tables["evidence"].filter(published()).agg(
        F.count("*").alias("evidence"),
        count_where(F.col("lifecycle_state").isin(PAST_STATES)).alias("historical"),
        count_where(is_valid() & is_status()).alias("current_certificates"),
        count_where(F.col("evidence_type") == PROCUREMENT).alias("official_disclosures"),
    )
    verifiers = tables["verification_agencies"].agg(count_where(F.col("visibility") == "public").alias("verifiers"))
    events = tables["publication_events"].agg(
        count_where(
            F.col("published_at") >= F.lit(clock.events_as_of).cast("timestamp_ntz") - F.expr("INTERVAL 30 DAYS")
        ).alias("updated_30d")
    )
    flags = live.select("id").join(category_flags(tables, clock), "id", "left")
    companies = flags.agg(
        F.count("*").alias("companies"),
        count_where(F.col("recent")).alias("recent_companies"),
        count_where(category_condition("historical_evidence")).alias("historical_only"),
        count_where(category_condition("date_not_stated") & ~F.col("valid")).alias("undated_official"),
    )
    by_year = companies_by_evidence_year(tables).agg(
        *[F.coalesce(F.sum(F.when(F.col("year") == y, F.col("companies"))), F.lit(0)).alias(f"with_{y}") for y in years]
    )
    return _row(companies, evidence, verifiers, events, by_year)


def companies_by_evidence_year(tables) -> DataFrame:
    """Distinct live entities with visible published evidence issued in each year."""
    rows = linked_evidence(
        {"evidence_entity_links": tables["evidence_entity_links"], "evidence": tables["evidence_raw"]}, ["issue_date"]
    )
    live = tables["entities"].filter(live_entity()).select(F.col("id").alias("entity_id"))
    return (
        rows.filter(F.col("issue_date").isNotNull())
        .select("entity_id", F.year("issue_date").alias("year"))
        .distinct()
        .join(live, "entity_id", "left_semi")
        .groupBy("year")
        .agg(F.count("*").alias("companies"))
    )


def sector_counts(tables) -> DataFrame:
    """Public classification rows per sector; sectors without any are kept."""
    counts = (
        tables["entity_classifications"]
        .filter(F.col("is_public") & (F.col("classification_type") == "sector"))
        .groupBy(F.col("sector_id").alias("id"))
        .agg(F.count("*").alias("n"))
    )
    return (
        tables["sectors"].filter(~F.col("id").isin(NON_INDUSTRY_SECTORS)).join(counts, "id", "left").fillna(0, ["n"]).select("id", "slug", "name", "n")
    )


def genuine_sectors(tables) -> DataFrame:
    return tables["entity_classifications"].filter(
        F.col("is_public") & (F.col("classification_type") == "sector") & ~F.col("sector_id").isin(NON_INDUSTRY_SECTORS)
    )


def sector_coverage(tables) -> DataFrame:
    """Share of live entities with a genuine sector."""
    live = tables["entities"].filter(live_entity()).select("id")
    has = genuine_sectors(tables).select(F.col("entity_id").alias("id")).distinct().withColumn("has", F.lit(True))
    totals = live.join(has, "id", "left").agg(
        F.count("*").alias("published"), count_where(F.col("has")).alias("with_sector")
    )
    return totals.select(
        "published",
        "with_sector",
        (F.col("published") - F.col("with_sector")).alias("missing"),
        F.round(F.when(F.col("published") > 0, F.col("with_sector") * 100.0 / F.col("published")).otherwise(0.0), 1).alias("coverage"),
    )


def sector_distribution(tables) -> DataFrame:
    live = tables["entities"].filter(live_entity()).select(F.col("id").alias("entity_id"))
    names = tables["sectors"].select(F.col("id").alias("sector_id"), "name")
    return (
        genuine_sectors(tables)
        .select("entity_id", "sector_id")
        .distinct()
        .join(live, "entity_id", "left_semi")
        .groupBy("sector_id")
        .agg(F.count("*").alias("n"))
        .join(names, "sector_id")
    )


def agency_evidence_counts(tables, text: str | None = None) -> DataFrame:
    agencies = tables["verification_agencies"].filter(F.col("visibility") == "public")
    if text and text.strip():
        agencies = agencies.filter(F.col("name").ilike(f"%{text.strip()}%"))
    counts = (
        tables["evidence_raw"].filter(published()).groupBy(F.col("verifier_agency_id").alias("id")).agg(F.count("*").alias("evidence_count"))
    )
    return agencies.select("id", "slug", "name", "website").join(counts, "id", "left").fillna(0, ["evidence_count"])


def dashboard_counts(tables, flags: DataFrame) -> DataFrame:
    """Table counts, lifecycle breakdown and completeness gaps."""
    state = F.col("lifecycle_state")
    companies = flags.agg(
        count_where(F.col("merged_into_id").isNull()).alias("tracked"),
        count_where(live_entity()).alias("visible"),
        count_where(live_entity() & queue_condition("no_registration")).alias("no_registration"),
        count_where(live_entity() & queue_condition("no_website")).alias("no_website"),
        count_where(live_entity() & queue_condition("procurement_only")).alias("procurement_only"),
        count_where(live_entity() & queue_condition("no_monitored_source")).alias("no_monitored_source"),
    )
    classified = tables["entity_classifications"].select(F.col("entity_id").alias("id")).distinct()
    no_sector = tables["entities"].filter(live_entity()).join(classified, "id", "left_anti").agg(F.count("*").alias("no_sector"))
    evidence = tables["evidence"].agg(
        F.count("*").alias("evidence"),
        count_where(state == "current").alias("current"),
        count_where(state.isin("historical", "superseded")).alias("historical"),
        count_where(state == "expired").alias("expired"),
        count_where(state == "expiring_soon").alias("expiring"),
        count_where(state == "unknown_validity").alias("unknown_validity"),
    )
    pending = F.col("status") == "pending"
    reviews = tables["review_items"].agg(
        count_where(pending).alias("review"),
        count_where(pending & (F.col("type") == "uncertain_entity_match")).alias("matches"),
    )
    submissions = tables["submissions"].agg(count_where(pending).alias("submissions"))
    sources = tables["monitored_sources"].agg(F.count("*").alias("sources"))
    verifiers = tables["verification_agencies"].agg(F.count("*").alias("verifiers"))
    return _row(companies, no_sector, evidence, reviews, submissions, sources, verifiers)


def activity_last_days(tables, clock: Clock, days: int = 7) -> DataFrame:
    """Six activity counts over the last days of each table's clock."""
    since = F.lit(clock.events_as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    day = F.date_sub(F.lit(clock.as_of), days)
    runs = tables["extraction_runs"].agg(
        count_where((F.col("started_at") >= day) & F.col("success")).alias("extracted"),
        count_where((F.col("started_at") >= day) & ~F.col("success")).alias("extract_failed"),
    )
    checks = tables["source_checks"].agg(count_where(F.col("started_at") >= since).alias("sources_checked"))
    evidence = tables["evidence_raw"].agg(count_where(F.col("created_at") >= day).alias("new_evidence"))
    events = tables["publication_events"].agg(
        count_where((F.col("published_at") >= since) & (F.col("event_type") == "auto_published")).alias("auto_published")
    )
    jobs = tables["crawler_jobs"].agg(
        count_where((F.col("created_at") >= since) & (F.col("state") == "failed")).alias("crawler_failed")
    )
    return _row(runs, checks, evidence, events, jobs)


def review_breakdown(tables, samples: int = 8) -> DataFrame:
    """Pending reviews per type with the newest samples of each type."""
    pending = tables["review_items"].filter(F.col("status") == "pending")
    counts = pending.groupBy("type").agg(F.count("*").alias("n"))
    top = top_per_group(pending, ["type"], [F.desc("generated_at"), F.desc("id")], samples).withColumnRenamed("_rank", "position")
    evidence = tables["evidence_raw"].select(
        F.col("id").alias("evidence_id"), F.col("title").alias("evidence_title"), "publication_state", "evidence_type"
    )
    entities = tables["entities"].select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"), "visibility")
    return (
        top.join(counts, "type")
        .join(evidence, "evidence_id", "left")
        .join(entities, "entity_id", "left")
        .select("type", "n", "position", "id", "reason", "entity_name", "evidence_title", "publication_state", "evidence_type", "visibility")
    )


def duplicate_name_groups(tables, limit: int = 40) -> DataFrame:
    """Normalised names held by more than one unmerged entity, largest first.

    One row per member of the listed groups, however large they are.
    """
    rows = tables["entities"].filter(F.col("merged_into_id").isNull()).select("normalized_name", F.col("id").alias("entity_id"), "canonical_name")
    top = (
        rows.groupBy("normalized_name")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .orderBy(F.desc("n"), "normalized_name")
        .limit(limit)
    )
    # At most ``limit`` rows, so the broadcast is bounded by the parameter.
    return rows.join(F.broadcast(top), "normalized_name").select("normalized_name", "n", "entity_id", "canonical_name")


def corpus_stats(tables) -> DataFrame:
    """Counts that describe the repair state of the corpus."""
    state, expiry = F.col("lifecycle_state"), F.col("expiry_date")
    evidence = tables["evidence"].agg(
        F.count("*").alias("evidence"),
        count_where(state == "current").alias("current"),
        count_where(state.isin("historical", "superseded")).alias("historical"),
        count_where(state == "expired").alias("expired"),
        count_where(state == "disputed").alias("disputed"),
        count_where(state == "expiring_soon").alias("expiring"),
        count_where(state == "unknown_validity").alias("unknown_validity"),
        count_where(F.col("verifier_agency_id").isNotNull()).alias("agencies_linked"),
        count_where(expiry.isNotNull()).alias("expiry_set"),
        count_where(expiry.isNull()).alias("expiry_missing"),
        count_where(is_valid() & expiry.isNull()).alias("current_without_expiry"),
        count_where(published() & (F.col("evidence_type") == PROCUREMENT)).alias("official_disclosures"),
    )
    state_rows = tables["entity_current_state"].select(F.col("entity_id").alias("id"), "lifecycle_state")
    companies = tables["entities"].join(state_rows, "id", "left").agg(
        count_where(F.col("merged_into_id").isNull()).alias("entities"),
        count_where(live_entity()).alias("published"),
        count_where(live_entity() & ~F.coalesce(is_valid(), F.lit(False))).alias("without_current_certificate"),
    )
    locks = tables["field_overrides"].agg(count_where(F.col("locked")).alias("field_overrides"))
    reviews = tables["review_items"].agg(count_where(F.col("status") == "pending").alias("review"))
    return _row(evidence, companies, locks, reviews)


def sector_names(tables) -> DataFrame:
    """Public sector names of each entity as one ordered list."""
    names = tables["sectors"].select(F.col("id").alias("sector_id"), "name")
    return (
        tables["entity_classifications"]
        .filter("is_public")
        .select("entity_id", "sector_id", "classification_type")
        .join(names, "sector_id")
        .groupBy("entity_id")
        .agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("sector_names"))
    )


def rejection_summary(candidates: DataFrame) -> DataFrame:
    """Per document: candidates, valid and rejected rows."""
    ok = F.size("reasons") == 0
    return candidates.groupBy("document_id").agg(
        F.count("*").alias("candidates"), count_where(ok).alias("valid"), count_where(~ok).alias("rejected")
    )


def rejection_reasons(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.explode_outer("reasons").alias("reason")).filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def enrichment_rollup(results: DataFrame) -> DataFrame:
    counters = ["attempted", "enriched", "certificates_found", "registrations_found", "domains_found", "errors"]
    return results.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in counters], F.max("at").alias("created_at"))
