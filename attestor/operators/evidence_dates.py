"""Resolved source dates of evidence and everything decided from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import dates as D
from attestor.functions import names as N
from attestor.operators.common import any_where, computed, count_where, is_status, is_valid, linked_evidence, live_entity, top_per_group
from attestor.operators.ranking import evidence_rank
from attestor.schemas import COMPANY_DISCLOSURE_TYPES, DISCLOSURE_TYPES, PROCUREMENT, Clock

# --- fixed values: labels ---------------------------------------------------
KIND_LABELS = {
    "current_certificate": "Current certificate",
    "expiring_soon": "Expiring soon",
    "official_company_disclosure": "Official company disclosure",
    "official_procurement_disclosure": "Official procurement disclosure",
    "validity_unconfirmed": "Validity unconfirmed",
    "expired_certificate": "Expired certificate",
    "historical_certificate": "Historical certificate",
    "historical_procurement_disclosure": "Historical procurement disclosure",
    "historical_disclosure": "Historical disclosure",
    "official_undated": "Official evidence — source date not stated",
    "other": "Public evidence",
}
DATE_INPUT = ["issue_date", "issue_date_precision", "issue_date_raw", "title", "source_url", "created_at", "retrieved_at", "discovered_at"]


def resolve_evidence_dates(evidence: DataFrame) -> DataFrame:
    """Evidence with ``resolved``: iso, precision, label, year, month, stated.

    A stored date equal to an import day is ignored; an invented day is
    demoted to what the source states.
    """
    title, url, stored = F.col("title"), F.col("source_url"), F.col("issue_date")
    blobs = computed(evidence, **D.date_blobs(F.col("issue_date_raw"), title, url))
    staged = computed(
        blobs,
        _inferred=D.inferred_parts(title, url),
        import_day=D.is_import_day(stored, F.col("created_at"), F.col("retrieved_at"), F.col("discovered_at")),
    )
    chosen = D.resolve_parts(F.col("_inferred"), stored, F.col("issue_date_precision"), F.col("import_day"), title, url)
    staged = computed(staged, _chosen=chosen)
    return computed(staged, resolved=D.describe_parts(F.col("_chosen"))).drop("_raw", "_title", "_name", "_inferred", "_chosen")


def evidence_kind(clock: Clock) -> Column:
    """Kind of a document from type, lifecycle and resolved date."""
    kind, state = F.col("evidence_type"), F.col("lifecycle_state")
    stated = F.col("resolved.stated")
    recent = F.coalesce(F.col("resolved.iso") >= F.lit(clock.recent_from.isoformat()), F.lit(False))
    certificate = (
        F.when(state == "current", "current_certificate")
        .when(state == "expiring_soon", "expiring_soon")
        .when(state == "unknown_validity", "validity_unconfirmed")
        .when(state == "expired", "expired_certificate")
        .otherwise("historical_certificate")
    )
    procured = F.when(recent, "official_procurement_disclosure").otherwise("historical_procurement_disclosure")
    other = F.when(recent, "official_company_disclosure").otherwise("historical_disclosure")
    return (
        F.when(is_status(), certificate)
        .when(~stated, "official_undated")
        .when(kind.isin(DISCLOSURE_TYPES), procured)
        .otherwise(other)
    )


def kind_rank(kind: Column) -> Column:
    ranks = {
        "current_certificate": 100,
        "expiring_soon": 90,
        "official_company_disclosure": 80,
        "official_procurement_disclosure": 70,
        "validity_unconfirmed": 60,
        "expired_certificate": 50,
        "historical_certificate": 50,
        "historical_procurement_disclosure": 40,
        "historical_disclosure": 40,
        "official_undated": 35,
    }
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ranks.items() for x in p]), kind), F.lit(30))


def timeline_by_resolved_date(tables) -> DataFrame:
    """Visible documents of each entity with the resolved date they sort by.

    Dated rows come before undated ones; the reader sorts by
    (entity_id, undated, sort_date desc, evidence_id).
    """
    rows = resolve_evidence_dates(
        linked_evidence({"evidence_entity_links": tables["evidence_entity_links"], "evidence": tables["evidence_raw"]}, DATE_INPUT)
    )
    return rows.select(
        "entity_id",
        F.col("id").alias("evidence_id"),
        (~F.col("resolved.stated")).alias("undated"),
        F.col("resolved.iso").alias("sort_date"),
        F.col("resolved.label").alias("label"),
    )


def date_audit_bucket() -> Column:
    precision = F.col("resolved.precision")
    return (
        F.when(F.col("issue_date").isNull() | F.col("import_day"), "import_timestamp")
        .when(~F.col("resolved.stated"), "unknown")
        .when(precision == "day", "exact")
        .otherwise(precision)
    )


def evidence_date_audit(evidence: DataFrame) -> DataFrame:
    """Rows and needed corrections per date bucket."""
    return (
        evidence_date_repair(evidence)
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), count_where(F.col("date_changed")).alias("corrected"), count_where(F.col("title_changed")).alias("titles_polished"))
    )


def evidence_date_repair(evidence: DataFrame) -> DataFrame:
    """Corrected date, precision, raw text and title of every document."""
    rows = resolve_evidence_dates(evidence)
    polished = F.when((F.col("evidence_type") == PROCUREMENT) | F.col("evidence_type").isNull(), D.polish_title(F.col("title"))).otherwise(F.col("title"))
    out = rows.select(
        "id",
        date_audit_bucket().alias("bucket"),
        F.col("resolved.iso").alias("new_date"),
        F.col("resolved.precision").alias("new_precision"),
        F.when(F.col("resolved.stated"), F.col("resolved.label")).otherwise(F.col("issue_date_raw")).alias("new_raw"),
        polished.alias("new_title"),
        "title",
        F.date_format("issue_date", "yyyy-MM-dd").alias("old_date"),
        "issue_date_precision",
    )
    return out.select(
        "id",
        "bucket",
        "new_date",
        "new_precision",
        "new_raw",
        "new_title",
        (~F.col("old_date").eqNullSafe(F.col("new_date")) | ~F.col("issue_date_precision").eqNullSafe(F.col("new_precision"))).alias("date_changed"),
        F.coalesce(F.col("new_title") != F.col("title"), F.lit(False)).alias("title_changed"),
    )


HISTORICAL_KINDS = ["historical_procurement_disclosure", "historical_disclosure", "historical_certificate", "expired_certificate"]


def eligible_evidence(tables, clock: Clock) -> DataFrame:
    """Visible documents with date eligibility and whether they qualify an entity."""
    rows = resolve_evidence_dates(linked_evidence(tables, ["evidence_type", "lifecycle_state", *DATE_INPUT]))
    dated = D.eligibility(F.col("resolved"), F.lit(clock.recent_from))
    current = is_status() & is_valid()
    # This rank counts web pages as company disclosures, unlike the directory's.
    web = (F.col("evidence_type") == "company_webpage") & F.coalesce(F.col("issue_date") >= F.lit(clock.recent_from), F.lit(False))
    return rows.select(
        "*",
        dated.alias("eligibility"),
        current.alias("current"),
        (current | (dated == "modern")).alias("qualifies"),
        evidence_kind(clock).alias("kind"),
        F.when(web, 80).otherwise(evidence_rank(clock)).alias("directory_rank"),
    )


def classify_eligibility(tables, clock: Clock) -> DataFrame:
    """Keep or unpublish each live entity, with counts and reason."""
    rows = eligible_evidence(tables, clock)
    status = F.col("eligibility")
    disclosure = F.col("evidence_type").isin(DISCLOSURE_TYPES + COMPANY_DISCLOSURE_TYPES)
    grouped = rows.groupBy("entity_id").agg(
        count_where(status == "modern").alias("modern_count"),
        count_where(status == "past").alias("past_count"),
        count_where(status == "unknown").alias("unknown_count"),
        count_where(F.col("qualifies")).alias("qualifying_count"),
        any_where(F.col("current")).alias("current_certificate"),
        F.min("id").alias("first_evidence_id"),
        F.max(F.struct(kind_rank(F.col("kind")).alias("r"), F.col("resolved.iso").alias("d"), F.col("id"), F.col("kind"))).getField("kind").alias("latest_kind"),
        F.max(
            F.struct(F.col("directory_rank").alias("r"), F.col("issue_date"), F.col("id"), (disclosure & (status != "modern")).alias("old"))
        ).getField("old").alias("directory_historical"),
    )
    entities = tables["entities"].filter(live_entity()).select(F.col("id").alias("entity_id"))
    joined = entities.join(grouped, "entity_id", "left").fillna(0, ["modern_count", "past_count", "unknown_count", "qualifying_count"]).fillna(False, ["current_certificate", "directory_historical"])
    qualifies = F.col("qualifying_count") > 0
    none = (F.col("modern_count") + F.col("past_count") + F.col("unknown_count")) == 0
    historical = F.coalesce(F.col("latest_kind").isin(HISTORICAL_KINDS), F.lit(False))
    only_unknown = (F.col("unknown_count") > 0) & (F.col("past_count") == 0)
    bucket = (
        F.when(qualifies & (F.col("directory_historical") | historical), "keep_has_newer")
        .when(qualifies, "keep_qualifying_latest")
        .when(none | only_unknown, "unpublish_unknown")
        .otherwise("unpublish_past")
    )
    reason = (
        F.when(bucket == "keep_has_newer", "A historical record is the latest shown, but recent or current-certificate evidence also exists.")
        .when(qualifies & F.col("current_certificate"), "Current or expiring-soon certificate.")
        .when(qualifies, "Has stated recent qualifying evidence.")
        .when(none, "No published evidence.")
        .when(only_unknown, "Only evidence with dates not stated in the source.")
        .when(F.col("unknown_count") > 0, "No recent qualifying evidence; the rest is old or undated.")
        .otherwise("Only evidence from before the boundary.")
    )
    return joined.select(
        "*",
        bucket.alias("bucket"),
        (~qualifies & (none | (F.col("unknown_count") > 0))).alias("needs_review"),
        reason.alias("reason"),
    )


def corpus_state(tables, clock: Clock) -> DataFrame:
    """Publication state of every live entity."""
    rows = eligible_evidence(tables, clock).groupBy("entity_id").agg(
        any_where(F.col("current")).alias("c"),
        any_where(F.col("eligibility") == "modern").alias("m"),
        any_where(F.col("eligibility") == "past").alias("h"),
    )
    entities = tables["entities"].filter(live_entity()).select(F.col("id").alias("entity_id"))
    return entities.join(rows, "entity_id", "left").select(
        "entity_id",
        F.when(F.col("c"), "current_certificate").when(F.col("m"), "recent_public_evidence").when(F.col("h"), "historical_evidence_only").otherwise("official_undated").alias("state"),
    )


def recency_audit(classified: DataFrame, samples: int = 5) -> DataFrame:
    """Bucket counts with the first sample entities of each bucket."""
    counts = classified.groupBy("bucket").agg(F.count("*").alias("n"), count_where(F.col("needs_review")).alias("needs_review"))
    first = top_per_group(classified.select("bucket", "entity_id"), ["bucket"], [F.asc("entity_id")], samples)
    listed = first.groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("entity_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(listed, "bucket")


def withdraw_ineligible(tables, classified: DataFrame) -> DataFrame:
    """Entities to hide, with the audit reason and whether a review opens."""
    return classified.filter(F.col("bucket").startswith("unpublish")).select(
        "entity_id",
        F.lit("hidden").alias("visibility"),
        "reason",
        F.when(F.col("needs_review"), "invalid_dates").alias("review_type"),
    )


def withdrawal_audit(classified: DataFrame, clock: Clock) -> DataFrame:
    """One audit row for each hidden entity."""
    boundary = F.date_format(F.lit(clock.recent_from), "d MMMM yyyy")
    unknown = F.lit("Public page withdrawn: all evidence is undated. An unknown date does not count as recent. Entity, evidence and provenance were kept.")
    stale = F.concat(F.lit("Public page withdrawn: no qualifying evidence dated "), boundary, F.lit(" or later. Historical records were kept."))
    return classified.filter(F.col("bucket").startswith("unpublish")).select(
        F.lit("entity.unpublished").alias("action"),
        F.lit("entity").alias("target_type"),
        F.col("entity_id").alias("target_id"),
        F.lit("public").alias("before_visibility"),
        F.lit("hidden").alias("after_visibility"),
        "bucket",
        F.when(F.col("bucket") == "unpublish_unknown", unknown).otherwise(stale).alias("reason"),
    )


def withdrawal_reviews(classified: DataFrame) -> DataFrame:
    """The review that each hidden entity with undated evidence opens, at its first document."""
    return classified.filter(F.col("bucket").startswith("unpublish") & F.col("needs_review")).select(
        F.lit("invalid_dates").alias("type"),
        F.lit("normal").alias("severity"),
        F.concat(F.lit("Unpublished after the recency audit: "), "reason", F.lit(" Publish again only if recent qualifying evidence is found.")).alias("reason"),
        "entity_id",
        F.col("first_evidence_id").alias("evidence_id"),
        "bucket",
        "unknown_count",
        "past_count",
    )


def latest_summary(tables, clock: Clock, latest: DataFrame) -> DataFrame:
    """One line about the latest evidence: level, kind, source, date."""
    dates = tables["evidence_raw"].select(F.col("id").alias("evidence_id"), "issue_date_raw", "created_at", "retrieved_at")
    rows = resolve_evidence_dates(latest.join(dates, "evidence_id"))
    kind = evidence_kind(clock)
    label = F.try_element_at(F.create_map(*[F.lit(x) for p in KIND_LABELS.items() for x in p]), kind)
    source = source_label()
    when = F.when(F.col("resolved.stated"), F.col("resolved.label"))
    expiry = F.concat(F.lit("expires "), F.date_format("expiry_date", "d MMMM yyyy"))
    certificate = kind.isin("current_certificate", "expiring_soon")
    parts = F.when(
        certificate, F.concat_ws(" · ", N.display_level(F.col("reported_level")), label, F.coalesce("agency_name", source), F.coalesce(expiry, when))
    ).otherwise(F.concat_ws(" · ", N.display_level(F.col("reported_level")), label, source, when))
    return rows.select("entity_id", "evidence_id", kind.alias("kind"), source.alias("source"), parts.alias("summary"))


def source_label() -> Column:
    """Organisation a document comes from, in words."""
    agency, issuer = F.nullif(F.trim("agency_name"), F.lit("")), F.nullif(F.trim("document_issuer"), F.lit(""))
    is_url = issuer.rlike("(?i)^https?:")
    is_host = issuer.rlike("(?i)^[a-z0-9.-]+$")
    host = F.regexp_replace("source_domain", r"^www\.", "")
    return F.coalesce(
        agency,
        F.when(~is_url & ~is_host, issuer),
        F.when(F.col("evidence_type").isin(COMPANY_DISCLOSURE_TYPES), "Official company disclosure"),
        F.when(~is_url, issuer),
        F.when(~host.contains("/") & host.contains("."), host),
        issuer,
        F.lit("Source not named"),
    )


