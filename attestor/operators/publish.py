"""From claims to publication: checks, routing, publishing, repair.

Each job is a pure table-to-table function.  A write is a snapshot of the
affected table; nothing is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import dates as D
from attestor.functions import names as N
from attestor.functions import quality as Q
from attestor.operators.claims import working_claims
from attestor.operators.common import any_where, computed, join_known, shared_folder, staged, stored, top_per_group
from attestor.operators.lifecycle import expiry_status, is_disclosure
from attestor.schemas import COMPANY_DISCLOSURE_TYPES, PROCUREMENT, RECOGNISED_TYPES, STATE_FIELDS, STATUS_TYPES, Clock

ISO_DAY = r"^\d{4}-\d{2}-\d{2}$"


@dataclass(frozen=True)
class AutomationRule:
    """Which gates an automatic publication must pass (all off by default)."""

    site_enabled: bool = False
    enabled: bool = False
    official_domain: bool = True
    recognised_type: bool = True
    minimum_confidence: float = 0.98
    exact_match: bool = True
    valid_dates: bool = True
    no_conflict: bool = True
    known_verifier: bool = False
    registration_consistent: bool = True
    no_lock_conflict: bool = True


def apply_claim_metadata(evidence: DataFrame, claims: DataFrame, repair: bool = False) -> DataFrame:
    """Evidence dates, raw dates, issuer and type taken from well-formed claims.

    ``claims`` has (evidence_id, field_key, value, raw_value).  Disclosures keep
    their type; the repair form drops an expiry equal to the issue date.
    """
    def field(name: str, column: str = "value") -> Column:
        return F.max(F.when(F.col("field_key") == name, F.col(column)))

    wide = claims.groupBy(F.col("evidence_id").alias("id")).agg(
        field("issue_date").alias("c_issue"),
        field("expiry_date").alias("c_expiry"),
        field("issue_date", "raw_value").alias("c_issue_raw"),
        field("expiry_date", "raw_value").alias("c_expiry_raw"),
        F.coalesce(field("document_type"), field("certificate_type")).alias("c_type"),
        field("verification_agency").alias("c_issuer"),
    )
    if repair:
        wide = wide.withColumn("c_expiry", F.when(~F.coalesce(F.col("c_issue") == F.col("c_expiry"), F.lit(False)), F.col("c_expiry")))

    def day(name: str) -> Column:
        return F.when(F.col(name).rlike(ISO_DAY), F.col(name).try_cast("date"))

    keep = F.col("evidence_type").isin(COMPANY_DISCLOSURE_TYPES + [PROCUREMENT])
    new_type = F.when(~keep & F.col("c_type").isin(STATUS_TYPES), F.col("c_type"))
    return evidence.join(wide, "id", "left").select(
        "id",
        F.coalesce(new_type, "evidence_type").alias("evidence_type"),
        F.coalesce(day("c_issue"), "issue_date").alias("issue_date"),
        F.coalesce(day("c_expiry"), "expiry_date").alias("expiry_date"),
        F.coalesce("c_issue_raw", "issue_date_raw").alias("issue_date_raw"),
        F.col("c_expiry_raw").alias("expiry_date_raw"),
        F.coalesce("c_issuer", "document_issuer").alias("document_issuer"),
    )


def linked_entity(tables) -> DataFrame:
    """Best linked unmerged entity of each document: confirmed, extracted, candidate."""
    state = F.col("link_state")
    order = F.when(state == "confirmed", 0).when(state == "extracted", 1).otherwise(2)
    links = tables["evidence_entity_links"].filter(state.isin("confirmed", "extracted", "candidate"))
    unmerged = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"))
    best = links.join(unmerged, "entity_id", "left_semi").groupBy("evidence_id").agg(
        F.min(F.struct(order.alias("o"), "entity_id", "confidence", "link_state")).alias("l")
    )
    return best.select("evidence_id", "l.entity_id", F.col("l.confidence").alias("match_confidence"), F.col("l.link_state").alias("match_state"))


def checked_evidence(tables, min_confidence: float = 0.98) -> DataFrame:
    """One row per document with everything the validation rules read."""
    claims = working_claims(tables)
    key = F.col("field_key")

    def normal(name: str) -> Column:
        return F.max(F.when(key == name, F.col("normalized_value")))

    def raw(name: str) -> Column:
        return F.max(F.when(key == name, F.col("raw_value")))

    wide = claims.groupBy(F.col("evidence_id").alias("id")).agg(
        normal("issue_date").alias("c_issue"),
        normal("expiry_date").alias("c_expiry"),
        F.coalesce(normal("registration_number"), raw("registration_number")).alias("c_reg"),
        F.coalesce(normal("legal_entity_name"), normal("measured_entity"), raw("legal_entity_name"), raw("measured_entity")).alias("c_name"),
        normal("bee_level").alias("c_level"),
        F.coalesce(normal("bee_level"), raw("bee_level")).alias("c_level_any"),
        raw("verification_agency").alias("c_agency"),
        F.min("confidence").alias("min_claim_confidence"),
        F.count_if(F.col("confidence") < min_confidence).alias("low_confidence_claims"),
    )
    agencies = tables["verification_agencies"].select(N.normalize_name(F.col("name")).alias("agency_key")).distinct().withColumn("known_agency", F.lit(True))
    entity = tables["entities"].select(
        F.col("id").alias("entity_id"), "registration_number_normalized", "normalized_name", F.col("website").alias("entity_website"), "automation_state"
    )
    state = tables["entity_current_state"].select(
        "entity_id", F.col("bee_level").alias("s_level"), F.col("evidence_id").alias("s_evidence"), F.col("issue_date").alias("s_issue")
    )
    locks = tables["field_overrides"].filter("locked").groupBy("entity_id").agg(any_where(F.col("field_key") == "bee_level").alias("level_locked"))
    evidence = tables["evidence_raw"]
    # A copy is a document whose content was stored before, under a smaller id; joined by id, so a much copied text is no hot key.
    first = evidence.filter(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first_copy"))
    live = F.col("source_live_status") if "source_live_status" in evidence.columns else F.lit(None).cast("string")
    return (
        evidence.select("id", "evidence_type", "issue_date", "expiry_date", "mime_type", "source_domain", "content_hash", live.alias("source_live_status"))
        .join(first, "id", "left")
        .withColumn("duplicate_hash", F.col("content_hash").isNotNull() & F.col("first_copy").isNull())
        .drop("content_hash", "first_copy")
        .join(wide, "id", "left")
        .withColumn("agency_key", N.normalize_name(F.col("c_agency")))
        .join(agencies, "agency_key", "left")
        .join(linked_entity(tables).withColumnRenamed("evidence_id", "id"), "id", "left")
        .join(entity, "entity_id", "left")
        .join(state, "entity_id", "left")
        .join(locks, "entity_id", "left")
    )


def validate_claims(checked: DataFrame) -> DataFrame:
    """Add ``flags``: an array of (code, severity) per document."""
    issue = F.coalesce("c_issue", F.date_format("issue_date", "yyyy-MM-dd"))
    expiry = F.coalesce("c_expiry", F.date_format("expiry_date", "yyyy-MM-dd"))
    staged = computed(checked, _issue=issue, _expiry=expiry)
    staged = computed(staged, _iw=D.date_warning(F.col("_issue")), _ew=D.date_warning(F.col("_expiry")))

    def flag(condition: Column, code: str, severity: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))

    reg = N.normalize_registration(F.col("c_reg"))
    level = F.col("c_level")
    mime = F.col("mime_type")
    flags = F.array_compact(
        F.array(
            flag(F.col("_iw").isNotNull(), "impossible_date", "error"),
            flag(F.col("_ew").isNotNull(), "impossible_date", "error"),
            flag(F.col("_expiry") < F.col("_issue"), "expiry_before_issue", "error"),
            flag(F.col("duplicate_hash"), "duplicate_hash", "warning"),
            flag((reg != "") & (reg != F.col("registration_number_normalized")), "registration_mismatch", "error"),
            flag(N.normalize_name(F.col("c_name")) != F.col("normalized_name"), "company_mismatch", "warning"),
            flag((level != F.col("s_level")) & F.col("s_evidence").isNotNull(), "conflicting_level", "warning"),
            flag(F.col("low_confidence_claims") > 0, "low_confidence", "warning"),
            flag(F.col("c_agency").isNotNull() & F.col("known_agency").isNull(), "unknown_verifier", "warning"),
            flag(F.col("source_live_status") == "missing", "source_missing", "warning"),
            flag(F.col("_issue") < F.col("s_issue"), "older_than_current", "warning"),
            flag((mime != "") & ~mime.rlike(r"^(application/pdf|text/|image/|application/json|application/xml)"), "unexpected_mime", "warning"),
            flag(F.col("evidence_type").isin(RECOGNISED_TYPES) & level.isNull(), "missing_level", "warning"),
            flag(F.col("level_locked") & (F.col("c_level_any") != F.col("s_level")), "manual_lock_conflict", "error"),
        )
    )
    return computed(staged, flags=flags).drop("_issue", "_expiry", "_iw", "_ew")


def _has(code: str) -> Column:
    return F.exists("flags", lambda f: f["code"] == code)


def _any_error() -> Column:
    return F.exists("flags", lambda f: f["severity"] == "error")


def evaluate_automation(validated: DataFrame, rule: AutomationRule = AutomationRule()) -> DataFrame:
    """Add ``reasons`` against automatic publication; none means it passes."""
    def gate(on: bool, fails: Column, text: str) -> Column:
        return F.when(F.lit(on) & F.coalesce(fails, F.lit(True)), F.lit(text))

    site = F.col("entity_website")
    auto = F.coalesce("automation_state", F.lit("review_only"))
    percent = round(rule.minimum_confidence * 100)
    confidence = F.col("min_claim_confidence")
    reasons = F.array_compact(
        F.array(
            gate(not rule.site_enabled, F.lit(True), "Site-wide auto-publication is disabled."),
            gate(not rule.enabled, F.lit(True), "The automation rule is disabled."),
            F.when(auto != "automation_allowed", F.concat(F.lit("Entity automation state is "), auto, F.lit("."))),
            gate(rule.official_domain, ~N.is_official_domain(F.col("source_domain"), site), "Source is not the official company domain."),
            gate(rule.recognised_type, ~F.col("evidence_type").isin(RECOGNISED_TYPES), "Document type is not a recognised primary certificate/report."),
            gate(rule.exact_match, ~((F.col("match_confidence") >= 0.9) & ~F.col("uncertain")), "Entity match is not exact."),
            gate(rule.known_verifier, F.col("known_agency").isNull(), "Verifier is not a known agency."),
            gate(rule.minimum_confidence > 0, confidence.isNull() | (confidence < rule.minimum_confidence), f"Extraction confidence is below {percent}%."),
            gate(rule.valid_dates, _has("impossible_date") | _has("expiry_before_issue"), "Dates failed validation."),
            gate(rule.no_conflict, _has("conflicting_level"), "Conflicts with currently published evidence."),
            gate(rule.registration_consistent, _has("registration_mismatch"), "Registration number is inconsistent."),
            gate(rule.no_lock_conflict, _has("manual_lock_conflict"), "A locked field would be overwritten."),
            gate(True, _any_error(), "Validation produced errors."),
        )
    )
    return computed(validated, reasons=reasons)


def route_reviews(evaluated: DataFrame) -> DataFrame:
    """Decide each document: automatic publication or the review it opens.

    Reads ``flags``, ``reasons``, ``entity_id``, ``uncertain``, ``conflict``,
    ``included`` (the linked number is printed in the text, which clears match
    doubt) and ``extraction_failed``.
    """
    passes = F.size("reasons") == 0
    doubt = ~F.col("included")
    conflict = F.coalesce(F.col("conflict") == "registration_number_conflict", F.lit(False))
    decision = (
        F.when(F.col("extraction_failed"), "extraction_failed")
        .when(doubt & (conflict | _has("registration_mismatch")), "registration_number_conflict")
        .when(F.col("entity_id").isNull() | (doubt & F.col("uncertain")), "uncertain_entity_match")
        .when(_has("manual_lock_conflict"), "manual_lock_conflict")
        .when(_has("conflicting_level") & ~passes, "conflicting_evidence")
        .when(passes, "auto_published")
        .when(_has("low_confidence"), "low_confidence_extraction")
        .when(_any_error(), "invalid_dates")
        .otherwise("new_evidence")
    )
    d = F.col("decision")
    severity = (
        F.when(d == "registration_number_conflict", "critical")
        .when(d == "uncertain_entity_match", F.when(F.col("conflict").isNotNull(), "high").otherwise("normal"))
        .when(d.isin("extraction_failed", "manual_lock_conflict", "conflicting_evidence") | _any_error(), "high")
        .otherwise("normal")
    )
    return evaluated.withColumn("decision", decision).select(
        F.col("id").alias("evidence_id"), "entity_id", "decision", F.when(d != "auto_published", severity).alias("severity")
    )


def open_review_once(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """New review rows: not a second pending one for the same type and document."""
    pending = existing.filter((F.col("status") == "pending") & F.col("evidence_id").isNotNull()).select("type", "evidence_id")
    named = wanted.filter(F.col("evidence_id").isNotNull()).dropDuplicates(["type", "evidence_id"]).join(pending, ["type", "evidence_id"], "left_anti")
    # Reviews without a document are never merged with one another.
    return named.unionByName(wanted.filter(F.col("evidence_id").isNull()))


def lock_overrides(incoming: DataFrame, locks: DataFrame) -> DataFrame:
    """(entity_id, field_key, value) rows under locks: the kept value and conflicts."""
    held = locks.filter("locked").select("entity_id", "field_key", F.col("value").alias("lock_value"), F.lit(True).alias("is_locked"))
    j = incoming.join(held, ["entity_id", "field_key"], "left")
    conflict = F.coalesce(F.col("lock_value") != F.col("value"), F.lit(False))
    return j.select(
        "entity_id", "field_key", F.coalesce("lock_value", "value").alias("value"), F.coalesce("is_locked", F.lit(False)).alias("locked"), conflict.alias("conflict")
    )


def claims_of(tables, documents: DataFrame) -> DataFrame:
    """Working claims of some documents (evidence_id), told apart before runs and claims are put together."""
    some = documents.select("evidence_id").distinct()
    return working_claims({name: tables[name].join(some, "evidence_id", "left_semi") for name in ("extraction_runs", "extracted_claims")})


def approved_claims(tables, approved: DataFrame, working: DataFrame | None = None) -> DataFrame:
    """Claims that approved certificates publish: plausible, own number, not locked away.

    ``approved`` has (evidence_id, entity_id); ``working`` are the claims of
    these documents, if they have been read already.
    """
    kinds = tables["evidence_raw"].select(F.col("id").alias("evidence_id"), "evidence_type")
    claims = claims_of(tables, approved) if working is None else working
    claims = claims.filter(Q.plausible_claim(F.col("canonical_key"), F.col("value"))).select("evidence_id", F.col("canonical_key").alias("field_key"), "value", "claim_id")
    own = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"), "registration_number_normalized")
    rows = approved.join(kinds, "evidence_id").filter(~is_disclosure()).join(claims, "evidence_id").join(own, "entity_id")
    foreign = (F.col("field_key") == "registration_number") & (N.normalize_registration(F.col("value")) != F.col("registration_number_normalized"))
    rows = rows.filter(~F.coalesce(foreign, F.lit(False)))
    state = tables["entity_current_state"].select("entity_id", F.expr(f"stack({len(STATE_FIELDS)}, {', '.join(repr(f) + ', ' + f for f in STATE_FIELDS)}) as (field_key, state_value)"))
    locks = tables["field_overrides"].filter("locked").select("entity_id", "field_key", F.col("value").alias("lock_value"), F.lit(True).alias("is_locked"))
    j = rows.join(locks, ["entity_id", "field_key"], "left").join(state, ["entity_id", "field_key"], "left")
    held = F.coalesce("lock_value", "state_value")
    blocked = F.coalesce(F.col("is_locked") & (held != "") & (held != F.col("value")), F.lit(False))
    return j.select("entity_id", "evidence_id", "field_key", "value", "claim_id", blocked.alias("blocked"))


def upsert_published_claims(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (entity, field): an incoming unblocked claim replaces the stored one.

    Within one batch the claim of the highest evidence id wins.
    """
    old = existing.select("entity_id", "field_key", F.lit(0).alias("pass"), "evidence_id", "value")
    new = incoming.filter(~F.col("blocked")).select("entity_id", "field_key", F.lit(1).alias("pass"), "evidence_id", "value")
    newest = F.max(F.struct("pass", "evidence_id", "value"))
    return old.unionByName(new).groupBy("entity_id", "field_key").agg(newest.alias("c")).select(
        "entity_id", "field_key", F.col("c.value").alias("value"), F.col("c.evidence_id").alias("evidence_id"), (F.col("c.pass") == 1).alias("changed")
    )


def checked_approvals(tables, approved: DataFrame) -> DataFrame:
    """Approvals with ``error``: why one is refused, null if it can be published.

    ``approved`` has (evidence_id, entity_id) and may have review_item_id.
    """
    if "review_item_id" not in approved.columns:
        approved = approved.withColumn("review_item_id", F.lit(None).cast("string"))
    items = tables["review_items"].select(
        F.col("id").alias("review_item_id"), F.col("status").alias("review_status"), F.col("evidence_id").alias("review_evidence"), F.lit(True).alias("has_item")
    )
    entities = tables["entities"].select(F.col("id").alias("entity_id"), F.col("merged_into_id").isNotNull().alias("merged"))
    stored = tables["evidence_raw"].select(F.col("id").alias("evidence_id"), F.lit(True).alias("has_evidence"))
    rows = join_known(approved, items, ["review_item_id"], "evidence_id").join(entities, "entity_id", "left").join(stored, "evidence_id", "left")
    named = F.col("review_item_id").isNotNull()
    error = (
        F.when(named & F.col("has_item").isNull(), "Review item no longer exists.")
        .when(named & ~F.coalesce(F.col("review_status").isin("pending", "in_review"), F.lit(False)), "Review item is no longer open.")
        .when(named & (F.col("review_evidence") != F.col("evidence_id")), "Review item is attached to different evidence.")
        .when(F.col("merged").isNull(), "Entity not found.")
        .when(F.col("merged"), "This entity was merged. Publish against the surviving record.")
        .when(F.col("has_evidence").isNull(), "Evidence not found.")
    )
    return rows.withColumn("error", error).drop("review_status", "review_evidence", "has_item", "merged", "has_evidence")


def publication_days(tables, approved: DataFrame, working: DataFrame | None = None) -> DataFrame:
    """Approved documents with the days they are published with.

    A certificate's own claims come before its stored days; a disclosure keeps
    its stored issue day and has no expiry.  A claim that is no day is passed over.
    """
    claims = claims_of(tables, approved) if working is None else working
    day = F.regexp_extract(F.trim("value"), r"^\d{4}-\d{2}-\d{2}", 0).try_cast("date")

    def claimed(name: str) -> Column:
        return F.max(F.when(F.col("canonical_key") == name, day))

    days = claims.filter(F.col("canonical_key").isin("issue_date", "expiry_date")).groupBy("evidence_id").agg(claimed("issue_date").alias("c_issue"), claimed("expiry_date").alias("c_expiry"))
    stored = tables["evidence_raw"].select(F.col("id").alias("evidence_id"), "evidence_type", F.col("issue_date").alias("s_issue"), F.col("expiry_date").alias("s_expiry"))
    rows = approved.join(stored, "evidence_id").join(days, "evidence_id", "left")
    issue = F.when(is_disclosure(), F.coalesce("s_issue", "c_issue")).otherwise(F.coalesce("c_issue", "s_issue"))
    expiry = F.when(~is_disclosure(), F.coalesce("c_expiry", "s_expiry"))
    return rows.withColumns({"issue_date": issue, "expiry_date": expiry}).drop("c_issue", "c_expiry", "s_issue", "s_expiry")


def supersede_previous(tables, approved: DataFrame, clock: Clock, days: DataFrame | None = None) -> DataFrame:
    """Stored current documents that an approved primary document replaces; ``days`` are its publication days, if known."""
    days = publication_days(tables, approved.select("evidence_id", "entity_id")) if days is None else days
    new = days.filter(F.col("evidence_type").isin(STATUS_TYPES))
    # The newest approved document of an entity decides.
    newest = new.groupBy("entity_id").agg(F.max(F.struct("issue_date", "evidence_id")).alias("n"), any_where(F.col("issue_date").isNull()).alias("undated"))
    state = tables["entity_current_state"].filter(F.col("evidence_id").isNotNull()).select("entity_id", F.col("evidence_id").alias("previous_id"))
    before = tables["evidence_raw"].select(F.col("id").alias("previous_id"), F.col("issue_date").alias("previous_issue"), F.col("expiry_date").alias("previous_expiry"))
    j = newest.join(state, "entity_id").join(before, "previous_id").filter(F.col("previous_id") != F.col("n.evidence_id"))
    replaces = F.col("previous_issue").isNull() | F.col("undated") | (F.col("n.issue_date") >= F.col("previous_issue"))
    return j.filter(replaces).select(
        "entity_id",
        F.col("previous_id").alias("evidence_id"),
        F.col("n.evidence_id").alias("replaced_by"),
        F.when(F.col("previous_expiry") < F.lit(clock.as_of), "expired").otherwise("superseded").alias("lifecycle_state"),
    )


def claim_states(tables, published: DataFrame, superseded: DataFrame) -> DataFrame:
    """Claims that a batch publishes or, with their document, supersedes.

    A document that is approved and replaced in one batch ends as superseded.
    """
    new = published.select("claim_id", "evidence_id").withColumn("now", F.lit(True))
    old = tables["extracted_claims"].filter("published_state = 'published'").select(F.col("id").alias("claim_id"), "evidence_id").withColumn("now", F.lit(False))
    gone = superseded.select("evidence_id").distinct().withColumn("gone", F.lit(True))
    rows = new.unionByName(old).join(gone, "evidence_id", "left").filter(F.col("now") | F.col("gone"))
    rows = rows.groupBy("claim_id", "evidence_id").agg(any_where(F.col("now")).alias("now"), any_where(F.col("gone")).alias("gone"))
    return rows.select("claim_id", "evidence_id", F.when(F.col("gone"), "superseded").otherwise("published").alias("published_state"), F.when(F.col("now"), "approved").alias("review_state"))


def publication_decisions(tables, approved: DataFrame, clock: Clock) -> dict[str, DataFrame]:
    """What a batch of approvals comes to; every table that it changes follows from these.

    checked: approvals and why one is refused; rows: accepted documents with
    their days and reported level; claims: those of accepted certificates;
    superseded: documents they replace.  Approvals are checked, and the claims
    of accepted documents read, once for all of them.
    """
    checked = stored(checked_approvals(tables, approved), "publication-checked")
    pairs = checked.filter("error is null").select("evidence_id", "entity_id").distinct()
    working = stored(claims_of(tables, pairs).select("evidence_id", "claim_id", "canonical_key", "value"), "publication-claims")
    days = stored(publication_days(tables, pairs, working), "publication-days")
    reported = working.filter((F.col("canonical_key") == "bee_level") & Q.plausible_claim(F.col("canonical_key"), F.col("value")))
    reported = reported.groupBy("evidence_id").agg(F.max("value").alias("reported"))
    return {
        "checked": checked,
        "rows": days.join(reported, "evidence_id", "left"),
        "claims": approved_claims(tables, pairs, working),
        "superseded": supersede_previous(tables, pairs, clock, days),
    }


def publish_batch(
    tables, approved: DataFrame, clock: Clock, *, rule_version: int | None = None, actor: str = "reviewer", reason: str | None = None, stage: str | None = None
) -> dict[str, DataFrame]:
    """All tables a batch of approvals changes, and the approvals it refuses.

    The decisions are written once to ``stage``, a folder that names the batch
    (a new shared folder if not given), and every table is a projection of
    them; run again with the same folder, nothing is decided anew.  Disclosures
    never feed certificate fields and carry no expiry.  With a ``rule_version``
    the publication counts as automatic.
    """
    spark = approved.sparkSession
    decided = staged(spark, stage or shared_folder(spark, "publication"), lambda: publication_decisions(tables, approved, clock))
    checked, rows, claims, superseded = (decided[n] for n in ("checked", "rows", "claims", "superseded"))
    accepted = checked.filter(F.col("error").isNull()).drop("error")
    pairs = rows.select("evidence_id", "entity_id")
    taken = claims.filter(~F.col("blocked"))
    auto = rule_version is not None

    lifecycle = F.when(is_disclosure(), "historical").otherwise(expiry_status(F.col("expiry_date"), F.lit("current"), F.lit(clock.as_of), clock.soon_days))
    evidence = rows.select(
        F.col("evidence_id").alias("id"), F.lit("published").alias("publication_state"), F.lit("approved").alias("review_state"), lifecycle.alias("lifecycle_state"), "issue_date", "expiry_date"
    )

    # What each document shows: a disclosure the level it reports, a certificate the level it publishes.
    field = F.concat_ws("=", "field_key", "value")
    shown = claims.groupBy("evidence_id", "entity_id").agg(
        F.max(F.when((F.col("field_key") == "bee_level") & ~F.col("blocked"), F.col("value"))).alias("own_level"),
        F.array_sort(F.collect_set(F.when(~F.col("blocked"), field))).alias("fields"),
        F.array_sort(F.collect_set(F.when(F.col("blocked"), F.col("field_key")))).alias("skipped_locked"),
    )
    previous = superseded.select("entity_id", F.col("replaced_by").alias("evidence_id"), F.col("evidence_id").alias("previous_evidence_id"))
    key = ["evidence_id", "entity_id"]
    told = rows.join(shown, key, "left").join(previous, key, "left")
    none = F.array().cast("array<string>")
    told = told.withColumns({"fields": F.coalesce("fields", none), "skipped_locked": F.coalesce("skipped_locked", none)})
    number, level = F.col("evidence_id").cast("string"), F.when(is_disclosure(), F.col("reported")).otherwise(F.col("own_level"))
    summary = F.when(
        is_disclosure(),
        F.concat(
            F.lit("Published official procurement disclosure "),
            number,
            F.when(level.isNotNull(), F.concat(F.lit(" (reported B-BBEE level "), level, F.lit(")"))).otherwise(""),
            F.lit(". This is not a current verification certificate."),
        ),
    ).when(level.isNotNull(), F.concat(F.lit("Published B-BBEE level "), level, F.lit(" from evidence "), number)).otherwise(F.concat(F.lit("Published evidence "), number))
    kept = F.when(F.size("skipped_locked") > 0, F.concat(F.lit(" (locked fields preserved: "), F.array_join("skipped_locked", ", "), F.lit(")"))).otherwise("")

    live = tables["entities"].select(F.col("id").alias("entity_id"), "visibility")
    return {
        "evidence": evidence,
        "superseded": superseded,
        "published_claims": upsert_published_claims(tables["published_claims"], claims),
        "claim_states": claim_states(tables, taken, superseded),
        "links": pairs.select("evidence_id", "entity_id", F.lit("confirmed").alias("link_state")),
        "entities": live.filter(F.col("visibility") == "draft").join(pairs.select("entity_id"), "entity_id", "left_semi").select("entity_id", F.lit("public").alias("visibility")),
        "events": told.select(
            "entity_id", "evidence_id", F.lit("auto_published" if auto else "published").alias("event_type"), F.concat(summary, kept).alias("summary"), "previous_evidence_id", F.lit(actor).alias("published_by")
        ),
        "reviews": accepted.filter(F.col("review_item_id").isNotNull())
        .select("review_item_id")
        .distinct()
        .select(F.col("review_item_id").alias("id"), F.lit("approved").alias("status"), F.lit(actor).alias("reviewer_id"), F.lit(reason or "Approved and published.").alias("resolution")),
        "audit": told.select(
            F.lit(actor).alias("actor_id"),
            F.lit("evidence.auto_published" if auto else "evidence.published").alias("action"),
            F.lit("evidence").alias("target_type"),
            number.alias("target_id"),
            "entity_id",
            "fields",
            "skipped_locked",
            F.lit(rule_version).cast("long").alias("rule_version"),
            F.lit(reason).cast("string").alias("reason"),
        ),
        "refused": checked.filter(F.col("error").isNotNull()).select("evidence_id", "entity_id", "error"),
    }


def merge_repair_claims(previous: DataFrame, extracted: DataFrame, context: DataFrame) -> DataFrame:
    """Decide per (evidence, field) between the stored and the re-extracted claim.

    ``previous``: evidence_id, field_key, value, edited (bool).
    ``extracted``: evidence_id, field_key, new_value.
    ``context``: evidence_id, published, entity_reg, locked_fields, linked_name.
    The result names the source kept (previous, extracted or none), its value,
    and whether the two conflict.
    """
    issue = (
        extracted.filter(F.col("field_key") == "issue_date").select("evidence_id", F.col("new_value").alias("i_new"))
        .join(previous.filter(F.col("field_key") == "issue_date").select("evidence_id", F.col("value").alias("i_old")), "evidence_id", "full_outer")
        .select("evidence_id", F.coalesce("i_new", "i_old").alias("issue_value"))
    )
    j = previous.join(extracted, ["evidence_id", "field_key"], "full_outer").join(context, "evidence_id", "left").join(issue, "evidence_id", "left")
    f = F.col("field_key")
    aliases = F.array().cast("array<string>")
    canonical = Q.canonical_field(f)
    is_name = canonical.isin("measured_entity", "legal_entity_name", "trading_name")

    def shown(col: Column) -> Column:
        fits = ~is_name | F.col("linked_name").isNull() | Q.matches_linked(col, F.col("linked_name"), aliases)
        return F.when(Q.plausible_claim(canonical, col) & fits, col)

    j = computed(j, old=shown(F.col("value")), new=shown(F.col("new_value")))
    old, new, reg = F.col("old"), F.col("new"), F.col("entity_reg")
    had = F.col("value").isNotNull()
    locked = F.coalesce(F.array_contains("locked_fields", f), F.lit(False)) & had
    differ = F.coalesce(old != new, F.lit(False))
    same_day = (f == "expiry_date") & differ & (old == F.col("issue_value")) & (new != F.col("issue_value"))
    is_reg = (f == "registration_number") & reg.isNotNull()
    draft_date = ~F.col("published") & f.isin("issue_date", "expiry_date") & new.isNotNull()
    step = (
        F.when(locked, "locked")
        .when(F.coalesce("edited", F.lit(False)), "edited")
        .when(F.coalesce(same_day, F.lit(False)), "same_day")
        .when(F.coalesce(is_reg & (new == reg), F.lit(False)), "own_number")
        .when(F.coalesce(is_reg & (old == reg), F.lit(False)), "kept_number")
        .when(F.coalesce(is_reg & (new != reg), F.lit(False)), "foreign_number")
        .when(F.coalesce(draft_date, F.lit(False)), "draft_date")
        .when(differ, "conflict")
        .when(F.col("new_value").isNotNull() & old.isNull(), "filled")
        .when(old.isNotNull(), "kept")
        .otherwise("dropped")
    )
    s = F.col("step")
    raw_differ = F.coalesce(F.col("value") != F.col("new_value"), F.lit(False))
    from_new = s.isin("same_day", "own_number", "foreign_number", "draft_date", "filled")
    return j.withColumn("step", step).select(
        "evidence_id",
        "field_key",
        "step",
        F.when(from_new, F.col("new_value")).when(s != "dropped", F.col("value")).alias("value"),
        (s.isin("conflict", "foreign_number") | ((s == "locked") & raw_differ) | ((s == "kept_number") & differ)).alias("conflict"),
    )


def unusable_names(previous: DataFrame, context: DataFrame) -> DataFrame:
    """Documents with a stored name that may not be shown."""
    c = Q.canonical_field(F.col("field_key"))
    named = previous.join(context.select("evidence_id", "linked_name"), "evidence_id", "left")
    bad = ~Q.plausible_claim(c, F.col("value")) | (F.col("linked_name").isNotNull() & ~Q.matches_linked(F.col("value"), F.col("linked_name"), F.array().cast("array<string>")))
    return named.filter(c.isin("measured_entity", "legal_entity_name", "trading_name") & bad).select("evidence_id").distinct()


def sanitize_claims(previous: DataFrame, extracted: DataFrame, context: DataFrame) -> DataFrame:
    """Fields whose stored value may not be shown and was not replaced.

    Extraction is used only for documents with an unusable name.
    """
    merged = merge_repair_claims(previous, extracted.join(unusable_names(previous, context), "evidence_id", "left_semi"), context)
    dropped = merged.filter(F.col("step") == "dropped").select("evidence_id", "field_key")
    return dropped.join(context.select("evidence_id", "published"), "evidence_id", "left").select("evidence_id", "field_key", F.col("published").alias("opens_review"))


def sanitized_runs(tables, previous: DataFrame, extracted: DataFrame, context: DataFrame, parser: str = "sanitize/v1") -> dict[str, DataFrame]:
    """Runs, claims and reviews of a pass that suppresses values which may not be shown.

    Every document of ``context`` without a successful run of ``parser`` gets
    one, with a claim for each field that is left and a warning for each one
    suppressed; a published document with a suppressed field gets one review.
    """
    done = tables["extraction_runs"].filter((F.col("parser") == parser) & F.col("success")).select("evidence_id").distinct()
    todo = context.join(done, "evidence_id", "left_anti")
    mine = todo.select("evidence_id")
    previous, extracted = (df.join(mine, "evidence_id", "left_semi") for df in (previous, extracted))
    suppressed = sanitize_claims(previous, extracted, todo)
    merged = merge_repair_claims(previous, extracted.join(unusable_names(previous, todo), "evidence_id", "left_semi"), todo)
    run = F.concat_ws("-", F.lit(parser), F.col("evidence_id").cast("string"))
    listed = suppressed.groupBy("evidence_id").agg(F.array_sort(F.collect_set("field_key")).alias("fields"))  # at most one of each claim field
    none = F.array().cast("array<string>")
    runs = todo.join(listed, "evidence_id", "left").select(
        run.alias("id"), "evidence_id", F.lit(parser).alias("parser"), F.lit(True).alias("success"), F.transform(F.coalesce("fields", none), lambda f: F.concat(F.lit("Suppressed invalid "), f, F.lit("."))).alias("warnings")
    )
    claims = merged.filter("value is not null").select(F.concat_ws("-", run, "field_key").alias("id"), run.alias("extraction_run_id"), "evidence_id", "field_key", F.col("value").alias("raw_value"))
    told = listed.join(todo.filter("published").select("evidence_id"), "evidence_id", "left_semi")
    reason = F.concat(F.lit("Malformed extracted "), F.array_join("fields", ", "), F.lit(" was suppressed and not shown as a published fact."))
    reviews = open_review_once(tables["review_items"], told.select(F.lit("invalid_extracted_claim").alias("type"), reason.alias("reason"), F.lit("normal").alias("severity"), "evidence_id"))
    return {"extraction_runs": runs, "extracted_claims": claims, "review_items": reviews}


def pending_repairs(tables, parser: str) -> DataFrame:
    """Documents without a successful run of a parser."""
    done = tables["extraction_runs"].filter((F.col("parser") == parser) & F.col("success")).select(F.col("evidence_id").alias("id"))
    return tables["evidence_raw"].select("id", "created_at").join(done, "id", "left_anti")


def reset_runs(tables, parser: str, only_equal_dates: bool = False) -> dict[str, DataFrame]:
    """Runs and claims left after dropping those of one parser."""
    drop = tables["extraction_runs"].filter(F.col("parser") == parser).select(F.col("id").alias("extraction_run_id"), "evidence_id")
    if only_equal_dates:
        equal = tables["evidence_raw"].filter(F.col("issue_date") == F.col("expiry_date")).select(F.col("id").alias("evidence_id"))
        drop = drop.join(equal, "evidence_id", "left_semi")
    drop = drop.select("extraction_run_id")
    return {
        "extraction_runs": tables["extraction_runs"].join(drop.withColumnRenamed("extraction_run_id", "id"), "id", "left_anti"),
        "extracted_claims": tables["extracted_claims"].join(drop, "extraction_run_id", "left_anti"),
    }


def cleanup_agencies(tables) -> dict[str, DataFrame]:
    """Agencies whose name is noise are removed and references to them cleared."""
    bad = tables["verification_agencies"].filter(Q.canonical_agency(F.col("name")).isNull()).select(F.col("id").alias("verifier_agency_id"), F.lit(True).alias("_bad"))
    evidence = tables["evidence_raw"].join(bad, "verifier_agency_id", "left")
    return {
        "removed": bad.select(F.col("verifier_agency_id").alias("id")),
        "evidence": evidence.withColumn("verifier_agency_id", F.when(F.col("_bad").isNull(), F.col("verifier_agency_id"))).drop("_bad"),
    }


def newest_reviews(reviews: DataFrame) -> DataFrame:
    """Newest open review of each document."""
    open_rows = reviews.filter(F.col("status").isin("pending", "in_review"))
    return top_per_group(open_rows, ["evidence_id"], [F.desc("generated_at"), F.desc("id")], 1).drop("_rank")
