"""Fixed vocabularies, parameters and struct types of the data model."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T

# --- fixed values: evidence vocabulary -------------------------------------
CERTIFICATE = "bee_certificate"
AFFIDAVIT = "sworn_affidavit"
PROCUREMENT = "government_procurement_disclosure"

STATUS_TYPES = [CERTIFICATE, AFFIDAVIT]
DISCLOSURE_TYPES = [PROCUREMENT]
RECOGNISED_TYPES = [CERTIFICATE, AFFIDAVIT, "annual_report", "integrated_report", "transformation_report"]
COMPANY_DISCLOSURE_TYPES = [
    "company_disclosure",
    "company_webpage",
    "annual_report",
    "integrated_report",
    "esg_report",
    "sustainability_report",
    "transformation_report",
    "investor_document",
]
# The directory rank leaves web pages out of the company-disclosure step.
RANKED_DISCLOSURE_TYPES = [t for t in COMPANY_DISCLOSURE_TYPES if t != "company_webpage"]
EVIDENCE_TYPES = [
    CERTIFICATE,
    AFFIDAVIT,
    "annual_report",
    "integrated_report",
    "esg_report",
    "sustainability_report",
    "transformation_report",
    "procurement_page",
    "supplier_page",
    "investor_document",
    "company_disclosure",
    "company_webpage",
    "verification_agency_document",
    "accreditation_record",
    "regulatory_record",
    "government_record",
    PROCUREMENT,
    "other",
]
REVIEW_TYPES = [
    "new_evidence",
    "conflicting_evidence",
    "uncertain_entity_match",
    "low_confidence_extraction",
    "community_submission",
    "potential_duplicate_entity",
    "verifier_mismatch",
    "registration_number_conflict",
    "invalid_dates",
    "source_problem",
    "manual_lock_conflict",
    "potentially_revoked",
    "relationship_claim",
    "consultant_relationship",
    "extraction_failed",
    "invalid_extracted_claim",
]
LIFECYCLE_STATES = [
    "discovered",
    "current",
    "historical",
    "superseded",
    "expired",
    "expiring_soon",
    "disputed",
    "unknown_validity",
]
VISIBILITIES = ["draft", "public", "hidden"]
LINK_STATES = ["candidate", "extracted", "confirmed", "rejected", "included"]
PUBLICATION_STATES = ["unpublished", "published"]
VISIBLE_LINKS = ["confirmed", "extracted"]
LIFECYCLE_LINKS = ["confirmed", "extracted", "candidate"]
VALID_STATES = ["current", "expiring_soon"]
PAST_STATES = ["historical", "superseded", "expired"]
NON_INDUSTRY_SECTORS = ["sec_jse", "sec_government_suppliers"]

CLAIM_FIELDS = [
    "bee_level",
    "recognition_level",
    "scorecard_type",
    "certificate_type",
    "measured_entity",
    "legal_entity_name",
    "trading_name",
    "registration_number",
    "issue_date",
    "expiry_date",
    "verification_agency",
    "signatory",
    "document_type",
    "certificate_number",
]
DISCLOSURE_FIELDS = [
    "tender_number",
    "government_institution",
    "enterprise_class",
    "tender_description",
    "contract_period",
    "contract_amount",
    "procurement_outcome",
]
STATE_FIELDS = [
    "bee_level",
    "recognition_level",
    "scorecard_type",
    "certificate_type",
    "issue_date",
    "expiry_date",
    "registration_number",
]
MAX_DOCUMENT_BYTES = 8 * 1024 * 1024


@dataclass(frozen=True)
class Clock:
    """Explicit time parameters shared by the operators."""

    as_of: date = date(2001, 1, 1)
    recent_from: date = date(1999, 1, 1)
    soon_days: int = 90
    # Newest moment of the event-like tables.
    events_as_of: str = "2024-01-30 00:00:00"


DEFAULT_CLOCK = Clock()

PROCUREMENT_ROW = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "sourceUrl",
            "governmentInstitution",
            "tenderNumber",
            "tenderDescription",
            "awardDate",
            "beeLevel",
            "enterpriseClass",
            "contractPeriod",
            "contractAmount",
            "sourceTitle",
            "outcome",
        )
    ]
)
EVIDENCE_LINK_ROW = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("url", "title", "evidenceType", "issueDate", "expiryDate")]
)
SOURCE_ROW = T.StructType([T.StructField(n, T.StringType()) for n in ("url", "sourceType", "frequency")])
CORPUS_ITEM = T.StructType(
    [
        T.StructField("canonicalName", T.StringType()),
        T.StructField("legalName", T.StringType()),
        T.StructField("tradingName", T.StringType()),
        T.StructField("registrationNumber", T.StringType()),
        T.StructField("website", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
        T.StructField("sectorIds", T.ArrayType(T.StringType())),
        T.StructField("jseListed", T.BooleanType()),
        T.StructField("parentName", T.StringType()),
        T.StructField("entityType", T.StringType()),
        T.StructField("evidence", T.ArrayType(EVIDENCE_LINK_ROW)),
        T.StructField("sources", T.ArrayType(SOURCE_ROW)),
        T.StructField("procurement", T.ArrayType(PROCUREMENT_ROW)),
        T.StructField("publishIfSafe", T.BooleanType()),
    ]
)
