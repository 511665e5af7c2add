"""Text of documents and pages: hashes, HTML, links, types, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import names as N

# --- fixed values ------------------------------------------------------------
EVIDENCE_HINTS = [
    "bee",
    "b-bbee",
    "bbbee",
    "certificate",
    "affidavit",
    "transformation",
    "annual report",
    "integrated report",
    "supplier",
    "procurement",
    "sustainability",
    "scorecard",
    "form b-bbee",
    "compliance report",
    "bee certificate",
]
LABELS = {
    "discovered": "Discovered",
    "current": "Current",
    "historical": "Historical",
    "superseded": "Superseded",
    "expired": "Expired",
    "expiring_soon": "Expiring soon",
    "disputed": "Disputed",
    "unknown_validity": "Validity unconfirmed",
    "current_certificate": "Current certificate",
    "validity_unconfirmed": "Validity unconfirmed",
    "expired_certificate": "Expired certificate",
    "historical_certificate": "Historical certificate",
    "official_dated_disclosure": "Official dated disclosure",
    "official_procurement_disclosure": "Official procurement disclosure",
    "official_company_disclosure": "Official company disclosure",
    "historical_procurement_disclosure": "Historical procurement disclosure",
    "historical_disclosure": "Historical disclosure",
    "official_undated": "Official evidence — source date not stated",
    "historical_evidence_only": "Historical evidence only",
    "recent_public_evidence": "Recent public evidence",
    "no_current_certificate": "No current certificate in corpus",
    "approved": "Approved",
    "published": "Published",
    "unpublished": "Unpublished",
    "pending": "Pending",
    "rejected": "Rejected",
    "edited": "Edited",
    "under_review": "Under review",
    "in_review": "In review",
    "live": "Live",
    "dead": "Unreachable",
    "unreachable": "Unreachable",
    "unknown": "Unknown",
    "conflicting_evidence": "Conflicting evidence",
    "retained": "Retained (not published as a public file URL)",
    "not_stored": "Not stored",
    "bee_certificate": "B-BBEE certificate",
    "sworn_affidavit": "Sworn affidavit",
    "annual_report": "Annual report",
    "integrated_report": "Integrated report",
    "esg_report": "ESG report",
    "sustainability_report": "Sustainability report",
    "transformation_report": "Transformation report",
    "procurement_page": "Procurement page",
    "supplier_page": "Supplier page",
    "investor_document": "Investor document",
    "company_disclosure": "Company disclosure",
    "company_webpage": "Company webpage",
    "verification_agency_document": "Verification-agency document",
    "accreditation_record": "Accreditation record",
    "regulatory_record": "Regulatory record",
    "government_record": "Government / public record",
    "government_procurement_disclosure": "Official procurement disclosure",
    "other": "Other public evidence",
}


def near_text_hash(text: Column) -> Column:
    """Hash of lower-cased text with white space collapsed."""
    return F.sha2(F.lower(N.collapse_text(text)), 256)


def html_to_text(html: Column) -> Column:
    """Visible text of a page; only ``&nbsp;`` and ``&#39;`` are decoded."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"(?i)&nbsp;", " ")
    t = F.replace(t, F.lit("&#39;"), F.lit("'"))
    return N.collapse(t)


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute URL of a link on a page (no ``..`` segments are folded)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(bare == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(bare, "[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )


def anchors(html: Column) -> Column:
    """Array of (href, text) of the anchors of a page."""
    pattern = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    hrefs = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all(html, F.lit(pattern), F.lit(2))
    return F.transform(
        F.arrays_zip(hrefs.alias("href"), texts.alias("body")),
        lambda a: F.struct(a["href"].alias("href"), N.collapse(F.regexp_replace(a["body"], r"<[^>]+>", " ")).alias("text")),
    )


def infer_evidence_type(url: Column, title: Column) -> Column:
    """Document type from URL and title; unclear documents stay ``other``."""
    blob = F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit(""))))
    mark = r"b-?bbee|bbbee|\bbee\b"
    return (
        F.when(blob.rlike(r"sworn\s+affidavit|\baffidavit\b") & blob.rlike(mark), "sworn_affidavit")
        .when(blob.rlike(r"form\s*b-?bbee\s*1|b-?bbee\s+compliance\s+report"), "transformation_report")
        .when(blob.rlike(r"integrated[_\s-]?report"), "integrated_report")
        .when(blob.rlike(r"annual[_\s-]?report"), "annual_report")
        .when(blob.rlike(r"sustainability[_\s-]?report"), "sustainability_report")
        .when(blob.rlike("transformation") & blob.rlike(mark), "transformation_report")
        .when(blob.rlike(r"(b-?bbee|bbbee|bee).{0,48}(certificate|cert\b)|(certificate|cert\b).{0,48}(b-?bbee|bbbee)"), "bee_certificate")
        .when(url.rlike(r"(?i)\.pdf($|\?)") & blob.rlike(r"\bb-?bbee\b|\bbbbee\b"), "bee_certificate")
        .when(blob.contains("procurement"), "procurement_page")
        .when(blob.contains("supplier"), "supplier_page")
        .when(blob.contains("investor"), "investor_document")
        .otherwise("other")
    )


def evidence_likeness(url: Column, text: Column, mime: Column) -> Column:
    """Number of hint words, plus two for a PDF."""
    blob = F.lower(F.concat_ws(" ", url, F.coalesce(text, F.lit("")), F.coalesce(mime, F.lit(""))))
    score = F.when(url.rlike(r"(?i)\.pdf($|\?)") | F.coalesce(mime == "application/pdf", F.lit(False)), 2).otherwise(0)
    for hint in EVIDENCE_HINTS:
        score = score + F.when(blob.contains(hint), 1).otherwise(0)
    return score


def state_label(code: Column) -> Column:
    """Display label of a code; an unknown code is shown in words."""
    value = F.trim(code)
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in LABELS.items() for x in p]), value)
    words = F.transform(
        F.filter(F.split(value, "[_-]+"), lambda w: w != ""),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
    )
    return (
        F.when(value.isNull() | (value == ""), "Not found in published evidence")
        .when(known.isNotNull(), known)
        .when(~value.rlike("[_-]"), value)
        .otherwise(F.array_join(words, " "))
    )


def interpretation(evidence_type: Column, lifecycle: Column, eligibility: Column) -> Column:
    """Interpretation code of one document."""
    disclosed = (
        F.when(eligibility == "unknown", "official_undated")
        .when(eligibility == "past", "historical_procurement_disclosure")
        .otherwise("official_dated_disclosure")
    )
    return (
        F.when(evidence_type == "government_procurement_disclosure", disclosed)
        .when(lifecycle == "current", "current_certificate")
        .when(lifecycle == "expiring_soon", "expiring_soon")
        .when(lifecycle == "unknown_validity", "validity_unconfirmed")
        .when(lifecycle == "expired", "expired_certificate")
        .when(lifecycle.isin("historical", "superseded"), "historical_certificate")
        .otherwise(F.coalesce(lifecycle, F.lit("no_current_certificate")))
    )


def company_interpretation(state: Column, state_type: Column, disclosed: Column, modern: Column, company: Column) -> Column:
    """Interpretation code of a company from its state and disclosures."""
    dated = F.when(~F.coalesce(modern, F.lit(True)), "historical_procurement_disclosure").otherwise("official_dated_disclosure")
    from_disclosure = F.when(~F.coalesce(modern, F.lit(True)), "historical_procurement_disclosure").when(disclosed, "official_dated_disclosure").otherwise("no_current_certificate")
    return (
        F.when(state_type == "government_procurement_disclosure", from_disclosure)
        .when(state == "current", "current_certificate")
        .when(state == "expiring_soon", "expiring_soon")
        .when(state == "unknown_validity", "validity_unconfirmed")
        .when(state == "expired", "expired_certificate")
        .when(state == "disputed", "disputed")
        .when(disclosed, dated)
        .when(company, "official_company_disclosure")
        .when(state.isin("historical", "superseded"), "historical_certificate")
        .otherwise("no_current_certificate")
    )
