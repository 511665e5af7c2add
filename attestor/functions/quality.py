"""Plausibility of claims, names, signatories and agencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.schemas import CLAIM_FIELDS

# --- fixed values: spellings of claim fields --------------------------------
FIELD_SPELLINGS = {
    "bee_level": ["bbbee_level", "b_bbee_level", "bbb_ee_level", "b-bbee-level", "b-bbee_level", "beelevel", "status_level"],
    "recognition_level": ["recognition", "recognition_percentage", "procurement_recognition"],
    "scorecard_type": ["scorecard", "scorecard_applied", "sector_code", "sector"],
    "verification_agency": ["verifier", "verification_agency_name", "rating_agency", "agency"],
    "signatory": ["technical_signatory", "signed_by"],
    "certificate_number": ["cert_number", "certificate_no", "certificate_ref", "reference_number", "unique_ref_no"],
    "registration_number": ["company_registration", "registration", "enterprise_number"],
    "legal_entity_name": ["entity_name", "company_name"],
    "measured_entity": ["name_of_measured_entity", "enterprise_name"],
    "issue_date": ["date_of_issue", "date_issued"],
    "expiry_date": ["valid_until", "date_of_expiry", "certificate_expiry_date"],
}
# --- fixed values: patterns -------------------------------------------------
PROSE = (
    r"(?i)measured against|codes of good practice|broad[-\s]*based black|this certificate|independent and impartial"
    r"|verification of the bbb?ee status|has been issued|has been determined|gazette|scorecard|procurement recognition"
    r"|empowering supplier|management of the measured entity|and is an|contributor status|discounting principle"
    r"|verification certificate policy|for enquiries|amended codes|generic codes gazetted|participated in y\.?e\.?s"
    r"|black designated groups|black military veterans"
)
NAME_STARTS = (
    r"(?i)^(measured|issued|verified|this|a consolidated|broad|codes|the result|independent|according|in terms"
    r"|valid for|expiry|issue date|level)"
)
HEADINGS = r"(?i)^(the )?(measured entity|legal entity|company name|enterprise name|verification agency)$"
FRAGMENTS = r"(?i)^(and is an|by the management|of the measured)$"
COMPANY_HINT = r"(?i)\b(pty|ltd|limited|inc|incorporated|cc|holdings|group|company|n\.v\.|plc)\b"
SIGNATORY_STARTS = r"(?i)^(per|as|date|expiry|signatory|technical|yes|no)\b"
SIGNATORY_LABELS = (
    r"(?i)\b(certificate number|registration number|unique reference|scorecard|b-?bbee|issue date|expiry date"
    r"|technical signatory)\b"
)

AGENCY_REJECT = (
    r"^(sanas|yes|no|n a|na|n/a|date|level|bee|b bbee|verification agency|rating agency|broad based black economic"
    r"|broad based black economic empowerment|name of technical signatory|technical signatory|measured entity"
    r"|by management of measured entity and is an)$"
)
KNOWN_AGENCIES = [
    ("EmpowerLogic (Pty) Ltd", r"(?i)empower\s*logic"),
    ("AQRate (Pty) Ltd", r"(?i)\baqrate\b"),
    ("Honeycomb BEE Ratings", r"(?i)\bhoneycomb\b"),
    ("Empowerdex (Pty) Ltd", r"(?i)empowerdex"),
    ("BDO Verification Services (Pty) Ltd", r"(?i)bdo\s+verification\s+services"),
    ("mPower Ratings", r"(?i)\bm\s*power\s+ratings\b"),
    ("Siyandisa Solutions", r"(?i)siyandisa"),
    ("MSCT BEE Services (Pty) Ltd", r"(?i)\bmsct\s+bee\b"),
    ("1st Verification Networx (Pty) Ltd", r"(?i)1st\s+verification\s+networx|first\s+verification\s+networx"),
    ("Renaissance SA Ratings", r"(?i)renaissance\s+sa\s+ratings"),
    ("VOS Quantum Solutions CC", r"(?i)vos\s+quantum|vqs\s+quantum"),
    ("Mosela Rating Agency (Pty) Ltd", r"(?i)mosela\s+rating"),
    ("Beescore (Pty) Ltd", r"(?i)\bbeescore\b"),
    ("IRBA", r"\birba\b"),
]


def canonical_field(col: Column) -> Column:
    """Canonical claim key of a field spelling; unknown keys pass through."""
    key = F.regexp_replace(F.lower(F.trim(col)), r"\s+", "_")
    pairs = [(s, c) for c, spellings in FIELD_SPELLINGS.items() for s in spellings]
    known = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.when(key.isin(CLAIM_FIELDS), key).otherwise(F.coalesce(F.try_element_at(known, key), key))


def looks_like_company(col: Column) -> Column:
    words = F.split(N.collapse(col), r"\s+")
    capital = F.forall(words, lambda w: w.rlike("^[A-Z0-9]") | w.rlike("(?i)^(and|of|the|for|&)$"))
    return col.rlike(COMPANY_HINT) | (F.size(words).between(2, 8) & capital)


def name_reject_reason(col: Column) -> Column:
    """Why a text is not a company name; null when it is plausible."""
    name = F.coalesce(N.collapse(col), F.lit(""))
    return (
        F.when(name == "", "empty")
        .when(F.length(name) < 3, "too short")
        .when(F.length(name) > 100, "too long")
        .when(F.size(F.split(name, r"\s+")) > 12, "prose")
        .when(name.rlike(PROSE), "certificate prose")
        .when(name.rlike(NAME_STARTS), "sentence fragment")
        .when(name.rlike(HEADINGS), "heading")
        .when(name.rlike("[,:;]$"), "truncated")
        .when(~name.rlike("[A-Za-z]"), "not a name")
        .when(name.rlike(FRAGMENTS), "fragment")
    )


def matches_linked(name: Column, linked: Column, aliases: Column) -> Column:
    """False when a name that does not look like a company shares no word with its entity."""
    def tokens(c: Column) -> Column:
        return F.filter(F.split(c, " "), lambda t: F.length(t) > 2)

    n, c = N.normalize_name(N.collapse(name)), N.normalize_name(linked)
    alias_hit = F.coalesce(F.exists(aliases, lambda a: N.normalize_name(a) == n), F.lit(False))
    disjoint = (F.size(tokens(n)) > 0) & (F.size(tokens(c)) > 0) & ~F.arrays_overlap(tokens(n), tokens(c))
    checked = linked.isNotNull() & (n != "") & (c != "") & ~alias_hit & ~looks_like_company(N.collapse(name))
    return ~F.coalesce(checked & disjoint, F.lit(False))


def plausible_signatory(col: Column) -> Column:
    name = N.collapse(col)
    return (
        F.length(name).between(4, 60)
        & ~name.rlike(PROSE)
        & ~name.rlike(SIGNATORY_STARTS)
        & ~name.rlike(SIGNATORY_LABELS)
        & F.size(F.split(name, r"\s+")).between(2, 5)
        & name.rlike(r"^[A-Za-z][A-Za-z .'\-]+$")
    )


def plausible_certificate_number(col: Column) -> Column:
    v = N.collapse(col)
    return F.length(v).between(4, 40) & v.rlike(r"\d") & ~v.rlike("(?i)^(version|final|draft|certificate|number|unique)$")


def plausible_agency(col: Column) -> Column:
    v = N.collapse(col)
    return (
        ~v.rlike(PROSE)
        & ~v.rlike(r"(?i)^per\s")
        & ~(v.rlike("(?i)certificate|incorporates following") & ~v.rlike("(?i)pty|ltd|agency|ratings|verification"))
        & F.length(v).between(3, 120)
    )


def plausible_claim(field: Column, value: Column) -> Column:
    """May this value be shown for this (canonical) field?"""
    v = F.coalesce(N.collapse(value), F.lit(""))
    return (
        F.when(v == "", F.lit(False))
        .when(field.isin("legal_entity_name", "measured_entity", "trading_name"), name_reject_reason(v).isNull())
        .when(field == "signatory", plausible_signatory(v))
        .when(field == "certificate_number", plausible_certificate_number(v))
        .when(field == "verification_agency", plausible_agency(v))
        .otherwise(F.lit(True))
    )


def canonical_agency(col: Column) -> Column:
    """Known agency name, the trimmed name, or null for noise."""
    t = N.collapse(col)
    n = N.normalize_name(t)
    noise = (
        ~F.length(t).between(3, 120)
        | n.rlike(AGENCY_REJECT)
        | n.rlike("^per [a-z]")
        | t.rlike("(?i)measured entity|technical signatory|management of|gazette|scorecard|procurement recognition")
        | (
            n.rlike("incorporates following|b bbee certificate|verification certificate")
            & ~n.rlike("pty|ltd|ratings|agency|verification services")
        )
    )
    known = F.coalesce(*[F.when(t.rlike(p), F.lit(name)) for name, p in KNOWN_AGENCIES])
    return F.when(~noise, F.coalesce(known, t))
