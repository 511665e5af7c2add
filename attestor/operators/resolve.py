"""Entity resolution, links, agencies and identity data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.functions import quality as Q
from attestor.operators.common import computed, is_status, join_known, live_entity, published
from attestor.schemas import NON_INDUSTRY_SECTORS

# --- fixed values ------------------------------------------------------------
NON_COMPANY_HOST = r"(?i)(\.gov\.za$|\.gov$|treasury\.gov|sanas\.co\.za|irba\.co\.za|empowerlogic|aqrate|empowerdex|bee\.co\.za|cipc\.co\.za)"
AGENCY_NUMBER = r"(?i)\bBVA\s?\d{2,4}\b"
DOMAIN_TYPES = [
    "bee_certificate",
    "sworn_affidavit",
    "company_disclosure",
    "annual_report",
    "integrated_report",
    "transformation_report",
    "investor_document",
    "company_webpage",
]


def unmerged(tables) -> DataFrame:
    return tables["entities"].filter(F.col("merged_into_id").isNull())


def _name_index(tables) -> DataFrame:
    return unmerged(tables).groupBy(F.col("normalized_name").alias("name_key")).agg(F.min("id").alias("by_name"))


def _alias_index(tables) -> DataFrame:
    live = unmerged(tables).select(F.col("id").alias("entity_id"))
    return (
        tables["entity_aliases"].join(live, "entity_id", "left_semi").groupBy(F.col("normalized_alias").alias("name_key")).agg(F.min("entity_id").alias("by_alias"))
    )


def _registration_index(tables) -> DataFrame:
    return (
        unmerged(tables)
        .filter(F.col("registration_number_normalized").isNotNull())
        .groupBy(F.col("registration_number_normalized").alias("reg_key"))
        .agg(F.min("id").alias("by_reg"), F.count("*").alias("reg_holders"))
    )


def find_existing_entity(tables, wanted: DataFrame) -> DataFrame:
    """(ordinal, name, registration) rows matched by registration, name, then alias.

    Where several entities share the key the smallest id is taken.
    """
    keyed = wanted.select("*", N.normalize_name(F.col("name")).alias("name_key"), F.nullif(N.normalize_registration(F.col("registration")), F.lit("")).alias("reg_key"))
    found = (
        join_known(keyed, _registration_index(tables).drop("reg_holders"), ["reg_key"], "ordinal")
        .transform(join_known, _name_index(tables), ["name_key"], "ordinal")
        .transform(join_known, _alias_index(tables), ["name_key"], "ordinal")
    )
    via = (
        F.when(F.col("by_reg").isNotNull(), "registration_number")
        .when(F.col("by_name").isNotNull(), "canonical_name")
        .when(F.col("by_alias").isNotNull(), "alias")
    )
    return found.select(*wanted.columns, F.coalesce("by_reg", "by_name", "by_alias").alias("entity_id"), via.alias("via"))


def resolve_entity(tables, mentions: DataFrame) -> DataFrame:
    """Match (mention_id, name, registration, suggested_id) rows to entities.

    Name and alias candidates are reduced to counts and extremes before the
    join, so no candidate list is built however many entities share a name.
    """
    name = F.nullif(F.trim("name"), F.lit(""))
    m = mentions.select(
        "mention_id",
        name.alias("name"),
        F.nullif(N.normalize_registration(F.col("registration")), F.lit("")).alias("reg"),
        "suggested_id",
        F.nullif(N.normalize_name(name), F.lit("")).alias("name_key"),
    )
    entities = tables["entities"]
    suggested = entities.select(
        F.col("id").alias("suggested_id"),
        F.coalesce("merged_into_id", "id").alias("s_id"),
        F.col("registration_number_normalized").alias("s_reg"),
    )
    by_reg = _registration_index(tables).withColumnRenamed("reg_key", "reg")
    owner = unmerged(tables).select(F.col("id").alias("by_reg"), F.col("normalized_name").alias("owner_name"))
    alias_pairs = tables["entity_aliases"].select(F.col("entity_id").alias("by_reg"), F.col("normalized_alias").alias("name_key")).distinct().withColumn("alias_ok", F.lit(True))

    live = unmerged(tables).select(F.col("id").alias("entity_id"), F.col("normalized_name").alias("name_key"), F.col("registration_number_normalized").alias("c_reg"))
    named = live.withColumn("is_name", F.lit(True))
    aliased = (
        tables["entity_aliases"]
        .select("entity_id", F.col("normalized_alias").alias("name_key"))
        .join(live.drop("name_key"), "entity_id")
        .withColumn("is_name", F.lit(False))
        .select("entity_id", "name_key", "c_reg", "is_name")
    )
    both = named.select("entity_id", "name_key", "c_reg", "is_name").unionByName(aliased)
    candidates = (
        both.groupBy("name_key", "entity_id")
        .agg(F.max("is_name").alias("is_name"), F.max("c_reg").alias("c_reg"))
        .groupBy("name_key")
        .agg(
            F.count("*").alias("n_candidates"),
            F.min("entity_id").alias("c_id"),
            F.max("is_name").alias("any_name"),
            F.min("c_reg").alias("c_reg_low"),
            F.max("c_reg").alias("c_reg_high"),
        )
    )
    j = (
        join_known(m, suggested, ["suggested_id"], "mention_id")
        .transform(join_known, by_reg, ["reg"], "mention_id")
        .transform(join_known, owner, ["by_reg"], "mention_id")
        .transform(join_known, alias_pairs, ["by_reg", "name_key"], "mention_id")
        .transform(join_known, candidates, ["name_key"], "mention_id")
    )
    reg = F.col("reg")
    is_suggested = F.col("s_id").isNotNull()
    s_conflict = reg.isNotNull() & F.col("s_reg").isNotNull() & (reg != F.col("s_reg"))
    one_holder = F.col("reg_holders") == 1
    differs = F.col("name_key").isNotNull() & (F.col("name_key") != F.col("owner_name")) & F.col("alias_ok").isNull()
    single = F.col("n_candidates") == 1
    c_conflict = reg.isNotNull() & ((F.col("c_reg_low") != reg) | (F.col("c_reg_high") != reg))
    several = F.col("n_candidates") > 1
    case = (
        F.when(is_suggested & F.coalesce(s_conflict, F.lit(False)), "suggested_conflict")
        .when(is_suggested, "suggested")
        .when(one_holder & F.coalesce(differs, F.lit(False)), "reg_name_differs")
        .when(one_holder, "reg")
        .when(single & F.coalesce(c_conflict, F.lit(False)), "name_conflict")
        .when(single & F.col("any_name"), "name")
        .when(single, "alias")
        .when(several & F.coalesce(c_conflict, F.lit(False)), "several_conflict")
        .when(several, "several")
        .when(F.col("name").isNotNull() | reg.isNotNull(), "none")
        .otherwise("nothing")
    )
    c = F.col("case")

    def choose(**values) -> Column:
        return F.coalesce(*[F.when(c == k, v if isinstance(v, Column) else F.lit(v)) for k, v in values.items()])

    return j.withColumn("case", case).select(
        "mention_id",
        choose(
            suggested_conflict=F.col("s_id"), suggested=F.col("s_id"), reg_name_differs=F.col("by_reg"), reg=F.col("by_reg"), name_conflict=F.col("c_id"), name=F.col("c_id"), alias=F.col("c_id")
        ).alias("entity_id"),
        choose(
            suggested_conflict="admin",
            suggested="admin",
            reg_name_differs="registration_number",
            reg="registration_number",
            name_conflict="name",
            name="canonical_name",
            alias="alias",
            several_conflict="ambiguous_name",
            several="ambiguous_name",
        ).alias("method"),
        choose(
            suggested_conflict=0.4, suggested=1.0, reg_name_differs=0.7, reg=0.99, name_conflict=0.4, name=0.92, alias=0.92, several_conflict=0.3, several=0.3, none=0.0, nothing=0.0
        ).alias("confidence"),
        c.isin("suggested_conflict", "reg_name_differs", "name_conflict", "several_conflict", "several", "none").alias("uncertain"),
        choose(
            suggested_conflict="registration_number_conflict",
            reg_name_differs="name_differs",
            name_conflict="registration_number_conflict",
            several_conflict="registration_number_conflict",
            several="ambiguous_name",
        ).alias("conflict"),
    )


def link_evidence(links: DataFrame, matches: DataFrame) -> DataFrame:
    """Links after a match pass: a matched pair is a candidate again, others stay.

    ``matches`` has (evidence_id, entity_id, match_method, confidence).
    """
    old = links.select("evidence_id", "entity_id", "link_state", "match_method", "confidence", F.lit(0).alias("pass"))
    new = matches.filter(F.col("entity_id").isNotNull()).select(
        "evidence_id", "entity_id", F.lit("candidate").alias("link_state"), "match_method", "confidence", F.lit(1).alias("pass")
    )
    latest = F.max(F.struct("pass", "link_state", "match_method", "confidence"))
    return old.unionByName(new).groupBy("evidence_id", "entity_id").agg(latest.alias("l")).select(
        "evidence_id", "entity_id", "l.link_state", "l.match_method", "l.confidence"
    )


def link_included(tables, named: DataFrame) -> DataFrame:
    """New ``included`` links of (entity_id, url) rows to published group documents.

    A URL may be the source, discovered or canonical URL; a published
    document wins, then the newest.
    """
    evidence = tables["evidence_raw"]
    urls = ["source_url"] + [c for c in ("discovered_url", "canonical_url") if c in evidence.columns]
    rank = F.struct((F.col("publication_state") == "published").alias("pub"), "created_at", "id")
    places = evidence.select(F.explode(F.array_distinct(F.array(*urls))).alias("url"), rank.alias("r"))
    best = places.groupBy("url").agg(F.max("r").alias("r")).filter(F.col("r.pub")).select("url", F.col("r.id").alias("evidence_id"))
    existing = tables["evidence_entity_links"].select("evidence_id", "entity_id")
    return (
        named.join(best, "url").select("evidence_id", "entity_id").distinct().join(existing, ["evidence_id", "entity_id"], "left_anti").withColumn("link_state", F.lit("included"))
    )


def agency_lookup(tables) -> DataFrame:
    """Distinct (agency, normalised name) pairs of names and aliases."""
    names = tables["verification_agencies"].select(F.col("id").alias("agency_id"), N.normalize_name(F.col("name")).alias("name_key"))
    aliases = tables["agency_aliases"].select("agency_id", N.normalize_name(F.col("alias")).alias("name_key"))
    return names.unionByName(aliases).filter(F.col("name_key") != "").distinct()


def ensure_agencies(tables, stated: DataFrame) -> DataFrame:
    """Agencies named in claims: known id, or a new agency with a derived id.

    ``stated`` has (evidence_id, name); noise names give no agency.
    """
    canonical = Q.canonical_agency(F.col("name"))
    keyed = stated.select("evidence_id", "name", canonical.alias("canonical")).filter(F.col("canonical").isNotNull())
    known = agency_lookup(tables).groupBy("name_key").agg(F.min("agency_id").alias("known_id"))
    raw_known = known.select(F.col("name_key").alias("raw_key"), F.col("known_id").alias("raw_id"))
    out = (
        keyed.select("*", N.normalize_name(F.col("canonical")).alias("name_key"), N.normalize_name(F.col("name")).alias("raw_key"))
        .join(known, "name_key", "left")
        .join(raw_known, "raw_key", "left")
    )
    agency = F.coalesce("known_id", "raw_id")
    return out.groupBy("name_key").agg(
        F.max(agency).alias("agency_id"),
        F.min("canonical").alias("canonical_name"),
        F.count("*").alias("evidence_count"),
        F.max(F.col("raw_key") != F.col("name_key")).alias("new_alias"),
    ).select(
        "name_key",
        "agency_id",
        F.when(F.col("agency_id").isNull(), F.concat(F.lit("agy_"), F.substring(F.sha2("name_key", 256), 1, 16))).alias("new_agency_id"),
        "canonical_name",
        "evidence_count",
        "new_alias",
    )


def agency_changes(tables, stated: DataFrame) -> dict[str, DataFrame]:
    """Rows that a batch of stated agency names adds: agencies, aliases and accreditation numbers.

    ``stated`` has (evidence_id, name) and may have ``number``, the agency's
    accreditation number, which is otherwise read from the name.  An alias is a
    stated spelling that differs from the agency's name; of several documents
    with one new number the smallest id is its evidence.
    """
    if "number" not in stated.columns:
        stated = stated.withColumn("number", F.lit(None).cast("string"))
    canonical = Q.canonical_agency(F.col("name"))
    rows = computed(stated.select("evidence_id", F.trim("name").alias("name"), "number"), canonical=canonical).filter("canonical is not null")
    rows = computed(rows, name_key=N.normalize_name(F.col("canonical")), raw_key=N.normalize_name(F.col("name")))
    known = agency_lookup(tables).groupBy("name_key").agg(F.min("agency_id").cast("string").alias("known_id"))
    keyed = rows.join(known, "name_key", "left").join(known.select(F.col("name_key").alias("raw_key"), F.col("known_id").alias("raw_id")), "raw_key", "left")
    new_id = F.concat(F.lit("agy_"), F.substring(F.sha2("name_key", 256), 1, 16))
    keyed = keyed.select("*", F.coalesce("known_id", "raw_id").alias("have"), F.coalesce("known_id", "raw_id", new_id).alias("agency_id"))
    made = keyed.filter("have is null").groupBy("agency_id").agg(F.min("canonical").alias("name"), F.min("name_key").alias("normalized_name"))
    had = agency_lookup(tables).select(F.col("agency_id").cast("string").alias("agency_id"), F.col("name_key").alias("normalized_alias"))
    alias = keyed.filter("raw_key <> name_key and raw_key <> ''").groupBy("agency_id", F.col("raw_key").alias("normalized_alias")).agg(F.min("name").alias("alias"))
    number = F.upper(F.regexp_replace(F.coalesce(F.nullif(F.trim("number"), F.lit("")), F.regexp_extract("name", AGENCY_NUMBER, 0)), r"\s+", ""))
    marked = keyed.select("agency_id", number.alias("accreditation_identifier"), "evidence_id").filter(F.col("accreditation_identifier").rlike(r"^BVA\d{2,4}$"))
    marks = tables["agency_accreditations"].select(F.col("agency_id").cast("string").alias("agency_id"), "accreditation_identifier")
    return {
        "agencies": made.select(F.col("agency_id").alias("id"), "name", "normalized_name", N.slugify(F.col("name")).alias("slug"), F.lit("public").alias("visibility")),
        "aliases": alias.join(had, ["agency_id", "normalized_alias"], "left_anti").select("agency_id", "alias", "normalized_alias"),
        "accreditations": marked.groupBy("agency_id", "accreditation_identifier")
        .agg(F.min("evidence_id").alias("evidence_id"))
        .join(marks, ["agency_id", "accreditation_identifier"], "left_anti")
        .select("agency_id", F.lit("SANAS").alias("accreditation_body"), "accreditation_identifier", F.lit("Identifier stated on certificate").alias("status"), "evidence_id"),
    }


def registration_candidates(tables) -> DataFrame:
    """Valid company numbers for entities without one, from three sources."""
    wanted = tables["entities"].filter(live_entity() & N.blank(F.col("registration_number"))).select(F.col("id").alias("entity_id"))
    state = tables["entity_current_state"].filter(F.col("registration_number").isNotNull()).select("entity_id", F.col("registration_number").alias("value"), F.lit("current_state").alias("via"))
    claimed = tables["published_claims"].filter(F.col("field_key") == "registration_number").select("entity_id", "value", F.lit("published_claim").alias("via"))
    documents = tables["evidence_raw"].filter(published() & is_status()).select(F.col("id").alias("evidence_id"))
    stated = (
        tables["extracted_claims"]
        .filter(F.col("field_key") == "registration_number")
        .select("evidence_id", F.coalesce("normalized_value", "raw_value").alias("value"))
        .join(documents, "evidence_id", "left_semi")
        .join(tables["evidence_entity_links"].select("evidence_id", "entity_id"), "evidence_id")
        .select("entity_id", "value", F.lit("certificate_claim").alias("via"))
    )
    rows = state.unionByName(claimed).unionByName(stated).join(wanted, "entity_id", "left_semi")
    return rows.select("entity_id", N.format_registration(F.col("value")).alias("registration"), "via").filter(
        F.col("registration").isNotNull() & ~N.is_verifier_registration(F.col("registration"))
    )


def copy_registrations(tables, candidates: DataFrame) -> DataFrame:
    """Copy a number where exactly one is stated and no other entity holds it.

    Distinct values are compared by their extremes, not collected.
    """
    per_entity = candidates.groupBy("entity_id").agg(
        F.min("registration").alias("low"), F.max("registration").alias("high"), F.max(F.when(F.col("via") == "current_state", F.col("via"))).alias("state_via"), F.min("via").alias("any_via")
    )
    holders = unmerged(tables).filter(F.col("registration_number_normalized").isNotNull()).groupBy(F.col("registration_number_normalized").alias("reg_key")).agg(
        F.min("id").alias("holder")
    )
    single = F.col("low") == F.col("high")
    joined = per_entity.withColumn("reg_key", N.normalize_registration(F.col("low"))).join(holders, "reg_key", "left")
    outcome = F.when(~single, "conflicting_values").when(F.col("holder").isNotNull(), "belongs_to_another").otherwise("copied")
    return joined.select(
        "entity_id", outcome.alias("outcome"), F.when(outcome == "copied", F.col("low")).alias("registration"), F.coalesce("state_via", "any_via").alias("via")
    )


def clear_verifier_registrations(tables) -> DataFrame:
    """Entities that carry a verifier's number, except the verifiers themselves."""
    return (
        unmerged(tables)
        .filter(F.col("registration_number_normalized").isin(N.CLEARED_REGISTRATIONS) & ~F.col("canonical_name").rlike(N.VERIFIER_NAMES))
        .select("id", "canonical_name", F.col("registration_number").alias("before"), F.lit(None).cast("string").alias("after"))
    )


def discover_domains(tables) -> DataFrame:
    """Website of entities without one: host of their newest fitting document."""
    wanted = tables["entities"].filter(live_entity() & F.col("website").isNull()).select(F.col("id").alias("entity_id"))
    host = F.regexp_replace(F.coalesce(F.nullif("source_domain", F.lit("")), N.url_host(F.col("source_url"))), r"^www\.", "")
    documents = (
        tables["evidence_raw"]
        .filter(published() & F.col("evidence_type").isin(DOMAIN_TYPES))
        .select(F.col("id").alias("evidence_id"), "issue_date", host.alias("host"), F.regexp_extract("source_url", r"(?i)^(https?://[^/?#]+)", 1).alias("origin"))
        .filter((F.col("host") != "") & ~F.col("host").rlike(NON_COMPANY_HOST))
    )
    links = tables["evidence_entity_links"].select("evidence_id", "entity_id")
    newest = documents.join(links, "evidence_id").join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(
        F.max(F.struct("issue_date", "evidence_id", "host", "origin")).alias("d")
    )
    return newest.select("entity_id", F.when(F.col("d.origin") != "", F.col("d.origin")).otherwise(F.concat(F.lit("https://"), F.col("d.host"))).alias("website"))


def fill_missing_identity(tables, items: DataFrame) -> DataFrame:
    """Fill null identity fields of found entities; nothing is overwritten.

    ``items`` has (entity_id, registration, website, legal_name, trading_name).
    """
    formatted = F.when(~N.is_verifier_registration(F.col("registration")), N.format_registration(F.col("registration")))
    offered = items.select("entity_id", formatted.alias("new_reg"), F.col("website").alias("new_site"), F.trim("legal_name").alias("new_legal"), F.trim("trading_name").alias("new_trading"))
    holders = _holders(tables)
    own = tables["entities"].select(F.col("id").alias("entity_id"), "registration_number", "website", "legal_name", "trading_name")
    j = own.join(offered, "entity_id").withColumn("reg_key", N.normalize_registration(F.col("new_reg"))).join(holders, "reg_key", "left")
    clash = F.col("holder").isNotNull() & ((F.col("holder") != F.col("entity_id")) | (F.col("holders") > 1))
    site = F.when(F.col("new_site").rlike("(?i)^https?://[^/]"), F.col("new_site"))
    return j.select(
        "entity_id",
        F.coalesce("registration_number", F.when(~F.coalesce(clash, F.lit(False)), F.col("new_reg"))).alias("registration_number"),
        F.coalesce("website", site).alias("website"),
        F.coalesce("legal_name", F.nullif("new_legal", F.lit(""))).alias("legal_name"),
        F.coalesce("trading_name", F.nullif("new_trading", F.lit(""))).alias("trading_name"),
    )


def _holders(tables) -> DataFrame:
    return unmerged(tables).filter(F.col("registration_number_normalized").isNotNull()).groupBy(F.col("registration_number_normalized").alias("reg_key")).agg(
        F.min("id").alias("holder"), F.count("*").alias("holders")
    )


def apply_identity_patches(tables, patches: DataFrame) -> DataFrame:
    """Result of a batch of patches: entity found, new number, or why it was kept.

    ``patches`` has (ordinal, name, registration, replace_if, website).
    """
    found = find_existing_entity(tables, patches)
    own = tables["entities"].select(F.col("id").alias("entity_id"), F.col("registration_number").alias("old_reg"), F.col("website").alias("old_site"))
    formatted = N.format_registration(F.col("registration"))
    j = found.join(own, "entity_id", "left").withColumn("reg_key", N.normalize_registration(formatted)).join(_holders(tables), "reg_key", "left")
    offered = ~N.blank(F.col("registration"))
    old, new = N.normalize_registration(F.col("old_reg")), F.col("reg_key")
    replaceable = F.col("old_reg").isNull() | N.is_verifier_registration(F.col("old_reg")) | F.coalesce(old == N.normalize_registration(F.col("replace_if")), F.lit(False))
    clash = F.coalesce(F.col("holder").isNotNull() & ((F.col("holder") != F.col("entity_id")) | (F.col("holders") > 1)), F.lit(False))
    missing = F.col("entity_id").isNull()
    reason = (
        F.when(missing, "not_found")
        .when(~offered, None)
        .when(formatted.isNull(), "invalid_registration_format")
        .when(N.is_verifier_registration(formatted), "verifier_agency_registration")
        .when(replaceable & clash, "registration_belongs_to_another_entity")
        .when(~replaceable & (old != new), "existing_registration_preserved")
    )
    fill_site = F.col("old_site").isNull() & F.col("website").rlike("(?i)^https?://[^/]")
    return j.select(
        "ordinal",
        "entity_id",
        "via",
        reason.alias("reason"),
        F.when(~missing & reason.isNull() & offered & replaceable, formatted).alias("new_registration"),
        F.when(~missing & fill_site, F.col("website")).alias("new_website"),
    )


def apply_sector_list(tables, items: DataFrame) -> DataFrame:
    """(ordinal, name, sectors) to new classifications; unknown names have no entity."""
    found = find_existing_entity(tables, items.withColumn("registration", F.lit(None).cast("string")))
    rows = found.select("entity_id", "via", F.explode_outer("sectors").alias("sector_id"))
    known = tables["sectors"].select(F.col("id").alias("sector_id"))
    existing = tables["entity_classifications"].filter(F.col("classification_type") == "sector").select("entity_id", "sector_id")
    return (
        rows.filter(F.col("entity_id").isNotNull() & ~F.col("sector_id").isin(NON_INDUSTRY_SECTORS))
        .select("entity_id", "sector_id")
        .distinct()
        .join(known, "sector_id", "left_semi")
        .join(existing, ["entity_id", "sector_id"], "left_anti")
    )
