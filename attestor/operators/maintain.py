"""Merging, sectors, reviews, monitoring and the corpus import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.functions import suppliers as S
from attestor.operators.common import is_status, linked_evidence, live_entity, published
from attestor.operators.publish import newest_reviews
from attestor.operators.reports import genuine_sectors

UNSAFE_REVIEWS = ["registration_number_conflict", "conflicting_evidence", "manual_lock_conflict"]


def _moved(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replace absorbed ids by their survivors; ``_own`` marks rows that stayed."""
    to = mapping.select(F.col("absorbed_id").alias(column), F.col("survivor_id").alias("_to"))
    j = df.join(to, column, "left")
    return j.withColumn("_own", F.col("_to").isNull()).withColumn(column, F.coalesce("_to", column)).drop("_to")


def _one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; the survivor's own row wins over a moved one."""
    rest = [c for c in df.columns if c not in keys and c != "_own"]
    best = F.max(F.struct("_own", *rest)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def merge_entities(tables, mapping: DataFrame) -> dict[str, DataFrame]:
    """Every table after merging (absorbed_id, survivor_id) pairs.

    Keys are kept unique: where survivor and absorbed entity both hold a row
    for one key, the survivor's stays.  Edges that would loop are dropped.
    """
    entities = tables["entities"]
    names = entities.select(F.col("id").alias("absorbed_id"), "canonical_name", "normalized_name", "registration_number")
    absorbed = mapping.join(names, "absorbed_id")
    former = absorbed.select(
        F.col("survivor_id").alias("entity_id"), F.col("normalized_name").alias("normalized_alias"), F.col("canonical_name").alias("alias"), F.lit("former").alias("alias_type"), F.lit(True).alias("_own")
    )
    aliases = _moved(tables["entity_aliases"].select("entity_id", "normalized_alias", "alias", "alias_type"), mapping, "entity_id").unionByName(former)
    edges = _moved(tables["entity_relationships"].select("source_entity_id", "target_entity_id", "relationship_type"), mapping, "source_entity_id").drop("_own")
    edges = _moved(edges, mapping, "target_entity_id").drop("_own").filter(F.col("source_entity_id") != F.col("target_entity_id")).distinct()
    classes = _moved(tables["entity_classifications"].select("entity_id", "sector_id", "classification_type", "is_public"), mapping, "entity_id")
    links = _moved(tables["evidence_entity_links"].select("evidence_id", "entity_id", "link_state", "match_method"), mapping, "entity_id")
    claims = _moved(tables["published_claims"].select("entity_id", "field_key", "value", "evidence_id"), mapping, "entity_id")
    given = absorbed.groupBy(F.col("survivor_id").alias("id")).agg(F.min("registration_number").alias("_given"))
    gone = mapping.select(F.col("absorbed_id").alias("id"), F.col("survivor_id").alias("_into"))
    changed = entities.join(gone, "id", "left").join(given, "id", "left")
    return {
        "entities": changed.select(
            "id",
            F.when(F.col("_into").isNotNull(), "hidden").otherwise(F.col("visibility")).alias("visibility"),
            F.coalesce("_into", "merged_into_id").alias("merged_into_id"),
            F.coalesce("registration_number", "_given").alias("registration_number"),
        ),
        "entity_aliases": _one_per_key(aliases, ["entity_id", "normalized_alias"]),
        "entity_relationships": edges,
        "entity_classifications": _one_per_key(classes, ["entity_id", "sector_id", "classification_type"]),
        "evidence_entity_links": _one_per_key(links, ["evidence_id", "entity_id"]),
        "published_claims": _one_per_key(claims, ["entity_id", "field_key"]),
        "monitored_sources": _moved(tables["monitored_sources"].select("id", "entity_id", "domain"), mapping, "entity_id").drop("_own"),
        "review_items": _moved(tables["review_items"].select("id", "entity_id", "type", "status"), mapping, "entity_id").drop("_own"),
        "events": absorbed.select("survivor_id", "absorbed_id", F.to_json(F.struct("canonical_name", "registration_number")).alias("snapshot")),
    }


def unmerge_entities(entities: DataFrame, reversed_merges: DataFrame) -> DataFrame:
    """Absorbed entities of reversed merges are drafts again; moved rows stay moved."""
    back = reversed_merges.select(F.col("absorbed_id").alias("id"), F.lit(True).alias("_back"))
    return entities.join(back, "id", "left").select(
        "id",
        F.when(F.col("_back"), "draft").otherwise(F.col("visibility")).alias("visibility"),
        F.when(F.col("_back").isNull(), F.col("merged_into_id")).alias("merged_into_id"),
    )


def merge_duplicates(tables) -> DataFrame:
    """Pairs of one normalised name to merge, or the reason they are not.

    The survivor is public before hidden, has a number, has more links.
    Groups are reduced by extremes, so a name held by very many entities
    costs no more than any other.
    """
    links = tables["evidence_entity_links"].groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("links"))
    rows = tables["entities"].filter(F.col("merged_into_id").isNull()).join(links, "id", "left")
    rank = F.struct(
        (F.col("visibility") == "public").alias("public"), F.col("registration_number").isNotNull().alias("reg"), F.coalesce("links", F.lit(0)).alias("links"), (-F.col("id")).alias("first"), "id"
    )
    reg = F.col("registration_number_normalized")
    groups = rows.groupBy("normalized_name").agg(
        F.count("*").alias("n"), F.min(reg).alias("low"), F.max(reg).alias("high"), F.max(rank).alias("best"), F.min(rank).alias("worst")
    ).filter(F.col("n") == 2)
    conflict = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    return groups.select(
        "normalized_name", F.col("best.id").alias("survivor_id"), F.col("worst.id").alias("absorbed_id"), F.when(conflict, "registration_conflict").otherwise("merge").alias("outcome")
    )


def assign_sectors(tables, known: DataFrame | None = None) -> DataFrame:
    """New sector rows of live entities without a genuine sector.

    ``known`` optionally gives (normalized_name, sectors) of named companies,
    which win over the rules.
    """
    has = genuine_sectors(tables).select(F.col("entity_id").alias("id"))
    missing = tables["entities"].filter(live_entity()).join(has, "id", "left_anti")
    sectors = S.infer_sectors(F.col("canonical_name"))
    if known is not None:
        missing = missing.join(known, "normalized_name", "left")
        sectors = F.coalesce("sectors", sectors)
    return missing.select(F.col("id").alias("entity_id"), F.explode(sectors).alias("sector_id")).distinct()


def move_attributes(classifications: DataFrame) -> DataFrame:
    """The two non-industry sectors become a listing and an attribute."""
    kind = (
        F.when((F.col("classification_type") == "sector") & (F.col("sector_id") == "sec_jse"), "listing")
        .when((F.col("classification_type") == "sector") & (F.col("sector_id") == "sec_government_suppliers"), "attribute")
        .otherwise(F.col("classification_type"))
    )
    return classifications.select("entity_id", "sector_id", kind.alias("classification_type"), "is_public").groupBy("entity_id", "sector_id", "classification_type").agg(
        F.max("is_public").alias("is_public")
    )


def close_reviews(tables) -> DataFrame:
    """Pending reviews to close, with status and resolution."""
    pending = tables["review_items"].filter(F.col("status") == "pending")
    done = tables["evidence_raw"].filter(published()).select(F.col("id").alias("evidence_id"), F.lit(True).alias("is_published"))
    ran = tables["extraction_runs"].filter("success").select("evidence_id").distinct().withColumn("has_run", F.lit(True))
    names = tables["entities"].select(F.col("id").alias("entity_id"), "canonical_name", "visibility")
    j = pending.join(done, "evidence_id", "left").join(ran, "evidence_id", "left").join(names, "entity_id", "left")
    kind, reason = F.col("type"), F.col("reason")
    kept = reason.ilike("Repair extracted a different%") & reason.ilike("%Stored value was kept%") & ~reason.rlike("(?i)bee_level|b-bbee level")
    joint = S.is_joint_venture(F.col("canonical_name"))
    junk = (F.col("visibility") != "public") & (joint | S.is_malformed(F.col("canonical_name")))
    resolution = (
        F.when((kind == "new_evidence") & F.col("is_published"), "Evidence already published; leftover new_evidence review closed.")
        .when((kind == "extraction_failed") & F.col("has_run"), "A later extraction run succeeded for this evidence.")
        .when((kind == "invalid_extracted_claim") & reason.ilike("%suppressed and not shown%"), "Malformed extracted claim was already suppressed and not published.")
        .when((kind == "conflicting_evidence") & kept, "Repair already kept the stored claim; the incoming extract was not applied. Leftover conflict review closed.")
        .when(junk & joint, "Joint-venture name is not a single legal entity.")
        .when(junk, "Malformed or non-entity name; not a company record.")
    )
    closed = j.select("id", "type", "entity_id", resolution.alias("resolution")).filter(F.col("resolution").isNotNull())
    rejected = F.col("resolution").rlike("^(Joint|Malformed or)")
    return closed.select("id", "type", F.when(rejected, "rejected").otherwise("approved").alias("status"), "resolution")


def retry_candidates(tables, limit: int = 8) -> DataFrame:
    """Oldest unpublished documents of unmerged entities without an unsafe review."""
    unsafe = newest_reviews(tables["review_items"]).filter(F.col("type").isin(UNSAFE_REVIEWS)).select("evidence_id")
    live = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"))
    waiting = tables["evidence_raw"].filter(F.col("publication_state") == "unpublished").select(F.col("id").alias("evidence_id"), "created_at")
    links = tables["evidence_entity_links"].select("evidence_id", "entity_id").join(live, "entity_id", "left_semi")
    return waiting.join(unsafe, "evidence_id", "left_anti").join(links, "evidence_id").orderBy("created_at", "evidence_id", "entity_id").limit(limit)


def missing_sources(tables) -> DataFrame:
    """New monitored sources: websites of live entities no source watches."""
    site = F.trim("website")
    wanted = tables["entities"].filter(live_entity() & ~N.blank(F.col("website"))).select(
        F.col("id").alias("entity_id"),
        F.when(site.rlike("(?i)^https?://"), site).otherwise(F.concat(F.lit("https://"), site)).alias("url"),
        N.website_host(F.col("website")).alias("domain"),
        F.lit("monthly").alias("frequency"),
    )
    return wanted.join(tables["monitored_sources"].select("entity_id", "domain"), ["entity_id", "domain"], "left_anti")


def verifier_gaps(tables) -> DataFrame:
    """Published certificates without an agency: one review per live entity."""
    rows = linked_evidence({"evidence_entity_links": tables["evidence_entity_links"], "evidence": tables["evidence_raw"]}, ["evidence_type", "verifier_agency_id"], visible=False)
    gaps = rows.filter(is_status() & F.col("verifier_agency_id").isNull())
    live = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"))
    return gaps.join(live, "entity_id", "left_semi").groupBy("entity_id").agg(F.min("id").alias("evidence_id")).withColumn("type", F.lit("verifier_mismatch"))


def hide_named(tables, names: DataFrame) -> DataFrame:
    """Public unmerged entities whose lower-cased name is in a list."""
    wanted = names.select(F.lower(F.trim("name")).alias("key")).filter(F.length("key") >= 2).distinct()
    rows = tables["entities"].filter(live_entity()).withColumn("key", F.lower("canonical_name"))
    return rows.join(wanted, "key", "left_semi").select("id", "canonical_name", F.lit("hidden").alias("visibility"))


def republish_eligible(tables) -> DataFrame:
    """Hidden unmerged entities with visible evidence and an acceptable name."""
    hidden = tables["entities"].filter((F.col("visibility") == "hidden") & F.col("merged_into_id").isNull())
    seen = linked_evidence({"evidence_entity_links": tables["evidence_entity_links"], "evidence": tables["evidence_raw"]}, []).select(F.col("entity_id").alias("id")).distinct().withColumn("_seen", F.lit(True))
    reason = S.reject_reason(F.col("canonical_name"), F.col("registration_number"))
    out = hidden.join(seen, "id", "left").select(
        "id", "canonical_name", F.when(F.col("_seen").isNull(), "no published evidence").otherwise(reason).alias("reason")
    )
    return out.withColumn("visibility", F.when(F.col("reason").isNull(), "public").otherwise("hidden"))


def disclosure_claims(disclosures: DataFrame) -> DataFrame:
    """Long claims of disclosure rows, one per non-empty field.

    Expects evidence_id, canonical_name, bee_level_raw, evidence_date and the
    disclosure columns.
    """
    def row(field: str, raw: Column, normal: Column | None = None) -> Column:
        value = F.nullif(F.trim(raw), F.lit(""))
        return F.when(
            value.isNotNull(), F.struct(F.lit(field).alias("field_key"), value.alias("raw_value"), F.coalesce(normal if normal is not None else value, value).alias("normalized_value"))
        )

    c = F.col
    rows = F.array(
        row("document_type", F.lit("government_procurement_disclosure")),
        row("measured_entity", c("canonical_name")),
        row("legal_entity_name", c("canonical_name")),
        row("bee_level", c("bee_level_raw"), N.normalize_level(c("bee_level_raw"))),
        row("issue_date", c("evidence_date")),
        row("tender_number", c("tender_number")),
        row("government_institution", c("institution")),
        row("enterprise_class", c("enterprise_class"), F.upper(c("enterprise_class"))),
        row("tender_description", c("tender_description")),
        row("contract_period", c("contract_period")),
        row("contract_amount", c("contract_amount")),
        row("procurement_outcome", c("outcome")),
    )
    return disclosures.select("evidence_id", F.explode_outer(F.array_compact(rows)).alias("c")).filter(F.col("c").isNotNull()).select("evidence_id", "c.*")


def disclosure_to_evidence(disclosures: DataFrame, existing: DataFrame) -> dict[str, DataFrame]:
    """New evidence, locations, links and claims of disclosures not stored yet.

    ``disclosures`` carry ``identity_hash`` and ``entity_id``; a hash that is
    already stored adds no evidence row.  ``imports.disclosed`` gives the dates
    that rows or their sources state.
    """
    from attestor.operators.imports import notes

    stored = existing.select(F.col("content_hash").alias("identity_hash")).distinct()
    first = disclosures.groupBy("identity_hash").agg(F.min_by(F.struct(*[c for c in disclosures.columns if c != "identity_hash"]), "ordinal").alias("d"))
    new = first.join(stored, "identity_hash", "left_anti").select("identity_hash", "d.*").withColumn("evidence_id", F.concat(F.lit("evd_"), F.substring("identity_hash", 1, 24)))
    level = N.normalize_level(F.col("bee_level_raw"))
    shown = F.when(level.isNotNull(), F.concat(F.lit("Level "), level, F.lit(" reported"))).otherwise("B-BBEE level as reported")
    title = F.concat(F.col("canonical_name"), F.lit(" — "), shown, F.lit(" in "), F.col("institution"), F.coalesce(F.concat(F.lit(" "), F.col("tender_number")), F.lit("")))
    return {
        "evidence": new.select("evidence_id", "identity_hash", title.alias("title"), "source_url", F.col("evidence_date").alias("issue_date"), "institution", notes(F.col("outcome")).alias("public_notes")),
        "locations": new.select("evidence_id", F.col("source_url").alias("url")),
        "links": new.select("evidence_id", "entity_id", F.lit("confirmed").alias("link_state")),
        "claims": disclosure_claims(new),
    }


def import_corpus(tables, items: DataFrame, recent_year: int = 2024) -> DataFrame:
    """Decision per corpus item: held with a reason, matched, or a new entity.

    ``items`` has (ordinal, canonical_name, registration, has_evidence,
    newest_year) where ``newest_year`` is that of its newest disclosure.
    """
    from attestor.operators.resolve import find_existing_entity

    cleaned = items.withColumn("_c", S.clean_supplier(F.col("canonical_name"))).select("*", F.col("_c.canonical_name").alias("name")).drop("_c")
    found = find_existing_entity(tables, cleaned)
    name = F.col("name")
    joint = S.is_joint_venture(name) | S.is_joint_venture(F.col("canonical_name"))
    missing = F.col("entity_id").isNull()
    malformed = S.is_malformed(name) & missing & ~S.is_short_legal_name(name, F.col("registration"))
    old = missing & ~F.col("has_evidence") & F.col("newest_year").isNotNull() & (F.col("newest_year") < recent_year)
    held = F.when(F.length(name) < 2, "no_name").when(joint, "joint_venture").when(malformed, "malformed").when(old, "old_procurement")
    outcome = F.when(held.isNotNull(), "held").when(missing, "created").otherwise("matched")
    return found.select(
        "ordinal",
        name.alias("name"),
        outcome.alias("outcome"),
        held.alias("held_reason"),
        F.when(held.isNull(), F.col("entity_id")).alias("entity_id"),
        "via",
    )


