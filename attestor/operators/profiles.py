"""Joined views of one entity, document or agency, computed for all at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.operators.claims import latest_values, working_claims
from attestor.operators.common import linked_evidence, live_entity, published, top_per_group, visible_link
from attestor.schemas import NON_INDUSTRY_SECTORS

TIMELINE_CLAIMS = ["bee_level", "tender_number", "government_institution", "enterprise_class"]
PARENT_TYPES = ["parent", "holding_company"]
CHILD_TYPES = ["subsidiary", "operating_company", "division", "trading_brand"]


def published_entity_evidence(tables) -> DataFrame:
    """Live entity with each visible published document."""
    rows = linked_evidence(tables, ["evidence_type", "lifecycle_state", "issue_date", "expiry_date", "title"])
    live = tables["entities"].filter(live_entity()).select(F.col("id").alias("entity_id"), "canonical_name")
    return rows.withColumnRenamed("id", "evidence_id").join(live, "entity_id")


def entity_evidence_timeline(tables) -> DataFrame:
    """Published documents of every entity with agency, signatory and four claims.

    The reader sorts by (entity_id, issue_date desc nulls last, evidence_id desc).
    """
    columns = ["evidence_type", "lifecycle_state", "issue_date", "expiry_date", "title", "verifier_agency_id", "signatory_id"]
    rows = linked_evidence(tables, columns)
    agencies = tables["verification_agencies"].select(F.col("id").alias("verifier_agency_id"), F.col("name").alias("agency_name"))
    people = tables["signatories"].select(F.col("id").alias("signatory_id"), F.col("name").alias("signatory_name"))
    claims = latest_values(tables, TIMELINE_CLAIMS).withColumnRenamed("evidence_id", "id").withColumnRenamed("bee_level", "reported_bee_level")
    return (
        rows.join(claims, "id", "left")
        .join(agencies, "verifier_agency_id", "left")
        .join(people, "signatory_id", "left")
        .withColumnRenamed("id", "evidence_id")
    )


def parent_child_links(tables) -> DataFrame:
    """Approved public edges to public entities, as parents and children."""
    kind = F.col("relationship_type")
    edges = tables["entity_relationships"].filter(
        (F.col("public_status") == "public") & (F.col("review_state") == "approved") & kind.isin(PARENT_TYPES + CHILD_TYPES)
    )
    targets = tables["entities"].filter(F.col("visibility") == "public").select(
        F.col("id").alias("target_entity_id"), F.col("slug").alias("target_slug"), F.col("canonical_name").alias("target_name")
    )
    return edges.join(targets, "target_entity_id").select(
        F.col("source_entity_id").alias("entity_id"),
        F.when(kind.isin(PARENT_TYPES), "parent").otherwise("child").alias("side"),
        "relationship_type",
        "target_entity_id",
        "target_slug",
        "target_name",
    )


def merge_redirect(tables) -> DataFrame:
    """Absorbed entity with the slug of its survivor; one hop."""
    entities = tables["entities"]
    survivors = entities.select(F.col("id").alias("merged_into_id"), F.col("slug").alias("redirect_to"))
    return (
        entities.filter(F.col("merged_into_id").isNotNull())
        .select("id", "slug", "merged_into_id")
        .join(survivors, "merged_into_id", "left")
    )


def official_domain_sources(tables) -> DataFrame:
    """Live entities with a monitored source on the host of their website."""
    hosts = tables["entities"].filter(live_entity() & F.col("website").isNotNull()).select(
        "id", "canonical_name", N.website_host(F.col("website")).alias("host")
    )
    sources = tables["monitored_sources"].select(F.col("entity_id").alias("id"), F.col("domain").alias("host"))
    return hosts.join(sources, ["id", "host"], "left_semi")


def entity_evidence_array(tables) -> DataFrame:
    """Each entity with its published documents, one a row; an entity without any keeps one row of nulls."""
    rows = linked_evidence(tables, ["evidence_type", "lifecycle_state", "issue_date", "title"])
    entities = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"), "canonical_name", "visibility")
    return entities.join(rows, "entity_id", "left").select("entity_id", "canonical_name", "visibility", F.col("id").alias("evidence_id"), "evidence_type", "lifecycle_state", "issue_date", "title")


def _section(df: DataFrame, key: str, section: str, *, date: str | None = None, of: str | None = None, value: str | None = None) -> DataFrame:
    """(key, section, item_date, item_key, item_value)."""
    null = F.lit(None)
    return df.select(
        F.col(key).alias("key"),
        F.lit(section).alias("section"),
        (F.to_date(date) if date else null).cast("date").alias("item_date"),
        (F.col(of) if of else null).cast("string").alias("item_key"),
        (F.col(value) if value else null).cast("string").alias("item_value"),
    )


ITEM = ["section", "item_date", "item_key", "item_value"]


def entity_profile(tables) -> DataFrame:
    """Profile of every live entity: its state, one row per item of each section.

    Sections are aliases, sectors, parents, children, claims, events,
    documents and included documents.  An entity without any item keeps one
    row.  Items stay rows, so no list grows with an entity.
    """
    raw = tables["evidence_raw"]
    visible = linked_evidence({"evidence_entity_links": tables["evidence_entity_links"], "evidence": raw}, ["issue_date"])
    newest = visible.groupBy("entity_id").agg(F.max(F.struct("issue_date", "id")).getField("id").alias("newest_id"))
    state = tables["entity_current_state"].select(
        "entity_id", "bee_level", "lifecycle_state", F.col("evidence_id").alias("state_evidence_id"), "verifier_agency_id"
    )
    shown = visible.select("entity_id", F.col("id").alias("state_evidence_id"), F.lit(True).alias("shown"))
    agencies = tables["verification_agencies"].select(F.col("id").alias("verifier_agency_id"), F.col("name").alias("agency_name"))
    header = (
        tables["entities"]
        .filter(live_entity())
        .select(F.col("id").alias("entity_id"), "slug", "canonical_name", "registration_number")
        .join(state, "entity_id", "left")
        .join(shown, ["entity_id", "state_evidence_id"], "left")
        .join(newest, "entity_id", "left")
        .join(agencies, "verifier_agency_id", "left")
    )
    names = tables["sectors"].select(F.col("id").alias("sector_id"), F.col("name").alias("sector_name"))
    sectors = (
        tables["entity_classifications"]
        .filter(F.col("is_public") & (F.col("classification_type") == "sector") & ~F.col("sector_id").isin(NON_INDUSTRY_SECTORS))
        .join(names, "sector_id")
    )
    edges = parent_child_links(tables)
    included = (
        tables["evidence_entity_links"]
        .filter(F.col("link_state") == "included")
        .select("entity_id", F.col("evidence_id").alias("id"))
        .join(raw.filter(published()).select("id", "issue_date"), "id")
    )
    sections = reduce(DataFrame.unionByName, [
            _section(tables["entity_aliases"].filter(F.col("reviewed_status") == "reviewed"), "entity_id", "aliases", value="alias"),
            _section(sectors, "entity_id", "sectors", value="sector_name"),
            _section(edges.filter(F.col("side") == "parent"), "entity_id", "parents", value="target_name"),
            _section(edges.filter(F.col("side") == "child"), "entity_id", "children", value="target_name"),
            _section(tables["published_claims"], "entity_id", "claims", of="field_key", value="value"),
            _section(tables["publication_events"], "entity_id", "events", date="published_at", of="id"),
            _section(visible, "entity_id", "documents", date="issue_date", of="id"),
            _section(included, "entity_id", "included", date="issue_date", of="id"),
        ],
    ).withColumnRenamed("key", "entity_id")
    return header.join(sections, "entity_id", "left").select(
        "entity_id",
        "slug",
        "canonical_name",
        "registration_number",
        "bee_level",
        "lifecycle_state",
        "agency_name",
        F.when(F.col("shown"), F.col("state_evidence_id")).otherwise(F.col("newest_id")).alias("supporting_id"),
        "section",
        *ITEM[1:],
    )


def evidence_profile(tables) -> DataFrame:
    """Every published document, one row per item of each section: entities, claims, locations."""
    rows = tables["evidence"].filter(published()).select("id", "title", "evidence_type", "lifecycle_state", "verifier_agency_id", "signatory_id")
    public = tables["entities"].filter(F.col("visibility") == "public").select(F.col("id").alias("entity_id"), "canonical_name")
    entities = tables["evidence_entity_links"].filter(visible_link()).join(public, "entity_id")
    sections = reduce(DataFrame.unionByName, [
            _section(entities, "evidence_id", "entities", of="entity_id", value="canonical_name"),
            _section(working_claims(tables), "evidence_id", "claims", of="field_key", value="value"),
            _section(tables["evidence_source_locations"], "evidence_id", "locations", date="last_seen_at", value="url"),
        ],
    ).withColumnRenamed("key", "id")
    agencies = tables["verification_agencies"].select(F.col("id").alias("verifier_agency_id"), F.col("name").alias("agency_name"))
    people = tables["signatories"].select(F.col("id").alias("signatory_id"), F.col("name").alias("signatory_name"))
    return (
        rows.join(sections, "id", "left")
        .join(agencies, "verifier_agency_id", "left")
        .join(people, "signatory_id", "left")
        .select("id", "title", "evidence_type", "lifecycle_state", "agency_name", "signatory_name", *ITEM)
    )


def agency_profile(tables, newest: int = 100) -> DataFrame:
    """Newest published documents of each public agency, with its identifiers."""
    agencies = tables["verification_agencies"].filter(F.col("visibility") == "public").select(F.col("id").alias("verifier_agency_id"), F.col("name").alias("agency_name"))
    rows = tables["evidence_raw"].filter(published()).select("id", "title", "evidence_type", "issue_date", "verifier_agency_id")
    confirmed = tables["evidence_entity_links"].filter(F.col("link_state") == "confirmed").select(F.col("evidence_id").alias("id"), "entity_id")
    top = top_per_group(
        rows.join(confirmed, "id", "left").join(agencies, "verifier_agency_id"),
        ["verifier_agency_id"],
        [F.desc_nulls_last("issue_date"), F.desc("id"), F.asc_nulls_last("entity_id")],
        newest,
    ).withColumnRenamed("_rank", "position")
    public = tables["entities"].filter(F.col("visibility") == "public").select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name"))
    marks = tables["agency_accreditations"].groupBy(F.col("agency_id").alias("verifier_agency_id")).agg(F.min("accreditation_identifier").alias("accreditation"))
    aliases = tables["agency_aliases"].groupBy(F.col("agency_id").alias("verifier_agency_id")).agg(F.count("*").alias("alias_count"))
    people = tables["signatories"].groupBy(F.col("agency_id").alias("verifier_agency_id")).agg(F.count("*").alias("signatory_count"))
    return (
        top.join(public, "entity_id", "left")
        .join(marks, "verifier_agency_id", "left")
        .join(aliases, "verifier_agency_id", "left")
        .join(people, "verifier_agency_id", "left")
        .fillna(0, ["alias_count", "signatory_count"])
    )


def agency_sections(tables, newest: int = 100) -> DataFrame:
    """Profile of every public agency as rows of sections, agencies without documents included.

    Sections are agency, alias, accreditation, signatory (by name) and evidence
    (the newest documents); ``position`` counts within a section.
    """
    public = tables["verification_agencies"].filter("visibility = 'public'")
    keys = public.select(F.col("id").alias("agency_id"))
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, section: str, label: Column, detail: Column = none, extra: Column = none, order: list[Column] | None = None) -> DataFrame:
        place = F.row_number().over(W.partitionBy("agency_id").orderBy(*(order or [label, detail])))
        return df.join(keys, "agency_id", "left_semi").select("agency_id", F.lit(section).alias("section"), place.alias("position"), label.cast("string").alias("label"), detail.cast("string").alias("detail"), extra.cast("string").alias("extra"))

    c = F.col
    named = public.select(c("id").alias("agency_id"), "name", "legal_name", "website")
    confirmed = tables["evidence_entity_links"].filter("link_state = 'confirmed'").select(c("evidence_id").alias("id"), "entity_id")
    shown = tables["entities"].filter("visibility = 'public'").select(c("id").alias("entity_id"), "canonical_name")
    papers = tables["evidence_raw"].filter(published()).select("id", "title", "issue_date", c("verifier_agency_id").alias("agency_id")).join(keys, "agency_id", "left_semi")
    newest_first = [F.desc_nulls_last("issue_date"), F.desc("id"), F.asc_nulls_last("entity_id")]
    top = top_per_group(papers.join(confirmed, "id", "left"), ["agency_id"], newest_first, newest).join(shown, "entity_id", "left")
    evidence = top.select("agency_id", F.lit("evidence").alias("section"), c("_rank").alias("position"), c("title").alias("label"), c("canonical_name").alias("detail"), F.date_format("issue_date", "yyyy-MM-dd").alias("extra"))
    parts = [
        rows(named, "agency", c("name"), c("legal_name"), c("website")),
        rows(tables["agency_aliases"], "alias", c("alias")),
        rows(tables["agency_accreditations"], "accreditation", c("accreditation_identifier"), c("accreditation_body"), c("status")),
        rows(tables["signatories"], "signatory", c("name"), c("role_title")),
        evidence,
    ]
    return reduce(DataFrame.unionByName, parts)
