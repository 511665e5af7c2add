"""Lifecycle of published evidence and the entity snapshot built from it.

The order-dependent rules are written as aggregates rather than as windows
over whole entities.  Stage one counts rows per (entity, class, issue,
expiry) with map-side combine; stage two reduces those few groups per entity.
An entity holding a third of all rows therefore never lands in one task.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.operators.claims import latest_values, working_claims
from attestor.operators.common import is_status, published, top_per_group
from attestor.operators.graph import heavy_keys, join_facts
from attestor.schemas import COMPANY_DISCLOSURE_TYPES, DISCLOSURE_TYPES, LIFECYCLE_LINKS, STATE_FIELDS, Clock

NO_ISSUE = "Multiple live certificates have no issue date; current record was not guessed."


def is_disclosure(kind: str = "evidence_type") -> Column:
    """Dated disclosures never compete for the current certificate."""
    return F.col(kind).isin(DISCLOSURE_TYPES + COMPANY_DISCLOSURE_TYPES)


def expiry_status(expiry: Column, state: Column, as_of: Column, soon_days: int) -> Column:
    valid = state.isin("current", "expiring_soon")
    return (
        F.when(expiry.isNull(), F.when(valid, F.lit("unknown_validity")).otherwise(state))
        .when(expiry < as_of, F.lit("expired"))
        .when(valid & (expiry <= F.date_add(as_of, soon_days)), F.lit("expiring_soon"))
        .when(state == "expiring_soon", F.lit("current"))
        .otherwise(state)
    )


def entity_evidence_pairs(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Published evidence per entity, candidate links included."""
    kept = links.filter(F.col("link_state").isin(LIFECYCLE_LINKS)).select(
        "entity_id", F.col("evidence_id").alias("id")
    )
    rows = evidence.filter(published()).select("id", "evidence_type", "issue_date", "expiry_date", "discovered_at")
    return kept.join(rows, "id")


def entity_lifecycle(pairs: DataFrame, clock: Clock) -> DataFrame:
    """One row per entity with certificate-class evidence: the decision facts."""
    now = F.lit(clock.as_of)
    graded = (
        pairs.filter(~is_disclosure())
        .withColumn("status", is_status())
        .groupBy("entity_id", "status", "issue_date", "expiry_date")
        .agg(F.count("*").alias("n"), F.max(F.struct("discovered_at", "id")).alias("newest"))
    )
    key = F.struct("issue_date", "expiry_date", "newest", "n")
    live = F.col("expiry_date") >= now

    def pool(flag: Column, prefix: str) -> list[Column]:
        return [
            F.max(F.when(flag & live, key)).alias(f"{prefix}_live"),
            F.sum(F.when(flag & live, F.col("n")).otherwise(0)).alias(f"{prefix}_count"),
            F.max(F.when(flag, key)).alias(f"{prefix}_any"),
        ]

    per_entity = graded.groupBy("entity_id").agg(
        F.max("status").alias("has_status"),
        *pool(F.col("status"), "s"),
        # Without a status document every certificate-class row competes.
        *pool(F.lit(True), "a"),
    )

    def choose(name: str) -> Column:
        return F.when(F.col("has_status"), F.col(f"s_{name}")).otherwise(F.col(f"a_{name}"))

    top = per_entity.select(
        "entity_id",
        "has_status",
        choose("live").alias("top"),
        choose("count").alias("live_count"),
        choose("any").alias("any_top"),
    )
    disputed = (F.col("live_count") >= 2) & (F.col("top.issue_date").isNull() | (F.col("top.n") >= 2))
    return top.select(
        "entity_id",
        "has_status",
        "live_count",
        disputed.alias("disputed"),
        F.col("top.issue_date").alias("top_issue"),
        F.col("top.expiry_date").alias("top_expiry"),
        F.when(~disputed & (F.col("live_count") >= 1), F.col("top.newest.id")).alias("current_evidence_id"),
        F.col("any_top.newest.id").alias("newest_evidence_id"),
    ).withColumn("supporting_evidence_id", F.coalesce("current_evidence_id", "newest_evidence_id"))


def decided_evidence(evidence: DataFrame, links: DataFrame, clock: Clock) -> DataFrame:
    """Every published linked document with its decision and its entity's facts."""
    pairs = entity_evidence_pairs(evidence, links)
    facts = entity_lifecycle(pairs, clock)
    now = F.lit(clock.as_of)
    expired = F.coalesce(F.col("expiry_date") < now, F.lit(False))
    present = F.coalesce(F.col("expiry_date") >= now, F.lit(False))
    competes = is_status() | ~F.col("has_status")
    has_current = F.col("current_evidence_id").isNotNull()
    lifecycle = (
        F.when(is_disclosure(), "historical")
        .when(F.col("disputed") & competes & present, "disputed")
        .when(
            has_current & (F.col("id") == F.col("current_evidence_id")),
            expiry_status(F.col("expiry_date"), F.lit("current"), now, clock.soon_days),
        )
        .when(expired, "expired")
        .when(has_current & competes, "superseded")
        .when(~present & competes, "unknown_validity")
        .otherwise("historical")
    )
    # Entities whose evidence is all disclosures have no facts.
    return join_facts(pairs, facts, "entity_id", heavy_keys(links, "entity_id"), "id").select(
        "entity_id",
        F.col("id").alias("evidence_id"),
        lifecycle.alias("lifecycle"),
        F.coalesce("disputed", F.lit(False)).alias("disputed"),
        "current_evidence_id",
        "supporting_evidence_id",
    )


def classify_lifecycle(evidence: DataFrame, links: DataFrame, clock: Clock) -> DataFrame:
    """(entity_id, evidence_id, lifecycle) for every published linked document."""
    return decided_evidence(evidence, links, clock).select("entity_id", "evidence_id", "lifecycle")


def with_lifecycle(evidence: DataFrame, decided: DataFrame) -> DataFrame:
    """Evidence with ``lifecycle_state``; unlinked or unpublished rows are ``discovered``.

    A document linked to several entities takes the decision of the highest
    entity id, where a serial pass would keep whichever entity came last.
    """
    state = decided.groupBy(F.col("evidence_id").alias("id")).agg(F.max_by("lifecycle", "entity_id").alias("state"))
    return evidence.join(state, "id", "left").select(
        "*", F.coalesce("state", F.lit("discovered")).alias("lifecycle_state")
    ).drop("state")


def dispute_reasons(evidence: DataFrame, links: DataFrame, levels: DataFrame, clock: Clock) -> DataFrame:
    """Why an entity has no current record; compares the levels of the two newest ties."""
    pairs = entity_evidence_pairs(evidence, links)
    facts = entity_lifecycle(pairs, clock).filter("disputed")
    tied = (
        pairs.filter(~is_disclosure() & (F.col("expiry_date") >= F.lit(clock.as_of)))
        .join(facts.select("entity_id", "has_status", "top_issue", "top_expiry", "supporting_evidence_id"), "entity_id")
        .filter((is_status() | ~F.col("has_status")) & F.col("issue_date").eqNullSafe(F.col("top_issue")))
        .filter(F.col("top_issue").isNull() | (F.col("expiry_date") == F.col("top_expiry")))
    )
    order = [F.desc_nulls_last(c) for c in ("issue_date", "expiry_date", "discovered_at", "id")]
    pair = (
        top_per_group(tied, ["entity_id"], order, 2)
        .join(levels.select(F.col("evidence_id").alias("id"), "bee_level"), "id", "left")
        .groupBy("entity_id", "top_issue", "supporting_evidence_id")
        .agg(F.min("bee_level").alias("low"), F.max("bee_level").alias("high"), F.count("bee_level").alias("n"))
    )
    issue = F.date_format("top_issue", "yyyy-MM-dd")
    text = (
        F.when(F.col("top_issue").isNull(), NO_ISSUE)
        .when(
            (F.col("n") == 2) & (F.col("low") != F.col("high")),
            F.concat(
                F.lit("Multiple live certificates share issue date "), issue, F.lit(" with conflicting B-BBEE levels.")
            ),
        )
        .otherwise(
            F.concat(
                F.lit("Multiple live certificates share issue date "), issue, F.lit("; current record was not guessed.")
            )
        )
    )
    return pair.select("entity_id", "supporting_evidence_id", text.alias("reason"))


def current_state(tables) -> DataFrame:
    """Entity snapshot: claims of the supporting document, under locks and identity."""
    decided = tables["decided_evidence"]
    state = decided.groupBy("entity_id").agg(
        F.max("disputed").alias("disputed"),
        F.max("current_evidence_id").alias("current_evidence_id"),
        F.max("supporting_evidence_id").alias("supporting_evidence_id"),
        F.max(F.col("lifecycle") == "unknown_validity").alias("unknown"),
        F.max(F.when(F.col("evidence_id") == F.col("supporting_evidence_id"), F.col("lifecycle"))).alias("lifecycle"),
    )
    lifecycle = (
        F.when(F.col("disputed"), "disputed")
        .when(F.col("current_evidence_id").isNotNull(), F.col("lifecycle"))
        .when(F.col("unknown"), "unknown_validity")
        .when(F.col("supporting_evidence_id").isNotNull(), F.col("lifecycle"))
    )
    entities = tables["entities"].select(
        F.col("id").alias("entity_id"), "registration_number", "registration_number_normalized"
    )
    supported = state.join(entities, "entity_id", "left")

    # For the fields of the snapshot any non-blank value is plausible.
    claims = working_claims(tables).filter(F.col("canonical_key").isin(STATE_FIELDS) & (F.trim("value") != ""))
    own_number = (
        (F.col("canonical_key") != "registration_number")
        | F.col("registration_number_normalized").isNull()
        | (N.normalize_registration(F.col("value")) == F.col("registration_number_normalized"))
    )
    incoming = (
        supported.filter(F.col("supporting_evidence_id").isNotNull() & ~F.col("disputed"))
        .select("entity_id", F.col("supporting_evidence_id").alias("evidence_id"), "registration_number_normalized")
        .join(claims.select("evidence_id", "canonical_key", "field_key", "value"), "evidence_id")
        .filter(own_number)
        .groupBy("entity_id")
        .agg(*_by_field("canonical_key", F.max_by, "i_", "field_key"))
    )
    stored = (
        tables["published_claims"]
        .join(state.select("entity_id", "supporting_evidence_id"), "entity_id")
        .groupBy("entity_id")
        .agg(
            *_by_field("field_key", F.max, "p_"),
            F.min("published_at").alias("first_published_at"),
            F.min(F.when(F.col("evidence_id") == F.col("supporting_evidence_id"), F.col("published_at"))).alias("here_published_at"),
        )
    )
    locked = (
        tables["field_overrides"]
        .filter("locked")
        .groupBy("entity_id")
        .agg(*_by_field("field_key", F.max, "l_"), F.collect_set("field_key").alias("locked_fields"))
    )
    documents = tables["evidence_raw"].select(
        F.col("id").alias("supporting_evidence_id"), "verifier_agency_id", "signatory_id"
    )
    joined = (
        supported.join(incoming, "entity_id", "left")
        .join(stored, "entity_id", "left")
        .join(locked, "entity_id", "left")
        .join(documents, "supporting_evidence_id", "left")
    )
    has = F.col("supporting_evidence_id").isNotNull()

    def value(field: str) -> Column:
        is_locked = F.coalesce(F.array_contains("locked_fields", field), F.lit(False))
        base = F.when(has, F.coalesce(F.when(~is_locked, F.col(f"i_{field}")), F.col(f"p_{field}")))
        if field == "registration_number":
            own = F.col("registration_number")
            differs = N.normalize_registration(base) != F.col("registration_number_normalized")
            fix = has & ~F.col("disputed") & ~is_locked & own.isNotNull()
            base = F.when(fix & (base.isNull() | differs), own).otherwise(base)
        return F.coalesce(F.col(f"l_{field}"), base).alias(field)

    return joined.select(
        "entity_id",
        *[value(f) for f in STATE_FIELDS],
        F.col("supporting_evidence_id").alias("evidence_id"),
        "verifier_agency_id",
        "signatory_id",
        lifecycle.alias("lifecycle_state"),
        F.coalesce("here_published_at", "first_published_at").alias("published_at"),
        "disputed",
    )


def _by_field(key: str, agg, prefix: str, *by: str) -> list[Column]:
    """One aggregate of the non-empty ``value`` per snapshot field."""
    value = F.nullif(F.col("value"), F.lit(""))
    return [agg(F.when(F.col(key) == f, value), *[F.when(F.col(key) == f, F.col(b)) for b in by]).alias(prefix + f) for f in STATE_FIELDS]


def refresh_expiries(tables, before: DataFrame, clock: Clock) -> DataFrame:
    """Evidence whose lifecycle changed, given the previously stored states."""
    unmerged = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"))
    links = tables["evidence_entity_links"].join(unmerged, "entity_id", "left_semi")
    after = classify_lifecycle(tables["evidence_raw"], links, clock)
    return (
        after.join(before.select("evidence_id", F.col("lifecycle").alias("before")), "evidence_id", "left")
        .filter(~F.col("before").eqNullSafe(F.col("lifecycle")))
        .select("entity_id", "evidence_id", "before", F.col("lifecycle").alias("after"))
    )


def evidence_levels(tables) -> DataFrame:
    """Reported level per evidence from its newest successful run that has one."""
    return latest_values(tables, ["bee_level"]).select("evidence_id", "bee_level")


def transition_index(tables, clock: Clock) -> DataFrame:
    """(day, entity_id): the days on which the date alone can change a company's documents.

    A document changes when its last ``soon_days`` begin, and on the day after
    its expiry.
    """
    unmerged = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"))
    pairs = entity_evidence_pairs(tables["evidence_raw"], tables["evidence_entity_links"].join(unmerged, "entity_id", "left_semi"))
    days = F.array(F.date_sub("expiry_date", clock.soon_days), F.date_add("expiry_date", 1))
    return pairs.filter("expiry_date is not null").select("entity_id", F.explode(days).alias("day")).distinct()


def write_transition_index(index: DataFrame, path: str) -> None:
    """One folder per day, so that a run opens only the days it is asked for."""
    index.repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)


def refresh_due(tables, index: DataFrame, since: date, clock: Clock) -> DataFrame:
    """What the days after ``since`` up to the clock change, looking only at companies due in between.

    Equals a comparison of all states at both dates, as long as nothing but
    the date has changed.
    """
    due = index.filter((F.col("day") > F.lit(since)) & (F.col("day") <= F.lit(clock.as_of))).select("entity_id").distinct()
    links = tables["evidence_entity_links"].join(due, "entity_id", "left_semi")
    then = classify_lifecycle(tables["evidence_raw"], links, replace(clock, as_of=since))
    now = classify_lifecycle(tables["evidence_raw"], links, clock).withColumnRenamed("lifecycle", "after")
    changed = then.withColumnRenamed("lifecycle", "before").join(now, ["entity_id", "evidence_id"])
    return changed.filter("before <> after").select("entity_id", "evidence_id", "before", "after")


def refresh_counts(changes: DataFrame) -> DataFrame:
    """Changed documents by state before and after."""
    return changes.groupBy("before", "after").agg(F.count("*").alias("updated"))


def refresh_reviews(tables, clock: Clock) -> DataFrame:
    """Reviews to open for companies whose current record is disputed, unless one is open for the document."""
    from attestor.operators.publish import open_review_once

    unmerged = tables["entities"].filter(F.col("merged_into_id").isNull()).select(F.col("id").alias("entity_id"))
    links = tables["evidence_entity_links"].join(unmerged, "entity_id", "left_semi")
    disputes = dispute_reasons(tables["evidence_raw"], links, evidence_levels(tables), clock)
    wanted = disputes.select(F.lit("conflicting_evidence").alias("type"), "reason", F.lit("high").alias("severity"), "entity_id", F.col("supporting_evidence_id").alias("evidence_id"))
    return open_review_once(tables["review_items"], wanted)
