"""Claims of extraction runs: latest run, working values, wide form, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import names as N
from attestor.functions.quality import canonical_field

def latest_successful_run(runs: DataFrame) -> DataFrame:
    """Newest successful run of each evidence; ties go to the larger run id."""
    return (
        runs.filter("success")
        .groupBy("evidence_id")
        .agg(F.max(F.struct("started_at", "id")).alias("top"))
        .select("evidence_id", F.col("top.id").alias("extraction_run_id"), F.col("top.started_at").alias("started_at"))
    )


def _working_value() -> Column:
    return F.coalesce(
        F.nullif(F.trim("edited_value"), F.lit("")), "normalized_value", "structured_value", "raw_value"
    )


def working_claims(tables) -> DataFrame:
    """Claims of the latest successful run with the value a reviewer would see."""
    latest = latest_successful_run(tables["extraction_runs"]).select("evidence_id", "extraction_run_id")
    return (
        tables["extracted_claims"]
        .join(latest, ["evidence_id", "extraction_run_id"])
        .select(
            "evidence_id",
            "extraction_run_id",
            F.col("id").alias("claim_id"),
            "field_key",
            canonical_field(F.col("field_key")).alias("canonical_key"),
            _working_value().alias("value"),
            "raw_value",
            "normalized_value",
            "edited_value",
            "confidence",
        )
    )


def latest_values(tables, fields: list[str]) -> DataFrame:
    """One column per field: value of the newest successful run that has the field.

    The value is edited, else normalised, else raw, without trimming, as the
    reports read it.
    """
    runs = tables["extraction_runs"].filter("success").select(F.col("id").alias("extraction_run_id"), "started_at")
    value = F.coalesce("edited_value", "normalized_value", "raw_value")
    rows = (
        tables["extracted_claims"]
        .filter(F.col("field_key").isin(fields))
        .select("evidence_id", "extraction_run_id", "field_key", value.alias("value"))
        .join(runs, "extraction_run_id")
    )
    newest = F.struct("started_at", "extraction_run_id", "value")
    return rows.groupBy("evidence_id").agg(
        *[F.max(F.when(F.col("field_key") == f, newest)).getField("value").alias(f) for f in fields]
    )


def claims_wide(tables, fields: list[str]) -> DataFrame:
    return latest_values(tables, fields)


def apply_claim_edits(tables, edits: DataFrame) -> DataFrame:
    """Overlay (evidence_id, field_key, edit) rows on the working claims.

    An edit of an unknown field becomes a manual claim of the latest run; an
    edit of evidence without a successful run is dropped.
    """
    claims = working_claims(tables).select(
        "evidence_id", "extraction_run_id", "field_key", "value", "normalized_value", "confidence"
    )
    latest = latest_successful_run(tables["extraction_runs"]).select("evidence_id", F.col("extraction_run_id").alias("run_id"))
    kept_edits = edits.join(latest, "evidence_id")
    joined = claims.join(kept_edits, ["evidence_id", "field_key"], "full_outer")
    edit = F.trim("edit")
    manual = F.col("extraction_run_id").isNull()
    key = F.col("field_key")
    normal = F.nullif(edit, F.lit(""))
    normalized = (
        F.when(key == "bee_level", F.coalesce(N.normalize_level(normal), normal))
        .when(key == "registration_number", N.normalize_registration(normal))
        .when(key.isin("legal_entity_name", "measured_entity", "trading_name"), N.normalize_name(normal))
        .otherwise(normal)
    )
    return joined.select(
        "evidence_id",
        F.coalesce("extraction_run_id", "run_id").alias("extraction_run_id"),
        "field_key",
        F.coalesce(F.nullif(edit, F.lit("")), "value").alias("value"),
        F.when(manual, normalized).otherwise(F.col("normalized_value")).alias("normalized_value"),
        F.when(manual, F.lit(1.0)).otherwise(F.col("confidence")).alias("confidence"),
        F.col("edit").isNotNull().alias("edited"),
    )
