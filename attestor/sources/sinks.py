"""Writers: corpus and rejects, append-only evidence, audit rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.operators.common import shared_folder


def reason_summary(candidates: DataFrame) -> DataFrame:
    """Rejected rows by reason; a row with several reasons counts for each."""
    return candidates.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def write_corpus(corpus: DataFrame, candidates: DataFrame, path: str) -> None:
    """Grouped items, rejected rows and the count of each reason to three JSON directories.

    ``read_corpus(spark, f"{path}/corpus")`` gives the items back.
    """
    corpus.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/corpus")
    candidates.filter(F.size("reasons") > 0).write.mode("overwrite").json(f"{path}/rejected")
    reason_summary(candidates).write.mode("overwrite").json(f"{path}/reasons")


def unseen_evidence(new: DataFrame, stored: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows whose hash is not stored, once per hash (the smallest id)."""
    others = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min(F.struct(*others)).alias("r")).select(key, "r.*")
    return first.join(stored.select(key).distinct(), key, "left_anti")


def append_evidence(new: DataFrame, stored: DataFrame, path: str, key: str = "content_hash") -> None:
    unseen_evidence(new, stored, key).write.mode("append").parquet(path)


def audit_rows(before: DataFrame, after: DataFrame, key: str, *, action: str, target: str, actor: str, reason: str) -> DataFrame:
    """One audit row per changed key, with the old and new row as JSON."""
    columns = [c for c in after.columns if c != key]
    old = before.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("before_state"))
    new = after.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("after_state"))
    changed = old.join(new, key, "full_outer").filter(~F.col("before_state").eqNullSafe(F.col("after_state")))
    return changed.select(
        F.sha2(F.concat_ws("|", F.lit(action), F.col(key).cast("string"), F.coalesce("after_state", F.lit(""))), 256).alias("id"),
        F.lit(actor).alias("actor_id"),
        F.lit(action).alias("action"),
        F.lit(target).alias("target_type"),
        F.col(key).cast("string").alias("target_id"),
        "before_state",
        "after_state",
        F.lit(reason).alias("reason"),
    )


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)
