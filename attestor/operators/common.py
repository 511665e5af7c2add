"""Shared predicates, joins and skew-safe helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestor.schemas import STATUS_TYPES, VALID_STATES, VISIBLE_LINKS


def live_entity() -> Column:
    return (F.col("visibility") == "public") & F.col("merged_into_id").isNull()


def published() -> Column:
    return F.col("publication_state") == "published"


def is_status(kind: str = "evidence_type") -> Column:
    return F.col(kind).isin(STATUS_TYPES)


def is_valid(state: str = "lifecycle_state") -> Column:
    return F.col(state).isin(VALID_STATES)


def visible_link() -> Column:
    return F.col("link_state").isin(VISIBLE_LINKS)


def linked_evidence(tables, evidence_columns: list[str], *, visible: bool = True, only_published: bool = True) -> DataFrame:
    """(entity_id, evidence columns) for every link; the base of most reports."""
    links, evidence = tables["evidence_entity_links"], tables["evidence"]
    if visible:
        links = links.filter(visible_link())
    if only_published:
        evidence = evidence.filter(published())
    wanted = [c for c in evidence_columns if c != "id"]
    return links.select("entity_id", F.col("evidence_id").alias("id")).join(evidence.select("id", *wanted), "id")


def count_where(condition: Column) -> Column:
    """Rows where the condition holds; nulls count as false."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def any_where(condition: Column) -> Column:
    return F.coalesce(F.max(F.coalesce(condition, F.lit(False))), F.lit(False))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A plain projection would be copied into every later filter and condition
    that reads it; the output of a generator is not.  Use it for long text
    expressions that many others build on.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Where Spark takes the number of a shuffle's tasks from before it merges small ones.
TASKS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def shuffle_tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get(name, None) or 0) for name in ("spark.sql.shuffle.partitions", TASKS))


def at_least_tasks(spark: SparkSession, n: int) -> None:
    """Let shuffles of this session have ``n`` tasks or more; Spark still merges those that turn out small."""
    if n > shuffle_tasks(spark):
        spark.conf.set(TASKS, n)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to as many tasks as a shuffle has.

    A small file of many rows is read by one task; long expressions on its rows
    should not all run there.
    """
    return df.repartition(shuffle_tasks(df.sparkSession), key)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group.

    The rank filter lets Spark cut every group to ``n`` rows per map task
    before the shuffle, so a hot key sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n)


def join_known(left: DataFrame, right: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Left join in which rows with a null key are spread over all tasks.

    A null key matches nothing, but all such rows would meet in one task; here
    each is shuffled by its own ``row`` id instead.
    """
    text = [F.col(k).cast("string") for k in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    joined = F.concat_ws("\u0001", *text)
    a = left.withColumn("_key", F.when(known, joined).otherwise(F.concat(F.lit("\u0000"), F.col(row).cast("string"))))
    b = right.filter(known).withColumn("_key", joined).drop(*keys)
    return a.join(b, "_key", "left").drop("_key")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Only a session on one machine may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to a shared folder and read back, so a lost executor costs nothing that was written."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> str:
    """Name of a session table with these rows, written once to a shared folder, dealt and sorted by ``key``.

    Joins and groupings of such tables by their keys need no exchange.  The
    key should be spread evenly, best one row each.
    """
    spark = df.sparkSession
    n = shuffle_tasks(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", shared_folder(spark, name)).format("parquet").saveAsTable(table)
    return table


def staged(spark: SparkSession, folder: str, build: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables written once to ``folder``, with a mark after the last; where the mark is found nothing is built or written.

    A run that died before the mark is written over by the next, so running
    again always ends with one whole set of tables.
    """
    mark = f"{folder}/committed"
    try:
        names = [r["name"] for r in spark.read.schema("name string").parquet(mark).collect()]
    except AnalysisException:
        names = []
    if not names:
        tables = build()
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        names = list(tables)
        spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(mark)
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
