"""Joins on keys that a few values dominate, and groups of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators.common import stored

#: Keys treated as heavy; any other key holds at most one part in so many of all rows.
HEAVY = 1000


def heavy_keys(df: DataFrame, key: str, n: int = HEAVY) -> DataFrame:
    """The ``n`` most frequent keys: a bounded list, whatever the size of ``df``."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).count().orderBy(F.desc("count"), key).limit(n).select(key)


def join_heavy(left: DataFrame, right: DataFrame, key: str, n: int = HEAVY) -> DataFrame:
    """Left join to a table with one row per key, where a few keys may hold most of ``left``.

    Rows of heavy keys and of null keys stay where they are: the facts of the
    heavy keys, ``n`` rows at most, go to them.  Only the others are shuffled.
    """
    heavy = F.broadcast(heavy_keys(left, key, n))
    facts = right.join(heavy, key, "left_semi").withColumn("_heavy", F.lit(True))
    # the list, not the facts, tells heavy keys apart: a heavy key may have no facts
    marked = left.join(F.broadcast(heavy_keys(left, key, n).withColumn("_listed", F.lit(True))), key, "left")
    still = F.col("_listed").isNotNull() | F.col(key).isNull()
    stay = marked.filter(still).drop("_listed").join(F.broadcast(facts), key, "left").drop("_heavy")
    move = marked.filter(~still).drop("_listed").join(right, key, "left")
    return stay.unionByName(move.select(*stay.columns))


def join_salted(left: DataFrame, right: DataFrame, key: str, *, how: str = "inner", salts: int = 64, n: int = HEAVY, row: str) -> DataFrame:
    """Join in which the rows of heavy keys of ``left`` are dealt to ``salts`` tasks each.

    ``right`` may hold several rows per key; those of heavy keys are copied
    once per salt.  ``row`` spreads the rows of a key, null keys included, and
    ``how`` is inner or left.
    """
    heavy = heavy_keys(left, key, n).withColumn("_heavy", F.lit(True))
    spread = F.pmod(F.xxhash64(row), F.lit(salts)).cast("int")
    a = left.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.when(F.col("_heavy") | F.col(key).isNull(), spread).otherwise(0)).drop("_heavy")
    # a null key matches nothing but would gather in one task
    a = a.withColumn("_null", F.when(F.col(key).isNull(), F.xxhash64(row)).otherwise(0))
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(copies)).drop("_heavy").withColumn("_null", F.lit(0).cast("long"))
    return a.join(b, [key, "_salt", "_null"], how).drop("_salt", "_null")


def join_facts(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame, row: str, salts: int = 256) -> DataFrame:
    """Left join to one row per key, reading ``left`` once; ``heavy`` is a bounded list of its frequent keys.

    The facts of heavy keys are broadcast.  Their rows have what they need by
    then, so in the join of the others they are spread over ``salts`` values
    that match nothing, as are the rows of null keys.
    """
    facts = right.select(key, F.struct(*[c for c in right.columns if c != key]).alias("_facts"))
    few = facts.join(F.broadcast(heavy), key, "left_semi").withColumnRenamed("_facts", "_few")
    listed = heavy.withColumn("_listed", F.lit(True)).join(few, key, "left")
    marked = left.join(F.broadcast(listed), key, "left")
    apart = F.coalesce("_listed", F.lit(False)) | F.col(key).isNull()
    marked = marked.withColumn("_salt", F.when(apart, 1 + F.pmod(F.xxhash64(row), F.lit(salts))).otherwise(0).cast("int"))
    marked = marked.withColumn("_key", F.when(~apart, F.col(key)))
    # zero, but no literal: the join would drop a literal from its keys, and with it the spreading
    others = facts.withColumnRenamed(key, "_key").withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(1)).cast("int"))
    joined = marked.join(others, (marked["_salt"] == others["_salt"]) & marked["_key"].eqNullSafe(others["_key"]), "left").drop("_salt", "_key", "_listed")
    found = F.coalesce("_few", "_facts")
    return joined.select(*left.columns, *[found[c].alias(c) for c in right.columns if c != key])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the smallest node it reaches.

    Each round hooks every root to its smallest smaller partner, follows the
    hooks to their ends by pointer doubling, and keeps the edges between what
    is left.  At least every root with a smaller partner goes, so the number of
    rounds is logarithmic; every round is stored, so lineage stays short.
    """
    def between(rows: DataFrame) -> DataFrame:
        return stored(rows.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    left, found = between(edges), None
    while not left.isEmpty():
        hook = stored(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("_above"))
            moved = stored(join_heavy(hook, up, "root"), "hooks")
            hook = moved.select("node", F.coalesce("_above", "root").alias("root"))
            if moved.filter("_above is not null").isEmpty():
                break
        ends = hook.select(F.col("node").alias("_end"), F.col("root").alias("_root"))

        def at_root(rows: DataFrame, end: str, ends=ends) -> DataFrame:
            joined = join_heavy(rows, ends.withColumnRenamed("_end", end), end)
            return joined.withColumn(end, F.coalesce("_root", end)).drop("_root")

        found = hook if found is None else at_root(found, "root").select("node", "root").unionByName(hook)
        found = stored(found, "roots")
        left = between(at_root(at_root(left, "u"), "v"))
    if found is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
