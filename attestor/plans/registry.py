"""Registry of runnable queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.schemas import DEFAULT_CLOCK
from attestor.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Scalar columns that any engine prints alike: dates and arrays become text."""
    out = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            col = F.array_join(col, "|")
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            col = F.to_json(col)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(kind, T.DecimalType):
            col = col.cast("double")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its check in SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = Tables(spark, sf_dir, DEFAULT_CLOCK, store=True)
            tables.size_tasks()
            return portable(fn(tables))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            from attestor.plans.oracle_views import with_views

            ORACLES[name] = with_views(sql)
        return fn

    return wrap
