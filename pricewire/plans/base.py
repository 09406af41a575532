"""Registry used by the query modules: ``@query(name, sql)`` records a Spark
job ``(spark, sf_dir) -> DataFrame`` and, when the job is SQL-expressible,
the DuckDB oracle string that must give the same rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (and double arrays) for order-independent compares."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def flatten(df: DataFrame, array_col: str, n: int, prefix: str, start: int = 1) -> DataFrame:
    """Spread a fixed-length array into ``prefix{start}..`` scalar columns."""
    extra = [F.col(array_col)[i].alias(f"{prefix}{i + start}") for i in range(n)]
    return df.select(*[c for c in df.columns if c != array_col], *extra)
