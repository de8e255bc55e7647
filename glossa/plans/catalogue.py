"""All registered queries and, where SQL can state them, the SQL with the same rows.

Each query takes (spark, sf_dir), reads whole tables and returns a DataFrame with named columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums in another order differ in the last digits; results are stated to six."""
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


from glossa.plans import corpus, counts, extra, formats, labels, models, more, structure  # noqa: E402, F401
