"""The table of driver-contract queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query (spark, sf_dir) → DataFrame under its name, with its SQL if there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)
