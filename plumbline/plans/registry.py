"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded (no negative zero, NaN as null), whole numbers as long: what two engines can agree on."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(F.when(~F.isnan(c.cast("double")), c.cast("double")), DIGITS) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, doubles: str = "", longs: str = "") -> Callable[[Query], Query]:
    """Registers fn under name. doubles and longs: columns that the SQL side rounds or casts."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql:
            swaps = [f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            SQL[name] = f"SELECT * REPLACE ({', '.join(swaps)}) FROM ({sql}) AS whole" if swaps else sql
        return fn

    return register
