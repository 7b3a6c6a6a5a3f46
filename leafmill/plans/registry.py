"""All named queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import incremental, oracle
from leafmill.plans import queries as named

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named.flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in named.ALL} | {"p1_found": incremental.p1_found}


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | {"p1_found": incremental.P1_SQL}
