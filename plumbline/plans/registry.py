"""Every query of the library outside the optional corpus operations, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import case_queries, rating_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return rating_queries.QUERIES | case_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return rating_queries.ORACLE | case_queries.ORACLE
