"""The registered queries of the contact library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardfile.plans import checks
from cardfile.plans.queries import QUERIES, email_domains


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_domains(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return checks.all_sql()
