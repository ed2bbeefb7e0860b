"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evidence, forensics, results  # noqa: F401  evidence and results add their queries to the table that forensics holds


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return forensics.queries()


def oracle_sql() -> dict[str, str]:
    return forensics.oracle_sql()
