"""A registered query: the Spark plan and, where SQL can say the same, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
