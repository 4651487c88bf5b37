"""Where named queries and their check SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.plans.views import Tables, duck_sql
from millwright.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def plain_timestamps(df: DataFrame) -> DataFrame:
    """Zone-free timestamps at the edge, so a client's local zone never shifts them."""
    zoned = {f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
    if not zoned:
        return df
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in df.columns])


def rendered_checks() -> dict[str, str]:
    """Check SQL of every query, complete with the fragments it uses."""
    return {name: duck_sql(text) for name, text in CHECKS.items()}


def query(name: str, check: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name`` with its check SQL."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain_timestamps(build(Tables(prepare(spark), folder)))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return build

    return register
