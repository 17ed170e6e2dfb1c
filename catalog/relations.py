"""Relations the registered queries read, built from the test tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from hazardframe.operators.clean import repair_rows
from hazardframe.plans.cleaning import clean_incidents
from hazardframe.sources.testbed import TIE_KEY, incidents

Query = Callable[[SparkSession, str], DataFrame]


def repaired(spark: SparkSession, sf_dir: str, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Incidents after the row-local repairs; only the asked columns and the joins they need."""
    names = columns.split() if isinstance(columns, str) else columns
    return repair_rows(incidents(spark, sf_dir, names))


def on_repaired(operator: Callable[..., DataFrame], reads: str, /, **options) -> Query:
    """A query: ``operator`` over the repaired table restricted to the columns in ``reads``."""
    return lambda spark, sf_dir: operator(repaired(spark, sf_dir, reads), **options)


def raw(spark: SparkSession, sf_dir: str, columns: str, tie_key: bool = False) -> DataFrame:
    return incidents(spark, sf_dir, columns.split(), tie_key)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fully cleaned table."""
    return clean_incidents(incidents(spark, sf_dir, tie_key=True), TIE_KEY, drop=TIE_KEY)


def on_clean(operator: Callable[..., DataFrame], **options) -> Query:
    return lambda spark, sf_dir: operator(clean(spark, sf_dir), **options)
