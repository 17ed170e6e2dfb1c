"""From the clean table to the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hazardframe.operators.features import build_features
from hazardframe.roles import INCIDENT, Roles
from hazardframe.sources.tables import save_table


def run_features(
    clean: DataFrame, path: str | None = None, leak_free: bool = False, r: Roles = INCIDENT
) -> DataFrame:
    """All features; given a path, written there and read back, which cuts the lineage."""
    features = build_features(clean, leak_free=leak_free, r=r)
    if path is None:
        return features
    save_table(features, path)
    return clean.sparkSession.read.parquet(path)
