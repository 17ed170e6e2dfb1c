"""Grid cells, hot spots and map layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions.scalar import n_rows, share
from hazardframe.roles import FATAL, INCIDENT, SERIOUS, Roles
from hazardframe.sources.tables import sample_rows


def _cell(c: str, size: float) -> Column:
    """Number of the grid line nearest to the coordinate: an integer key, not a fraction."""
    return F.round(F.col(c) / F.lit(size)).cast("long")


def _grid(df: DataFrame, size: float, r: Roles) -> DataFrame:
    return df.withColumns({"_i": _cell(r.lat, size), "_j": _cell(r.lon, size)})


def _centre(index: str, size: float) -> Column:
    return F.round(F.col(index) * F.lit(size), 6)


def black_spots(df: DataFrame, cell: float = 0.05, n: int = 20, r: Roles = INCIDENT) -> DataFrame:
    """Grid cells with most serious and fatal incidents; fatal share is among those."""
    severe = df.where(F.col(r.severity).isin(SERIOUS, FATAL))
    cells = _grid(severe, cell, r).groupBy("_i", "_j").agg(
        n_rows().alias("n"),
        F.sum(r.deaths).alias("deces"),
        share(F.col(r.severity) == FATAL, 1).alias("pct_mortel"),
    )
    top = cells.orderBy(F.desc("n"), "_i", "_j").limit(n)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "_i", "_j"))  # over n rows only
    return top.select(
        place.alias("rank"),
        _centre("_i", cell).alias("latitude"),
        _centre("_j", cell).alias("longitude"),
        "n",
        "deces",
        "pct_mortel",
        (F.col("n") / 10 + 8).alias("radius"),
    )


def region_summary(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Per region: incidents, deaths, fatal share, mean position and marker radius."""
    return df.groupBy(r.region).agg(
        n_rows().alias("n"),
        F.sum(r.deaths).alias("deces"),
        share(F.col(r.severity) == FATAL, 1).alias("pct_mortel"),
        F.round(F.avg(r.lat), 4).alias("latitude"),
        F.round(F.avg(r.lon), 4).alias("longitude"),
        F.least(n_rows() / 100, F.lit(80.0)).alias("radius"),
    )


def density_grid(df: DataFrame, cell: float = 0.05, by: Sequence[str] = (), r: Roles = INCIDENT) -> DataFrame:
    """Incidents per grid cell; with ``by``, one grid per value of those columns."""
    return (
        _grid(df, cell, r)
        .groupBy(*by, "_i", "_j")
        .agg(n_rows().alias("n"))
        .select(*by, _centre("_i", cell).alias("latitude"), _centre("_j", cell).alias("longitude"), "n")
    )


def heat_frames(df: DataFrame, cell: float = 0.05, r: Roles = INCIDENT) -> DataFrame:
    """One density grid per period of the day."""
    return density_grid(df, cell, [r.period], r)


def points(
    df: DataFrame,
    n: int = 6000,
    columns: Sequence[str] = (),
    severity: str | None = None,
    seed: int = 42,
    r: Roles = INCIDENT,
) -> DataFrame:
    """At most ``n`` sampled rows with position, severity and hover columns."""
    rows = df if severity is None else df.where(F.col(r.severity) == severity)
    names = [r.lat, r.lon, r.severity, *columns]
    return sample_rows(rows, n, r.id, seed).select(r.id, *dict.fromkeys(c for c in names if c != r.id))
