"""Repair of dirty records: row-local repairs first, then dedup, consistency, capping, target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.functions.ordered import median_cell
from hazardframe.functions.scalar import all_of, clip, mapped, strip
from hazardframe.roles import INCIDENT, NO, SEVERITY_ORDER, YES, Roles

BINARY_ROLES = ("helmet", "belt", "holiday")


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [n for n in names if n in df.columns]


def trim_strings(df: DataFrame) -> DataFrame:
    """White space off both ends of every string column."""
    strings = {f.name: strip(f.name) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(strings) if strings else df


def coerce_dates(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Dates as DATE; rows whose date cannot be read are dropped."""
    kind = df.schema[r.date].dataType
    day = F.to_date(r.date) if not isinstance(kind, T.StringType) else F.coalesce(
        F.try_to_date(r.date, "yyyy-MM-dd"), F.try_to_timestamp(r.date).cast("date")
    )
    return df.withColumn(r.date, day).where(F.col(r.date).isNotNull())


def wrap_hours(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Hours outside 0..23 wrap around the day, negative ones too."""
    hour = F.col(r.hour)
    return df.withColumn(r.hour, F.when(hour.between(0, 23), hour).otherwise(F.pmod(hour, F.lit(24))))


def clip_speed(df: DataFrame, r: Roles = INCIDENT, low: float = 0.0, high: float = 200.0) -> DataFrame:
    """Speeds into the physically possible range; unknown stays unknown."""
    return df.withColumn(r.speed, clip(r.speed, low, high))


def repair_negative_cost(df: DataFrame, r: Roles = INCIDENT, accuracy: int | None = None) -> DataFrame:
    """Negative costs become the median of the others. The result is double: a median may be x.5."""
    cost = F.col(r.cost)
    fair = median_cell(df, F.when(cost >= 0, cost), accuracy=accuracy)
    return df.withColumn(r.cost, F.when(cost < 0, fair).otherwise(cost.cast("double")))


def standardise_binary(df: DataFrame, r: Roles = INCIDENT, trimmed: bool = False) -> DataFrame:
    """Yes/no columns, in any case and padding, to exactly two spellings; anything else is unknown."""
    out = {}
    for name in _present(df, [getattr(r, role) for role in BINARY_ROLES]):
        text = F.lower(F.col(name) if trimmed else strip(name))
        out[name] = mapped(text, {YES.lower(): YES, NO.lower(): NO})
    return df.withColumns(out) if out else df


def repair_rows(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """All row-local repairs in one projection: no shuffle, no statistics."""
    df = trim_strings(df)
    steps = {r.date: coerce_dates, r.hour: wrap_hours, r.speed: clip_speed}
    for column, step in steps.items():
        if column in df.columns:
            df = step(df, r)
    return standardise_binary(df, r, trimmed=True)


def keep_first(df: DataFrame, tie: Sequence[Column | str], r: Roles = INCIDENT) -> DataFrame:
    """One row per incident id: the first in the order of ``tie``.

    Catalyst puts a group limit before the shuffle, so each task ships one row per
    id however many copies an id has.
    """
    order = Window.partitionBy(r.id).orderBy(*tie)
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def drop_incoherent(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Rows with more deaths than victims go; an unknown count is no contradiction."""
    return df.where(~F.coalesce(F.col(r.deaths) > F.col(r.victims), F.lit(False)))


def cap_cost(df: DataFrame, r: Roles = INCIDENT, prob: float = 0.999, accuracy: int | None = None) -> DataFrame:
    """Cap costs at an upper quantile."""
    cap = median_cell(df, r.cost, prob, accuracy)
    cost = F.col(r.cost).cast("double")
    return df.withColumn(r.cost, F.when(cost.isNotNull(), F.least(cost, cap)))


def encode_severity(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Severity as 0/1/2; rows with another label are dropped."""
    return df.withColumn(r.severity_rank, mapped(r.severity, SEVERITY_ORDER)).where(
        F.col(r.severity_rank).isNotNull()
    )


def narrow_types(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Longs and ints of known range to the smallest width that holds it."""
    narrow = {
        r.hour: "tinyint",
        r.semester: "tinyint",
        r.vehicles: "smallint",
        r.deaths: "smallint",
        r.limit: "smallint",
        r.severity_rank: "tinyint",
    }
    return df.withColumns({c: F.col(c).cast(t) for c, t in narrow.items() if c in df.columns})


def filter_incidents(
    df: DataFrame,
    years: tuple[int, int] | None = None,
    regions: Sequence[str] = (),
    severities: Sequence[str] = (),
    vehicles: Sequence[str] = (),
    periods: Sequence[str] = (),
    r: Roles = INCIDENT,
) -> DataFrame:
    """Conjunction of optional filters; an empty list means no filter, years are inclusive.

    The year range is written as a date range so that it reaches the Parquet scan.
    """
    tests = []
    if years:
        first, last = f"{years[0]}-01-01", f"{years[1]}-12-31"
        tests.append(F.col(r.date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    wanted = {r.region: regions, r.severity: severities, r.vehicle: vehicles, r.period: periods}
    tests += [F.col(c).isin(list(values)) for c, values in wanted.items() if values]
    return df.where(all_of(tests)) if tests else df
