"""Filling of missing values: global or grouped mode and median, constants.

Modes and medians are taken from counted values, so no group is held in one task.
``fill_all`` counts the values of all imputed columns in a single pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.joins import attach, lookup, materialise, store
from hazardframe.functions.ordered import median_cell, modes, quantiles, quantiles_of_counts, value_counts
from hazardframe.roles import GOOD_SURFACE, INCIDENT, NO, UNKNOWN_CAUSE, Roles


def _cells(table: DataFrame, key: str, value: str, wanted: Sequence[str]) -> Column:
    """Rows of a small keyed table as one struct cell with a field per wanted key."""
    picks = [F.max(F.when(F.col(key) == w, F.col(value))).alias(w) for w in wanted]
    return table.agg(*picks).select(F.struct(*wanted).alias("cells")).scalar()


def fill_mode(df: DataFrame, columns: Sequence[str], default: str | None = None) -> DataFrame:
    """Most frequent value of each text column (smallest on a tie), all columns in one pass."""
    names = list(columns)
    long = df.select(*names).unpivot([], names, "column", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    cells = _cells(modes(counts, ["column"]), "column", "mode", names)
    return df.withColumns(
        {c: F.coalesce(F.col(c), cells.getField(c), F.lit(default).cast("string")) for c in names}
    )


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def fill_group_mode(df: DataFrame, column: str, by: str, default: str | None = None) -> DataFrame:
    """Most frequent value within the group. Without a group the result is NULL."""
    table = modes(value_counts(df, [by], column), [by], out="_fill")
    filled = F.coalesce(F.col(column), F.col("_fill"), F.lit(default).cast("string"))
    return (
        lookup(df, materialise(table), [by], ["_fill"])
        .withColumn(column, F.when(F.col(by).isNotNull(), filled))
        .drop("_fill")
    )


def fill_group_median(df: DataFrame, column: str, by: str) -> DataFrame:
    """Median within the group. Without a group the result is NULL."""
    table = quantiles_of_counts(value_counts(df, [by], column), [by], {"_fill": 0.5})
    filled = F.coalesce(F.col(column), F.col("_fill"))
    return (
        lookup(df, materialise(table), [by], ["_fill"])
        .withColumn(column, F.when(F.col(by).isNotNull(), filled))
        .drop("_fill")
    )


def fill_floor(df: DataFrame, column: str, value: float = 1.0, low: float = 0.0) -> DataFrame:
    """A constant for the unknown, then no value below ``low``."""
    return df.withColumn(column, F.greatest(F.coalesce(F.col(column), F.lit(value)), F.lit(low)))


def fill_median(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    cell = median_cell(df, column, accuracy=accuracy)
    return df.withColumn(column, F.coalesce(F.col(column), cell))


def fill_all(df: DataFrame, r: Roles = INCIDENT, accuracy: int | None = None) -> DataFrame:
    """Replacement of negative costs and every imputation, from one counting pass.

    Each row yields one (slot, text, number) triple per statistic; a slot is a column,
    or a column within one group. The counted triples give the mode and the median of
    every slot: a table of a few rows per group value, computed once and kept. With
    ``accuracy`` numbers are not counted; their medians are sketches of that accuracy.
    """
    texts = [r.weather, r.helmet, r.belt]
    numbers = {r.response: F.col(r.response), r.cost: F.when(F.col(r.cost) >= 0, F.col(r.cost))}
    surface_slot = F.concat(F.lit(f"{r.surface} of "), F.col(r.region))
    speed_slot = F.concat(F.lit(f"{r.speed} of "), F.col(r.road_type))
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    triples = [
        *[(F.lit(c), F.col(c), no_number) for c in texts],
        *[(F.lit(c), no_text, v.cast("double")) for c, v in numbers.items()],
        (surface_slot, F.col(r.surface), no_number),
        (speed_slot, no_text, F.col(r.speed)),
    ]
    flat = [part for triple in triples for part in triple]
    cells = df.select(F.stack(F.lit(len(triples)), *flat).alias("slot", "text", "number")).where(
        F.col("slot").isNotNull() & (F.col("text").isNotNull() | F.col("number").isNotNull())
    )
    counted = cells if accuracy is None else cells.withColumn("number", no_number)
    counts = counted.groupBy("slot", "text", "number").agg(F.count(F.lit(1)).alias("n"))
    half = {"_median": 0.5}
    if accuracy is None:
        medians = quantiles_of_counts(counts, ["slot"], half, "number")
    else:
        medians = quantiles(cells, ["slot"], "number", half, accuracy)
    fills = store(
        attach(
            modes(counts, ["slot"], "text", "_mode"),
            medians,
            ["slot"],
            ["_median"],
        ),
        "fills",
    )
    overall = {row["slot"]: row for row in fills.where(F.col("slot").isin([*texts, *numbers])).collect()}

    def known(slot: str, field: str, kind: str) -> Column:
        return F.lit(overall[slot][field] if slot in overall else None).cast(kind)

    out = df.withColumns({"_surface": surface_slot, "_speed": speed_slot})
    out = lookup(out, fills, ["_surface"], ["_mode"], right_keys=["slot"])
    out = lookup(out, fills, ["_speed"], ["_median"], right_keys=["slot"])
    surface = F.coalesce(F.col(r.surface), F.col("_mode"), F.lit(GOOD_SURFACE))
    speed = F.coalesce(F.col(r.speed), F.col("_median"))
    cost = F.col(r.cost)
    out = out.withColumns(
        {
            r.cost: F.when(cost < 0, known(r.cost, "_median", "double")).otherwise(cost.cast("double")),
            r.weather: F.coalesce(F.col(r.weather), known(r.weather, "_mode", "string")),
            r.surface: F.when(F.col(r.region).isNotNull(), surface),
            r.speed: F.when(F.col(r.road_type).isNotNull(), speed),
            r.helmet: F.coalesce(F.col(r.helmet), known(r.helmet, "_mode", "string"), F.lit(NO)),
            r.belt: F.coalesce(F.col(r.belt), known(r.belt, "_mode", "string"), F.lit(NO)),
            r.response: F.coalesce(F.col(r.response), known(r.response, "_median", "double")),
        }
    ).drop("_surface", "_speed", "_mode", "_median")
    return fill_floor(fill_constant(out, {r.cause: UNKNOWN_CAUSE}), r.victims)
