"""Profiles, anomaly counts and data quality reports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.functions.joins import BROADCAST_ROWS, attach, count_sliced, materialise
from hazardframe.functions.ordered import counted, known, mean_of_counts, median_cell, quantiles, quantiles_of_counts
from hazardframe.functions.scalar import n_rows, per_100
from hazardframe.roles import ALLOWED_VALUES, INCIDENT, Roles

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in skip]


def _long(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """One (column, value) row per cell, all values cast to one type."""
    cells = df.select(*[F.col(c).cast(kind).alias(c) for c in columns])
    return cells.unpivot([], list(columns), "column", "value")


def _row_hashes(df: DataFrame) -> list[Column]:
    """Two independent hashes of a whole row; the places of unknown cells count, too."""
    unknown = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in df.columns])
    return [F.xxhash64(F.lit(seed), unknown, *df.columns).alias(f"_h{seed}") for seed in (1, 2)]


def equal_rows(df: DataFrame) -> DataFrame:
    """The rows that another row equals, once per set of equal ones, with their number ``_n``.

    Rows are counted by a 128-bit hash; only rows whose hash occurs again are compared as a whole,
    so no shuffle carries all columns of all rows.
    """
    hashes = _row_hashes(df)
    again = df.select(*hashes).groupBy("_h1", "_h2").agg(n_rows().alias("_n")).where("_n > 1").select("_h1", "_h2")
    again = materialise(again)
    some = attach(df.select("*", *hashes), again.withColumn("_again", F.lit(True)), ["_h1", "_h2"], ["_again"], "inner",
                  null_keys=False, small=again.count() <= BROADCAST_ROWS)
    return some.groupBy(*df.columns).agg(n_rows().alias("_n")).where("_n > 1")


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns and full-row duplicates."""
    extra = equal_rows(df).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    return df.agg(n_rows().alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"), extra.alias("duplicates"))


def null_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """Columns with missing values, most first, with the percentage of rows."""
    names = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names], n_rows().alias("_rows"))
    ranked = (
        counts.unpivot(["_rows"], names, "column", "missing")
        .where(F.col("missing") > 0)
        .select("column", "missing", F.round(per_100(F.col("missing"), F.col("_rows")), 2).alias("pct"))
        .orderBy(F.desc("missing"), "column")
    )
    return ranked.limit(top) if top else ranked


def completeness(df: DataFrame) -> DataFrame:
    """Known and missing cells of the whole table and the share of known ones."""
    names = df.columns
    missing = sum((F.count_if(F.col(c).isNull()) for c in names[1:]), F.count_if(F.col(names[0]).isNull()))
    cells = n_rows() * F.lit(len(names))
    return df.agg(
        (cells - missing).alias("known"),
        missing.alias("missing"),
        F.round(per_100(cells - missing, cells), 2).alias("completeness_pct"),
    )


def column_profile(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """Type, known count, missing %, distinct count and smallest value (as text) of every column.

    The exact form counts (column, value) pairs once; ``rsd`` uses sketches in a single
    aggregation instead, for tables whose distinct values are as many as their rows.
    """
    names = df.columns
    if rsd is None:
        pairs = _long(df, names, "string").groupBy("column", "value").agg(n_rows().alias("n"))
        stats = pairs.groupBy("column").agg(
            F.sum("n").alias("_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.count("value").alias("distinct"),
            F.min("value").alias("example"),
        )
    else:
        stats = _long(df, names, "string").groupBy("column").agg(
            n_rows().alias("_rows"),
            F.count("value").alias("non_null"),
            F.approx_count_distinct("value", rsd).alias("distinct"),
            F.min("value").alias("example"),
        )
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return stats.select(
        "column",
        F.element_at(types, F.col("column")).alias("dtype"),
        "non_null",
        F.round(per_100(F.col("_rows") - F.col("non_null"), F.col("_rows")), 2).alias("null_pct"),
        "distinct",
        "example",
    )


def value_frequencies(df: DataFrame, columns: Sequence[str], include_null: bool = False) -> DataFrame:
    """Frequency and share of each value of each column, all columns in one pass.

    NULLs are left out, and out of the shares too, unless ``include_null``.
    """
    cells = _long(df, columns, "string")
    if not include_null:
        cells = cells.where(F.col("value").isNotNull())
    counts = cells.groupBy("column", "value").agg(n_rows().alias("n"))
    whole = counts.groupBy("column").agg(F.sum("n").alias("_all"))
    return attach(counts, whole, ["column"], ["_all"]).select(
        "column", "value", "n", F.round(per_100(F.col("n"), F.col("_all")), 2).alias("pct")
    )


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts in equal-width bins between minimum and maximum, the last bin closed on the right.

    Only non-empty bins have a row. Mean and median come along as marks. A column with a
    single value gets a range of width one around it.
    """
    value = F.col(column).cast("double")
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    flat = F.col("low") == F.col("high")
    span = span.select(
        F.struct(
            F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
            F.when(flat, 1.0 / bins).otherwise((F.col("high") - F.col("low")) / bins).alias("width"),
            F.col("mean"),
        )
    ).scalar()
    placed = df.where(value.isNotNull()).select(value.alias("_v"), span.alias("_span"))
    index = F.least(F.floor((F.col("_v") - F.col("_span.low")) / F.col("_span.width")), F.lit(bins - 1))
    return (
        placed.groupBy(index.cast("int").alias("bin"))
        .agg(n_rows().alias("n"), F.min("_span").alias("_span"))
        .select(
            "bin",
            (F.col("_span.low") + F.col("bin") * F.col("_span.width")).alias("low"),
            (F.col("_span.low") + (F.col("bin") + 1) * F.col("_span.width")).alias("high"),
            "n",
            F.round("_span.mean", 6).alias("mean"),
            median_cell(df, column).alias("median"),
        )
        .orderBy("bin")
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of numeric columns.

    All of them come from the counted values, so the table is read once.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    counts = counted(_long(df, names, "double"), ["column"], "value")
    v, n = F.col("value"), F.col("n")
    moments = counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0)).alias("count"),
        mean_of_counts().alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.round(per_100(F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)), F.sum(n)), 4).alias("missing_pct"),
    )
    # A row per column of the table: as few as its schema has.
    spread = attach(known(counts), moments, ["column"], ["count", "mean"], small=True)
    square = F.sum(n * (v - F.col("mean")) * (v - F.col("mean")))
    spread = spread.groupBy("column").agg(F.when(F.max("count") > 1, F.sqrt(square / (F.max("count") - 1))).alias("std"))
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    cuts = quantiles_of_counts(known(counts), ["column"], marks) if accuracy is None else quantiles(
        _long(df, names, "double"), ["column"], "value", marks, accuracy)
    joined = attach(attach(moments, spread, ["column"], ["std"], small=True), cuts, ["column"], list(marks), small=True)
    return joined.select("column", "count", "mean", "std", "min", *marks, "max", "missing_pct")


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``describe`` of the listed features that exist and are numeric."""
    present = set(numeric_columns(df))
    return describe(df, [f for f in dict.fromkeys(features) if f in present])


def _rules(r: Roles) -> dict[str, tuple[Column, str]]:
    return {
        "heure_hors_plage": (~F.col(r.hour).between(0, 23), "wrap modulo 24"),
        "cout_negatif": (F.col(r.cost) < 0, "replace by median"),
        "deces_sup_victimes": (F.col(r.deaths) > F.col(r.victims), "drop the row"),
        "vitesse_aberrante": (F.col(r.speed) > 200, "clip to 200"),
    }


def anomaly_report(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Rows that break each of five rules, in percent of all rows, and the remedy."""
    rules = _rules(r)
    counts = df.agg(
        n_rows().alias("_rows"),
        *[F.count_if(test).alias(name) for name, (test, _) in rules.items()],
        (n_rows() - F.count_distinct(r.id)).alias("doublons"),
    )
    action = F.create_map(
        *[F.lit(x) for name, (_, text) in rules.items() for x in (name, text)],
        F.lit("doublons"),
        F.lit("keep one row per id"),
    )
    return counts.unpivot(["_rows"], [*rules, "doublons"], "rule", "n").select(
        "rule",
        "n",
        F.round(per_100(F.col("n"), F.col("_rows")), 3).alias("pct"),
        F.element_at(action, F.col("rule")).alias("action"),
    )


def class_balance(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Classes with count and percentage, and how often the largest outnumbers the smallest."""
    counts = df.where(F.col(r.severity).isNotNull()).groupBy(r.severity).agg(n_rows().alias("n"))
    every = Window.partitionBy()
    return counts.select(
        r.severity,
        "n",
        F.round(per_100(F.col("n"), F.sum("n").over(every)), 2).alias("pct"),
        F.round(F.max("n").over(every) / F.min("n").over(every), 6).alias("imbalance"),
    ).orderBy(F.desc("n"), r.severity)


def collection_report(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """One row: shape, period, completeness, anomalies and class counts of a raw table."""
    names = df.columns
    rules = _rules(r)
    missing = sum((F.count_if(F.col(c).isNull()) for c in names[1:]), F.count_if(F.col(names[0]).isNull()))
    anomalies = sum((F.count_if(test) for test, _ in rules.values()), n_rows() - F.count_distinct(r.id))
    classes = {f"nb_{label.lower()}": F.count_if(F.col(r.severity) == label) for label in ALLOWED_VALUES["gravite"]}
    cells = n_rows() * F.lit(len(names))
    return df.agg(
        n_rows().alias("nb_lignes"),
        F.lit(len(names)).alias("nb_colonnes"),
        F.concat_ws(" → ", F.min(r.date).cast("string"), F.max(r.date).cast("string")).alias("periode"),
        F.round(per_100(cells - missing, cells), 2).alias("completude_pct"),
        anomalies.alias("nb_anomalies"),
        *[count.alias(name) for name, count in classes.items()],
    )


def collection_document(df: DataFrame, r: Roles = INCIDENT) -> dict:
    """The collection report as a plain document, ready for a JSON file."""
    return json.loads(collection_report(df, r).toJSON().first())


def unexpected_values(df: DataFrame, allowed: Mapping[str, Sequence[str]] = ALLOWED_VALUES) -> DataFrame:
    """Values outside the allowed set of their column, with their number of rows."""
    names = [c for c in allowed if c in df.columns]
    cells = _long(df, names, "string").where(F.col("value").isNotNull())
    counts = cells.groupBy("column", "value").agg(n_rows().alias("n"))
    fine = F.create_map(
        *[x for c in names for x in (F.lit(c), F.array(*[F.lit(v) for v in allowed[c]]))]
    )
    return counts.where(~F.array_contains(F.element_at(fine, F.col("column")), F.col("value")))


def before_after(raw: DataFrame, clean: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Rows before and after cleaning, retention, missing cells and duplicate rows left."""
    missing = F.size(F.filter(F.array(*[F.col(c).isNull() for c in clean.columns]), lambda x: x))
    before = F.lit(count_sliced(raw, r.id if r.id in raw.columns else raw.columns[0])).cast("long")
    extra = equal_rows(clean).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).scalar()
    return clean.agg(
        n_rows().alias("rows_clean"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("missing_left"),
    ).select(
        before.alias("rows_raw"),
        "rows_clean",
        (before - F.col("rows_clean")).alias("rows_removed"),
        F.round(per_100(F.col("rows_clean"), before), 2).alias("retention_pct"),
        F.lit(len(clean.columns)).alias("columns"),
        "missing_left",
        extra.alias("duplicates_left"),
    )
