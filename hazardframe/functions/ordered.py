"""Exact order statistics without gathering a group in one task.

Spark's own ``percentile``/``median``/``mode`` keep every distinct value of a
group in one aggregation buffer, and an ordered window keeps a group in one
task. Here values are counted first (map-side combined, spread by value), then
ordered in two levels: a monotone bucket of the value, whose totals are few per
group, and the values inside one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.functions.joins import attach, materialise
from hazardframe.functions.scalar import col

# Buckets per e-fold of |value|: about 0.1 % wide, at most ~42 000 per sign below 1e18.
RESOLUTION = 1024


def log_bucket(value: Column, resolution: int = RESOLUTION) -> Column:
    """A non-decreasing bucket number that needs no knowledge of the value range."""
    return (F.signum(value) * F.floor(F.log1p(F.abs(value)) * resolution)).cast("long")


def value_counts(df: DataFrame, keys: Sequence[str], value: Column | str, name: str = "value") -> DataFrame:
    """Known values with their number of rows, per key; NULL and NaN are unknown."""
    values = df.select(*keys, col(value).alias(name))
    if isinstance(values.schema[name].dataType, T.DoubleType | T.FloatType):
        values = values.where(~F.isnan(name))
    return (
        values.where(F.col(name).isNotNull())
        .groupBy(*keys, name)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def counted(df: DataFrame, keys: Sequence[str], value: Column | str) -> DataFrame:
    """Rows per keys and value, unknown ones too, computed once and kept: (keys, value, n).

    Totals, means, deviations and quantiles of the value can all be taken from it, so that the
    rows themselves are read once. NaN counts as unknown.
    """
    values = df.select(*keys, col(value).alias("value"))
    if isinstance(values.schema["value"].dataType, T.DoubleType | T.FloatType):
        values = values.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return materialise(values.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))


def known(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("value").isNotNull())


def mean_of_counts(value: Column | str = "value") -> Column:
    """The mean, as an aggregate over counted values."""
    v = col(value)
    return F.try_divide(F.sum(v * F.col("n")).cast("double"), F.sum(F.when(v.isNotNull(), F.col("n"))))


def modes(counts: DataFrame, keys: Sequence[str], value: str = "value", out: str = "mode") -> DataFrame:
    """Most frequent value per key from counted values; the smallest one wins a tie."""
    ranked = F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(out)
    return counts.groupBy(*keys).agg(ranked)


def running_sums(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, str],
    bucket: Column | None = None,
    descending: bool = False,
) -> DataFrame:
    """Add ``out = sum of the column over all values strictly before`` for each of ``sums``.

    ``counts`` holds one row per (keys, value). ``sums`` maps output to input column.
    """
    bucket = log_bucket(F.col(value)) if bucket is None else bucket
    direction = F.desc if descending else F.asc
    spread = counts.withColumn("_b", bucket)
    before = lambda order, *part: (
        Window.partitionBy(*part)
        .orderBy(direction(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = spread.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    w_out = before("_b", *keys)
    bases = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{o}").over(w_out), F.lit(0)).alias(f"_s_{o}") for o in sums]
    )
    w_in = before(value, *keys, "_b")
    inner = spread.select(
        "*", *[F.coalesce(F.sum(c).over(w_in), F.lit(0)).alias(f"_i_{o}") for o, c in sums.items()]
    )
    joined = attach(inner, bases, [*keys, "_b"], [f"_s_{o}" for o in sums])
    return joined.select(
        *counts.columns, *[(F.col(f"_s_{o}") + F.col(f"_i_{o}")).alias(o) for o in sums]
    )


def order_statistics(
    counts: DataFrame,
    keys: Sequence[str],
    ranks: Mapping[str, Callable[[Column], Column]],
    value: str = "value",
    bucket: Column | None = None,
) -> DataFrame:
    """Values at given ranks (from 0) of each key's ascending order, from counted values.

    ``ranks`` maps an output column to a function of the key's row count. Returns the
    keys, ``n`` and the values. Only the buckets that hold a wanted rank are ordered
    inside; all others are just summed.
    """
    bucket = log_bucket(F.col(value)) if bucket is None else bucket
    spread = counts.withColumn("_b", bucket)
    totals = spread.groupBy(*keys, "_b").agg(F.sum("n").alias("_t"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(
        *keys, "_b", "_t", F.sum("_t").over(running).alias("_end"), F.sum("_t").over(group).alias("_n")
    )
    wanted_ranks = [rank(F.col("_n")) for rank in ranks.values()]
    hit = F.lit(False)
    for k in wanted_ranks:
        hit = hit | ((k >= F.col("_end") - F.col("_t")) & (k < F.col("_end")))
    wanted = totals.where(hit).select(*keys, "_b", "_n", (F.col("_end") - F.col("_t")).alias("_base"))
    values = attach(spread, wanted, [*keys, "_b"], ["_n", "_base"], how="inner")
    inside = (
        Window.partitionBy(*keys, "_b")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    end = F.col("_base") + F.sum("n").over(inside)
    values = values.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("n"))
    picks = [
        F.max(F.when((k >= F.col("_start")) & (k < F.col("_end")), F.col(value))).alias(name)
        for name, k in zip(ranks, wanted_ranks)
    ]
    return values.groupBy(*keys).agg(F.max("_n").alias("n"), *picks)


def quantiles_of_counts(
    counts: DataFrame, keys: Sequence[str], probs: Mapping[str, float], value: str = "value"
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: the keys, ``n``, a double per entry of ``probs``."""
    position = lambda p: lambda n: (n - 1) * F.lit(float(p))
    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, at=position(p): F.floor(at(n))
        ranks[f"_hi_{name}"] = lambda n, at=position(p): F.ceil(at(n))
    found = order_statistics(counts, keys, ranks, value)
    out = []
    for name, p in probs.items():
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        place = position(p)(F.col("n"))
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, "n", *out)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    accuracy: int | None = None,
) -> DataFrame:
    """Quantiles per key: exact by default, one-pass sketches with ``accuracy`` (percentile_approx)."""
    if accuracy is None:
        return quantiles_of_counts(value_counts(df, keys, value), keys, probs)
    known = df.select(*keys, col(value).cast("double").alias("value")).where(F.col("value").isNotNull())
    sketch = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("value", [float(p) for p in probs.values()], accuracy).alias("q"),
    )
    return sketch.select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(probs)])


def median_cell(df: DataFrame, value: Column | str, prob: float = 0.5, accuracy: int | None = None) -> Column:
    """One global quantile as a scalar sub-query, usable in any expression."""
    return quantiles(df, [], value, {"q": prob}, accuracy).select("q").scalar()
