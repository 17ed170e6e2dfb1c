"""Exact stratified splits without ordering a whole class in one task.

Rows get a uniform hash of their key. The cut between the parts is a hash value found
as an order statistic of each class; assigning a row is then one comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.joins import lookup, materialise, store
from hazardframe.functions.ordered import order_statistics, value_counts
from hazardframe.functions.scalar import HASH_SIZE, flag, n_rows, row_hash
from hazardframe.roles import INCIDENT

_HASH_BUCKETS = 1024


def _cuts(
    df: DataFrame, label: str, keys: Sequence[str], seed: int, ranks: Mapping[str, Callable[[Column], Column]]
) -> DataFrame:
    """Per class, the hash values at the given ranks of the class's rows.

    Rows are first counted by ranges of the hash; only the values of ranges that hold a wanted rank
    are shuffled, the others are one value each, as no rank falls among them.
    """
    width = HASH_SIZE // _HASH_BUCKETS
    bucket = F.floor(F.col("value") / F.lit(width))
    rows = df.select(label, row_hash(keys, seed).alias("value"))
    totals = store(rows.groupBy(label, bucket.alias("value")).agg(n_rows().alias("n")), "ranges")
    hit = order_statistics(totals, [label], ranks, bucket=F.lit(0)).select(label, F.array(*ranks).alias("_hit"))
    hit = materialise(hit)
    hits = lambda number: F.coalesce(F.array_contains("_hit", number), F.lit(False))
    inside = lookup(rows, hit, [label], ["_hit"]).where(hits(bucket))
    others = lookup(totals, hit, [label], ["_hit"]).where(~hits(F.col("value")))
    others = others.select(label, (F.col("value") * F.lit(width)).alias("value"), "n")
    counts = value_counts(inside.drop("_hit"), [label], "value").unionByName(others)
    return materialise(order_statistics(counts, [label], ranks, bucket=bucket).select(label, *ranks))


def stratified_split(
    df: DataFrame, label: str, keys: Sequence[str], fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``part``: "test" for the given fraction of every class, "train" for the rest."""
    last = {"_cut": lambda n: F.round(n * fraction).cast("long") - 1}
    rows = lookup(df, _cuts(df, label, keys, seed, last), [label], ["_cut"])
    inside = F.coalesce(row_hash(keys, seed) <= F.col("_cut"), F.lit(False))
    return rows.withColumn("part", F.when(inside, "test").otherwise("train")).drop("_cut")


def stratified_folds(
    df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1, every class spread evenly over the folds."""
    names = [f"_cut{j}" for j in range(1, k)]
    ranks = {
        name: (lambda n, j=j: F.floor(n * j / k).cast("long") - 1) for j, name in enumerate(names, start=1)
    }
    rows = lookup(df, _cuts(df, label, keys, seed, ranks), [label], names)
    here = row_hash(keys, seed)
    fold = sum((flag(here > F.col(name)) for name in names), F.lit(0))
    return rows.withColumn("fold", fold).drop(*names)


def class_weights(df: DataFrame, label: str = INCIDENT.severity_rank) -> DataFrame:
    """Balanced weight of every class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(n_rows().alias("n"))
    whole = counts.agg(F.sum("n").alias("rows"), n_rows().alias("classes")).select(F.struct("*")).scalar()
    weight = whole.getField("rows") / (whole.getField("classes") * F.col("n"))
    return counts.select(label, "n", weight.alias("weight"))


def add_class_weight(df: DataFrame, label: str = INCIDENT.severity_rank) -> DataFrame:
    return lookup(df, materialise(class_weights(df, label)), [label], ["weight"])
