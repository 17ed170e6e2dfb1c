"""Equi-joins that add columns by key."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.functions.scalar import all_of
from hazardframe.session import shared_dir

# A lookup table is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 100_000
# Bytes of input files that one slice of `store_sliced` is to read.
SLICE_BYTES = 768_000_000


def attach(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    how: str = "left",
    null_keys: bool = True,
    right_keys: Sequence[str] | None = None,
    small: bool = False,
) -> DataFrame:
    """Add ``columns`` of ``right`` by key; the key columns of the result are the left ones.

    ``right_keys`` names the keys on the right if they differ. With ``null_keys=False``
    a NULL key matches nothing. ``small`` asks for a broadcast: only for a checked size.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    picked = right.select(*[F.col(k).alias(n) for k, n in zip(right_keys or keys, names)], *columns)
    tests = [
        F.col(k).eqNullSafe(F.col(n)) if null_keys else F.col(k) == F.col(n)
        for k, n in zip(keys, names)
    ]
    return left.join(F.broadcast(picked) if small else picked, all_of(tests), how).drop(*names)


def materialise(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared checkpoint folder, cutting the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the commands run inside go when a command ends, not when the driver
    happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a large table once, as Parquet in the shared folder, and read it back.

    Later jobs scan only the columns they need, and nothing before it is computed again.
    """
    return _stored([df], name)


def store_sliced(df: DataFrame, name: str, key: str, slices: int) -> DataFrame:
    """As ``store``, written in slices by a hash of ``key``, so that no more than a slice's shuffle
    files are on disk at a time. Each slice reads the input again."""
    if slices <= 1:
        return store(df, name)
    at = F.pmod(F.xxhash64(key), F.lit(slices))
    return _stored([df.where(at == i) for i in range(slices)], name)


def count_sliced(df: DataFrame, key: str) -> int:
    """The number of rows, counted slice by slice as ``store_sliced`` writes them."""
    slices = slices_of(df)
    at = F.pmod(F.xxhash64(key), F.lit(slices))
    with shuffles_dropped(df.sparkSession):
        return sum((df.where(at == i) if slices > 1 else df).count() for i in range(slices))


def _stored(parts: Sequence[DataFrame], name: str) -> DataFrame:
    spark = parts[0].sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        for part in parts:
            part.write.mode("append").parquet(path)
    stored = spark.read.schema(parts[0].schema).parquet(path)
    stored._stored_at = path
    return stored


def slices_of(df: DataFrame) -> int:
    """Into how many slices a table is cut so that each reads about SLICE_BYTES of its input files."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaf for leaf in map(leaves.apply, range(leaves.size())) if leaf.getClass().getSimpleName() == "LogicalRelation"]
    read = sum(int(str(leaf.relation().sizeInBytes())) for leaf in files)
    return max(1, math.ceil(read / SLICE_BYTES))


def forget(stored: DataFrame) -> None:
    """Delete the files of a table written by ``store`` that nothing reads any more."""
    if path := getattr(stored, "_stored_at", None):
        forget_path(stored.sparkSession, path)


def forget_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    right_keys: Sequence[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Left join of rows with a materialised per-group table, whose size is counted first, or
    given as ``rows`` by a caller who has counted it.

    A small table is broadcast, so the rows are not shuffled and a hot key does no
    harm. A large one is joined by shuffle, where adaptive execution splits hot keys.
    NULL keys match nothing.
    """
    small = (table.count() if rows is None else rows) <= BROADCAST_ROWS
    return attach(df, table, keys, columns, null_keys=False, right_keys=right_keys, small=small)
