"""What the operators share: tables in the shared folder, distributed components, whole texts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.session import shared_dir


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    root = shared_dir(spark)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns; further columns of any name stay out of the way."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def ship(spark: SparkSession) -> None:
    """Give executors this package's code once per application, as --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_hazardframe_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="hazardframe-code-"), "hazardframe.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(Path(package.name, file.relative_to(package))))
    sc.addPyFile(name)
    sc._hazardframe_shipped = True


#: What one operator remembers in this worker from task to task.
_held: dict[tuple[type, str], object] = {}


def hold(make: type, path: str):
    """`make(path)`, made once and kept by this worker until another operator runs in it."""
    if (make, path) not in _held:
        let_go()
        _held[make, path] = make(path)
    return _held[make, path]


def let_go() -> None:
    """Free what earlier operators remember, so that a worker's memory is that of one of them."""
    if _held:
        _held.clear()
        gc.collect()  # words and their maker refer to each other
    pa.default_memory_pool().release_unused()


def arrow_map(
    df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, holding: bool = False
) -> DataFrame:
    """mapInArrow with this package at hand on the executors; `holding` says that `f` calls `hold`."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holding:
            let_go()
        yield from f(batches)

    return df.mapInArrow(run, schema)


def slices(values: list, most_chars: int = 16_000_000) -> Iterator[list]:
    """Runs of whole texts of about `most_chars` characters together, one text at least."""
    run: list = []
    size = 0
    for value in values:
        if run and size + len(value) > most_chars:
            yield run
            run, size = [], 0
        run.append(value)
        size += len(value)
    if run:
        yield run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the undirected `edges` (a, b): one row (node, component) per node.

    Alternating star contraction: every round hangs the larger neighbours of a node, then the
    smaller ones and itself, on the smallest value in sight, until each node hangs on the least
    node of its component. A round is one map-side combined minimum and one join by node, written
    to the shared folder; no group of neighbours is ever gathered. Edges with a null or equal ends
    are ignored; an empty table gives an empty result.
    """
    pairs = edges.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).filter("a is not null and b is not null and a <> b")
    pairs = keep(pairs.distinct(), name)
    seen = _digest(pairs)
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are written first: a join of two plain shuffles lets AQE split a hot node.
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = keep(large.distinct(), name)
        least = keep(stars.groupBy("u").agg(F.min("v").alias("m")), name)
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m")), F.struct("u", "m"))
        small = stars.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", F.col("e.m").alias("v"))
        pairs = keep(small.filter("u <> v").distinct(), name)
        now = _digest(pairs)
        if now == seen:
            roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return pairs.toDF("node", "component").unionAll(roots)
        seen = now


def _digest(pairs: DataFrame) -> tuple:
    """Row count and order-free hash sum: equal after a round that changed nothing."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(hashed)).first())
