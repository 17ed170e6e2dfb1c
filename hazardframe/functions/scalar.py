"""Column expressions shared by the operators. All stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Clip to a range. NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    value = col(c)
    out = value
    if low is not None:
        out = F.when(value < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(value > high, F.lit(high)).otherwise(out)
    return out


# Every character that counts as white space in Unicode.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column | str) -> Column:
    """Drop white space of any kind at both ends."""
    return F.trim(col(c), F.lit(WHITE_SPACE))


def flag(predicate: Column) -> Column:
    """1 where true, 0 where false or unknown."""
    return F.coalesce(predicate, F.lit(False)).cast("int")


def mapped(c: Column | str, table: Mapping[str, object], default: object = None) -> Column:
    """CASE lookup of a small fixed table."""
    branches = [(col(c) == key, F.lit(value)) for key, value in table.items()]
    start = F.when(*branches[0])
    return reduce(lambda acc, b: acc.when(*b), branches[1:], start).otherwise(F.lit(default))


def severity_position(c: Column | str) -> Column:
    """Fatal first, serious second, everything else last: the report order of severities."""
    return F.when(col(c) == "Mortel", 1).when(col(c) == "Grave", 2).otherwise(3)


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open bin ``(edges[i], edges[i+1]]``; NULL outside all bins."""
    value = col(c)
    out = F.when((value > edges[0]) & (value <= edges[1]), F.lit(labels[0]))
    for low, high, label in zip(edges[1:-1], edges[2:], labels[1:]):
        out = out.when((value > low) & (value <= high), F.lit(label))
    return out


def band(c: Column | str, cuts: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Band of a rate between rising cut points, left-closed; the last band is open.

    Values from the last cut on are in a band of their own, named ``30+`` for a last cut of 30;
    ``labels`` has one name for each cut. Values below the first cut are in the first band.
    """
    names = list(labels) if labels else [*(f"{a:g}-{b:g}" for a, b in zip(cuts, cuts[1:])), f"{cuts[-1]:g}+"]
    value = col(c)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for high, name in zip(cuts[1:], names):
        out = out.when(value < high, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


# ---- aggregate expressions -------------------------------------------------


def n_rows() -> Column:
    return F.count(F.lit(1))


def per_100(total: Column, count: Column) -> Column:
    """``100 * total / count``, NULL for an empty denominator."""
    return F.try_divide(total * F.lit(100.0), count)


def share(predicate: Column, digits: int | None = None) -> Column:
    """Percent of rows for which the predicate holds (unknown counts as not)."""
    pct = per_100(F.count_if(predicate), n_rows())
    return pct if digits is None else F.round(pct, digits)


def deaths_per_100(deaths: str, digits: int = 2) -> Column:
    """Deaths per 100 incidents: NOT the share of fatal incidents."""
    return F.round(per_100(F.sum(deaths), n_rows()), digits)


def mean(c: Column | str, digits: int) -> Column:
    return F.round(F.avg(c), digits)


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean over the rows whose value is known."""
    return F.try_divide(
        F.sum(F.col(value) * F.col(weight)),
        F.sum(F.when(F.col(value).isNotNull(), F.col(weight))),
    )


# Row hashes are whole numbers below this.
HASH_SIZE = 2**52


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """A uniform hash of the seed and the keys' texts that any SQL engine with md5 can repeat."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
