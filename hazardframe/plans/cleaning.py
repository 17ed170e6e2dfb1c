"""The whole cleaning, from the raw table to the clean one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from hazardframe.functions.joins import forget, slices_of, store_sliced
from hazardframe.operators.clean import (
    cap_cost,
    drop_incoherent,
    encode_severity,
    keep_first,
    narrow_types,
    repair_rows,
)
from hazardframe.operators.impute import fill_all
from hazardframe.roles import INCIDENT, Roles
from hazardframe.sources.tables import save_table


def clean_incidents(
    raw: DataFrame,
    tie: Sequence[Column | str],
    r: Roles = INCIDENT,
    drop: Sequence[str] = (),
    accuracy: int | None = None,
) -> DataFrame:
    """Row repairs, imputation, dedup, consistency, cost cap and severity rank, in that order.

    Imputation comes before dedup, so its statistics see every copy; the cost cap
    is taken after dedup and after the incoherent rows are gone. ``tie`` orders the
    copies of one id; columns named in ``drop`` served only for that. The repaired rows are
    stored, so that what yields them runs once, and so are the coherent ones before the cap;
    both in slices of ids if the input is large, as their shuffles would fill the disk.
    The result names the store that it reads, for ``forget``.
    With ``accuracy`` the medians and the cap are one-pass sketches.
    """
    slices = slices_of(raw)
    repaired = store_sliced(repair_rows(raw, r), "repaired", r.id, slices)
    filled = fill_all(repaired, r, accuracy)
    unique = keep_first(filled, tie, r).drop(*drop)
    # Filled rows are wide, so that dedup takes twice as many slices; they read one store, not joins.
    coherent = store_sliced(drop_incoherent(unique, r), "coherent", r.id, 2 * slices if slices > 1 else 1)
    forget(repaired)
    clean = encode_severity(cap_cost(coherent, r, accuracy=accuracy), r)
    clean._stored_at = coherent._stored_at
    return clean


def run_cleaning(
    raw: DataFrame, tie: Sequence[Column | str], path: str | None = None, r: Roles = INCIDENT, **options
) -> DataFrame:
    """Clean, narrow the types and, given a path, write the table and read it back.

    Reading back cuts the lineage: later jobs scan the clean table and nothing before it.
    """
    whole = clean_incidents(raw, tie, r, **options)
    clean = narrow_types(whole, r)
    if path is None:
        return clean
    save_table(clean, path)
    forget(whole)
    return raw.sparkSession.read.parquet(path)
