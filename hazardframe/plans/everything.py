"""All stages in a row: clean, features, reports, models, final report."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from hazardframe.operators.reports import full_report
from hazardframe.plans.cleaning import run_cleaning
from hazardframe.plans.features import run_features
from hazardframe.plans.training import train_models
from hazardframe.roles import INCIDENT, Roles
from hazardframe.sources.tables import export_reports, save_json


def run_all(
    raw: DataFrame,
    tie: Sequence[Column | str],
    out_dir: str,
    train: bool = True,
    r: Roles = INCIDENT,
    drop: Sequence[str] = (),
    **training: Any,
) -> dict[str, Any]:
    """Write every table and report under ``out_dir``. The stages meet in Parquet tables only.

    Further options go to ``train_models``; the models are saved too. The result names the
    tables and, with training, the best model and the comparison.
    """
    clean = run_cleaning(raw, tie, f"{out_dir}/clean.parquet", r, drop=drop)
    leak_free = bool(training.get("leak_free", False))
    features = run_features(clean, f"{out_dir}/features.parquet", leak_free, r)
    export_reports(full_report(clean, r), f"{out_dir}/reports")
    out: dict[str, Any] = {"clean": clean, "features": features}
    if train:
        out |= train_models(features, keys=(r.id,), out_dir=f"{out_dir}/models", **training)
        table = [row.asDict() for row in out["comparison"].collect()]  # a row per model
        report = {"best_model": out["best"]["model_name"], "f1_macro": out["best"]["f1_macro"], "comparison": table}
        save_json(raw.sparkSession, report, f"{out_dir}/final_report")
    return out
