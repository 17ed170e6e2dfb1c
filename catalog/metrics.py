"""Evaluation metrics on a deterministic scored table, and the expert rule."""

from pyspark.sql import functions as F

from catalog.relations import on_repaired, raw
from hazardframe.functions.scalar import mapped
from hazardframe.operators import metrics as M
from hazardframe.operators.rules import rule_severity
from hazardframe.roles import SEVERITY_ORDER


def scored(spark, sf_dir):
    """Every incident with scores made from its keys; many scores are equal, as in real life."""
    rows = raw(spark, sf_dir, "gravite", tie_key=True)
    a0, a1, a2 = 1 + F.col("l_partkey") % 7, 1 + F.col("l_suppkey") % 5, 1 + F.col("l_orderkey") % 3
    whole = (a0 + a1 + a2).cast("double")
    first = F.when((a0 >= a1) & (a0 >= a2), 0).when(a1 >= a2, 1).otherwise(2)
    return rows.select(
        mapped("gravite", SEVERITY_ORDER).alias("label"),
        first.alias("prediction"),
        *[(a / whole).alias(f"p{i}") for i, a in enumerate((a0, a1, a2))],
    )


def _on_scored(operator):
    return lambda spark, sf_dir: operator(scored(spark, sf_dir))


QUERIES = {
    "confusion_matrix": _on_scored(M.confusion_matrix),
    "classification_report": _on_scored(M.classification_report),
    "macro_scores": _on_scored(M.macro_scores),
    "class_auc": _on_scored(lambda df: M.class_auc(df).withColumn("auc", F.round("auc", 9))),
    "macro_auc": _on_scored(M.macro_auc),
    "roc_points": _on_scored(M.roc_points),
    "roc_curve": _on_scored(M.roc_curve),
    "rule_severity": on_repaired(
        lambda df: rule_severity(df).select(
            "accident_id", "score", F.concat_ws(",", "factors").alias("factors"), "predicted", "p0", "p1", "p2"
        ),
        "accident_id heure vitesse_estimee limitation_vitesse type_route meteo cause port_casque luminosite",
    ),
}
