"""Logistic models over coded blocks against Spark's own and against themselves."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from hazardframe.operators import linear
from hazardframe.operators import metrics as M
from hazardframe.operators import model as L
from hazardframe.operators import trees


@pytest.fixture(scope="module")
def rows(spark):
    """Severity follows speed and cause, a tenth of the labels by chance."""
    df = spark.range(1200).select(
        F.col("id").alias("accident_id"),
        (F.col("id") * 7919 % 101).cast("double").alias("vitesse_estimee"),
        (F.col("id") * 104729 % 13).cast("int").alias("heure"),
        F.element_at(F.array(*map(F.lit, ["Alcool", "Fatigue", "Téléphone"])), (F.col("id") % 3 + 1).cast("int")).alias("cause"),
    )
    label = F.when(F.col("vitesse_estimee") > 70, 2).when(F.col("cause") == "Alcool", 1).otherwise(0)
    df = df.withColumn("gravite_num", F.when(F.col("accident_id") % 10 == 3, F.col("accident_id") % 3).otherwise(label).cast("int"))
    return L.prepare(df).persist()


def spark_own(n):
    return LogisticRegression(family="multinomial", labelCol=L.LABEL, weightCol="weight", maxIter=5000, regParam=1.0 / n,
                              standardization=False, tol=1e-12)


@pytest.mark.parametrize("many", [10**9, 2])
def test_the_optimum_of_sparks_own(spark, rows, many, monkeypatch):
    monkeypatch.setattr(linear, "MANY_BLOCKS", many)
    monkeypatch.setattr(linear, "SHARE", 2)
    assert isinstance(L.logistic(1200), linear.Logistic)
    spread = rows.repartition(8)
    got, names = L.fit(spread, L.logistic(1200))
    want, _ = L.fit(spread, spark_own(1200))
    assert np.allclose(got.stages[-1].coefficientMatrix.toArray(), want.stages[-1].coefficientMatrix.toArray(), atol=1e-3)
    assert np.allclose(got.stages[-1].interceptVector.toArray(), want.stages[-1].interceptVector.toArray(), atol=1e-3)
    assert names == ["vitesse_estimee", "heure", "cause_Fatigue", "cause_Téléphone"]


def test_features_without_functions_on_vectors(spark, rows):
    model, _ = L.fit(rows, L.logistic(1200))
    odd = rows.withColumn("cause", F.when(F.col("accident_id") > 5, F.col("cause")).otherwise("Autre"))
    got = odd.select(L.features_of(model.stages[:-1]).alias("x"), "*")
    for row in model.transform(got).limit(300).collect():
        assert np.allclose(row["x"], row["features"].toArray(), atol=1e-12)


def test_folds_side_by_side_are_folds_apart(spark, rows):
    n = rows.count()
    together = L.cross_validate(rows, L.logistic(n), ["accident_id"], 3)
    apart = L.cross_validate(rows, spark_own(n), ["accident_id"], 3)
    assert [set(t) for t in together] == [set(a) for a in apart]
    for t, a in zip(together, apart):
        assert all(t[k] == pytest.approx(a[k], abs=0.01) for k in t)
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label int, prediction int")
    counts = np.array([[1, 1, 0], [0, 1, 0], [1, 0, 0]])
    assert M.scores_of_counts(counts) == M.macro_scores(pairs).first().asDict()


def test_a_class_that_is_not_there(spark, rows):
    two = rows.where("gravite_num != 1")
    model, _ = L.fit(two, L.logistic(two.count()))
    assert {r["prediction"] for r in L.score(model, two).select("prediction").collect()} == {0, 2}
    one = rows.where("gravite_num = 1")
    model, _ = L.fit(one, L.logistic(one.count()))
    assert {r["prediction"] for r in L.score(model, one).select("prediction").collect()} == {1}


def test_attribution_by_hand(spark, rows):
    model, names = L.fit(rows, L.logistic(1200))
    x = np.array([r["features"].toArray() for r in model.transform(rows).select("features").collect()])
    weights = model.stages[-1].coefficientMatrix.toArray()
    want = np.abs(weights).mean(axis=0) * np.abs(x - x.mean(axis=0)).mean(axis=0)
    got = {r["feature"]: r["contribution"] for r in L.linear_attribution(model, rows.repartition(5), names).collect()}
    assert got == {n: pytest.approx(v) for n, v in zip(names, want)}


def test_long_and_short_paths_have_the_same_values(monkeypatch):
    """Patterns that are kept and those that are met give the same Shapley values."""
    rng = np.random.default_rng(3)
    d, n = 6, 200
    paths = [(list(range(d)), np.where(rng.random(d) < 0.5, -np.inf, 0.2), np.where(rng.random(d) < 0.5, np.inf, 0.8), rng.random(d), rng.random(3))
             for _ in range(5)]
    x = rng.random((n, 8))
    kept: dict = {}
    first, again = trees.shapley(paths, x, 3, kept), trees.shapley(paths, x, 3, kept)
    assert len(kept) == 5 and (first == again).all()
    monkeypatch.setattr(trees, "KEPT_FEATURES", 0)
    assert np.allclose(first, trees.shapley(paths, x, 3))
    prediction = sum(np.array([((r[:d] > low) & (r[:d] <= high)).all() for r in x])[:, None] * v for _, low, high, _, v in paths)
    assert np.allclose(first.sum(axis=1) + trees.expected(paths), prediction)


def test_labelled_rows_are_found_once(spark, rows, monkeypatch):
    stored = {}
    keep = L.store
    monkeypatch.setattr(L, "store", lambda df, name: stored.setdefault(name, keep(df, name)))
    space = {"maxIter": (1, 2, 1), "maxDepth": (1, 2, 1)}
    assert len(L.search(rows, ["accident_id"], space, trials=1, folds=2, labelled_rows=300)) == 1
    whole = L.sample_rows(rows, 300, "accident_id")
    assert stored["sample"].count() == 300 and stored["sample"].exceptAll(whole).count() == 0
