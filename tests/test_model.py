"""Models at toy settings."""

import pytest
from pyspark.sql import functions as F

from hazardframe.operators import model as L
from hazardframe.plans.training import train_models

LIGHT = {
    "logistic": {"maxIter": 5},
    "forest": {"numTrees": 3, "maxDepth": 3},
    "boosted": {"maxIter": 2, "maxDepth": 2},
    "boosted weighted": {"maxIter": 2, "maxDepth": 2},
}


@pytest.fixture(scope="module")
def rows(spark):
    """Severity follows speed and cause, with some noise."""
    df = spark.range(600).select(
        F.col("id").alias("accident_id"),
        (F.rand(1) * 100).alias("vitesse_estimee"),
        F.element_at(F.array(*map(F.lit, ["Alcool", "Fatigue", "Téléphone"])), (F.col("id") % 3 + 1).cast("int")).alias("cause"),
        F.lit("R1").alias("axe_routier"),
    )
    label = F.when(F.col("vitesse_estimee") > 70, 2).when(F.col("cause") == "Alcool", 1).otherwise(0)
    return df.withColumn("gravite_num", label).persist()


def test_feature_lists(rows):
    assert L.feature_lists(rows) == (["vitesse_estimee"], ["cause"])


def test_guards(spark, rows):
    with pytest.raises(ValueError):
        L.prepare(rows.withColumn("gravite_num", F.lit(3)))
    with pytest.raises(ValueError):
        L.prepare(rows.withColumn("cause", F.when(F.col("accident_id") > 5, F.col("cause"))))


def test_first_category_and_unknown_encode_as_zeros(spark, rows):
    train = L.prepare(rows)
    model, names = L.fit(train, L.logistic(600, maxIter=3))
    assert names == ["vitesse_estimee", "cause_Fatigue", "cause_Téléphone"]
    probe = spark.createDataFrame([(1.0, "Alcool"), (1.0, "Autre"), (1.0, "Fatigue")], "vitesse_estimee double, cause string")
    vectors = [list(r["features"].toArray())[1:] for r in model.transform(probe).collect()]
    assert vectors == [[0.0, 0.0], [0.0, 0.0], [1.0, 0.0]]


def test_training_plan(spark, rows, tmp_path):
    out = train_models(rows, folds=2, settings=LIGHT, out_dir=str(tmp_path / "models"))
    table = out["comparison"].collect()
    assert [r["f1_macro"] for r in table] == sorted((r["f1_macro"] for r in table), reverse=True)
    assert len(table) == 4 and table[0]["f1_macro"] > 0.8
    assert all(0 <= r["auc_ovr"] <= 1 for r in table)
    assert {r["feature"] for r in out["attribution"].collect()} == set(out["best"]["features"])
    for name in ("logistic", "boosted"):
        again = L.load_model(str(tmp_path / "models" / name))
        got = L.predict_severity(again, rows.limit(20)).collect()
        for r in got:
            whole = r["proba_Léger"] + r["proba_Grave"] + r["proba_Mortel"]
            assert whole == pytest.approx(1, abs=0.002)
            assert r["gravite_predite"] == ["Léger", "Grave", "Mortel"][r["classe_num"]]


def test_search_and_importance(spark, rows):
    train = L.prepare(rows)
    space = {"maxIter": (1, 2, 1), "stepSize": (0.05, 0.2, "log"), "maxDepth": (1, 2, 1)}
    found = L.search(train, ["accident_id"], space, trials=2, folds=2)
    assert len(found) == 2 and found[0]["f1_macro"] >= found[1]["f1_macro"]
    model, names = L.fit(train, L.forest(numTrees=3, maxDepth=3))
    top = L.tree_importance(model, names, spark).first()
    assert top["feature"] == "vitesse_estimee"
    curve = L.learning_curve(train, L.forest(numTrees=2, maxDepth=2), ["accident_id"], sizes=(0.5, 1.0), folds=2)
    assert [round(c["size"], 1) for c in curve] == [0.5, 1.0]


def test_a_held_out_label_changes_no_feature(spark):
    from hazardframe.operators import features as X

    rows = [(i, f"R{i % 2}", f"V{i % 3}", f"A{i % 4}", "Mortel" if i % 5 == 0 else "Léger") for i in range(20)]
    rows.append((20, "R9", "V9", "A9", "Mortel"))  # a place that the training rows do not know
    schema = "accident_id int, region string, ville string, axe_routier string, gravite string"
    table = X.place_features(spark.createDataFrame(rows, schema))
    other = table.withColumn("gravite", F.when(F.col("accident_id") >= 15, "Mortel").otherwise(F.col("gravite")))

    def features(df):
        rates = X.refit_places(df.where("accident_id < 15"))
        return {r["accident_id"]: r for r in X.with_places(df, rates).drop("gravite").collect()}

    found = features(table)
    assert found == features(other)
    assert found[20]["taux_mortalite_region"] == found[20]["taux_mortalite_ville"] == pytest.approx(3 / 15)
    assert found[20]["nb_accidents_axe"] == 0 and found[0]["nb_accidents_axe"] == 4
    assert X.refit_places(table.drop("region")) is None


def test_ablation_names_what_counts(spark, rows):
    model, names = L.fit(L.prepare(rows), L.forest(numTrees=5, maxDepth=4))
    got = {r["feature"]: r["contribution"] for r in L.ablation_attribution(model, rows, names).collect()}
    assert set(got) == set(names) and max(got, key=got.get) == "vitesse_estimee"
    assert got == {r["feature"]: pytest.approx(r["contribution"]) for r in L.ablation_attribution(model, rows.repartition(5), names).collect()}


def test_all_stages(spark, sf_dir, tmp_path):
    from hazardframe.plans.everything import run_all
    from hazardframe.sources.tables import load_json
    from hazardframe.sources.testbed import TIE_KEY, incidents

    raw = incidents(spark, sf_dir, tie_key=True)
    out = run_all(raw, TIE_KEY, str(tmp_path), drop=TIE_KEY, folds=0, settings=LIGHT, leak_free=True)
    assert len(out["features"].columns) == 70
    assert (tmp_path / "models/place_rates.parquet").exists()
    assert len(list((tmp_path / "reports").iterdir())) == 11
    report = load_json(spark, str(tmp_path / "final_report"))
    assert report["best_model"] == out["comparison"].first()["model_name"]
    assert load_json(spark, str(tmp_path / "models/metrics"))["best_model"] == report["best_model"]
