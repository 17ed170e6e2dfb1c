"""Split, weights and models.

The models learn a planted severity, a rule over two columns of the feature table, so that what
they must predict for every test row is known and SQL can say it.
"""

import uuid

from pyspark.sql import functions as F

from catalog.relations import clean, repaired
from hazardframe.functions.joins import forget, store
from hazardframe.functions.scalar import mapped, n_rows
from hazardframe.operators import features as X
from hazardframe.operators import model as L
from hazardframe.operators.clean import repair_rows
from hazardframe.operators.impute import fill_constant, fill_floor
from hazardframe.operators.split import class_weights, stratified_folds, stratified_split
from hazardframe.plans.training import save_bundle, score_rows, train_models
from hazardframe.roles import SEVERITY_ORDER
from hazardframe.session import shared_dir
from hazardframe.sources.testbed import TIE_KEY, incidents

COLUMNS = [
    "accident_id", "heure", "limitation_vitesse", "nombre_vehicules", "nombre_victimes",
    "vitesse_estimee", "cause", "periode_journaliere", "type_accident", "port_casque",
    "accident_fete", "gravite",
]


def labelled(spark, sf_dir):
    """Incidents with a label, the natural key and no missing values."""
    df = repair_rows(incidents(spark, sf_dir, COLUMNS, tie_key=True))
    df = fill_constant(df, {"cause": "Inconnue", "vitesse_estimee": 0.0})
    return fill_floor(df, "nombre_victimes").withColumn("gravite_num", mapped("gravite", SEVERITY_ORDER))


def trainable(spark, sf_dir):
    """The feature table of the clean incidents, with the planted severity."""
    cause = F.when(F.col("cause") == "Alcool", "Grave").otherwise("Léger")
    planted = F.when(F.col("limitation_vitesse") >= 90, "Mortel").otherwise(cause)
    rows = clean(spark, sf_dir)
    df = rows.withColumn("gravite", planted)
    df = df.withColumn("gravite_num", mapped("gravite", SEVERITY_ORDER))
    features = store(X.build_features(df, leak_free=True), "planted")
    forget(rows)
    return features


KEY = ["accident_id"]
#: Labelled rows that the search and the learning curve use at most, those of least row hash.
LABELLED_ROWS = 3000


def split_counts(spark, sf_dir):
    parts = stratified_split(labelled(spark, sf_dir), "gravite_num", TIE_KEY)
    return parts.groupBy("gravite_num", "part").agg(n_rows().alias("n"))


def fold_counts(spark, sf_dir):
    folded = stratified_folds(labelled(spark, sf_dir), "gravite_num", TIE_KEY)
    return folded.groupBy("gravite_num", "fold").agg(n_rows().alias("n"))


def _members(assign, out):
    """A query: the part or fold of every row, by the row hash of its id."""

    def run(spark, sf_dir):
        df = repaired(spark, sf_dir, "accident_id gravite")
        df = df.withColumn("gravite_num", mapped("gravite", SEVERITY_ORDER))
        return assign(df, "gravite_num", KEY).select("accident_id", "gravite_num", out)

    return run


def _weights(spark, sf_dir):
    df = repaired(spark, sf_dir, "gravite").withColumn("gravite_num", mapped("gravite", SEVERITY_ORDER))
    return class_weights(df).withColumn("weight", F.round("weight", 9))


def feature_columns(spark, sf_dir):
    """Which columns a model would use, with their completeness, from the data itself."""
    df = labelled(spark, sf_dir)
    numeric, texts = L.feature_lists(df.drop(*TIE_KEY))
    kinds = {**{c: "numeric" for c in numeric}, **{c: "category" for c in texts}}
    one_row = df.agg(*[F.count(c).alias(c) for c in kinds])
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("feature"))
    return one_row.unpivot([], list(kinds), "feature", "known").select("feature", kind.alias("kind"), "known")


def _train(spark, sf_dir):
    return L.prepare(trainable(spark, sf_dir), leak_free=True)


def parted(spark, sf_dir):
    """Training and test rows, their place features fitted on the training rows."""
    parts = stratified_split(trainable(spark, sf_dir), L.LABEL, KEY)
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    rates = X.refit_places(train)
    return X.with_places(train, rates), X.with_places(test, rates)


def place_rates_of_train(spark, sf_dir):
    """Place features of all rows, fitted on the training rows alone."""
    parts = stratified_split(clean(spark, sf_dir), L.LABEL, KEY)
    rates = store(X.place_rates(parts.where("part = 'train'")), "rates")
    df = X.place_features(parts, rates)
    rounded = {c: F.round(c, 9) for c in X.PLACE_FEATURES if c != "nb_accidents_axe"}
    return df.withColumns(rounded).select("accident_id", "part", *X.PLACE_FEATURES)


def _scored(build):
    """A query: fit on the training part, predict the whole test part."""

    def run(spark, sf_dir):
        train, test = parted(spark, sf_dir)
        train = L.prepare(train, leak_free=True)
        model, _ = L.fit(train, build(train), leak_free=True)
        return L.predict_severity(model, test).select("accident_id", "gravite_predite", "classe_num")

    return run


def forest_importance(spark, sf_dir):
    model, names = L.fit(_train(spark, sf_dir), L.forest(), leak_free=True)
    return L.tree_importance(model, names, spark)


def logistic_attribution(spark, sf_dir):
    train = _train(spark, sf_dir)
    model, names = L.fit(train, L.logistic(train.count()), leak_free=True)
    return L.linear_attribution(model, train, names)


def cross_validation(spark, sf_dir):
    train = _train(spark, sf_dir)
    rows = L.cross_validate(train, L.logistic(train.count()), KEY, leak_free=True)
    return spark.createDataFrame(rows, "fold int, f1_macro double, balanced_acc double, accuracy double")


def model_comparison(spark, sf_dir):
    """Test and cross-validation scores of the four models, fitted on all training rows, to three digits."""
    table = train_models(trainable(spark, sf_dir), leak_free=True)["comparison"]
    return table.select("model_name", *[F.round(c, 3).alias(c) for c in table.columns if c != "model_name"])


def search_results(spark, sf_dir):
    """Per rung of the search: the settings that came so far, their rounds, and the best score they reached."""
    rows = L.search(_train(spark, sf_dir), KEY, L.SEARCH_SPACES["level_wise"], leak_free=True, labelled_rows=LABELLED_ROWS)
    rungs = []
    for rung in range(max(row["rung"] for row in rows) + 1):
        far = [row for row in rows if row["rung"] >= rung]
        rungs.append((rung, len(far), L.FIRST_RUNG * 2**rung, round(max(row["f1_macro"] for row in far), 3)))
    return spark.createDataFrame(rungs, "rung int, settings int, rounds int, best_f1 double")


def learning_curve(spark, sf_dir):
    """Training rows, scores to two digits and the verdict at eight sizes."""
    rows = L.learning_curve(_train(spark, sf_dir), L.forest(), KEY, leak_free=True, labelled_rows=LABELLED_ROWS)
    table = [(round(r["size"], 6), r["rows"], round(r["train_mean"], 2), round(r["val_mean"], 2), r["overfitting"]) for r in rows]
    return spark.createDataFrame(table, "size double, rows long, train_f1 double, val_f1 double, overfitting boolean")


def forest_values(spark, sf_dir):
    """Each test row's class as its Shapley values tell it: the largest sum of base and values."""
    train, test = parted(spark, sf_dir)
    model, _ = L.fit(L.prepare(train, leak_free=True), L.forest(), leak_free=True)
    values = L.tree_values(model, test, KEY)
    total = F.col("base") + F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return values.groupBy("accident_id").agg(F.max_by("class", F.struct(F.round(total, 9), -F.col("class"))).alias("classe_num"))


def boosted_values(spark, sf_dir):
    """As `forest_values`, from margins of boosted trees."""
    train, test = parted(spark, sf_dir)
    model, _ = L.fit(L.prepare(train, leak_free=True), L.boosted(), leak_free=True)
    values = L.tree_values(model, test, KEY)
    total = F.col("base") + F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return values.groupBy("accident_id").agg(F.max_by("class", F.struct(F.round(total, 9), -F.col("class"))).alias("classe_num"))


def stored_model_scores(spark, sf_dir):
    """Test rows, half of them moved to a place no training row knows, scored by a model read back
    from its stored bundle."""
    parts = stratified_split(trainable(spark, sf_dir), L.LABEL, KEY)
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    rates = X.refit_places(train)
    train = L.prepare(X.with_places(train, rates), leak_free=True)
    model, _ = L.fit(train, L.logistic(train.count()), leak_free=True)
    path = f"{shared_dir(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}"
    save_bundle(spark, path, {"logistic": model}, rates, {"best_model": "logistic"})
    away = {c: F.when(F.col("accident_id") % 2 == 0, "elsewhere").otherwise(F.col(c)) for c in ("region", "ville", "axe_routier")}
    scored = score_rows(test.withColumns(away).drop(L.LABEL, "gravite"), path)
    return scored.select("accident_id", "gravite_predite", "classe_num")


QUERIES = {
    "split_counts": split_counts,
    "fold_counts": fold_counts,
    "split_members": _members(stratified_split, "part"),
    "fold_members": _members(stratified_folds, "fold"),
    "class_weights": _weights,
    "feature_columns": feature_columns,
    "place_rates_of_train": place_rates_of_train,
    "logistic_scores": _scored(lambda train: L.logistic(train.count())),
    "forest_scores": _scored(lambda train: L.forest()),
    "boosted_scores": _scored(lambda train: L.boosted()),
    "forest_importance": forest_importance,
    "logistic_attribution": logistic_attribution,
    "cross_validation": cross_validation,
    "model_comparison": model_comparison,
    "search_results": search_results,
    "learning_curve": learning_curve,
    "forest_values": forest_values,
    "boosted_values": boosted_values,
    "stored_model_scores": stored_model_scores,
}
