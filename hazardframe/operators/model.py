"""Severity models on pyspark.ml: preparation, estimators, evaluation, search, attribution."""

from __future__ import annotations

import json
import math
import random
import uuid
from collections.abc import Iterable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    StandardScalerModel,
    StringIndexerModel,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardframe.functions.joins import forget, forget_path, store
from hazardframe.functions.scalar import HASH_SIZE, row_hash
from hazardframe.functions.workers import ship
from hazardframe.operators import boost, linear, trees
from hazardframe.operators import metrics as M
from hazardframe.operators.features import PLACE_FEATURES, refit_places, subset_places, with_places
from hazardframe.operators.quality import numeric_columns
from hazardframe.operators.split import add_class_weight, stratified_folds
from hazardframe.roles import INCIDENT, SEVERITIES, Roles
from hazardframe.session import shared_dir
from hazardframe.sources.tables import sample_rows

LABEL = INCIDENT.severity_rank

# --------------------------------------------------------------------------
# Published model settings and search ranges.
# --------------------------------------------------------------------------

SEED = 42
FOREST = {"numTrees": 300, "maxDepth": 30, "minInstancesPerNode": 5}
BOOSTED = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
# Trees of 63 leaves are grown level by level here, and six levels are as many as these leaves need.
BOOSTED_WEIGHTED = {
    "maxIter": 500, "stepSize": 0.05, "maxDepth": 6, "maxLeaves": 63, "minInstancesPerNode": 20, "regLambda": 0.0,
    "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
}
# name: (low, high, step); step "log" draws log-uniformly, None uniformly, a number on a grid
SEARCH_SPACES = {
    "level_wise": {
        "maxIter": (200, 1000, 100),
        "stepSize": (0.01, 0.2, "log"),
        "maxDepth": (3, 10, 1),
        "minChildWeight": (1, 20, 1),
        "subsamplingRate": (0.5, 1.0, None),
        "featureSubsetStrategy": (0.5, 1.0, None),
        "minInfoGain": (0.0, 5.0, None),
        "regAlpha": (1e-8, 10.0, "log"),
        "regLambda": (1e-8, 10.0, "log"),
    },
    "weighted": {
        "maxIter": (200, 1000, 100),
        "stepSize": (0.01, 0.2, "log"),
        "maxLeaves": (20, 150, 1),
        "maxDepth": (3, 12, 1),
        "minInstancesPerNode": (10, 100, 1),
        "subsamplingRate": (0.5, 1.0, None),
        "featureSubsetStrategy": (0.5, 1.0, None),
        "regAlpha": (1e-8, 10.0, "log"),
        "regLambda": (1e-8, 10.0, "log"),
    },
}

# --------------------------------------------------------------------------


def feature_lists(df: DataFrame, leak_free: bool = False, r: Roles = INCIDENT) -> tuple[list[str], list[str]]:
    """Numeric and text feature columns: no ids, dates, targets or columns that follow from the target."""
    out = {r.id, r.date, r.severity, r.severity_rank, r.deaths, r.cost, "part", "fold", "weight"}
    if leak_free:
        out.add("urgence_intervention")
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return numeric_columns(df, skip=out), [c for c in texts if c not in {*out, r.road, r.town}]


def check_ready(df: DataFrame, features: Sequence[str], label: str = LABEL) -> None:
    """Raise if a label is outside 0..2 or a feature has missing values; one aggregation."""
    tests = {label: ~F.coalesce(F.col(label).between(0, 2), F.lit(False))}
    tests |= {c: F.col(c).isNull() for c in features}
    bad = df.agg(*[F.count_if(t).alias(c) for c, t in tests.items()]).first().asDict()
    wrong = {c: n for c, n in bad.items() if n}
    if wrong:
        raise ValueError(f"rows with a bad label or missing feature: {wrong}")


def category_labels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of category columns, as many as there are; the driver holds them,
    as it holds the encoder and the names of its features."""
    labels: dict[str, list[str]] = {c: [] for c in columns}
    if columns:
        pairs = df.select(*columns).unpivot([], list(columns), "column", "value").distinct()
        for row in pairs.where(F.col("value").isNotNull()).collect():
            labels[row["column"]].append(row["value"])
    return {c: sorted(values) for c, values in labels.items()}


def preprocessor(numeric: Sequence[str], labels: Mapping[str, Sequence[str]]) -> tuple[list, list[str]]:
    """Pipeline stages giving ``features``, and the feature names in order.

    Numbers are standardised. Categories are one-hot without the first; an unknown one
    encodes as zeros. The scaler divides by the sample deviation, which differs from the
    population one by a factor of sqrt((n - 1) / n).
    """
    stages: list = []
    parts, names = ["_scaled"], list(numeric)
    coded = [c for c, values in labels.items() if len(values) > 1]
    if coded:
        stages += [
            StringIndexerModel.from_labels(
                list(labels[c]), inputCol=c, outputCol=f"_i_{c}", handleInvalid="keep"
            )
            for c in coded
        ]
        # "keep" adds one last slot for the unknown, which dropLast leaves out again.
        stages.append(
            OneHotEncoder(
                inputCols=[f"_i_{c}" for c in coded], outputCols=[f"_h_{c}" for c in coded], dropLast=True
            )
        )
        for c in coded:
            rest = list(range(1, len(labels[c])))
            stages.append(VectorSlicer(inputCol=f"_h_{c}", outputCol=f"_s_{c}", indices=rest))
            parts.append(f"_s_{c}")
            names += [f"{c}_{labels[c][i]}" for i in rest]
    stages += [
        VectorAssembler(inputCols=list(numeric), outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        VectorAssembler(inputCols=parts, outputCol="features"),
    ]
    return stages, names


def logistic(rows: int, **overrides: Any) -> linear.Logistic:
    """Multinomial logistic regression with balanced weights and a unit L2 penalty on the sum."""
    return linear.Logistic(LABEL, **{"maxIter": 1000, "regParam": 1.0 / rows, **overrides})


def forest(**overrides: Any) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=LABEL, weightCol="weight", seed=SEED, **{**FOREST, **overrides})


class SoftmaxModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees over the vector ``features``: adds ``probability`` and ``prediction``."""

    rounds = Param(Params._dummy(), "rounds", "JSON of a list of rounds, each a tree per class")

    def __init__(self, rounds: list | None = None):
        super().__init__()
        if rounds is not None:
            self._set(rounds=json.dumps(rounds, separators=(",", ":")))

    def grown(self) -> list[list[trees.Tree]]:
        return json.loads(self.getOrDefault("rounds"))

    def featureImportances(self, size: int) -> DenseVector:
        """Share of each feature in the gains of all splits."""
        total = np.zeros(size)
        for tree in (t for one in self.grown() for t in one):
            for f, gain in zip(tree["feature"], tree["gain"]):
                if f >= 0:
                    total[f] += gain
        return DenseVector(total / total.sum() if total.any() else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        rounds = self.grown()

        @F.pandas_udf("array<double>")
        def probabilities(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            margin = np.zeros((boost.CLASSES, len(rows)))
            for one in rounds:
                for c, tree in enumerate(one):
                    margin[c] += trees.values_of(tree, rows)
            e = np.exp(margin - margin.max(axis=0))
            return pd.Series(list((e / e.sum(axis=0)).T))

        out = dataset.withColumn("_p", probabilities(vector_to_array("features")))
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": best.cast("double")}).drop("_p")


class SoftmaxBoosting(Estimator):
    """Softmax boosting on ``features`` and ``LABEL``; rows are sampled by a hash of their values."""

    def __init__(self, **settings: Any):
        super().__init__()
        self.settings = settings

    def _fit(self, dataset: DataFrame) -> SoftmaxModel:
        return self.fit_on(dataset, vector_to_array("features"))

    def fit_on(self, dataset: DataFrame, x: Column) -> SoftmaxModel:
        """Fit with ``x``, an array of numbers, for the features."""
        dataset = dataset.withColumn("_x", x)
        values = F.xxhash64("_x", F.lit(SEED))
        weight = "weight" if "weight" in dataset.columns else None
        blocks = boost.make_blocks(dataset, [], LABEL, F.pmod(values, F.lit(HASH_SIZE)), weight, seed=SEED, x=F.col("_x"))
        task = boost.Task(self.settings, list(range(len(blocks.cuts))))
        boost.grow(blocks, [task])
        forget(blocks.table)
        return SoftmaxModel(boost.with_cuts(task, blocks.cuts))


def boosted_settings(weighted: bool = False, **overrides: Any) -> dict[str, Any]:
    """The published settings, level by level or with a limit of leaves and balanced weights."""
    return {**(BOOSTED_WEIGHTED if weighted else BOOSTED), "weighted": weighted, **overrides}


def boosted(weighted: bool = False, **overrides: Any) -> SoftmaxBoosting:
    """Boosted trees of all classes; optionally with balanced weights.

    ``maxIter`` is a limit: a tenth of the rows measures the loss, and growing ends when that has
    not fallen by ``tolerance`` over ``patience`` rounds.
    """
    return SoftmaxBoosting(**boosted_settings(weighted, **overrides))


def pipeline(train: DataFrame, classifier: Estimator, leak_free: bool = False) -> tuple[Pipeline, list[str]]:
    numeric, texts = feature_lists(train, leak_free)
    stages, names = preprocessor(numeric, category_labels(train, texts))
    return Pipeline(stages=[*stages, classifier]), names


def with_scores(scored: DataFrame) -> DataFrame:
    """Class probabilities p0, p1, p2 from a model's output."""
    scored = scored.withColumn("_p", vector_to_array("probability"))
    return scored.withColumns({f"p{i}": F.col("_p")[i] for i in range(3)}).drop("_p")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``prediction`` (int), probabilities p0..p2 and, if known, ``label``."""
    out = with_scores(model.transform(df))
    out = out.withColumn("prediction", F.col("prediction").cast("int"))
    if LABEL in out.columns:
        out = out.withColumn("label", F.col(LABEL).cast("int"))
    return out.drop(*[c for c in out.columns if c.startswith(("_i_", "_h_", "_s_", "_numbers", "_scaled"))])


def predict_severity(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Severity name, class number and the three probabilities to three digits, for each row."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    scored = score(model, df)
    return scored.select(
        *df.columns,
        F.element_at(names, F.col("prediction") + 1).alias("gravite_predite"),
        F.col("prediction").alias("classe_num"),
        *[F.round(f"p{i}", 3).alias(f"proba_{s}") for i, s in enumerate(SEVERITIES)],
    )


def features_of(stages: Sequence[Any]) -> Column:
    """The array of what the fitted stages of ``preprocessor`` put in ``features``, as plain expressions: a
    tenth of the time of the stages' functions on vectors."""
    labels = {s.getInputCol(): s.labels for s in stages if isinstance(s, StringIndexerModel)}
    scaler = next(s for s in stages if isinstance(s, StandardScalerModel))
    numbers = next(s for s in stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "_numbers").getInputCols()
    at = []
    for name, mean, std in zip(numbers, scaler.mean.tolist(), scaler.std.tolist()):
        factor = 1.0 / std if std else 0.0
        at.append((F.col(name).cast("double") - F.lit(mean)) * F.lit(factor))
    for column, values in labels.items():
        at += [F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values[1:]]
    return F.array(*at)


def fit(train: DataFrame, classifier: Estimator, leak_free: bool = False) -> tuple[PipelineModel, list[str]]:
    stages, names = pipeline(train, classifier, leak_free)
    if not hasattr(classifier, "fit_on"):
        return stages.fit(train), names
    prepared = Pipeline(stages=stages.getStages()[:-1]).fit(train).stages
    return PipelineModel([*prepared, classifier.fit_on(train, features_of(prepared))]), names


def evaluate(model: PipelineModel, test: DataFrame) -> dict[str, float]:
    """Macro F1, balanced accuracy and macro AUC on a labelled frame."""
    scored = score(model, test).select("label", "prediction", *M.SCORES).persist()
    try:
        row = M.macro_scores(scored).first().asDict()
        row["auc_ovr"] = M.macro_auc(scored).first()["auc_ovr"]
    finally:
        scored.unpersist()
    return row


def apart(folded: DataFrame, fold: int, leak_free: bool) -> tuple[DataFrame, DataFrame]:
    """The rows outside a fold and those in it; with ``leak_free`` the place features of both
    are fitted on the rows outside alone."""
    rest, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
    rates = refit_places(rest) if leak_free else None
    return with_places(rest, rates), with_places(held, rates)


def cross_validate(
    train: DataFrame, classifier: Estimator, keys: Sequence[str], k: int = 5, leak_free: bool = False, parallelism: int = 5
) -> list[dict[str, float]]:
    """Scores of each stratified fold, everything fitted on the other folds, ``parallelism`` folds at a time;
    logistic models grow side by side, from one table of coded rows."""
    if isinstance(classifier, linear.Logistic):
        return cross_validate_linear(train, classifier, keys, k, leak_free)
    folded = stratified_folds(train, LABEL, keys, k, SEED).persist()

    def scored(i: int) -> dict[str, float]:
        rest, held = apart(folded, i, leak_free)
        model, _ = fit(rest, classifier, leak_free)
        pairs = score(model, held).select("label", "prediction")
        return {"fold": i, **M.macro_scores(pairs).first().asDict()}

    try:
        with ThreadPool(parallelism) as pool:
            return pool.map(scored, range(k))
    finally:
        folded.unpersist()


def cross_validate_linear(
    train: DataFrame, classifier: linear.Logistic, keys: Sequence[str], k: int, leak_free: bool
) -> list[dict[str, float]]:
    """As ``cross_validate``: each fold's model has its own place features, means and deviations."""
    rows, extra, _, names, columns = folded_rows(train, keys, k, leak_free)
    numeric, texts = feature_lists(train, leak_free)
    x = F.concat("_x", F.array(*[F.col(f"`{n}`").cast("double") for n in extra]).cast("array<double>"))
    blocks = linear.make_blocks(rows, x, LABEL, F.col("weight"), F.col("fold"))
    scaled = [*range(len(numeric)), *range(len(names), len(names) + len(extra))]
    of = {i: max((c for c in texts if names[i].startswith(f"{c}_")), key=len) for i in range(len(numeric), len(names))}
    flags = [[i for i, c in of.items() if c == text] for text in texts]
    tasks = [classifier.task(columns[i], i, scaled=scaled, flags=flags) for i in range(k)]
    linear.fit(blocks, tasks)
    forget(blocks.table)
    return [{"fold": i, **M.scores_of_counts(t.held)} for i, t in enumerate(tasks)]


def mean_std(values: Iterable[float]) -> tuple[float, float]:
    """Mean and population deviation."""
    values = list(values)
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def draw(space: Mapping[str, tuple], rng: random.Random) -> dict[str, Any]:
    """One random setting from a search space."""
    setting: dict[str, Any] = {}
    for name, (low, high, step) in space.items():
        if step == "log":
            value = math.exp(rng.uniform(math.log(low), math.log(high)))
        elif step is None:
            value = rng.uniform(low, high)
        else:
            value = low + step * rng.randint(0, (high - low) // step)
        setting[name] = str(round(value, 4)) if name == "featureSubsetStrategy" else value
    return setting


def folded_rows(
    train: DataFrame, keys: Sequence[str], folds: int, leak_free: bool
) -> tuple[DataFrame, list[str], list, list[str], list[list[int]]]:
    """Prepared training rows with their folds, their further columns, the fitted preparation, its feature
    names and, for each fold and last for all rows, the columns that a model may use: with ``leak_free``
    each fold has place features fitted on the other folds."""
    numeric, texts = feature_lists(train, leak_free)
    stages, names = preprocessor(numeric, category_labels(train, texts))
    prepared = Pipeline(stages=stages).fit(train)
    rows = stratified_folds(train, LABEL, keys, folds, SEED) if folds else train.withColumn("fold", F.lit(-1))
    rows = rows.withColumn("_x", features_of(prepared.stages))
    own = list(range(len(names)))
    columns, extra = [own] * folds, []
    if leak_free and folds and {*PLACE_FEATURES, INCIDENT.region, INCIDENT.town, INCIDENT.road, INCIDENT.severity, INCIDENT.id} <= set(train.columns):
        rows = subset_places(rows, {str(i): F.col("fold") != i for i in range(folds)})
        rest = [i for i in own if names[i] not in PLACE_FEATURES]
        for i in range(folds):
            columns[i] = rest + [len(names) + len(extra) + j for j in range(len(PLACE_FEATURES))]
            extra += [f"{c}@{i}" for c in PLACE_FEATURES]
    return rows, extra, prepared.stages, names, [*columns, own]


def folded_blocks(
    train: DataFrame, keys: Sequence[str], folds: int, leak_free: bool
) -> tuple[boost.Blocks, list, list[str], list[list[int]]]:
    """Binned rows of ``folded_rows``, the fitted preparation, its feature names and the models' columns."""
    rows, extra, stages, names, columns = folded_rows(train, keys, folds, leak_free)
    weight = "weight" if "weight" in rows.columns else None
    blocks = boost.make_blocks(rows, extra, LABEL, row_hash(keys, SEED + 1), weight, "fold", SEED, F.col("_x"))
    return blocks, stages, names, columns


#: Rounds of the first rung of a search; each rung has twice as many in all.
FIRST_RUNG = 5


def search(
    train: DataFrame,
    keys: Sequence[str],
    space: Mapping[str, tuple],
    trials: int = 30,
    folds: int = 5,
    weighted: bool = False,
    leak_free: bool = False,
    labelled_rows: int | None = None,
) -> list[dict[str, Any]]:
    """Random search by cross-validated macro F1 and successive halving, best setting first.

    All settings and folds grow side by side from the same binned rows. After 5, 10, 20 ... rounds the
    better half (macro F1 over the folds, then the smaller validation loss) goes on from
    where it is; the last one grows until its loss no longer falls or to its ``maxIter``. A row has the
    setting's scores and ``rounds`` (mean over the folds) at its last ``rung``. ``labelled_rows`` bounds
    the rows that are searched on, those of least row hash.
    """
    if labelled_rows is not None:  # stored, as finding them reads all rows
        train = store(sample_rows(train, labelled_rows, keys[0]), "sample")
    rng = random.Random(SEED)
    settings = [draw(space, rng) for _ in range(trials)]
    blocks, _, _, columns = folded_blocks(train, keys, folds, leak_free)
    tasks = [[boost.Task({**setting, "weighted": weighted}, columns[i], i) for i in range(folds)] for setting in settings]
    results: dict[int, dict[str, Any]] = {}
    alive, rung, grown = list(range(trials)), 0, FIRST_RUNG
    while True:
        last = len(alive) == 1
        boost.grow(blocks, [t for i in alive for t in tasks[i]], None if last else grown)
        for i in alive:
            mean, std = mean_std(boost.f1_macro(t.held) for t in tasks[i])
            loss = sum(t.losses[-1] for t in tasks[i]) / folds
            rounds = sum(len(t.rounds) for t in tasks[i]) / folds
            results[i] = {"f1_macro": mean, "f1_std": std, "loss": loss, "rung": rung, "rounds": rounds, **settings[i]}
        if last:
            break
        order = sorted(alive, key=lambda i: (-results[i]["f1_macro"], results[i]["loss"], i))
        alive = order[: (len(order) + 1) // 2]
        grown = FIRST_RUNG * 2**rung  # as many again as so far
        rung += 1
    forget(blocks.table)
    return sorted(results.values(), key=lambda row: (-row["rung"], -row["f1_macro"], row["loss"]))


def draws_only(found: Mapping[str, Any]) -> dict[str, Any]:
    """The setting of a row of ``search``."""
    return {k: v for k, v in found.items() if k not in ("f1_macro", "f1_std", "loss", "rung", "rounds")}


def fit_boosted(
    train: DataFrame, settings: Sequence[Mapping[str, Any]], keys: Sequence[str], folds: int = 5, leak_free: bool = False
) -> tuple[list[PipelineModel], list[str], list[list[float]]]:
    """A model of all rows for each setting, the feature names, and each setting's macro F1 by fold:
    all of them grown side by side."""
    blocks, stages, names, columns = folded_blocks(train, keys, folds, leak_free)
    tasks = [[boost.Task(s, columns[i], i if i < folds else -1) for i in range(folds + 1)] for s in settings]
    boost.grow(blocks, [t for of in tasks for t in of])
    forget(blocks.table)
    models = [PipelineModel([*stages, SoftmaxModel(boost.with_cuts(of[-1], blocks.cuts))]) for of in tasks]
    return models, names, [[boost.f1_macro(t.held) for t in of[:-1]] for of in tasks]


def learning_curve(
    train: DataFrame,
    classifier: Estimator,
    keys: Sequence[str],
    sizes: Sequence[float] = tuple(0.1 + 0.9 * i / 7 for i in range(8)),
    folds: int = 3,
    leak_free: bool = False,
    parallelism: int = 8,
    labelled_rows: int | None = None,
) -> list[dict[str, Any]]:
    """Train and validation macro F1 at growing training sizes; a final gap above 0.1 is overfitting.

    The size is a threshold on a row hash, so each sample contains the smaller ones. All samples and
    folds are fitted side by side, ``parallelism`` at a time; their place features come from one
    aggregation. ``rows`` counts the training rows of all folds together. ``labelled_rows`` bounds the
    rows of the largest size, those of least row hash.
    """
    if labelled_rows is not None:  # stored, as finding them reads all rows
        train = store(sample_rows(train, labelled_rows, keys[0]), "sample")
    folded = stratified_folds(train, LABEL, keys, folds, SEED).withColumn("_luck", row_hash(keys, SEED + 1))
    cuts = [int(size * HASH_SIZE) for size in sizes]
    inside = {f"{j}_{i}": (F.col("fold") != i) & (F.col("_luck") < cut) for j, cut in enumerate(cuts) for i in range(folds)}
    refit = leak_free and {*PLACE_FEATURES, INCIDENT.region, INCIDENT.town, INCIDENT.road, INCIDENT.severity, INCIDENT.id} <= set(train.columns)
    table = store(subset_places(folded, inside) if refit else folded, "curve")

    def scores(name: str) -> tuple[float, float, int]:
        held = F.col("fold") == int(name.split("_")[1])
        own = {c: F.col(f"`{c}@{name}`") for c in PLACE_FEATURES} if refit else {}
        rows = table.where(inside[name] | held).withColumns({**own, "_held": held})
        rows = rows.select("_held", *train.columns).persist()
        try:
            model, _ = fit(rows.where(~F.col("_held")).drop("_held"), classifier, leak_free)
            counts = {False: np.zeros((3, 3), int), True: np.zeros((3, 3), int)}
            for row in score(model, rows).groupBy("_held", "label", "prediction").count().collect():
                counts[row["_held"]][row["label"], row["prediction"]] = row["count"]
        finally:
            rows.unpersist()
        return boost.f1_macro(counts[False]), boost.f1_macro(counts[True]), int(counts[False].sum())

    with ThreadPool(parallelism) as pool:
        found = dict(zip(inside, pool.map(scores, inside, chunksize=1)))
    forget(table)
    curve = []
    for j, size in enumerate(sizes):
        of_size = [found[f"{j}_{i}"] for i in range(folds)]
        (tm, ts), (vm, vs) = (mean_std(x[k] for x in of_size) for k in (0, 1))
        curve.append({"size": size, "rows": sum(x[2] for x in of_size), "train_mean": tm, "train_std": ts, "val_mean": vm,
                      "val_std": vs, "gap": tm - vm, "overfitting": tm - vm > 0.1})
    return curve


def tree_importance(model: PipelineModel, names: Sequence[str], spark: SparkSession, top: int = 20) -> DataFrame:
    """Named split importances of a forest or of boosted trees (shares of all gains)."""
    last = model.stages[-1]
    shares = last.featureImportances(len(names)) if isinstance(last, SoftmaxModel) else last.featureImportances
    rows = sorted(((n, float(shares[i])) for i, n in enumerate(names)), key=lambda row: (-row[1], row[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def linear_attribution(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute contribution ``|w (x - mean)|`` of each feature of a logistic model.

    It is taken over all rows and classes; sums per feature are all that is shuffled, a pass for
    the means and one for the distances from them.
    """
    last = model.stages[-1]
    weights = last.coefficientMatrix.toArray()
    strength = [float(sum(abs(w) for w in weights[:, i]) / len(weights)) for i in range(len(names))]
    ship(df.sparkSession)
    rows = df.select(features_of(model.stages[:-1]).alias("x"))
    width = len(names)

    def total(mean: np.ndarray | None) -> np.ndarray:
        """Rows, then the sums of the features or of their distances from the means: a row per task reaches the driver."""

        def add(batches):
            sums = np.zeros(width + 1)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                sums[0] += batch.num_rows
                sums[1:] += (x if mean is None else np.abs(x - mean)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["sums"])

        found = rows.mapInArrow(add, "sums array<double>")
        at = [F.sum(F.get("sums", F.lit(i))).alias(str(i)) for i in range(width + 1)]
        return np.array(found.agg(*at).first(), float)

    whole = total(None)
    distance = total(whole[1:] / whole[0])
    contribution = distance[1:] / distance[0] * np.array(strength)
    found = sorted(zip(names, contribution.tolist()), key=lambda row: (-row[1], row[0]))
    return df.sparkSession.createDataFrame(found, "feature string, contribution double")


def ablation_attribution(model: PipelineModel, sample: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute change of the class probabilities when a feature is set to its mean.

    For any model. Rows are scored as they are, then once with each feature at its mean, side by
    side in the same row: no id and no join is needed, and only sums per feature are shuffled.
    """
    last = model.stages[-1]
    prepared = PipelineModel(model.stages[:-1]).transform(sample).select("features")
    means = prepared.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()

    def scored(rows: DataFrame, out: str) -> DataFrame:
        got = with_scores(last.transform(rows))
        return got.select(*[c for c in rows.columns if c != "features"], F.array("p0", "p1", "p2").alias(out))

    base = scored(prepared.withColumn("_x", F.col("features")), "_base")
    mean_of = F.array(*[F.lit(m) for m in means])
    at = F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_k")
    swapped = F.transform(vector_to_array("_x"), lambda v, i: F.when(i == F.col("_k"), F.get(mean_of, i)).otherwise(v))
    changed = base.select("_x", "_base", at).select("_base", "_k", array_to_vector(swapped).alias("features"))
    moved = F.aggregate(F.zip_with("_p", "_base", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1)
    return (
        scored(changed, "_moved").withColumnRenamed("_moved", "_p")
        .groupBy("_k")
        .agg(F.avg(moved / 3).alias("contribution"))
        .select(label.alias("feature"), "contribution")
        .orderBy(F.desc("contribution"), "feature")
    )


def forest_trees(model: PipelineModel, spark: SparkSession) -> list[trees.Tree]:
    """The trees of a forest; a leaf's values are its class shares, divided by the number of trees."""
    path = f"{shared_dir(spark).rstrip('/')}/forest-{uuid.uuid4().hex}"
    model.stages[-1].write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # the model itself
    forget_path(spark, path)
    out: dict[int, dict[int, Any]] = {}
    for row in rows:
        out.setdefault(row["treeID"], {})[row["id"]] = row
    found = []
    for nodes in out.values():
        tree: dict[str, list] = {name: [] for name in trees.leaf()}
        for i in range(len(nodes)):
            node = nodes[i]
            stats = np.array(node["impurityStats"])
            split = node["split"]
            left, right, cut = node["leftChild"], node["rightChild"], 0.0
            if left >= 0:
                cut = split["leftCategoriesOrThreshold"][0]
                if split["numCategories"] >= 0:  # a flag: one of its two values goes left
                    if split["numCategories"] != 2:
                        raise ValueError("splits of more than two categories are not known")
                    left, right = (left, right) if cut == 0 else (right, left)
                    cut = 0.5
            values = (-1 if node["leftChild"] < 0 else split["featureIndex"], cut, max(left, 0), max(right, 0),
                      (stats / stats.sum() / len(out)).tolist(), max(node["gain"], 0.0), float(node["rawCount"]))
            for name, value in zip(("feature", "cut", "left", "right", "value", "gain", "cover"), values):
                tree[name].append(value)
        found.append(tree)
    return found


def tree_paths(model: PipelineModel, spark: SparkSession) -> list[trees.Path]:
    """The flat paths of a forest or of boosted trees, with a value per class at each end."""
    last = model.stages[-1]
    if isinstance(last, SoftmaxModel):
        one = np.eye(boost.CLASSES)
        return [(f, low, high, share, v[0] * one[c])
                for of in last.grown() for c, tree in enumerate(of) for f, low, high, share, v in trees.paths(tree)]
    return [path for tree in forest_trees(model, spark) for path in trees.paths(tree)]


def _explained(model: PipelineModel, df: DataFrame, keep: Sequence[str], schema: str, make) -> DataFrame:
    """mapInArrow over (kept columns, feature arrays): ``make(batch, values)`` gets Shapley values."""
    spark = df.sparkSession
    ship(spark)
    paths = tree_paths(model, spark)
    spread = spark.sparkContext.broadcast(paths)  # as large as the model, which the driver holds
    rows = df.select(*keep, features_of(model.stages[:-1]).alias("_x"))

    def explain(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = part.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                yield make(part, trees.shapley(spread.value, x, boost.CLASSES, kept))

    return rows.mapInArrow(explain, schema)


def tree_attribution(model: PipelineModel, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean absolute Shapley value of each feature over all rows and classes, for a forest (of
    probabilities) or boosted trees (of margins). Sums per feature are all that is shuffled."""
    def total(part, values):
        sums = np.abs(values).sum(axis=(0, 2))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums), pa.array([part.num_rows * boost.CLASSES] * len(sums), pa.int64())],
            names=["i", "s", "n"])

    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    sums = _explained(model, df, [], "i int, s double, n long", total)
    return (
        sums.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("contribution"))
        .select(label.alias("feature"), "contribution").orderBy(F.desc("contribution"), "feature")
    )


def tree_values(model: PipelineModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class, base, values): per row and class the Shapley value of every feature, in the model's
    order; they add up to the tree score (probability or margin) less ``base``."""
    base = trees.expected(tree_paths(model, df.sparkSession))
    base = [float(b) for b in np.broadcast_to(base, boost.CLASSES)]

    def flat(part, values):
        rows, width = len(values), values.shape[1]
        each = pa.ListArray.from_arrays(
            pa.array(np.arange(rows * boost.CLASSES + 1) * width, pa.int32()), pa.array(values.transpose(0, 2, 1).ravel()))
        of_row = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * boost.CLASSES, pa.int32()), each)
        return pa.RecordBatch.from_arrays([*part.columns[:-1], of_row], names=[*keys, "v"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    found = _explained(model, df, keys, f"{kinds}, v array<array<double>>", flat)
    at = F.element_at(F.array(*[F.lit(b) for b in base]), F.col("class") + 1)
    return found.select(*keys, F.posexplode("v").alias("class", "values")).select(*keys, "class", at.alias("base"), "values")


def compare_models(results: Sequence[Mapping[str, Any]], spark: SparkSession) -> DataFrame:
    """The models with their scores, best macro F1 first. One row per model."""
    fields = ["f1_macro", "balanced_acc", "auc_ovr", "cv_f1_mean", "cv_f1_std"]
    rows = [(r["model_name"], *[float(r[f]) if r.get(f) is not None else None for f in fields]) for r in results]
    schema = "model_name string, " + ", ".join(f"{f} double" for f in fields)
    return spark.createDataFrame(rows, schema).orderBy(F.desc("f1_macro"), "model_name")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def prepare(df: DataFrame, leak_free: bool = False) -> DataFrame:
    """Check labels and features, and add the balanced class weight."""
    numeric, texts = feature_lists(df, leak_free)
    check_ready(df, [*numeric, *texts])
    return add_class_weight(df)
