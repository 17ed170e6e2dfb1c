"""Boosting against a plain version in memory, and Shapley values against their definition."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from hazardframe.functions.scalar import row_hash
from hazardframe.operators import boost, trees
from hazardframe.operators import model as L


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select(
        F.col("id"), (F.rand(1) * 10).alias("a"), F.floor(F.rand(2) * 4).cast("double").alias("b"), F.rand(3).alias("c"),
        (F.col("id") % 3).cast("int").alias("fold"))
    label = F.when(F.col("a") > 7, 2).when(F.col("b") == 1, 1).otherwise(0)
    noisy = F.when(F.rand(4) < 0.05, F.floor(F.rand(5) * 3)).otherwise(label).cast("int")
    df = df.withColumn("gravite_num", noisy).withColumn("weight", F.col("gravite_num") + 0.5)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).persist()


def softmax(m):
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def plain_boost(x, y, w, judge, rounds, s):
    """Exact greedy softmax boosting, one row set, no sampling of rows or columns."""
    margin, losses, all_trees = np.zeros((len(x), 3)), [], []
    lam, alpha = s["regLambda"], s["regAlpha"]
    soft = lambda g: math.copysign(max(abs(g) - alpha, 0), g)

    def build(idx, g, h, depth):
        G, H = g[idx].sum(), h[idx].sum()
        value = -s["stepSize"] * soft(G) / (H + lam)
        best = (0, None)
        if depth < s["maxDepth"]:
            for f in range(x.shape[1]):
                for cut in np.unique(x[idx, f])[:-1]:
                    left = idx[x[idx, f] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    gain = 0.5 * (soft(gl) ** 2 / (hl + lam) + soft(G - gl) ** 2 / (H - hl + lam) - soft(G) ** 2 / (H + lam)) - s["minInfoGain"]
                    if gain > best[0] + 1e-9 and min(len(left), len(idx) - len(left)) >= s["minInstancesPerNode"]:
                        best = (gain, (f, cut))
        if best[1] is None:
            return lambda r: np.full(len(r), value)
        f, cut = best[1]
        yes, no = build(idx[x[idx, f] <= cut], g, h, depth + 1), build(idx[x[idx, f] > cut], g, h, depth + 1)
        return lambda r: np.where(r[:, f] <= cut, yes(r), no(r))

    for _ in range(rounds + 1):
        p = softmax(margin)
        losses.append(float((-np.log(p[np.arange(len(y)), y]) * w)[judge].sum() / w[judge].sum()))
        one = []
        for c in range(3):
            g, h = (p[:, c] - (y == c)) * w, 2 * p[:, c] * (1 - p[:, c]) * w
            one.append(build(np.flatnonzero(~judge), g, h, 0))
        for c in range(3):
            margin[:, c] += one[c](x)
        all_trees.append(one)
    return losses


def packed(rows, fold=None):
    few = rows.withColumns({"a": F.round("a", 0), "c": F.round("c", 1)})
    few = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(few.drop("features"))
    return few, boost.make_blocks(few, [], "gravite_num", row_hash(["id"], 1), "weight", fold)


@pytest.mark.parametrize("extra", [{}, {"weighted": True, "regAlpha": 0.7, "regLambda": 0.0, "minInfoGain": 0.5, "minInstancesPerNode": 20}])
def test_equal_to_exact_boosting(rows, extra):
    few, blocks = packed(rows)
    s = {"maxIter": 4, "stepSize": 0.3, "maxDepth": 3, "patience": 0, **extra}
    task = boost.Task(s, [0, 1, 2])
    boost.grow(blocks, [task])
    data = few.select("a", "b", "c", "gravite_num", "weight", row_hash(["id"], 1).alias("luck")).toPandas()
    judge = boost._uniform(data["luck"].to_numpy(), blocks.seed + 1) < 0.1
    w = data["weight"].to_numpy() if extra else np.ones(len(data))
    want = plain_boost(data[["a", "b", "c"]].to_numpy(), data["gravite_num"].to_numpy(), w, judge, 4, task.settings)
    assert task.losses == pytest.approx(want, rel=1e-6)
    assert len(task.rounds) == 4 and task.seen.sum() == 3000 and task.held.sum() == 0


def test_side_by_side_equals_one_by_one(rows):
    """Models, folds, sample sizes and stored margins do not disturb one another."""
    settings = [{"maxIter": 12, "maxDepth": 2, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.67", "patience": 0},
                {"maxIter": 5, "maxLeaves": 3, "maxDepth": 0, "patience": 0}]
    tasks = lambda: [boost.Task(s, [0, 1, 2], fold, size) for s in settings for fold in (-1, 1) for size in (1.0, 0.4)]
    together = tasks()
    _, blocks = packed(rows, "fold")
    boost.grow(blocks, together, 3)
    boost.grow(blocks, together)
    for alone, other in zip(tasks(), together):
        _, blocks = packed(rows, "fold")
        boost.grow(blocks, [alone])
        assert [len(t["feature"]) for one in alone.rounds for t in one] == [len(t["feature"]) for one in other.rounds for t in one]
        assert alone.losses[-1] == pytest.approx(other.losses[-1], rel=1e-5)
        assert (alone.held == other.held).all() and (alone.seen == other.seen).all()
    assert all(sum(f < 0 for f in t["feature"]) <= 3 for one in together[-1].rounds for t in one)
    assert together[2].held.sum() == rows.where("fold = 1").count() and together[1].seen.sum() < 1400


def test_growing_ends_when_the_loss_does_not_fall(rows):
    _, blocks = packed(rows)
    task = boost.Task({"maxIter": 500, "stepSize": 0.3}, [0, 1, 2])
    boost.grow(blocks, [task])
    assert task.stopped and 5 < len(task.rounds) < 60
    assert boost.f1_macro(task.seen) > 0.9
    with pytest.raises(ValueError):
        boost.Task({"depth": 3}, [0])


def test_empty_and_single_class(spark, rows):
    for some in (rows.limit(0), rows.where("gravite_num = 0")):
        model = L.SoftmaxBoosting(maxIter=2).fit(some)
        assert model.transform(rows).where("prediction <> 0").count() == 0


def test_model_round_trip(spark, rows, tmp_path):
    model = L.SoftmaxBoosting(maxIter=6, stepSize=0.3).fit(rows)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = L.SoftmaxModel.load(str(tmp_path / "m"))
    one, two = (sorted((r.id, r.prediction, tuple(r.probability.toArray())) for r in m.transform(rows).collect()) for m in (model, again))
    assert one == two
    assert sum(r.gravite_num == r.prediction for r in model.transform(rows).collect()) > 2700
    assert np.argmax(model.featureImportances(3).toArray()) == 0


def brute(tree, row, d):
    """Shapley values by the definition: turns of unknown features are shared by training rows."""
    def worth(known, node=0):
        f = tree["feature"][node]
        if f < 0:
            return np.array(tree["value"][node], float)
        left, right = tree["left"][node], tree["right"][node]
        if f in known:
            return worth(known, left if row[f] <= tree["cut"][node] else right)
        return sum(worth(known, c) * tree["cover"][c] for c in (left, right)) / tree["cover"][node]

    out = np.zeros(d)
    for f in range(d):
        others = [x for x in range(d) if x != f]
        for k in range(d):
            for known in itertools.combinations(others, k):
                out[f] += (worth({*known, f}) - worth(set(known))) / (d * math.comb(d - 1, k))
    return out, worth(set()), worth(set(range(d)))


def test_shapley_by_definition():
    rng = np.random.default_rng(4)
    for _ in range(20):
        tree = trees.leaf(0.0, 100.0)
        open_ = [0]
        for _ in range(6):
            node = open_.pop(rng.integers(len(open_)))
            tree["feature"][node], tree["cut"][node] = int(rng.integers(4)), float(rng.random())
            part = float(rng.integers(0, int(tree["cover"][node]) + 1)) if tree["cover"][node] else 0.0
            for side, cover in (("left", part), ("right", tree["cover"][node] - part)):
                tree[side][node] = trees.add_leaf(tree, float(rng.normal()), cover)
                open_.append(tree[side][node])
            open_ = [n for n in open_ if tree["cover"][n] > 0] or open_
        if any(tree["feature"][n] >= 0 and tree["cover"][n] == 0 for n in range(len(tree["cover"]))):
            continue
        x = rng.random((30, 4))
        got = trees.shapley(trees.paths(tree), x, 1)[:, :, 0]
        for row, values in zip(x, got):
            want, base, full = brute(tree, row, 4)
            assert values == pytest.approx(want, abs=1e-9)
            assert values.sum() == pytest.approx(full - base, abs=1e-9)


@pytest.mark.parametrize("build", [lambda: L.forest(numTrees=7, maxDepth=5), lambda: L.boosted(maxIter=5, stepSize=0.3)])
def test_values_add_up_to_the_score(spark, build):
    df = spark.range(900).select(
        F.col("id").alias("accident_id"), (F.rand(1) * 100).alias("vitesse_estimee"), F.rand(7).alias("autre"),
        F.element_at(F.array(*map(F.lit, ["Alcool", "Fatigue", "Téléphone"])), (F.col("id") % 3 + 1).cast("int")).alias("cause"))
    df = df.withColumn("gravite_num", F.when(F.col("vitesse_estimee") > 70, 2).when(F.col("cause") == "Fatigue", 1).otherwise(0)).persist()
    model, names = L.fit(L.prepare(df), build())
    raw = model.transform(df)
    values = L.tree_values(model, df, ["accident_id"]).collect()
    assert len(values) == 2700
    total = {(r["accident_id"], r["class"]): r["base"] + sum(r["values"]) for r in values}
    for row in raw.select("accident_id", "probability").collect():
        p = row["probability"].toArray()
        t = np.array([total[row["accident_id"], c] for c in range(3)])
        if isinstance(model.stages[-1], L.SoftmaxModel):
            t = np.exp(t) / np.exp(t).sum()
        assert t == pytest.approx(p, abs=1e-9)
    got = [r["feature"] for r in L.tree_attribution(model, df, names).collect()]
    assert got[0] == "vitesse_estimee" and got[1] == "cause_Fatigue" and set(got) == set(names)
