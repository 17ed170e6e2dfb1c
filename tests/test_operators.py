"""Hand-made frames for features, statistics, metrics, frames and the rule."""

import math

import pytest
from pyspark.sql import functions as F

from hazardframe.functions.scalar import band, right_closed_bin, weighted_mean
from hazardframe.operators import features as X
from hazardframe.operators import frames as H
from hazardframe.operators import metrics as M
from hazardframe.operators import quality as Q
from hazardframe.operators import stats as S


def test_speed_zone_bins_close_on_the_right(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0, 50, 51, 90, 200, 210, None])], "id int, v int")
    zone = right_closed_bin("v", X.SPEED_ZONE_EDGES, X.SPEED_ZONES)
    got = [r[0] for r in df.orderBy("id").select(zone).collect()]
    assert got == [None, "Zone30-50", "Zone70", "Zone90", "Zone+90", None, None]


def test_bands(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 9.9, 10.0, 29.0, 30.0, 45.0, None])], "id int, v double")
    got = [r[0] for r in df.orderBy("id").select(band("v", [0, 10, 20, 30])).collect()]
    assert got == ["0-10", "0-10", "10-20", "20-30", "30+", "30+", None]


def test_weighted_mean_ignores_unknown(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 100), (4.0, 2)], "v double, w int")
    assert df.agg(weighted_mean("v", "w")).first()[0] == 3.0


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0.5, 100), (0.0, 10), (1.0, 10), (0.5, 0)], "p double, n long")
    low, high = S.wilson_interval("p", "n")
    rows = df.select(low.alias("low"), high.alias("high")).collect()
    assert rows[0]["low"] == pytest.approx(0.4038315, abs=1e-6)
    assert rows[0]["high"] == pytest.approx(0.5961685, abs=1e-6)
    assert rows[1]["low"] == pytest.approx(0, abs=1e-12) and rows[2]["high"] == pytest.approx(1, abs=1e-12)
    assert rows[3]["low"] is None and rows[3]["high"] is None


def table(spark, cells):
    rows = [(x, y) for (x, y), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "x string, y string")


def test_cramers_v_with_continuity_correction(spark):
    df = table(spark, {("a", "p"): 10, ("a", "q"): 20, ("b", "p"): 30, ("b", "q"): 15})
    a, b, c, d = 10, 20, 30, 15
    n = a + b + c + d
    chi2 = n * (abs(a * d - b * c) - n / 2) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    assert S.cramers_v(df, "x", "y").first()["cramers_v"] == pytest.approx(math.sqrt(chi2 / n), abs=5e-5)


def test_cramers_v_with_an_empty_cell(spark):
    cells = {("a", "p"): 10, ("a", "q"): 20, ("a", "r"): 5, ("b", "p"): 30, ("b", "q"): 15}
    df = table(spark, cells)
    n = sum(cells.values())
    row = {k: sum(v for (x, _), v in cells.items() if x == k) for k in "ab"}
    col = {k: sum(v for (_, y), v in cells.items() if y == k) for k in "pqr"}
    chi2 = sum((cells.get((x, y), 0) - row[x] * col[y] / n) ** 2 / (row[x] * col[y] / n) for x in row for y in col)
    assert S.cramers_v(df, "x", "y").first()["cramers_v"] == pytest.approx(math.sqrt(chi2 / n), abs=5e-5)


def test_constant_column_has_no_association(spark):
    df = table(spark, {("a", "p"): 3, ("a", "q"): 4})
    assert S.cramers_v(df, "x", "y").first()["cramers_v"] is None


def test_relative_risk_without_exposed_rows(spark):
    df = spark.createDataFrame([("Mortel", False), ("Léger", False), ("Léger", None)], "gravite string, e boolean")
    row = S.relative_risk(df, {"e": F.col("e")}).first()
    assert (row["n_exposed"], row["fatal_pct_exposed"], row["relative_risk"]) == (0, None, None)
    assert row["fatal_pct_unexposed"] == 50.0


SCORED = [
    (0, 0, 0.6, 0.2, 0.2), (0, 0, 0.6, 0.3, 0.1), (0, 1, 0.4, 0.5, 0.1), (0, 0, 0.5, 0.3, 0.2),
    (1, 1, 0.2, 0.6, 0.2), (1, 0, 0.6, 0.3, 0.1), (1, 1, 0.3, 0.5, 0.2), (1, 1, 0.1, 0.8, 0.1),
    (2, 1, 0.2, 0.5, 0.3), (2, 0, 0.5, 0.2, 0.3), (2, 1, 0.3, 0.4, 0.3), (2, 0, 0.6, 0.2, 0.2),
]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "label int, prediction int, p0 double, p1 double, p2 double")


def test_class_never_predicted(scored):
    report = {r["class"]: r for r in M.classification_report(scored).collect()}
    assert report["Mortel"]["precision"] == report["Mortel"]["recall"] == report["Mortel"]["f1"] == 0.0
    f1 = [2 * 3 / (4 + 6), 2 * 3 / (4 + 6), 0]
    assert report["macro avg"]["f1"] == pytest.approx(sum(f1) / 3, abs=1e-6)
    assert report["accuracy"]["f1"] == 0.5
    row = M.macro_scores(scored).first()
    assert row["balanced_acc"] == 0.5 and row["f1_macro"] == 0.4


def test_auc_counts_ties_half(scored):
    got = {r["class"]: r["auc"] for r in M.class_auc(scored).collect()}
    for c in range(3):
        pos = [row[2 + c] for row in SCORED if row[0] == c]
        neg = [row[2 + c] for row in SCORED if row[0] != c]
        won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert got[c] == pytest.approx(won / len(pos) / len(neg))


def test_roc_ends_in_the_corners(scored):
    points = M.roc_points(scored).orderBy("class", F.desc_nulls_first("threshold")).collect()
    for c in range(3):
        curve = [(r["fpr"], r["tpr"]) for r in points if r["class"] == c]
        assert curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)
        assert curve == sorted(curve)


def test_box_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    row = H.box_stats(df, ["g"], "v").first()
    assert (row["q1"], row["median"], row["q3"], row["outliers"]) == (2.0, 3.0, 4.0, 1)


def test_histogram_of_one_value(spark):
    rows = Q.histogram(spark.createDataFrame([(5.0,), (5.0,)], "v double"), "v", 4).collect()
    assert [(r["low"], r["high"], r["n"]) for r in rows] == [(5.0, 5.25, 2)]


def test_shares_add_up_and_tree_matches(spark, sf_dir):
    from catalog import QUERIES

    shares = QUERIES["severity_distribution"](spark, sf_dir).collect()
    assert sum(r["pct"] for r in shares) == pytest.approx(100, abs=0.05)
    tree = QUERIES["region_severity_tree"](spark, sf_dir).collect()
    total = [r["n"] for r in tree if r["depth"] == 0]
    assert total == [sum(r["n"] for r in tree if r["depth"] == 1)] == [sum(r["n"] for r in tree if r["depth"] == 2)]


def test_report_order(spark, sf_dir):
    from catalog import QUERIES

    assert [r["gravite"] for r in QUERIES["by_severity"](spark, sf_dir).collect()] == ["Mortel", "Grave", "Léger"]
    rates = [r["taux_mortalite"] for r in QUERIES["top_regions"](spark, sf_dir).collect()]
    assert rates == sorted(rates, reverse=True)
    running = QUERIES["running_deaths"](spark, sf_dir).collect()
    for year in {r["annee"] for r in running}:
        months = [r for r in running if r["annee"] == year]
        assert months[-1]["deces_cumul"] == sum(r["deces_mois"] for r in months)
