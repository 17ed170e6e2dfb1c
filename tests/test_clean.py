"""Hand-made frames for the cleaning and imputation rules, and properties of the whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalog.relations import clean
from hazardframe.functions.scalar import strip
from hazardframe.operators import clean as C
from hazardframe.operators import impute as I
from hazardframe.plans.cleaning import clean_incidents, run_cleaning
from hazardframe.sources.testbed import TIE_KEY, incidents


def column(df, name, key="id"):
    return [row[name] for row in df.orderBy(key).collect()]


def test_clip_keeps_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, 250.0), (3, -3.0), (4, 90.5)], "id int, vitesse_estimee double")
    assert column(C.clip_speed(df), "vitesse_estimee") == [None, 200.0, 0.0, 90.5]


def test_hours_wrap_both_ways(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate([-1, 0, 23, 24, 30])], "id int, heure int")
    assert column(C.wrap_hours(df), "heure") == [23, 0, 23, 0, 6]


def test_strip(spark):
    df = spark.createDataFrame([(1, "\t oUI\n"), (2, " été chaud "), (3, None), (4, "")], "id int, t string")
    out = df.select("id", strip("t").alias("s"))
    assert column(out, "s") == ["oUI", "été chaud", None, ""]


def test_binary_values(spark):
    df = spark.createDataFrame([(1, " oui"), (2, "NON"), (3, "Peut-être"), (4, None), (5, "\tOuI\n")], "id int, port_casque string")
    assert column(C.standardise_binary(df), "port_casque") == ["Oui", "Non", None, None, "Oui"]


def test_unreadable_dates_go(spark):
    df = spark.createDataFrame([(1, "2024-02-29"), (2, "2023-02-29"), (3, "x"), (4, "2024-01-05 07:30:00")], "id int, date_accident string")
    assert column(C.coerce_dates(df), "date_accident") == [dt.date(2024, 2, 29), dt.date(2024, 1, 5)]


def test_negative_cost_takes_median_of_the_rest(spark):
    df = spark.createDataFrame([(1, 10), (2, 13), (3, -5), (4, None)], "id int, cout_estime long")
    assert column(C.repair_negative_cost(df), "cout_estime") == [10.0, 13.0, 11.5, None]


def test_cap_is_interpolated(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 11)], "id int, cout_estime long")
    assert column(C.cap_cost(df, prob=0.95), "cout_estime")[-1] == pytest.approx(9.55)


def test_first_copy_stays(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, 9, "c")], "accident_id int, t int, v string")
    assert column(C.keep_first(df, ["t"]), "v", "accident_id") == ["a", "c"]


def test_unknown_victims_are_no_contradiction(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 5, None)], "id int, nombre_deces int, nombre_victimes double")
    assert column(C.drop_incoherent(df), "id") == [2, 3]


def test_unmapped_severity_goes(spark):
    df = spark.createDataFrame([(1, "Léger"), (2, "?"), (3, None), (4, "Mortel")], "id int, gravite string")
    assert column(C.encode_severity(df), "gravite_num") == [0, 2]


def test_smallest_mode_wins_a_tie(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "b", "a", None])], "id int, meteo string")
    assert column(I.fill_mode(df, ["meteo"]), "meteo")[-1] == "a"


def test_column_without_values_takes_default(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, port_casque string")
    assert column(I.fill_mode(df, ["port_casque"], "Non"), "port_casque") == ["Non", "Non"]


def test_group_mode(spark):
    rows = [(1, "X", None), (2, "Y", "Dégradé"), (3, "Y", None), (4, None, None), (5, None, "Bon")]
    df = spark.createDataFrame(rows, "id int, region string, etat_route string")
    filled = I.fill_group_mode(df, "etat_route", "region", "Bon")
    assert column(filled, "etat_route") == ["Bon", "Dégradé", "Dégradé", None, None]


def test_group_median(spark):
    rows = [(1, "a", 1.0), (2, "a", 4.0), (3, "a", None), (4, "b", None)]
    df = spark.createDataFrame(rows, "id int, type_route string, vitesse_estimee double")
    assert column(I.fill_group_median(df, "vitesse_estimee", "type_route"), "vitesse_estimee") == [1.0, 4.0, 2.5, None]


def test_floor(spark):
    df = spark.createDataFrame([(1, None), (2, -2.0), (3, 4.0)], "id int, nombre_victimes double")
    assert column(I.fill_floor(df, "nombre_victimes"), "nombre_victimes") == [1.0, 0.0, 4.0]


def test_filters(spark):
    rows = [(1, dt.date(2021, 12, 31), "A"), (2, dt.date(2022, 1, 1), "A"), (3, dt.date(2023, 12, 31), "B"), (4, dt.date(2024, 1, 1), "B")]
    df = spark.createDataFrame(rows, "id int, date_accident date, region string")
    assert column(C.filter_incidents(df, years=(2022, 2023)), "id") == [2, 3]
    assert column(C.filter_incidents(df, severities=[], regions=["B"]), "id") == [3, 4]
    assert C.filter_incidents(df).count() == 4


@pytest.fixture(scope="module")
def cleaned(spark, sf_dir):
    return clean(spark, sf_dir).persist()


def test_clean_table_has_one_row_per_id(cleaned):
    assert cleaned.count() == cleaned.select("accident_id").distinct().count()


def test_clean_table_has_no_gaps_or_bad_values(cleaned):
    row = cleaned.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cleaned.columns],
        F.count_if(F.col("nombre_deces") > F.col("nombre_victimes")).alias("incoherent"),
        F.count_if(F.col("cout_estime") < 0).alias("negative"),
        F.count_if(~F.col("heure").between(0, 23)).alias("bad_hour"),
    ).first()
    assert set(row) == {0}
    assert len(cleaned.columns) == 30


def test_row_repairs_change_nothing_the_second_time(spark, sf_dir):
    once = C.repair_rows(incidents(spark, sf_dir, tie_key=True))
    assert once.exceptAll(C.repair_rows(once)).count() == 0


def test_partitioning_does_not_matter(spark, sf_dir, cleaned):
    other = clean_incidents(incidents(spark, sf_dir, tie_key=True).repartition(7), TIE_KEY, drop=TIE_KEY)
    assert other.exceptAll(cleaned).count() == 0
    assert other.count() == cleaned.count()


def test_sketches_stay_close(spark, sf_dir):
    exact, sketch = (
        run_cleaning(incidents(spark, sf_dir, tie_key=True), TIE_KEY, drop=TIE_KEY, accuracy=a) for a in (None, 10_000)
    )
    assert exact.columns == sketch.columns and exact.count() == sketch.count()
    top = [df.agg(F.max("cout_estime").alias("m")).first()["m"] for df in (exact, sketch)]
    assert top[0] == pytest.approx(top[1], rel=0.01)


def files_under(folder):
    import os

    return [os.path.join(at, f) for at, _, names in os.walk(folder) for f in names]


def test_slices_hold_every_row_once(spark, sf_dir, cleaned, monkeypatch):
    from hazardframe.functions import joins as J
    from hazardframe.operators.quality import before_after

    raw = incidents(spark, sf_dir, tie_key=True)
    written = []
    keep = J._stored
    monkeypatch.setattr(J, "_stored", lambda parts, name: written.append((name, len(parts))) or keep(parts, name))
    monkeypatch.setattr(J, "SLICE_BYTES", J.slices_of(raw) and 100_000)
    assert J.slices_of(raw) > 1
    sliced = clean_incidents(raw, TIE_KEY, drop=TIE_KEY)
    assert {name: n > 1 for name, n in written}["repaired"] and dict(written)["coherent"] > 1
    assert sliced.exceptAll(cleaned).count() == 0 and sliced.count() == cleaned.count()
    assert before_after(raw.drop(*TIE_KEY), cleaned).first()["rows_raw"] == raw.count()


def test_rows_without_an_id_are_in_a_slice(spark):
    from hazardframe.functions.joins import store_sliced

    df = spark.range(50).select(F.when(F.col("id") % 3 != 0, F.col("id")).alias("k"), (F.col("id") % 7).alias("v"))
    stored = store_sliced(df, "sliced", "k", 4)
    assert stored.exceptAll(df).count() == 0 and stored.count() == 50


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import time

    from hazardframe.functions.joins import store

    jsc = spark.sparkContext._jsc.sc()
    folders = [str(d) for d in jsc.env().blockManager().diskBlockManager().localDirs()]
    shuffles = lambda: {f for d in folders for f in files_under(d) if "/shuffle_" in f}
    before = shuffles()
    store(spark.range(1000).withColumn("k", F.col("id") % 13).repartition(4, "k"), "shuffled")
    for _ in range(20):
        if shuffles() <= before:
            break
        time.sleep(0.25)
    assert shuffles() <= before
