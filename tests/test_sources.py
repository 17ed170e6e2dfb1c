"""Sources and sinks."""

import datetime as dt

import pytest

from hazardframe.operators import reports as R
from hazardframe.plans.cleaning import run_cleaning
from hazardframe.roles import RAW_COLUMNS
from hazardframe.sources import tables as S
from hazardframe.sources.testbed import incidents


@pytest.fixture(scope="module")
def raw(spark, sf_dir):
    return incidents(spark, sf_dir).persist()


def test_csv_round_trip(spark, raw, tmp_path):
    path = str(tmp_path / "raw.csv")
    S.save_table(raw, path, "csv")
    back = S.read_raw(spark, path)
    assert back.columns == RAW_COLUMNS
    # CSV readers trim nothing, so even the dirty flags survive.
    assert back.exceptAll(raw).count() == 0 and back.count() == raw.count()


def test_bad_csv_values_become_null(spark, tmp_path):
    header = ",".join(RAW_COLUMNS)
    row = dict.fromkeys(RAW_COLUMNS, "")
    row |= {"accident_id": "1", "date_accident": "2024-05-06", "heure": "noon"}
    (tmp_path / "bad.csv").write_bytes(("﻿" + header + "\n" + ",".join(row.values()) + "\n").encode())
    got = S.read_raw(spark, str(tmp_path / "bad.csv")).first()
    assert (got["accident_id"], got["date_accident"], got["heure"]) == (1, dt.date(2024, 5, 6), None)


def test_parquet_round_trip_and_suffix_errors(spark, raw, tmp_path):
    path = str(tmp_path / "t.parquet")
    S.save_table(raw, path)
    assert S.read_table(spark, path).count() == raw.count()
    with pytest.raises(FileNotFoundError):
        S.read_table(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "x.feather").write_bytes(b"")
    with pytest.raises(ValueError):
        S.read_table(spark, str(tmp_path / "x.feather"))
    with pytest.raises(ValueError):
        S.save_table(raw, path, "feather")


def test_reports_and_json(spark, raw, tmp_path):
    reports = R.full_report(raw)
    assert len(reports) == 11
    some = {k: reports[k] for k in ("gravite", "top_regions")}
    S.export_reports(some, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/gravite"), header=True).count() == 3
    S.save_json(spark, {"a": 1, "é": [dt.date(2024, 1, 1)]}, str(tmp_path / "doc"))
    assert S.load_json(spark, str(tmp_path / "doc")) == {"a": 1, "é": ["2024-01-01"]}


def test_sql_view(spark, raw, tmp_path):
    assert S.query(raw, "SELECT count(*) AS n FROM accidents").first()["n"] == raw.count()
    S.save_table(raw, str(tmp_path / "t.parquet"))
    assert S.query_path(spark, str(tmp_path / "t.parquet"), "SELECT max(heure) AS h FROM accidents").first()["h"] == 30


def test_raw_fallback(spark, raw, tmp_path):
    S.save_table(raw, str(tmp_path / "raw.csv"), "csv")
    got = S.load_or_repair(spark, str(tmp_path / "clean.parquet"), str(tmp_path / "raw.csv"))
    assert got.where("heure > 23 OR vitesse_estimee IS NULL").count() == 0
    S.save_table(raw.limit(3), str(tmp_path / "clean.parquet"))
    assert S.load_or_repair(spark, str(tmp_path / "clean.parquet"), str(tmp_path / "raw.csv")).count() == 3


def test_sample_is_exact_and_repeatable(spark, raw):
    one = S.sample_rows(raw.dropDuplicates(["accident_id"]), 50, "accident_id")
    two = S.sample_rows(raw.dropDuplicates(["accident_id"]).repartition(3), 50, "accident_id")
    ids = lambda df: sorted(r[0] for r in df.select("accident_id").collect())
    assert ids(one) == ids(two) and len(ids(one)) == 50
    assert S.sample_rows(raw.limit(7), 50, "accident_id").count() == 7


def test_clean_table_is_written_narrow(spark, sf_dir, tmp_path):
    from hazardframe.sources.testbed import TIE_KEY

    raw = incidents(spark, sf_dir, tie_key=True)
    clean = run_cleaning(raw, TIE_KEY, str(tmp_path / "clean.parquet"), drop=TIE_KEY)
    types = dict(clean.dtypes)
    assert (types["heure"], types["gravite_num"], types["limitation_vitesse"]) == ("tinyint", "tinyint", "smallint")
    assert clean.count() > 0


def test_raw_csv_is_read_by_name(spark, tmp_path):
    path = tmp_path / "swapped.csv"
    path.write_text(
        "ville,region,heure,date_accident,vitesse_estimee,accident_id,more\n"
        "Kara,Kpagouda,3.0,2024-01-02,NaN,1,x\nNA,,4.5,2024-01-03,50.5,2,x\n"
    )
    one, two = S.read_raw(spark, str(path)).orderBy("accident_id").collect()
    assert (one.ville, one.region, one.heure, one.vitesse_estimee) == ("Kara", "Kpagouda", 3, None)
    assert (two.ville, two.region, two.heure, two.vitesse_estimee, two.cause) == (None, None, None, 50.5, None)


def test_inferred_csv_has_numbers(spark, tmp_path):
    S.save_table(spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string"), str(tmp_path / "t.csv"), fmt="csv")
    assert [t for _, t in S.read_table(spark, str(tmp_path / "t.csv")).dtypes] == ["int", "double", "string"]
