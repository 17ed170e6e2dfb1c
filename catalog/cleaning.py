"""Cleaning and imputation steps, one by one and as a whole."""

import uuid

from pyspark.sql import functions as F

from catalog.relations import on_clean, on_repaired, raw, repaired
from hazardframe.functions.scalar import severity_position
from hazardframe.operators import clean as C
from hazardframe.operators import impute as I
from hazardframe.operators import reports as R
from hazardframe.session import shared_dir
from hazardframe.sources.tables import least_repair, read_table, save_table
from hazardframe.sources.testbed import TIE_KEY


def _on_raw(operator, columns, **options):
    return lambda spark, sf_dir: operator(raw(spark, sf_dir, columns), **options)


def coerce_dates(spark, sf_dir):
    """Dates arrive as text, some of them unreadable."""
    df = raw(spark, sf_dir, "accident_id date_accident", tie_key=True)
    text = F.when(F.col("l_suppkey") % 10 == 3, "not a date").otherwise(F.col("date_accident").cast("string"))
    return C.coerce_dates(df.select("accident_id", text.alias("date_accident")))


def dedup_first(spark, sf_dir):
    df = raw(spark, sf_dir, "accident_id cout_estime", tie_key=True)
    return C.keep_first(df, TIE_KEY).select("accident_id", "l_partkey", "l_suppkey", "cout_estime")


def severity_label_order(spark, sf_dir):
    """CASE ordering of labels; the number is the place in that order."""
    counts = repaired(spark, sf_dir, "gravite").groupBy("gravite").agg(F.count(F.lit(1)).alias("nb"))
    return counts.select("gravite", severity_position("gravite").alias("position"), "nb").orderBy("position")


WRITTEN = "accident_id date_accident heure region nombre_victimes cout_estime port_casque"


def csv_round_trip(spark, sf_dir):
    """Written as CSV with columns in another order, found again by name and type."""
    df = raw(spark, sf_dir, WRITTEN)
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}.csv"
    save_table(df.select(*reversed(df.columns)), path, fmt="csv")
    return read_table(spark, path, df.schema)


def parquet_round_trip(spark, sf_dir):
    """Written as Parquet by region, read again with narrowed types."""
    df = raw(spark, sf_dir, "accident_id heure semestre nombre_vehicules nombre_deces limitation_vitesse region")
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}.parquet"
    save_table(C.narrow_types(df), path, partition_by=("region",))
    return read_table(spark, path).select(*df.columns)


QUERIES = {
    "csv_round_trip": csv_round_trip,
    "parquet_round_trip": parquet_round_trip,
    "trim_text": _on_raw(C.trim_strings, "accident_id port_casque port_ceinture"),
    "coerce_dates": coerce_dates,
    "wrap_hours": _on_raw(C.wrap_hours, "accident_id heure"),
    "clip_speed": _on_raw(C.clip_speed, "accident_id vitesse_estimee"),
    "negative_cost_to_median": on_repaired(C.repair_negative_cost, "accident_id cout_estime"),
    "standardise_binary": _on_raw(
        C.standardise_binary, "accident_id port_casque port_ceinture accident_fete"
    ),
    "dedup_first": dedup_first,
    "drop_incoherent": _on_raw(C.drop_incoherent, "accident_id nombre_deces nombre_victimes"),
    "cap_cost": _on_raw(C.cap_cost, "accident_id cout_estime"),
    "encode_severity": _on_raw(C.encode_severity, "accident_id gravite"),
    "filter_incidents": on_repaired(
        C.filter_incidents,
        "accident_id date_accident region gravite type_vehicule periode_journaliere",
        years=(1996, 1998),
        regions=["ASIA", "EUROPE"],
        severities=["Grave", "Mortel"],
        vehicles=["BUILDING", "MACHINERY"],
        periods=[],
    ),
    "severity_label_order": severity_label_order,
    "fill_mode": on_repaired(
        I.fill_mode,
        "accident_id meteo port_casque port_ceinture",
        columns=["meteo", "port_casque", "port_ceinture"],
        default="Non",
    ),
    "fill_constant": on_repaired(I.fill_constant, "accident_id cause", values={"cause": "Inconnue"}),
    "fill_group_mode": on_repaired(
        I.fill_group_mode, "accident_id region etat_route", column="etat_route", by="region", default="Bon"
    ),
    "fill_group_median": on_repaired(
        I.fill_group_median, "accident_id type_route vitesse_estimee", column="vitesse_estimee", by="type_route"
    ),
    "fill_floor": on_repaired(I.fill_floor, "accident_id nombre_victimes", column="nombre_victimes"),
    "fill_median": on_repaired(
        I.fill_median, "accident_id intervention_secours", column="intervention_secours"
    ),
    "least_repair": _on_raw(least_repair, "accident_id heure vitesse_estimee"),
    "clean_incidents": on_clean(lambda df: df),
    # The capped costs are fractions, so their sum depends on the order of adding.
    "kpis_of_clean": on_clean(
        lambda df: R.kpis(df).withColumn("cout_total_GFCFA", F.round("cout_total_GFCFA", 6))
    ),
    "top_regions_of_clean": on_clean(R.top_regions),
    "speed_profile_of_clean": on_clean(R.speed_profile),
}
