"""The analytical reports over the row-repaired table."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.relations import on_repaired, repaired
from hazardframe.functions.joins import store
from hazardframe.operators import reports as R
from hazardframe.session import shared_dir
from hazardframe.sources.tables import CSV_READ, export_reports, load_json, query, read_table, save_json, typed

VIEW_SQL = """
SELECT region, type_route, count(*) AS n, sum(nombre_deces) AS deces
FROM accidents WHERE heure BETWEEN 18 AND 23 GROUP BY region, type_route
"""


def scan_table(spark, sf_dir):
    """A Parquet file read by its suffix, whole."""
    lines = read_table(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.max("l_orderkey").alias("last_order")
    )


BUNDLE = " ".join(dict.fromkeys(
    "nombre_deces nombre_victimes cout_estime date_accident region ville axe_routier gravite vitesse_estimee heure cause "
    "type_route limitation_vitesse port_casque port_ceinture type_vehicule".split()))  # fmt: skip


def full_report(spark, sf_dir):
    """Rows and columns of every report of the bundle."""
    reports = R.full_report(store(repaired(spark, sf_dir, BUNDLE), "repaired"))
    sizes = [df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")) for name, df in reports.items()]
    return reduce(DataFrame.unionByName, sizes)


def report_export(spark, sf_dir):
    """The bundle written as one CSV per report; the region report as read back."""
    path = f"{shared_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    reports = R.full_report(store(repaired(spark, sf_dir, BUNDLE), "repaired"))
    export_reports(reports, path)
    name = "top_regions"
    return typed(spark.read.csv(f"{path}/{name}", **CSV_READ), reports[name].schema)


def json_round_trip(spark, sf_dir):
    """Numbers of incidents and deaths by severity, written as a JSON report and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    rows = repaired(spark, sf_dir, "gravite nombre_deces").groupBy("gravite").agg(F.count(F.lit(1)).alias("n"), F.sum("nombre_deces").alias("deces"))
    save_json(spark, {row["gravite"]: {"n": row["n"], "deces": row["deces"]} for row in rows.collect()}, path)  # a row per severity
    found = [(name, v["n"], v["deces"]) for name, v in load_json(spark, path).items()]
    return spark.createDataFrame(found, "gravite string, n long, deces long")


QUERIES = {
    "full_report": full_report,
    "report_export": report_export,
    "json_round_trip": json_round_trip,
    "scan_table": scan_table,
    "sql_view": on_repaired(query, "region type_route nombre_deces heure", sql=VIEW_SQL),
    "kpis": on_repaired(
        R.kpis, "nombre_deces nombre_victimes cout_estime date_accident region ville axe_routier"
    ),
    "by_severity": on_repaired(R.by_severity, "gravite nombre_victimes nombre_deces cout_estime"),
    "yearly_trend": on_repaired(R.yearly_trend, "date_accident nombre_deces vitesse_estimee cout_estime"),
    "by_hour": on_repaired(R.by_hour, "heure nombre_deces"),
    "by_weekday": on_repaired(R.by_weekday, "jour_semaine nombre_deces cout_estime"),
    "hour_by_weekday": on_repaired(R.hour_by_weekday, "heure jour_semaine nombre_deces"),
    "by_holiday": on_repaired(R.by_holiday, "accident_fete nombre_deces vitesse_estimee cout_estime"),
    "top_regions": on_repaired(
        R.top_regions, "region nombre_deces nombre_victimes vitesse_estimee cout_estime"
    ),
    "top_towns": on_repaired(R.top_towns, "ville region nombre_deces latitude longitude"),
    "top_roads": on_repaired(R.top_roads, "axe_routier nombre_deces vitesse_estimee ville"),
    "causes_by_severity": on_repaired(R.causes_by_severity, "cause gravite"),
    "cause_severity_pivot": on_repaired(R.cause_severity_pivot, "cause gravite"),
    "cause_severity_pivot_filled": on_repaired(R.cause_severity_pivot, "cause gravite", fill=0),
    "speed_profile": on_repaired(
        R.speed_profile, "gravite type_route vitesse_estimee limitation_vitesse"
    ),
    "protection_impact": on_repaired(
        R.protection_impact, "port_casque port_ceinture gravite cout_estime"
    ),
    "cause_share_by_hour": on_repaired(R.cause_share_by_hour, "heure cause"),
    "cost_by_region": on_repaired(R.cost_by_region, "region cout_estime"),
    "cost_by_cause": on_repaired(R.cost_by_cause, "cause cout_estime nombre_deces"),
    "yearly_cost": on_repaired(R.yearly_cost, "date_accident cout_estime"),
    "by_vehicle": on_repaired(
        R.by_vehicle, "type_vehicule nombre_victimes nombre_deces vitesse_estimee"
    ),
    "running_deaths": on_repaired(R.running_deaths, "date_accident nombre_deces"),
    "top_night_zones": on_repaired(R.top_night_zones, "ville region luminosite nombre_deces"),
    "excess_speed_by_severity": on_repaired(
        R.excess_speed_by_severity, "gravite vitesse_estimee limitation_vitesse"
    ),
}
