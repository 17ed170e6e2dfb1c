"""Chart frames."""

from pyspark.sql import functions as F

from catalog.relations import on_repaired
from hazardframe.operators import frames as H
from hazardframe.operators import geo as G
from hazardframe.operators.clean import filter_incidents
from hazardframe.operators.stats import kernel_density
from hazardframe.sources.testbed import table


def _counts(*keys, top=None, known=False):
    def run(df):
        return H.counts(df.where(F.col(keys[0]).isNotNull()) if known else df, *keys, top=top)

    return on_repaired(run, " ".join(keys))


def event_hour_weekday(spark, sf_dir):
    """The hour by weekday frame of a second table with real time stamps."""
    events = table(spark, sf_dir, "events")
    parts = events.select(F.hour("ts").alias("heure"), F.date_format("ts", "EEEE").alias("jour_semaine"))
    return H.hour_weekday_matrix(parts)


KPI = "nombre_deces nombre_victimes cout_estime region intervention_secours"
PROTECTION = "port_casque port_ceinture gravite"

QUERIES = {
    "severity_distribution": on_repaired(H.severity_distribution, "gravite"),
    "hour_weekday_matrix": on_repaired(H.hour_weekday_matrix, "heure jour_semaine"),
    "hourly_rate": on_repaired(H.hourly_rate, "heure nombre_deces"),
    "cause_fatal_share": on_repaired(
        lambda df: H.fatal_share_by(df, "cause").orderBy(F.desc("nb"), "cause"), "cause gravite"
    ),
    "speed_box_by_severity": on_repaired(
        H.box_stats, "gravite vitesse_estimee", keys=["gravite"], value="vitesse_estimee"
    ),
    "speed_box_by_severity_and_road": on_repaired(
        H.box_stats,
        "gravite type_route vitesse_estimee",
        keys=["gravite", "type_route"],
        value="vitesse_estimee",
    ),
    "cost_box_by_severity": on_repaired(
        H.box_stats, "gravite cout_estime", keys=["gravite"], value="cout_estime"
    ),
    "speed_density_by_severity": on_repaired(
        kernel_density, "gravite vitesse_estimee", group="gravite", value="vitesse_estimee"
    ),
    "region_radar": on_repaired(
        H.region_radar, "region gravite vitesse_estimee luminosite port_casque port_ceinture meteo"
    ),
    "vehicle_radar": on_repaired(
        H.vehicle_radar,
        "type_vehicule gravite vitesse_estimee limitation_vitesse luminosite port_casque port_ceinture",
    ),
    "monthly_series": on_repaired(H.monthly_series, "date_accident nombre_deces"),
    "monthly_by_severity": on_repaired(H.monthly_by_severity, "date_accident gravite"),
    "cause_severity_flow": on_repaired(H.cause_severity_flow, "cause gravite"),
    "region_counts": _counts("region"),
    "top_causes": _counts("cause", top=6, known=True),
    "hour_by_period": on_repaired(H.hour_by_period, "heure periode_journaliere"),
    "region_bars": on_repaired(H.region_bars, "region nombre_deces"),
    "top_kinds": on_repaired(H.top_kinds, "type_accident"),
    "yearly_by_severity": on_repaired(H.yearly_by_severity, "date_accident gravite"),
    "town_table": on_repaired(H.town_table, "ville region nombre_deces"),
    "cause_by_severity": _counts("cause", "gravite"),
    "protection_bars": on_repaired(H.protection_bars, PROTECTION),
    "weather_by_severity": _counts("meteo", "gravite"),
    "cost_by_region_frame": on_repaired(H.cost_by, "region cout_estime", key="region"),
    "cost_by_cause_frame": on_repaired(H.cost_by, "cause cout_estime", key="cause"),
    "cause_speed_scatter": on_repaired(H.cause_speed_scatter, "cause vitesse_estimee gravite"),
    "yearly_cost_line": on_repaired(H.yearly_cost_line, "date_accident cout_estime"),
    "region_severity_tree": on_repaired(H.hierarchy, "region gravite", levels=["region", "gravite"]),
    "protection_severity_tree": on_repaired(
        H.hierarchy, PROTECTION, levels=["port_casque", "port_ceinture", "gravite"]
    ),
    "region_road_fatal_matrix": on_repaired(
        H.fatal_share_matrix,
        "region type_route gravite",
        row="region",
        column="type_route",
        domain=["Urbaine", "Interurbaine", "Rurale"],
    ),
    "holiday_comparison": on_repaired(
        H.holiday_comparison, "accident_fete gravite vitesse_estimee cout_estime"
    ),
    "mean_excess_by_cause": on_repaired(
        H.mean_excess_by_cause, "cause vitesse_estimee limitation_vitesse"
    ),
    "scatter_sample": on_repaired(
        G.points,
        "accident_id latitude longitude gravite heure vitesse_estimee intervention_secours type_route",
        n=3000,
        columns=["heure", "vitesse_estimee", "intervention_secours", "type_route"],
    ),
    "kpi_row": on_repaired(H.kpi_row, KPI),
    "kpi_row_filtered_out": on_repaired(
        lambda df: H.kpi_row(filter_incidents(df, years=(2050, 2050))), f"{KPI} date_accident"
    ),
    "quick_stats": on_repaired(
        H.quick_stats, "gravite vitesse_estimee cout_estime intervention_secours"
    ),
    "rate_bands": on_repaired(H.rate_bands, "axe_routier nombre_deces", key="axe_routier", cuts=(0, 50, 65, 80, 100)),
    "event_hour_weekday": event_hour_weekday,
}
