"""The analytical reports. Each is one hash aggregation, plus a window over its few result rows.

Result column names are those of the published reports. ``taux_mortalite`` is
deaths per 100 incidents, except in ``protection_impact``, where it is the
share of fatal incidents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions.joins import attach
from hazardframe.functions.ordered import counted, known, mean_of_counts, quantiles, quantiles_of_counts
from hazardframe.functions.scalar import (
    deaths_per_100,
    mapped,
    mean,
    n_rows,
    per_100,
    severity_position,
    share,
)
from hazardframe.roles import FATAL, INCIDENT, NIGHT, SERIOUS, SEVERITIES, WEEKDAYS, Roles


def _total(c: str, name: str) -> Column:
    return F.sum(c).alias(name)


def _percent_of(*keys: str, count: str = "nb_accidents") -> Column:
    """Percent of the total per key. It runs over result rows, which are few: one per group."""
    return F.round(per_100(F.col(count), F.sum(count).over(Window.partitionBy(*keys))), 2)


def _scaled_sum(c: Column | str, unit: float, digits: int) -> Column:
    return F.round(F.sum(c) / F.lit(unit), digits)


def kpis(df: DataFrame, r: Roles = INCIDENT, rsd: float | None = None) -> DataFrame:
    """Global key figures. ``rsd`` swaps the exact distinct counts for sketches."""
    distinct = (lambda c: F.approx_count_distinct(c, rsd)) if rsd else F.count_distinct
    # Group by the counted columns first: what is left for the distinct counts is small.
    places = [r.region, r.town, r.road]
    groups = df.groupBy(*places).agg(
        n_rows().alias("_n"),
        _total(r.deaths, "_deaths"),
        _total(r.victims, "_victims"),
        F.count(r.victims).alias("_known_victims"),
        _total(r.cost, "_cost"),
        F.count(r.cost).alias("_known_costs"),
        F.min(r.date).alias("_first"),
        F.max(r.date).alias("_last"),
    )
    total = {c: F.sum(c) for c in groups.columns[3:]}
    mean_victims = F.try_divide(total["_victims"], total["_known_victims"])
    mean_cost = F.try_divide(total["_cost"], total["_known_costs"])
    return groups.agg(
        F.coalesce(total["_n"], F.lit(0)).alias("total_accidents"),
        total["_deaths"].alias("total_deces"),
        total["_victims"].alias("total_victimes"),
        F.round(mean_victims, 2).alias("moy_victimes_par_accident"),
        F.round(per_100(total["_deaths"], total["_n"]), 2).alias("taux_mortalite_pct"),
        F.round(mean_cost / F.lit(1e6), 3).alias("cout_moyen_MFCFA"),
        (total["_cost"] / F.lit(1e9)).alias("cout_total_GFCFA"),
        F.min("_first").alias("date_debut"),
        F.max("_last").alias("date_fin"),
        distinct(F.col(r.region)).alias("nb_regions"),
        distinct(F.col(r.town)).alias("nb_villes"),
        distinct(F.col(r.road)).alias("nb_axes_routiers"),
    )


def by_severity(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    grouped = df.groupBy(r.severity).agg(
        n_rows().alias("nb_accidents"),
        _total(r.victims, "total_victimes"),
        _total(r.deaths, "total_deces"),
        mean(r.cost, 0).alias("cout_moyen_FCFA"),
    )
    return grouped.select(
        r.severity,
        "nb_accidents",
        _percent_of().alias("pct"),
        "total_victimes",
        "total_deces",
        "cout_moyen_FCFA",
    ).orderBy(severity_position(r.severity), r.severity)


def yearly_trend(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(F.year(r.date).alias("annee"))
        .agg(
            n_rows().alias("nb_accidents"),
            _total(r.deaths, "deces"),
            deaths_per_100(r.deaths).alias("taux_mortalite"),
            mean(r.speed, 1).alias("vitesse_moyenne"),
            _scaled_sum(r.cost, 1e6, 1).alias("cout_total_MFCFA"),
        )
        .orderBy("annee")
    )


def by_hour(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    grouped = df.groupBy(r.hour).agg(
        n_rows().alias("nb_accidents"),
        _total(r.deaths, "deces"),
        deaths_per_100(r.deaths).alias("taux_mortalite"),
    )
    return grouped.withColumn("pct_total", _percent_of()).orderBy(r.hour)


def by_weekday(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    order = {day: i + 1 for i, day in enumerate(WEEKDAYS)}
    return (
        df.groupBy(r.weekday)
        .agg(
            n_rows().alias("nb_accidents"),
            _total(r.deaths, "deces"),
            deaths_per_100(r.deaths).alias("taux_mortalite"),
            mean(r.cost, 0).alias("cout_moyen"),
        )
        .withColumn("ordre", mapped(r.weekday, order))
        .orderBy("ordre")
    )


def hour_by_weekday(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(r.hour, r.weekday)
        .agg(n_rows().alias("nb_accidents"), deaths_per_100(r.deaths).alias("taux_mortalite"))
        .orderBy(r.hour, r.weekday)
    )


def by_holiday(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return df.groupBy(r.holiday).agg(
        n_rows().alias("nb_accidents"),
        deaths_per_100(r.deaths).alias("taux_mortalite"),
        mean(r.speed, 1).alias("vitesse_moyenne"),
        mean(r.cost, 0).alias("cout_moyen"),
    )


def top_regions(df: DataFrame, n: int = 5, r: Roles = INCIDENT) -> DataFrame:
    """Regions by death rate. The percentage is over all regions, taken before the limit."""
    grouped = df.groupBy(r.region).agg(
        n_rows().alias("nb_accidents"),
        _total(r.deaths, "deces"),
        _total(r.victims, "victimes"),
        deaths_per_100(r.deaths).alias("taux_mortalite"),
        mean(r.speed, 1).alias("vitesse_moy"),
        _scaled_sum(r.cost, 1e6, 1).alias("cout_total_MFCFA"),
    )
    return (
        grouped.withColumn("pct_accidents", _percent_of())
        .orderBy(F.desc("taux_mortalite"), r.region)
        .limit(n)
    )


def top_towns(df: DataFrame, n: int = 10, r: Roles = INCIDENT) -> DataFrame:
    """Towns by number of incidents, with the mean position in place of a coordinate check."""
    return (
        df.groupBy(r.town, r.region)
        .agg(
            n_rows().alias("nb_accidents"),
            _total(r.deaths, "deces"),
            deaths_per_100(r.deaths).alias("taux_mortalite"),
            mean(r.lat, 4).alias("mean_lat"),
            mean(r.lon, 4).alias("mean_lon"),
        )
        .orderBy(F.desc("nb_accidents"), r.town, r.region)
        .limit(n)
    )


def top_roads(df: DataFrame, n: int = 10, min_n: int = 50, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(r.road)
        .agg(
            n_rows().alias("nb_accidents"),
            _total(r.deaths, "deces"),
            deaths_per_100(r.deaths).alias("taux_mortalite"),
            mean(r.speed, 1).alias("vitesse_moy"),
            F.count_distinct(r.town).alias("nb_villes_touchees"),
        )
        .where(F.col("nb_accidents") >= min_n)
        .orderBy(F.desc("deces"), r.road)
        .limit(n)
    )


def causes_by_severity(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    grouped = df.groupBy(r.cause, r.severity).agg(n_rows().alias("nb_accidents"))
    return grouped.withColumn(
        "pct_dans_gravite", _percent_of(r.severity)
    ).orderBy(r.cause, r.severity)


def cause_severity_pivot(
    df: DataFrame, severities: Sequence[str] = tuple(SEVERITIES), fill: int | None = None, r: Roles = INCIDENT
) -> DataFrame:
    """Causes as rows, severities as columns; an absent pair is NULL, or ``fill``."""
    wide = df.groupBy(r.cause).pivot(r.severity, list(severities)).agg(n_rows())
    if fill is not None:
        wide = wide.fillna(fill, list(severities))
    return wide.orderBy(F.desc_nulls_last(FATAL), r.cause)


def speed_profile(df: DataFrame, r: Roles = INCIDENT, accuracy: int | None = None) -> DataFrame:
    keys = [r.severity, r.road_type]
    grouped = df.groupBy(*keys).agg(
        mean(r.speed, 1).alias("vitesse_moy"),
        F.round(F.stddev(r.speed), 1).alias("vitesse_std"),
        mean(F.col(r.speed) - F.col(r.limit), 1).alias("exces_moy"),
        mean(r.limit, 0).alias("limitation_moy"),
        n_rows().alias("nb_accidents"),
    )
    middle = quantiles(df, keys, r.speed, {"_median": 0.5}, accuracy)
    return (
        attach(grouped, middle, keys, ["_median"])
        .select(
            *keys,
            "vitesse_moy",
            F.round("_median", 1).alias("vitesse_mediane"),
            "vitesse_std",
            "exces_moy",
            "limitation_moy",
            "nb_accidents",
        )
        .orderBy(*keys)
    )


def protection_impact(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    severity = F.col(r.severity)
    return (
        df.groupBy(r.helmet, r.belt)
        .agg(
            n_rows().alias("nb_accidents"),
            share(severity == FATAL, 2).alias("taux_mortalite"),
            share(severity == SERIOUS, 2).alias("taux_grave"),
            mean(r.cost, 0).alias("cout_moyen"),
        )
        .orderBy(F.desc("taux_mortalite"), r.helmet, r.belt)
    )


def cause_share_by_hour(df: DataFrame, value: str = "Alcool", r: Roles = INCIDENT) -> DataFrame:
    hit = F.col(r.cause) == value
    return (
        df.groupBy(r.hour)
        .agg(
            n_rows().alias("total_accidents"),
            F.count_if(hit).alias("accidents_alcool"),
            share(hit, 2).alias("pct_alcool"),
        )
        .orderBy(r.hour)
    )


def cost_by_region(df: DataFrame, r: Roles = INCIDENT, accuracy: int | None = None) -> DataFrame:
    """Totals and mean from the counted costs that also give the median: the rows are read once."""
    counts = counted(df, [r.region], r.cost)
    cost, n = F.col("value"), F.col("n")
    grouped = counts.groupBy(r.region).agg(
        F.sum(n).alias("nb_accidents"),
        _scaled_sum(cost * n, 1e6, 1).alias("cout_total_MFCFA"),
        F.round(mean_of_counts(), 0).alias("cout_moyen_FCFA"),
        F.round(F.max(cost.cast("double")), 0).alias("cout_max_FCFA"),
    )
    middle = _cuts(df, counts, [r.region], r.cost, {"_median": 0.5}, accuracy)
    return (
        attach(grouped, middle, [r.region], ["_median"])
        .withColumn("cout_median_FCFA", F.round("_median", 0))
        .drop("_median")
        .orderBy(F.desc("cout_total_MFCFA"), r.region)
    )


def _cuts(
    df: DataFrame, counts: DataFrame, keys: list[str], value: Column | str, marks: dict[str, float], accuracy: int | None
) -> DataFrame:
    """Quantiles from counted values, or from sketches of the rows with ``accuracy``."""
    if accuracy is None:
        return quantiles_of_counts(known(counts), keys, marks)
    return quantiles(df, keys, value, marks, accuracy)


def cost_by_cause(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(r.cause)
        .agg(
            n_rows().alias("nb_accidents"),
            _scaled_sum(r.cost, 1e6, 2).alias("cout_total_MFCFA"),
            mean(r.cost, 0).alias("cout_moyen"),
            deaths_per_100(r.deaths).alias("taux_mortalite"),
        )
        .orderBy(F.desc("cout_total_MFCFA"), r.cause)
    )


def yearly_cost(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(F.year(r.date).alias("annee"))
        .agg(
            _scaled_sum(r.cost, 1e9, 3).alias("cout_total_GFCFA"),
            F.round(F.avg(r.cost) / F.lit(1e6), 3).alias("cout_moyen_MFCFA"),
            n_rows().alias("nb_accidents"),
        )
        .orderBy("annee")
    )


def by_vehicle(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    grouped = df.groupBy(r.vehicle).agg(
        n_rows().alias("nb_accidents"),
        _total(r.victims, "total_victimes"),
        _total(r.deaths, "total_deces"),
        deaths_per_100(r.deaths).alias("taux_mortalite"),
        mean(r.victims, 2).alias("moy_victimes"),
        mean(r.speed, 1).alias("vitesse_moy"),
    )
    return grouped.withColumn("pct_total", _percent_of()).orderBy(
        F.desc("taux_mortalite"), r.vehicle
    )


def running_deaths(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Monthly deaths with the running total of the year and a three-row moving mean of incidents.

    A month without incidents has no row, and both frames restart each year.
    """
    monthly = df.groupBy(F.year(r.date).alias("annee"), F.month(r.date).alias("mois")).agg(
        _total(r.deaths, "deces_mois"), n_rows().alias("accidents_mois")
    )
    months = Window.partitionBy("annee").orderBy("mois")
    return monthly.select(
        "*",
        F.sum("deces_mois").over(months.rowsBetween(Window.unboundedPreceding, 0)).alias("deces_cumul"),
        F.round(F.avg("accidents_mois").over(months.rowsBetween(-2, 0)), 1).alias("moy_mobile_3mois"),
    ).orderBy("annee", "mois")


def top_night_zones(df: DataFrame, n: int = 10, min_n: int = 100, r: Roles = INCIDENT) -> DataFrame:
    night = F.col(r.light) == NIGHT
    grouped = df.groupBy(r.town, r.region).agg(
        F.count_if(night).alias("accidents_nuit"),
        n_rows().alias("total_accidents"),
        F.sum(F.when(night, F.col(r.deaths))).alias("_deaths"),
    )
    return (
        grouped.where(F.col("total_accidents") >= min_n)
        .select(
            r.town,
            r.region,
            "accidents_nuit",
            "total_accidents",
            F.round(per_100(F.col("accidents_nuit"), F.col("total_accidents")), 2).alias("pct_nuit"),
            F.round(per_100(F.col("_deaths"), F.col("accidents_nuit")), 2).alias("taux_mortalite_nuit"),
        )
        .orderBy(F.desc("accidents_nuit"), r.town, r.region)
        .limit(n)
    )


def excess_speed_by_severity(df: DataFrame, r: Roles = INCIDENT, accuracy: int | None = None) -> DataFrame:
    """Mean, quartiles and ninth decile from the counted excess: the rows are read once."""
    excess = F.col(r.speed) - F.col(r.limit)
    counts = counted(df, [r.severity], excess)
    grouped = counts.groupBy(r.severity).agg(F.round(mean_of_counts(), 2).alias("exces_moy"), F.sum("n").alias("n"))
    marks = {"q25": 0.25, "mediane": 0.5, "q75": 0.75, "p90": 0.9}
    cuts = _cuts(df, counts, [r.severity], excess, marks, accuracy).drop("n")
    return (
        attach(grouped, cuts, [r.severity], list(marks))
        .select(r.severity, "exces_moy", *[F.round(q, 1).alias(q) for q in marks], "n")
        .orderBy(severity_position(r.severity), r.severity)
    )


def full_report(df: DataFrame, r: Roles = INCIDENT) -> dict[str, DataFrame]:
    """The eleven headline reports, lazily; persist or write ``df`` first if all are wanted."""
    return {
        "kpi_globaux": kpis(df, r),
        "gravite": by_severity(df, r),
        "tendance_annuelle": yearly_trend(df, r),
        "accidents_par_heure": by_hour(df, r),
        "top_regions": top_regions(df, r=r),
        "top_axes": top_roads(df, r=r),
        "causes_gravite": causes_by_severity(df, r),
        "analyse_vitesse": speed_profile(df, r),
        "impact_epi": protection_impact(df, r),
        "cout_region": cost_by_region(df, r),
        "risque_vehicule": by_vehicle(df, r),
    }
