"""The small aggregate behind each chart, map and card. Drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions.joins import attach
from hazardframe.functions.ordered import quantiles
from hazardframe.functions.scalar import band, n_rows, per_100, share
from hazardframe.operators.features import excess_speed
from hazardframe.roles import FATAL, INCIDENT, NIGHT, NO, SERIOUS, SEVERITIES, WEEKDAYS, Roles


def _total_pct(count: str = "n", *keys: str) -> Column:
    """Percent of the total of ``count``; runs over result rows only."""
    return F.round(per_100(F.col(count), F.sum(count).over(Window.partitionBy(*keys))), 2)


def counts(df: DataFrame, *keys: str, top: int | None = None) -> DataFrame:
    """Rows per combination of keys, most frequent first; optionally the ``top`` of them."""
    grouped = df.groupBy(*keys).agg(n_rows().alias("n")).orderBy(F.desc("n"), *keys)
    return grouped.limit(top) if top else grouped


def matrix(
    df: DataFrame, row: str, column: str, domain: Sequence[str], fill: int | None = 0
) -> DataFrame:
    """Counts with ``row`` down and the known ``domain`` of ``column`` across."""
    wide = df.groupBy(row).pivot(column, list(domain)).agg(n_rows())
    if fill is not None:
        wide = wide.fillna(fill, list(domain))
    return wide.orderBy(row)


def severity_distribution(df: DataFrame, fill: int | None = 0, r: Roles = INCIDENT) -> DataFrame:
    """Every severity in fixed order with count and percentage; an absent one has ``fill``."""
    one_row = df.agg(*[F.count_if(F.col(r.severity) == s).alias(s) for s in SEVERITIES])
    long = one_row.unpivot([], SEVERITIES, r.severity, "n")
    pct = _total_pct()
    found = F.when(F.col("n") > 0, F.col("n"))
    return long.select(r.severity, F.coalesce(found, F.lit(fill).cast("long")).alias("n"), pct.alias("pct"))


def hour_weekday_matrix(df: DataFrame, fill: int | None = 0, r: Roles = INCIDENT) -> DataFrame:
    return matrix(df, r.hour, r.weekday, WEEKDAYS, fill)


def hourly_rate(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return _deaths_by(df, r.hour, r).orderBy(r.hour)


def _deaths_by(df: DataFrame, key: str, r: Roles, digits: int = 2) -> DataFrame:
    return df.groupBy(key).agg(
        n_rows().alias("n"),
        F.sum(r.deaths).alias("deces"),
        F.round(per_100(F.sum(r.deaths), n_rows()), digits).alias("taux"),
    )


def fatal_share_by(df: DataFrame, *keys: str, digits: int = 2, r: Roles = INCIDENT) -> DataFrame:
    """Incidents, fatal incidents and the fatal share per group."""
    fatal = F.col(r.severity) == FATAL
    return df.groupBy(*keys).agg(
        n_rows().alias("nb"), F.count_if(fatal).alias("mortel"), share(fatal, digits).alias("pct")
    )


def box_stats(
    df: DataFrame, keys: Sequence[str], value: Column | str, accuracy: int | None = None
) -> DataFrame:
    """Box plot figures per group: quartiles, mean, deviation, Tukey fences, number of outliers."""
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull())
    moments = rows.groupBy(*keys).agg(
        F.count("_v").alias("n"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
        F.round(F.avg("_v"), 6).alias("mean"),
        F.round(F.stddev("_v"), 6).alias("std"),
    )
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    cuts = quantiles(rows, keys, "_v", marks, accuracy)
    boxes = attach(moments, cuts, keys, list(marks))
    iqr = F.col("q3") - F.col("q1")
    boxes = boxes.withColumns(
        {"low_fence": F.col("q1") - 1.5 * iqr, "high_fence": F.col("q3") + 1.5 * iqr}
    )
    values = rows.groupBy(*keys, "_v").agg(n_rows().alias("_n"))
    placed = attach(values, boxes, keys, ["low_fence", "high_fence"])
    beyond = (F.col("_v") < F.col("low_fence")) | (F.col("_v") > F.col("high_fence"))
    outside = placed.groupBy(*keys).agg(F.sum(F.when(beyond, F.col("_n")).otherwise(0)).alias("outliers"))
    return attach(boxes, outside, keys, ["outliers"])


def _unprotected(r: Roles) -> Column:
    return (F.col(r.helmet) == NO) | (F.col(r.belt) == NO)


def region_radar(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Five risk metrics per region and the same scaled to 0..1 between regions, in long form."""
    metrics = {
        "pct_mortel": share(F.col(r.severity) == FATAL),
        "vitesse_moy": F.avg(r.speed),
        "pct_nuit": share(F.col(r.light) == NIGHT),
        "pct_sans_epi": share(_unprotected(r)),
        "pct_pluie": share(F.col(r.weather) == "Pluie"),
    }
    long = _profile(df, r.region, metrics)
    scale = Window.partitionBy("metric")
    low, high = F.min("value").over(scale), F.max("value").over(scale)
    return long.select(
        r.region,
        "metric",
        F.round("value", 6).alias("value"),
        F.round((F.col("value") - low) / (high - low + 1e-10), 6).alias("scaled"),
    )


def vehicle_radar(df: DataFrame, top: int = 5, r: Roles = INCIDENT) -> DataFrame:
    """Five risk metrics of the most frequent vehicles, in long form; mean speed is halved."""
    metrics = {
        "pct_mortel": share(F.col(r.severity) == FATAL),
        "vitesse_moy_2": F.avg(r.speed) / 2,
        "pct_sans_epi": share(_unprotected(r)),
        "pct_nuit": share(F.col(r.light) == NIGHT),
        "pct_exces": share(F.col(r.speed) > F.col(r.limit)),
    }
    known = df.where(F.col(r.vehicle).isNotNull())
    grouped = known.groupBy(r.vehicle).agg(n_rows().alias("_n"), *[m.alias(k) for k, m in metrics.items()])
    frequent = grouped.orderBy(F.desc("_n"), r.vehicle).limit(top)
    long = frequent.unpivot([r.vehicle], list(metrics), "metric", "value")
    return long.withColumn("value", F.round("value", 6))


def _profile(df: DataFrame, key: str, metrics: dict[str, Column]) -> DataFrame:
    wide = df.groupBy(key).agg(*[m.alias(name) for name, m in metrics.items()])
    return wide.unpivot([key], list(metrics), "metric", "value")


def _month(r: Roles) -> Column:
    return F.date_format(r.date, "yyyy-MM").alias("periode")


def monthly_series(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(_month(r))
        .agg(n_rows().alias("accidents"), F.sum(r.deaths).alias("deces"))
        .orderBy("periode")
    )


def monthly_by_severity(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return matrix(df.select(_month(r), r.severity), "periode", r.severity, SEVERITIES)


def cause_severity_flow(df: DataFrame, top: int = 6, r: Roles = INCIDENT) -> DataFrame:
    """Links from the most frequent causes to the severities, with their number of incidents."""
    links = (
        df.where(F.col(r.cause).isNotNull() & F.col(r.severity).isNotNull())
        .groupBy(r.cause, r.severity)
        .agg(n_rows().alias("value"))
    )
    frequent = counts(df.where(F.col(r.cause).isNotNull()), r.cause, top=top)
    return links.join(frequent, r.cause, "left_semi").select(
        F.col(r.cause).alias("source"), F.col(r.severity).alias("target"), "value"
    )


def overview(df: DataFrame, top_causes: int = 6, r: Roles = INCIDENT) -> dict[str, DataFrame]:
    """The panels of the overview figure, lazily."""
    return {
        "severity": severity_distribution(df, r=r),
        "regions": counts(df, r.region),
        "causes": counts(df.where(F.col(r.cause).isNotNull()), r.cause, top=top_causes),
        "hour_by_period": hour_by_period(df, r),
        "speed_by_severity": box_stats(df, [r.severity], r.speed),
    }


def hour_by_period(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return matrix(df, r.hour, r.period, ["Matin", "Après-midi", "Soir", "Nuit"])


def region_bars(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return _deaths_by(df, r.region, r, digits=1).orderBy("n", r.region)


def top_kinds(df: DataFrame, top: int = 6, r: Roles = INCIDENT) -> DataFrame:
    return counts(df.where(F.col(r.kind).isNotNull()), r.kind, top=top)


def yearly_by_severity(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return counts(df.select(F.year(r.date).alias("annee"), r.severity), "annee", r.severity)


def town_table(df: DataFrame, top: int = 15, threshold: float = 10, r: Roles = INCIDENT) -> DataFrame:
    """Towns with most incidents, death rate, and whether the rate is to be highlighted."""
    grouped = df.groupBy(r.town).agg(
        n_rows().alias("accidents"), F.sum(r.deaths).alias("deces"), F.min(r.region).alias("region")
    )
    rate = F.round(per_100(F.col("deces"), F.col("accidents")), 1)
    return (
        grouped.orderBy(F.desc("accidents"), r.town)
        .limit(top)
        .select("*", rate.alias("taux_mort"), (rate > threshold).alias("highlight"))
    )


def protection_bars(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Fatal share per protection pair, its label, the plain mean of the shares, above it or not."""
    known = df.where(F.col(r.helmet).isNotNull() & F.col(r.belt).isNotNull())
    grouped = fatal_share_by(known, r.helmet, r.belt, digits=1, r=r)
    middle = F.avg("pct").over(Window.partitionBy())
    label = F.concat(F.lit("Casque:"), F.col(r.helmet), F.lit(" / Ceinture:"), F.col(r.belt))
    return grouped.select(
        "*",
        label.alias("label"),
        F.round(middle, 4).alias("mean_line"),
        (F.col("pct") > middle).alias("above_mean"),
    ).orderBy(F.desc("pct"), "label")


def cost_by(df: DataFrame, key: str, r: Roles = INCIDENT) -> DataFrame:
    """Total, mean and number of costs per group, also in millions and thousands."""
    return df.groupBy(key).agg(
        F.sum(r.cost).cast("double").alias("total"),
        F.round(F.avg(r.cost), 2).alias("moyen"),
        F.count(r.cost).alias("nb"),
        F.round(F.sum(r.cost) / F.lit(1e6), 1).alias("total_M"),
        F.round(F.avg(r.cost) / F.lit(1e3), 1).alias("mean_K"),
    )


def cause_speed_scatter(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return df.groupBy(r.cause).agg(
        F.round(F.avg(r.speed), 6).alias("vitesse_moy"),
        share(F.col(r.severity) == FATAL, 6).alias("taux_mort"),
        n_rows().alias("n"),
    )


def yearly_cost_line(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return (
        df.groupBy(F.year(r.date).alias("annee"))
        .agg(F.round(F.sum(r.cost) / F.lit(1e9), 6).alias("cout_G"))
        .orderBy("annee")
    )


def hierarchy(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """All nodes of a tree chart: counts at every depth, and the percentage of the parent.

    One aggregation gives the leaves; the subtotals roll up from those.
    """
    leaves = df.groupBy(*levels).agg(n_rows().alias("_n"))
    nodes = leaves.rollup(*levels).agg(F.sum("_n").alias("n"), F.grouping_id().alias("_gid"))
    depth = F.lit(len(levels)) - F.length(F.replace(F.bin("_gid"), F.lit("0"), F.lit("")))
    nodes = nodes.select(*levels, depth.cast("int").alias("depth"), "n")
    parent_keys = [F.when(F.col("depth") > i + 1, F.col(c)).alias(f"_p{i}") for i, c in enumerate(levels)]
    children = nodes.select("*", *parent_keys, (F.col("depth") - 1).alias("_up"))
    parents = nodes.withColumnRenamed("n", "_whole")
    joined = attach(
        children,
        parents,
        [*[f"_p{i}" for i in range(len(levels))], "_up"],
        ["_whole"],
        right_keys=[*levels, "depth"],
    )
    pct = F.round(per_100(F.col("n"), F.coalesce("_whole", "n")), 2)
    return joined.select(*levels, "depth", "n", pct.alias("pct_parent"))


def fatal_share_matrix(
    df: DataFrame, row: str, column: str, domain: Sequence[str], r: Roles = INCIDENT
) -> DataFrame:
    """Fatal share in percent with ``row`` down and ``column`` across."""
    return df.groupBy(row).pivot(column, list(domain)).agg(share(F.col(r.severity) == FATAL, 2)).orderBy(row)


def holiday_comparison(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return df.groupBy(r.holiday).agg(
        n_rows().alias("nb_accidents"),
        share(F.col(r.severity) == FATAL, 2).alias("taux_mortalite"),
        F.round(F.avg(r.speed), 2).alias("vitesse_moy"),
        F.round(F.avg(r.cost), 2).alias("cout_moyen"),
    )


def mean_excess_by_cause(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return df.groupBy(r.cause).agg(F.round(F.avg(excess_speed(r)), 6).alias("exces_moy"))


def kpi_row(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    return df.agg(
        n_rows().alias("total"),
        F.coalesce(F.sum(r.deaths), F.lit(0)).alias("deces"),
        F.coalesce(F.sum(r.victims), F.lit(0.0)).cast("long").alias("victimes"),
        F.coalesce(F.round(per_100(F.sum(r.deaths), n_rows()), 1), F.lit(0.0)).alias("taux"),
        F.coalesce(F.round(F.sum(r.cost) / F.lit(1e9), 6), F.lit(0.0)).alias("cout_G"),
        F.count_distinct(r.region).alias("regions"),
        F.round(F.avg(r.response), 4).alias("intervention_moy"),
    )


def quick_stats(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """The short statistics table: label, value and, for the classes, their percentage."""
    severity = F.col(r.severity)
    values = {
        "total": (n_rows().cast("double"), F.lit(None).cast("double")),
        "mortels": (F.count_if(severity == FATAL).cast("double"), share(severity == FATAL, 1)),
        "graves": (F.count_if(severity == SERIOUS).cast("double"), share(severity == SERIOUS, 1)),
        "legers": (F.count_if(severity == SEVERITIES[0]).cast("double"), share(severity == SEVERITIES[0], 1)),
        "vitesse_moyenne": (F.round(F.avg(r.speed), 0), F.lit(None).cast("double")),
        "cout_moyen_K": (F.round(F.avg(r.cost) / 1e3, 0), F.lit(None).cast("double")),
        "intervention_moyenne": (F.round(F.avg(r.response), 0), F.lit(None).cast("double")),
    }
    one_row = df.agg(*[F.struct(v.alias("value"), p.alias("pct")).alias(k) for k, (v, p) in values.items()])
    return one_row.unpivot([], list(values), "stat", "s").select("stat", "s.value", "s.pct")


def rate_bands(
    df: DataFrame, key: str, cuts: Sequence[float] = (0, 10, 20, 30), r: Roles = INCIDENT
) -> DataFrame:
    """Deaths per 100 incidents of each group and the gauge band it falls into."""
    return _deaths_by(df, key, r).withColumn("band", band("taux", cuts))


