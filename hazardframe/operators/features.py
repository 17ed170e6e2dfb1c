"""Feature columns: calendar, behaviour, environment, interactions, geography.

All but the geographic ones are row-local projections. Flags count an unknown as 0.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.joins import lookup, materialise
from hazardframe.functions.scalar import clip, flag, mapped, right_closed_bin
from hazardframe.roles import FATAL, INCIDENT, NIGHT, NO, SERIOUS, YES, Roles

# --------------------------------------------------------------------------
# Feature definitions and set membership as published.
# --------------------------------------------------------------------------

RUSH_HOURS = [(7, 9), (17, 20)]
DEEP_NIGHT_FROM, DEEP_NIGHT_TO = 22, 5
RAINY_MONTHS = [3, 4, 5, 6, 7, 10, 11]
RISKY_CAUSES = ["Alcool", "Téléphone", "Fatigue"]
RISKY_WEATHER = ["Pluie", "Brouillard"]
DAMAGED_SURFACE = ["Dégradé", "Très dégradé"]
ROAD_TYPE_ORDER = {"Urbaine": 0, "Interurbaine": 1, "Rurale": 2}
SPEED_ZONE_EDGES = [0, 50, 70, 90, 200]
SPEED_ZONES = ["Zone30-50", "Zone70", "Zone90", "Zone+90"]

PLACE_FEATURES = ["taux_mortalite_region", "taux_mortalite_ville", "nb_accidents_axe", "log_nb_accidents_axe"]
FEATURE_SETS = {
    "temporal": [
        "heure", "heure_sin", "heure_cos", "mois_sin", "mois_cos", "jour_sin", "jour_cos",
        "is_weekend", "is_rush_hour", "is_nuit_profonde", "is_saison_pluies", "semestre",
    ],
    "behavioral": [
        "exces_vitesse", "ratio_vitesse", "score_risque_comportemental", "is_alcool",
        "is_distracteur", "is_fatigue", "is_exces_vitesse", "epi_double", "no_epi",
        "port_casque", "port_ceinture",
    ],
    "environmental": [
        "is_meteo_risque", "is_nuit", "is_crepuscule", "is_route_degradee",
        "score_conditions_env", "type_route_num", "limitation_vitesse",
    ],
    "interaction": [
        "exces_vitesse_nuit", "alcool_nuit", "pluie_route_deg", "victimes_risque", "is_multi_vehicule",
    ],
    "geographic": ["taux_mortalite_region", "taux_mortalite_ville", "log_nb_accidents_axe"],
    "accident": ["nombre_vehicules", "nombre_victimes", "intervention_secours", "accident_fete"],
    "categorical_to_encode": [
        "region", "type_route", "meteo", "luminosite", "type_vehicule", "etat_route",
        "type_accident", "cause", "periode_journaliere", "speed_zone",
    ],
}

# --------------------------------------------------------------------------


def _cycle(value: Column, period: int, name: str) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * value / F.lit(period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def calendar_features(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Calendar parts, cyclic encodings (Monday is day 0) and time flags."""
    hour, month, day = F.col(r.hour), F.month(r.date), F.weekday(r.date)
    rush = F.lit(False)
    for first, last in RUSH_HOURS:
        rush = rush | hour.between(first, last)
    return df.withColumns(
        {
            "annee": F.year(r.date),
            "mois": month,
            "semaine": F.weekofyear(r.date),
            "jour_mois": F.dayofmonth(r.date),
            "trimestre": F.quarter(r.date),
            **_cycle(hour, 24, "heure"),
            **_cycle(month, 12, "mois"),
            **_cycle(day, 7, "jour"),
            "is_weekend": flag(day >= 5),
            "is_rush_hour": flag(rush),
            "is_nuit_profonde": flag((hour >= DEEP_NIGHT_FROM) | (hour <= DEEP_NIGHT_TO)),
            "is_saison_pluies": flag(month.isin(RAINY_MONTHS)),
        }
    )


def excess_speed(r: Roles = INCIDENT) -> Column:
    """Speed above the limit, 0 below it, NULL if the speed is unknown."""
    return clip(F.col(r.speed) - F.col(r.limit), low=0.0)


def behaviour_features(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Speeding, causes and protection, with a risk score of 0..5 in which alcohol counts twice."""
    cause, helmet, belt, limit = (F.col(c) for c in (r.cause, r.helmet, r.belt, r.limit))
    excess = excess_speed(r)
    score = (
        flag(helmet == NO)
        + flag(belt == NO)
        + flag(cause.isin(RISKY_CAUSES))
        + flag(excess > 20)
        + flag(cause == "Alcool")
    )
    return df.withColumns(
        {
            "exces_vitesse": excess,
            "ratio_vitesse": F.col(r.speed) / F.when(limit == 0, 1).otherwise(limit),
            "score_risque_comportemental": score,
            "is_alcool": flag(cause == "Alcool"),
            "is_distracteur": flag(cause == "Téléphone"),
            "is_fatigue": flag(cause == "Fatigue"),
            "is_exces_vitesse": flag(cause == "Excès de vitesse"),
            "epi_double": flag((helmet == YES) & (belt == YES)),
            "no_epi": flag((helmet == NO) & (belt == NO)),
        }
    )


def environment_features(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Weather, light and surface flags, their score of 0..4, road type order and speed zone."""
    flags = {
        "is_meteo_risque": flag(F.col(r.weather).isin(RISKY_WEATHER)),
        "is_nuit": flag(F.col(r.light) == NIGHT),
        "is_crepuscule": flag(F.col(r.light) == "Crépuscule"),
        "is_route_degradee": flag(F.col(r.surface).isin(DAMAGED_SURFACE)),
    }
    return df.withColumns(
        {
            **flags,
            "score_conditions_env": sum(flags.values(), F.lit(0)),
            "type_route_num": mapped(r.road_type, ROAD_TYPE_ORDER, default=1),
            "speed_zone": right_closed_bin(r.limit, SPEED_ZONE_EDGES, SPEED_ZONES),
        }
    )


def interaction_features(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Products of earlier features. ``urgence_intervention`` leaks the target; see ``build_features(leak_free=True)``."""
    severe = flag(F.col(r.severity).isin(SERIOUS, FATAL))
    return df.withColumns(
        {
            "exces_vitesse_nuit": F.col("exces_vitesse") * F.col("is_nuit"),
            "alcool_nuit": F.col("is_alcool") * F.col("is_nuit"),
            "pluie_route_deg": F.col("is_meteo_risque") * F.col("is_route_degradee"),
            "victimes_risque": F.col(r.victims) * F.col("score_risque_comportemental"),
            "is_multi_vehicule": flag(F.col(r.vehicles) > 1),
            "urgence_intervention": F.col(r.response) * severe,
        }
    )


#: The place that stands for all rows in the table of rates.
WHOLE = "all rows"


def place_rates(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """(place, value, fatal_share, incidents): fatal share and known-id count of every region,
    town and road, and of all rows (place ``WHOLE``): one pass.

    Fit it on the training rows only to keep the target out of the features of the others.
    """
    places = {c: F.col(c) for c in (r.region, r.town, r.road)} | {WHOLE: F.lit("")}
    rows = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("place"), v.alias("value")) for c, v in places.items()])).alias("at"),
        (F.col(r.severity) == FATAL).alias("_fatal"),
        F.col(r.id).isNotNull().alias("_known"),
    ).where(F.col("at.value").isNotNull())
    return rows.groupBy("at.place", "at.value").agg(
        (F.count_if("_fatal") / F.count(F.lit(1))).alias("fatal_share"),
        F.count_if("_known").alias("incidents"),
    )


def place_features(df: DataFrame, rates: DataFrame | None = None, r: Roles = INCIDENT) -> DataFrame:
    """Fatal share of the region and the town, number of incidents on the road and its log1p.

    Without ``rates`` they are those of ``df`` itself. With rates fitted on other rows, a region
    or town these do not know has the share of all of them, and a road none of them lies on has
    zero incidents; such rates should be stored, as they are read several times. The tables of
    the three columns are counted together and joined apart.
    """
    table = materialise(place_rates(df, r)) if rates is None else rates
    sizes = {row["place"]: row["n"] for row in table.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    overall = None
    if rates is not None:
        whole = table.where(F.col("place") == WHOLE).first()
        overall = whole["fatal_share"] if whole else None
    for column, source, name, unseen in (
        (r.region, "fatal_share", "taux_mortalite_region", F.lit(overall).cast("double")),
        (r.town, "fatal_share", "taux_mortalite_ville", F.lit(overall).cast("double")),
        (r.road, "incidents", "nb_accidents_axe", F.lit(0).cast("long")),
    ):
        known = table.where(F.col("place") == column).select("value", F.col(source).alias(name))
        df = lookup(df, known, [column], [name], ["value"], rows=sizes.get(column, 0))
        if rates is not None:
            df = df.withColumn(name, F.coalesce(name, unseen))
    return df.withColumn("log_nb_accidents_axe", F.log1p("nb_accidents_axe"))


def refit_places(train: DataFrame, r: Roles = INCIDENT) -> DataFrame | None:
    """The rates of these rows, stored; None for a table without the place features."""
    if not {*PLACE_FEATURES, r.region, r.town, r.road, r.severity, r.id} <= set(train.columns):
        return None
    return materialise(place_rates(train, r))


def with_places(df: DataFrame, rates: DataFrame | None, r: Roles = INCIDENT) -> DataFrame:
    """A feature table with its place features taken anew from ``rates``; unchanged for None."""
    if rates is None:
        return df
    return place_features(df.drop(*PLACE_FEATURES), rates, r).select(*df.columns)


def subset_places(df: DataFrame, subsets: Mapping[str, Column], r: Roles = INCIDENT) -> DataFrame:
    """For every named subset of the rows, the place features fitted on it alone, as columns
    ``feature@name``: what ``place_features`` gives with rates of that subset.

    All subsets come from one aggregation and one join per place, however many there are.
    """
    fatal, known = (F.col(r.severity) == FATAL).cast("int"), F.col(r.id).isNotNull().cast("int")
    inside = {name: F.coalesce(test, F.lit(False)) for name, test in subsets.items()}
    flags = df.select(
        r.region, r.town, r.road, fatal.alias("_fatal"), known.alias("_known"),
        *[test.alias(f"_in{i}") for i, test in enumerate(inside.values())])
    places = {c: F.col(c) for c in (r.region, r.town, r.road)} | {WHOLE: F.lit("")}
    at = F.explode(F.array(*[F.struct(F.lit(c).alias("place"), v.alias("value")) for c, v in places.items()]))
    sums = []
    for i in range(len(inside)):
        test = F.col(f"_in{i}")
        sums.append(F.try_divide(F.sum(F.when(test, F.col("_fatal"))), F.count_if(test)).alias(f"share{i}"))
        sums.append(F.coalesce(F.sum(F.when(test, F.col("_known"))), F.lit(0)).alias(f"incidents{i}"))
    rows = flags.select(at.alias("at"), "*").where(F.col("at.value").isNotNull())
    table = materialise(rows.groupBy("at.place", "at.value").agg(*sums))
    sizes = {row["place"]: row["n"] for row in table.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = table.where(F.col("place") == WHOLE).first()
    for column, source, feature in (
        (r.region, "share", "taux_mortalite_region"), (r.town, "share", "taux_mortalite_ville"), (r.road, "incidents", "nb_accidents_axe")
    ):
        names = {f"{source}{i}": f"{feature}@{name}" for i, name in enumerate(inside)}
        known_ = table.where(F.col("place") == column).select("value", *[F.col(s).alias(n) for s, n in names.items()])
        df = lookup(df, known_, [column], list(names.values()), ["value"], rows=sizes.get(column, 0))
        unseen = {n: F.lit(whole[s] if whole else None).cast("double") if source == "share" else F.lit(0) for s, n in names.items()}
        df = df.withColumns({n: F.coalesce(F.col(f"`{n}`"), u) for n, u in unseen.items()})
    return df.withColumns({f"log_nb_accidents_axe@{name}": F.log1p(F.col(f"`nb_accidents_axe@{name}`")) for name in inside})


def encode_binary(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Yes/no columns as 1/0, unknown as 0."""
    return df.withColumns({c: flag(F.col(c) == YES) for c in (r.helmet, r.belt, r.holiday) if c in df.columns})


def build_features(
    clean: DataFrame, rates: DataFrame | None = None, leak_free: bool = False, r: Roles = INCIDENT
) -> DataFrame:
    """All feature groups in order: 41 columns on top of the clean table.

    With ``leak_free`` the response-urgency feature, which knows the target, is left out.
    Place features know the target of all rows of ``clean`` unless ``rates`` fitted on training
    rows are given; training with ``leak_free`` fits them anew on each training part.
    """
    df = clean.transform(calendar_features, r).transform(behaviour_features, r)
    df = df.transform(environment_features, r).transform(interaction_features, r)
    df = df.transform(place_features, rates, r).transform(encode_binary, r)
    return df.drop("urgence_intervention") if leak_free else df


def select_features(df: DataFrame, sets: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """The columns of the named feature sets that exist, after the ``keep`` columns."""
    names = [c for s in sets for c in FEATURE_SETS[s]]
    return df.select(*dict.fromkeys([*keep, *[c for c in names if c in df.columns]]))
