"""Feature columns, group by group and as a whole. Irrational values are compared at 9 digits."""

from pyspark.sql import functions as F

from catalog.relations import clean, on_repaired, repaired
from hazardframe.operators import features as X
from hazardframe.operators.quality import feature_summary

ROUNDED = [
    "heure_sin", "heure_cos", "mois_sin", "mois_cos", "jour_sin", "jour_cos",
    "taux_mortalite_region", "taux_mortalite_ville", "log_nb_accidents_axe",
]


def _rounded(df):
    """Nine digits, and no negative zero."""
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in ROUNDED if c in df.columns})


def _feature(step, reads, out):
    def run(df):
        return _rounded(df.transform(step).select("accident_id", *out.split()))

    return on_repaired(run, f"accident_id {reads}")


def _interactions(df):
    return X.interaction_features(X.environment_features(X.behaviour_features(df)))


def _feature_set(spark, sf_dir):
    df = X.encode_binary(
        X.behaviour_features(
            repaired(
                spark,
                sf_dir,
                "accident_id cause port_casque port_ceinture accident_fete vitesse_estimee limitation_vitesse",
            )
        )
    )
    return X.select_features(df, ["behavioral"], keep=["accident_id"])


def _summary(df):
    """Describe whichever of the catalogued features the table has; text and absent ones are left out."""
    names = [c for group in X.FEATURE_SETS.values() for c in group]
    figures = feature_summary(X.behaviour_features(df), names)
    return figures.withColumns({c: F.round(c, 9) for c in ("mean", "std", "q25", "q50", "q75", "min", "max")})


CALENDAR = "date_accident heure"
BEHAVIOUR = "cause port_casque port_ceinture vitesse_estimee limitation_vitesse"
SURROUNDINGS = "meteo luminosite etat_route type_route limitation_vitesse"
PLACES = "region ville axe_routier gravite"

QUERIES = {
    "calendar_parts": _feature(X.calendar_features, CALENDAR, "annee mois semaine jour_mois trimestre"),
    "cyclic_encoding": _feature(
        X.calendar_features, CALENDAR, "heure_sin heure_cos mois_sin mois_cos jour_sin jour_cos"
    ),
    "time_flags": _feature(
        X.calendar_features, CALENDAR, "is_weekend is_rush_hour is_nuit_profonde is_saison_pluies"
    ),
    "speed_excess": _feature(X.behaviour_features, BEHAVIOUR, "exces_vitesse ratio_vitesse"),
    "behaviour_score": _feature(X.behaviour_features, BEHAVIOUR, "score_risque_comportemental"),
    "cause_flags": _feature(
        X.behaviour_features,
        BEHAVIOUR,
        "is_alcool is_distracteur is_fatigue is_exces_vitesse epi_double no_epi",
    ),
    "environment_flags": _feature(
        X.environment_features,
        SURROUNDINGS,
        "is_meteo_risque is_nuit is_crepuscule is_route_degradee score_conditions_env",
    ),
    "road_type_order": _feature(X.environment_features, SURROUNDINGS, "type_route_num"),
    "speed_zone": _feature(X.environment_features, SURROUNDINGS, "speed_zone"),
    "interactions": _feature(
        _interactions,
        f"{BEHAVIOUR} meteo luminosite etat_route type_route "
        "gravite nombre_victimes nombre_vehicules intervention_secours",
        "exces_vitesse_nuit alcool_nuit pluie_route_deg victimes_risque is_multi_vehicule urgence_intervention",
    ),
    "target_rates": _feature(X.place_features, PLACES, "taux_mortalite_region taux_mortalite_ville"),
    "road_counts": _feature(X.place_features, PLACES, "nb_accidents_axe log_nb_accidents_axe"),
    "binary_flags": _feature(
        X.encode_binary, "port_casque port_ceinture accident_fete", "port_casque port_ceinture accident_fete"
    ),
    "feature_set_behaviour": _feature_set,
    "feature_summary": on_repaired(_summary, "cause port_casque port_ceinture vitesse_estimee limitation_vitesse nombre_victimes"),
    "features_of_clean": lambda spark, sf_dir: _rounded(X.build_features(clean(spark, sf_dir))),
}
