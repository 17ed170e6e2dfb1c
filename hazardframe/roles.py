"""Column roles and fixed vocabulary.

Every operator takes a DataFrame and a ``Roles`` object saying which column
plays which part, so the same operator runs on any incident-like table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Names of the columns that play each role; the defaults are the raw schema's."""

    id: str = "accident_id"
    date: str = "date_accident"
    hour: str = "heure"
    weekday: str = "jour_semaine"
    semester: str = "semestre"
    period: str = "periode_journaliere"
    region: str = "region"
    town: str = "ville"
    lat: str = "latitude"
    lon: str = "longitude"
    road: str = "axe_routier"
    road_type: str = "type_route"
    weather: str = "meteo"
    light: str = "luminosite"
    vehicle: str = "type_vehicule"
    vehicles: str = "nombre_vehicules"
    victims: str = "nombre_victimes"
    deaths: str = "nombre_deces"
    severity: str = "gravite"
    severity_rank: str = "gravite_num"
    cause: str = "cause"
    surface: str = "etat_route"
    limit: str = "limitation_vitesse"
    speed: str = "vitesse_estimee"
    helmet: str = "port_casque"
    belt: str = "port_ceinture"
    response: str = "intervention_secours"
    kind: str = "type_accident"
    holiday: str = "accident_fete"
    cost: str = "cout_estime"


INCIDENT = Roles()

# --------------------------------------------------------------------------
# They must equal the published data model for results to match.
# --------------------------------------------------------------------------

LIGHT_INJURY, SERIOUS, FATAL = "Léger", "Grave", "Mortel"
SEVERITY_ORDER = {"Léger": 0, "Grave": 1, "Mortel": 2}
SEVERITIES = list(SEVERITY_ORDER)

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

YES, NO = "Oui", "Non"
UNKNOWN_CAUSE = "Inconnue"
GOOD_SURFACE = "Bon"
NIGHT = "Nuit"

ALLOWED_VALUES = {
    "gravite": ["Léger", "Grave", "Mortel"],
    "periode_journaliere": ["Matin", "Après-midi", "Soir", "Nuit"],
    "meteo": ["Soleil", "Nuageux", "Pluie", "Brouillard"],
    "luminosite": ["Jour", "Nuit", "Crépuscule"],
    "type_route": ["Urbaine", "Interurbaine", "Rurale"],
    "etat_route": ["Bon", "Dégradé", "Très dégradé"],
    "port_casque": ["Oui", "Non"],
    "port_ceinture": ["Oui", "Non"],
    "accident_fete": ["Oui", "Non"],
    "type_accident": [
        "Collision frontale",
        "Collision arrière",
        "Collision latérale",
        "Collision piéton",
        "Sortie de route",
        "Renversement",
    ],
    "cause": [
        "Alcool",
        "Téléphone",
        "Fatigue",
        "Excès de vitesse",
        "Dépassement dangereux",
        "Priorité non respectée",
        "Freinage brusque",
    ],
    "type_vehicule": ["Moto", "Voiture", "Camion", "Bus", "Tricycle", "Vélo"],
    "region": ["Maritime", "Plateaux", "Centrale", "Kara", "Savanes"],
}

# Columns of the published association ranking and correlation matrix.
ASSOCIATED = [
    "region", "type_route", "meteo", "luminosite", "type_vehicule", "cause", "etat_route",
    "port_casque", "port_ceinture", "type_accident", "periode_journaliere",
]
CORRELATED = [
    "heure", "nombre_vehicules", "nombre_victimes", "nombre_deces", "limitation_vitesse",
    "vitesse_estimee", "exces_vitesse", "intervention_secours", "cout_estime", "gravite_num",
]

# --------------------------------------------------------------------------

RAW_SCHEMA = T.StructType(
    [
        T.StructField("accident_id", T.LongType()),
        T.StructField("date_accident", T.StringType()),  # coerced later: bad dates become NULL
        T.StructField("heure", T.IntegerType()),
        T.StructField("jour_semaine", T.StringType()),
        T.StructField("semestre", T.IntegerType()),
        T.StructField("periode_journaliere", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("ville", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("axe_routier", T.StringType()),
        T.StructField("type_route", T.StringType()),
        T.StructField("meteo", T.StringType()),
        T.StructField("luminosite", T.StringType()),
        T.StructField("type_vehicule", T.StringType()),
        T.StructField("nombre_vehicules", T.IntegerType()),
        T.StructField("nombre_victimes", T.DoubleType()),
        T.StructField("nombre_deces", T.IntegerType()),
        T.StructField("gravite", T.StringType()),
        T.StructField("cause", T.StringType()),
        T.StructField("etat_route", T.StringType()),
        T.StructField("limitation_vitesse", T.IntegerType()),
        T.StructField("vitesse_estimee", T.DoubleType()),
        T.StructField("port_casque", T.StringType()),
        T.StructField("port_ceinture", T.StringType()),
        T.StructField("intervention_secours", T.DoubleType()),
        T.StructField("type_accident", T.StringType()),
        T.StructField("accident_fete", T.StringType()),
        T.StructField("cout_estime", T.LongType()),
    ]
)
RAW_COLUMNS = RAW_SCHEMA.fieldNames()
