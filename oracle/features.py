"""DuckDB oracles of the feature columns."""

from oracle.binding import on_repaired, rnd
from oracle.cleaning import on_clean

D = "date_accident"


def _cycle(value, period, name):
    return ", ".join(
        f"round({f}(2 * pi() * {value} / {period}), 9) + 0.0 AS {name}_{f}" for f in ("sin", "cos")
    )


def _flag(test):
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


CALENDAR = f"""CAST(year({D}) AS INTEGER) AS annee, CAST(month({D}) AS INTEGER) AS mois,
  CAST(week({D}) AS INTEGER) AS semaine, CAST(day({D}) AS INTEGER) AS jour_mois,
  CAST(quarter({D}) AS INTEGER) AS trimestre"""
CYCLES = ",\n  ".join(
    [_cycle("heure", 24, "heure"), _cycle(f"month({D})", 12, "mois"), _cycle(f"(isodow({D}) - 1)", 7, "jour")]
)
TIME_FLAGS = f"""{_flag(f'isodow({D}) IN (6, 7)')} AS is_weekend,
  {_flag('heure IN (7, 8, 9, 17, 18, 19, 20)')} AS is_rush_hour,
  {_flag('heure IN (22, 23, 0, 1, 2, 3, 4, 5)')} AS is_nuit_profonde,
  {_flag(f'month({D}) IN (3, 4, 5, 6, 7, 10, 11)')} AS is_saison_pluies"""

EXCESS = "CASE WHEN vitesse_estimee > limitation_vitesse THEN vitesse_estimee - limitation_vitesse WHEN vitesse_estimee IS NOT NULL THEN 0.0 END::DOUBLE"
SCORE = " + ".join(
    _flag(t)
    for t in (
        "port_casque = 'Non'",
        "port_ceinture = 'Non'",
        "cause IN ('Alcool', 'Téléphone', 'Fatigue')",
        "vitesse_estimee - limitation_vitesse > 20",
        "cause = 'Alcool'",
    )
)
SPEEDING = f"{EXCESS} AS exces_vitesse, vitesse_estimee / CASE limitation_vitesse WHEN 0 THEN 1 ELSE limitation_vitesse END AS ratio_vitesse"
BEHAVIOUR = f"{SCORE} AS score_risque_comportemental"
CAUSE_FLAGS = ", ".join(
    f"{_flag(t)} AS {n}"
    for n, t in {
        "is_alcool": "cause = 'Alcool'",
        "is_distracteur": "cause = 'Téléphone'",
        "is_fatigue": "cause = 'Fatigue'",
        "is_exces_vitesse": "cause = 'Excès de vitesse'",
        "epi_double": "port_casque = 'Oui' AND port_ceinture = 'Oui'",
        "no_epi": "port_casque = 'Non' AND port_ceinture = 'Non'",
    }.items()
)
WEATHER, DARK, DUSK, SURFACE = (
    _flag("meteo IN ('Pluie', 'Brouillard')"),
    _flag("luminosite = 'Nuit'"),
    _flag("luminosite = 'Crépuscule'"),
    _flag("etat_route IN ('Dégradé', 'Très dégradé')"),
)
ENVIRONMENT = f"""{WEATHER} AS is_meteo_risque, {DARK} AS is_nuit, {DUSK} AS is_crepuscule, {SURFACE} AS is_route_degradee,
  {WEATHER} + {DARK} + {DUSK} + {SURFACE} AS score_conditions_env"""
ROAD_ORDER = "CASE type_route WHEN 'Urbaine' THEN 0 WHEN 'Rurale' THEN 2 ELSE 1 END AS type_route_num"
ZONE = """CASE WHEN limitation_vitesse <= 0 OR limitation_vitesse > 200 THEN NULL
  WHEN limitation_vitesse <= 50 THEN 'Zone30-50' WHEN limitation_vitesse <= 70 THEN 'Zone70'
  WHEN limitation_vitesse <= 90 THEN 'Zone90' WHEN limitation_vitesse <= 200 THEN 'Zone+90' END AS speed_zone"""
INTERACTIONS = f"""({EXCESS}) * {DARK} AS exces_vitesse_nuit,
  {_flag("cause = 'Alcool' AND luminosite = 'Nuit'")} AS alcool_nuit,
  {_flag("meteo IN ('Pluie', 'Brouillard') AND etat_route IN ('Dégradé', 'Très dégradé')")} AS pluie_route_deg,
  nombre_victimes * ({SCORE}) AS victimes_risque,
  {_flag('nombre_vehicules > 1')} AS is_multi_vehicule,
  intervention_secours * {_flag("gravite <> 'Léger'")} AS urgence_intervention"""
PLACES = """round(avg(CASE WHEN gravite = 'Mortel' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY region), 9) AS taux_mortalite_region,
  round(avg(CASE WHEN gravite = 'Mortel' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER (PARTITION BY ville), 9) AS taux_mortalite_ville"""
COUNTS = """count(accident_id) OVER (PARTITION BY axe_routier) AS nb_accidents_axe,
  round(ln(1 + count(accident_id) OVER (PARTITION BY axe_routier)), 9) AS log_nb_accidents_axe"""
BINARY = ", ".join(f"{_flag(f'''{c} = 'Oui' ''')} AS {c}" for c in ("port_casque", "port_ceinture", "accident_fete"))


SUMMARISED = [
    "limitation_vitesse", "nombre_victimes", "exces_vitesse", "ratio_vitesse", "score_risque_comportemental",
    "is_alcool", "is_distracteur", "is_fatigue", "is_exces_vitesse", "epi_double", "no_epi",
]


def _summary():
    cell = lambda c: (
        f"SELECT '{c}' AS \"column\", count({c}) AS count, {rnd(f'avg({c}::DOUBLE)', 9)} AS mean, "
        f"{rnd(f'stddev_samp({c}::DOUBLE)', 9)} AS std, {rnd(f'min({c}::DOUBLE)', 9)} AS min, "
        + ", ".join(f"{rnd(f'quantile_cont({c}::DOUBLE, 0.{q})', 9)} AS q{q}" for q in (25, 50, 75))
        + f", {rnd(f'max({c}::DOUBLE)', 9)} AS max, "
        f"{rnd(f'100 * count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)', 4)} AS missing_pct FROM feat"
    )
    table = f"feat AS (SELECT limitation_vitesse, nombre_victimes, {SPEEDING}, {BEHAVIOUR}, {CAUSE_FLAGS} FROM rep)"
    return on_repaired("\nUNION ALL ".join(cell(c) for c in SUMMARISED), table)


def _pick(*expressions):
    return on_repaired(f"SELECT accident_id, {', '.join(expressions)} FROM rep")


ORACLES = {
    "calendar_parts": _pick(CALENDAR),
    "cyclic_encoding": _pick(CYCLES),
    "time_flags": _pick(TIME_FLAGS),
    "speed_excess": _pick(SPEEDING),
    "behaviour_score": _pick(BEHAVIOUR),
    "cause_flags": _pick(CAUSE_FLAGS),
    "environment_flags": _pick(ENVIRONMENT),
    "road_type_order": _pick(ROAD_ORDER),
    "speed_zone": _pick(ZONE),
    "interactions": _pick(INTERACTIONS),
    "target_rates": _pick(PLACES),
    "road_counts": _pick(COUNTS),
    "binary_flags": _pick(BINARY),
    "feature_set_behaviour": _pick(
        SPEEDING, BEHAVIOUR, CAUSE_FLAGS, _flag("port_casque = 'Oui'") + " AS port_casque",
        _flag("port_ceinture = 'Oui'") + " AS port_ceinture",
    ),
    "feature_summary": _summary(),
    "features_of_clean": on_clean(
        f"""SELECT * REPLACE ({BINARY}),
  {CALENDAR}, {CYCLES}, {TIME_FLAGS}, {SPEEDING}, {BEHAVIOUR}, {CAUSE_FLAGS}, {ENVIRONMENT}, {ROAD_ORDER},
  {ZONE}, {INTERACTIONS}, {PLACES}, {COUNTS} FROM clean"""
    ),
}
