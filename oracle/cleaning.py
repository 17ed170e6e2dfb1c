"""DuckDB oracles of the cleaning and imputation steps."""

from oracle.binding import on_raw, on_repaired, rnd
from oracle.reports import over

MODE = "(SELECT {c} FROM rep WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"

SURFACE_MODE = """
surface_mode AS (
  SELECT region AS k, etat_route AS m FROM (
    SELECT region, etat_route, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, etat_route) AS k
    FROM rep WHERE etat_route IS NOT NULL GROUP BY region, etat_route) WHERE k = 1)"""
SPEED_MEDIAN = """
speed_median AS (SELECT type_route AS k, quantile_cont(vitesse_estimee, 0.5) AS m FROM rep GROUP BY type_route)"""
COST_MEDIAN = "(SELECT quantile_cont(cout_estime, 0.5) FROM rep WHERE cout_estime >= 0)"
RESPONSE_MEDIAN = "(SELECT quantile_cont(intervention_secours, 0.5) FROM rep)"

FILLED = f"""
filled AS (
  SELECT rep.* REPLACE (
    CASE WHEN cout_estime < 0 THEN {COST_MEDIAN} ELSE cout_estime::DOUBLE END AS cout_estime,
    coalesce(meteo, {MODE.format(c='meteo')}) AS meteo,
    coalesce(cause, 'Inconnue') AS cause,
    CASE WHEN region IS NOT NULL THEN coalesce(etat_route, surface_mode.m, 'Bon') END AS etat_route,
    CASE WHEN type_route IS NOT NULL THEN coalesce(vitesse_estimee, speed_median.m) END AS vitesse_estimee,
    greatest(coalesce(nombre_victimes, 1.0::DOUBLE), 0.0::DOUBLE) AS nombre_victimes,
    coalesce(port_casque, {MODE.format(c='port_casque')}, 'Non') AS port_casque,
    coalesce(port_ceinture, {MODE.format(c='port_ceinture')}, 'Non') AS port_ceinture,
    coalesce(intervention_secours, {RESPONSE_MEDIAN}) AS intervention_secours)
  FROM rep
  LEFT JOIN surface_mode ON region = surface_mode.k
  LEFT JOIN speed_median ON type_route = speed_median.k)"""
TIE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
UNIQUE = f"""
uniq AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY accident_id ORDER BY {TIE}) = 1)"""
COHERENT = """
coherent AS (SELECT * FROM uniq WHERE nombre_deces <= nombre_victimes OR nombre_victimes IS NULL)"""
CLEAN = f"""
clean AS (
  SELECT * EXCLUDE ({TIE}) REPLACE (
      least(cout_estime, (SELECT quantile_cont(cout_estime, 0.999) FROM coherent)) AS cout_estime),
    CAST(list_position(['Léger', 'Grave', 'Mortel'], gravite) - 1 AS INTEGER) AS gravite_num
  FROM coherent WHERE gravite IN ('Léger', 'Grave', 'Mortel'))"""
STEPS = [SURFACE_MODE, SPEED_MEDIAN, FILLED, UNIQUE, COHERENT, CLEAN]


def on_clean(body: str, *ctes: str) -> str:
    """``body`` over the fully cleaned table ``clean``."""
    return on_repaired(body, *STEPS, *ctes)


_CAPITAL = "upper({c}[1]) || lower({c}[2:])"

ORACLES = {
    "csv_round_trip": on_raw(
        "SELECT accident_id, date_accident, heure, region, nombre_victimes, cout_estime, port_casque FROM raw"
    ),
    "parquet_round_trip": on_raw(
        "SELECT accident_id, CAST(heure AS TINYINT) AS heure, CAST(semestre AS TINYINT) AS semestre, "
        "CAST(nombre_vehicules AS SMALLINT) AS nombre_vehicules, CAST(nombre_deces AS SMALLINT) AS nombre_deces, "
        "CAST(limitation_vitesse AS SMALLINT) AS limitation_vitesse, region FROM raw"
    ),
    "trim_text": on_raw(
        "SELECT accident_id, trim(port_casque) AS port_casque, trim(port_ceinture) AS port_ceinture FROM raw"
    ),
    "coerce_dates": on_raw(
        "SELECT accident_id, try_cast(t AS DATE) AS date_accident FROM (SELECT accident_id, "
        "CASE WHEN l_suppkey % 10 = 3 THEN 'not a date' ELSE strftime(date_accident, '%Y-%m-%d') END AS t FROM raw) "
        "WHERE try_cast(t AS DATE) IS NOT NULL"
    ),
    "wrap_hours": on_raw(
        "SELECT accident_id, CAST(CASE WHEN heure > 23 THEN heure - 24 ELSE heure END AS INTEGER) AS heure FROM raw"
    ),
    "clip_speed": on_raw(
        "SELECT accident_id, CASE WHEN vitesse_estimee IS NOT NULL "
        "THEN greatest(0, least(200, vitesse_estimee))::DOUBLE END AS vitesse_estimee FROM raw"
    ),
    "negative_cost_to_median": on_repaired(
        f"SELECT accident_id, CASE WHEN cout_estime < 0 THEN {COST_MEDIAN} ELSE cout_estime::DOUBLE END AS cout_estime FROM rep"
    ),
    "standardise_binary": on_raw(
        "SELECT accident_id, "
        + ", ".join(
            f"CASE WHEN lower(trim({c})) = 'oui' THEN 'Oui' WHEN lower(trim({c})) = 'non' THEN 'Non' END AS {c}"
            for c in ("port_casque", "port_ceinture", "accident_fete")
        )
        + " FROM raw"
    ),
    "dedup_first": on_raw(
        f"SELECT accident_id, l_partkey, l_suppkey, cout_estime FROM raw "
        f"QUALIFY row_number() OVER (PARTITION BY accident_id ORDER BY {TIE}) = 1"
    ),
    "drop_incoherent": on_raw(
        "SELECT accident_id, nombre_deces, nombre_victimes FROM raw "
        "WHERE NOT coalesce(nombre_deces > nombre_victimes, false)"
    ),
    "cap_cost": on_raw(
        "SELECT accident_id, least(cout_estime, (SELECT quantile_cont(cout_estime, 0.999) FROM raw))::DOUBLE "
        "AS cout_estime FROM raw"
    ),
    "encode_severity": on_raw(
        "SELECT accident_id, CAST(CASE gravite WHEN 'Léger' THEN 0 WHEN 'Grave' THEN 1 WHEN 'Mortel' THEN 2 END "
        "AS INTEGER) AS gravite_num, gravite FROM raw WHERE gravite IS NOT NULL"
    ),
    "filter_incidents": on_repaired(
        "SELECT accident_id, date_accident, region, gravite, type_vehicule, periode_journaliere FROM rep "
        "WHERE year(date_accident) >= 1996 AND year(date_accident) <= 1998 AND region IN ('ASIA', 'EUROPE') "
        "AND gravite IN ('Grave', 'Mortel') AND type_vehicule IN ('BUILDING', 'MACHINERY')"
    ),
    "severity_label_order": on_repaired(
        "SELECT gravite, CAST(row_number() OVER (ORDER BY CASE gravite WHEN 'Mortel' THEN 1 WHEN 'Grave' THEN 2 "
        "ELSE 3 END) AS INTEGER) AS position, count(*) AS nb FROM rep GROUP BY gravite"
    ),
    "fill_mode": on_repaired(
        "SELECT accident_id, "
        + ", ".join(
            f"coalesce({c}, {MODE.format(c=c)}, 'Non') AS {c}" for c in ("meteo", "port_casque", "port_ceinture")
        )
        + " FROM rep"
    ),
    "fill_constant": on_repaired("SELECT accident_id, coalesce(cause, 'Inconnue') AS cause FROM rep"),
    "fill_group_mode": on_repaired(
        "SELECT accident_id, region, CASE WHEN region IS NOT NULL THEN coalesce(etat_route, m, 'Bon') END AS etat_route "
        "FROM rep LEFT JOIN surface_mode ON region = k",
        SURFACE_MODE,
    ),
    "fill_group_median": on_repaired(
        "SELECT accident_id, type_route, coalesce(vitesse_estimee, m) AS vitesse_estimee "
        "FROM rep LEFT JOIN speed_median ON type_route = k",
        SPEED_MEDIAN,
    ),
    "fill_floor": on_repaired(
        "SELECT accident_id, CASE WHEN nombre_victimes IS NULL THEN 1.0 WHEN nombre_victimes < 0 THEN 0.0 "
        "ELSE nombre_victimes END::DOUBLE AS nombre_victimes FROM rep"
    ),
    "fill_median": on_repaired(
        f"SELECT accident_id, coalesce(intervention_secours, {RESPONSE_MEDIAN}) AS intervention_secours FROM rep"
    ),
    "least_repair": on_raw(
        "SELECT accident_id, CAST(heure % 24 AS INTEGER) AS heure, coalesce(vitesse_estimee, "
        "(SELECT quantile_cont(vitesse_estimee, 0.5) FROM raw)) AS vitesse_estimee FROM raw"
    ),
    "clean_incidents": on_clean("SELECT * FROM clean"),
    "kpis_of_clean": on_clean(
        over("clean", "kpis").replace(
            "CAST(sum(cout_estime) AS DOUBLE) / 1e9", rnd("sum(cout_estime) / 1e9", 6)
        )
    ),
    "top_regions_of_clean": on_clean(over("clean", "top_regions")),
    "speed_profile_of_clean": on_clean(over("clean", "speed_profile")),
}
