"""DuckDB oracles of the analytical reports, over the row-repaired table."""

from oracle.binding import on_repaired, rnd


def _deaths_per_100(digits=2):
    return rnd("100 * sum(nombre_deces)::DOUBLE / count(*)", digits)


def _pct(part, whole, digits=2):
    return rnd(f"100 * ({part})::DOUBLE / ({whole})", digits)


ORDER = "CASE gravite WHEN 'Mortel' THEN 1 WHEN 'Grave' THEN 2 ELSE 3 END"

# Body text per report; `t` is the relation it reads, so the same text serves other tables.
BODIES = {
    "kpis": f"""
SELECT count(*) AS total_accidents,
  CAST(sum(nombre_deces) AS BIGINT) AS total_deces,
  sum(nombre_victimes) AS total_victimes,
  {rnd('avg(nombre_victimes)', 2)} AS moy_victimes_par_accident,
  {_deaths_per_100()} AS taux_mortalite_pct,
  {rnd('avg(cout_estime) / 1e6', 3)} AS "cout_moyen_MFCFA",
  CAST(sum(cout_estime) AS DOUBLE) / 1e9 AS "cout_total_GFCFA",
  min(date_accident) AS date_debut, max(date_accident) AS date_fin,
  count(DISTINCT region) AS nb_regions, count(DISTINCT ville) AS nb_villes,
  count(DISTINCT axe_routier) AS nb_axes_routiers
FROM t""",
    "by_severity": f"""
, g AS (
  SELECT gravite, count(*) AS c, sum(nombre_victimes) AS v, sum(nombre_deces) AS d, avg(cout_estime) AS m
  FROM t GROUP BY gravite)
SELECT gravite, c AS nb_accidents, {_pct('c', '(SELECT count(*) FROM t)')} AS pct,
  v AS total_victimes, CAST(d AS BIGINT) AS total_deces, {rnd('m', 0)} AS "cout_moyen_FCFA"
FROM g ORDER BY {ORDER}""",
    "yearly_trend": f"""
SELECT CAST(year(date_accident) AS INTEGER) AS annee, count(*) AS nb_accidents,
  CAST(sum(nombre_deces) AS BIGINT) AS deces, {_deaths_per_100()} AS taux_mortalite,
  {rnd('avg(vitesse_estimee)', 1)} AS vitesse_moyenne,
  {rnd('sum(cout_estime)::DOUBLE / 1e6', 1)} AS "cout_total_MFCFA"
FROM t GROUP BY 1 ORDER BY 1""",
    "by_hour": f"""
SELECT heure, count(*) AS nb_accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces,
  {_deaths_per_100()} AS taux_mortalite,
  {_pct('count(*)', '(SELECT count(*) FROM t)')} AS pct_total
FROM t GROUP BY heure ORDER BY heure""",
    "by_weekday": f"""
SELECT jour_semaine, count(*) AS nb_accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces,
  {_deaths_per_100()} AS taux_mortalite, {rnd('avg(cout_estime)', 0)} AS cout_moyen,
  CAST(list_position(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'],
       jour_semaine) AS INTEGER) AS ordre
FROM t GROUP BY jour_semaine ORDER BY ordre""",
    "hour_by_weekday": f"""
SELECT heure, jour_semaine, count(*) AS nb_accidents, {_deaths_per_100()} AS taux_mortalite
FROM t GROUP BY ALL ORDER BY ALL""",
    "by_holiday": f"""
SELECT accident_fete, count(*) AS nb_accidents, {_deaths_per_100()} AS taux_mortalite,
  {rnd('avg(vitesse_estimee)', 1)} AS vitesse_moyenne, {rnd('avg(cout_estime)', 0)} AS cout_moyen
FROM t GROUP BY accident_fete""",
    "top_regions": f"""
SELECT region, count(*) AS nb_accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces,
  sum(nombre_victimes) AS victimes, {_deaths_per_100()} AS taux_mortalite,
  {rnd('avg(vitesse_estimee)', 1)} AS vitesse_moy,
  {rnd('sum(cout_estime)::DOUBLE / 1e6', 1)} AS "cout_total_MFCFA",
  {_pct('count(*)', '(SELECT count(*) FROM t)')} AS pct_accidents
FROM t GROUP BY region ORDER BY taux_mortalite DESC, region LIMIT 5""",
    "top_towns": f"""
SELECT ville, region, count(*) AS nb_accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces,
  {_deaths_per_100()} AS taux_mortalite,
  {rnd('avg(latitude)', 4)} AS mean_lat, {rnd('avg(longitude)', 4)} AS mean_lon
FROM t GROUP BY ville, region ORDER BY nb_accidents DESC, ville, region LIMIT 10""",
    "top_roads": f"""
SELECT axe_routier, count(*) AS nb_accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces,
  {_deaths_per_100()} AS taux_mortalite, {rnd('avg(vitesse_estimee)', 1)} AS vitesse_moy,
  count(DISTINCT ville) AS nb_villes_touchees
FROM t GROUP BY axe_routier HAVING count(*) >= 50 ORDER BY deces DESC, axe_routier LIMIT 10""",
    "causes_by_severity": f"""
, per AS (SELECT gravite, count(*) AS whole FROM t GROUP BY gravite),
pair AS (SELECT cause, gravite, count(*) AS c FROM t GROUP BY cause, gravite)
SELECT cause, pair.gravite, c AS nb_accidents, {_pct('c', 'whole')} AS pct_dans_gravite
FROM pair JOIN per ON pair.gravite IS NOT DISTINCT FROM per.gravite""",
    "cause_severity_pivot": """
SELECT cause,
  nullif(count(*) FILTER (WHERE gravite = 'Léger'), 0) AS "Léger",
  nullif(count(*) FILTER (WHERE gravite = 'Grave'), 0) AS "Grave",
  nullif(count(*) FILTER (WHERE gravite = 'Mortel'), 0) AS "Mortel"
FROM t GROUP BY cause""",
    "speed_profile": f"""
SELECT gravite, type_route, {rnd('avg(vitesse_estimee)', 1)} AS vitesse_moy,
  {rnd('quantile_cont(vitesse_estimee, 0.5)', 1)} AS vitesse_mediane,
  {rnd('stddev_samp(vitesse_estimee)', 1)} AS vitesse_std,
  {rnd('avg(vitesse_estimee - limitation_vitesse)', 1)} AS exces_moy,
  {rnd('avg(limitation_vitesse)', 0)} AS limitation_moy, count(*) AS nb_accidents
FROM t GROUP BY gravite, type_route""",
    "protection_impact": f"""
SELECT port_casque, port_ceinture, count(*) AS nb_accidents,
  {_pct("count(*) FILTER (WHERE gravite = 'Mortel')", 'count(*)')} AS taux_mortalite,
  {_pct("count(*) FILTER (WHERE gravite = 'Grave')", 'count(*)')} AS taux_grave,
  {rnd('avg(cout_estime)', 0)} AS cout_moyen
FROM t GROUP BY port_casque, port_ceinture""",
    "cause_share_by_hour": f"""
SELECT heure, count(*) AS total_accidents,
  count(*) FILTER (WHERE cause = 'Alcool') AS accidents_alcool,
  {_pct("count(*) FILTER (WHERE cause = 'Alcool')", 'count(*)')} AS pct_alcool
FROM t GROUP BY heure""",
    "cost_by_region": f"""
SELECT region, count(*) AS nb_accidents, {rnd('sum(cout_estime)::DOUBLE / 1e6', 1)} AS "cout_total_MFCFA",
  {rnd('avg(cout_estime)', 0)} AS "cout_moyen_FCFA",
  {rnd('max(cout_estime)', 0)} AS "cout_max_FCFA",
  {rnd('quantile_cont(cout_estime, 0.5)', 0)} AS "cout_median_FCFA"
FROM t GROUP BY region""",
    "cost_by_cause": f"""
SELECT cause, count(*) AS nb_accidents, {rnd('sum(cout_estime)::DOUBLE / 1e6', 2)} AS "cout_total_MFCFA",
  {rnd('avg(cout_estime)', 0)} AS cout_moyen, {_deaths_per_100()} AS taux_mortalite
FROM t GROUP BY cause""",
    "yearly_cost": f"""
SELECT CAST(year(date_accident) AS INTEGER) AS annee,
  {rnd('sum(cout_estime)::DOUBLE / 1e9', 3)} AS "cout_total_GFCFA",
  {rnd('avg(cout_estime) / 1e6', 3)} AS "cout_moyen_MFCFA", count(*) AS nb_accidents
FROM t GROUP BY 1""",
    "by_vehicle": f"""
SELECT type_vehicule, count(*) AS nb_accidents, sum(nombre_victimes) AS total_victimes,
  CAST(sum(nombre_deces) AS BIGINT) AS total_deces, {_deaths_per_100()} AS taux_mortalite,
  {rnd('avg(nombre_victimes)', 2)} AS moy_victimes, {rnd('avg(vitesse_estimee)', 1)} AS vitesse_moy,
  {_pct('count(*)', '(SELECT count(*) FROM t)')} AS pct_total
FROM t GROUP BY type_vehicule""",
    "running_deaths": f"""
, m AS (SELECT CAST(year(date_accident) AS INTEGER) AS annee, CAST(month(date_accident) AS INTEGER) AS mois,
    CAST(sum(nombre_deces) AS BIGINT) AS deces_mois, count(*) AS accidents_mois,
    row_number() OVER (PARTITION BY year(date_accident) ORDER BY month(date_accident)) AS k
  FROM t GROUP BY year(date_accident), month(date_accident))
SELECT a.annee, a.mois, a.deces_mois, a.accidents_mois,
  CAST(sum(b.deces_mois) AS BIGINT) AS deces_cumul,
  {rnd('avg(b.accidents_mois) FILTER (WHERE b.k >= a.k - 2)', 1)} AS moy_mobile_3mois
FROM m a JOIN m b ON a.annee = b.annee AND b.k <= a.k
GROUP BY a.annee, a.mois, a.deces_mois, a.accidents_mois""",
    "top_night_zones": f"""
, z AS (SELECT ville, region, count(*) AS c,
    sum(CASE WHEN luminosite = 'Nuit' THEN 1 ELSE 0 END)::BIGINT AS c_night,
    sum(CASE WHEN luminosite = 'Nuit' THEN nombre_deces END) AS d_night
  FROM t GROUP BY ville, region)
SELECT ville, region, c_night AS accidents_nuit, c AS total_accidents,
  {_pct('c_night', 'c')} AS pct_nuit, {_pct('d_night', 'nullif(c_night, 0)')} AS taux_mortalite_nuit
FROM z WHERE c >= 100 ORDER BY c_night DESC, ville, region LIMIT 10""",
    "excess_speed_by_severity": f"""
, e AS (SELECT gravite, vitesse_estimee - limitation_vitesse AS x FROM t)
SELECT gravite, {rnd('avg(x)', 2)} AS exces_moy,
  {rnd('quantile_cont(x, 0.25)', 1)} AS q25, {rnd('quantile_cont(x, 0.5)', 1)} AS mediane,
  {rnd('quantile_cont(x, 0.75)', 1)} AS q75, {rnd('quantile_cont(x, 0.9)', 1)} AS p90, count(*) AS n
FROM e GROUP BY gravite""",
}


def over(relation: str, name: str) -> str:
    """CTE tail plus final SELECT of a report reading ``relation``."""
    return f", t AS (SELECT * FROM {relation})\n{BODIES[name]}"


ORACLES = {name: on_repaired(over("rep", name)) for name in BODIES}
ORACLES["scan_table"] = (
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, max(l_orderkey) AS last_order "
    "FROM lineitem GROUP BY ALL"
)
ORACLES["sql_view"] = on_repaired(
    "SELECT region, type_route, count(*) AS n, CAST(sum(nombre_deces) AS BIGINT) AS deces "
    "FROM rep WHERE heure >= 18 GROUP BY region, type_route"
)
ORACLES["cause_severity_pivot_filled"] = on_repaired(
    "SELECT cause, "
    + ", ".join(f"count(*) FILTER (WHERE gravite = '{c}') AS \"{c}\"" for c in ("Léger", "Grave", "Mortel"))
    + " FROM rep GROUP BY cause"
)

#: Reports of the bundle: name, the query that gives it, its columns.
BUNDLE = [
    ("kpi_globaux", "kpis"), ("gravite", "by_severity"), ("tendance_annuelle", "yearly_trend"), ("accidents_par_heure", "by_hour"),
    ("top_regions", "top_regions"), ("top_axes", "top_roads"), ("causes_gravite", "causes_by_severity"), ("analyse_vitesse", "speed_profile"),
    ("impact_epi", "protection_impact"), ("cout_region", "cost_by_region"), ("risque_vehicule", "by_vehicle"),
]
ORACLES["full_report"] = " UNION ALL ".join(
    f"SELECT '{name}' AS report, (SELECT count(*) FROM ({ORACLES[query]})) AS n_rows, "
    f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {ORACLES[query]})) AS n_columns"
    for name, query in BUNDLE
)
ORACLES["report_export"] = ORACLES["top_regions"]
ORACLES["json_round_trip"] = on_repaired(
    "SELECT gravite, count(*) AS n, CAST(sum(nombre_deces) AS BIGINT) AS deces FROM rep GROUP BY gravite"
)
