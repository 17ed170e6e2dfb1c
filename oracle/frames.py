"""DuckDB oracles of the chart frames."""

from oracle.binding import on_repaired, rnd, sample

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CLASSES = ["Léger", "Grave", "Mortel"]
FATAL = "count(*) FILTER (WHERE gravite = 'Mortel')"


def _pct(part, whole="count(*)", digits=2):
    return rnd(f"100 * ({part})::DOUBLE / ({whole})", digits)


def _share(test, digits=2):
    return _pct(f"count(*) FILTER (WHERE {test})", digits=digits)


def _across(column, values, extra=""):
    return ", ".join(f"count(*) FILTER (WHERE {column} = '{v}') AS \"{v}\"" for v in values)


def _count(*keys, where="true", limit=""):
    k = ", ".join(keys)
    return on_repaired(f"SELECT {k}, count(*) AS n FROM rep WHERE {where} GROUP BY {k} ORDER BY n DESC, {k} {limit}")


def _box(keys, value):
    k, on = ", ".join(keys), " AND ".join(f"e.{c} IS NOT DISTINCT FROM s.{c}" for c in keys)
    return f"""
, e AS (SELECT {k}, {value}::DOUBLE AS v FROM rep WHERE {value} IS NOT NULL),
s AS (SELECT {k}, count(*) AS n, min(v) AS min, max(v) AS max, avg(v) AS m, stddev_samp(v) AS d,
    quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY ALL),
x AS (SELECT {', '.join('s.' + c for c in keys)}, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM e JOIN s ON {on} GROUP BY ALL)
SELECT {', '.join('s.' + c for c in keys)}, n, min, max, {rnd('m', 6)} AS mean, {rnd('d', 6)} AS std, q1, median, q3,
  q1 - 1.5 * (q3 - q1) AS low_fence, q3 + 1.5 * (q3 - q1) AS high_fence, outliers
FROM s JOIN x ON {' AND '.join(f's.{c} IS NOT DISTINCT FROM x.{c}' for c in keys)}"""


REGION_METRICS = {
    "pct_mortel": "100.0::DOUBLE * count(*) FILTER (WHERE gravite = 'Mortel') / count(*)",
    "vitesse_moy": "avg(vitesse_estimee)",
    "pct_nuit": "100.0::DOUBLE * count(*) FILTER (WHERE luminosite = 'Nuit') / count(*)",
    "pct_sans_epi": "100.0::DOUBLE * count(*) FILTER (WHERE port_casque = 'Non' OR port_ceinture = 'Non') / count(*)",
    "pct_pluie": "100.0::DOUBLE * count(*) FILTER (WHERE meteo = 'Pluie') / count(*)",
}
VEHICLE_METRICS = {
    "pct_mortel": REGION_METRICS["pct_mortel"],
    "vitesse_moy_2": "avg(vitesse_estimee) / 2",
    "pct_sans_epi": REGION_METRICS["pct_sans_epi"],
    "pct_nuit": REGION_METRICS["pct_nuit"],
    "pct_exces": "100.0::DOUBLE * count(*) FILTER (WHERE vitesse_estimee > limitation_vitesse) / count(*)",
}


def _long(metrics, key, table):
    return "\nUNION ALL ".join(
        f"SELECT {key}, '{name}' AS metric, {text} AS value FROM {table} GROUP BY {key}" for name, text in metrics.items()
    )


def _tree(levels):
    """One SELECT per depth, each node with the size of its parent."""
    parts = ["SELECT " + ", ".join(f"NULL::VARCHAR AS {c}" for c in levels)
             + ", CAST(0 AS INTEGER) AS depth, count(*) AS n, 100.0::DOUBLE AS pct_parent FROM rep"]
    for d in range(1, len(levels) + 1):
        shown = ", ".join(c if i < d else f"NULL::VARCHAR AS {c}" for i, c in enumerate(levels))
        over = f"PARTITION BY {', '.join(levels[: d - 1])}" if d > 1 else ""
        parts.append(
            f"SELECT {shown}, CAST({d} AS INTEGER), count(*), {_pct('count(*)', f'sum(count(*)) OVER ({over})')} "
            f"FROM rep GROUP BY {', '.join(levels[:d])}"
        )
    return on_repaired("\nUNION ALL ".join(parts))


ORACLES = {
    "scatter_sample": sample(
        3000, "accident_id, latitude, longitude, gravite, heure, vitesse_estimee, intervention_secours, type_route"
    ),
    "severity_distribution": on_repaired(
        "SELECT c AS gravite, count(gravite) AS n, " + _pct("count(gravite)", "(SELECT count(*) FROM rep)")
        + " AS pct FROM (SELECT unnest(['Léger', 'Grave', 'Mortel']) AS c) LEFT JOIN rep ON gravite = c GROUP BY c"
    ),
    "hour_weekday_matrix": on_repaired(
        f"SELECT heure, {_across('jour_semaine', DAYS)} FROM rep GROUP BY heure"
    ),
    "hourly_rate": on_repaired(
        f"SELECT heure, count(*) AS n, CAST(sum(nombre_deces) AS BIGINT) AS deces, {_pct('sum(nombre_deces)')} AS taux FROM rep GROUP BY heure"
    ),
    "cause_fatal_share": on_repaired(
        f"SELECT cause, count(*) AS nb, {FATAL} AS mortel, {_pct(FATAL)} AS pct FROM rep GROUP BY cause"
    ),
    "speed_box_by_severity": on_repaired(_box(["gravite"], "vitesse_estimee")),
    "speed_box_by_severity_and_road": on_repaired(_box(["gravite", "type_route"], "vitesse_estimee")),
    "cost_box_by_severity": on_repaired(_box(["gravite"], "cout_estime")),
    "region_radar": on_repaired(
        f"""
, m AS ({_long(REGION_METRICS, 'region', 'rep')})
SELECT region, metric, {rnd('value', 6)} AS value,
  {rnd('(value - (min(value) OVER (PARTITION BY metric))) / ((max(value) OVER (PARTITION BY metric)) - (min(value) OVER (PARTITION BY metric)) + 1e-10)', 6)} AS scaled
FROM m"""
    ),
    "vehicle_radar": on_repaired(
        f"""
, f AS (SELECT * FROM rep WHERE type_vehicule IN (
    SELECT type_vehicule FROM rep WHERE type_vehicule IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5))
SELECT type_vehicule, metric, {rnd('value', 6)} AS value FROM ({_long(VEHICLE_METRICS, 'type_vehicule', 'f')})"""
    ),
    "monthly_series": on_repaired(
        "SELECT strftime(date_accident, '%Y-%m') AS periode, count(*) AS accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces FROM rep GROUP BY 1"
    ),
    "monthly_by_severity": on_repaired(
        f"SELECT strftime(date_accident, '%Y-%m') AS periode, {_across('gravite', CLASSES)} FROM rep GROUP BY 1"
    ),
    "cause_severity_flow": on_repaired(
        "SELECT cause AS source, gravite AS target, count(*) AS value FROM rep WHERE cause IN "
        "(SELECT cause FROM rep WHERE cause IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 6) GROUP BY ALL"
    ),
    "region_counts": _count("region"),
    "top_causes": _count("cause", where="cause IS NOT NULL", limit="LIMIT 6"),
    "hour_by_period": on_repaired(
        f"SELECT heure, {_across('periode_journaliere', ['Matin', 'Après-midi', 'Soir', 'Nuit'])} FROM rep GROUP BY heure"
    ),
    "region_bars": on_repaired(
        f"SELECT region, count(*) AS n, CAST(sum(nombre_deces) AS BIGINT) AS deces, {_pct('sum(nombre_deces)', digits=1)} AS taux FROM rep GROUP BY region"
    ),
    "top_kinds": _count("type_accident", where="type_accident IS NOT NULL", limit="LIMIT 6"),
    "yearly_by_severity": on_repaired(
        "SELECT CAST(year(date_accident) AS INTEGER) AS annee, gravite, count(*) AS n FROM rep GROUP BY ALL"
    ),
    "town_table": on_repaired(
        f"SELECT *, taux_mort > 10 AS highlight FROM (SELECT ville, count(*) AS accidents, CAST(sum(nombre_deces) AS BIGINT) AS deces, "
        f"min(region) AS region, {_pct('sum(nombre_deces)', digits=1)} AS taux_mort FROM rep GROUP BY ville ORDER BY 2 DESC, 1 LIMIT 15)"
    ),
    "cause_by_severity": _count("cause", "gravite"),
    "protection_bars": on_repaired(
        f"""
, g AS (SELECT port_casque, port_ceinture, count(*) AS nb, {FATAL} AS mortel, {_pct(FATAL, digits=1)} AS pct FROM rep
  WHERE port_casque IS NOT NULL AND port_ceinture IS NOT NULL GROUP BY ALL)
SELECT *, 'Casque:' || port_casque || ' / Ceinture:' || port_ceinture AS label,
  {rnd('(SELECT avg(pct) FROM g)', 4)} AS mean_line, pct > (SELECT avg(pct) FROM g) AS above_mean FROM g"""
    ),
    "weather_by_severity": _count("meteo", "gravite"),
    **{
        f"cost_by_{name}_frame": on_repaired(
            f"SELECT {c}, sum(cout_estime)::DOUBLE AS total, {rnd('avg(cout_estime)', 2)} AS moyen, count(cout_estime) AS nb, "
            f"{rnd('sum(cout_estime)::DOUBLE / 1e6', 1)} AS \"total_M\", {rnd('avg(cout_estime) / 1e3', 1)} AS \"mean_K\" FROM rep GROUP BY {c}"
        )
        for name, c in {"region": "region", "cause": "cause"}.items()
    },
    "cause_speed_scatter": on_repaired(
        f"SELECT cause, {rnd('avg(vitesse_estimee)', 6)} AS vitesse_moy, {_pct(FATAL, digits=6)} AS taux_mort, count(*) AS n FROM rep GROUP BY cause"
    ),
    "yearly_cost_line": on_repaired(
        f"SELECT CAST(year(date_accident) AS INTEGER) AS annee, {rnd('sum(cout_estime)::DOUBLE / 1e9', 6)} AS \"cout_G\" FROM rep GROUP BY 1"
    ),
    "region_severity_tree": _tree(["region", "gravite"]),
    "protection_severity_tree": _tree(["port_casque", "port_ceinture", "gravite"]),
    "region_road_fatal_matrix": on_repaired(
        "SELECT region, " + ", ".join(
            _pct(f"count(*) FILTER (WHERE gravite = 'Mortel' AND type_route = '{t}')", f"nullif(count(*) FILTER (WHERE type_route = '{t}'), 0)")
            + f' AS "{t}"' for t in ("Urbaine", "Interurbaine", "Rurale")
        ) + " FROM rep GROUP BY region"
    ),
    "holiday_comparison": on_repaired(
        f"SELECT accident_fete, count(*) AS nb_accidents, {_pct(FATAL)} AS taux_mortalite, {rnd('avg(vitesse_estimee)', 2)} AS vitesse_moy, "
        f"{rnd('avg(cout_estime)', 2)} AS cout_moyen FROM rep GROUP BY accident_fete"
    ),
    "mean_excess_by_cause": on_repaired(
        f"SELECT cause, {rnd('avg(CASE WHEN vitesse_estimee < limitation_vitesse THEN 0 ELSE vitesse_estimee - limitation_vitesse END)', 6)} AS exces_moy "
        "FROM rep GROUP BY cause"
    ),
    "kpi_row": on_repaired(
        f"SELECT count(*) AS total, CAST(sum(nombre_deces) AS BIGINT) AS deces, CAST(sum(nombre_victimes) AS BIGINT) AS victimes, "
        f"{_pct('sum(nombre_deces)', digits=1)} AS taux, {rnd('sum(cout_estime)::DOUBLE / 1e9', 6)} AS \"cout_G\", count(DISTINCT region) AS regions, "
        f"{rnd('avg(intervention_secours)', 4)} AS intervention_moy FROM rep"
    ),
    "kpi_row_filtered_out": on_repaired(
        "SELECT count(*) AS total, CAST(coalesce(sum(nombre_deces), 0) AS BIGINT) AS deces, CAST(coalesce(sum(nombre_victimes), 0) AS BIGINT) AS victimes, "
        "0.0::DOUBLE AS taux, coalesce(sum(cout_estime), 0)::DOUBLE AS \"cout_G\", count(DISTINCT region) AS regions, "
        "avg(intervention_secours) AS intervention_moy FROM rep WHERE year(date_accident) = 2050"
    ),
    "quick_stats": on_repaired(
        f"SELECT 'total' AS stat, count(*)::DOUBLE AS value, NULL::DOUBLE AS pct FROM rep"
        + "".join(
            f"\nUNION ALL SELECT '{n}', count(*) FILTER (WHERE gravite = '{c}')::DOUBLE, {_share(f'''gravite = '{c}' ''', 1)} FROM rep"
            for n, c in {"mortels": "Mortel", "graves": "Grave", "legers": "Léger"}.items()
        )
        + f"\nUNION ALL SELECT 'vitesse_moyenne', {rnd('avg(vitesse_estimee)', 0)}, NULL FROM rep"
        + f"\nUNION ALL SELECT 'cout_moyen_K', {rnd('avg(cout_estime) / 1e3', 0)}, NULL FROM rep"
        + f"\nUNION ALL SELECT 'intervention_moyenne', {rnd('avg(intervention_secours)', 0)}, NULL FROM rep"
    ),
    "rate_bands": on_repaired(
        f"SELECT *, CASE WHEN taux < 50 THEN '0-50' WHEN taux < 65 THEN '50-65' WHEN taux < 80 THEN '65-80' WHEN taux < 100 THEN '80-100' ELSE '100+' END AS band FROM "
        f"(SELECT axe_routier, count(*) AS n, CAST(sum(nombre_deces) AS BIGINT) AS deces, {_pct('sum(nombre_deces)')} AS taux FROM rep GROUP BY axe_routier)"
    ),
    "event_hour_weekday": (
        "SELECT CAST(hour(ts) AS INTEGER) AS heure, "
        + ", ".join(f"count(*) FILTER (WHERE dayname(ts) = '{d}') AS \"{d}\"" for d in DAYS)
        + " FROM events GROUP BY 1"
    ),
}
