"""DuckDB oracles of the statistics, grids and hot spots."""

from statistics import NormalDist

from oracle.binding import on_repaired, rnd, sample

Z = NormalDist().inv_cdf(0.975)
ASSOCIATED = ["region", "type_route", "meteo", "luminosite", "type_vehicule", "cause", "etat_route",
              "port_casque", "port_ceinture", "type_accident", "periode_journaliere"]
NUMBERS = ["heure", "nombre_vehicules", "nombre_victimes", "nombre_deces", "limitation_vitesse",
           "vitesse_estimee", "exces_vitesse", "intervention_secours", "cout_estime", "gravite_num"]

EXTENDED = """ext AS (
  SELECT *, CASE WHEN vitesse_estimee IS NULL THEN NULL
      ELSE greatest(vitesse_estimee - limitation_vitesse, 0) END AS exces_vitesse,
    CASE gravite WHEN 'Léger' THEN 0 WHEN 'Grave' THEN 1 ELSE 2 END AS gravite_num FROM rep)"""


def _cramer(pairs):
    """Full grid of expected counts, then Pearson's chi-square; ``pairs`` has column, x, y."""
    return f"""
, p AS ({pairs}),
o AS (SELECT "column", x, y, count(*) AS c FROM p GROUP BY ALL),
rx AS (SELECT "column", x, sum(c) AS r FROM o GROUP BY ALL),
ry AS (SELECT "column", y, sum(c) AS s FROM o GROUP BY ALL),
nn AS (SELECT "column", sum(c)::DOUBLE AS n FROM o GROUP BY ALL),
k AS (SELECT nn."column", n, (SELECT count(*) FROM rx WHERE rx."column" = nn."column") AS nr,
        (SELECT count(*) FROM ry WHERE ry."column" = nn."column") AS nc FROM nn),
grid AS (
  SELECT k."column", n, nr, nc, r::DOUBLE * s / n AS e, coalesce(c, 0) AS c
  FROM k JOIN rx USING ("column") JOIN ry USING ("column") LEFT JOIN o USING ("column", x, y)),
chi AS (
  SELECT "column", any_value(n) AS n, any_value(least(nr, nc)) AS m,
    sum(CASE WHEN nr = 2 AND nc = 2 THEN greatest(abs(c - e) - 0.5, 0) ELSE abs(c - e) END ** 2 / e) AS x2
  FROM grid GROUP BY "column"),
v AS (SELECT "column", {rnd('sqrt(x2 / n / (m - 1))', 4)} AS cramers_v FROM chi)
SELECT "column", cramers_v,
  CASE WHEN cramers_v < 0.1 THEN 'weak' WHEN cramers_v < 0.3 THEN 'moderate' ELSE 'strong' END AS strength FROM v"""


def _correlations():
    parts = []
    for i, b in enumerate(NUMBERS):
        for a in NUMBERS[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS row, '{b}' AS \"column\", {rnd(f'corr({a}::DOUBLE, {b}::DOUBLE)', 6)} AS corr FROM ext"
            )
    return "\nUNION ALL ".join(parts)


EXPOSED = {
    "weekend": "isodow(date_accident) IN (6, 7)",
    "holiday": "accident_fete = 'Oui'",
    "rainy_season": "month(date_accident) IN (3, 4, 5, 6, 7, 10, 11)",
    "no_helmet": "port_casque = 'Non'",
    "no_protection": "port_casque = 'Non' AND port_ceinture = 'Non'",
    "excess_over_40": "vitesse_estimee > limitation_vitesse + 40",
}


def _risk(name, test):
    a = f"avg(CASE WHEN {test} THEN fatal END)"
    b = f"avg(CASE WHEN NOT ({test}) THEN fatal END)"
    return (
        f"SELECT '{name}' AS exposure, count(*) FILTER (WHERE {test}) AS n_exposed, {rnd(f'100 * {a}', 4)} AS fatal_pct_exposed, "
        f"{rnd(f'100 * {b}', 4)} AS fatal_pct_unexposed, {rnd(f'{a} / {b}', 4)} AS relative_risk FROM f"
    )


def _cells(table, keys=""):
    lead = f"{keys}, " if keys else ""
    return (
        f"SELECT {lead}round(CAST(round(latitude / 0.05) AS BIGINT) * 0.05::DOUBLE, 6) AS latitude, "
        f"round(CAST(round(longitude / 0.05) AS BIGINT) * 0.05::DOUBLE, 6) AS longitude, count(*) AS n "
        f"FROM {table} GROUP BY ALL"
    )


def _density(v):
    return f"""
, s AS (SELECT gravite AS g, count({v}) AS n, stddev_samp({v}) * count({v}) ** -0.2::DOUBLE AS h,
    min({v}) - (max({v}) - min({v})) / 2 AS x0, 2 * (max({v}) - min({v})) / 999 AS step FROM ext GROUP BY gravite),
p AS (SELECT s.*, CAST(i AS INTEGER) AS point, x0 + i * step AS x FROM s, range(1000) t(i)),
c AS (SELECT gravite AS g, {v} AS v, count(*) AS k FROM ext WHERE {v} IS NOT NULL GROUP BY ALL)
SELECT p.g AS gravite, point, {rnd('any_value(x)', 6)} AS x,
  {rnd('sum(k * exp(-0.5::DOUBLE * ((x - v) / h) * ((x - v) / h))) / any_value(n * h * sqrt(2 * pi()))', 9)} AS density
FROM p JOIN c ON p.g = c.g GROUP BY p.g, point"""


#: Values give their weight to the two grid points around them; the kernel runs between grid points.
GRID_DENSITY = f"""
, s AS (SELECT gravite AS g, type_route AS t, count(*) AS n, stddev_samp(cout_estime) * count(*) ** -0.2::DOUBLE AS h,
    min(cout_estime) - (max(cout_estime) - min(cout_estime))::DOUBLE / 2 AS x0, 2 * (max(cout_estime) - min(cout_estime))::DOUBLE / 999 AS step
  FROM rep WHERE cout_estime IS NOT NULL GROUP BY ALL HAVING stddev_samp(cout_estime) > 0),
v AS (SELECT s.*, (cout_estime - x0) / step AS place FROM rep JOIN s ON gravite = g AND type_route = t WHERE cout_estime IS NOT NULL),
b AS (SELECT g, t, CAST(floor(place) AS BIGINT) AS c, 1 - (place - floor(place)) AS w FROM v UNION ALL SELECT g, t, CAST(floor(place) AS BIGINT) + 1, place - floor(place) FROM v),
k AS (SELECT g, t, c, sum(w) AS w FROM b GROUP BY ALL),
p AS (SELECT s.*, i AS point FROM s, range(1000) r(i))
SELECT p.g AS gravite, p.t AS type_route, point, {rnd('any_value(x0 + point * step)', 6)} AS x,
  {rnd('sum(w * exp(-0.5::DOUBLE * ((point - c) * step / h) * ((point - c) * step / h))) / any_value(n * h * sqrt(2 * pi()))', 9)} AS density
FROM p JOIN k ON p.g = k.g AND p.t = k.t AND abs(point - c) <= ceil(8 * h / step) GROUP BY ALL"""


ORACLES = {
    "cost_density_by_severity_and_road": on_repaired(GRID_DENSITY),
    "weighted_mean_speed": on_repaired(
        "SELECT region, " + rnd(
            "sum(vitesse_estimee * nombre_vehicules) / sum(nombre_vehicules) FILTER (WHERE vitesse_estimee IS NOT NULL)", 6
        ) + " AS weighted_mean FROM rep GROUP BY region"
    ),
    "wilson_interval": on_repaired(
        f"""
, g AS (SELECT region, cause, count(*) AS n, avg(CASE WHEN gravite = 'Mortel' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM rep GROUP BY ALL),
w AS (SELECT *, 1 + {Z}::DOUBLE ** 2 / n AS d, p + {Z}::DOUBLE ** 2 / (2 * n) AS c,
  {Z}::DOUBLE * sqrt(p * (1 - p) / n + {Z}::DOUBLE ** 2 / (4 * n * n)) AS m FROM g)
SELECT region, cause, n, {rnd('p', 9)} AS p, {rnd('greatest(0, (c - m) / d)', 9)} AS low, {rnd('least(1, (c + m) / d)', 9)} AS high FROM w"""
    ),
    "cramers_v": on_repaired(
        _cramer(
            "SELECT 'port_casque' AS \"column\", port_casque AS x, accident_fete AS y FROM rep "
            "WHERE port_casque IS NOT NULL AND accident_fete IS NOT NULL"
        )
    ),
    "association_ranking": on_repaired(
        _cramer(
            "\nUNION ALL ".join(
                f"SELECT '{c}' AS \"column\", coalesce({c}, 'nan') AS x, coalesce(gravite, 'nan') AS y FROM rep" for c in ASSOCIATED
            )
        )
    ),
    "correlation_matrix": on_repaired(_correlations(), EXTENDED),
    "kernel_density": on_repaired(_density("exces_vitesse"), EXTENDED),
    "speed_density_by_severity": on_repaired(_density("vitesse_estimee"), EXTENDED),
    "extremes": on_repaired(
        f"""
, f AS (SELECT * FROM rep WHERE gravite = 'Mortel')
SELECT * FROM (SELECT 'deadliest_hour' AS insight, heure::VARCHAR AS value, count(*)::DOUBLE AS measure FROM f GROUP BY heure ORDER BY 3 DESC, heure LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'deadliest_cause', cause, count(*)::DOUBLE FROM f WHERE cause IS NOT NULL GROUP BY cause ORDER BY 3 DESC, cause LIMIT 2)
UNION ALL SELECT * FROM (SELECT 'deadliest_region', region, {rnd("100 * count(*) FILTER (WHERE gravite = 'Mortel')::DOUBLE / count(*)", 4)}
  FROM rep GROUP BY region ORDER BY 3 DESC, region LIMIT 1)"""
    ),
    "relative_risk": on_repaired(
        "\nUNION ALL ".join(_risk(n, t) for n, t in EXPOSED.items()),
        "f AS (SELECT *, CASE WHEN gravite = 'Mortel' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fatal FROM rep)",
    ),
    "black_spots": on_repaired(
        f"""
, c AS (SELECT CAST(round(latitude / 0.05) AS BIGINT) AS i, CAST(round(longitude / 0.05) AS BIGINT) AS j, count(*) AS n,
    CAST(sum(nombre_deces) AS BIGINT) AS deces, count(*) FILTER (WHERE gravite = 'Mortel') AS m
  FROM rep WHERE gravite <> 'Léger' GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY n DESC, i, j) AS INTEGER) AS rank, round(i * 0.05::DOUBLE, 6) AS latitude,
  round(j * 0.05::DOUBLE, 6) AS longitude, n, deces, {rnd('100 * m::DOUBLE / n', 1)} AS pct_mortel, n / 10 + 8.0::DOUBLE AS radius
FROM c ORDER BY 1 LIMIT 20"""
    ),
    "region_summary": on_repaired(
        f"""SELECT region, count(*) AS n, CAST(sum(nombre_deces) AS BIGINT) AS deces,
  {rnd("100 * count(*) FILTER (WHERE gravite = 'Mortel')::DOUBLE / count(*)", 1)} AS pct_mortel,
  {rnd('avg(latitude)', 4)} AS latitude, {rnd('avg(longitude)', 4)} AS longitude,
  CASE WHEN count(*) > 8000 THEN 80.0::DOUBLE ELSE count(*)::DOUBLE / 100 END AS radius FROM rep GROUP BY region"""
    ),
    "map_points": sample(6000, "accident_id, latitude, longitude, gravite, ville, cause, type_accident"),
    "density_grid": on_repaired(_cells("rep")),
    "heat_frames": on_repaired(_cells("rep", "periode_journaliere")),
}
