"""DuckDB oracles of the profiles and data quality reports."""

from hazardframe.roles import ALLOWED_VALUES
from oracle.binding import on_raw, on_repaired, rnd
from oracle.cleaning import on_clean

# Raw columns with the Spark type names the profile reports.
RAW_TYPES = {
    "accident_id": "bigint", "date_accident": "date", "heure": "int", "jour_semaine": "string",
    "semestre": "int", "periode_journaliere": "string", "region": "string", "ville": "string",
    "latitude": "double", "longitude": "double", "axe_routier": "string", "type_route": "string",
    "meteo": "string", "luminosite": "string", "type_vehicule": "string", "nombre_vehicules": "int",
    "nombre_victimes": "double", "nombre_deces": "int", "gravite": "string", "cause": "string",
    "etat_route": "string", "limitation_vitesse": "int", "vitesse_estimee": "double",
    "port_casque": "string", "port_ceinture": "string", "intervention_secours": "double",
    "type_accident": "string", "accident_fete": "string", "cout_estime": "bigint",
}
COLUMNS = list(RAW_TYPES)
NUMBERS = [c for c, t in RAW_TYPES.items() if t in ("int", "bigint", "double") and c != "accident_id"]


def each(columns, template, table="raw"):
    return "\nUNION ALL ".join(template.format(c=c, t=RAW_TYPES.get(c), table=table) for c in columns)


SLIM = f"slim AS (SELECT {', '.join(COLUMNS)} FROM raw)"
MISSING = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in COLUMNS)

DESCRIBE = (
    "SELECT '{c}' AS \"column\", count({c}) AS count, " + rnd("avg({c}::DOUBLE)", 9) + " AS mean, "
    + rnd("stddev_samp({c}::DOUBLE)", 9) + " AS std, min({c})::DOUBLE AS min, "
    "quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50, "
    "quantile_cont({c}::DOUBLE, 0.75) AS q75, max({c})::DOUBLE AS max, "
    + rnd("100 * count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)", 4) + " AS missing_pct FROM {table}"
)

BAD_ROWS = {
    "heure_hors_plage": ("heure < 0 OR heure > 23", "wrap modulo 24"),
    "cout_negatif": ("cout_estime < 0", "replace by median"),
    "deces_sup_victimes": ("nombre_deces > nombre_victimes", "drop the row"),
    "vitesse_aberrante": ("vitesse_estimee > 200", "clip to 200"),
}
ANOMALIES = "\nUNION ALL ".join(
    [
        f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {test}) AS n, "
        f"{rnd(f'100 * count(*) FILTER (WHERE {test})::DOUBLE / count(*)', 3)} AS pct, '{action}' AS action FROM raw"
        for name, (test, action) in BAD_ROWS.items()
    ]
    + [
        "SELECT 'doublons', count(*) - count(DISTINCT accident_id), "
        + rnd("100 * (count(*) - count(DISTINCT accident_id))::DOUBLE / count(*)", 3)
        + ", 'keep one row per id' FROM raw"
    ]
)

CATEGORIES = ["meteo", "gravite", "cause", "type_route"]

ALLOWED = ALLOWED_VALUES


def _unexpected(table):
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM {table} "
        f"WHERE {c} NOT IN ({', '.join(repr(v) for v in values)}) GROUP BY {c}"
        for c, values in ALLOWED.items()
    )


def _histogram(column, bins):
    return f"""
, e AS (SELECT {column}::DOUBLE AS v FROM rep WHERE {column} IS NOT NULL),
s AS (SELECT min(v) AS lo, (max(v) - min(v)) / {bins} AS w, avg(v) AS m, quantile_cont(v, 0.5) AS med FROM e),
b AS (SELECT CAST(least(floor((v - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM e, s GROUP BY 1)
SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, n, {rnd('m', 6)} AS mean, med AS median FROM b, s"""


ORACLES = {
    "table_summary": on_raw(
        "SELECT (SELECT count(*) FROM slim) AS rows, CAST(29 AS INTEGER) AS columns, "
        "(SELECT count(*) FROM slim) - (SELECT count(*) FROM (SELECT DISTINCT * FROM slim)) AS duplicates",
        SLIM,
    ),
    "null_ranking": on_raw(
        "SELECT * FROM (" + each(
            COLUMNS,
            "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, "
            + rnd("100 * count(*) FILTER (WHERE {c} IS NULL)::DOUBLE / count(*)", 2) + " AS pct FROM {table}",
        ) + ") WHERE missing > 0"
    ),
    "completeness": on_raw(
        f"SELECT 29 * count(*) - ({MISSING}) AS known, {MISSING} AS missing, "
        f"{rnd(f'100 * (29 * count(*) - ({MISSING}))::DOUBLE / (29 * count(*))', 2)} AS completeness_pct FROM raw"
    ),
    "column_profile": on_raw(
        each(
            COLUMNS,
            "SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, "
            + rnd("100 * (count(*) - count({c}))::DOUBLE / count(*)", 2) + " AS null_pct, "
            "count(DISTINCT {c}) AS \"distinct\", min({c}::VARCHAR) AS example FROM {table}",
        )
    ),
    "value_frequencies": on_repaired(
        each(
            CATEGORIES,
            "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, "
            + rnd("100 * count(*)::DOUBLE / (SELECT count({c}) FROM {table})", 2)
            + " AS pct FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}",
            "rep",
        )
    ),
    "value_frequencies_with_null": on_repaired(
        each(
            CATEGORIES,
            "SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, "
            + rnd("100 * count(*)::DOUBLE / (SELECT count(*) FROM {table})", 2)
            + " AS pct FROM {table} GROUP BY {c}",
            "rep",
        )
    ),
    "histogram_speed": on_repaired(_histogram("vitesse_estimee", 40)),
    "histogram_hour": on_repaired(_histogram("heure", 24)),
    "describe": on_raw(each(NUMBERS, DESCRIBE)),
    "anomaly_report": on_raw(ANOMALIES),
    "class_balance": on_raw(
        "SELECT gravite, count(*) AS n, " + rnd("100 * count(*)::DOUBLE / sum(count(*)) OVER ()", 2) + " AS pct, "
        + rnd("(max(count(*)) OVER ())::DOUBLE / min(count(*)) OVER ()", 6) + " AS imbalance FROM raw GROUP BY gravite"
    ),
    "collection_report": on_raw(
        "SELECT count(*) AS nb_lignes, CAST(29 AS INTEGER) AS nb_colonnes, "
        "min(date_accident)::VARCHAR || ' → ' || max(date_accident)::VARCHAR AS periode, "
        f"{rnd(f'100 * (29 * count(*) - ({MISSING}))::DOUBLE / (29 * count(*))', 2)} AS completude_pct, "
        f"(SELECT CAST(sum(n) AS BIGINT) FROM ({ANOMALIES})) AS nb_anomalies, "
        "count(*) FILTER (WHERE gravite = 'Léger') AS \"nb_léger\", "
        "count(*) FILTER (WHERE gravite = 'Grave') AS nb_grave, "
        "count(*) FILTER (WHERE gravite = 'Mortel') AS nb_mortel FROM raw"
    ),
    "unexpected_values": on_repaired(_unexpected("rep")),
    "unexpected_values_of_clean": on_clean(_unexpected("clean")),
    "before_after": on_clean(
        "SELECT a AS rows_raw, b AS rows_clean, a - b AS rows_removed, "
        + rnd("100 * b::DOUBLE / a", 2)
        + " AS retention_pct, CAST(30 AS INTEGER) AS columns, m AS missing_left, d AS duplicates_left FROM "
        "(SELECT count(*) AS a FROM raw), (SELECT count(*) AS b, CAST("
        + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in COLUMNS)
        + " AS BIGINT) AS m FROM clean), "
        "(SELECT (SELECT count(*) FROM clean) - count(*) AS d FROM (SELECT DISTINCT * FROM clean))"
    ),
}
