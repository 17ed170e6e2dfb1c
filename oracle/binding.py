"""DuckDB side of the test-table binding: the ``raw`` and ``rep`` CTEs every oracle starts from."""

RAW = """
raw AS (
  SELECT
    l_orderkey * 10 + l_linenumber AS accident_id,
    CAST(l_shipdate AS DATE) AS date_accident,
    CAST(l_partkey % 31 AS INTEGER) AS heure,
    dayname(l_shipdate) AS jour_semaine,
    CASE WHEN month(l_shipdate) <= 6 THEN 1 ELSE 2 END AS semestre,
    CASE WHEN (l_partkey % 31) % 24 BETWEEN 6 AND 11 THEN 'Matin'
         WHEN (l_partkey % 31) % 24 BETWEEN 12 AND 17 THEN 'Après-midi'
         WHEN (l_partkey % 31) % 24 BETWEEN 18 AND 21 THEN 'Soir'
         ELSE 'Nuit' END AS periode_journaliere,
    r_name AS region, n_name AS ville,
    6.0::DOUBLE + n_nationkey * 0.2::DOUBLE + (l_suppkey % 10) * 0.01::DOUBLE AS latitude,
    0.2::DOUBLE + (n_nationkey % 5) * 0.3::DOUBLE + (l_partkey % 10) * 0.01::DOUBLE AS longitude,
    s_name AS axe_routier,
    CASE WHEN p_size <= 16 THEN 'Urbaine' WHEN p_size <= 33 THEN 'Interurbaine' ELSE 'Rurale' END AS type_route,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Soleil' WHEN '2-HIGH' THEN 'Nuageux'
         WHEN '3-MEDIUM' THEN 'Pluie' WHEN '5-LOW' THEN 'Brouillard' END AS meteo,
    CASE o_orderstatus WHEN 'F' THEN 'Jour' WHEN 'O' THEN 'Nuit' ELSE 'Crépuscule' END AS luminosite,
    c_mktsegment AS type_vehicule,
    CAST(1 + l_linenumber % 3 AS INTEGER) AS nombre_vehicules,
    CASE WHEN l_suppkey % 20 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS nombre_victimes,
    CAST(CASE WHEN l_returnflag = 'R' THEN 1 + l_linenumber % 3 ELSE 0 END AS INTEGER) AS nombre_deces,
    CASE l_returnflag WHEN 'R' THEN 'Mortel' WHEN 'A' THEN 'Grave' WHEN 'N' THEN 'Léger' END AS gravite,
    CASE l_partkey % 8 WHEN 0 THEN 'Alcool' WHEN 1 THEN 'Téléphone' WHEN 2 THEN 'Fatigue'
         WHEN 3 THEN 'Excès de vitesse' WHEN 4 THEN 'Dépassement dangereux'
         WHEN 5 THEN 'Priorité non respectée' WHEN 6 THEN 'Freinage brusque' END AS cause,
    CASE WHEN l_suppkey % 4 = 0 THEN 'Dégradé' WHEN l_suppkey % 4 = 1 THEN 'Très dégradé'
         WHEN l_suppkey % 7 = 2 THEN NULL ELSE 'Bon' END AS etat_route,
    CAST(30 + 20 * (l_partkey % 5) AS INTEGER) AS limitation_vitesse,
    CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity * 4.5::DOUBLE END AS vitesse_estimee,
    CASE WHEN l_linestatus = 'O' THEN ' oui' ELSE 'Non' END AS port_casque,
    CASE WHEN l_discount < 0.045::DOUBLE THEN 'Oui' WHEN l_discount < 0.095::DOUBLE THEN 'NON ' ELSE '?' END AS port_ceinture,
    CASE WHEN l_suppkey % 25 = 3 THEN NULL ELSE CAST(floor(l_extendedprice / 3000) AS DOUBLE) END AS intervention_secours,
    CASE l_partkey % 6 WHEN 0 THEN 'Collision frontale' WHEN 1 THEN 'Collision arrière'
         WHEN 2 THEN 'Collision latérale' WHEN 3 THEN 'Collision piéton'
         WHEN 4 THEN 'Sortie de route' ELSE 'Renversement' END AS type_accident,
    CASE WHEN month(l_shipdate) = 12 AND day(l_shipdate) >= 24 THEN 'Oui' ELSE 'Non' END AS accident_fete,
    CASE WHEN l_partkey % 97 = 0 THEN -1 ELSE 1 END * CAST(round(l_extendedprice) AS BIGINT) AS cout_estime,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey
)"""

# Row-local repairs only; capital first letter, rest lower.
_BINARY = """CASE WHEN upper(trim({c})) IN ('OUI', 'NON')
         THEN upper(trim({c})[1]) || lower(trim({c})[2:]) END AS {c}"""

REPAIRED = f"""
rep AS (
  SELECT * REPLACE (
    CAST(((heure % 24) + 24) % 24 AS INTEGER) AS heure,
    CASE WHEN vitesse_estimee > 200 THEN 200.0::DOUBLE
         WHEN vitesse_estimee < 0 THEN 0.0::DOUBLE ELSE vitesse_estimee END AS vitesse_estimee,
    {_BINARY.format(c="port_casque")},
    {_BINARY.format(c="port_ceinture")},
    {_BINARY.format(c="accident_fete")})
  FROM raw
)"""


def on_raw(body: str, *ctes: str) -> str:
    """``body`` over the bound raw table, with further CTEs in between."""
    return "WITH " + ",\n".join([RAW, *ctes]) + "\n" + body


def on_repaired(body: str, *ctes: str) -> str:
    """``body`` over the row-repaired table ``rep``."""
    return on_raw(body, REPAIRED, *ctes)


def rnd(expr: str, digits: int) -> str:
    """Round half up on the decimal value, the rule Spark's round() follows for doubles."""
    scale = 18 if digits >= 6 else 12
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,{scale})), {digits}) AS DOUBLE)"


def row_hash(key: str, seed: int = 42) -> str:
    """The first 52 bits of the md5 of seed and key."""
    return f"('0x' || md5('{seed}|' || {key})[1:13])::BIGINT"


def sample(n: int, columns: str) -> str:
    """The ``n`` rows of least row hash."""
    return on_repaired(f"SELECT {columns} FROM rep ORDER BY {row_hash('accident_id')}, accident_id LIMIT {n}")
