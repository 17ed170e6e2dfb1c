"""Binding of the star-schema test tables to the raw incident schema.

``incidents(spark, dir, columns)`` joins only the dimensions that the asked
columns need: every line row has exactly one match in each dimension, so a join
that feeds no column changes nothing and is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.roles import ALLOWED_VALUES, RAW_COLUMNS

# One row per business key is not guaranteed by accident_id; these five columns are.
TIE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

_NEEDS = {
    "region": {"orders", "customer", "nation", "region"},
    "ville": {"orders", "customer", "nation"},
    "latitude": {"orders", "customer"},
    "longitude": {"orders", "customer"},
    "axe_routier": {"supplier"},
    "type_route": {"part"},
    "meteo": {"orders"},
    "luminosite": {"orders"},
    "type_vehicule": {"orders", "customer"},
}


def _pick(index: Column, labels: list[str]) -> Column:
    """``labels[index]``, NULL beyond the end."""
    return F.try_element_at(F.array(*[F.lit(v) for v in labels]), index + 1)


def _expressions() -> dict[str, Callable[[], Column]]:
    """How to build each raw column; only the asked ones are built."""
    part, supp, size = F.col("l_partkey"), F.col("l_suppkey"), F.col("p_size")
    day = F.to_date("l_shipdate")
    raw_hour = part % 31
    hour = raw_hour % 24
    return {
        "accident_id": lambda: F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        "date_accident": lambda: day,
        "heure": lambda: raw_hour.cast("int"),
        "jour_semaine": lambda: F.date_format(day, "EEEE"),
        "semestre": lambda: F.when(F.month(day) <= 6, 1).otherwise(2),
        "periode_journaliere": lambda: F.when(hour.between(6, 11), "Matin")
        .when(hour.between(12, 17), "Après-midi")
        .when(hour.between(18, 21), "Soir")
        .otherwise("Nuit"),
        "region": lambda: F.col("r_name"),
        "ville": lambda: F.col("n_name"),
        "latitude": lambda: F.lit(6.0) + F.col("c_nationkey") * F.lit(0.2) + (supp % 10) * F.lit(0.01),
        "longitude": lambda: F.lit(0.2)
        + (F.col("c_nationkey") % 5) * F.lit(0.3)
        + (part % 10) * F.lit(0.01),
        "axe_routier": lambda: F.col("s_name"),
        "type_route": lambda: F.when(size <= 16, "Urbaine")
        .when(size <= 33, "Interurbaine")
        .otherwise("Rurale"),
        "meteo": lambda: F.when(F.col("o_orderpriority") == "1-URGENT", "Soleil")
        .when(F.col("o_orderpriority") == "2-HIGH", "Nuageux")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "Pluie")
        .when(F.col("o_orderpriority") == "5-LOW", "Brouillard"),
        "luminosite": lambda: F.when(F.col("o_orderstatus") == "F", "Jour")
        .when(F.col("o_orderstatus") == "O", "Nuit")
        .otherwise("Crépuscule"),
        "type_vehicule": lambda: F.col("c_mktsegment"),
        "nombre_vehicules": lambda: 1 + F.col("l_linenumber") % 3,
        "nombre_victimes": lambda: F.when(supp % 20 != 0, F.col("l_linenumber").cast("double")),
        "nombre_deces": lambda: F.when(F.col("l_returnflag") == "R", 1 + F.col("l_linenumber") % 3).otherwise(0),
        "gravite": lambda: F.when(F.col("l_returnflag") == "R", "Mortel")
        .when(F.col("l_returnflag") == "A", "Grave")
        .when(F.col("l_returnflag") == "N", "Léger"),
        "cause": lambda: _pick((part % 8).cast("int"), ALLOWED_VALUES["cause"]),
        "etat_route": lambda: F.when(supp % 4 == 0, "Dégradé")
        .when(supp % 4 == 1, "Très dégradé")
        .when(supp % 7 != 2, "Bon"),
        "limitation_vitesse": lambda: (30 + 20 * (part % 5)).cast("int"),
        "vitesse_estimee": lambda: F.when(F.col("l_tax") != 0, F.col("l_quantity") * 4.5),
        "port_casque": lambda: F.when(F.col("l_linestatus") == "O", " oui").otherwise("Non"),
        "port_ceinture": lambda: F.when(F.col("l_discount") < 0.045, "Oui")
        .when(F.col("l_discount") < 0.095, "NON ")
        .otherwise("?"),
        "intervention_secours": lambda: F.when(
            supp % 25 != 3, F.floor(F.col("l_extendedprice") / 3000).cast("double")
        ),
        "type_accident": lambda: _pick((part % 6).cast("int"), ALLOWED_VALUES["type_accident"]),
        "accident_fete": lambda: F.when((F.month(day) == 12) & (F.dayofmonth(day) >= 24), "Oui").otherwise("Non"),
        "cout_estime": lambda: F.when(part % 97 == 0, -1).otherwise(1)
        * F.round("l_extendedprice").cast("long"),
    }


# Declared schemas, so that opening a table starts no job.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def incidents(
    spark: SparkSession,
    sf_dir: str,
    columns: Iterable[str] | None = None,
    tie_key: bool = False,
) -> DataFrame:
    """Raw incidents with the asked columns (all 29 by default), plus the tie key if wanted."""
    wanted = list(columns) if columns is not None else list(RAW_COLUMNS)
    need = set().union(*(_NEEDS.get(c, set()) for c in wanted))
    df = table(spark, sf_dir, "lineitem")
    if "orders" in need:
        # The dimensions of an order, from order to region.
        chain = [
            ("orders", "l_orderkey", "o_orderkey"),
            ("customer", "o_custkey", "c_custkey"),
            ("nation", "c_nationkey", "n_nationkey"),
            ("region", "n_regionkey", "r_regionkey"),
        ]
        chain = [step for step in chain if step[0] in need]
        # Resolve the orders first, so that the lines meet one table.
        orders = table(spark, sf_dir, "orders")
        for name, left, right in chain[1:]:
            orders = orders.join(table(spark, sf_dir, name), F.col(left) == F.col(right))
        df = df.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    if "supplier" in need:
        supplier = table(spark, sf_dir, "supplier")
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey)
    if "part" in need:
        part = table(spark, sf_dir, "part")
        df = df.join(part, df.l_partkey == part.p_partkey)
    exprs = _expressions()
    extra = TIE_KEY if tie_key else []
    return df.select(*[exprs[c]().alias(c) for c in wanted], *extra)
