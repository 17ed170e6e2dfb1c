"""DuckDB oracles of split sizes and class weights."""

from oracle.binding import on_repaired, rnd, row_hash
from oracle.cleaning import on_clean

LABELLED = "lab AS (SELECT CAST(list_position(['Léger', 'Grave', 'Mortel'], gravite) - 1 AS INTEGER) AS gravite_num FROM raw)"
SIZES = "siz AS (SELECT gravite_num, count(*) AS c FROM lab GROUP BY gravite_num)"

HASHED = f"""hashed AS (SELECT accident_id, CAST(list_position(['Léger', 'Grave', 'Mortel'], gravite) - 1 AS INTEGER) AS gravite_num,
  {row_hash('accident_id')} AS h FROM rep)"""
RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY gravite_num ORDER BY h) AS rn,
  count(*) OVER (PARTITION BY gravite_num) AS c FROM hashed)"""


def _beyond(rank):
    """Whether a row's hash lies above the one at a rank of its class."""
    return f"coalesce(h > max(CASE WHEN rn = {rank} THEN h END) OVER (PARTITION BY gravite_num), true)"


ALL = "count(*)"
KNOWN = {
    "heure": "numeric", "limitation_vitesse": "numeric", "nombre_vehicules": "numeric", "nombre_victimes": "numeric",
    "vitesse_estimee": "numeric", "cause": "category", "periode_journaliere": "category", "type_accident": "category",
    "port_casque": "category", "accident_fete": "category",
}
FILLED = {"vitesse_estimee", "cause", "nombre_victimes"}

PLANTED = f"""hashed AS (SELECT accident_id, CASE WHEN limitation_vitesse >= 90 THEN 2 WHEN cause = 'Alcool' THEN 1 ELSE 0 END AS gravite_num,
  {row_hash('accident_id')} AS h FROM clean)"""
OF_TRAIN = f"""hashed AS (SELECT accident_id, gravite_num, gravite, region, ville, axe_routier, {row_hash('accident_id')} AS h FROM clean)"""
PARTED = f"parted AS (SELECT *, CASE WHEN {_beyond('CAST(round(c * 0.2::DOUBLE) AS BIGINT)')} THEN 'train' ELSE 'test' END AS part FROM ranked)"
PREDICTED = on_clean(
    "SELECT accident_id, ['Léger', 'Grave', 'Mortel'][gravite_num + 1] AS gravite_predite, CAST(gravite_num AS INTEGER) AS classe_num "
    "FROM parted WHERE part = 'test'",
    PLANTED, RANKED, PARTED,
)


def _share(column, name):
    return (f"{name} AS (SELECT {column}, avg(CASE WHEN gravite = 'Mortel' THEN 1.0::DOUBLE ELSE 0 END) AS s, count(accident_id) AS n "
            f"FROM parted WHERE part = 'train' GROUP BY {column})")  # fmt: skip


CLASSES_OF_TEST = on_clean(
    "SELECT accident_id, CAST(gravite_num AS INTEGER) AS classe_num FROM parted WHERE part = 'test'", PLANTED, RANKED, PARTED
)
#: Each statement about models of the planted severity holds where its three classes occur.
PLANTED_OCCUR = "(SELECT count(DISTINCT gravite_num) FROM hashed) = 3"
SIZES_OF_CURVE = [0.1 + 0.9 * i / 7 for i in range(8)]


def _curve():
    """Rows of two of three folds below each size's hash; the rule is learned at every size."""
    below = "(SELECT 2 * count(*) FROM lucky WHERE h < {cut})"
    rows = (
        f"SELECT {round(size, 6)}::DOUBLE AS size, {below.format(cut=int(size * 2**52))} AS rows, 1.0::DOUBLE AS train_f1, 1.0::DOUBLE AS val_f1, "
        f"false AS overfitting WHERE {PLANTED_OCCUR}"
        for size in SIZES_OF_CURVE
    )
    return on_clean(
        " UNION ALL ".join(rows), PLANTED,
        f"lucky AS (SELECT {row_hash('accident_id', 43)} AS h FROM (SELECT accident_id FROM clean ORDER BY {row_hash('accident_id')}, accident_id LIMIT 3000))",
    )


ORACLES = {
    "logistic_scores": PREDICTED,
    "stored_model_scores": PREDICTED,
    "forest_values": CLASSES_OF_TEST,
    "boosted_values": CLASSES_OF_TEST,
    "model_comparison": on_clean(
        "SELECT unnest(['logistic', 'forest', 'boosted', 'boosted weighted']) AS model_name, 1.0::DOUBLE AS f1_macro, 1.0::DOUBLE AS balanced_acc, "
        f"1.0::DOUBLE AS auc_ovr, 1.0::DOUBLE AS cv_f1_mean, 0.0::DOUBLE AS cv_f1_std WHERE {PLANTED_OCCUR}",
        PLANTED,
    ),
    "search_results": on_clean(
        "SELECT CAST(rung AS INTEGER) AS rung, CAST(ceil(30 / power(2, rung)) AS INTEGER) AS settings, CAST(5 * power(2, rung) AS INTEGER) AS rounds, "
        f"1.0::DOUBLE AS best_f1 FROM range(6) t(rung) WHERE {PLANTED_OCCUR}",
        PLANTED,
    ),
    "learning_curve": _curve(),
    "forest_scores": PREDICTED,
    "boosted_scores": PREDICTED,
    "cross_validation": on_clean(
        "SELECT CAST(j AS INTEGER) AS fold, 1.0::DOUBLE AS f1_macro, 1.0::DOUBLE AS balanced_acc, 1.0::DOUBLE AS accuracy "
        "FROM range(5) t(j) WHERE (SELECT count(DISTINCT gravite_num) FROM hashed) = 3",
        PLANTED,
    ),
    "place_rates_of_train": on_clean(
        f"SELECT accident_id, part, {rnd('coalesce(a.s, w.s)', 9)} AS taux_mortalite_region, {rnd('coalesce(b.s, w.s)', 9)} AS taux_mortalite_ville, "
        f"coalesce(d.n, 0) AS nb_accidents_axe, {rnd('ln(1 + coalesce(d.n, 0))', 9)} AS log_nb_accidents_axe FROM parted p "
        "LEFT JOIN by_region a ON p.region = a.region LEFT JOIN by_town b ON p.ville = b.ville LEFT JOIN by_road d ON p.axe_routier = d.axe_routier, "
        "(SELECT avg(CASE WHEN gravite = 'Mortel' THEN 1.0::DOUBLE ELSE 0 END) AS s FROM parted WHERE part = 'train') w",
        OF_TRAIN, RANKED, PARTED, _share("region", "by_region"), _share("ville", "by_town"), _share("axe_routier", "by_road"),
    ),
    "split_members": on_repaired(
        f"SELECT accident_id, gravite_num, CASE WHEN {_beyond('CAST(round(c * 0.2::DOUBLE) AS BIGINT)')} THEN 'train' ELSE 'test' END AS part FROM ranked",
        HASHED,
        RANKED,
    ),
    "fold_members": on_repaired(
        "SELECT accident_id, gravite_num, "
        + " + ".join(f"CAST({_beyond(f'c * {j} // 5')} AS INTEGER)" for j in range(1, 5))
        + " AS fold FROM ranked",
        HASHED,
        RANKED,
    ),
    "feature_columns": on_repaired(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, '{kind}' AS kind, {ALL if c in FILLED else f'count({c})'} AS known FROM rep"
            for c, kind in KNOWN.items()
        )
    ),
    "split_counts": on_repaired(
        "SELECT gravite_num, 'test' AS part, CAST(round(c * 0.2::DOUBLE) AS BIGINT) AS n FROM siz UNION ALL "
        "SELECT gravite_num, 'train', c - CAST(round(c * 0.2::DOUBLE) AS BIGINT) FROM siz",
        LABELLED,
        SIZES,
    ),
    "fold_counts": on_repaired(
        "SELECT gravite_num, CAST(j AS INTEGER) AS fold, (c * (j + 1)) // 5 - (c * j) // 5 AS n FROM siz, range(5) t(j)",
        LABELLED,
        SIZES,
    ),
    "class_weights": on_repaired(
        f"SELECT gravite_num, c AS n, {rnd('(SELECT sum(c) FROM siz)::DOUBLE / ((SELECT count(*) FROM siz) * c)', 9)} AS weight FROM siz",
        LABELLED,
        SIZES,
    ),
}
