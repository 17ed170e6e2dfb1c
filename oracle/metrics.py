"""DuckDB oracles of the evaluation metrics and the expert rule."""

from oracle.binding import on_repaired, rnd

SCORED = """
sc AS (
  SELECT CASE gravite WHEN 'Léger' THEN 0 WHEN 'Grave' THEN 1 ELSE 2 END AS label,
    1 + l_partkey % 7 AS a0, 1 + l_suppkey % 5 AS a1, 1 + l_orderkey % 3 AS a2 FROM raw),
scored AS (
  SELECT label, a0::DOUBLE / (a0 + a1 + a2) AS p0, a1::DOUBLE / (a0 + a1 + a2) AS p1, a2::DOUBLE / (a0 + a1 + a2) AS p2,
    CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END AS prediction FROM sc)"""

NAMES = ["Léger", "Grave", "Mortel"]
PER_CLASS = "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"class\", count(*) FILTER (WHERE label = {i} AND prediction = {i})::DOUBLE AS tp, "
    f"count(*) FILTER (WHERE prediction = {i})::DOUBLE AS pp, count(*) FILTER (WHERE label = {i})::DOUBLE AS rp FROM scored"
    for i, name in enumerate(NAMES)
)
PRF = f"""
prf AS (
  SELECT "class", coalesce(tp / nullif(pp, 0), 0) AS pr, coalesce(tp / nullif(rp, 0), 0) AS re,
    coalesce(2 * tp / nullif(pp + rp, 0), 0) AS f, rp, tp FROM ({PER_CLASS}))"""

RANKED = "\nUNION ALL ".join(
    f"SELECT {i} AS c, (label = {i})::INT AS y, rank() OVER (ORDER BY p{i}) + (count(*) OVER (PARTITION BY p{i}) - 1) / 2 AS r FROM scored"
    for i in range(3)
)
LONG = "\nUNION ALL ".join(f"SELECT {i} AS c, p{i} AS s, (label = {i})::INT AS y FROM scored" for i in range(3))

EXCESS = "greatest(vitesse_estimee - limitation_vitesse, 0)"
FACTORS = {
    "speeding": f"CASE WHEN vitesse_estimee IS NULL THEN 0 WHEN {EXCESS} > 40 THEN 3 WHEN {EXCESS} > 20 THEN 2 WHEN {EXCESS} > 0 THEN 1 ELSE 0 END",
    "night": "CASE WHEN luminosite = 'Nuit' OR heure IN (0, 1, 2, 3, 4, 22, 23) THEN 2 ELSE 0 END",
    "weather": "CASE WHEN meteo IN ('Pluie', 'Brouillard') THEN 2 ELSE 0 END",
    "cause": "CASE WHEN cause IN ('Alcool', 'Fatigue') THEN 3 WHEN cause = 'Téléphone' THEN 2 ELSE 0 END",
    "no_helmet": "CASE WHEN port_casque = 'Non' THEN 2 ELSE 0 END",
    "rural_road": "CASE WHEN type_route = 'Rurale' THEN 1 ELSE 0 END",
}
POINTS = "pts AS (SELECT accident_id, " + ", ".join(f"{sql} AS {name}" for name, sql in FACTORS.items()) + " FROM rep)"
SCORE = " + ".join(FACTORS)
NAMED = "concat_ws(',', " + ", ".join(f"CASE WHEN {n} > 0 THEN '{n}' END" for n in FACTORS) + ")"


def _p(a, b, c):
    return f"(CASE WHEN score <= 2 THEN {a} WHEN score <= 5 THEN {b} ELSE {c} END)::DOUBLE"


ORACLES = {
    "confusion_matrix": on_repaired(
        "SELECT label, "
        + ", ".join(f"count(*) FILTER (WHERE prediction = {i}) AS n_{i}" for i in range(3))
        + ", "
        + ", ".join(f"{rnd(f'count(*) FILTER (WHERE prediction = {i})::DOUBLE / count(*)', 6)} AS share_{i}" for i in range(3))
        + " FROM scored GROUP BY label",
        SCORED,
    ),
    "classification_report": on_repaired(
        f"""
SELECT "class", {rnd('pr', 6)} AS precision, {rnd('re', 6)} AS recall, {rnd('f', 6)} AS f1, CAST(rp AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', NULL, NULL, {rnd('sum(tp) / sum(rp)', 6)}, CAST(sum(rp) AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', {rnd('avg(pr)', 6)}, {rnd('avg(re)', 6)}, {rnd('avg(f)', 6)}, CAST(sum(rp) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', {rnd('sum(pr * rp) / sum(rp)', 6)}, {rnd('sum(re * rp) / sum(rp)', 6)}, {rnd('sum(f * rp) / sum(rp)', 6)},
  CAST(sum(rp) AS BIGINT) FROM prf""",
        SCORED,
        PRF,
    ),
    "macro_scores": on_repaired(
        f"SELECT {rnd('avg(f)', 6)} AS f1_macro, {rnd('avg(re)', 6)} AS balanced_acc, {rnd('sum(tp) / sum(rp)', 6)} AS accuracy FROM prf",
        SCORED,
        PRF,
    ),
    # Mann-Whitney: the rank sum of the positives, tied scores sharing their mean rank.
    "class_auc": on_repaired(
        f"""
, r AS ({RANKED})
SELECT c AS "class", {rnd('(sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2)::DOUBLE / (sum(y) * sum(1 - y))', 9)} AS auc FROM r GROUP BY c""",
        SCORED,
    ),
    "macro_auc": on_repaired(
        f"""
, r AS ({RANKED}),
a AS (SELECT c, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2)::DOUBLE / (sum(y) * sum(1 - y)) AS auc FROM r GROUP BY c)
SELECT {rnd('avg(auc)', 9)} AS auc_ovr FROM a""",
        SCORED,
    ),
    "roc_points": on_repaired(
        f"""
, l AS ({LONG}),
g AS (SELECT c, s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM l GROUP BY c, s),
w AS (SELECT c, s, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, sum(pos) OVER (PARTITION BY c) AS p, sum(neg) OVER (PARTITION BY c) AS n
  FROM g WINDOW down AS (PARTITION BY c ORDER BY s DESC))
SELECT c AS "class", s AS threshold, {rnd('fp / n', 9)} AS fpr, {rnd('tp / p', 9)} AS tpr FROM w
UNION ALL SELECT DISTINCT c, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM g""",
        SCORED,
    ),
    "roc_curve": on_repaired(
        f"""
, l AS ({LONG}),
g AS (SELECT c, s, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM l GROUP BY c, s),
w AS (SELECT c, s, pos, neg, sum(pos) OVER down AS tp, sum(neg) OVER down AS fp, sum(pos) OVER (PARTITION BY c) AS p, sum(neg) OVER (PARTITION BY c) AS n,
    row_number() OVER down AS i, lead(pos) OVER down AS pos1, lead(neg) OVER down AS neg1
  FROM g WINDOW down AS (PARTITION BY c ORDER BY s DESC))
SELECT c AS "class", s AS threshold, {rnd('fp / n', 9)} AS fpr, {rnd('tp / p', 9)} AS tpr FROM w
  WHERE i = 1 OR pos1 IS NULL OR pos1 <> pos OR neg1 <> neg
UNION ALL SELECT DISTINCT c, NULL::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM g""",
        SCORED,
    ),
    "rule_severity": on_repaired(
        f"""
, s AS (SELECT *, {SCORE} AS score FROM pts)
SELECT accident_id, score, {NAMED} AS factors,
  CASE WHEN score <= 2 THEN 'Léger' WHEN score <= 5 THEN 'Grave' ELSE 'Mortel' END AS predicted,
  {_p(0.70, 0.25, 0.08)} AS p0, {_p(0.22, 0.55, 0.25)} AS p1, {_p(0.08, 0.20, 0.67)} AS p2 FROM s""",
        POINTS,
    ),
}
