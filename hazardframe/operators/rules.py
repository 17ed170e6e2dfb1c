"""Expert-rule severity estimate for whole tables, no training needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.scalar import flag
from hazardframe.operators.features import RISKY_WEATHER, excess_speed
from hazardframe.roles import INCIDENT, NIGHT, NO, Roles

# --------------------------------------------------------------------------
# Points, limits and class probabilities as published.
# --------------------------------------------------------------------------

EXCESS_POINTS = [(40, 3), (20, 2), (0, 1)]  # excess above -> points
NIGHT_POINTS, NIGHT_BEFORE, NIGHT_FROM = 2, 5, 22
WEATHER_POINTS = 2
CAUSE_POINTS = {"Alcool": 3, "Fatigue": 3, "Téléphone": 2}
NO_HELMET_POINTS = 2
RURAL_POINTS = 1
LIGHT_UP_TO, SERIOUS_UP_TO = 2, 5
PROBABILITIES = {"Léger": (0.70, 0.22, 0.08), "Grave": (0.25, 0.55, 0.20), "Mortel": (0.08, 0.25, 0.67)}

# --------------------------------------------------------------------------


def _points(r: Roles) -> dict[str, Column]:
    excess = excess_speed(r)
    speed = F.lit(0)
    for above, points in reversed(EXCESS_POINTS):
        speed = F.when(excess > above, points).otherwise(speed)
    cause = F.lit(0)
    for label, points in CAUSE_POINTS.items():
        cause = F.when(F.col(r.cause) == label, points).otherwise(cause)
    hour = F.col(r.hour)
    night = (F.col(r.light) == NIGHT) | (hour < NIGHT_BEFORE) | (hour >= NIGHT_FROM)
    return {
        "speeding": speed,
        "night": NIGHT_POINTS * flag(night),
        "weather": WEATHER_POINTS * flag(F.col(r.weather).isin(RISKY_WEATHER)),
        "cause": cause,
        "no_helmet": NO_HELMET_POINTS * flag(F.col(r.helmet) == NO),
        "rural_road": RURAL_POINTS * flag(F.col(r.road_type) == "Rurale"),
    }


def rule_severity(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Add the score (0..13), the factors behind it, the estimated class and its probabilities."""
    points = _points(r)
    score = sum(points.values(), F.lit(0))
    factors = F.array(*[F.when(p > 0, F.lit(name)) for name, p in points.items()])
    scored = df.withColumns({"score": score, "factors": F.filter(factors, lambda x: x.isNotNull())})
    label = F.when(F.col("score") <= LIGHT_UP_TO, "Léger").when(F.col("score") <= SERIOUS_UP_TO, "Grave")
    scored = scored.withColumn("predicted", label.otherwise("Mortel"))

    def probability(i: int) -> Column:
        light, serious, fatal = (p[i] for p in PROBABILITIES.values())
        chosen = F.when(F.col("predicted") == "Léger", light).when(F.col("predicted") == "Grave", serious)
        return chosen.otherwise(fatal)

    return scored.withColumns({f"p{i}": probability(i) for i in range(3)})
