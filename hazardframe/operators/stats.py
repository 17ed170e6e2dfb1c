"""Association and distribution statistics, each from one or two grouped aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions.joins import attach, lookup, materialise
from hazardframe.functions.ordered import value_counts
from hazardframe.functions.scalar import col, n_rows, per_100, share, weighted_mean
from hazardframe.roles import FATAL, INCIDENT, Roles


def weighted_means(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(weighted_mean(value, weight).alias("weighted_mean"))


def wilson_interval(p: Column | str, n: Column | str, alpha: float = 0.05) -> tuple[Column, Column]:
    """Wilson score bounds of a proportion, inside [0, 1]; NULL for an empty sample."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    p, n = col(p), col(n).cast("double")
    spread = F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = p + F.try_divide(F.lit(z * z / 2), n)
    low, high = (centre - z * spread) / scale, (centre + z * spread) / scale
    known = spread.isNotNull()
    return F.when(known, F.greatest(low, F.lit(0.0))), F.when(known, F.least(high, F.lit(1.0)))


def fatal_share_interval(df: DataFrame, keys: Sequence[str], alpha: float = 0.05, r: Roles = INCIDENT) -> DataFrame:
    """Fatal share per group with its Wilson interval."""
    grouped = df.groupBy(*keys).agg(
        n_rows().alias("n"), (F.count_if(F.col(r.severity) == FATAL) / n_rows()).alias("p")
    )
    low, high = wilson_interval("p", "n", alpha)
    return grouped.select(*keys, "n", "p", low.alias("low"), high.alias("high"))


def association_ranking(
    df: DataFrame,
    columns: Sequence[str],
    target: str = INCIDENT.severity,
    null_as: str | None = "nan",
) -> DataFrame:
    """Cramér's V of each column with the target, strongest first, from one counting pass.

    The chi-square of a contingency table is ``N * (sum O^2 / (R C) - 1)``, which needs
    its filled cells only, so no grid is built. A 2x2 table gets the continuity
    correction. With ``null_as`` a missing value is a category of its own, otherwise
    pairs with one are left out. A constant column has no V.
    """
    text = lambda c: F.col(c).cast("string")
    named = df.select(text(target).alias("_y"), *[text(c).alias(f"x_{c}") for c in columns])
    cells = named.unpivot(["_y"], [f"x_{c}" for c in columns], "column", "_x")
    if null_as is not None:
        cells = cells.fillna(null_as, ["_x", "_y"])
    else:
        cells = cells.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    counts = cells.groupBy(F.substring("column", 3, 1000).alias("column"), "_x", "_y").agg(
        n_rows().cast("double").alias("_o")
    )
    # Sums of a table's rows and columns beside its cells; the first cell of each stands for it.
    in_row, in_column = (Window.partitionBy("column", c) for c in ("_x", "_y"))
    first = lambda w, other: F.row_number().over(w.orderBy(other)) == 1
    full = counts.withColumns({"_r": F.sum("_o").over(in_row), "_row": first(in_row, "_y")})
    full = full.withColumns({"_c": F.sum("_o").over(in_column), "_column": first(in_column, "_x")})
    parts = full.groupBy("column").agg(
        F.sum("_o").alias("_n"),
        F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("_f"),
        F.count_if("_row").alias("_rows"),
        F.sum(F.when(F.col("_row"), 1 / F.col("_r"))).alias("_ir"),
        F.count_if("_column").alias("_cols"),
        F.sum(F.when(F.col("_column"), 1 / F.col("_c"))).alias("_ic"),
    )

    phi2 = F.greatest(F.col("_f") - 1, F.lit(0.0))
    # In a 2x2 table all four cells are off by the same distance d, and chi2 = d^2 * sum 1/E.
    inverse = F.col("_n") * F.col("_ir") * F.col("_ic")
    distance = F.sqrt(phi2 * F.col("_n") / inverse)
    corrected = F.pow(F.greatest(distance - 0.5, F.lit(0.0)), 2) * inverse / F.col("_n")
    two_by_two = (F.col("_rows") == 2) & (F.col("_cols") == 2)
    v = F.sqrt(
        F.try_divide(F.when(two_by_two, corrected).otherwise(phi2), F.least("_rows", "_cols") - F.lit(1))
    )
    rounded = F.round(v, 4)
    strength = F.when(rounded < 0.1, "weak").when(rounded < 0.3, "moderate").otherwise("strong")
    return parts.select(
        "column", rounded.alias("cramers_v"), F.when(rounded.isNotNull(), strength).alias("strength")
    ).orderBy(F.desc("cramers_v"), "column")


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cramér's V of two columns over the rows that have both."""
    return association_ranking(df, [x], y, null_as=None)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle of pairwise-complete Pearson correlations, all from one grouping."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = list(combinations(columns, 2))
    cells = [x for i, (b, a) in enumerate(pairs) for x in (F.lit(i), F.col(a), F.col(b))]
    # One row per pair: 45 correlations as one aggregate each would outgrow generated code.
    long = numbers.select(F.stack(F.lit(len(pairs)), *cells).alias("pair", "x", "y"))
    found = long.groupBy("pair").agg(F.corr("x", "y").alias("corr"))
    name = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("pair") + 1)
    known = F.when(~F.isnan("corr"), F.col("corr"))
    return found.select(name(1).alias("row"), name(0).alias("column"), F.round(known, 6).alias("corr"))


def kernel_density(
    df: DataFrame, group: str, value: Column | str, points: int = 1000
) -> DataFrame:
    """Gaussian density per group on an even grid that reaches half a range beyond both ends.

    Scott's bandwidth: n^(-1/5) times the sample deviation. Each counted value adds to
    every grid point inside its own task; only (group, point) sums are shuffled.
    """
    counts = value_counts(df, [group], col(value).cast("double"))
    known = df.select(group, col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    shape = known.groupBy(group).agg(
        n_rows().alias("_n"), F.stddev("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    half = (F.col("_max") - F.col("_min")) / 2
    shape = shape.select(
        group,
        "_n",
        (F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h"),
        (F.col("_min") - half).alias("_from"),
        (4 * half / F.lit(points - 1)).alias("_step"),
    )
    terms = attach(counts, shape, [group], ["_n", "_h", "_from", "_step"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    )
    x = F.col("_from") + F.col("point") * F.col("_step")
    u = (x - F.col("value")) / F.col("_h")
    scale = F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi())
    return terms.groupBy(group, "point").agg(
        F.round(F.max(x), 6).alias("x"),
        F.round(F.sum(F.col("n") * F.exp(-0.5 * u * u) / scale), 9).alias("density"),
    )


def grid_density(
    df: DataFrame, keys: Sequence[str], value: Column | str, points: int = 1000, reach: float = 8.0
) -> DataFrame:
    """Gaussian density per combination of ``keys``, as in ``kernel_density``, from binned values.

    A value gives its weight to the two grid points around it, in proportion to its distance, so
    a group becomes at most ``points`` rows whatever its values; a grid point then adds to those within
    ``reach`` bandwidths. The work after binning is bounded by the grid, and the error is at most
    about step^2 / (8 h^2) of the largest density. Groups without a spread have no density.
    """
    known = df.select(*keys, col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    shape = known.groupBy(*keys).agg(
        n_rows().alias("_n"), F.stddev("_v").alias("_sd"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )
    half = (F.col("_max") - F.col("_min")) / 2
    shape = shape.where("_sd > 0").select(
        *keys,
        "_n",
        (F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))).alias("_h"),
        (F.col("_min") - half).alias("_from"),
        (4 * half / F.lit(points - 1)).alias("_step"),
    )
    shape = materialise(shape)
    rows = lookup(value_counts(known, keys, "_v"), shape, keys, ["_n", "_h", "_from", "_step"]).where("_h is not null")
    place = (F.col("value") - F.col("_from")) / F.col("_step")
    cell = F.least(F.floor(place), F.lit(points - 2))
    sides = F.array(
        F.struct(cell.alias("c"), (F.col("n") * (1 - (place - cell))).alias("w")),
        F.struct((cell + 1).alias("c"), (F.col("n") * (place - cell)).alias("w")),
    )
    binned = rows.select(*keys, F.explode(sides).alias("s")).groupBy(*keys, F.col("s.c").alias("c")).agg(F.sum("s.w").alias("w"))
    binned = lookup(binned, shape, keys, ["_n", "_h", "_from", "_step"])
    width = F.ceil(reach * F.col("_h") / F.col("_step"))
    near = F.sequence(F.greatest(F.col("c") - width, F.lit(0)), F.least(F.col("c") + width, F.lit(points - 1)))
    terms = binned.select("*", F.explode(near).alias("point"))
    u = (F.col("point") - F.col("c")) * F.col("_step") / F.col("_h")
    scale = F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi())
    return terms.groupBy(*keys, "point").agg(
        F.round(F.max(F.col("_from") + F.col("point") * F.col("_step")), 6).alias("x"),
        F.round(F.sum(F.col("w") * F.exp(-0.5 * u * u) / scale), 9).alias("density"),
    )


def extremes(df: DataFrame, r: Roles = INCIDENT) -> DataFrame:
    """Deadliest hour, the two deadliest causes and the region with the highest fatal share: one pass."""
    kinds = {"deadliest_hour": (r.hour, 1), "deadliest_cause": (r.cause, 2), "deadliest_region": (r.region, 1)}
    # Ties go to the smallest key, an hour's by number.
    keys = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("insight"), F.col(c).cast("string").alias("value"),
                 (F.col(c) if c == r.hour else F.lit(None)).cast("long").alias("number"))
        for kind, (c, _) in kinds.items()
    ]))
    rows = df.select((F.col(r.severity) == FATAL).alias("_fatal"), keys.alias("k")).select("_fatal", "k.*")
    grouped = rows.where(F.col("value").isNotNull()).groupBy("insight", "value", "number").agg(
        F.count_if("_fatal").alias("_deadly"), share(F.col("_fatal"), 4).alias("_share"))
    of_region = F.col("insight") == "deadliest_region"
    measure = F.when(of_region, F.col("_share")).otherwise(F.col("_deadly").cast("double"))
    best = Window.partitionBy("insight").orderBy(F.desc("measure"), "number", "value")
    ranked = grouped.where(of_region | (F.col("_deadly") > 0)).withColumn("measure", measure).withColumn("_at", F.row_number().over(best))
    most = F.element_at(F.create_map(*[F.lit(x) for kind, (_, n) in kinds.items() for x in (kind, n)]), F.col("insight"))
    return ranked.where(F.col("_at") <= most).select("insight", "value", "measure")


def exposures(r: Roles = INCIDENT) -> dict[str, Column]:
    """The exposures whose relative risk is published."""
    return {
        "weekend": F.weekday(r.date) >= 5,
        "holiday": F.col(r.holiday) == "Oui",
        "rainy_season": F.month(r.date).isin([3, 4, 5, 6, 7, 10, 11]),
        "no_helmet": F.col(r.helmet) == "Non",
        "no_protection": (F.col(r.helmet) == "Non") & (F.col(r.belt) == "Non"),
        "excess_over_40": F.col(r.speed) - F.col(r.limit) > 40,
    }


def relative_risk(df: DataFrame, exposed: Mapping[str, Column], r: Roles = INCIDENT) -> DataFrame:
    """Fatal share with and without each exposure and their ratio, all in one aggregation.

    Rows whose exposure is unknown belong to neither side; an empty side gives NULL.
    """
    fatal = F.col(r.severity) == FATAL
    stats = []
    for name, test in exposed.items():
        parts = F.struct(
            F.count_if(test).alias("n_exposed"),
            per_100(F.count_if(test & fatal), F.count_if(test)).alias("a"),
            per_100(F.count_if(~test & fatal), F.count_if(~test)).alias("b"),
        )
        stats.append(parts.alias(name))
    long = df.agg(*stats).unpivot([], list(exposed), "exposure", "s")
    return long.select(
        "exposure",
        "s.n_exposed",
        F.round("s.a", 4).alias("fatal_pct_exposed"),
        F.round("s.b", 4).alias("fatal_pct_unexposed"),
        F.round(F.try_divide("s.a", "s.b"), 4).alias("relative_risk"),
    )
