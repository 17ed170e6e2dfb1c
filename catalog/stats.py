"""Statistics, grids and hot spots."""

from pyspark.sql import functions as F

from catalog.relations import on_repaired
from hazardframe.operators import geo as G
from hazardframe.operators import stats as S
from hazardframe.operators.features import excess_speed
from hazardframe.roles import ASSOCIATED, CORRELATED, SEVERITY_ORDER
from hazardframe.functions.scalar import mapped


def _rounded(df, *columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _with_excess(df):
    return df.withColumn("exces_vitesse", excess_speed())


def _correlations(df):
    df = _with_excess(df).withColumn("gravite_num", mapped("gravite", SEVERITY_ORDER))
    return S.correlation_matrix(df, CORRELATED)


POSITIONS = "accident_id latitude longitude gravite"

QUERIES = {
    "weighted_mean_speed": on_repaired(
        lambda df: _rounded(
            S.weighted_means(df, ["region"], "vitesse_estimee", "nombre_vehicules"), "weighted_mean", digits=6
        ),
        "region vitesse_estimee nombre_vehicules",
    ),
    "wilson_interval": on_repaired(
        lambda df: _rounded(S.fatal_share_interval(df, ["region", "cause"]), "p", "low", "high"),
        "region cause gravite",
    ),
    "cramers_v": on_repaired(S.cramers_v, "port_casque accident_fete", x="port_casque", y="accident_fete"),
    "association_ranking": on_repaired(
        S.association_ranking, " ".join([*ASSOCIATED, "gravite"]), columns=ASSOCIATED
    ),
    "correlation_matrix": on_repaired(
        _correlations,
        "heure nombre_vehicules nombre_victimes nombre_deces limitation_vitesse vitesse_estimee "
        "intervention_secours cout_estime gravite",
    ),
    "kernel_density": on_repaired(
        lambda df: S.kernel_density(_with_excess(df), "gravite", "exces_vitesse"),
        "gravite vitesse_estimee limitation_vitesse",
    ),
    "cost_density_by_severity_and_road": on_repaired(
        S.grid_density, "gravite type_route cout_estime", keys=["gravite", "type_route"], value="cout_estime"
    ),
    "extremes": on_repaired(S.extremes, "heure cause region gravite"),
    "relative_risk": on_repaired(
        lambda df: S.relative_risk(df, S.exposures()),
        "date_accident accident_fete port_casque port_ceinture vitesse_estimee limitation_vitesse gravite",
    ),
    "black_spots": on_repaired(G.black_spots, "latitude longitude gravite nombre_deces"),
    "region_summary": on_repaired(G.region_summary, "region latitude longitude gravite nombre_deces"),
    "density_grid": on_repaired(G.density_grid, "latitude longitude"),
    "heat_frames": on_repaired(G.heat_frames, "latitude longitude periode_journaliere"),
    "map_points": on_repaired(
        G.points, f"{POSITIONS} ville cause type_accident", columns=["ville", "cause", "type_accident"]
    ),
}
