"""Reference forecasts. Input: ``forecast_rows`` with a ``split`` column.

Predictions are long: one row per (model, horizon, SID, ISO_TIME) with
PRED_Y_LAT / PRED_Y_LON in the target space of the mode.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline import constants as K
from driftline.functions import geo
from driftline.functions.joins import broadcast_if_small
from driftline.functions.order_stats import same_keys
from driftline.operators.least_squares import dot, fit_groups
from driftline.session import cut_lineage

log = logging.getLogger(__name__)


def to_target_space(dlat: Column, dlon: Column, mode: str = K.TARGET_MODE) -> tuple[Column, Column]:
    """Displacements as they are, or as absolute positions (longitude wrapped)."""
    if mode == "displacement":
        return dlat, dlon
    return F.col("LAT") + dlat, geo.wrap_degrees(F.col("LON") + dlon)


def displacements(lat: str = "Y_LAT", lon: str = "Y_LON",
                  mode: str = K.TARGET_MODE) -> tuple[Column, Column]:
    """The inverse: target-space columns as displacements."""
    if mode == "displacement":
        return F.col(lat), F.col(lon)
    return F.col(lat) - F.col("LAT"), geo.angular_difference(lon, "LON")


def persistence() -> tuple[Column, Column]:
    return F.lit(0.0), F.lit(0.0)


def linear_extrapolation() -> tuple[Column, Column]:
    n = F.col("horizon") / F.lit(K.CADENCE_HOURS)
    return F.col("DELTA_LAT") * n, F.col("DELTA_LON") * n


def fit_climatology(train: DataFrame, mode: str = K.TARGET_MODE) -> DataFrame:
    """Mean training displacement per (horizon, BASIN), plus a row per horizon overall.

    The result is checkpointed: it is a fitted model, read by every prediction.
    """
    dlat, dlon = displacements(mode=mode)
    sums = train.groupBy("horizon", "BASIN").agg(
        F.count("*").alias("n"), F.sum(dlat).alias("lat"), F.sum(dlon).alias("lon"))
    sums = cut_lineage(sums)
    overall = sums.groupBy("horizon").agg(
        F.lit(None).cast("string").alias("BASIN"), F.lit(True).alias("overall"),
        (F.sum("lat") / F.sum("n")).alias("CLIM_DLAT"), (F.sum("lon") / F.sum("n")).alias("CLIM_DLON"))
    basins = sums.where("BASIN IS NOT NULL").select(
        "horizon", "BASIN", F.lit(False).alias("overall"),
        (F.col("lat") / F.col("n")).alias("CLIM_DLAT"), (F.col("lon") / F.col("n")).alias("CLIM_DLON"))
    return overall.unionByName(basins)


def basin_lookup(rows: DataFrame, means: DataFrame, by_basin: bool = True) -> DataFrame:
    """Climatology of each row: its basin's mean, else the overall mean of the horizon."""
    overall = means.where("overall").select(
        "horizon", F.col("CLIM_DLAT").alias("_g_lat"), F.col("CLIM_DLON").alias("_g_lon"))
    rows = rows.join(broadcast_if_small(overall), "horizon", "left")
    if by_basin:
        basins = means.where("NOT overall").drop("overall")
        rows = rows.join(broadcast_if_small(basins), ["horizon", "BASIN"], "left")
    else:
        rows = rows.withColumns({"CLIM_DLAT": F.lit(None).cast("double"),
                                 "CLIM_DLON": F.lit(None).cast("double")})
    return rows.withColumns({"CLIM_DLAT": F.coalesce("CLIM_DLAT", "_g_lat"),
                             "CLIM_DLON": F.coalesce("CLIM_DLON", "_g_lon")}).drop("_g_lat", "_g_lon")


def climatology() -> tuple[Column, Column]:
    return F.col("CLIM_DLAT"), F.col("CLIM_DLON")


def with_regression(rows: DataFrame, train: DataFrame, features=K.FEATURES) -> DataFrame:
    """``rows`` with the least-squares prediction of each lead time, ``REG_LAT`` and ``REG_LON``.

    All lead times are fitted in one scan; the weights, a row per lead time, are broadcast.
    """
    train.select(*features)  # raises when one is missing
    fits = fit_groups(train, features, ("Y_LAT", "Y_LON"), "horizon")
    table = rows.sparkSession.createDataFrame(
        [(h, *(x for k in (0, 1) for x in (s.weights[:, k].tolist(), float(s.intercepts[k])))) for h, s in fits.items()],
        "horizon int, _w_lat array<double>, _b_lat double, _w_lon array<double>, _b_lon double")
    values = F.array(*[F.col(c).cast("double") for c in features])
    return rows.join(F.broadcast(table), "horizon", "left").withColumns({
        f"REG_{s.upper()}": dot(values, F.col(f"_w_{s}")) + F.col(f"_b_{s}") for s in ("lat", "lon")}).drop(
        "_w_lat", "_b_lat", "_w_lon", "_b_lon")


#: The baselines that need no fitted model.
CLOSED_FORM = K.BASELINES[:3]


def run_baselines(rows: DataFrame, split_name: str = "test", names=K.BASELINES,
                  mode: str = K.TARGET_MODE) -> DataFrame:
    """All baselines in one pass over the rows of a partition.

    A baseline whose input columns are missing is left out with a warning (the regression
    needs all features, see ``forecast_rows(keep=...)``); an unknown name is an error.
    """
    split = rows.where(F.col("split") == split_name)
    made = {}
    for name in names:
        try:
            if name == "Persistence":
                made[name] = persistence()
            elif name == "Linear Extrapolation":
                made[name] = linear_extrapolation()
            elif name == "Climatology":
                means = fit_climatology(rows.where("split = 'train'"), mode)
                split, made[name] = basin_lookup(split, means), climatology()
            elif name == "Linear Regression":
                split = with_regression(split, rows.where("split = 'train'"))
                made[name] = F.col("REG_LAT"), F.col("REG_LON")
            else:
                raise ValueError(f"unknown baseline {name!r}")
        except AnalysisException as error:  # a column it needs is missing
            log.warning("baseline %s left out: %s", name, error)
    structs = []
    for name, (dlat, dlon) in made.items():
        fitted = name == "Linear Regression"  # on targets, so in their space
        lat, lon = (dlat, dlon) if fitted else to_target_space(dlat, dlon, mode)
        structs.append(F.struct(F.lit(name).alias("model"), lat.alias("PRED_Y_LAT"),
                                lon.alias("PRED_Y_LON")))
    keep = [c for c in split.columns if c not in ("CLIM_DLAT", "CLIM_DLON", "REG_LAT", "REG_LON")]
    return split.select(*keep, F.explode(F.array(*structs)).alias("_p")) \
                .select(*keep, "_p.model", "_p.PRED_Y_LAT", "_p.PRED_Y_LON")


def union_forecasts(*tables: DataFrame) -> DataFrame:
    """Stack prediction tables of several models or horizons."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out
