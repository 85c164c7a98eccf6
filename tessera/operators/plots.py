"""Tables ready to be drawn: classes, labels and colours by id. Nothing here draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import classified
from tessera.operators import esda, gw
from tessera.operators.weights import Weights

#: The usual colours of cluster maps.
LISA_COLOURS = {"NS": "#d3d3d3", "HH": "#d7191c", "LH": "#abd9e9", "LL": "#2c7bb6", "HL": "#fdae61"}
HOTSPOT_COLOURS = {"Hot spot 99%": "#bd0026", "Hot spot 95%": "#f03b20", "Hot spot 90%": "#fd8d3c", "Not significant": "#d3d3d3", "Cold spot 90%": "#6baed6", "Cold spot 95%": "#3182bd", "Cold spot 99%": "#08519c"}


def coloured(label: Column, colours: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, colour in colours.items():
        out = F.when(label == name, colour).otherwise(out)
    return out


def choropleth(df: DataFrame, column: str, scheme: str = "quantiles", k: int = 5) -> DataFrame:
    return classified(df, column, scheme, k)


def lisa_map(values: DataFrame, w: Weights, permutations: int = 99, seed: int = 0) -> DataFrame:
    """(id, label, colour)."""
    return esda.local_permutations(values, w, "moran", permutations, seed).select("id", "label").withColumn("colour", coloured(F.col("label"), LISA_COLOURS))


def hotspot_map(values: DataFrame, w: Weights) -> DataFrame:
    return esda.hotspots(values, w).select("id", "label").withColumn("colour", coloured(F.col("label"), HOTSPOT_COLOURS))


def moran_scatter(values: DataFrame, w: Weights) -> tuple[DataFrame, DataFrame]:
    """(id, z, lag), and one row with the slope of the line through them."""
    points = esda.moran_scatter(values, w)
    return points, points.agg(F.regr_slope("lag", "z").alias("slope"), F.regr_intercept("lag", "z").alias("intercept"))


def local_coefficients(fitted: DataFrame, k: int, n: int, alpha: float = 0.05) -> DataFrame:
    """(id, value, significant) of one coefficient."""
    s = gw.significance(fitted, n, alpha, "none").where(F.col("coefficient") == k).select("id", F.col("reject").alias("significant"))
    return fitted.select("id", F.col("beta")[k].alias("value")).join(s, "id")


def bandwidth_curve(scores: DataFrame) -> DataFrame:
    """(bandwidth, score, best), in order of bandwidth."""
    least = scores.agg(F.min("score").alias("_m"))
    return scores.crossJoin(F.broadcast(least)).select("bandwidth", "score", (F.col("score") == F.col("_m")).alias("best")).orderBy("bandwidth")
