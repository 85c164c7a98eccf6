"""Simulated tables with known structure; every draw is a hash, so a table is the same on any cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.resample import uniform


def normal(seed: int, salt: str, *keys: str) -> Column:
    return F.sqrt(-2 * F.log(uniform(seed, f"{salt}-r", *keys))) * F.cos(2 * math.pi * uniform(seed, f"{salt}-a", *keys))


def lattice(spark: SparkSession, n: int = 8, seed: int = 0) -> DataFrame:
    """(id, row, col, x, y, z, binary): unit cells with a wave and noise; binary is z above its median."""
    d = spark.range(n * n).select("id", F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    d = d.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5, "z": F.sin(F.col("row") * (2 * math.pi / n)) + F.cos(F.col("col") * (2 * math.pi / n)) + 0.2 * normal(seed, "z", "id")})
    return d.crossJoin(F.broadcast(d.agg(F.percentile("z", 0.5).alias("_m")))).withColumn("binary", (F.col("z") > F.col("_m")).cast("int")).drop("_m")


def csr_points(spark: SparkSession, n: int = 100, seed: int = 1) -> DataFrame:
    return spark.range(n).withColumns({"x": uniform(seed, "x", "id"), "y": uniform(seed, "y", "id")})


def _simulated(spark: SparkSession, n: int, seed: int, size: float, features: dict[str, tuple[float, float]], target: str, base: float, waves: dict[str, float], extra: dict[str, Column] | None = None) -> DataFrame:
    """Normal features by (mean, deviation) and a target whose coefficients vary over space."""
    d = spark.range(n).withColumns({"x": size * uniform(seed, "x", "id"), "y": size * uniform(seed, "y", "id")})
    if extra:
        d = d.withColumns(extra)
    d = d.withColumns({f: m + s * normal(seed, f, "id") for f, (m, s) in features.items()})
    value = F.lit(float(base))
    for k, (f, c) in enumerate(waves.items()):
        m, s = features[f]
        value = value + c * (1 + 0.5 * F.sin(F.col("x" if k % 2 else "y") * (math.pi / size))) * (F.col(f) - m) / s
    return d.withColumn(target, value + 0.1 * abs(base) * normal(seed, target, "id"))


def georgia(spark: SparkSession) -> DataFrame:
    """159 rows with six covariates and TotPop90."""
    return _simulated(spark, 159, 42, 300.0, {"PctRural": (70, 25), "PctBach": (11, 5), "PctEld": (12, 3), "PctFB": (1.1, 1), "PctPov": (19, 7), "PctBlack": (27, 17)}, "TotPop90", 41.0, {"PctBach": 9, "PctRural": -6, "PctFB": 5, "PctPov": -3, "PctEld": -2, "PctBlack": 1})


def london_houses(spark: SparkSession) -> DataFrame:
    """500 rows with five covariates and Price."""
    d = _simulated(spark, 500, 43, 40.0, {"FloorArea": (95, 30), "Bathrooms": (1.5, 0.6), "Bedrooms": (2.8, 1), "DistCenter": (10, 5), "GreenSpace": (30, 12)}, "Price", 300.0, {"FloorArea": 90, "DistCenter": -50, "GreenSpace": 20, "Bathrooms": 15, "Bedrooms": 10})
    return d.withColumns({"Bathrooms": F.greatest(F.lit(1), F.round("Bathrooms").cast("int")), "Bedrooms": F.greatest(F.lit(1), F.round("Bedrooms").cast("int"))})


def beijing_pm25(spark: SparkSession) -> DataFrame:
    """300 rows with five covariates and PM25."""
    return _simulated(spark, 300, 44, 150.0, {"AOD": (0.6, 0.25), "DEM": (200, 120), "Wind": (2.5, 0.9), "Temperature": (13, 6), "Humidity": (55, 15)}, "PM25", 75.0, {"AOD": 22, "DEM": -9, "Wind": -8, "Humidity": 6, "Temperature": -3})


def ncovid(spark: SparkSession) -> DataFrame:
    """400 rows at times 1 to 4 with five covariates and MortalityRate."""
    return _simulated(spark, 400, 45, 400.0, {"PopDensity": (300, 150), "MedianAge": (39, 5), "PctUninsured": (10, 4), "HospBeds": (2.8, 1.1), "Mobility": (0, 10)}, "MortalityRate", 2.0, {"MedianAge": 0.5, "PctUninsured": 0.3, "PopDensity": 0.3, "HospBeds": -0.2, "Mobility": 0.1}, {"time": (F.col("id") % 4 + 1).cast("double")})


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", x: str = "x", y: str = "y", **options) -> DataFrame:
    """A table of points from parquet, csv, json or orc; the coordinate columns become x and y."""
    d = spark.read.options(**({"header": True, "inferSchema": True} if fmt == "csv" else {}), **options).format(fmt).load(path)
    return d.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})


GEOJSON = "struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(type, ring or point, properties) of line-delimited GeoJSON features; a polygon's outer ring."""
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace("value", ",\\s*$", ""), GEOJSON).alias("f")).where("f.geometry is not null")
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.from_json(raw, "array<double>")
    ring = F.from_json(raw, "array<array<array<double>>>")[0]
    return rows.select(
        kind.alias("type"), F.when(kind == "Point", point[0]).alias("x"), F.when(kind == "Point", point[1]).alias("y"),
        F.when(kind == "Polygon", F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("ring"), F.col("f.properties").alias("properties"),
    )
