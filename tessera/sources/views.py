"""Spatial views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as points: (id, x, y, z, v, mark)."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), at(3).alias("v"), F.col("label").alias("mark"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as a 5 x 5 lattice of unit squares with customers as population and their orders as cases."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    cases = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("cases"))
    people = customers.groupBy("c_nationkey").agg(F.count("*").alias("pop"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    joined = n.join(people, n["id"] == people["c_nationkey"], "left").drop("c_nationkey").join(cases, n["id"] == cases["c_nationkey"], "left").drop("c_nationkey")
    row, col = F.floor(F.col("id") / 5).cast("int"), (F.col("id") % 5).cast("int")
    return joined.select("id", row.alias("row"), col.alias("col"), (col + 0.5).cast("double").alias("x"), (row + 0.5).cast("double").alias("y"), F.coalesce("pop", F.lit(0)).cast("double").alias("pop"), F.coalesce("cases", F.lit(0)).cast("double").alias("cases"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer on a lattice 50 wide: (id, row, col, x, y, z, stratum, cluster)."""
    c = table(spark, sf_dir, "customer")
    row, col = F.floor(F.col("c_custkey") / 50).cast("int"), (F.col("c_custkey") % 50).cast("int")
    return c.select(F.col("c_custkey").alias("id"), row.alias("row"), col.alias("col"), col.cast("double").alias("x"), row.cast("double").alias("y"), F.col("c_acctbal").alias("z"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("cluster"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events at their users' lattice sites: (id, site, x, y, day, t in days, value)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("site"), (F.col("user_id") % 5).cast("double").alias("x"), F.floor(F.col("user_id") / 5).cast("double").alias("y"),
        F.dayofyear("ts").cast("int").alias("day"), (F.unix_micros("ts") / 86400e6).alias("t"), "value",
    )
