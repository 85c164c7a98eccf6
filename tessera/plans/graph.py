"""Connected components by the least label that reaches a node, with jumps over found labels."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed into the shared checkpoint folder, the session's own; a temporary one only on a single machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node, edges taken in both directions."""
    both = cut(edges.select("i", "j").union(edges.select("j", "i")).where("i != j").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("j"), F.col("component").alias("c")), "j").groupBy("i").agg(F.min("c").alias("c"))
        least = labels.join(near, labels["id"] == near["i"], "left").select("id", F.least("component", "c").alias("least"), "component")
        jump = labels.select(F.col("id").alias("least"), F.col("component").alias("further"))
        moved = cut(least.join(jump, "least").select("id", F.least("least", "further").alias("new"), "component"))
        labels = moved.select("id", F.col("new").alias("component"))
        if moved.where("new != component").isEmpty():
            return labels
