"""Compute settings: what a thread pool's options are elsewhere is the session's configuration here."""

from __future__ import annotations

from pyspark.sql import SparkSession


def resolve_jobs(spark: SparkSession, n: int | None = None) -> int:
    """``n``, or the cluster's default parallelism for none or a number below 1."""
    return n if n and n > 0 else spark.sparkContext.defaultParallelism


def set_options(spark: SparkSession, jobs: int | None = None, **options: str) -> None:
    """Shuffle partitions for so many parallel tasks, and any other settings that may change at run time."""
    spark.conf.set("spark.sql.shuffle.partitions", str(resolve_jobs(spark, jobs)))
    for name, value in options.items():
        spark.conf.set(name, value)


def get_options(spark: SparkSession) -> dict[str, str]:
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold")
    return {n: spark.conf.get(n) for n in names}


def chunked(n: int, jobs: int) -> list[range]:
    """``n`` indices in up to ``jobs`` nearly equal runs."""
    return [range(n * k // jobs, n * (k + 1) // jobs) for k in range(jobs) if n * k // jobs < n * (k + 1) // jobs]
