"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one numpy step: few enough that their word lists stay small.
CHUNK_CHARS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the cluster's shared checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a
    temporary folder is chosen on a single machine (tests), and a cluster raises.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint"))
    return df.checkpoint(eager=True)


def release() -> None:
    """Gives what a Python worker has freed back to the machine, at a task's end: the worker lives on into other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(spark: SparkSession) -> None:
    """Lets the context's cleaner remove at once the shuffle files of what is checkpointed and not referred to any more.

    Executors then collect theirs too, which gives the heap that earlier work has
    made large back to the machine: two short tasks for each core, so that every
    executor is likely to get one. Nothing depends on it.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc")).alias("gc")).write.format("noop").mode("overwrite").save()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels may not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def slices(batches, rows: int = 512):
    """The batches in runs of few rows: what Python holds of them at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(sizes: list[int], most: int = CHUNK_CHARS):
    """Slices of consecutive rows whose sizes sum to about ``most`` (one row at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


#: Ids handed to every task up to this number (8 bytes each); beyond it rows are joined to them.
IDS_BROADCAST = 4_000_000


def without(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in ``ids`` (doc_id); rows without one stay."""
    ids = cut(ids.select("doc_id").where("doc_id is not null").distinct())
    few = ids.count() <= IDS_BROADCAST
    return documents.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(documents.columns)
