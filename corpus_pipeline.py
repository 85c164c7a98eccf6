"""The training-data pipeline: five stages, each over all that the one before it kept.

Every stage takes any columns beside doc_id and text and returns those it was
given. Null and empty texts, repeated rows and null doc_ids pass through as the
operators say; an empty table gives an empty table. A stage rejects by doc_id:
all rows of a rejected id go, and rows without an id stay.
"""

from __future__ import annotations

import uuid
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, packing, quality, simhash, toxicity
from tessera.llm.common import read_table, remove, tidy, without


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that importance resampling doesn't draw; a null or empty text weighs as much as raw text does."""
    found = quality.classify(docs, read_table(spark, sf_dir, "labels"))
    return without(docs, found.where(~F.col("kept")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity reaches their language's threshold (0.7 where none was calibrated, and without a column lang)."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    found = toxicity.scores(docs, model)
    limit = F.coalesce(*(F.when(F.col("lang") == k, v) for k, v in model.thresholds.items()), F.lit(0.7))
    langs = docs.select("doc_id", limit.alias("limit")).distinct()
    strict = min([0.7, *model.thresholds.values()])
    some = found.where(F.col("score") >= strict).join(langs, "doc_id").where(F.col("score") >= F.col("limit"))
    return without(docs, some)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines of recurring templates; n_chars, where there is one, follows the text. No document goes."""
    out = line_dedup.drop_recurring(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in line_dedup.ADDED))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates; texts without words are alike."""
    found = simhash.text_near_duplicates(docs)
    return without(docs, found.where("doc_id != component_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences; a null text is an empty one, which has its end token only."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def fresh(stage):
    """``stage``, before which executors give back the memory that earlier stages took."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [("quality", good_quality), ("toxicity", not_toxic), ("line_dedup", without_boilerplate), ("near_dedup", one_of_each), ("packing", packed)]
STAGES = [(name, fresh(stage)) for name, stage in STAGES]

#: Classifiers, hashes and merge rounds: the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each returns is written to the shared folder and read again, and removed once the next one is written."""
    docs = read_table(spark, sf_dir, "documents")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    home, before = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{home}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
