"""The stages one after another, and each by its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL


def test_stages_keep_the_columns_and_the_clean_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, SMALL)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
            assert {r.doc_id for r in out.select("doc_id").collect()} == before
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept[name] <= before
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(good & kept["quality"]) >= 0.95 * len(good)
    assert len(clean & kept["toxicity"]) >= 0.9 * len(clean)
    assert kept["line_dedup"] == kept["toxicity"]


def test_stages_take_odd_rows(spark, odd, empty):
    """Nulls, repeated and empty texts, extra columns, no lang, no rows: every stage has a result, and no clean row is lost."""
    plain = odd.select("doc_id", "text", F.lit("x").alias("row"), F.lit(1).alias("limit"), F.lit(2).alias("root"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, plain, SMALL)
        assert out.columns == plain.columns
        kept = sorted(str(r.doc_id) for r in out.collect())
        assert kept == (["1", "3", "6", "7", "8", "None"] if name == "near_dedup" else kept) and "None" in kept
        if name == "line_dedup":
            assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in plain.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0
    pieces = corpus_pipeline.packed(spark, plain, SMALL).collect()
    assert len({r.doc_id for r in pieces}) == 9 and max(r.length for r in pieces) <= 1024


def test_run_leaves_only_the_last_input(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir")
    import os

    corpus_pipeline.run(spark, SMALL).count()
    homes = [d for d in os.listdir(before) if d.startswith("pipeline-")]
    assert homes and all(len(os.listdir(os.path.join(before, d))) == 1 for d in homes)


def test_run_is_the_last_stages_rows(spark):
    assert corpus_pipeline.run(spark, SMALL).where("length > 1024").isEmpty()


def test_stages_begin_with_memory_given_back(spark, empty):
    """Every executor is asked to collect its garbage before a stage takes memory of its own."""
    context = spark.sparkContext
    for name, stage in corpus_pipeline.STAGES:
        context.setJobGroup(f"stage-{name}", name)
        stage(spark, empty, SMALL)
        first = min(context.statusTracker().getJobIdsForGroup(f"stage-{name}"))
        info = context.statusTracker().getStageInfo(context.statusTracker().getJobInfo(first).stageIds[0])
        assert info.numTasks == 2 * context.defaultParallelism
    context.setLocalProperty("spark.jobGroup.id", None)


def test_operators_import_nothing_back():
    import ast
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent / "tessera"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            names = [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not [n for n in names if "llm" in n], path
