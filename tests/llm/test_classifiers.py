"""Held-out accuracy, sampling by brute force, and odd rows."""

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm.common import held_out
from tests.llm.conftest import ODD

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


@pytest.fixture(scope="module")
def toxic(tables):
    return toxicity.train(*tables)


def test_toxic_texts_of_the_held_out_third_are_told(tables, toxic):
    documents, labels = tables
    rows = toxicity.scores(documents, toxic).join(labels, "doc_id").where(held_out(F.col("doc_id"))).toPandas()
    assert rows.score.between(0, 1).all()
    assert (rows.score[rows.toxic == 1] >= 0.7).mean() >= 0.8
    assert (rows.score[rows.toxic == 0] >= 0.7).mean() <= 0.05


def test_training_never_sees_the_held_out_third(tables, toxic):
    documents, labels = tables
    other = toxicity.train(documents, labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(other.embedding, toxic.embedding) and other.bias == toxic.bias


def test_tables_give_the_convolution(toxic):
    text = "one two three four five"
    words, (numbers,) = toxicity.unique_words([text])
    vectors = toxic.embedding[toxicity.feature_rows(words)].sum(1)[np.concatenate([[0, 0], numbers, [0, 0, 0]])]
    pooled = [max((vectors[i : i + len(f)] * f[:, :, k]).sum() for i in range(len(vectors) - len(f) + 1)) + o[k] for f, o in zip(toxic.filters, toxic.offsets, strict=True) for k in range(toxicity.FILTERS)]
    score = 1 / (1 + math.exp(-(np.maximum(pooled, 0) @ toxic.output + toxic.bias)))
    assert toxic.score([text, "another text between"])[0] == pytest.approx(score, abs=1e-5)


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(3)
    texts = ["one two three four five six", "three two one", "seven", "", "two two nine ten one"]
    words, numbers = toxicity.unique_words(texts)
    features = toxicity.feature_rows(words)
    shape = (toxicity.DIMENSION, toxicity.FILTERS)
    model = toxicity.Model(rng.normal(0, 0.3, (toxicity.BUCKETS, toxicity.DIMENSION)), [rng.normal(0, 0.3, (k, *shape)) for k in toxicity.WIDTHS], [rng.normal(0, 1, toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(0, 1, len(toxicity.WIDTHS) * toxicity.FILTERS), 0.3, {})
    model.embedding[0] = 0
    labels, weight = np.array([1.0, 0, 1, 0, 0]), np.array([1.0, 2, 1, 0.5, 1])
    loss, grads, rows = toxicity.loss_gradients(model, features, numbers, labels, weight)
    params = [model.embedding, *model.filters, *model.offsets, model.output]
    assert set(rows) >= set(np.flatnonzero(np.abs(grads[0]).sum(1)))
    for k, param in enumerate(params):
        places = [(int(r), int(c)) for r, c in zip(rng.choice(rows, 8), rng.integers(0, toxicity.DIMENSION, 8))] if k == 0 else [tuple(int(rng.integers(n)) for n in param.shape) for _ in range(8)]
        for at in places:
            if k == 0 and at[0] == 0:
                continue
            held = param[at]
            param[at] = held + 1e-6
            more = toxicity.loss_gradients(model, features, numbers, labels, weight)[0]
            param[at] = held
            assert (more - loss) / 1e-6 == pytest.approx(grads[k][at], abs=1e-4)
    model.bias += 1e-6
    assert (toxicity.loss_gradients(model, features, numbers, labels, weight)[0] - loss) / 1e-6 == pytest.approx(grads[-1][0], abs=1e-4)


def test_scores_of_odd_rows(toxic, odd, empty, tables):
    rows = toxicity.scores(odd, toxic).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[3] == by[4] == by[5]
    assert toxicity.scores(empty, toxic).count() == 0
    none = toxicity.train(odd, tables[1].limit(0))
    assert none.score(["anything"])[0] < 0.1


def test_thresholds_follow_the_language():
    model = type("Fixed", (), {"score": lambda self, texts: np.array([float(t) for t in texts])})()
    got = toxicity.calibrated(model, ["0.2", "0.45", "0.5", "0.9"], np.array([0, 1, 1, 1]), ["de"] * 4)
    assert 0.2 < got["de"] <= 0.45
    assert toxicity.calibrated(model, ["0.2"], np.array([0]), ["fr"]) == {}


@pytest.fixture(scope="module")
def sampled(tables):
    return quality.classify(*tables).toPandas()


def test_good_documents_are_drawn_and_bad_ones_not(tables, sampled):
    labels = tables[1].toPandas().merge(sampled, on="doc_id")
    rest = labels[labels.held_out]
    assert rest.kept[rest.quality == 1].mean() >= 0.98
    # About as many as are good: then it is the bad that stay out.
    fewer = quality.classify(*tables, share=0.87).toPandas().merge(labels[["doc_id", "quality"]], on="doc_id")
    rest = fewer[fewer.held_out]
    assert rest.kept[rest.quality == 1].mean() >= 0.97
    assert rest.kept[rest.quality == 0].mean() <= 0.1


def test_the_share_is_that_of_good_rows(spark, tables, sampled):
    known = [r.quality for r in tables[1].where(~held_out(F.col("doc_id"))).collect()]
    p, n = np.mean(known), len(known)
    assert quality.good_share(tables[1]) == pytest.approx(p + 2 * math.sqrt(p * (1 - p) / n))
    assert sampled.kept.sum() >= math.ceil(quality.good_share(tables[1]) * len(sampled))
    assert quality.good_share(tables[1].limit(0)) == 1.0


def test_weights_and_keys_are_those_of_plain_python(tables, sampled, documents_by_id):
    """Both models counted n-gram by n-gram, the key rebuilt from its parts, the draw by sorting."""
    labels = tables[1].where("quality = 1").where(~held_out(F.col("doc_id"))).collect()
    features = quality.Features()
    counts = lambda texts: np.bincount(np.concatenate([features.of([t])[0] for t in texts]), minlength=quality.BUCKETS) + quality.SMOOTHING
    target, raw = counts([documents_by_id[r.doc_id] for r in labels]), counts(documents_by_id.values())
    log_ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for row in sampled.sample(60, random_state=1).itertuples():
        buckets = features.of([documents_by_id[row.doc_id]])[0]
        assert row.n_grams == len(buckets)
        assert row.log_weight == pytest.approx(quality.CHUNK * log_ratio[buckets].sum() / (len(buckets) + quality.SHRINK), abs=1e-6)
        assert -4 < row.gumbel_key - row.log_weight < 30
    k = math.ceil(quality.good_share(tables[1]) * len(sampled))
    assert sampled.kept.equals(sampled.gumbel_key >= np.sort(sampled.gumbel_key)[::-1][k - 1])


@pytest.fixture(scope="module")
def documents_by_id(tables):
    return {r.doc_id: r.text or "" for r in tables[0].collect()}


def test_noise_draws_other_rows_than_a_threshold(tables):
    """With half of the good rows wanted, many that a threshold would take stay out."""
    rows = quality.classify(*tables, share=0.4).toPandas()
    cut = np.sort(rows.log_weight)[::-1][int(rows.kept.sum()) - 1]
    assert 0.05 <= (rows.kept != (rows.log_weight >= cut)).mean() <= 0.6


def test_inclusion_follows_the_weights(spark):
    """Over many seeds a row is drawn as often as in sampling without replacement in proportion to the weights."""
    weights = np.array([0.0] * 20 + [1.0] * 20 + [2.0] * 20)
    rows = spark.createDataFrame([(i, float(w), i, float(w)) for i, w in enumerate(weights)], "doc_id long, ratio double, n_grams long, log_weight double").cache()
    seeds = 30
    keys = [rows.withColumn("gumbel_key", F.col("log_weight") + quality.gumbel(s, "doc_id", "n_grams", "ratio")).select("doc_id", F.lit(s).alias("seed"), "gumbel_key") for s in range(seeds)]
    every = keys[0]
    for one in keys[1:]:
        every = every.unionAll(one)
    frame = every.toPandas()
    drawn = np.zeros(60)
    for _, one in frame.groupby("seed"):
        drawn[one.nlargest(12, "gumbel_key").doc_id] += 1
    got = drawn.reshape(3, 20).mean(1) / seeds
    rng, plain = np.random.default_rng(4), np.zeros(60)
    for _ in range(4000):
        plain[rng.choice(60, 12, replace=False, p=np.exp(weights) / np.exp(weights).sum())] += 1
    assert np.abs(got - plain.reshape(3, 20).mean(1) / 4000).max() < 0.05
    one = quality.resample(rows, 12, seed=3).toPandas()
    assert set(one.doc_id[one.kept]) == set(frame[frame.seed == 3].nlargest(12, "gumbel_key").doc_id)


def test_kth_largest_by_bins(spark):
    values = np.random.default_rng(2).normal(size=500).tolist() + [1.5] * 20
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 20, 333, 520):
        assert quality.kth_largest(rows, "v", k) == sorted(values)[-k]


def test_raw_counts_are_those_of_every_text(spark, documents, texts):
    want = np.zeros(quality.BUCKETS)
    for t in texts.values():
        tokens = quality.TOKEN.findall(t)
        one = [xxhash and __import__("zlib").crc32(x.encode()) for x in tokens]
        for x in one:
            want[x % quality.BUCKETS] += 1
        for a, b in zip(one, one[1:], strict=False):
            mixed = 0 if a == b else (a * 0x9E3779B97F4A7C15 + b) % 2**64 >> 40
            want[mixed % quality.BUCKETS] += 1
    assert np.array_equal(quality.raw_counts(documents), want)


def test_quality_of_odd_rows(odd, empty, tables):
    rows = quality.classify(odd, tables[1].limit(0)).collect()
    assert len(rows) == len(ODD) and all(r.kept for r in rows)
    by = {r.doc_id: r for r in rows}
    assert (by[3].log_weight, by[3].n_grams, by[4].log_weight, by[5].n_grams) == (0.0, 0, 0.0, 0)
    assert quality.classify(empty, tables[1]).count() == 0
