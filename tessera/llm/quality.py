"""Quality by importance resampling.

Two generative models over hashed word n-grams are estimated: one of target
texts (a sample of rows labelled good) and one of the raw collection (counts
over every document). Documents differ in length, so each is weighed as a chunk
of ``CHUNK`` of its n-grams is: the log importance weight is ``CHUNK`` times its
mean log likelihood ratio under the two models. Documents are drawn without
replacement in proportion to their weights by Gumbel top-k: standard Gumbel
noise is added to the log weights and the k largest sums stay. k is a share of
all rows; no cut of the weights is fitted to labels.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, cut, held_out, release

BUCKETS = 1 << 16
#: Labelled rows that the target model counts, at most.
MOST_ROWS = 6_000
#: Counts added to every bucket of either model.
SMOOTHING = 1.0
#: n-grams that a document is weighed by, and those without any ratio that are added to shrink the weights of short texts.
CHUNK, SHRINK = 50, 5.0
#: Divides the log weights before the noise is added: 1 draws in proportion to the weights.
TEMPERATURE = 1.0
MOST_WORDS = 150_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Features(dict):
    """Hashed unigrams and bigrams of words and punctuation runs; BUCKETS is a power of two.

    As a dict: what stands between white space, in UTF-8, to its tokens' hashes, packed.
    """

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > MOST_WORDS:
            self.clear()
        packed = self[piece] = array("I", [zlib.crc32(t.encode("utf-8")) for t in TOKEN.findall(piece.decode("utf-8"))]).tobytes()
        return packed

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all texts' n-grams in one array, and the number of each text."""
        packed = [b"".join(map(self.__getitem__, t.encode("utf-8").split())) for t in texts]
        one = np.frombuffer(b"".join(packed), np.uint32).astype(np.uint64)
        text = np.repeat(np.arange(len(texts)), [len(p) // 4 for p in packed])
        # A word said twice is one bigram, whatever the word.
        two = np.where(one[:-1] == one[1:], 0, (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) >> np.uint64(40))
        inner = text[:-1] == text[1:]
        buckets = (np.concatenate([one, two[inner]]) & np.uint64(BUCKETS - 1)).astype(np.int64)
        return buckets, np.concatenate([text, text[:-1][inner]])


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """For each bucket the log of its probability in the target model over that in the raw one."""
    target, raw = target + SMOOTHING, raw + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def raw_counts(documents: DataFrame) -> np.ndarray:
    """n-grams of each bucket over all documents; a row for each bucket and task is shuffled, one for each bucket collected."""

    def run(batches):
        features, counts = Features(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for part in chunks([len(t) for t in texts]):
                counts += np.bincount(features.of(texts[part])[0], minlength=BUCKETS)
        del features
        release()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["bucket", "n"])

    found = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def weights_of(texts: list[str], ratio: np.ndarray, features: Features) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the log ratios of each text's n-grams, and their number."""
    buckets, text = features.of(texts)
    return np.bincount(text, ratio[buckets], len(texts)).astype(float), np.bincount(text, minlength=len(texts))


def log_weight(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log importance weight of a chunk of texts whose ``n`` n-grams sum up to ``total``."""
    return CHUNK * total / (n + SHRINK)


def train(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> np.ndarray:
    """The models' log ratio; zeros, so that all weigh the same, without rows labelled good.

    The target model counts at most ``most_rows`` rows labelled good outside the
    held-out third, the first by a hash of doc_id; texts stay in the tasks.
    """
    known = labels.where("quality = 1").where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    target = raw_counts(rows)
    return log_ratio(target, raw_counts(documents)) if target.any() else np.zeros(BUCKETS)


def good_share(labels: DataFrame) -> float:
    """Share of good rows among those labelled outside the held-out third, and two standard errors, so that k errs towards keeping; 1 without any."""
    known = labels.where("quality in (0, 1)").where(~held_out(F.col("doc_id")))
    n, good = known.agg(F.count("*"), F.sum("quality")).first()
    return min(1.0, good / n + 2 * math.sqrt(good * (n - good) / n) / n) if n else 1.0


def weigh(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, ratio, n_grams, log_weight) for each row, over its whole text; ratio is the sum over its n-grams."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        features = Features()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks([len(t) for t in texts]):
                total, n = weights_of(texts[part], shared.value, features)
                ids = batch.column(0).slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(total), pa.array(n.astype(np.int64)), pa.array(log_weight(total, n))], ["doc_id", "ratio", "n_grams", "log_weight"])
        del features
        release()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ratio double, n_grams long, log_weight double")


def gumbel(seed: int, *columns: str):
    """Standard Gumbel noise from a hash of the row: the same at every computation."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, found by counting rows in 1,024 bins of a shrinking range."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        step = (high - low) / 1024
        if step <= 0 or low + step == low:
            break
        bin_of = F.least(F.floor((F.col(column) - low) / step), F.lit(1023))
        inside = rows.where(F.col(column).between(low, high)).withColumn("_bin", bin_of)
        found = {int(r[0]): r[1:] for r in inside.groupBy("_bin").agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(found, reverse=True):
            n, least, most = found[b]
            if above + n >= k:
                low, high = least, most
                break
            above += n
    return low


def resample(weighted: DataFrame, k: int, temperature: float = TEMPERATURE, seed: int = 11) -> DataFrame:
    """``weighted`` (as of ``weigh``) with ``gumbel_key`` and ``kept``: the k largest keys.

    The key is log_weight / temperature plus standard Gumbel noise. Rows with
    equal keys, as repeated rows have, stay or go together, so a few more than
    k may stay.
    """
    keyed = cut(weighted.withColumn("gumbel_key", F.col("log_weight") / temperature + gumbel(seed, "doc_id", "n_grams", "ratio")))
    if k <= 0 or keyed.isEmpty():
        return keyed.withColumn("kept", F.lit(False))
    return keyed.withColumn("kept", F.col("gumbel_key") >= kth_largest(keyed, "gumbel_key", k))


def classify(documents: DataFrame, labels: DataFrame, share: float | None = None, most_rows: int = MOST_ROWS, seed: int = 11) -> DataFrame:
    """(doc_id, held_out, ratio, n_grams, log_weight, gumbel_key, kept) for each row.

    ``share`` of the rows are drawn, by default the share of good rows among the
    labelled ones. A null or empty text has no n-grams and log weight 0.
    Repeated rows stay repeated and share their fate, a null doc_id is carried,
    other columns are not read, an empty table gives an empty table. Without
    labelled rows all are kept.
    """
    weighted = weigh(documents, train(documents, labels, most_rows))
    k = math.ceil((good_share(labels) if share is None else share) * documents.count())
    out = resample(weighted, k, seed=seed).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "ratio", "n_grams", "log_weight", "gumbel_key", "kept")
