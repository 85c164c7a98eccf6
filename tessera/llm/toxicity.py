"""Toxicity by a convolutional text classifier in numpy.

A word's embedding is the sum of the hashed embeddings of itself and its
beginnings. Filters of several widths run over the words, each filter's largest
answer in a text (max pooling) goes to a logistic output. It is trained on whole
texts. A threshold for each language is calibrated on labelled rows set apart
from training; the score itself knows no language.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, held_out, release

BUCKETS = 1 << 15
WIDTHS = (1, 2, 3)
FILTERS = 4
DIMENSION = 12
#: Labelled rows that the classifier is fitted on, at most, of either class.
MOST_ROWS = 2_500
#: One in so many of them is set apart to calibrate the thresholds.
CALIBRATED = 5
#: Words whose answers a worker remembers.
MOST_WORDS = 125_000
WORD = re.compile(r"\w+")


def word_features(word: str) -> list[int]:
    """Buckets of a word: itself and its first 4, 5 and 6 letters."""
    raw = [f"={word}", *(f"{n}<{word[:n]}" for n in (4, 5, 6) if len(word) > n)]
    return [1 + zlib.crc32(x.encode("utf-8")) % (BUCKETS - 1) for x in raw]


def unique_words(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """Each distinct word, and each text as numbers of them (from 1; 0 is the padding)."""
    seen: defaultdict[str, int] = defaultdict(lambda: len(seen) + 1)
    out = [np.array(list(map(seen.__getitem__, WORD.findall(t.lower()))), np.int32) for t in texts]
    return list(seen), out


def feature_rows(words: list[str]) -> np.ndarray:
    """(words + 1, 4) buckets, 0 where a word has fewer; row 0 is the padding."""
    out = np.zeros((len(words) + 1, 4), np.int64)
    for i, w in enumerate(words):
        f = word_features(w)
        out[i + 1, : len(f)] = f
    return out


@dataclass
class Model:
    embedding: np.ndarray  # (BUCKETS, DIMENSION); bucket 0 is zero
    filters: list[np.ndarray]  # for each width (width, DIMENSION, FILTERS)
    offsets: list[np.ndarray]
    output: np.ndarray  # (widths * FILTERS,)
    bias: float
    thresholds: dict[str, float]

    def tables(self, features: np.ndarray) -> list[list[np.ndarray]]:
        """For each width and place in the filter, every word's answer: convolutions become sums of rows."""
        vectors = self.embedding[features].sum(1)
        return [[vectors @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, tables: list[list[np.ndarray]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter over the words (padded at both ends), and where it is."""
        padded = np.concatenate([[0, 0], words, [0, 0, 0]])
        top, where = [], []
        for table, offset in zip(tables, self.offsets, strict=True):
            n = len(padded) - len(table) + 1
            answer = table[0][padded[:n]]
            for j in range(1, len(table)):
                answer = answer + table[j][padded[j : j + n]]
            at = answer.argmax(0)
            top.append(answer[at, np.arange(answer.shape[1])] + offset)
            where.append(at)
        return np.concatenate(top), np.concatenate(where)

    def score(self, texts: list[str]) -> np.ndarray:
        return Scorer(self).score(texts)


class Scorer(dict):
    """A model with the answers to the words seen lately.

    As a dict: what stands between white space, in UTF-8, to the packed rows of
    its words in ``table``, which has an answer of each filter's each place.
    """

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.words: dict[str, int] = {}
        self.new: list[str] = []
        self.table = self._answers([])  # row 0 is the padding's

    def _answers(self, words: list[str]) -> np.ndarray:
        return np.concatenate([t for width in self.model.tables(feature_rows(words)) for t in width], 1).astype(np.float32)

    def _row(self, word: str) -> int:
        if word not in self.words:
            self.words[word] = len(self.words) + 1
            self.new.append(word)
        return self.words[word]

    def __missing__(self, piece: bytes) -> bytes:
        packed = self[piece] = array("i", map(self._row, WORD.findall(piece.decode("utf-8")))).tobytes()
        return packed

    def score(self, texts: list[str]) -> np.ndarray:
        """All texts in one array with padding between them: a row of answers for each word, then one maximum a text."""
        if len(self) > MOST_WORDS:
            self._reset()
        packed = [b"".join(map(self.__getitem__, t.lower().encode("utf-8").split())) for t in texts]
        if self.new:
            self.table = np.concatenate([self.table, self._answers(self.new)[1:]])
            self.new = []
        pad, model = bytes(8), self.model
        line = np.frombuffer(b"".join(x for p in packed for x in (pad, p, pad)) + pad, np.int32)
        starts = np.cumsum([0, *(len(p) // 4 + 4 for p in packed)])[:-1]
        # What a text's last windows reach is the padding of the next.
        answers, pooled, n, at = self.table[line], [], len(line) - 2, 0
        for width, offset in zip(map(len, model.filters), model.offsets, strict=True):
            answer = answers[:n, at : at + FILTERS]
            for j in range(1, width):
                at += FILTERS
                answer = answer + answers[j : j + n, at : at + FILTERS]
            at += FILTERS
            pooled.append(np.maximum.reduceat(answer, starts) + offset)
        pooled = np.maximum(np.concatenate(pooled, 1), 0)
        return 1 / (1 + np.exp(-np.clip(pooled @ model.output + model.bias, -30, 30)))


def starting_embedding(features: np.ndarray, texts_words: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Small random vectors whose first component is the bucket's log odds between the classes."""
    seen = np.zeros((2, BUCKETS))
    for words, y in zip(texts_words, labels, strict=True):
        seen[int(y), np.unique(features[words])] += 1
    n = np.maximum(np.bincount(labels.astype(int), minlength=2), 1)
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    # Rare buckets say little: their odds shrink towards none.
    total = seen.sum(0)
    out = rng.normal(0, 0.05, (BUCKETS, DIMENSION))
    out[:, 0] = np.clip(odds * total / (total + 3), -4, 4) / 2
    out[0] = 0
    return out


def loss_gradients(model: Model, features: np.ndarray, used: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
    """Mean weighted log loss of a batch, its gradients (embedding, filters, offsets, output, bias) and the buckets that the first one touches.

    The gradient reaches the windows that won the pooling.
    """
    each, at = np.unique(np.concatenate([[0], *used]), return_inverse=True)
    local, vectors = features[each], model.embedding[features[each]].sum(1)
    tables = [[vectors @ f[j] for j in range(len(f))] for f in model.filters]
    ends = np.cumsum([1, *map(len, used)])
    widths = len(model.filters)
    grads = [np.zeros(x.shape) for x in (model.embedding, *model.filters, *model.offsets, model.output)] + [np.zeros(1)]
    d_vectors, loss = np.zeros_like(vectors), 0.0
    for y, v, lo, hi in zip(labels, weight, ends[:-1], ends[1:], strict=True):
        padded = np.concatenate([[0, 0], at[lo:hi], [0, 0, 0]])
        top, where = model.pooled(tables, at[lo:hi])
        active = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ model.output + model.bias, -30, 30)))
        loss -= v * np.log(max(p if y else 1 - p, 1e-300)) / len(used)
        d = v * (p - y) / len(used)
        grads[-2] += d * active
        grads[-1] += d
        d_top = d * model.output * (top > 0)
        for k, f in enumerate(model.filters):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            grads[1 + widths + k] += d_top[own]
            for j in range(len(f)):
                here = padded[where[own] + j]
                grads[1 + k][j] += (vectors[here] * d_top[own, None]).T
                np.add.at(d_vectors, here, d_top[own, None] * f[j].T)
    touched = np.flatnonzero(np.abs(d_vectors).sum(1))
    for c in range(local.shape[1]):
        np.add.at(grads[0], local[touched, c], d_vectors[touched])
    grads[0][0] = 0
    return float(loss), grads, np.unique(local[touched])


def fit(texts: list[str], labels: np.ndarray, epochs: int = 4, seed: int = 7) -> Model:
    """Trained with Adam on whole texts in batches."""
    rng = np.random.default_rng(seed)
    words, texts_words = unique_words(texts)
    features = feature_rows(words)
    labels = np.asarray(labels, float)
    embedding = starting_embedding(features, texts_words, labels, rng)
    filters = [rng.normal(0, 0.15, (k, DIMENSION, FILTERS)) for k in WIDTHS]
    for f in filters:  # half the filters begin by looking at the odds of one word
        f[:, 0, : FILTERS // 2] = 0
        f[0, 0, : FILTERS // 2] = 1
    model = Model(embedding, filters, [np.full(FILTERS, -0.5) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.1), -1.0, {})
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    size = [embedding.shape, *(f.shape for f in filters), *(o.shape for o in model.offsets), model.output.shape, (1,)]
    mean, square, step = [np.zeros(s) for s in size], [np.zeros(s) for s in size], 0
    for _ in range(epochs if len(texts) else 0):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 32):
            batch = order[a : a + 32]
            _, grads, rows = loss_gradients(model, features, [texts_words[i] for i in batch], labels[batch], weight[batch])
            step += 1
            params = [model.embedding, *model.filters, *model.offsets, model.output]
            for k, (param, grad) in enumerate(zip(params, grads[:-1], strict=True)):
                here = rows if k == 0 else slice(None)
                mean[k][here] = 0.9 * mean[k][here] + 0.1 * grad[here]
                square[k][here] = 0.99 * square[k][here] + 0.01 * grad[here] ** 2
                param[here] -= 0.02 * (mean[k][here] / (1 - 0.9**step)) / (np.sqrt(square[k][here] / (1 - 0.99**step)) + 1e-6)
            mean[-1] = 0.9 * mean[-1] + 0.1 * grads[-1]
            square[-1] = 0.99 * square[-1] + 0.01 * grads[-1] ** 2
            model.bias -= float((0.02 * (mean[-1] / (1 - 0.9**step)) / (np.sqrt(square[-1] / (1 - 0.99**step)) + 1e-6))[0])
    return model


def calibrated(model: Model, texts: list[str], labels: np.ndarray, langs: list[str | None], default: float = 0.7) -> dict[str, float]:
    """For each language the threshold with fewest errors on the labelled texts; of equal ones the nearest to ``default``."""
    scores = np.concatenate([model.score(texts[p]) for p in chunks([len(t) for t in texts])]) if texts else np.zeros(0)
    out = {}
    for lang in sorted({x for x in langs if x is not None}):
        here = np.array([x == lang for x in langs])
        s, y = scores[here], np.asarray(labels)[here]
        if y.min() == y.max():
            continue
        tries = np.unique(np.concatenate([np.arange(0.3, 0.95, 0.05), [default]]))
        errors = [((s >= t) != (y == 1)).sum() for t in tries]
        out[lang] = float(min(zip(errors, np.abs(tries - default), tries, strict=True))[2])
    return out


def train(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model fitted on at most ``most_rows`` labelled rows of either class, the first by a hash of doc_id.

    Of these one in ``CALIBRATED`` is not fitted on but calibrates the
    thresholds. Only rows outside the held-out third are learned from. Rows
    whose label or text is null are left out; of the texts of a repeated doc_id
    the least is taken. Without rows of both classes the model gives every text
    the same low score. A table without lang has no thresholds.
    """
    known = labels.where("toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(most_rows).unionAll(known.where("toxic = 0").orderBy(order, "doc_id").limit(most_rows))
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.where("text is not null").select("doc_id", F.struct(F.col("text").cast("string").alias("text"), lang.alias("lang")).alias("t"))
    # At most 2 * most_rows ids: small enough for every task.
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(CALIBRATED)) == 0
    rows = found.select("doc_id", "toxic", "t.text", "t.lang", apart.alias("apart")).orderBy("doc_id").toArrow()
    texts, langs = rows.column("text").to_pylist(), rows.column("lang").to_pylist()
    y, apart = rows.column("toxic").to_numpy().astype(int), rows.column("apart").to_numpy().astype(bool)
    fitted, rest = np.flatnonzero(~apart), np.flatnonzero(apart)
    if len(fitted) == 0 or y[fitted].min() == y[fitted].max():
        return Model(np.zeros((BUCKETS, DIMENSION)), [np.zeros((k, DIMENSION, FILTERS)) for k in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), -3.0, {})
    model = fit([texts[i] for i in fitted], y[fitted])
    model.thresholds = calibrated(model, [texts[i] for i in rest], y[rest], [langs[i] for i in rest])
    return model


def scores(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) for each row, over its whole text.

    A null or empty text, or one without words, has the score of the padding.
    Repeated rows stay repeated, a null doc_id is carried, other columns are
    not read, an empty table gives an empty table.
    """
    small = Model(model.embedding.astype(np.float32), [f.astype(np.float32) for f in model.filters], [o.astype(np.float32) for o in model.offsets], model.output, model.bias, {})
    shared = documents.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in chunks([len(t) for t in texts]):
                found = scorer.score(texts[part])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(found.astype(np.float64))], ["doc_id", "score"])
        del scorer
        release()

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
