"""Exact top-k search by MaxScore over integer vectors.

Each dimension is a query term. In a shard (a block of rows) a term's score
lies between two bounds; the terms with the largest spread are essential: a row
whose score comes from the others alone cannot reach a query's top k any more.
Essential postings are traversed for all rows, the other terms are probed only
for rows that stay competitive, and the shards' best are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import cut

#: Query vectors broadcast at once (64 MB at 64 dimensions); more of them go in further passes.
QUERIES_A_PASS = 100_000
SHARD_ROWS = 8_192
PROBED_AT_ONCE = 8
#: Sums of products are exact in doubles up to here.
EXACT = 2.0**53
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>) with floor(scale * x) for each component.

    Vectors that are null or empty, or hold a component that is null or not
    finite (or not when scaled), and rows without an id take no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    # Doubles from 2^52 on are whole numbers already, and might not fit the long that floor gives.
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    return rows.where("vec_id is not null and size(v) > 0").where(good).withColumn("v", F.transform("v", lambda x: whole(x * scale)))


class Best:
    """The k highest scores of a query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -math.inf

    def offer_exact(self, found: list[tuple[int, int]]) -> None:
        """(score, id) pairs, the scores whole numbers of any size; from now on all are."""
        both = [*found, *zip(map(int, self.scores.tolist()), self.ids.tolist(), strict=True)]
        both = sorted(both, key=lambda x: (-x[0], x[1]))[: self.k]
        self.ids = np.array([i for _, i in both], np.int64)
        self.scores = np.array([s for s, _ in both], object)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if self.scores.dtype == object:
            return self.offer_exact(list(zip(map(int, scores.tolist()), ids.tolist(), strict=True)))
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class Shard:
    """A block of vectors as postings: one column of scores for each term, with its bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.postings = ids, np.ascontiguousarray(vectors.T)
        self.low, self.high = vectors.min(0), vectors.max(0)

    def wide(self, query_id: int, query: np.ndarray, best: Best) -> None:
        """The same for components so large that doubles don't hold the sums: whole numbers of any size, scores kept to those of a long."""
        terms = [int(x) for x in query.tolist()]
        for a in range(0, len(self.ids), 256):
            rows = self.postings[:, a : a + 256].T.tolist()
            scores = [max(-_LONG - 1, min(_LONG, sum(t * int(x) for t, x in zip(terms, row, strict=True)))) for row in rows]
            best.offer_exact([(s, i) for s, i in zip(scores, self.ids[a : a + 256].tolist(), strict=True) if i != query_id])

    def search(self, query_id: int, query: np.ndarray, best: Best) -> None:
        if np.abs(query) @ np.maximum(np.abs(self.low), np.abs(self.high)) >= EXACT:
            return self.wide(query_id, query, best)
        ends = np.stack([query * self.low, query * self.high])
        floor, spread = ends.min(0), np.ptp(ends, axis=0)
        order = np.argsort(-spread, kind="stable")
        # rest[i]: what the terms from the i-th on can add at most.
        rest = np.append(np.cumsum((floor + spread)[order][::-1])[::-1], 0.0)
        if rest[0] < best.least:
            return
        # Essential: the fewest terms without which no row can be competitive,
        # by what the others add over the floor that every row has.
        above = np.append(np.cumsum(spread[order][::-1])[::-1], 0.0)
        split = max(1, int(np.argmax(above <= max(best.least - floor.sum(), 0.0)))) if best.least > -math.inf else len(order)
        split = min(split, len(order))
        essential = order[:split]
        scores = query[essential] @ self.postings[essential]
        live = np.flatnonzero((scores + rest[split] >= best.least) & (self.ids != query_id))
        scores = scores[live]
        for a in range(split, len(order), PROBED_AT_ONCE):
            if not len(live):
                return
            terms = order[a : a + PROBED_AT_ONCE]
            scores = scores + query[terms] @ self.postings[np.ix_(terms, live)]
            stay = scores + rest[a + len(terms)] >= best.least
            live, scores = live[stay], scores[stay]
        if len(live):
            best.offer(self.ids[live], scores)


def _pass(base: DataFrame, shared, k: int) -> DataFrame:
    def run(batches):
        query_ids, query_vectors = shared.value
        best = [Best(k) for _ in query_ids]
        width = query_vectors.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                lists = part.column(1)
                flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
                if (sizes == width).all():
                    vectors = flat.reshape(-1, width)
                else:  # terms that a vector lacks add nothing
                    vectors = np.zeros((len(sizes), width))
                    row, col = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    vectors[row[col < width], col[col < width]] = flat[col < width]
                shard = Shard(part.column(0).to_numpy(), vectors)
                for q, v, b in zip(query_ids.tolist(), query_vectors, best, strict=True):
                    shard.search(q, v, b)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]).astype(np.int64))], ["query_id", "vec_id", "score"])

    return base.mapInArrow(run, "query_id long, vec_id long, score long")


def search(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` highest inner products with rows of ``base``.

    Both have (vec_id, v) as of ``quantised``. A row with the query's own id is
    no candidate; equal scores go to the smaller vec_id. Scores beyond a long are
    its largest or smallest value. Queries are broadcast in passes of a fixed
    size, each over all rows; a pass is computed and written before the next
    one's queries are read and its broadcast is dropped, so that neither the
    driver's nor a task's memory grows with their number. A repeated id is one
    query and as many candidates as it has rows; no queries or no rows give no
    result.
    """
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    passes = max(1, -(-queries.count() // QUERIES_A_PASS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for i in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).toArrow()
        vectors = rows.column("v").to_pylist()
        width = max(map(len, vectors), default=1)
        matrix = np.array([v + [0.0] * (width - len(v)) for v in vectors]).reshape(len(vectors), width)
        shared = base.sparkSession.sparkContext.broadcast((rows.column("vec_id").to_numpy(), matrix))
        ranked = _pass(base, shared, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        one = ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        if passes > 1:
            one = cut(one)
            shared.destroy()
        out = one if out is None else out.unionAll(one)
    return out
