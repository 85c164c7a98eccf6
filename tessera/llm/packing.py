"""Best-fit packing of token sequences by best-two-fit.

Bins are planned on the number of pieces of each length: a bin is filled
greedily, then its smallest piece gives way to two unpacked pieces that fit the
expanded gap more tightly. Bins with the same lengths form one pattern with a
multiplicity, so the plan has a few rows for each length however many documents
there are. Pieces then take their places by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bpe import BYTE_LEVEL, CACHE_WORDS, PieceTable, byte_letters, parts, vocabulary
from tessera.llm.common import cut, release

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces of one length and salt meet in one task: about so many.
ROWS_A_SALT = 4_000


class PieceIds(dict):
    """Piece of text to its packed ids, found when first asked for; emptied when it has grown large."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in self.vocab.ids.items()}
        self.encode = tiktoken.Encoding("pieces", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if piece in self.vocab.special:
            ids = [self.vocab.special[piece]]
        else:
            ids = [i for word in self.vocab.split(piece) for i in self.encode(word.encode("utf-8"))]
        packed = self[piece] = array("I", ids).tobytes()
        return packed


@lru_cache(maxsize=4)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


def tightest_pair(counts: np.ndarray, above: int, most: int) -> tuple[int, int] | None:
    """Two available lengths with the largest sum over ``above`` up to ``most``; of equal sums the longer first."""
    lengths = np.flatnonzero(counts > 0)
    a = lengths[(lengths > 0) & (lengths < most)]
    if not len(a):
        return None
    before = np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))
    b = before[np.minimum(most - a, a)]
    single = (b == a) & (counts[a] < 2)
    b = np.where(single, before[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(np.max(total))
    if best <= above:
        return None
    longer = int(np.max(a[total == best]))
    return longer, best - longer


def plan_bins(counts: np.ndarray, cap: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins); ``counts[n]`` pieces have length n, 1 to ``cap``."""
    counts, plan = counts.astype(np.int64).copy(), []
    counts[0] = 0
    while counts.any():
        left, gap, lengths = counts.copy(), cap, []
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            size = int(fits[-1])
            n = min(gap // size, int(left[size]))
            lengths += [size] * n
            left[size] -= n
            gap -= n * size
        if gap and len(lengths) > 1:
            smallest = lengths[-1]
            if pair := tightest_pair(left, smallest, gap + smallest):
                lengths[-1:] = pair
        used = np.bincount(lengths, minlength=cap + 1)
        has = np.flatnonzero(used)
        times = int((counts[has] // used[has]).min())
        counts -= times * used
        plan.append((lengths, times))
    return plan


def places(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of places, its first sequence, and the offset there."""
    taken: dict[int, int] = {}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            runs.setdefault(n, []).append((rank, sequence, offset))
            taken[n] = rank + times
            offset += n
        sequence += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}


def token_pieces(documents: DataFrame, path: str, cap: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut from the end into ``cap`` ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        known = piece_ids(path)
        for batch in batches:
            for part, texts in parts(batch.column(1)):
                ids = batch.column(0).slice(part.start, part.stop - part.start).to_pylist()
                table, rows = PieceTable(texts, known.vocab), []
                data, ends = table.gathered(list(map(known.__getitem__, table.unique)))
                for doc, lo, hi in zip(ids, ends, ends[1:], strict=False):
                    packed = data[lo:hi] + end
                    n = len(packed) // 4
                    bounds = [0, *range(n % cap or cap, n + 1, cap)]
                    rows += [(doc, k, a, b - a, zlib.crc32(packed[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        release()

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(pieces: DataFrame, cap: int = 1024) -> DataFrame:
    """``pieces`` (as of ``token_pieces``) with sequence_id and offset.

    To the driver goes one count for each length, at most ``cap``. Ranks within
    a length are counted by salt, so that a very common length is no single task.
    """
    pieces = cut(pieces)
    total = pieces.count()
    salts = max(8, -(-total // ROWS_A_SALT))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    tally = pieces.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    tally = tally.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"), "_n")
    counts = np.zeros(cap + 1, np.int64)
    for n, c in tally.groupBy("length").agg(F.sum("_n")).collect():
        counts[n] = c
    at = pieces.sparkSession.sparkContext.broadcast(places(plan_bins(counts, cap)))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(tally.drop("_n"), ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                here = length == n
                first, seq, off = at.value[int(n)]
                run_of = np.searchsorted(first, rank[here], "right") - 1
                sequence[here] = seq[run_of] + rank[here] - first[run_of]
                offset[here] = off[run_of]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long").alias("_rank"))
    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str, cap: int = 1024, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id alone. Repeated rows
    and null doc_ids are packed like any others; other columns are not read; an
    empty table gives an empty table. Long texts are cut whole: the first piece
    takes what is over, the rest have ``cap`` ids.
    """
    return pack(token_pieces(documents, path, cap, end_id, text, doc_id), cap)
