"""Token counts by rank-synchronous array merging.

Pre-tokens are held as ragged numpy arrays (symbols and row bounds). Each step
applies, in all sequences at once, the lowest-rank pair of each; what counts in
the end is the number of surviving symbols.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import CACHE_WORDS, NO_RANK, PieceTable, Vocabulary, every_other, parts, vocabulary


class Ragged:
    """Sequences of symbols: ``values`` of all, row r at ``bounds[r]:bounds[r + 1]``."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray):
        self.values = values
        self.bounds = np.concatenate(([0], np.cumsum(sizes)))

    def pairs(self, vocab: Vocabulary) -> np.ndarray:
        """Where the pair table holds the pair that starts at each place (``no_pair`` at a row's last)."""
        out = np.full(len(self.values), vocab.no_pair, np.int32)
        inside = np.ones(len(self.values), bool)
        inside[self.bounds[1:] - 1] = False
        at = np.flatnonzero(inside)
        out[at] = vocab.pair_at(self.values[at], self.values[at + 1])
        return out


def surviving(values: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Number of symbols that each (nonempty) sequence ends with."""
    counts, row = np.array(sizes, np.int64), np.arange(len(sizes))
    ragged = Ragged(values, sizes)
    pairs = ragged.pairs(vocab)
    while len(row):
        sizes = np.diff(ragged.bounds)
        rank = vocab.pair_rank[pairs]
        lowest = np.minimum.reduceat(rank, ragged.bounds[:-1])
        live = lowest < NO_RANK
        counts[row[~live]] = sizes[~live]
        chosen = every_other((rank == np.repeat(lowest, sizes)) & (rank < NO_RANK))
        gone = np.concatenate(([False], chosen[:-1]))
        left = (sizes - np.add.reduceat(gone, ragged.bounds[:-1], dtype=np.int64))[live]
        stays = np.repeat(live, sizes) & ~gone
        merged = chosen[stays]
        ragged = Ragged(np.where(chosen, vocab.pair_whole[pairs], ragged.values)[stays], left)
        pairs, row = pairs[stays], row[live]
        # Only the pairs that hold a merged symbol have changed.
        merged[:-1] |= merged[1:]
        pairs[merged] = vocab.no_pair
        merged[ragged.bounds[1:] - 1] = False
        at = np.flatnonzero(merged)
        pairs[at] = vocab.pair_at(ragged.values[at], ragged.values[at + 1])
    return counts


class Counter:
    """Pieces of text to numbers of tokens, with the pieces seen lately remembered."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.known: dict[bytes, int] = dict.fromkeys(self.vocab.special, 1)

    def learn(self, pieces: list[bytes]) -> None:
        new = [x for x in set(pieces) if x not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = dict.fromkeys(self.vocab.special, 1)
            new = [x for x in set(pieces) if x not in self.known]
        if new:
            words = list(map(self.vocab.split, new))
            each = set().union(*words)
            counts = {w: known for w in each if (known := self.known.get(w.encode("utf-8"))) is not None}
            each = list(each.difference(counts))
            if each:
                counts.update(zip(each, surviving(*self.vocab.symbols(each), self.vocab).tolist(), strict=True))
            self.known.update(zip(new, (counts[w[0]] if len(w) == 1 else sum(map(counts.__getitem__, w)) for w in words), strict=True))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of a column."""
        out = [np.zeros(0, np.int64)]
        for _, part in parts(texts):
            table = PieceTable(part, self.vocab)
            self.learn(table.unique)
            out.append(table.sums(np.fromiter(map(self.known.__getitem__, table.unique), np.int64, len(table.unique))))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(documents: DataFrame, path: str, limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows stay repeated,
    a null doc_id is carried, other columns are not read, an empty table gives
    an empty table. A text of any length is counted whole.
    """

    def run(batches):
        counts = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts.count(batch.column(1)))], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
