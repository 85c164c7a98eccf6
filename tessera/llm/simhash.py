"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's bits are grouped into partitions, correlated bits together. Two
fingerprints within ``most`` bits agree, for any thresholds whose (t + 1) sum to
``most`` + 1, within t bits in some partition. Each fingerprint chooses its own
thresholds by dynamic programming on estimated candidate counts, probes the
partitions' values within them, and what it finds is verified on all bits.
"""

from __future__ import annotations

from bisect import bisect_right
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, release, slices, tidy
from tessera.llm.graph import components

#: A partition's value with more fingerprints than this is linked through their neighbours, not pair by pair.
CROWD = 48
#: Very common values of a partition whose exact count the estimate uses.
KNOWN_VALUES = 2_000
#: What a probe costs, in candidates.
PROBE = 1.5


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle, repeats included; of all words if they are fewer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words)
    if n <= width:
        return np.array([hashed(line, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: n - width + 1].tolist()
    return np.array([hashed(line[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = 3) -> int:
    return majority(shingle_hashes(text, width))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(documents: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(batches):
        for batch in batches:
            fps = [signed(fingerprint(t, width)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    """(n, 64) of 0 and 1; column b is the bit of value 1 << b."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits set, for each two bits (64 x 64)."""

    def run(batches):
        both = np.zeros((64, 64), np.int64)
        n = 0
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([*range(64), 64]), pa.array([*both.tolist(), [n] + [0] * 63], pa.list_(pa.int64()))], ["bit", "both"])

    sums = [F.sum(F.col("both")[i]).alias(f"b{i}") for i in range(64)]
    rows = {r[0]: r[1:] for r in distinct.select("fp").mapInArrow(run, "bit long, both array<long>").groupBy("bit").agg(*sums).collect()}
    if not rows:
        return 0, np.zeros((64, 64))
    return int(rows[64][0]), np.array([rows[b] for b in range(64)], float)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal size, each begun by the most skewed bit left and filled with those most correlated to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = 64 * (k + 1) // parts - 64 * k // parts
        group = [max(left, key=lambda b: (abs(p[b] - 0.5), -b))]
        left.discard(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def part_values(bits: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """(n, parts) long: the bits of each group as a number."""
    return np.stack([bits[:, g].astype(np.int64) @ (1 << np.arange(len(g), dtype=np.int64)) for g in groups], 1)


class Estimate:
    """Candidates of a partition's value within t bits, for t from 0 to ``most``.

    Bits are taken as independent, each with its own share of ones; values
    known to be very common count exactly, with those near them.
    """

    def __init__(self, n: int, share: np.ndarray, common: list[tuple[int, int]], most: int):
        self.n, self.share, self.most = max(0, n - sum(c for _, c in common)), share, most
        self.values = np.array([v for v, _ in common], np.int64)
        self.counts = np.array([c for _, c in common], np.int64)

    def __call__(self, bits: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(rows, most + 1)."""
        differ = np.where(bits == 1, 1 - self.share, self.share)
        exactly = np.zeros((len(bits), self.most + 1))
        exactly[:, 0] = 1
        for b in range(bits.shape[1]):
            q = differ[:, b : b + 1]
            exactly[:, 1:] = exactly[:, 1:] * (1 - q) + exactly[:, :-1] * q
            exactly[:, 0] *= 1 - q[:, 0]
        out = self.n * np.cumsum(exactly, 1)
        each, at = np.unique(values, return_inverse=True)
        if len(self.values):
            near = np.zeros((len(each), self.most + 1))
            for a in range(0, len(each), 1024):
                apart = np.bitwise_count(each[a : a + 1024, None] ^ self.values)
                for t in range(self.most + 1):
                    near[a : a + 1024, t] = ((apart <= t) * self.counts).sum(1)
            out += near[at]
        return out


def allocate(costs: list[np.ndarray], most: int) -> np.ndarray:
    """Thresholds (rows, parts) of least total cost whose (t + 1) sum to ``most`` + 1; -1 leaves a partition out.

    ``costs[i][:, t]`` is partition i's cost at threshold t; left out it costs nothing.
    """
    rows, budget = len(costs[0]), most + 1
    best = np.full((rows, budget + 1), np.inf)
    best[:, 0] = 0
    chosen = []
    for cost in costs:
        options = np.concatenate([np.zeros((rows, 1)), cost], 1)
        new, pick = np.full_like(best, np.inf), np.zeros((rows, budget + 1), np.int64)
        for total in range(budget + 1):
            for s in range(total + 1):
                value = best[:, total - s] + options[:, s]
                better = value < new[:, total]
                new[better, total], pick[better, total] = value[better], s
        best = new
        chosen.append(pick)
    out, left = np.zeros((rows, len(costs)), np.int64), np.full(rows, budget)
    for i in range(len(costs) - 1, -1, -1):
        s = chosen[i][np.arange(rows), left]
        out[:, i], left = s - 1, left - s
    return out


def flips(width: int, t: int) -> np.ndarray:
    """Masks of up to ``t`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(width), k)], np.int64)


def links(distinct: DataFrame, most: int = 2, parts: int = 3, crowd: int = CROWD) -> DataFrame:
    """(u, v) edges whose components are those of all fingerprints (column fp, each once) within ``most`` bits.

    Values shared by up to ``crowd`` fingerprints give every pair within
    ``most`` bits. More crowded values (``most`` of 2 only) are linked by a
    rule that is exact too: two fingerprints are within two bits just if some
    word is within one bit of both, so each sends itself to the 65 words within
    one bit, and those that meet there, 65 at most, are linked. That is linear
    in the crowd, and no link is lost.
    """
    if most > 2:
        raise ValueError("crowded values are linked exactly for up to two bits")
    n, both = bit_counts(distinct)
    groups = group_bits(n, both, parts)
    share = np.diag(both) / max(n, 1)

    def index_rows(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            values = part_values(bits_of(fps), groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(fps))), pa.array(values.ravel()), pa.array(np.repeat(fps, parts))], ["part", "val", "fp"])

    index = distinct.select("fp").mapInArrow(index_rows, "part int, val long, fp long")
    tally = cut(index.groupBy("part", "val").agg(F.count("*").alias("n")).where("n > 1"))
    common = tally.orderBy(F.desc("n"), "part", "val").limit(KNOWN_VALUES * parts).collect()
    estimates = [Estimate(n, share[g], [(r.val, r.n) for r in common if r.part == i and r.n > 4], most) for i, g in enumerate(groups)]
    masks = [[flips(len(g), t) for t in range(most + 1)] for g in groups]

    def probe_rows(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            bits = bits_of(fps)
            values = part_values(bits, groups)
            balls = [np.array([sum(comb(len(g), k) for k in range(t + 1)) for t in range(most + 1)]) for g in groups]
            costs = [e(bits[:, g], values[:, i]) + PROBE * balls[i] for i, (e, g) in enumerate(zip(estimates, groups, strict=True))]
            chosen = allocate(costs, most)
            for i in range(parts):
                for t in range(most + 1):
                    here = np.flatnonzero(chosen[:, i] == t)
                    for a in range(0, len(here), 1024):
                        some, mask = here[a : a + 1024], masks[i][t]
                        probes = (values[some, i, None] ^ mask).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(probes), i, np.int32)), pa.array(probes), pa.array(np.repeat(fps[some], len(mask)))], ["part", "val", "fp"])

    probes = distinct.select("fp").mapInArrow(probe_rows, "part int, val long, fp long")
    crowds = tally.where(F.col("n") > crowd).select("part", "val")
    found = index.withColumnRenamed("fp", "other")
    quiet = found.join(crowds, ["part", "val"], "left_anti")
    pairs = probes.join(quiet, ["part", "val"]).where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= most))
    out = pairs.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v")).distinct()
    crowded = probes.unionAll(index).join(crowds, ["part", "val"], "left_semi").select("fp").distinct()
    meet = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(64)])).alias("word"))
    stars = meet.groupBy("word").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    near = stars.select(F.explode("all").alias("u"), "v").where("u != v")
    if most < 2:
        near = near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)
    return out.unionAll(near.distinct())


def component_ids(rows: DataFrame, edges: DataFrame, key: str = "fp") -> DataFrame:
    """``rows`` (doc_id and ``key``) with component_id, the smallest doc_id reachable through equal keys and ``edges``.

    Components are formed of the keys' smallest doc_ids, so that a component's
    root is its id and nothing has to be gathered at it: no join has a key that
    grows with a component. Keys without any doc_id take numbers beyond all ids.
    """
    least = rows.groupBy(key).agg(F.min("doc_id").alias("first"))
    top = rows.agg(F.max(F.greatest("doc_id", F.lit(0)))).first()[0] or 0
    first = cut(least.select(key, F.coalesce("first", F.lit(top + 1) + F.monotonically_increasing_id()).alias("first")))
    ends = [first.select(F.col(key).alias(e), F.col("first").alias(f"{e}_first")) for e in ("u", "v")]
    named = edges.join(ends[0], "u").join(ends[1], "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    comps = components(named)
    ids = cut(first.join(comps, first["first"] == comps["node"], "left").select(key, F.coalesce("root", "first").alias("root")))
    ids = ids.select(key, F.when(F.col("root") <= top, F.col("root")).alias("component_id"))
    # Both sides come whole from a shuffle of their own, so that adaptive execution can cut the rows of a key with many copies.
    return rows.join(ids, key)


def near_duplicates(documents: DataFrame, width: int = 3, most: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Texts without words, null ones among them, have fingerprint zero and are
    linked like any others. Repeated rows stay repeated; a null doc_id is
    carried and never a component's id, unless nothing else is in it (then it
    is null). Other columns are not read; an empty table gives an empty table.
    """
    rows = cut(fingerprints(documents, width, text, doc_id))
    distinct = cut(rows.select("fp").distinct())
    out = component_ids(rows, links(distinct, most))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Partitions beyond those a pair may differ in, by share and number: the signatures with the fewest shingles are then left out.
SPARE, SPARE_LEAST = 0.3, 6
#: Longs of a set's parity bitmap.
PARITY = 16
#: Sets of a crowded signature that are compared at once.
BLOCK = 1024
#: Keys handed to every task (8 bytes each) up to this number; beyond it rows are joined to them.
KEYS_BROADCAST = 2_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Hashes of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        hashed = self[word] = xxhash.xxh64_intdigest(word)
        return hashed


def shingle_set(text: str | None, width: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of all words if they are fewer."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(one) - width + 1)
    mixed = np.zeros(n, np.uint64)
    for j in range(min(width, len(one))):
        mixed = (mixed ^ one[j : j + n]) * _M1
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mix(mixed))


def parity(s: np.ndarray, longs: int = PARITY) -> bytes:
    """Bitmap with a bit flipped by each hash: two sets' bitmaps differ in no more bits than the sets do in members."""
    at = (mix(s * _M1) >> np.uint64(40)).astype(np.int64) % (64 * longs)
    return np.packbits(np.bincount(at, minlength=64 * longs) & 1).tobytes()


def wide_parity(s: np.ndarray) -> bytes:
    """A bitmap of about as many bits as the set has members, so that large sets are told apart as well as small ones."""
    longs = PARITY
    while 64 * longs < min(len(s), 1 << 23):
        longs *= 2
    return parity(s, longs)


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the longer is folded to the length of the other, which has the same members flip each bit."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n), 0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


class Signatures:
    """Signatures of sets such that sets of Jaccard similarity ``similarity`` or more share one.

    Sizes are in classes so wide that such a pair lies in one or two next to each
    other; a set gives signatures for its class and the next. There, the pair
    differs in at most ``most`` members, so that of ``parts`` ranges of the hash
    all but ``most`` hold the same members in both. Ordered alike for all sets,
    here by members held and their hash, the first ``most`` + 1 of either set have
    one in common (prefix filter).
    """

    def __init__(self, similarity: float):
        t = Fraction(str(similarity))
        self.p, self.q = t.numerator, t.denominator
        self.bounds, self.parts = [1], {}

    def most(self, total):
        """Members in which a pair of ``total`` members together may differ."""
        return total * (self.q - self.p) // (self.q + self.p)

    def alike(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.q * both >= self.p * (len(a) + len(b) - both)

    def of(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return s
        while len(self.bounds) < 3 or self.bounds[-2] <= len(s):
            self.bounds.append(self.bounds[-1] * self.q // self.p + 1)
        own = bisect_right(self.bounds, len(s)) - 1
        cum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s * _M2), dtype=np.uint64)))
        out = []
        for c in (own, own + 1):
            if c not in self.parts:
                most = self.most(2 * (self.bounds[c + 1] - 1))
                parts = int(most * (1 + SPARE)) + SPARE_LEAST
                self.parts[c] = most, np.array([(k << 64) // parts for k in range(1, parts)], np.uint64), mix(np.arange(1, parts + 1, dtype=np.uint64) * _M1 + np.uint64(c))
            most, edges, salt = self.parts[c]
            if not most:  # equal sets only, which have one key
                continue
            at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
            held = np.diff(at)
            sig = mix((np.diff(cum[at]) ^ salt) * _M1)
            # Empty ranges come last: they are given only where fewer than most + 1 others are held.
            out.append(sig[np.lexsort((sig, -held))[: most + 1]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    return signed(xxhash.xxh64_intdigest(s.tobytes()))


def hashed_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, same, text); same is a hash of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("same"), text.alias("text"))


def shingle_sets(texts: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, same, key, n, fp, bits, wide) for each row of ``hashed_texts``; key is a hash of the set, fp its SimHash, the rest its bitmaps."""

    def run(batches):
        known = Words()
        for batch in slices(batches):
            sets = [shingle_set(t, width, known) for t in batch.column(2).to_pylist()]
            fps = pa.array([signed(majority(s)) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(set_key, sets), pa.int64()), pa.array(map(len, sets), pa.int32()), fps, pa.array(map(parity, sets), pa.binary()), pa.array(map(wide_parity, sets), pa.binary())],
                ["doc_id", "same", "key", "n", "fp", "bits", "wide"],
            )
        del known
        release()

    return texts.mapInArrow(run, "doc_id long, same long, key long, n int, fp long, bits binary, wide binary")


class Texts:
    """The texts of a table's sets, read again where they are wanted: neither they nor their sets are stored beside the table.

    ``sets`` has (key, same, doc_id) of one row for each set, ``again`` those of
    the sets that several rows have, ``copies`` the hashes (same) of all rows of
    these. The table must give the same rows each time it is read.
    """

    def __init__(self, texts: DataFrame, sets: DataFrame, again: DataFrame, copies: DataFrame, width: int):
        self.texts, self.sets, self.again, self.copies, self.width = texts, sets, again, copies, width

    def _first(self, rows: DataFrame) -> DataFrame:
        """(key, text), one for each of ``rows`` (key, same, doc_id)."""
        rows = cut(rows.select("key", F.col("same").alias("_same"), F.col("doc_id").alias("_doc")))
        rows = F.broadcast(rows) if rows.count() <= KEYS_BROADCAST else rows
        found = self.texts.join(rows, (F.col("same") == F.col("_same")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        return found.groupBy("key").agg(F.first("text").alias("text"))

    def of(self, keys: DataFrame) -> DataFrame:
        """(key, text) of ``keys`` (key, each once)."""
        return self._first(_having(self.sets.select("key", "same", "doc_id"), keys))

    def all(self) -> DataFrame:
        """(text), one for each set."""
        copies = F.broadcast(self.copies) if self.copies.count() <= KEYS_BROADCAST else self.copies
        alone = self.texts.join(copies, "same", "left_anti")
        return alone.select("text").unionAll(self._first(self.again).select("text"))


def buckets(texts: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """(sig, key, prev, size) of the signatures that several keys have; prev is the key before it in the bucket."""

    def spread(batches):
        signatures, known = Signatures(similarity), Words()
        for batch in slices(batches):
            sets = [shingle_set(t, width, known) for t in batch.column(0).to_pylist()]
            found = list(map(signatures.of, sets))
            keys = np.repeat(np.fromiter(map(set_key, sets), np.int64, len(sets)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(keys)], ["sig", "key"])
        del known
        release()

    def sweep(batches):
        last = np.zeros((2, 0), np.int64)  # rows of the bucket that the next batch may go on with
        for batch in _and_end(batches):
            rows = last if batch is None else np.concatenate([last, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])], 1)
            if batch is not None:
                end = np.searchsorted(rows[0], rows[0, -1]) if rows.shape[1] else 0
                rows, last = rows[:, :end], rows[:, end:]
            if not rows.shape[1]:
                continue
            again = np.concatenate(([False], (rows[:, 1:] == rows[:, :-1]).all(0)))
            sig, key = rows[:, ~again]
            begins = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            size = np.diff(np.append(begins, len(sig)))
            prev = np.concatenate(([0], key[:-1]))
            first = np.zeros(len(sig), bool)
            first[begins] = True
            size = np.repeat(size, size)
            some = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array(key[some]), pa.array(prev[some], mask=first[some]), pa.array(size[some])], ["sig", "key", "prev", "size"])
        release()

    rows = texts.select("text").mapInArrow(spread, "sig long, key long")
    return rows.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(sweep, "sig long, key long, prev long, size long")


def _and_end(batches):
    yield from batches
    yield None


def _having(rows: DataFrame, keys: DataFrame, most_broadcast: int = KEYS_BROADCAST) -> DataFrame:
    """``rows`` whose key (the first column) is among ``keys`` (key, each once)."""
    if keys.count() > most_broadcast:
        return rows.join(keys, "key", "left_semi")
    some = rows.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column("key").to_numpy()))

    def run(batches):
        wanted = some.value
        for batch in batches:
            if len(wanted):
                key = batch.column(0).to_numpy()
                yield batch.filter(pa.array(wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key))

    return rows.mapInArrow(run, rows.schema)


def not_told_apart(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose wide bitmaps don't rule the similarity out."""

    def run(batches):
        most = Signatures(similarity).most
        for batch in slices(batches):
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 4))
            apart = np.fromiter(map(bits_apart, batch.column(3).to_pylist(), batch.column(5).to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["u", "v"]).filter(pa.array(apart <= most(n + m)))

    keys = cut(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct())
    maps = _having(sets.select("key", "n", "wide"), keys)
    left, right = maps.toDF("u", "n", "a"), maps.toDF("v", "m", "b")
    return cut(pairs.join(left, "u").join(right, "v").select("u", "v", "n", "a", "m", "b").mapInArrow(run, "u long, v long"))


def verified(pairs: DataFrame, sets: DataFrame, texts: Texts, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets have Jaccard similarity ``similarity`` or more."""
    width = texts.width

    def run(batches):
        alike, known = Signatures(similarity).alike, Words()
        for batch in slices(batches, 64):
            a, b = ([shingle_set(t, width, known) for t in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array([alike(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))
        del known
        release()

    pairs = not_told_apart(pairs, sets, similarity)
    members = texts.of(cut(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()))
    left, right = members.toDF("u", "a"), members.toDF("v", "b")
    return cut(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def open_pairs(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float, best: bool, block: int = BLOCK) -> DataFrame:
    """(u, v) pairs that share a signature, lie in different components and aren't told apart by their bitmaps.

    Every pair of a bucket that is still in several components is compared, in
    blocks of about ``block`` by ``block`` of its sets; ``best`` keeps each set's
    closest pair of a block only.
    """
    rooted = members.select("sig", "key").join(roots, members["key"] == roots["node"], "left").select("sig", "key", F.coalesce("root", "key").alias("root"))
    rooted = cut(rooted)
    still = rooted.groupBy("sig").agg(F.count("*").alias("size"), F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("sig", "size")
    rows = cut(rooted.join(still, "sig"))
    keys = cut(rows.select("key").distinct())
    rows = rows.join(_having(sets.select("key", "n", "bits"), keys), "key")
    # Block i of a bucket meets every block j: in cell (least, greatest) both are present.
    sides = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), sides).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    rows = rows.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "n", "bits")

    def compare(batches):
        most = Signatures(similarity).most
        for table, cells in _cells(batches):
            i, j, own, key, root, n = (table.column(c).to_numpy() for c in ("i", "j", "own", "key", "root", "n"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, PARITY)
            for left, right in _pairs_of(cells, i, j, own):
                some = root[left] != root[right]
                left, right = left[some], right[some]
                apart = np.bitwise_count(bits[left] ^ bits[right]).sum(1, dtype=np.int64)
                some = apart <= most(n[left].astype(np.int64) + n[right])
                left, right, apart = left[some], right[some], apart[some]
                u, v = np.maximum(key[left], key[right]), np.minimum(key[left], key[right])
                if best and len(u):
                    order = np.lexsort((v, apart, u, cells[left]))
                    first = np.concatenate(([True], (u[order][1:] != u[order][:-1]) | (cells[left][order][1:] != cells[left][order][:-1])))
                    u, v = u[order[first]], v[order[first]]
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        release()

    cells = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return cells.mapInArrow(compare, "u long, v long").distinct()


#: Rows whose cells are compared together, and pairs at once.
CELL_ROWS, CELL_PAIRS = 4_096, 100_000


def _cells(batches):
    """(table, cell of each row) of consecutive rows, whole cells (equal sig, i and j) only."""
    held, count = [], 0

    def numbered(table):
        names = np.stack([table.column(c).to_numpy().astype(np.int64) for c in range(3)])
        return np.concatenate(([0], np.cumsum((names[:, 1:] != names[:, :-1]).any(0))))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= CELL_ROWS:
            table = pa.Table.from_batches(held)
            cells = numbered(table)
            end = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if end:
                yield table.slice(0, end), cells[:end]
                held, count = table.slice(end).to_batches(), table.num_rows - end
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _pairs_of(cells: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray):
    """(left, right) places of all pairs of rows of a cell, in runs: of one block where i and j are equal, else of one row of either."""
    ends = np.searchsorted(cells, cells, "right")
    partners = np.where(i == j, ends - np.arange(len(cells)) - 1, 0)
    begin = 0
    total = np.concatenate(([0], np.cumsum(partners)))
    while begin < len(cells):
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + CELL_PAIRS, "right")) - 1)
        size = partners[begin:stop]
        left = np.repeat(np.arange(begin, stop), size)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
        begin = stop
    for cell in np.unique(cells[i != j]):
        low, high = np.searchsorted(cells, [cell, cell + 1])
        a, b = (low + np.flatnonzero(own[low:high] == x[low]) for x in (i, j))
        for at in range(0, len(a), max(1, CELL_PAIRS // max(len(b), 1))):
            some = a[at : at + max(1, CELL_PAIRS // max(len(b), 1))]
            yield np.repeat(some, len(b)), np.tile(b, len(some))


def fingerprint_pairs(sets: DataFrame, most: int = 2) -> DataFrame:
    """(u, v) pairs of keys whose SimHashes are within ``most`` bits: of the sets of a fingerprint each with the least key, and of the ``links`` of a fingerprint that to the least one."""
    least = cut(sets.groupBy("fp").agg(F.min("key").alias("first")))
    same = sets.select("fp", "key").join(least, "fp").where("key != first").select(F.col("key").alias("u"), F.col("first").alias("v"))
    ends = [least.select(F.col("fp").alias(e), F.col("first").alias(f"{e}_first")) for e in ("u", "v")]
    near = links(least.select("fp"), most).groupBy("u").agg(F.min("v").alias("v")).join(ends[0], "u").join(ends[1], "v").select(F.col("u_first").alias("u"), F.col("v_first").alias("v"))
    return same.unionAll(near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def similar_links(sets: DataFrame, texts: Texts, similarity: float) -> DataFrame:
    """(u, v) edges, each verified, whose components are those of all pairs (key) of Jaccard similarity ``similarity`` or more.

    Sets whose SimHashes are near are held against each other first, found by
    the generalised pigeonhole over fingerprints, and each set against the
    neighbour with which it shares most signatures. That makes one component of
    most groups of copies. But a few bits of a fingerprint don't bound the
    similarity, so all pairs that share a signature, the pigeonhole over the
    sets themselves, and are still apart are compared, the closest before the
    rest, so that a crowd of copies isn't paired off in full.
    """
    members = cut(buckets(texts.all(), similarity, texts.width))
    tidy(sets.sparkSession)
    shared = members.where("prev is not null").groupBy("key", "prev").agg(F.count("*").alias("n"))
    near = cut(shared.groupBy("key").agg(F.max(F.struct("n", "prev")).alias("top")).select(F.col("key").alias("u"), F.col("top.prev").alias("v")))
    found = verified(cut(near.unionAll(fingerprint_pairs(sets)).distinct()), sets, texts, similarity)
    del shared, near
    tidy(sets.sparkSession)
    for best in (True, False):
        left = cut(open_pairs(members, cut(components(found)), sets, similarity, best))
        if left.isEmpty():
            break
        tidy(sets.sparkSession)
        found = found.unionAll(verified(left, sets, texts, similarity))
        tidy(sets.sparkSession)
    return found


def text_near_duplicates(documents: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row: groups of texts whose ``width``-word shingles are alike.

    Two texts are linked just if the Jaccard similarity of their sets of
    ``width``-word shingles is ``similarity`` or more: candidates come from
    signatures that such texts are bound to share, and each link is verified on
    the sets. Texts without words are alike. Nulls, repeated rows and empty
    tables are treated as in ``near_duplicates``. ``documents`` is read several
    times, so that no set has to be stored, and must give the same rows each time.
    """
    texts = hashed_texts(documents)
    rows = cut(shingle_sets(texts, width).withColumn("row", F.monotonically_increasing_id()))
    again = cut(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("row").alias("first")).where("copies > 1").select("key", "first"))
    several = F.broadcast(again) if again.count() <= KEYS_BROADCAST else again
    sets = rows.join(several, "key", "left").where("first is null or row = first").select("key", "same", "doc_id", "n", "fp", "bits", "wide")
    copied = cut(rows.join(several, "key").select("key", "same", "doc_id", (F.col("row") == F.col("first")).alias("leads")))
    source = Texts(texts, sets, copied.where("leads").drop("leads"), cut(copied.select("same").distinct()), width)
    return component_ids(rows.select("doc_id", "key"), similar_links(sets, source, similarity), "key").select("doc_id", "component_id")
