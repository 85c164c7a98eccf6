"""Canonical exact digests of documents.

Texts are folded (Unicode normalisation, case, white space) and hashed with
128-bit xxhash. Rows with equal digests form a bucket, and inside it the folded
bytes themselves are compared: should two texts share a digest, the greater
ones get their number in the bucket appended.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, slices


def canonical(text: str | None) -> bytes:
    """NFKC, case folded, white space runs to one space, none at the ends."""
    if not text:
        return b""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8")


def digest(folded: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(folded)


def key(folded: bytes) -> int:
    """What Spark's xxhash64 gives for these bytes."""
    return xxhash.xxh64_intdigest(folded, 42) - (1 << 64) * (xxhash.xxh64_intdigest(folded, 42) >> 63)


def _bucket_numbers(buckets: DataFrame) -> DataFrame:
    """(fingerprint, folded, number) of the digests that stand for more than one folded text.

    ``buckets`` has (fingerprint, folded) for rows of digests that occur again.
    Equal texts meet in the map-side part of the aggregation, so a group of
    copies of any size is one row for each task.
    """
    ends = buckets.groupBy("fingerprint").agg(F.min("folded").alias("least"), F.max("folded").alias("most"))
    clash = ends.where("least != most").select("fingerprint")
    texts = buckets.join(clash, "fingerprint", "left_semi").distinct()
    lower = texts.select("fingerprint", F.col("folded").alias("other"))
    # A 128-bit clash holds a few texts, however large the bucket.
    return texts.join(lower, "fingerprint").groupBy("fingerprint", "folded").agg(F.sum((F.col("other") < F.col("folded")).cast("int")).alias("number"))


def fold(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, folded binary) of each row; a null text folds as the empty one."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(canonical, batch.column(1).to_pylist()), pa.binary())], ["doc_id", "folded"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, folded binary")


#: Digests that occur again, handed to every worker up to this number; beyond it they are joined.
AGAIN_BROADCAST = 200_000


def _again_rows(documents: DataFrame, again: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(fingerprint, folded) of the documents whose digest is in ``again``; a task gives each pair once while they are few enough to be broadcast."""
    few = again.limit(AGAIN_BROADCAST + 1).count() <= AGAIN_BROADCAST
    wanted = documents.sparkSession.sparkContext.broadcast({bytes.fromhex(r[0]) for r in again.collect()} if few else None)

    def run(batches):
        sent = set()  # a digest and a cryptographic hash of the bytes: what this task has handed on already
        for batch in slices(batches):
            pairs = {(xxhash.xxh3_128_digest(x), x) for x in batch.column(1).to_pylist()}
            if wanted.value is not None:
                named = {(d, hashlib.sha256(x).digest()): (d, x) for d, x in pairs if d in wanted.value}
                pairs = {p for k, p in named.items() if k not in sent}
                sent.update(named)
            names, texts = [d.hex() for d, _ in pairs], [x for _, x in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["fingerprint", "folded"])

    rows = fold(documents, text, doc_id).mapInArrow(run, "fingerprint string, folded binary")
    return rows if few else rows.join(again, "fingerprint", "left_semi")


def settle(digests: DataFrame, documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``digests`` with ``fingerprint`` made distinct for texts that differ; it has ``fingerprint_key`` besides.

    The folded bytes of ``documents`` are compared inside each bucket of two
    rows or more. Where no digest stands for two texts, as good as always,
    nothing else is joined.
    """
    again = cut(digests.groupBy("fingerprint").count().where("count > 1").select("fingerprint"))
    numbers = cut(_bucket_numbers(_again_rows(documents, again, text, doc_id)))
    if numbers.isEmpty():
        return digests
    named = numbers.where("number > 0").select("fingerprint", F.xxhash64("folded").alias("fingerprint_key"), F.concat_ws("-", "fingerprint", "number").alias("_name"))
    return digests.join(named, ["fingerprint", "fingerprint_key"], "left").withColumn("fingerprint", F.coalesce("_name", "fingerprint")).drop("_name")


def fingerprints(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, n_copies) for each row; equal folded texts have equal fingerprints, and others never.

    A null or empty text, or one of white space only, has the digest of no
    bytes. Repeated rows stay repeated, a null doc_id is carried, other columns
    are not read, an empty table gives an empty table.
    """
    folded = fold(documents, text, doc_id)

    def run(batches):
        for batch in slices(batches):
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest, raw), pa.string()), pa.array(map(key, raw), pa.int64())], ["doc_id", "fingerprint", "fingerprint_key"])

    out = settle(cut(folded.mapInArrow(run, "doc_id long, fingerprint string, fingerprint_key long")), documents, text, doc_id)
    copies = out.groupBy("fingerprint").agg(F.count("*").alias("n_copies"))
    return out.select("doc_id", "fingerprint").join(copies, "fingerprint").select("doc_id", "fingerprint", "n_copies")


EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, fingerprint_key long, near_edited double, near_next double"


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the beginning of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edited_fingerprints(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text's fingerprint, its edited text's, and the likeness of its own to that and to the next text's (1 if the bytes are equal, else 0).

    The next document is the one after it by (doc_id, text), the null doc_id
    first, and the first one after the last; a table of one row follows itself.
    The table is sorted by range once and read in order; what a partition lacks
    is the first text of the one after it, so each hands its first and last row
    to a small second step. Empty tables give empty tables.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.withColumn("part", F.spark_partition_id())
    schema = f"{EDITS}, part int, kind int, text string"

    def row(doc, own, following):
        edited, mine = edited_text(own, following), canonical(own)
        theirs = canonical(edited)
        sha = hashlib.sha256(edited.encode("utf-8")).hexdigest()
        return doc, len(own), sha, digest(mine), digest(theirs), key(mine), float(mine == theirs), float(mine == canonical(following))

    def frame(out):
        return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=arrow)

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    arrow = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        last = part = None
        for batch in slices(batches):
            out = []
            for doc, own, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None:
                    out.append((doc, *[None] * 7, part, 1, own))
                else:
                    out.append((*row(*last, own), part, 0, None))
                last = doc, own
            yield frame(out)
        if last is not None:
            yield frame([(last[0], *[None] * 7, part, 2, last[1])])

    done = cut(rows.mapInArrow(run, schema))
    # Two rows for each partition of the sort: its first and its last document.
    edge = done.where("kind > 0").select("part", "kind", "doc_id", "text")
    first = edge.where("kind = 1").select(F.col("part").alias("at"), F.col("text").alias("following"))
    parts = sorted(r[0] for r in edge.where("kind = 1").select("part").collect())
    after = documents.sparkSession.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, at int")
    ends = edge.where("kind = 2").join(after, "part").join(first, "at").select("doc_id", "text", "following")

    def run_ends(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(names[:8], row(*r), strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)], schema=pa.schema(list(arrow)[:8]))

    out = done.where("kind = 0").select(names[:8]).unionAll(ends.mapInArrow(run_ends, EDITS))
    return settle(out, documents, text, doc_id).drop("fingerprint_key")
