"""Line dedup with a log-template tree.

A line's tokens that hold digits are variable fields. The tree has a fixed
depth: the number of tokens, then the leading tokens. Lines of a leaf belong
together where they agree in most other tokens. These are cut into a few blocks,
and a line's templates are its tokens whole and with any two blocks taken as
variable (one token in short lines): whatever two fields of two lines differ,
they have a template in common, and nothing depends on the order in which lines
arrive. Only lines of leaves that hold several different lines are given templates
with variable blocks. Lines with a template that recurs across documents are
dropped. What says less needs more holders: a template with variable blocks, or a
line of a word or two.

Copies and near copies of a document share all their lines without these being
boilerplate. A template recurs, therefore, if documents that are no copies of
each other hold it, however many copies there are of either: if some holder is
unlike the holder of the least text hash. Two holders are alike if enough of the
least hashes of their three-word shingles, those of the line itself left out,
are common to both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, release

LEADING = 2
#: (from tokens, to tokens, blocks, blocks that vary): from half to four fifths of a line's tokens stay fixed.
VARYING = ((5, 8, 5, 1), (8, 24, 5, 2), (24, 1 << 62, 4, 2))
#: Documents that hold a template that recurs, at least: of whole lines, of those with variable blocks, of short lines.
MIN_DOCS, VARIED_DOCS, SHORT_DOCS = 2, 5, 20
#: Lines of fewer tokens and fewer bytes in them are short.
SHORT_TOKENS, SHORT_BYTES = 4, 24
#: A template's last two bits tell its kind.
WHOLE, VARIED, SHORT, LEAF = 0, 1, 2, 3
#: Least hashes (32 bits each) of the rest of a document by which copies are told, and how many of them copies have in common
#: at least: so many that of thousands of near copies with three fifths in common none looks unlike by chance.
SKETCH, COMMON = 64, 16
#: Bytes of the two sizes before a sketch's hashes.
SIZES = 16
#: Templates of more holders, and of more than one in ``CROWDS`` of all templates' holders, are held against their reference by broadcast.
CROWD, CROWDS = 100, 100_000
#: Recurring templates handed to every worker (8 bytes each) up to this number; beyond it lines are joined to them.
TEMPLATES_BROADCAST = 2_000_000
#: Bytes of text taken at once; longer texts are cut between lines.
STEP_BYTES = 500_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_BASE = 0x5851F42D4C957F2D
_LETTER = np.random.default_rng(23).integers(0, 1 << 64, 256, np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), range(48, 58))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the base of token hashes, and of its inverse, modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.full(n + (n >> 2), b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of all before each place, and of all."""
    out = np.zeros(len(x) + 1, x.dtype)
    np.cumsum(x, out=out[1:])
    return out


class Lines:
    """The lines of some texts and the hashes of their tokens, in flat arrays: ``text`` of each line, ``start`` and ``end`` of its bytes, ``first`` token of each (and the end), ``token`` hashes."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        breaks = np.flatnonzero(data == 10)
        self.start, self.end = np.append(0, breaks + 1), np.append(breaks, len(data))
        self.text = np.searchsorted(np.cumsum(size + 1) - size - 1, self.start, "right") - 1
        space = np.concatenate(([True], _SPACE[data], [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        begins, ends = edge[::2], edge[1::2]
        up, down = _powers.of(len(data) + 1)
        sums = _sums(_LETTER[data] * up[: len(data)])
        self.token = mix((sums[ends] - sums[begins]) * down[begins])
        digits = _sums(_DIGIT[data].astype(np.int32))
        self.digit = digits[ends] > digits[begins]
        self.bytes = _sums(ends - begins)
        self.first = np.append(np.searchsorted(begins, self.start), len(begins))

        first, last = self.first[:-1], self.first[1:]
        self.n = last - first
        line = np.repeat(np.arange(len(self.n)), self.n)
        fields = _sums(self.digit.astype(np.int64))
        fields = fields[last] - fields[first]
        # A line that is mostly variable fields would be like any other: it is taken as it is.
        token = np.where(self.digit & (2 * fields <= self.n)[line], np.uint64(1), self.token)
        place = np.arange(len(token), dtype=np.int64) - first[line]
        self.sums = _sums(mix(token ^ (place.astype(np.uint64) + np.uint64(1)) * _M2))
        self.total, self.size = self.sums[last] - self.sums[first], self.n.astype(np.uint64) * _M3

    def _named(self, at: np.ndarray, fixed: np.ndarray, name: int, kind) -> np.ndarray:
        return ((mix(fixed ^ self.size[at] ^ np.array(name, np.uint64) * _M1) & ~np.uint64(3)) | np.asarray(kind, np.uint64)).view(np.int64)

    def wholes(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, template) of each line with all its tokens, lines without tokens left out."""
        some = np.flatnonzero(self.n)
        short = (self.n < SHORT_TOKENS) & (self.bytes[self.first[1:]] - self.bytes[self.first[:-1]] < SHORT_BYTES)
        return some, self._named(some, self.total[some], 0, np.where(short[some], SHORT, WHOLE))

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, leaf) of each line that may have variable blocks: its number of tokens and its leading tokens."""
        some = np.flatnonzero(self.n >= VARYING[0][0])
        first = self.first[some]
        return some, self._named(some, self.sums[first + LEADING] - self.sums[first], 1, LEAF)

    def varied(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, template) of the templates with variable blocks of the lines ``some``."""
        lines, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low, high, blocks, varying in VARYING:
            here = some[(self.n[some] >= low) & (self.n[some] < high)]
            if not len(here):
                continue
            rest, begin = self.n[here] - LEADING, self.first[here] + LEADING
            bounds = [self.sums[begin + rest * b // blocks] for b in range(blocks + 1)]
            empty = [rest * b // blocks == rest * (b + 1) // blocks for b in range(blocks)]
            for k, out in enumerate(combinations(range(blocks), varying)):
                fixed = self.total[here].copy()
                for b in out:
                    fixed -= bounds[b + 1] - bounds[b]
                full = ~np.logical_or.reduce([empty[b] for b in out])
                lines.append(here[full])
                found.append(self._named(here[full], fixed[full], k + 2, VARIED))
        return np.concatenate(lines), np.concatenate(found)

    def templates(self) -> tuple[np.ndarray, np.ndarray]:
        """(line, template) for each template of each line."""
        (a, b), (c, d) = self.wholes(), self.varied(np.arange(len(self.n)))
        return np.concatenate((a, c)), np.concatenate((b, d))

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the three-word shingles and the line of each; a shorter line's words are one shingle."""
        one, n = self.token, np.diff(self.first)
        line = np.repeat(np.arange(len(n)), n)
        ahead = np.concatenate((one, np.zeros(2, np.uint64)))
        owner = np.concatenate((line, [-1, -1]))
        second, third = owner[1:-1] == line, owner[2:] == line
        mixed = mix(one * _M1 ^ np.where(second, ahead[1:-1], 0) * _M2 ^ np.where(third, ahead[2:], 0) * _M3)
        whole = np.zeros(len(one), bool)
        whole[self.first[:-1][n > 0]] = True
        some = third | whole
        return mixed[some], line[some]


def templates(line: bytes) -> list[int]:
    """Hashes of one line's templates, the whole one first."""
    return Lines([line]).templates()[1].tolist()


def need(template: Column, min_docs: int = MIN_DOCS) -> Column:
    """Documents that must hold the template for it to recur."""
    kind = template.bitwiseAND(F.lit(3))
    return F.when(kind.isin(VARIED, LEAF), max(VARIED_DOCS, min_docs)).when(kind == SHORT, max(SHORT_DOCS, min_docs)).otherwise(min_docs)


def rest_sketch(hashes: np.ndarray, inside: np.ndarray) -> bytes:
    """Shingles in some lines (marked by ``inside``, in order of the hashes) and in the others, and the ``SKETCH`` least distinct hashes of the others without any that those lines hold."""
    few, mine = 4 * SKETCH, int(inside.sum())
    sizes = np.array([mine, len(hashes) - mine], np.uint64).tobytes()
    while True:
        gone = hashes[:few][inside[:few]]
        # Equal hashes stand side by side, so that all but the last here are known whole.
        kept = hashes[:few][~inside[:few]]
        if len(kept):
            kept = kept[np.concatenate(([True], kept[1:] != kept[:-1]))]
        if len(gone):
            kept = kept[gone[np.minimum(np.searchsorted(gone, kept), len(gone) - 1)] != kept]
        if len(hashes) > few:
            kept = kept[kept < hashes[few]]
        if len(kept) >= SKETCH or few >= len(hashes):
            return sizes + kept[:SKETCH].tobytes()
        few *= 4


def _sketches(column: pa.Array) -> np.ndarray:
    """(rows, 4 + SKETCH): the two sizes, two numbers each, and the hashes of each sketch, filled up with the largest number."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    flat = np.frombuffer(column.buffers()[2], np.uint32, int(ends[-1])) if len(column) else np.zeros(0, np.uint32)
    size, first = np.diff(ends), int(ends[0]) if len(ends) else 0
    out = np.full((len(column), 4 + SKETCH), np.uint32((1 << 32) - 1))
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(ends[:-1] - first, size)] = flat[first:]
    return out


def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether each two rests are those of copies: of the least hashes of both, as many as ``COMMON`` of ``SKETCH`` are in each.

    So are documents that are near copies by the line alone, four fifths of all they hold.
    """
    a, b = _sketches(a), _sketches(b)
    sizes = np.stack([a[:, [0, 2]], b[:, [0, 2]]]).astype(np.int64)
    inside, rest = sizes[:, :, 0], sizes[:, :, 1].sum(0)
    all_ = np.sort(np.concatenate([a[:, 4:], b[:, 4:]], 1), axis=1)
    some = all_ != np.uint32((1 << 32) - 1)
    # Either sketch has a hash once: what stands there twice is in both.
    twice = np.zeros(all_.shape, bool)
    twice[:, 1:] = (all_[:, 1:] == all_[:, :-1]) & some[:, 1:]
    rank = np.cumsum(some & ~twice, 1)
    both, least = (twice & (rank <= SKETCH)).sum(1), np.minimum(rank[:, -1], SKETCH)
    return (5 * inside.min(0) >= 4 * (inside.max(0) + rest)) | (SKETCH * both >= COMMON * least)


def _few(found: DataFrame, most: int):
    """The templates, sorted, as a broadcast array, or None if they are more than ``most``."""
    if found.count() > most:
        return None
    names = np.sort(found.select("template").toArrow().column("template").to_numpy())
    return found.sparkSession.sparkContext.broadcast(names)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def _steps(texts: list[bytes]):
    """(numbers of texts, ``Lines`` of them) for all texts in steps of about ``STEP_BYTES``; a longer text is in several steps, cut between lines."""
    numbers, parts, held = [], [], 0
    for i, raw in enumerate(texts):
        at = 0
        while True:
            end = raw.find(b"\n", at + STEP_BYTES) if len(raw) - at > STEP_BYTES else -1
            part = raw[at:] if end < 0 else raw[at:end]
            if parts and held + len(part) > STEP_BYTES:
                yield np.array(numbers), Lines(parts)
                numbers, parts, held = [], [], 0
            numbers.append(i)
            parts.append(part)
            held += len(part)
            if end < 0:
                break
            at = end + 1
    if parts:
        yield np.array(numbers), Lines(parts)


def _batches(batches, at: int = 0, rows: int = 1_024):
    """(batch, texts as UTF-8, null texts empty) in runs of few rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            yield part, [t or b"" for t in part.column(at).cast(pa.binary()).to_pylist()]
    release()


def _each_once(text: np.ndarray, template: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((template, text))
    text, template = text[order], template[order]
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (template[1:] != template[:-1])))[: len(text)]
    return text[new], template[new]


def _marks(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("text").cast("string").alias("text"))


def _lines(documents: DataFrame) -> DataFrame:
    """(template, mark) rows: each document's every whole template once, mark a hash of its text, and its leaves, mark the whole template."""

    def run(batches):
        for _, texts in _batches(batches):
            numbers, found, leaves, wholes = [], [], [], []
            for owner, lines in _steps(texts):
                line, names = lines.wholes()
                numbers.append(owner[lines.text[line]])
                found.append(names)
                some, leaf = lines.leaves()
                leaves.append(leaf)
                wholes.append(names[np.searchsorted(line, some)])
            text, template = _each_once(np.concatenate(numbers), np.concatenate(found))
            template, mark = np.concatenate([template, *leaves]), np.concatenate([_marks(texts)[text], *wholes])
            yield pa.RecordBatch.from_arrays([pa.array(template), pa.array(mark)], ["template", "mark"])

    return _texts(documents).mapInArrow(run, "template long, mark long")


def _varied(documents: DataFrame, leaves: DataFrame, most_broadcast: int) -> DataFrame:
    """(template, mark) rows for the lines in ``leaves`` (template): their templates with variable blocks, mark the whole template."""
    shared = _few(leaves, most_broadcast)

    def run(batches):
        for _, texts in _batches(batches):
            for _, lines in _steps(texts):
                some, leaf = lines.leaves()
                if shared is not None:
                    there = _among(leaf, shared.value)
                    some, leaf = some[there], leaf[there]
                if not len(some):
                    continue
                line, names = lines.varied(some)
                at, (whole_line, whole) = np.searchsorted(some, line), lines.wholes()
                columns = [pa.array(leaf[at]), pa.array(names), pa.array(whole[np.searchsorted(whole_line, line)])]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "template", "mark"])

    rows = _texts(documents).mapInArrow(run, "leaf long, template long, mark long")
    if shared is None:
        rows = rows.join(leaves.withColumnRenamed("template", "leaf"), "leaf", "left_semi")
    return rows.select("template", "mark")


def _rests(documents: DataFrame, only=None) -> DataFrame:
    """(template, text, rest) rows, rest the sketch of the document without the lines of the template; of those in the broadcast ``only`` if it is given."""

    def run(batches):
        for _, texts in _batches(batches, rows=512):
            parts: dict[int, list] = {}
            for owner, lines in _steps(texts):
                line, names = lines.templates()
                if only is not None:
                    wanted = _among(names, only.value)
                    line, names = line[wanted], names[wanted]
                if not len(line):
                    continue
                order = np.argsort(line, kind="stable")
                line, names = line[order], names[order]
                hashes, of = lines.shingles()
                for t in np.unique(lines.text[line]):
                    low, high = np.searchsorted(lines.text, [t, t + 1])
                    (a, b), (c, d) = np.searchsorted(line, [low, high]), np.searchsorted(of, [low, high])
                    parts.setdefault(int(owner[t]), []).append((line[a:b] - low, names[a:b], hashes[c:d], of[c:d] - low, high - low))
            found, marks, rests = [], [], []
            for number, some in parts.items():
                if len(texts[number]) > STEP_BYTES:  # all its steps, those without such lines too
                    some = _whole(texts[number], only)
                line, names, hashes, of, _ = some[0]
                order = np.argsort(hashes, kind="stable")
                hashes, of = (hashes[order] >> np.uint64(32)).astype(np.uint32), of[order]
                mark, known = xxhash.xxh64_intdigest(texts[number]), {}
                by = np.argsort(names, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], names[by][1:] != names[by][:-1], [True])))
                for a, b in zip(edges, edges[1:], strict=False):
                    out = np.unique(line[by[a:b]])
                    if out.tobytes() not in known:
                        known[out.tobytes()] = rest_sketch(hashes, _among(of, out))
                    found.append(names[by[a]])
                    marks.append(mark)
                    rests.append(known[out.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(rests, pa.binary())], ["template", "text", "rest"])

    return _texts(documents).mapInArrow(run, "template long, text long, rest binary")


def _whole(raw: bytes, only) -> list:
    """A long text's lines, templates and shingles from all its steps."""
    out, begin = [], 0
    for _, lines in _steps([raw]):
        line, names = lines.templates()
        if only is not None:
            wanted = _among(names, only.value)
            line, names = line[wanted], names[wanted]
        hashes, of = lines.shingles()
        out.append((line + begin, names, hashes, of + begin))
        begin += len(lines.text)
    return [(*(np.concatenate(x) for x in zip(*out, strict=True)), begin)]


def recurring(documents: DataFrame, min_docs: int = MIN_DOCS, most_broadcast: int = TEMPLATES_BROADCAST) -> DataFrame:
    """(template) that recur: of as many documents as its kind needs or more, some of them no copies of each other."""

    def unlike(batches):
        for batch in batches:
            yield batch.select(["template"]).filter(pa.array(~alike(batch.column(1), batch.column(2))))

    enough = F.col("n") >= need(F.col("template"), min_docs)

    def of_unlike(rows):
        # Counts combine on the map side: a line of every document is one row for each task.
        ends = rows.groupBy("template").agg(F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b"))
        return cut(ends.where(enough).where("a != b").select("template"))

    first = of_unlike(_lines(documents))
    leaf = F.col("template").bitwiseAND(F.lit(3)) == LEAF
    maybe = first.where(~leaf).unionAll(of_unlike(_varied(documents, first.where(leaf), most_broadcast)))
    few = _few(maybe, most_broadcast)
    rows = _rests(documents, few)
    # A document that is nothing but the line doesn't tell whether others are its copies.
    rows = cut((rows if few is not None else rows.join(maybe, "template", "left_semi")).where(F.length("rest") > SIZES))
    firsts = cut(rows.groupBy("template").agg(F.count("*").alias("n"), F.min("text").alias("first"), F.max("text").alias("last")).where("first != last").where(enough))
    # Fewer than CROWDS templates can have more than a CROWDS-th of all rows: few enough to be broadcast whatever the input's size.
    total = firsts.agg(F.sum("n")).first()[0] or 0
    crowd = max(CROWD, total // CROWDS)
    crowds = F.broadcast(firsts.where(F.col("n") > crowd))
    quiet = rows.join(crowds.select("template"), "template", "left_anti").join(firsts.where(F.col("n") <= crowd), "template")
    crowded = rows.join(crowds, "template")
    refs, crowd_refs = (x.where("text = first").groupBy("template").agg(F.first("rest").alias("ref")) for x in (quiet, crowded))
    pairs = quiet.where("text != first").join(refs, "template").select("template", "rest", "ref")
    pairs = pairs.unionAll(crowded.where("text != first").join(F.broadcast(crowd_refs), "template").select("template", "rest", "ref"))
    return cut(pairs.mapInArrow(unlike, "template long").distinct())


#: Columns that the result adds; input columns of these names give way.
ADDED = ("n_lines", "n_dropped")


def _by_broadcast(documents: DataFrame, shared) -> DataFrame:
    at, names = documents.columns.index("text"), [*documents.columns, *ADDED]
    documents = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))  # whatever their names hold
    schema = T.StructType([*documents.schema.fields, *(T.StructField(c, T.IntegerType()) for c in ADDED)])

    def run(batches):
        for batch, texts in _batches(batches, at):
            n_lines, n_dropped, changed = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), {}
            for owner, lines in _steps(texts):
                n_lines += np.bincount(owner[lines.text], minlength=len(texts)).astype(np.int32)
                line, found = lines.templates()
                gone = np.zeros(len(lines.text), bool)
                gone[line[_among(found, shared.value)]] = True
                n_dropped += np.bincount(owner[lines.text[gone]], minlength=len(texts)).astype(np.int32)
                for t in np.unique(lines.text[gone]):
                    low, high = np.searchsorted(lines.text, [t, t + 1])
                    changed[int(owner[t])] = gone[low:high]
            null = batch.column(at).is_null().to_numpy(zero_copy_only=False)
            n_lines[null] = 0
            for t, gone in changed.items():
                parts = texts[t].split(b"\n")
                gone = gone if len(texts[t]) <= STEP_BYTES else _gone(texts[t], shared.value)
                texts[t] = b"\n".join([x for x, g in zip(parts, gone.tolist(), strict=True) if not g])
            text = pa.array(texts, pa.binary(), mask=null).cast(pa.string())
            columns = [*batch.columns[:at], text, *batch.columns[at + 1 :], pa.array(n_lines), pa.array(n_dropped)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *ADDED])

    return documents.mapInArrow(run, schema).toDF(*names)


def _gone(raw: bytes, known: np.ndarray) -> np.ndarray:
    """Which lines of a long text go, from all its steps."""
    out = []
    for _, lines in _steps([raw]):
        line, names = lines.templates()
        gone = np.zeros(len(lines.text), bool)
        gone[line[_among(names, known)]] = True
        out.append(gone)
    return np.concatenate(out)


def _by_join(documents: DataFrame, found: DataFrame) -> DataFrame:
    def run(batches):
        for batch, texts in _batches(batches, 1):
            ids, begin = batch.column(0).to_numpy(), np.zeros(len(texts), np.int64)
            for owner, lines in _steps(texts):
                line, names = lines.templates()
                text = owner[lines.text]
                at = np.arange(len(text)) - np.searchsorted(text, text) + begin[text]
                begin += np.bincount(text, minlength=len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(ids[text[line]]), pa.array(at[line].astype(np.int32)), pa.array(names)], ["row", "line", "template"])

    # All input columns are held in one, so that none of them clashes with those added here.
    numbered = cut(documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("held")))
    lines = numbered.select("row", "held.text").mapInArrow(run, "row long, line int, template long").join(found, "template", "left_semi")
    both = numbered.join(lines.groupBy("row").agg(F.collect_set("line").alias("gone")), "row", "left")
    parts = F.split("held.text", "\n", -1)
    kept = F.filter(parts, lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    n = F.when(F.col("held.text").isNull(), 0).otherwise(F.size(parts))
    gone = F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0)
    columns = (F.array_join(kept, "\n").alias(c) if c == "text" else F.col(f"held.`{c}`").alias(c) for c in documents.columns)
    return both.select(*columns, n.cast("int").alias(ADDED[0]), gone.cast("int").alias(ADDED[1]))


def drop_recurring(documents: DataFrame, min_docs: int = MIN_DOCS, most_broadcast: int = TEMPLATES_BROADCAST) -> DataFrame:
    """``documents`` with the lines of recurring templates taken out of ``text``, and n_lines and n_dropped.

    A template recurs from ``min_docs`` documents on, one with variable blocks
    from ``VARIED_DOCS`` and a short line (fewer than ``SHORT_TOKENS`` tokens and
    ``SHORT_BYTES`` bytes) from ``SHORT_DOCS``. Blank lines stay. A null text
    stays null (no lines) and an empty one empty (one line); a text whose every
    line goes becomes empty. Repeated rows count as documents but, being copies,
    don't make their lines recur; each is returned. Other columns, null doc_ids
    among them, are carried, but for input columns named n_lines or n_dropped.
    An empty table gives an empty table.
    """
    documents = documents.drop(*ADDED).withColumn("text", F.col("text").cast("string"))
    found = recurring(documents, min_docs, most_broadcast)
    shared = _few(found, most_broadcast)
    return _by_join(documents, found) if shared is None else _by_broadcast(documents, shared)
