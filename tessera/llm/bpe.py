"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round the adjacent
pairs are looked up by binary search over the sorted pair keys, every word
merges all places of its lowest-rank pair, and finished words leave the array.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks

NO_RANK = np.iinfo(np.int32).max
#: Words remembered by a worker; beyond that it starts afresh.
CACHE_WORDS = 400_000
#: A space and what can begin white space after it (in UTF-8; some of it is none).
SPACE_SPACE = [b" " + x for x in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80")]
#: Fixed value: how byte-level BPE files split text if they name no pattern themselves.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def newer_letters() -> str:
    """Letters and numbers of the regex module's Unicode that Python's (and the encoders') doesn't have yet, as a class body."""
    found = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x250, 0xD800), *range(0xE000, 0x110000)])))
    return "".join(regex.escape(c) for c in found if unicodedata.category(c)[0] not in "LN")


class Vocabulary:
    """A byte-level BPE file: ids, sorted pair keys, text splitting and normalising."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = max(*self.ids.values(), *self.special.values(), 0) + 1
        self.names = [""] * self.size
        for name, i in [*self.ids.items(), *((k.decode(), i) for k, i in self.special.items())]:
            self.names[i] = name
        end = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int32)
        self.last = np.array([self.ids[c + end] for c in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], np.int64)
        right = np.array([self.ids[b] for _, b in merges], np.int64)
        whole = np.array([self.ids[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        # uint32 where the keys fit: the search then stays in the processor's cache.
        self.key_type = np.uint32 if self.size**2 < 2**32 else np.uint64
        self.pair_keys = keys[order].astype(self.key_type)
        self.no_pair = len(order)
        self.pair_rank = np.append(order, NO_RANK).astype(np.int32)
        self.pair_whole = np.append(whole[order], -1).astype(np.int32)
        self.folds = spec.get("normalizer") is not None
        pattern = self._pattern(spec["pre_tokenizer"])
        self.words = regex.compile(pattern)
        if newer := newer_letters():
            for kind in ("L", "N"):
                pattern = pattern.replace(rf"[\p{{{kind}}}]", rf"\p{{{kind}}}").replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{newer}]]")
        self.words_beyond_latin = regex.compile(pattern, regex.V1)
        self.specials = regex.compile(b"(" + b"|".join(map(regex.escape, self.special)) + b")") if self.special else None

    @staticmethod
    def _pattern(spec: dict) -> str:
        for part in spec.get("pretokenizers", []):
            if part["type"] == "Split":
                return part["pattern"]["Regex"]
        return BYTE_LEVEL

    def normal(self, text: str) -> str:
        if not self.folds:
            return text
        if text.isascii():
            return text.lower()
        # Each capital sigma becomes the medial one: letters fold without their context.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[bytes]:
        """The text in UTF-8, cut where no pre-token can reach across.

        Files that drop white space are cut at white space. In the others a
        space begins the word after it, so the cut is before each space, unless
        white space follows a space somewhere: then the pre-tokens themselves
        are the pieces. A special string is a piece of its own.
        """
        raw = text.encode("utf-8")
        if self.specials is None or b"<|" not in raw:
            return self._cut(raw)
        parts = self.specials.split(raw)
        return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self._cut(part))]

    def _cut(self, raw: bytes) -> list[bytes]:
        if self.folds:
            return raw.split()
        if any(map(raw.__contains__, SPACE_SPACE)):
            return [w.encode("utf-8") for w in self.split(raw)]
        first, *rest = raw.split(b" ")
        return [first, *map(b" ".__add__, rest)] if first else list(map(b" ".__add__, rest))

    def split(self, piece: bytes) -> list[str]:
        """Pre-tokens of a piece."""
        text = self.normal(piece.decode("utf-8"))
        if text.isalpha() or (text[:1] == " " and text[1:].isalpha() and not self.folds):
            return [text]
        return (self.words if not text or max(text) < "\u0250" else self.words_beyond_latin).findall(text)

    def pair_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where the sorted table holds each pair; ``no_pair`` if it doesn't."""
        keys = left.astype(self.key_type) * self.key_type(self.size) + right.astype(self.key_type)
        at = np.searchsorted(self.pair_keys, keys)
        at[at == self.no_pair] = 0
        return np.where(self.pair_keys[at] == keys, at, self.no_pair)

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all words in one array, and each word's number of them."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[data]
        ends = np.cumsum(sizes) - 1
        flat[ends] = self.last[data[ends]]
        return flat, sizes


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def every_other(chosen: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring places the first, third, ...: merges that don't overlap."""
    if not (chosen[1:] & chosen[:-1]).any():
        return chosen
    at = np.arange(len(chosen))
    begins = chosen & ~np.concatenate(([False], chosen[:-1]))
    begun = np.maximum.accumulate(np.where(begins, at, 0))
    return chosen & ((at - begun) % 2 == 0)


def merge_rounds(flat: np.ndarray, sizes: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of all words in one array, and each word's number of them.

    ``pair`` has, for each place, where the table holds the pair that starts
    there; only places beside a merge are looked up again.
    """
    n_words = len(sizes)
    word = np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    pair = np.full(len(flat), vocab.no_pair, np.int32)
    if len(flat):
        inner = np.flatnonzero(word[:-1] == word[1:])
        pair[inner] = vocab.pair_at(flat[inner], flat[inner + 1])
    done_word, done_flat = [], []
    while len(flat):
        rank = vocab.pair_rank[pair]
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
        live = lowest != NO_RANK
        if not live.all():
            done_word.append(word[~live])
            done_flat.append(flat[~live])
        merge = every_other((rank == lowest) & live)
        flat = np.where(merge, vocab.pair_whole[pair], flat)
        keep = live
        keep[1:] &= ~merge[:-1]
        flat, word, pair, merge = flat[keep], word[keep], pair[keep], merge[keep]
        beside = merge.copy()
        beside[:-1] |= merge[1:]
        at = np.flatnonzero(beside)
        pair[at] = vocab.no_pair
        at = at[at + 1 < len(word)]
        at = at[word[at] == word[at + 1]]
        pair[at] = vocab.pair_at(flat[at], flat[at + 1])
    if not done_word:
        return np.zeros(0, np.int64), np.zeros(n_words, np.int64)
    words, symbols = np.concatenate(done_word), np.concatenate(done_flat)
    return symbols[np.argsort(words, kind="stable")], np.bincount(words, minlength=n_words)


#: Where a text's pieces can't be cut at each space alone: a space and more white space, or what may be a special string.
UNEVEN = r" [ \t\n\v\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class PieceTable:
    """The pieces of a column of texts: each distinct one once, and for every text the numbers of its pieces."""

    def __init__(self, texts: pa.Array, vocab: Vocabulary):
        texts = texts.fill_null("")
        if vocab.folds:
            lists = pc.ascii_split_whitespace(texts)
        else:
            lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        self.unique: list[bytes] = coded.dictionary.cast(pa.binary()).to_pylist()
        codes = coded.indices.to_numpy().astype(np.int64)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        odd = pc.match_substring(texts, "<|")
        if not vocab.folds:
            odd = pc.or_(odd, pc.match_substring_regex(texts, UNEVEN))
            # A space begins every piece but a text's first.
            first, self.unique = [], [b" " + x for x in self.unique]
            for at in bounds[:-1].tolist():
                first.append(self.unique[codes[at]][1:])
            codes[bounds[:-1]] = len(self.unique) + np.arange(len(first))
            self.unique += first
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False))[::-1]:
            own = vocab.pieces(texts[row].as_py())
            codes = np.concatenate([codes[: bounds[row]], len(self.unique) + np.arange(len(own)), codes[bounds[row + 1] :]])
            bounds[row + 1 :] += len(own) - (bounds[row + 1] - bounds[row])
            self.unique += own
        self.codes, self.bounds = codes, bounds

    def sums(self, each: np.ndarray) -> np.ndarray:
        """For each text the sum of a number that every distinct piece has."""
        run = np.concatenate([[0], np.cumsum(each[self.codes])])
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def gathered(self, packed: list[bytes], width: int = 4) -> tuple[bytes, list[int]]:
        """The texts' packed pieces (of items of ``width`` bytes) one after another, and the bytes where each text ends, from 0."""
        kind = np.dtype(f"<u{width}")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // width
        pool, starts = np.frombuffer(b"".join(packed), kind), np.cumsum(sizes) - sizes
        lens = sizes[self.codes]
        ends = np.cumsum(lens)
        at = np.repeat(starts[self.codes] - (ends - lens), lens) + np.arange(int(lens.sum()))
        run = np.concatenate([[0], ends])
        return pool[at].tobytes(), (width * run[self.bounds]).tolist()


def parts(column: pa.Array, most: int = 8_000_000):
    """Slices of a column of texts with about ``most`` bytes, one text at least."""
    sizes = pc.binary_length(column).fill_null(0).to_pylist()
    for part in chunks(sizes, most):
        yield part, column.slice(part.start, part.stop - part.start)


class Encoder:
    """Pieces of text to ids, with the pieces seen lately remembered."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.packed: dict[bytes, bytes] = {}
        self._reset()

    def _reset(self) -> None:
        self.packed.clear()
        for name, i in self.vocab.special.items():
            self.packed[name] = np.array([i], "<u4").tobytes()

    def learn(self, pieces: list[bytes]) -> None:
        """Encodes the pieces that aren't remembered yet, all in one batch."""
        new = [x for x in set(pieces) if x not in self.packed]
        if len(self.packed) + len(new) > CACHE_WORDS:
            self._reset()
            new = [x for x in set(pieces) if x not in self.packed]
        if new:
            words = list(map(self.vocab.split, new))
            each = set().union(*words)
            ids = {w: known for w in each if (known := self.packed.get(w.encode("utf-8"))) is not None}
            each = list(each.difference(ids))
            symbols, sizes = merge_rounds(*self.vocab.symbols(each), self.vocab)
            data, ends = symbols.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            ids.update(zip(each, (data[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            self.packed.update(zip(new, (ids[w[0]] if len(w) == 1 else b"".join(map(ids.__getitem__, w)) for w in words), strict=True))

    def known(self, pieces: list[bytes]) -> list[bytes]:
        self.learn(pieces)
        return list(map(self.packed.__getitem__, pieces))

    def encode_batch(self, texts: list[str]):
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for _, part in parts(pa.array(texts, pa.string())):
            table = PieceTable(part, self.vocab)
            data, ends = table.gathered(self.known(table.unique))
            yield from (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker and file: pieces seen in earlier batches stay known."""
    return Encoder(path)


def decode(packed: bytes, vocab: Vocabulary) -> str:
    """The text of packed ids as files without a decoder give it: token names with spaces between."""
    return " ".join(map(vocab.names.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encoded(column: pa.Array, known: Encoder):
    """(slice, ids and decoded text of each text in it) for slices of the column."""
    spaced = [f"{name} ".encode() for name in known.vocab.names]
    for part, texts in parts(column):
        table = PieceTable(texts, known.vocab)
        packed = known.known(table.unique)
        names = [b"".join(map(spaced.__getitem__, array("I", p))) for p in packed]
        ids, ends = table.gathered(packed)
        text, stops = table.gathered(names, 1)
        yield part, [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)], [text[a : max(a, b - 1)] for a, b in zip(stops, stops[1:], strict=False)]


def encode_documents(documents: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids binary, decoded string) for each row; ids are little-endian unsigned 32-bit integers.

    A null or empty text has no ids and decodes to the empty string. Repeated
    rows stay repeated, a null doc_id is carried, other columns are not read,
    and an empty table gives an empty table. A text of any length is encoded whole.
    """

    def run(batches):
        known = encoder(path)
        for batch in batches:
            for part, ids, texts in encoded(batch.column(1), known):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(ids, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "decoded"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(documents: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``encode_documents`` with its ids and texts hashed where they are made.

    Nulls, empty texts, repeated rows and empty tables are as there.
    """

    def run(batches):
        known = encoder(path)
        for batch in batches:
            for part, ids, texts in encoded(batch.column(1), known):
                sizes = [len(x) // 4 for x in ids]
                shas = [pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()) for data in (ids, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(sizes, pa.int64()), *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
