"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, token_counts
from tests.llm.conftest import ODD

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def strange(n=400):
    rng = random.Random(3)
    kinds = [lambda: rng.randrange(32, 127), lambda: rng.randrange(0x600), lambda: rng.randrange(0x1E00, 0x2100), lambda: rng.randrange(0x3000, 0x3100), lambda: rng.randrange(0x1F300, 0x1F600), lambda: 32, lambda: 10, lambda: 97]
    made = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return [*made, "", " ", "a  b", "a \nb", " a", "a ", "\n", "a\xa0 b", "x \x85y", "aaaaaaaaaaa", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "<|end <|endoftext", "a\x1cb\x1fc", *(t or "" for _, t, *_ in ODD)]


@pytest.mark.parametrize("name", FILES)
def test_ids_and_counts_are_the_librarys(name, texts):
    path = public_tokenizers.path(name)
    library, rows = Tokenizer.from_file(path), [*strange(), *texts.values()]
    ids = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert [np.frombuffer(p, "<u4").tolist() for p in bpe.Encoder(path).encode_batch(rows)] == ids
    assert token_counts.Counter(path).count(pa.array(rows)).tolist() == list(map(len, ids))


def test_forgetting_words_changes_nothing(monkeypatch, texts):
    path, rows = public_tokenizers.path(FILES[0]), list(texts.values())
    whole = list(bpe.Encoder(path).encode_batch(rows))
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    small = bpe.Encoder(path)
    assert [p for t in rows for p in small.encode_batch([t])] == whole


def test_merges_that_overlap_go_from_the_left():
    chosen = np.array([True, True, True, False, True, True])
    assert bpe.every_other(chosen).tolist() == [True, False, True, False, True, False]


def test_digests_decode_as_the_library(odd, empty, documents, texts):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe.encode_digests(documents.unionByName(odd.where("doc_id = 6").selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "'x' AS source", "0L AS n_chars")), path).collect()}
    for i, t in {**texts, 1000006: ODD[7][1]}.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    rows = bpe.encode_documents(odd, path).collect()
    assert len(rows) == len(ODD)
    assert {(len(r.ids), r.decoded) for r in rows if r.doc_id in (3, 4, 5)} == {(0, "")}
    assert bpe.encode_digests(empty, path).count() == 0


def test_counts_of_odd_rows(odd, empty):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    rows = token_counts.token_counts(odd, path, limit=1000).collect()
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 1000) for r in rows)
    assert token_counts.token_counts(empty, path).count() == 0


def test_plans_hold_every_piece_and_are_tight():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 1024), minlength=1025)
    plan = packing.plan_bins(counts, 1024)
    used = np.zeros(1025, int)
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        used += times * np.bincount(lengths, minlength=1025)
    assert (used == counts).all()
    least = -(-int(counts @ np.arange(1025)) // 1024)
    assert sum(t for _, t in plan) <= 1.002 * least + 1


def test_two_pieces_replace_the_smallest():
    # 6 + 3 leaves a gap of 1; 2 + 2 fill the expanded gap of 4 whole.
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = 1, 1, 2
    assert packing.plan_bins(counts, 10)[0] == ([6, 2, 2], 1)


@pytest.mark.parametrize("salt_rows", [packing.ROWS_A_SALT, 7])
def test_packing(salt_rows, monkeypatch, odd, empty, documents, texts):
    monkeypatch.setattr(packing, "ROWS_A_SALT", salt_rows)
    path = public_tokenizers.path(FILES[1])
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(documents, path).toPandas()
    ids = {i: [*e.ids, 2] for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    for i, g in rows.sort_values("piece").groupby("doc_id"):
        at = 0
        for k, p in enumerate(g.itertuples()):
            assert (p.piece, p.start) == (k, at) and p.length <= 1024 and (k == 0 or p.length == 1024)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    assert set(rows.doc_id) == set(ids)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= 1.02 * -(-rows.length.sum() // 1024) + 1
    strange_rows = packing.pack_documents(odd, path).toPandas()
    assert len(strange_rows[strange_rows.piece == 0]) == len(ODD)
    assert strange_rows[strange_rows.doc_id == 4].length.tolist() == [1]
    assert packing.pack_documents(empty, path).count() == 0
