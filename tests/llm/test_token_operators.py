"""Encoding, token files and packing against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from panelgrid.llm import byte_bpe, packing, token_file
from panelgrid.llm.pretokens import library_encoder, parts
from panelgrid.session import scratch_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SIGNS = "ab'stremvldX  \t\n\r\x0b\x85\xa0 ​　123٣½.,!?éüß中文🙂́Σİ_-'' ''re'll"
SCHEMA = "doc_id long, text string, ids string, n_tokens string, offset string, sequence_id string"


def odd_texts(n=1500):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return texts + ["", "a" * 3000, " " * 500, "ab" * 700, "éà" * 400, "0" * 300, "<|endoftext|>", "word " * 20000]


@pytest.fixture(scope="module")
def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library_and_round_trips(reference_bpe):
    texts = odd_texts()
    for text, ids in zip(texts, byte_bpe.piece_encoder(RANKS).encode(texts), strict=True):
        assert ids.tolist() == reference_bpe.encode_ordinary(text)
        assert byte_bpe.bpe(RANKS).decode(ids) == text.encode()


@pytest.mark.parametrize(("path", "style"), [(BYTES, "bytelevel"), (WORDS, "words")])
def test_pieces_equal_library(path, style):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = odd_texts()
    for text, ids in zip(texts, library_encoder(path, style).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_parts_lose_nothing():
    text = "one two  three\n four " * 1000
    assert "".join(parts(text, 100)) == text and len(list(parts(text, 100))) > 100
    assert list(parts("x" * 500, 100)) == ["x" * 500]


def test_encode_rows(spark, reference_bpe):
    rows = [(1, "Hello there", "c", "c", "c", "c"), (1, "Hello there", None, None, None, None), (None, None, "x", "x", "x", "x"), (3, "", "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    for back in (byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS), byte_bpe.encode(docs, RANKS, decoded=True)):
        got = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded).decode()) for r in back.collect()]
        assert got == [(i, reference_bpe.encode_ordinary(t or ""), t or "") for i, t, *_ in rows]
    assert byte_bpe.encode(docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("ids", [[], [7], list(range(1000)), [5] * 300, [0, 2**32 - 1] * 200, list(range(127)) + [2**31]])
def test_blocks_round_trip(ids):
    payload = token_file.pack(np.array(ids, np.int64))
    assert token_file.unpack(payload).tolist() == ids
    for k in range(-(-len(ids) // token_file.BLOCK)):
        assert token_file.unpack_block(payload, k).tolist() == ids[128 * k:128 * (k + 1)]


def test_blocks_use_exceptions():
    ids = np.full(128, 3)
    ids[::16] = 1 << 20
    _, index, _ = token_file._parts(token_file.pack(ids))
    assert index["width"][0] == 0 and index["exceptions"][0] == 8


def test_token_files_in_id_order(spark):
    rows = [(9, "last one"), (2, None), (5, ""), (5, "again here"), (None, "no id"), (7, "word " * 60000)]
    path = scratch_path(spark, "test-tokens")
    token_file.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, lambda: library_encoder(BYTES, "bytelevel"))
    got = {r.start: r for r in token_file.read_token_files(spark, path).collect()}
    library, start = Tokenizer.from_file(BYTES), 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[start]
        assert (r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc_id, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    empty = scratch_path(spark, "test-tokens")
    token_file.write_token_files(spark.createDataFrame([], "doc_id long, text string"), empty, lambda: library_encoder(BYTES, "bytelevel"))
    assert token_file.read_token_files(spark, empty).count() == 0


def check_packing(pieces, rows, capacity):
    library = Tokenizer.from_file(WORDS)
    want = sorted((str(i), k, at, hashlib.md5(ids[at:at + capacity].tobytes()).hexdigest())
                  for i, t in rows for ids in [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")]
                  for k, at in enumerate(range(0, len(ids), capacity)))
    assert sorted((str(r.doc_id), r.piece, r.start) for r in pieces) == [w[:3] for w in want]
    by_bin = {}
    for r in pieces:
        by_bin.setdefault(r.sequence_id, []).append(r)
    for members in by_bin.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin), -(-sum(r.length for r in pieces) // capacity)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(k, "word " * rng.randint(0, 60)) for k in range(600)] + [(None, None), (3, ""), (3, ""), (900, "word " * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(10)
    pieces = packing.pack_documents(docs, lambda: library_encoder(WORDS, "words"), capacity=64).collect()
    bins, least = check_packing(pieces, rows, 64)
    assert bins <= least + 10  # at most one sequence for each partition that packed by itself
    assert packing.pack_documents(docs.limit(0), lambda: library_encoder(WORDS, "words")).count() == 0


def test_packing_of_items_that_never_fill_a_bin(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_ITEMS", 50)
    monkeypatch.setattr(packing, "HANDED_ON", 10)
    rows = [(k, "word " * 39) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)
    bins, _ = check_packing(packing.pack_documents(docs, lambda: library_encoder(WORDS, "words"), capacity=64).collect(), rows, 64)
    assert bins == 300


@pytest.mark.parametrize("parts", [1, 3])
def test_packing_of_more_bins_than_a_task_hands_on(spark, monkeypatch, parts):
    monkeypatch.setattr(packing, "WINDOW_ITEMS", 50)
    monkeypatch.setattr(packing, "HANDED_ON", 10)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = [(k, "word " * (39 if k < 150 else 22)) for k in range(300)]  # 40 and 23 ids
        docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1) if parts == 1 else spark.createDataFrame(
            rows, "doc_id long, text string").repartitionByRange(parts, "doc_id")
        bins, _ = check_packing(packing.pack_documents(docs, lambda: library_encoder(WORDS, "words"), capacity=64).collect(), rows, 64)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert bins == 150


def test_best_fit_of_counts():
    rng = np.random.default_rng(2)
    for capacity in (1, 7, 64, 100):
        for n in (1, 40, 400):
            loads = rng.integers(1, capacity + 1, n)
            lengths, counts = np.unique(loads, return_counts=True)
            runs, bins = packing.best_fit_counts(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), capacity)
            places = sorted((b + (k - first) // each, place + (k - first) % each * load, load)
                            for load, first, last, b, each, place in runs for k in range(first, last + 1))
            sums = [0] * bins
            for b, place, load in places:
                assert place == sums[b]
                sums[b] += load
            assert sorted(p[2] for p in places) == sorted(loads.tolist())
            assert sorted(sums) == sorted(np.bincount(packing.best_fit(loads, capacity), weights=loads).astype(int).tolist())


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins[0] == bins[2] and bins[1] == bins[3] == bins[4]
