"""Encoding, counting and packing against the tokenizer library."""

import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkclean.llm import bpe, packing, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "\n", " \n", "\t", "\x1c", "\x85", "\xa0", "é", "1", "22", "'s", "'re", "!", "<|endoftext|>", "<|startoftext|>",
         "中", "​", "😀", "the", "ing", "\r\n", "Σ", "İ", "é", "́", "aaaaaaa"]
mixed = st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=20)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def byte_bpe():
    return bpe.ByteBpe(BYTE)


def ids(library, path, text):
    return library[path].encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(text=mixed)
def test_ids_and_round_trip(text, library, byte_bpe):
    expected = ids(library, BYTE, text)
    found = byte_bpe.encode(text)
    assert np.frombuffer(found, "<u4").tolist() == expected
    assert byte_bpe.decode([found, b""]) == [library[BYTE].decode(expected, skip_special_tokens=False), ""]


def test_every_kind_of_character(library, byte_bpe):
    texts = [f"a{c}b {c} x1{c}{c}2 " for k in range(0, 0x11000, 3) if not 0xD800 <= k < 0xE000 for c in [chr(k)]]
    counter = token_counts.WordCounter(WORD)
    assert all(np.frombuffer(byte_bpe.encode(t), "<u4").tolist() == ids(library, BYTE, t) for t in texts)
    assert counter(texts) == [len(ids(library, WORD, t)) for t in texts]


def test_a_full_cache_changes_nothing(library, byte_bpe):
    small = bpe.WordSplit(byte_bpe._whole, limit=2)
    text = "one two three four five two one six."
    assert small(text) == byte_bpe.encode(text) and len(small.words) == 2


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(mixed, max_size=6))
def test_counts(texts, library):
    counter = _counter()
    assert counter(texts) == [len(ids(library, WORD, t)) for t in texts]


_made = []


def _counter():
    if not _made:
        _made.append(token_counts.WordCounter(WORD))
    return _made[0]


def test_counts_beyond_what_is_kept(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KEPT", 3)
    counter = token_counts.WordCounter(WORD)
    texts = ["alpha beta", "gamma delta epsilon zeta alpha", "eta theta"]
    assert [counter([t])[0] for t in texts] == [len(ids(library, WORD, t)) for t in texts]


def test_long_words(library):
    random.seed(5)
    words = ["".join(random.choices("abcdefgh", k=3000)), "a" * 5000, "ab" * 2500]
    assert _counter()(words) == [len(ids(library, WORD, w)) for w in words]
    own = packing.LibraryIds(BYTE)
    assert [np.frombuffer(own.encode(w), "<u4").tolist() for w in words] == [ids(library, BYTE, w) for w in words]


@settings(max_examples=200, deadline=None)
@given(text=mixed)
def test_library_ids(text, library):
    assert np.frombuffer(packing._ids(BYTE).encode(text), "<u4").tolist() == ids(library, BYTE, text)


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 50), max_size=60), open_bins=st.integers(1, 5))
def test_best_fit_against_a_plain_search(sizes, open_bins):
    packer, bins, full = packing.BestFit(50, open_bins), [], 0
    for size in sizes:
        number, offset = packer.place(size)
        fitting = [b for b in bins if b[0] >= size]
        if fitting:
            target = min(fitting, key=lambda b: (b[0], b[2]))
        else:
            if len(bins) >= open_bins:
                least = min(b[0] for b in bins)
                bins.remove(next(b for b in sorted(bins, key=lambda b: b[2]) if b[0] == least))
            target = [50, full, 0]
            full += 1
            bins.append(target)
        assert (number, offset) == (target[1], 50 - target[0])
        target[0] -= size
        target[2] = max([b[2] for b in bins]) + 1  # the order in which bins got their space
        bins = [b for b in bins if b[0]]


def test_cut_points():
    assert packing.cut_points(1024, 1024) == [(0, 1024)]
    assert packing.cut_points(1025, 1024) == [(0, 1), (1, 1024)]
    assert packing.cut_points(3000, 1024) == [(0, 952), (952, 1024), (1976, 1024)]


def test_tables(spark, odd_documents, library):
    rows = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    encoded = bpe.encode_texts(odd_documents, BYTE)
    decoded = bpe.decode_ids(encoded, BYTE).collect()
    expected = sorted((str(k), np.array(ids(library, BYTE, t), "<u4").tobytes(), t) for k, t in rows)
    assert sorted((str(r.doc_id), bytes(r.ids), r.text) for r in decoded) == expected
    counts = token_counts.count_tokens(odd_documents, WORD, limit=100).collect()
    plain = sorted((str(k), len(t.encode()), n := len(ids(library, WORD, t)), n > 100) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in counts) == plain
    none = spark.createDataFrame([], odd_documents.schema)
    assert bpe.encode_texts(none, BYTE).count() == token_counts.count_tokens(none, WORD).count() == packing.pack_documents(none, BYTE).count() == 0


def test_packed_documents(odd_documents, library):
    rows = packing.pack_documents(odd_documents, BYTE, capacity=64).collect()
    texts = {(r.doc_id, r.text or "") for r in odd_documents.collect()}
    want = sorted(sha256(str(k).encode() + np.array(ids(library, BYTE, t) + [2], "<u4").tobytes()).hexdigest() for k, t in texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 64
    for spots in by_sequence.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    got = set()
    for key, pieces in by_doc.items():
        for start in [p for p in pieces if p.piece == 0]:
            whole = [start] + sorted({(p.piece, p.start, bytes(p.ids)) for p in pieces if p.piece > 0 and len(pieces) > 1})
            joined = bytes(start.ids) + b"".join(x[2] for x in whole[1:])
            got.add(sha256(str(key).encode() + joined).hexdigest())
    assert set(want) == got
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 64) + 8
    assert all(isinstance(zlib.crc32(r.ids), int) for r in rows[:3])


def test_a_word_is_kept_once_and_a_decoder_has_no_merges():
    model = bpe.ByteBpe(BYTE)
    ids = model.encode("the first words don't stand here 12 times")
    assert {"words", "stand", "here"} <= set(model.encode.words) and " words" not in model.parts
    decoder = bpe.Vocabulary(BYTE)
    assert decoder.decode([ids]) == model.decode([ids]) == ["the first words don't stand here 12 times"]
    assert not hasattr(decoder, "merges") and not hasattr(decoder, "parts")
