"""Code points whose class differs between Unicode versions, against the tokenizer library itself."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkclean.llm import bpe, packing, shingles, token_counts


def test_newer_code_points_count_as_the_library_counts_them():
    points = [c for a, b in bpe.NEWER for c in {a, b, (a + b) // 2, a - 1, b + 1}] + [*range(0x370, 0x590), *range(0x1C80, 0x1C90), *range(0xA7C0, 0xA7F8)]
    texts = [t for c in map(chr, points) for t in (f"out{c}x", f" --{c}1{c}{c} the{c}", f"outheast{c}")]
    texts += ["outheast֌", " -------\U00018f6c"]
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert token_counts.WordCounter(public_tokenizers.path("word_bpe_49k.json"))(texts) == [len(e.ids) for e in words.encode_batch(texts, add_special_tokens=False)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for encode in (bpe.ByteBpe(path).encode, packing.LibraryIds(path).encode):
        assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == ids


def test_words_of_one_structure_have_different_hashes():
    """The Thue-Morse words collide under any polynomial modulo 2^64."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    for n in (64, 1024):
        one, other = (bytes(97 + (b ^ k) for b in bits[:n]) for k in (0, 1))
        for seed in (0, 1):
            data = np.frombuffer(one + b" " + other + b" " + one.upper(), np.uint8)
            found, counts = shingles.word_hashes(data, np.array([0, len(data)]), seed)
            assert counts.tolist() == [3] and found[0] != found[1] and found[0] == found[2]
    text = b"a b c d a b c e"
    data = np.frombuffer(text, np.uint8)
    sets = [set(shingles.shingle_sets(data, np.array([0, len(data)]), 3, seed)[0].tolist()) for seed in (0, 1)]
    assert len(sets[0]) == len(sets[1]) == 5 and not sets[0] & sets[1]
