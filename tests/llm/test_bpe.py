"""The transducer against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import clashing, documents, odd_texts
from quotalens.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def random_text(seed, alphabet, n):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


TEXTS = [
    "", " ", "a" * 5000, "ab" * 3000, "  \n\n x  ", "<|endoftext|>hi <|endoftext|>  ", "it's 12a²½ Ⅷx\x1c\x1cy \x85z _a_", " " * 100_000 + "x", "-" * 70_000,
    random_text(1, "abcdefghij", 20_000), random_text(2, [" ", "\n", "a", "\U0001F600", "́", "١", "'", "s"], 30_000), "é" * 999 + " 漢字" * 50,
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_equals_the_library(vocabulary, library, k):
    ids = library.encode(TEXTS[k], add_special_tokens=False).ids
    packed = bpe.Encoder(vocabulary).encode(TEXTS[k])
    assert list(memoryview(packed).cast("I")) == ids
    assert bpe.Decoder(vocabulary).decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_decoder_cuts_characters_anywhere(vocabulary, library):
    rng = random.Random(3)
    for _ in range(20):
        ids = [rng.randrange(50257) for _ in range(200)]
        packed = memoryview(bytearray(800)).cast("I")
        packed[:] = memoryview(__import__("array").array("I", ids))
        assert bpe.Decoder(vocabulary).decode(bytes(packed)) == library.decode(ids, skip_special_tokens=False)


def test_lookahead_is_sufficient(vocabulary):
    """Tokens that end ``reach`` bytes before the end of a text stay whatever follows."""
    e, rng = bpe.Encoder(vocabulary), random.Random(4)
    for seed in range(20):
        head = random_text(seed, rng.choice(["ab", "-=", "aeiou", "0", "xyz "]), 900).encode().replace(b" ", b"")
        ends = []
        for tail in (b"", b"ab" * 50, b"----", bytes(rng.choice(b"abxyz-=") for _ in range(60))):
            ids, at, stop = e.merged([vocabulary.single[b] for b in head + tail]), 0, []
            for i in ids:
                at += len(vocabulary.pieces[i])
                if at <= len(head) - vocabulary.reach:
                    stop.append((i, at))
            ends.append(stop)
        assert all(x == ends[0] for x in ends)


def test_chains_of_merges():
    assert bpe.lookahead([]) == 0
    assert bpe.lookahead([(b"a", b"b")]) == 1
    assert bpe.lookahead([(b"b", b"c"), (b"a", b"b"), (b"x", b"ab")]) == 3  # c undoes ab, which undoes xab


def test_operator(spark, vocabulary, library):
    rows = odd_texts()
    out = bpe.transcode(clashing(documents(spark, rows)), PATH, keep=["doc_id", "text", "node"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(memoryview(bytes(r.ids)).cast("I")) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "") and r.n_tokens == len(r.ids) // 4 and r.node == "x"
    assert bpe.transcode(documents(spark, []), PATH).count() == 0
