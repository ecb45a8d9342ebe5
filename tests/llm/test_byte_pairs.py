"""Pair encoding against the whole library, and its parts against plain merging."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm import byte_pairs
from sightline.llm.byte_pairs import NEVER, decode_content, encode_content, pair_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "s", "t", "re", "ll", "'", "'s", "'ll", "'re", "'S", "ve", "d", " ", "  ", "\n", "\t", " ", "　", "\x1c", "\x85", "​", "1", "²", "½", "_", "-",
         "<|endoftext|>", "<|", "é", "ü", "\U0001f600", "한", "́", "A", "\U000105c0", "the ", " and", "ing", "tion", "unhappiness", "zqxjk"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(held, texts):
    ids, counts = held.encoded([t.encode() for t in texts])
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_mixtures(library):
    draw = random.Random(11)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(6000)]
    assert ids_of(pair_vocabulary(PATH), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pairs_that_stand(library):
    """A pair of neighbours passes exactly if plain merging of its letters gives the pair back."""
    held = pair_vocabulary(PATH)
    draw = random.Random(5)
    tokens = [t for t in range(50256) if held.spelling[t].isalpha()]
    a, b = (np.array([draw.choice(tokens) for _ in range(4000)]) for _ in range(2))
    stands = held.first_meeting(a, b) == NEVER
    for x, y, fine in zip(a.tolist(), b.tolist(), stands.tolist()):
        assert fine == (held._merge([held.names[bytes([c])] for c in held.spelling[x] + held.spelling[y]]) == [x, y])


def test_only_failing_words_are_merged():
    held = pair_vocabulary(PATH)
    words = [b"the", b" and", b"unhappiness", b"zqxjkwvbn", b"ststst", b"thereof"]
    bounds = np.r_[0, np.cumsum([len(w) for w in words])]
    whose, tokens = held.proposed(np.frombuffer(b"".join(words), dtype=np.uint8), bounds)
    greedy = {i: tokens[whose == i].tolist() for i in range(len(words))}
    wrong = [i for i, w in enumerate(words) if held._merge([held.names[bytes([c])] for c in w]) != greedy[i]]
    assert held.failing(whose, tokens).tolist() == wrong


def test_portions_and_long_words(library, monkeypatch):
    draw = random.Random(2)
    texts = ["a" * 70000, "".join(draw.choice("abcdeé") for _ in range(20000)), " " * 500 + "x", "word " * 5000 + "<|endoftext|>" * 3, "it's we'll " * 900]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for at_once, long in ((64, 16), (1000, 3), (1 << 22, 256)):
        monkeypatch.setattr(byte_pairs, "BYTES_AT_ONCE", at_once)
        monkeypatch.setattr(byte_pairs, "LONG_WORD", long)
        assert ids_of(pair_vocabulary(PATH), texts) == want


def test_tables(spark, library):
    texts = ["The quick brown fox", "The quick brown fox", None, "", " \n ", "été <|endoftext|> it's", "very long " * 30000]
    rows = [(i // 2 if i < 6 else None, t, "clash", 7) for i, t in enumerate(texts)]
    content = spark.createDataFrame(rows, "uri int, content string, ids string, n_tokens int")
    encoded = encode_content(content, PATH)
    assert encoded.columns == ["uri", "n_tokens", "ids"]
    got = decode_content(encoded.withColumn("content", encoded.uri), PATH).collect()
    want = [(u, t or "", library.encode(t or "", add_special_tokens=False).ids) for u, t, _, _ in rows]
    assert sorted((str(r.uri), r.content, r.ids) for r in got) == sorted((str(u), t, ids) for u, t, ids in want)
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert encode_content(content.limit(0), PATH).collect() == [] and decode_content(encoded.limit(0), PATH).collect() == []


def test_decoding_of_anything(spark, library):
    lists = [None, [], [50256], [123456, -4, None, 464], [220, 39611, 10545], [187, 250, 100]]
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(lists)], "uri int, n_tokens bigint, ids array<int>")
    got = {r.uri: r.content for r in decode_content(rows, PATH).collect()}
    known = lambda x: [i for i in x or [] if i is not None and 0 <= i <= 50256]
    assert got == {i: library.decode(known(x), skip_special_tokens=False) for i, x in enumerate(lists)}
