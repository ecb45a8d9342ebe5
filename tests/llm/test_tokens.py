"""Token ids, files, counts and packing against the tokenizers library on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sightline.llm import packing
from sightline.llm import words as words_module
from sightline.llm.packing import best_fit, configuration_plan, packed_sequences
from sightline.llm.token_counts import LEAF_WORDS, PreTokenTree, edit_trees, plant_trees, redactions
from sightline.llm.token_files import EMPTY_FRAME, TokenFile, token_documents, write_token_files
from sightline.llm.words import WordEncoder, word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
TEXTS = ["Hello, World!", None, "", " \t\n", "don't STOP now é é H̱ İ ǅ", "<|endoftext|> a<|startoftext|>b", "\x00 a\x00b \x00", "日本語 テキスト 🙂🙂", "x" * 5000 + " tail",
         "12345 6.7e8 a_b-c", "same", "same", "word " * 9000, "\x1c\x1d\x85 end"]


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_words_equal_whole_text(text):
    assert np.frombuffer(word_encoder(PATH).ids(None if text is None else text.encode()), "<u4").tolist() == ids(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=12).map(lambda parts: random.Random(len(parts)).choice([" ", "\n", "\x0b"]).join(parts)))
def test_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(word_encoder(PATH).ids(text.encode()), "<u4").tolist() == ids(text)


def test_a_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(words_module, "WORDS_KEPT", 8)
    encoder = WordEncoder(PATH)
    text = " ".join(f"word{i % 37}" for i in range(500))
    assert np.frombuffer(encoder.ids(text.encode()), "<u4").tolist() == ids(text)


def frame(spark, texts):
    return spark.createDataFrame([(i * 3, t, "x", 1) for i, t in enumerate(texts)], "uri bigint, content string, ids string, length int").repartition(4)


def test_files_round_trip(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "files")
    write_token_files(frame(spark, TEXTS), path, PATH)
    got = {r.uri: (r.start, r.n_tokens, r.ids_crc32) for r in token_documents(spark, path).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        data = np.array([*ids(text), 1], dtype="<u4").tobytes()
        assert got[i * 3] == (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    assert len(got) == len(TEXTS)


def test_file_is_checked_and_read_by_frames(monkeypatch):
    import zstandard
    from sightline.llm import token_files

    monkeypatch.setattr(token_files, "FRAME_BYTES", 40)
    writer = token_files.FileWriter(2, 5)
    documents = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 9, 200, 1, 4)]
    for d in documents:
        writer.add(d)
    content = writer.content() + EMPTY_FRAME.encode("latin-1")
    held = TokenFile(content)
    assert (held.number, held.partition) == (5, 2) and [held.ids(i) for i in (5, 0, 3, 1, 2, 4)] == [documents[i] for i in (5, 0, 3, 1, 2, 4)]
    assert zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read() == b"".join(documents)
    broken = bytearray(content)
    broken[2] ^= 1
    with pytest.raises(ValueError):
        TokenFile(bytes(broken)).ids(0)
    assert TokenFile(bytes(broken)).ids(5) == documents[5]


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (1, None)]
    path = str(tmp_path / "files")
    write_token_files(spark.createDataFrame(rows, "uri int, content string"), path, PATH)
    got = sorted([(r.start, r.uri, r.n_tokens) for r in token_documents(spark, path).collect()])
    assert got[0] == (0, None, 2) and sorted(r[1:] for r in got[1:]) == [(1, 1), (1, 3), (1, 3)]
    packed = packed_sequences(spark.createDataFrame(rows, "uri int, content string"), PATH).collect()
    assert len(packed) == 4 and len({(r.sequence_id, r.offset) for r in packed}) == 4
    none = spark.createDataFrame([], "uri int, content string")
    write_token_files(none, path + "2", PATH)
    assert token_documents(spark, path + "2").count() == 0 and packed_sequences(none, PATH).count() == 0


def test_packing(spark):
    capacity = 64
    texts = TEXTS + ["word " * n for n in range(1, 200)]
    got = sorted(packed_sequences(frame(spark, texts), PATH, capacity).collect())
    want = []
    for i, text in enumerate(texts):
        data = np.array([*ids(text), 1], dtype="<u4")
        want += [(i * 3, n, at, min(capacity, len(data) - at), zlib.crc32(data[at:at + capacity].tobytes())) for n, at in enumerate(range(0, len(data), capacity))]
    assert [tuple(r[:5]) for r in got] == want
    reach = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == reach[r.sequence_id]
        reach[r.sequence_id] += r.length
    assert max(reach.values()) <= capacity
    assert len(reach) <= -(-sum(reach.values()) // capacity) + 1


@pytest.mark.parametrize("histogram,fewest", [({}, 0), ({4096: 7}, 7), ({1: 1}, 1), ({2048: 10}, 5), ({1365: 9, 1366: 1}, 4), ({1000: 100, 1096: 100, 2000: 100}, 100)])
def test_plan(histogram, fewest):
    plan = configuration_plan(histogram)
    assert fewest <= plan.sequences <= fewest + (fewest > 10)  # rounding may cost one sequence
    held = Counter()
    for config, times in plan.configs:
        assert sum(n * k for n, k in config.items()) <= 4096
        for n, k in config.items():
            held[n] += k * times
    assert held == Counter(histogram)


@pytest.mark.parametrize("histogram", [{1000: 100, 1096: 100, 2000: 100}, {57: 3000, 100: 4000}, {n: 30 for n in range(5, 3000, 7)}])
def test_plan_comes_from_the_program(histogram, monkeypatch):
    completed = []
    monkeypatch.setattr(packing, "best_fit", lambda lengths, left, capacity, opened=(): completed.append((int(left.sum()), list(opened))) or best_fit(lengths, left, capacity, opened))
    plan = configuration_plan(histogram)
    assert len(completed) == len(packing.RATES)
    for left, opened in completed:
        assert left + sum(times * sum(config.values()) for config, times in opened) == sum(histogram.values())
        assert left < sum(histogram.values()) / 2
    least = -(-sum(n * k for n, k in histogram.items()) // 4096)
    assert least <= plan.sequences <= least * 1.01 + 1


@pytest.mark.parametrize("seed", range(40))
def test_edits_count_like_a_full_encoding(seed):
    draw = random.Random(seed)
    encoder = word_encoder(PATH)
    say = lambda n: "".join(draw.choice(["ab", "c", " ", "\n", "é", ",", "don't", "  "]) for _ in range(n))
    text = say(draw.choice([0, 1, 5, 400]))
    tree = PreTokenTree.planted(text, encoder)
    assert tree.text == text
    for _ in range(30):
        start, length, new = draw.randint(0, len(text) + 2), draw.choice([0, 0, 1, 3, 80]), say(draw.choice([0, 1, 2, 40]))
        tree.replace(start, length, new, encoder)
        start = min(start, len(text))
        text = text[:start] + new + text[start + length:]
        assert (tree.text, tree.total) == (text, len(ids(text)))


def test_edits_touch_little():
    encoder = word_encoder(PATH)
    tree = PreTokenTree.planted("some words " * 5000, encoder)
    tree.replace(30_000, 3, "other", encoder)
    assert tree.total == len(ids(tree.text)) and tree.encoded <= 32


def test_edit_tables(spark):
    pages = spark.createDataFrame([(1, "call 555-123-4567 or write a.b@c.org now", "x"), (2, None, "x"), (3, "plain", "x"), (None, "12345678", "x"), (1, "short", "x")],
                                  "uri int, content string, tree string")
    edits = spark.createDataFrame([(1, 0, 5, 12, "[n]"), (2, 5, 0, 9, "new text"), (7, 0, 0, 1, "gone"), (None, 0, 0, 1, "gone"), (1, 1, None, None, None)],
                                  "uri int, edit_ix int, start int, length int, replacement string")
    got = sorted([(str(r.uri), r.content, r.n_edits, r.n_tokens_before, r.n_tokens) for r in edit_trees(plant_trees(pages, PATH), edits, PATH).collect()])
    want = [(1, "call 555-123-4567 or write a.b@c.org now", "call [n] or write a.b@c.org now", 2), (1, "short", "short[n]", 2), (2, "", "new text", 1), (3, "plain", "plain", 0),
            (None, "12345678", "12345678", 0)]
    assert got == sorted((str(u), new, n, len(ids(old)), len(ids(new))) for u, old, new, n in want)
    masked = edit_trees(plant_trees(pages, PATH), redactions(pages), PATH).where("content LIKE 'call%'").first()
    assert masked.content == "call [number] or write [address] now"
    none = pages.limit(0)
    assert edit_trees(plant_trees(none, PATH), redactions(none), PATH).count() == 0


def random_edit(draw, text):
    words = ["fox", "don't", " ", "\n", "a b c", "x" * 40, "é", "", "one two three four five six " * 12, "12-34"]
    start = draw.choice([draw.randint(0, len(text) + 2), 0, len(text), max(0, text.find(" "))])
    return start, draw.choice([0, 0, 1, 2, 7, 30, len(text)]), draw.choice(words)


def test_trees_survive_many_edits():
    whole, encoder = Tokenizer.from_file(PATH), word_encoder(PATH)
    draw = random.Random(8)
    for _ in range(300):
        text = " ".join(draw.choice(["the", "fox", "isn't", "x1", "long-ish", "größer"]) for _ in range(draw.randint(0, 90)))
        form = PreTokenTree.planted(text, encoder).stored_form()
        for _ in range(4):
            tree = PreTokenTree.stored(text, form)
            for _ in range(draw.randint(1, 3)):
                start, length, words = random_edit(draw, text)
                tree.replace(start, length, words, encoder)
                start = min(start, len(text))
                text = text[:start] + words + text[start + length:]
            form = tree.stored_form()
            assert tree.text == text and tree.total == len(whole.encode(text, add_special_tokens=False).ids)
            assert max(len(leaf.split()) for leaf in tree.leaves) <= LEAF_WORDS


def test_edited_tables_are_edited_again(spark):
    whole, draw = Tokenizer.from_file(PATH), random.Random(3)
    texts = {i: " ".join(draw.choice(["red", "green", "it's", "42"]) for _ in range(draw.choice([0, 5, 60, 400]))) for i in range(30)} | {30: None, 31: "", 32: "many words " * 20000}
    trees = plant_trees(spark.createDataFrame(list(texts.items()), "uri int, content string"), PATH)
    texts = {i: t or "" for i, t in texts.items()}
    for _ in range(3):
        edits = []
        for i in texts:
            for n in range(draw.randint(0, 3)):
                start, length, words = random_edit(draw, texts[i])
                edits.append((i, n, start, length, words, "clash"))
                start = min(start, len(texts[i]))
                texts[i] = texts[i][:start] + words + texts[i][start + length:]
        trees = edit_trees(trees, spark.createDataFrame(edits, "uri int, edit_ix int, start int, length int, replacement string, tree string"), PATH)
        assert {r.uri: (r.content, r.n_tokens) for r in trees.collect()} == {i: (t, len(whole.encode(t, add_special_tokens=False).ids)) for i, t in texts.items()}
