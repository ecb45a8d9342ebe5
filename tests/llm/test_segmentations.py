"""Sampled segmentations against all segmentations of short texts."""

from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from sightline.llm import segmentations
from sightline.llm.segmentations import LatticeStore, Words, decode_pieces, piece_model, sample_segmentations, sampled_paths, piece_ids

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = piece_model(PATH)


def every(unit):
    """All segmentations of a word with their log-weights."""
    held = MODEL.processor
    known = {MODEL.processor.id_to_piece(i): i for i in range(259, held.get_piece_size())}
    out = [((), 0.0)] if not unit else []
    for n in range(1, len(unit) + 1):
        head = unit[:n]
        if head in known:
            ids, weight = (known[head],), MODEL.weights[known[head]]
        elif n == 1:
            ids = tuple(int(MODEL.byte_ids[b]) for b in head.encode())
            weight = MODEL.weights[ids[0]] * len(ids)
        else:
            continue
        out += [(ids + more, weight + w) for more, w in every(unit[n:])]
    return out


def whole(text):
    units = [every(u) for u in MODEL.units(text)]
    out = {tuple(i for part, _ in choice for i in part): sum(w for _, w in choice) for choice in product(*units)}
    total = np.logaddexp.reduce(list(out.values()))
    return {ids: w - total for ids, w in out.items()}


def drawn(text, copies, samples, offset=0):
    keys = np.arange(offset, offset + copies, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lattices = LatticeStore(MODEL)
    lattices.add([MODEL.units("other words come first")[0], "▁the"])
    found, following = sampled_paths(Words.of([MODEL.units(text)] * copies), keys, lattices, samples)
    out = [[] for _ in range(copies)]
    for paths in found:
        ids, counts = piece_ids(lattices, paths, MODEL)
        for row, part, log_prob, value in zip(paths.texts, np.split(ids, np.cumsum(counts)[:-1]), paths.log_chance, paths.value):
            out[row].append((tuple(part.tolist()), log_prob, value))
    return out, following


@pytest.mark.parametrize("text", ["the cat", "a\nb", "été 🙂", "ab", "  x"])
def test_all_segmentations_in_falling_order(text):
    want = whole(text)
    (got, *_), following = drawn(text, 1, len(want) + 5)
    assert len(got) == len(want) and following[0] == -np.inf
    assert {ids: pytest.approx(p, abs=1e-6) for ids, p, _ in got} == want
    values = [v for _, _, v in got]
    assert values == sorted(values, reverse=True)


def test_draws_follow_the_weights():
    text, copies = "of the", 6000
    want = whole(text)
    got, _ = drawn(text, copies, 2, 99)
    first = Counter(s[0][0] for s in got)
    second = Counter(s[1][0] for s in got)
    assert all(len({x[0] for x in s}) == 2 for s in got)
    expected = Counter()
    for a, p in want.items():
        for b, q in want.items():
            if a != b:
                expected[b] += np.exp(p) * np.exp(q) / (1 - np.exp(p))
    for ids, p in want.items():
        assert abs(first[ids] / copies - np.exp(p)) < 4 * np.sqrt(np.exp(p) / copies) + 1e-3
        assert abs(second[ids] / copies - expected[ids]) < 4 * np.sqrt(expected[ids] / copies) + 1e-3


def test_a_full_store_changes_nothing(monkeypatch):
    texts = [f"words {i} and the others {i * 7}" for i in range(30)]
    keys = np.arange(30, dtype=np.uint64)
    whole = [p.edges.size for p in sampled_paths(Words.of([MODEL.units(t) for t in texts]), keys, LatticeStore(MODEL), 2)[0]]
    monkeypatch.setattr(segmentations, "EDGES_KEPT", 10)
    store, parts = LatticeStore(MODEL), []
    for t, k in zip(texts, keys):
        parts.append([p.edges.size for p in sampled_paths(Words.of([MODEL.units(t)]), np.array([k]), store, 2)[0]])
    assert whole == [sum(p[i] for p in parts) for i in range(2)]


@pytest.mark.parametrize("texts", [["a b  c", "", "\n\n x\n", " ", "▁ odd ▁▁", "tab\there\x0b", "🙂 é"], ["with a mark \x01 in it", "plain"], [""]])
def test_columns_cut_like_the_pattern(texts):
    got = MODEL.columns(pa.array(texts, pa.string()))
    words = [got.different[i] for i in got.place]
    assert words == [u for t in texts for u in MODEL.units(t)] and got.sizes.tolist() == [len(MODEL.units(t)) for t in texts]


def test_table(spark):
    texts = ["hello wide world, this is a text", None, "", " leading  and\ttabs\n\n", "数据 🙂 naïve", "same", "same", "long " * 5000]
    rows = [(i if i != 6 else None, t, "x", 1) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "uri int, content string, ids string, sample int")
    got = sample_segmentations(frame, PATH, samples=3).cache()
    again = sample_segmentations(frame.repartition(5), PATH, samples=3)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    per = Counter(r.uri for r in got.collect())
    assert per[0] == 3 and per[1] == per[2] == 1 and 1 <= per[5] <= 3
    assert len({(r.uri, tuple(r.ids)) for r in got.collect()}) == got.count()
    assert all(r.log_prob <= 0 and 0 <= r.inclusion <= 1 for r in got.collect())
    spelled = {(r.uri, r.sample): r.content for r in decode_pieces(got, PATH).collect()}
    source = {u: t or "" for u, t, _, _ in rows}
    assert all(text == source[uri] for (uri, _), text in spelled.items())
    assert sample_segmentations(frame.limit(0), PATH).count() == 0
