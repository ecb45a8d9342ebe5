"""Periodic runs against a brute-force search of all periods."""

import random

import numpy as np
import pytest

from sightline.llm import periodic
from sightline.llm.periodic import Extensions, SuffixTree, found_runs, periodic_runs


def plain_runs(words):
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and all(words[i:i + length - d] != words[i + d:i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(draw):
    words = [draw.randrange(draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(0, 60))]
    if draw.random() < 0.6:
        root = [draw.randrange(4) for _ in range(draw.randint(1, 9))]
        words = words[:20] + root * draw.randint(2, 8) + words[20:30] + root[:2] * draw.randint(0, 5) + root[:draw.randint(0, 3)]
    return words


@pytest.mark.parametrize("tree_words", [10, 100, 1 << 16])
def test_every_run(monkeypatch, tree_words):
    monkeypatch.setattr(periodic, "TREE_WORDS", tree_words)
    draw = random.Random(tree_words)
    for _ in range(60):
        texts = [some_words(draw) for _ in range(draw.randint(1, 12))]
        bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        got = found_runs(np.array([w for t in texts for w in t], dtype=np.int64), bounds)
        assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(t) for t in texts]


def test_common_extensions():
    draw = random.Random(4)
    text = [draw.randrange(3) for _ in range(300)] + [-1] + [draw.randrange(2) for _ in range(100)] + [-2]
    tree = SuffixTree(text)
    leaves, heights = tree.tour()
    assert leaves.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    a, b = (np.array([draw.randrange(len(text)) for _ in range(3000)]) for _ in range(2))
    a, b = a[a != b], b[a != b]
    plain = lambda i, j: next(k for k in range(len(text)) if text[i + k] != text[j + k])
    assert Extensions(leaves, heights).common(a, b).tolist() == [plain(i, j) for i, j in zip(a.tolist(), b.tolist())]


def test_tables(spark):
    texts = ["a b c " * 5 + "d", "a b c " * 5 + "d", None, "", " \t\n", "x " * 6, "x " * 5, "home news\x0bhome news home\x0cnews home news home", "one two " * 7,
             " ".join(f"w{i % 700}" for i in range(30000)), "no run at all"]
    rows = [(None if i == 10 else i // 2, t, [1], "clash") for i, t in enumerate(texts)]
    content = spark.createDataFrame(rows, "uri int, content string, runs array<int>, n_words string")
    got = sorted((str(r.uri), r.n_words, [tuple(x) for x in r.runs], r.content) for r in periodic_runs(content).collect())
    want = []
    for u, t, _, _ in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = [(0, 30000, 700)] if len(words) == 30000 else plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((str(u), len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert got == sorted(want)
    assert periodic_runs(content.limit(0)).collect() == []
