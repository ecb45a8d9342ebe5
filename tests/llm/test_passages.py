"""Recurring passages against a brute-force count of all windows."""

import random
from collections import Counter

import pytest

from sightline.llm.passages import repeated_passages


def plain(texts, window):
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, copy = say(60), say(150)
    texts = [f"{say(draw.randint(0, 80))} {passage}  {say(draw.randint(0, 40))}" for _ in range(40)]
    texts += [copy] * 5 + [copy.replace("w7", "other", 1), "same " * 300, "same " * 34, "same " * 35, None, "", " \n", "word", say(3000)]
    long = say(400).split()
    return texts + [" ".join(long), " ".join(long[:200] + ["new"] + long[200:]), " ".join(long[:34]), " ".join(long[:35])]


@pytest.mark.parametrize("seed,limits", [(1, {}), (2, {"stretches_per_key": 3, "shard_words": 40}), (3, {"window": 9, "group": 4, "shard_words": 300})])
def test_every_window(spark, seed, limits):
    texts = corpus(seed)
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.uri: (r.n_words, r.n_removed, r.content) for r in repeated_passages(spark.createDataFrame(rows, "uri int, content string, hits string"), **limits).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, limits.get("window", 35))


def test_repeated_and_nameless_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (None, "lone words"), (None, None)]
    got = sorted([(r.uri, r.n_words, r.n_removed, r.spans) for r in repeated_passages(spark.createDataFrame(rows, "uri int, content string")).collect()], key=str)
    assert got == sorted([(1, 50, 50, [(0, 50)]), (1, 50, 50, [(0, 50)]), (None, 2, 0, []), (None, 0, 0, [])], key=str)


def test_nothing(spark):
    assert repeated_passages(spark.createDataFrame([], "uri int, content string")).count() == 0
