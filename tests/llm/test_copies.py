"""Exact copies and near copies of fetched content, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from sightline.llm.digests import byte_copies
from sightline.llm.fingerprints import fingerprint_groups, near_copies, text_fingerprint

CONTENT = "uri bigint, content string, kept string, sha256 string"
TEXTS = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (2, " "), (None, "a b"), (7, "a b\n"), (7, "a b\n"), (4, "A b"), (1, "x" * 300_000), (6, "x" * 300_000)]


def plain_group(ids, linked):
    group = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(group[a], group[b])
            if (group[a], group[b]) != (low, low):
                group[a] = group[b] = low
                moved = True
    return group


def test_byte_copies(spark):
    rows = [(u, t, "clash", "clash") for u, t in TEXTS]
    got = sorted(map(tuple, byte_copies(spark.createDataFrame(rows, CONTENT).repartition(7)).collect()), key=str)
    want = []
    for u, t in TEXTS:
        body = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        same = [v for v, s in TEXTS if re.sub("[\x20\x09-\x0d]+", " ", s or "") == body]
        keep = min((v for v in same if v is not None), default=None)
        want.append((u, keep, len(same), u == keep, hashlib.sha256(body.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_byte_copies_of_nothing(spark):
    assert byte_copies(spark.createDataFrame([], CONTENT)).count() == 0


def test_many_runs_merge_to_the_smallest(spark):
    rows = spark.range(20_000, numPartitions=300).selectExpr("20000 - id AS uri", "concat('t', if(id % 3 = 0, 0, id % 500)) AS content")
    got = byte_copies(rows).toPandas()
    assert (got.groupby("sha256").uri.min() == got.groupby("sha256").kept_uri.max()).all()
    assert got.groupby("sha256").size().eq(got.groupby("sha256").copies.max()).all()
    assert got.kept.sum() == got.sha256.nunique()


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c d", "É a b\x0bc d É", "w " * 70_000 + "end", " a b   c d e f"])
def test_fingerprint(text):
    assert text_fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def clouds(seed):
    """Fingerprints around a few centres, so that links, near misses and chains of links all occur."""
    draw = random.Random(seed)
    prints = []
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(40):
            prints.append(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 7))))
    return prints + [draw.getrandbits(64) for _ in range(300)] + [0, 0, 0]


@pytest.mark.parametrize("bucket_rows", [8192, 20, 2])
def test_groups_lose_no_link(spark, bucket_rows):
    prints = np.array(clouds(7), dtype=np.uint64)
    rows = [(i + 1, int(p)) for i, p in enumerate(prints.view(np.int64))]
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    want = plain_group([i for i, _ in rows], [(int(a) + 1, int(b) + 1) for a, b in np.argwhere(near) if a < b])
    frame = spark.createDataFrame([*rows, (900, None), (901, None)], "asset_id bigint, phash bigint")
    got = {r.asset_id: r.group for r in fingerprint_groups(frame, bucket_rows).collect()}
    assert got == {**want, 900: 900, 901: 901}


def test_near_copies_of_odd_rows(spark):
    rows = [(4, None), (2, ""), (3, "same words in this text"), (3, "same words in this text"), (None, "same words in this text"), (1, "quite another thing stands here")]
    got = sorted([(r.uri, r.group) for r in near_copies(spark.createDataFrame(rows, "uri int, content string")).collect()], key=str)
    assert got == sorted([(4, 2), (2, 2), (3, 3), (3, 3), (None, 3), (1, 1)], key=str)
    assert near_copies(spark.createDataFrame([], "uri int, content string")).count() == 0
