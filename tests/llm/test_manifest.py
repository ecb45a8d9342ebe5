"""Sealed manifests against a plain tree, with one digit or several tiers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sightline.llm import manifest
from sightline.llm.manifest import folded, item_digest, seal_manifest, siblings


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """The root, and each leaf's siblings before and after it at each hashed level."""
    steps, nodes = [[] for _ in leaves], [(leaf, [i]) for i, leaf in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for i in range(0, len(nodes), 16):
            run = nodes[i:i + 16]
            for k, (_, own) in enumerate(run):
                for leaf in own:
                    steps[leaf].append(("".join(d for d, _ in run[:k]), "".join(d for d, _ in run[k + 1:])))
            above.append((digest("".join(d for d, _ in run)), [x for _, own in run for x in own]))
        nodes = above
    return nodes[0][0], steps


def plain_leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    """Of ``(uri, source, note)`` rows: sorted (uri, leaf, subroot, root, steps)."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0], plain_leaf(*row)))
    trees = {}
    for source, leaves in by_source.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = (leaves, *plain_tree([leaf for _, leaf in leaves]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, tops = plain_tree([trees[s][1] for s in order])
    return sorted((str(uri), leaf, trees[s][1], root, steps + top) for s, top in zip(order, tops) for (uri, leaf), steps in zip(trees[s][0], trees[s][2]))


@pytest.mark.parametrize("digits,sizes", [(3, {"a": 1, "b": 2, None: 17, "é": 40}), (1, {"a": 1, "b": 16, None: 17, "Z": 300, "\U0001f600": 256}), (3, {"one": 1}), (1, {f"s{i}": 1 + i % 3 for i in range(40)})])
def test_proofs(spark, monkeypatch, digits, sizes):
    monkeypatch.setattr(manifest, "DIGITS", digits)
    rows = [(i * 7 % 1000, source, f"n{i}" if i % 5 else None) for source, n in sizes.items() for i in range(n)]
    items = spark.createDataFrame(rows, "uri int, source string, note string").repartition(3)
    sealed = seal_manifest(items, ["uri", "source", "note"])
    got = sorted((str(r.uri), r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in sealed.collect())
    assert got == plain_manifest(rows)
    broken = item_digest(F.col("uri"), F.col("source"), F.lit("other"))
    checks = sealed.select((folded(F.col("leaf"), F.col("steps")) == F.col("root")).alias("right"), (folded(broken, F.col("steps")) == F.col("root")).alias("wrong"),
                           (F.length(siblings(F.col("steps"))) % 64).alias("rest")).distinct().collect()
    assert [tuple(r) for r in checks] == [(True, False, 0)]


def test_ties_nulls_and_clashes(spark):
    rows = [(None, None, None), (None, None, None), (1, None, "x"), (1, None, "y"), (1, None, "y"), (2, "s", ""), (None, "s", "long " * 50000)]
    items = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "uri int, source string, note string, leaf string, steps int, tree int")
    sealed = seal_manifest(items, ["uri", "source", "note"], carried=["note"])
    assert sealed.columns == ["uri", "source", "note", "leaf", "steps", "subroot", "root"]
    assert sorted((str(r.uri), r.leaf, r.subroot, r.root, [tuple(s) for s in r.steps]) for r in sealed.collect()) == plain_manifest(rows)
    assert seal_manifest(items.limit(0), ["uri", "source", "note"]).collect() == []


def test_nothing_is_joined_in_a_proof(spark):
    items = spark.range(5000).select(F.col("id").alias("uri"), F.lit("s").alias("source"))
    plan = seal_manifest(items, ["uri", "source"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan
