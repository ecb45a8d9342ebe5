"""Block bounds: the same leaders as comparing everything, from few cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.operators import bounded, matching
from sightline.operators.matching import identity_scores, rank_identities


def clustered(seed, identities, photos, spread):
    draw = np.random.default_rng(seed)
    towns = draw.normal(size=(12, 16))
    people = towns[np.arange(identities) % 12] * 4 + draw.normal(size=(identities, 16))
    return [(i, n, (people[i] + spread * draw.normal(size=16)).tolist(), 16) for i in range(identities) for n in range(photos if i else 40)]


@pytest.mark.parametrize("seed,strategy,k,exclude", [(1, "max", 1, False), (2, "topk_mean", 3, False), (3, "max", 1, True), (4, "topk_mean", 2, True)])
def test_leaders_are_those_of_all_pairs(spark, seed, strategy, k, exclude):
    draw = np.random.default_rng(seed + 10)
    refs = clustered(seed, 60, 4, 0.4) + [(100 + i, 0, draw.normal(size=5).tolist(), 5) for i in range(3)] + [(200, 0, [0.0] * 16, 16)]
    probes = [(1000 + i, r[2] if i % 3 else (np.array(r[2]) + draw.normal(size=r[3])).tolist(), r[3], int(draw.integers(0, 60))) for i, r in enumerate(refs)] + [(5000, [0.0] * 16, 16, 3), (5001, [1.0, 2.0], 2, 3)]
    references = spark.createDataFrame(refs, "user_id int, ref_ix int, vector array<double>, dim int")
    if exclude:
        references = references.withColumn("ref_name", F.col("user_id") * 100 + F.col("ref_ix"))
        probes = [(u * 100 + n, v, d, u) for u, n, v, d in refs]
    asked = spark.createDataFrame(probes, "probe_id int, vector array<double>, dim int, claim int")
    plain = identity_scores(asked, references, strategy, k, exclude)
    cut = identity_scores(asked, references, strategy, k, exclude, block_rows=25)
    lines = lambda rows, *fields: sorted([tuple(round(r[f], 6) + 0.0 if isinstance(r[f], float) else r[f] for f in fields) for r in rows], key=str)
    fields = ["probe_id", "user_id", "similarity", "runner_up", "euclidean", "decision"]
    assert lines(rank_identities(cut).collect(), *fields) == lines(rank_identities(plain).collect(), *fields)
    own = lambda scores: scores.join(asked.select("probe_id", "claim"), "probe_id").where("user_id = claim").collect()
    assert lines(own(cut), "probe_id", "user_id", "similarity", "euclidean") == lines(own(plain), "probe_id", "user_id", "similarity", "euclidean")


def test_most_cells_are_never_shuffled(spark, monkeypatch):
    refs = clustered(5, 240, 3, 0.1)
    references = spark.createDataFrame(refs, "user_id int, ref_ix int, vector array<double>, dim int")
    probes = spark.createDataFrame([(i, r[2], 16) for i, r in enumerate(refs)], "probe_id int, vector array<double>, dim int")
    met = []
    cells = bounded._cells
    monkeypatch.setattr(bounded, "_cells", lambda demand, placed, *rest: met.append((demand.count(), placed.select("block").distinct().count())) or cells(demand, placed, *rest))
    found = rank_identities(identity_scores(probes, references, block_rows=64))
    assert found.count() == len(refs)
    pairs, blocks = sum(n for n, _ in met), met[0][1]
    assert blocks >= 8 and pairs < 0.35 * len(refs) * blocks


def test_small_blocks_are_compared_in_large_cells(spark, monkeypatch):
    """However small the blocks by direction, a product takes all rows that one can hold."""
    calls, top_scores = spark.sparkContext.accumulator(0), matching._top_scores

    def counted(*args):
        reduce = top_scores(*args)
        return lambda left, right: calls.add(1) or reduce(left, right)

    monkeypatch.setattr(matching, "_top_scores", counted)
    refs = clustered(6, 2, 200, 0.1)
    references = spark.createDataFrame(refs, "user_id int, ref_ix int, vector array<double>, dim int")
    probes = spark.createDataFrame([(i, r[2], 16) for i, r in enumerate(refs)], "probe_id int, vector array<double>, dim int")
    assert rank_identities(identity_scores(probes, references, block_rows=16)).count() == len(refs)
    assert 0 < calls.value <= 8  # two blocks, met first or later; the ranking may run them twice


def test_probes_of_few_blocks_are_copied_once_per_block(spark, monkeypatch):
    """Six blocks by direction are six cells or more: the parts of a block travel to a probe together, eighty of them to one task in two batches."""
    met, by_blocks = spark.sparkContext.accumulator(0), bounded.by_blocks

    def counted(*args):
        cell = by_blocks(*args)
        return lambda x, y: met.add(len(x)) or cell(x, y)

    monkeypatch.setattr(bounded, "by_blocks", counted)
    monkeypatch.setattr(bounded, "BLOCK_ROWS", 10)
    refs = clustered(7, 6, 100, 3.0)
    references = spark.createDataFrame(refs, "user_id int, ref_ix int, vector array<double>, dim int")
    probes = spark.createDataFrame([(i, r[2], 16) for i, r in enumerate(refs)], "probe_id int, vector array<double>, dim int")
    scores = identity_scores(probes, references, block_rows=90)
    assert scores.groupBy("probe_id").count().count() == len(refs)
    assert met.value <= len(refs) * 13  # six blocks at most, once or, where they are evaluated again, twice
