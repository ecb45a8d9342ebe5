"""Near copies among vectors against all pairs."""

import numpy as np
import pytest
from test_copies import plain_group

from sightline.llm.near_vectors import near_identity_vectors

ROWS = "vec bigint, vector array<double>, links string"


def plain(rows):
    sound = {i: np.array(v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in sound for b in sound if a != b and len(sound[a]) == len(sound[b])
             and sound[a] @ sound[b] >= 0.95 * np.linalg.norm(sound[a]) * np.linalg.norm(sound[b])]
    group = plain_group([i for i, _ in rows], links)
    return {i: (sum(a == i for a, _ in links), group[i], group[i] == i) for i, _ in rows}


@pytest.mark.parametrize("cell_rows", [1024, 7])
def test_all_links(spark, cell_rows):
    draw = np.random.default_rng(5)
    rows = []
    for centre in draw.standard_normal((15, 16)):
        rows += [centre + draw.normal(0, 0.1, 16) for _ in range(draw.integers(1, 30))]
        rows += [centre] * 3
    rows += list(draw.standard_normal((100, 16)))
    rows = [(i + 10, [float(x) for x in v]) for i, v in enumerate(rows)]
    rows += [(1, None), (2, []), (3, [0.0] * 16), (4, [None] + [1.0] * 15), (5, [float("nan")] * 16), (6, [float("inf")] * 16), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [-1.0, -0.0])]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    got = {r.vec: (r.n_links, r.group, r.kept) for r in near_identity_vectors(frame, cell_rows=cell_rows).collect()}
    assert got == plain(rows)


def test_odd_rows(spark):
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.1]), (None, None), (2, [0.0, 1.0])]
    got = sorted([tuple(r) for r in near_identity_vectors(spark.createDataFrame(rows, "vec bigint, vector array<double>")).collect()], key=str)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (None, 0, None, True), (2, 0, 2, True)], key=str)
    assert near_identity_vectors(spark.createDataFrame([], ROWS)).count() == 0
