"""Hard negatives against a plain version in Python's integers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurewatch.llm import hardneg

SCHEMA = "vec_id bigint, label int, embedding array<double>, rank int"


def plain(rows, anchor=lambda i: i % 100 == 0, positives=5, negatives=10, scale=256.0):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), sorted."""
    part = []
    for i, label, vector in rows:
        if i is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            part.append((i, label, [math.floor(scale * float(x)) for x in vector]))
    found = []
    for a, label, vector in part:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for i, other, v in part if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            found += [(a, p, rank, i, -score, -s) for rank, (s, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(found)


def mined(spark, rows, every=100, **options):
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in hardneg.hard_negatives(frame, F.col("vec_id") % every == 0, **options).collect())


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "lengths"])
def test_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hardneg, "TOGETHER", 7)
    monkeypatch.setattr(hardneg, "ANCHOR_BYTES", 2000)
    monkeypatch.setattr(hardneg, "SAMPLE", 200)
    rng = np.random.default_rng(3)
    n = 1500
    vectors = rng.normal(size=(n, 12))
    if kind == "clustered":
        vectors = rng.normal(size=(9, 12))[rng.integers(0, 9, n)] + 0.1 * vectors
        vectors[::17] = vectors[3]
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if kind == "lengths":
        vectors *= rng.exponential(3, size=(n, 1))
        vectors[::50] = 0
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(vectors)]
    want = plain(rows, lambda i: i % 60 == 0)
    assert len(want) > 500 and mined(spark, rows, 60) == want


def test_odd_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (0, 1, [0.5, 0.5]), (None, 1, [0.5, 0.4]), (1, None, [0.5, 0.5]), (2, 1, None), (3, 2, [0.4, None]), (4, 2, [nan, 1.0]),
        (5, 2, [inf, 1.0]), (6, 1, [0.5, 0.25]), (6, 1, [0.5, 0.25]), (7, 2, [0.25, 0.25]), (8, 2, [0.25, 0.25]), (9, 2, []),
        (10, 2, [0.3]), (11, 2, [0.1, 0.2, 9.0]), (12, 1, [0.0, 0.0]), (13, 3, [-0.3, 0.1]), (100, 5, [1.0, 1.0]),
        (200, -3, [2.0**30, 3.0]), (201, -3, [2.0**10, 0.1]), (202, 4, [2.0**9, 0.3]),
    ]
    want = plain(rows)
    assert {r[:2] for r in want} >= {(0, 6), (200, 201)}
    assert mined(spark, rows) == want


def test_huge_components_do_not_fail(spark):
    rows = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e307, -1e307]), (3, 2, [0.1, 0.1])]
    assert mined(spark, rows) == []


def test_without_rows_or_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == []
    assert mined(spark, [(0, 1, []), (1, 1, []), (2, 2, [])]) == [(0, 1, 1, 2, 0, 0)]


def test_bounds_hold_and_pass_over_blocks():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16)) * 300
    values = np.floor(centres[rng.integers(0, 8, 4000)] + 20 * rng.normal(size=(4000, 16)))
    references = hardneg.choose_references(values[:300], 8)
    angles = hardneg.angles_to(values, references)
    rows = hardneg.Rows(np.arange(4000), np.zeros(4000), values, hardneg.norms_of(values), angles)
    anchors = rows.take(slice(0, 40))
    passed = 0
    for cell, block in hardneg.blocks_of(rows):
        found = hardneg.scores(anchors, block)
        low, high = hardneg.block_bounds(anchors, block)
        assert (found >= low[:, None]).all() and (found <= high[:, None]).all()
        wanted = np.full(40, 0.9) * anchors.norms**2
        passed += (high < wanted).sum()
        first, past = hardneg.angle_windows(anchors, block, cell, wanted, np.full(40, 2.0**60))
        for a in range(40):
            hit = np.flatnonzero(found[a] >= wanted[a])
            assert not len(hit) or (first[a] <= hit.min() and hit.max() < past[a])
    assert passed > 100
