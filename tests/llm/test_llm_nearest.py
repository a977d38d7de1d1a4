"""Nearest neighbours against brute force, on vectors of several shapes."""

from __future__ import annotations

import numpy as np
import pytest

from lurewatch.llm import mih

N = 4000


def clustered(rng):
    """Twenty tight clusters; the last 400 rows are points of their own."""
    vectors = rng.normal(size=(20, 32))[rng.integers(0, 20, N)] + 0.05 * rng.normal(size=(N, 32))
    vectors[-400:] = rng.normal(size=(400, 32))
    return vectors


def few_isolated(rng):
    """Twenty isolated points among tight clusters."""
    vectors = clustered(rng)
    vectors[-400:-20] = vectors[:380]
    return vectors


def isotropic(rng):
    vectors = rng.normal(size=(N, 32))
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def of_all_lengths(rng):
    return rng.normal(size=(N, 32)) * rng.exponential(1, size=(N, 1))


@pytest.mark.parametrize("make", [clustered, few_isolated, isotropic, of_all_lengths])
def test_every_query_finds_twenty_and_nine_in_ten(spark, make):
    vectors = make(np.random.default_rng(7))
    # isolated points are asked too
    ids = np.arange(N)
    ids[-20:] = 10**6 + 20 * np.arange(20)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>")
    found: dict = {}
    for r in mih.nearest(frame, query_bytes=30_000).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = np.flatnonzero(ids % 20 == 0)
    hits = {"isolated": [], "others": []}
    for q in asked:
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:20]
        mine = sorted(found[int(ids[q])])
        assert [k for k, *_ in mine] == list(range(1, 21))
        # ties aside: what scores as well counts
        worst = scores[order[-1]] - 1e-9
        kind = "isolated" if q >= N - 20 else "others"
        hits[kind].append(sum(s >= worst for _, _, s in mine) / 20)
    assert np.mean(hits["others"]) >= 0.9 and np.mean(hits["isolated"]) >= 0.9, {k: np.mean(v) for k, v in hits.items()}


def test_a_query_looks_farther_until_it_has_enough(spark, monkeypatch):
    """With radii of nothing, rounds still bring twenty."""
    monkeypatch.setattr(mih, "radii", lambda coder, gauge, gauge_ids, asked, ids: np.zeros(len(asked), np.int64))
    vectors = isotropic(np.random.default_rng(3))[:400]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    rows = mih.nearest(frame, every=40).groupBy("query_id").count().collect()
    assert len(rows) == 10 and {r["count"] for r in rows} == {20}
