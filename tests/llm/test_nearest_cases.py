"""Vectors of odd sizes, copies and repeated ids in the search for nearest neighbours."""

import numpy as np
import pytest

from auditlake.llm import ann


def brute(v: np.ndarray, ids: np.ndarray, q: int, k: int) -> list[tuple[float, int]]:
    score = np.cumsum(v * v[q], axis=1)[:, -1]
    return sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != ids[q])[:k]


@pytest.mark.parametrize("scale", [1e-200, 1e-30, 1.0, 1e30, 1e150])
def test_any_length_of_vectors(scale):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 8)) * scale * r.uniform(0.1, 3, size=(400, 1))
    ids = np.arange(400)
    q, got, score = ann.Block(ids, v, float((v**2).sum(1).max())).nearest(ids[:30], v[:30], 10)
    hit = [len({i for _, i in brute(v, ids, x, 10)} & set(got[q == x].tolist())) for x in range(30)]
    assert sum(hit) >= 0.97 * 300
    assert all(np.all(np.diff(score[q == x]) <= 0) for x in range(30))


def test_squares_that_overflow():
    v = np.array([[1e200, 0.0], [1e200, 1.0], [-1e200, 1.0]])
    q, got, _ = ann.Block(np.arange(3), v, float("inf")).nearest(np.array([7]), np.array([[1.0, 0.5]]), 2)
    assert got.tolist() == [0, 1] or got.tolist() == [1, 0]


def test_copies_are_ties():
    v = np.repeat(np.random.default_rng(2).normal(size=(3, 6)), 500, axis=0)
    ids = np.random.default_rng(3).permutation(1500)
    q, got, score = ann.Block(ids, v, float((v**2).sum(1).max())).nearest(ids[:1], v[:1], 20)
    assert got.tolist() == [i for _, i in brute(v, ids, 0, 20)] and len(set(score.tolist())) == 1


def test_fewer_candidates_than_asked():
    v = np.eye(3)
    q, got, _ = ann.Block(np.arange(3), v, 1.0).nearest(np.arange(3), v, 20)
    assert [got[q == x].tolist() for x in range(3)] == [[1, 2], [0, 2], [0, 1]]
    assert len(ann.Block(np.array([4]), v[:1], 1.0).nearest(np.array([4]), v[:1], 20)[0]) == 0


def test_rows_of_one_id_and_other_columns(spark):
    v = np.random.default_rng(4).normal(size=(60, 4))
    rows = [(1 if i % 3 == 0 else i, x.tolist(), 1.0, "a") for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, dim string")
    got = ann.nearest(d, d.where("vec_id = 20"), 5).orderBy("rank").collect()
    want = brute(v, np.array([x[0] for x in rows]), 20, 5)
    assert [(x["rank"], x["vec_id"]) for x in got] == [(n + 1, i) for n, (_, i) in enumerate(want)]
    assert np.allclose([x["score"] for x in got], [-s for s, _ in want], rtol=1e-12)
