import numpy as np
import pytest

from chatloom.llm import neighbors as N


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "window_id bigint, vec array<float>" + extra)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_and_similarities(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 64))
    x = (centres[rng.integers(0, 12, 3000)] + 0.9 * rng.standard_normal((3000, 64))).astype(np.float32)
    x *= rng.uniform(0.5, 3, (3000, 1)).astype(np.float32)
    got = N.most_similar(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).toPandas()
    s, best = exact(x.astype(np.float64), 10)
    assert got.groupby("id").size().eq(10).all() and len(got) == 30_000
    found = {(a, b) for a, b in zip(got["id"], got["other"])}
    recall = np.mean([(i, j) in found for i in range(3000) for j in best[i]])
    assert recall >= 0.9
    assert np.abs(s[got["id"], got["other"]] - got["similarity"]).max() < 1e-4
    [r] = N.measured_recall(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect()
    assert r.queries == 60 and r.recall >= 0.9


def test_scan_loses_little_and_invents_nothing():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:200]
    s = q @ x.T
    bound = (2 - 2 * np.partition(s, -10, axis=1)[:, -10]).astype(np.float32)
    a, b, sim = N.scan(q, N._prefix_norms(q), x, N._prefix_norms(x), bound + 1e-5)
    assert np.allclose(s[a, b], sim, atol=1e-5) and (2 - 2 * sim <= bound[a] + 1e-4).all()
    true = {(i, j) for i in range(200) for j in np.argsort(-s[i])[:10]}
    assert len(true & set(zip(a.tolist(), b.tolist()))) / len(true) > 0.98


def test_a_third_are_copies(spark):
    """The copies are each other's neighbours; the others still find theirs."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 64)).astype(np.float32)
    rows = [(i, x[0].tolist() if i % 3 == 0 else x[i].tolist()) for i in range(300)]
    got = N.most_similar(frame(spark, rows)).toPandas()
    assert got.groupby("id").size().eq(10).all()
    copies = got[got["id"] % 3 == 0]
    assert (copies["similarity"] == 1).all() and (copies["other"] % 3 == 0).all() and (copies["id"] != copies["other"]).all()
    assert copies.groupby("id")["other"].nunique().eq(10).all()
    assert set(copies[copies["id"] == 99]["other"]) == {0, 3, 6, 9, 12, 15, 18, 21, 24, 27}  # ties by the smaller id


def test_unusable_repeated_and_clashing(spark):
    one = [1.0] + [0.0] * 63
    two = [0.9, 0.1] + [0.0] * 62
    rows = [(1, one), (1, one), (2, two), (3, None), (4, [0.0] * 64), (5, [float("nan")] * 64), (6, [1.0] * 32), (7, [float("inf")] + one[1:]), (None, one), (8, [None, *one[1:]])]
    got = N.most_similar(frame(spark, [(*r, "x", 1) for r in rows], ", id string, cell int")).collect()
    assert {(r.id, r.other) for r in got} == {(1, 2), (2, 1)}
    assert N.most_similar(frame(spark, [])).collect() == []
    assert N.most_similar(frame(spark, [(1, one)])).collect() == []
    huge = N.most_similar(frame(spark, [(1, [3e38] * 64), (2, [1e-38] * 64)])).collect()
    assert [round(r.similarity, 5) for r in huge] == [1.0, 1.0]


def test_large_cells_are_cut():
    counts = np.array([10, 50_000, 3, 7])
    first, shards, units = N._pack(np.eye(4, 64, dtype=np.float32), counts, 16_384)
    assert shards[1] == 4 and units == first.max() + (shards[first.argmax()] if first.argmax() == 1 else 1)
    assert N._pack(np.ones((6, 64), dtype=np.float32), np.full(6, 100), 250)[2] >= 3


def random_recall(spark, n, k=10):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    got = N.most_similar(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])).toPandas()
    _, best = exact(x.astype(np.float64), k)
    found = set(zip(got["id"], got["other"]))
    return np.mean([(i, j) in found for i in range(n) for j in best[i]])


@pytest.mark.parametrize("most", [20, 64])
def test_sharded_units_find_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(N, "UNIT_ROWS", most)
    monkeypatch.setattr(N, "LEAST_UNIT", most)
    assert random_recall(spark, 400) >= 0.9


def test_a_second_level_of_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "MOST_FLAT", 16)
    fitted = []
    levels = N._fit_levels
    monkeypatch.setattr(N, "_fit_levels", lambda *a: fitted.append(levels(*a)) or fitted[-1])
    assert random_recall(spark, 1500) >= 0.9
    assert 40 <= len(fitted[0]) <= 80 and np.allclose(np.linalg.norm(fitted[0], axis=1), 1, atol=1e-4)


def test_the_recall_asked_for_is_reached(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 64)).astype(np.float32)
    rows = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    _, best = exact(x.astype(np.float64), 10)
    reached = []
    for recall in (0.7, 0.99):
        got = N.most_similar(rows, recall=recall).toPandas()
        found = set(zip(got["id"], got["other"]))
        reached.append(np.mean([(i, j) in found for i in range(1200) for j in best[i]]))
        assert reached[-1] >= recall
    assert reached[0] < reached[1]
