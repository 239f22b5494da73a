import numpy as np
import pytest

from anchorline.llm import ann as A

SHAPE = "vec_id long, embedding array<float>, label int, rank string"


def brute(vectors, queries, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in good:
            s = [(-round(float(good[q] @ v / np.sqrt(good[q] @ good[q]) / np.sqrt(v @ v)), 9), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
            out[q] = [(i, -x) for x, i in sorted(s)[:k]]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    vectors = [(i, (base[i % 40] + 0.3 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(600)]
    same = vectors[7][1]
    vectors += [(600 + i, same) for i in range(90)]
    vectors += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [float("inf")] + [0.0] * 15), (704, [None] + [1.0] * 15), (705, [1.0, 2.0]), (706, [2.0, 1.0]), (707, []), (708, [2 * x for x in vectors[9][1]])]
    return vectors


def run(spark, rows, k=5, **how):
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SHAPE)
    got = {}
    for r in A.nearest(df, df.where("vec_id % 50 = 0 or vec_id in (705, 7, 701)"), k, **how).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
        assert r.rank == len(got[r.query_id])
    return got


def test_all_cells_visited_is_exact(spark, rows):
    want = brute(rows, [i for i, _ in rows if i % 50 == 0 or i in (705, 7, 701)], 5)
    assert run(spark, rows, hashes=4, width=50.0, probes=60) == want


def test_recall(spark, rows):
    want = brute(rows, [i for i, _ in rows if i % 50 == 0 or i in (705, 7, 701)], 5)
    got = run(spark, rows)
    assert sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_hot_cells_are_dealt_out(spark, rows, monkeypatch):
    want = run(spark, rows)
    monkeypatch.setattr(A, "CELL_ROWS", 7)
    assert run(spark, rows) == want


def test_repeated_ids(spark):
    """Repeated rows count once; an id with several vectors answers by its nearest, and is asked by all of them."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((30, 8)).tolist()
    rows = [(i % 12, x) for i, x in enumerate(v)] + [(0, v[0]), (1, v[1]), (1, v[1]), (None, v[2]), (None, v[3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in A.nearest(df, df.where("vec_id in (0, 1)"), hashes=2, width=50.0, probes=9).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for q in (0, 1):
        best = {}
        for i, x in rows:
            for j, y in rows:
                if i == q and j is not None and j != q:
                    best[j] = max(best.get(j, -2), cos(x, y))
        assert got[q] == [(j, round(s, 9)) for s, j in sorted([(s, j) for j, s in best.items()], key=lambda p: (-p[0], p[1]))[:5]]


def test_very_large_and_small_components(spark):
    rows = [(i, [x * 10.0**e for x in v]) for i, (v, e) in enumerate([([1.0, 2.0], 0), ([1.0, 2.1], 300), ([2.0, 1.0], -300), ([1.0, -1.0], 305)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.nearest(df, df.where("vec_id = 0"), hashes=1, width=50.0, probes=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3] and all(np.isfinite(r.score) and r.score != 0 for r in got)


def test_share_of_candidates_falls_with_structure(spark):
    """The chosen cells hold a small part of clustered vectors, and neighbours are still found."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 24))
    x = np.repeat(base, 20, axis=0) + 0.15 * rng.standard_normal((3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, embedding array<double>")
    hashes, width, probes = A.tuned(df, df.where("eid % 50 = 0"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, shift = A.planes(24, A.TABLES, hashes, width, A.SEED)
    met = np.zeros((60, 3000), bool)
    for t in range(A.TABLES):
        v = (unit @ a[t].T + shift[t]) / width
        cell = np.floor(v)
        for n, q in enumerate(range(0, 3000, 50)):
            visited = {tuple(cell[q] + [sum(d for i, d in s if i == j) for j in range(hashes)]) for s in A.perturbations(v[q] - cell[q], probes)}
            met[n] |= [tuple(c) in visited for c in cell]
    near = np.argsort(-(unit[::50] @ unit.T), axis=1)[:, 1:6]
    assert met.mean() < 0.2 and np.take_along_axis(met, near, 1).mean() >= 0.9


def test_perturbations_come_in_order():
    rng = np.random.default_rng(1)
    below = rng.random(4)
    cost = lambda s: sum(below[i] ** 2 if d < 0 else (1 - below[i]) ** 2 for i, d in s)
    got = A.perturbations(below, 81)
    assert got[0] == [] and len(got) == 81 == len({tuple(sorted(s)) for s in got})
    assert all(cost(a) <= cost(b) + 1e-12 for a, b in zip(got, got[1:]))


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in A.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1)]
    assert A.nearest(df.where("vec_id > 9"), df.where("vec_id > 9")).count() == 0
