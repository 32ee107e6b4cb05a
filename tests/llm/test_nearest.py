"""Nearest neighbours by the k-means tree against brute force, and on odd rows."""

import numpy as np
import pytest

from custodia.llm import nearest

SCHEMA = "vec_id bigint, embedding array<double>, leaf string, vector string, query_id string"


def brute(rows, k=10, every=100):
    """{query: [(score, vec_id), ...]} over usable rows with distinct ids."""
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((vectors - vectors[at]) ** 2).sum(1))
        out[int(ids[at])] = sorted((float(far[x]), int(ids[x])) for x in range(len(ids)) if x != at)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        held = out.setdefault(r.query_id, [])
        held.append((r.score, r.vec_id))
        assert r.rank == len(held)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "l", "v", "q") for i, v in rows], SCHEMA)


def test_recall_on_the_given_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = found(nearest.nearest(table))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    truth = {q: dict((i, s) for s, i in v) for q, v in want.items()}
    assert all(abs(truth[q][i] - s) < 1e-12 for q, v in got.items() for s, i in v if i in truth[q])


def test_all_leaves_are_exact(spark):
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=6).round(2).tolist()) for k in range(3_000)]
    assert found(nearest.nearest(frame(spark, rows), recall=1.0)).keys() == brute(rows).keys()
    tree = nearest.fit(np.array([v for _, v in rows]))
    leaves = tree.leaves_of(np.array([v for _, v in rows]))
    tree.rows = dict(zip(*map(np.ndarray.tolist, np.unique(leaves, return_counts=True)), strict=True))
    assert sum(tree.rows.values()) == 3_000 and max(tree.rows.values()) <= nearest.LEAF
    order = list(tree.visits(np.zeros(len(tree.children)), 10**9, 0))
    assert sorted(order) == sorted(tree.rows)


@pytest.mark.parametrize("sizes", [(8192, 2048), (64, 3)])
def test_hot_vector_and_ties(spark, monkeypatch, sizes):
    monkeypatch.setattr(nearest, "CELL_ROWS", sizes[0])
    monkeypatch.setattr(nearest, "CELL_QUERIES", sizes[1])
    draw = np.random.default_rng(4)
    hot = [0.25, -1.5, 3.0, 0.1]
    rows = [(k, hot if k % 3 == 0 else draw.normal(size=4).tolist()) for k in range(2_400)]
    want, got = brute(rows), found(nearest.nearest(frame(spark, rows)))
    assert set(got) == set(want)
    assert all(got[q] == want[q] for q in want if q % 3 == 0)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (100, [1e200, -1e200]), (7, [0.0, 1e-300]), (200, [3.0, 4.0]), (-100, [3.0, 4.5])]
    bad = [(300, None), (400, []), (500, [0.0, 0.0]), (600, [1.0, None]), (700, [1.0, nan]), (800, [inf, 1.0]), (None, [1.0, 1.0]), (900, [1.0, 2.0, 3.0])]
    got = found(nearest.nearest(frame(spark, good + bad)))
    assert set(got) == {0, 100, 200, -100} and all(len(v) == 5 for v in got.values())
    assert got[0][0] == (0.0, 1) and got[200][0] == (0.5, -100)
    assert [i for _, i in got[100]] and all(np.isfinite(s) for s, _ in got[100]) and abs(got[100][0][0] / (2**0.5 * 1e200) - 1) < 1e-12
    assert found(nearest.nearest(frame(spark, good + good + [(1, [1.0, -50.0])]))) == got
    nearer = found(nearest.nearest(frame(spark, good + [(1, [3.0, 4.25])])))
    assert nearer[200][0] == (0.25, 1) and len(nearer[200]) == 5
    assert nearest.nearest(frame(spark, [])).count() == 0
    assert nearest.nearest(frame(spark, bad[:7])).count() == 0
    assert nearest.nearest(frame(spark, [(5, [1.0]), (6, [2.0])])).count() == 0
    assert nearest.nearest(frame(spark, [(0, [1.0])])).count() == 0
