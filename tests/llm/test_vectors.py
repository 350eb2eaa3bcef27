"""The vector operators over many lists, blocks and segments against all pairs, and their odd rows."""

import numpy as np
import pytest

from tagweave.llm import curve_search, pivot_dedup


def _clustered(n=3000, d=24, seed=6):
    """Loose clusters, tight groups of near copies, and equal vectors."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, d))[rng.integers(0, 60, n)] + rng.normal(scale=0.45, size=(n, d))
    for start in (100, 400, 900):
        x[start : start + 80] = x[start] + rng.normal(scale=0.08, size=(80, d))
    x[2000:2040] = x[100]
    return x.astype(np.float32)


def _frame(spark, x, extra=()):
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


@pytest.fixture(scope="module")
def truth():
    x = _clustered()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    return x, link


def test_links_over_many_blocks(spark, truth):
    x, link = truth
    df = _frame(spark, x)
    got = {r["vec_id"]: r for r in pivot_dedup.near_duplicates(df, block=16, small=4).collect()}
    whole = {r["vec_id"]: r["n_links"] for r in pivot_dedup.near_duplicates(df).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == whole
    found = np.array([whole[i] for i in range(len(x))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.98 * link.sum() > 10_000
    assert found[100] >= 100 and got[2010]["component_id"] == got[100]["component_id"] <= 100 and not got[2010]["kept"]
    for i, r in got.items():
        assert r["kept"] == (r["component_id"] == i)


def test_an_id_that_repeats_is_one_vector(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=8)
    rows = [(1, a.tolist()), (2, (a * 2).tolist()), (2, (a + 0.01).tolist()), (2, None), (3, rng.normal(size=8).tolist()), (4, (-a).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivot_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_order_of_pivots_chooses_the_lists():
    a, b = np.array([[5, 1, 9, 3]]), np.array([[9, 3, 5, 1]])
    one, two = (set(pivot_dedup.list_keys(c, 2, 1)[0].tolist()) for c in (a, b))
    assert len(one) == 3 and one & two == {(5 << 16) | 9}
    assert set(pivot_dedup.list_keys(a, 2, 4)[0].tolist()) == set(pivot_dedup.list_keys(b, 2, 4)[0].tolist())


def _nearest(x, q, top):
    s = x.astype(np.float64) @ x[q].astype(np.float64)
    s[q] = -np.inf
    return np.lexsort((np.arange(len(x)), -s))[:top].tolist()


def test_curves_alone_find_the_neighbours(spark, truth):
    """60 segments of 50 rows: recall from windows that compare a small share of all rows."""
    x, _ = truth
    found = curve_search.search(_frame(spark, x), segment=50, fit=(6, 3)).collect()
    share = 6 * 7 / 60
    asked = range(0, len(x), 20)
    got = {q: [] for q in asked}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[r["query_id"]].astype(float) @ x[r["vec_id"]].astype(float)), abs=1e-12)
    assert all(len(v) == len(set(v)) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(_nearest(x, q, 20))) / 20 for q in asked])
    assert recall >= 0.8 and share < 1


def test_fitted_windows_reach_the_recall(spark, truth):
    x, _ = truth
    found = curve_search.search(_frame(spark, x), segment=50).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(_nearest(x, q, 20))) / 20 for q in range(0, len(x), 20)]) >= 0.93


def test_short_queries_are_compared_with_all(spark, truth):
    x, _ = truth
    found = curve_search.search(_frame(spark, x[:200]), top=150, every=50, segment=20, fit=(1, 0)).collect()
    for q in range(0, 200, 50):
        mine = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == _nearest(x[:200], q, 150)


def test_odd_rows_take_no_part_and_reruns_agree(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 6)).round(1)
    x[7] = x[8]
    extra = [(0, [float("nan")] * 6), (0, None), (3, [float("inf")] + [0.0] * 5), (None, x[1].tolist()), (5, x[5].tolist()), (6, [9.0] * 6), (99, [0.0] * 6), (98, [1.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + extra, "vec_id long, embedding array<double>")
    y = x.copy()
    y[6] = min(x[6].tolist(), [9.0] * 6)
    got = sorted(tuple(r) for r in curve_search.search(df, top=50).collect())
    assert [(q, v) for q, _, v, _ in got] == [(q, v) for q in (0, 20) for v in _nearest(y, q, 39)]
    assert got == sorted(tuple(r) for r in curve_search.search(df.repartition(7), top=50).collect())
