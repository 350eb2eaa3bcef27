"""Registered queries over tables larger than the prefixes that their SQL names."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tagweave.operators import density


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """620 vectors, the last 40 of them copies of one, and an event for each and more."""
    d = str(tmp_path_factory.mktemp("whole"))
    v = np.random.default_rng(3).normal(size=(620, 4)).astype(np.float32)
    v[580:] = v[579]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.sql("select id as event_id, 5 as user_id, timestamp'2020-01-01' as ts, 10.0D as value, concat('e', id % 3) as event_type, concat('{\"k\": ', id % 2, '}') as props from range(700)").write.parquet(f"{d}/events.parquet")
    return d, v.astype(np.float64)


def test_density_queries_read_every_point(spark, folder, monkeypatch):
    d, v = folder
    monkeypatch.setattr(density, "BLOCK", 200)
    q = entry.queries()
    far = np.abs(v[:, None] - v[None]).sum(-1)
    order = np.lexsort((np.broadcast_to(np.arange(len(v)), far.shape), np.round(far, 9)))[:, :16]
    got = {(r["a"], r["rank"]): r["b"] for r in q["knn_l1"](spark, d).collect()}
    assert got == {(a, n + 1): b for a, near in enumerate(order.tolist()) for n, b in enumerate(near)}
    eps = np.take_along_axis(far, order, 1).mean()
    assert q["dbscan_epsilon"](spark, d).first()["epsilon"] == pytest.approx(eps, abs=1e-6)
    close = np.argwhere(np.triu(far <= eps, 1))
    assert {(r["a"], r["b"]) for r in q["epsilon_pairs"](spark, d).collect()} == set(map(tuple, close.tolist()))
    label = np.arange(len(v))
    while (low := np.where(far <= eps, label[None], len(v)).min(1)).tolist() != label.tolist():
        label = low
    assert {r["id"]: r["cluster"] for r in q["dbscan_clusters"](spark, d).collect()} == dict(enumerate(label.tolist()))
    counts = {(r["cluster"]): 0 for r in q["cluster_medoid"](spark, d).collect()}
    assert set(counts) == set(label.tolist())
    for r in q["cluster_top_tags"](spark, d).collect():
        counts[r["cluster"]] += r["n"]
    assert counts == {c: 2 * int((label == c).sum()) for c in set(label.tolist())}


def test_drop_null_embedding_reads_every_vector(spark, folder):
    got = {r["id"] for r in entry.queries()["drop_null_embedding"](spark, folder[0]).collect()}
    assert got == set(range(620))
