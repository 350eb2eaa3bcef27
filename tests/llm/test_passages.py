"""Removal of repeated passages over several fragments and shards against all windows."""

import hashlib
import random

import pytest

from tagweave.llm import substring


def _removed(rows, window=20):
    """(n_words, n_removed, digest) of every row, by a dictionary of all windows' first places."""
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = (t or "").split()
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, (i, a)), (i, a))
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < (i, a):
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def _rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(rng.choice([20, 21, 35, 60, 150])) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 25))
            parts += [p[a : a + rng.choice([19, 20, 40, 200])], text(rng.randrange(25))]
        rows.append((i, " ".join(x for part in parts for x in part)))
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(300, "a b " * 200), (301, "a b " * 45), (302, None), (303, ""), (304, "z " * 3)]
    rows.append((7, rows[9][1]))  # shares its id with another text
    return rows


@pytest.mark.parametrize(("fragments", "shard"), [(1, 150_000), (5, 150_000), (3, 200), (8, 40)])
def test_windows_over_fragments_and_shards(spark, fragments, shard):
    rows = _rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, key string").repartition(6)
    got = sorted(tuple(r) for r in substring.dedup(docs, fragments=fragments, shard_windows=shard).collect())
    assert got == _removed(rows)
    assert sum(n for _, _, n, _ in got) > 3000
