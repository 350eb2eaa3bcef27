"""The n-gram join over several fragments and blocks: numbers of links against all pairs."""

import random

import pytest

from tagweave.llm import ngram_join


def _sets(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        out[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])
    return out


def _linked(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choice(words) for _ in range(12))
    out = {}
    for g in range(6):
        base = [rng.choice(words) for _ in range(140)]
        for k in range(20):
            own = base[:]
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            out[g * 100 + k] = " ".join(own)
    for i in range(40):  # a line that unlinked documents share
        out[1000 + i] = line + " " + " ".join(rng.choice(words) for _ in range(60))
    out |= {2000 + i: "a few" for i in range(5)} | {3000: None, 3001: "", 3002: " \t"}
    return out


@pytest.mark.parametrize("fragments", [1, 7])
def test_links_of_every_document(spark, texts, fragments):
    sets = _sets(texts)
    n_links = {a: sum(_linked(sets[a], sets[b]) for b in sets if b != a) for a in sets}
    low = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if _linked(sets[a], sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()] + [(None, "a few", 1, "x")], "doc_id long, text string, n long, key string").repartition(5)
    got = {r["doc_id"]: r for r in ngram_join.link_groups(docs, fragments=fragments).collect()}
    assert got.pop(None)["n_links"] is None
    assert {i: r["n_links"] for i, r in got.items()} == n_links
    assert {i: r["component_id"] for i, r in got.items()} == low
    assert max(n_links.values()) > 10


def test_blocks_of_a_component_give_the_same_counts(spark, texts):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    sized = {r["doc_id"]: r["n_links"] for r in ngram_join.link_groups(docs).collect()}
    again = ngram_join.link_groups(docs, rows=3, grams=500)
    assert {r["doc_id"]: r["n_links"] for r in again.collect()} == sized


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    base = " ".join(f"w{i}" for i in range(50))
    rows = [(1, base), (1, "something else that is here too"), (2, base), (3, base + " w"), (3, "something else that is here too")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.link_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 2, 1, 1), (1, 46, 1, 2), (2, 46, 1, 2), (3, 2, 1, 1), (3, 47, 1, 2)]
