"""The learned operators' arithmetic against plain loops, whatever the block size, and their bounded samples."""

import numpy as np

from tagweave.llm import language, quality
from tagweave.llm._sample import least_hashes


def _flat(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_network_equals_plain_loops():
    rng = np.random.default_rng(2)
    e = rng.normal(0, 1, (quality.KERNEL, 256, quality.FILTERS)).astype(np.float32)
    model = {"tables": quality.pair_tables(e), "bias": rng.normal(0, 1, quality.FILTERS), "w": rng.normal(0, 1, quality.FILTERS), "b": 0.3}
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 3, 4, 5, 255, 256, 1020, 1024, 1030, 5000)]
    got = quality.forward(model, *_flat(texts))
    for t, p in zip(texts, got, strict=True):
        blocks = -(-(len(t) + quality.KERNEL) // quality.UNIT)
        padded = t + bytes(blocks * quality.UNIT + quality.KERNEL - len(t))
        most = []
        for b in range(blocks):
            acts = [sum(e[j][padded[i + j]] for j in range(quality.KERNEL)) for i in range(b * quality.UNIT, (b + 1) * quality.UNIT, quality.STEP)]
            most.append(np.max(acts, axis=0))
        hidden = []
        for k in range(0, max(blocks - 1, 1), quality.HOP):
            top = np.max([most[min(k + j, blocks - 1)] for j in range(quality.SPAN)], axis=0)
            hidden.append(np.maximum(top + model["bias"], 0))
        z = np.mean(hidden, axis=0) @ model["w"] + model["b"]
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-4


def test_maxima_do_not_depend_on_the_block_size():
    rng = np.random.default_rng(5)
    tables = quality.pair_tables(rng.normal(0, 1, (quality.KERNEL, 256, 3)).astype(np.float32))
    data = rng.integers(0, 256, 9 * quality.UNIT + quality.KERNEL).astype(np.uint8)
    last = np.array([2, 3, 8])
    assert (quality.block_maxima(data, tables, last, 2) == quality.block_maxima(data, tables, last)).all()


def test_margins_equal_plain_loops():
    rng = np.random.default_rng(3)
    table = rng.normal(0, 1, ((1 << language.BITS) + 1, 3)).astype(np.float32)
    table[-1] = 0
    texts = [b"", b"ab", b"abc", b"", bytes(rng.integers(65, 123, 700).astype(np.uint8)), b"x" * 90, b""]
    data, off = _flat(texts)
    ids = language._trigrams(data, off)
    plain = np.array([table[ids[a:b]].astype(float).sum(0) for a, b in zip(off[:-1], off[1:], strict=True)])
    for at_once in (1, 7, 64, 10_000):
        assert np.allclose(language._sums(table, ids, off, at_once), plain, atol=1e-3)
    assert len(set(ids[off[5] : off[6] - 2].tolist())) == 1 and (ids[off[6] - 2 : off[6]] == 1 << language.BITS).all()


def test_decoding_equals_plain_loops():
    code = language.codewords(6)
    margins = np.random.default_rng(4).normal(0, 2, (40, code.shape[1]))
    best, p, close = language.decode(margins, code)
    for row, b, share, c in zip(margins, best, p, close, strict=True):
        loss = [sum(np.log1p(np.exp(-m * w)) for m, w in zip(row, word, strict=True)) for word in code]
        order = np.argsort(loss)
        assert b == order[0] and c == (loss[order[1]] - loss[order[0]] < language.CLOSE)
        assert abs(share - 1 / np.exp(min(loss) - np.array(loss)).sum()) < 1e-9


def test_samples_are_bounded_and_repeat(spark):
    rows = [("big", i) for i in range(3000)] + [("big", 7)] * 500 + [("small", i) for i in range(5)] + [(None, 1), ("none", None)]
    df = spark.createDataFrame(rows, "kind string, name long")
    got = {(r["kind"], r["name"]) for r in least_hashes(df, "kind", "name", 50).collect()}
    assert sum(k == "big" for k, _ in got) == 50 and sum(k == "small" for k, _ in got) == 5 and len(got) == 55
    assert got == {(r["kind"], r["name"]) for r in least_hashes(df.repartition(7), "kind", "name", 50).collect()}


def test_repeated_ids_do_not_widen_a_sample(spark):
    docs = spark.createDataFrame([(1, f"some text {i}", "en") for i in range(300)] + [(2, "ein text", "de")], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model["langs"] == ["de", "en"]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert quality.score(docs, quality.fit(docs, labels, per_class=5)).count() == 301


def test_very_long_texts(spark):
    long = "wort und " * 400_000
    docs = spark.createDataFrame([(1, long, "de"), (2, "word and " * 30, "en"), (3, "wort und " * 20, "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.drop("lang"), language.fit(docs.where("doc_id > 1"))).collect()}
    assert got == {1: "de", 2: "en", 3: "de"}
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, label int")
    score = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert abs(score[1] - score[3]) < 0.2
