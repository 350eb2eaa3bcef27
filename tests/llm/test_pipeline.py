"""Every pipeline stage on its own and all in a row, on rows with null and shared ids, empty texts and odd columns."""

import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def _rows():
    rng = random.Random(12)
    word = {"en": ["the", "and", "with", "house", "water", "people"], "de": ["und", "mit", "ein", "wasser", "haus", "leute"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        text = " ".join(rng.choice(word[lang]) + rng.choice(["", ".", str(i)]) for _ in range(rng.randrange(20, 90)))
        rows.append((i, text, lang if i % 5 else None, f"src{i % 4}" if i % 7 else None, len(text)))
    near = rows[10][1].split()
    near[3] = "changed"
    rows += [(100, rows[10][1], "en", "src1", 1), (101, " ".join(near), "en", "src2", 1), (102, "12 345 !!", "en", "src1", 9), (103, None, "en", "src1", 0), (104, "", None, None, 0)]
    rows += [(5, "the house and the water write to a.b@mail.example.com or 10.0.0.1", "en", "src1", 64), (None, "the people with water", "en", "src1", 21), (None, "ein haus mit wasser", None, None, 19)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k") for r in _rows()], SCHEMA + ", size int, key string").repartition(4)


def _plain(df):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_language_stage_rejects_texts_without_language(spark, docs):
    out = STAGES["language_id"](spark, docs, "")
    assert out.columns == corpus_pipeline.COLUMNS
    kept = out.collect()
    assert {r["doc_id"] for r in kept} >= set(range(60)) and not {102, 103, 104} & {r["doc_id"] for r in kept}
    assert all(r["lang"] for r in kept) and len(kept) == len(_rows()) - 3
    assert all(r["lang"] == ("en" if r["doc_id"] % 3 else "de") for r in kept if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] != 5)


def _shingles(text):
    w = (text or "").lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_join_stage_keeps_one_of_each_group(spark, docs):
    out = STAGES["ngram_dedup"](spark, docs, "")
    rows = [r for r in _rows() if r[0] is not None]
    group = {r[0]: r[0] for r in rows}
    for a in rows:
        for b in rows:
            x, y = _shingles(a[1]), _shingles(b[1])
            if x and 100 * len(x & y) >= 80 * len(x | y):
                group[a[0]] = group[b[0]] = min(group[a[0]], group[b[0]])
    kept = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, g in group.items() if i == g) and kept.count(None) == 2
    assert 100 not in kept and 10 in kept and out.columns == corpus_pipeline.COLUMNS


def test_pii_stage_replaces_spans_only(spark, docs):
    rows = _plain(STAGES["pii"](spark, docs, ""))
    want = [(i, t and re.sub(r"[\w.]+@mail.example.com", "[EMAIL]", t).replace("10.0.0.1", "[IP]"), lang, s) for i, t, lang, s, _ in _rows()]
    assert rows == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_mixing_stage_takes_words_of_its_rows(spark, docs):
    rows = STAGES["mixing"](spark, docs, "").collect()
    texts = [(r[0], r[1]) for r in _rows() if r[1]]
    assert rows and all(any(r["doc_id"] == i and all(p.strip() in t for p in r["text"].split("\n")) for i, t in texts) for r in rows)
    words = sum(len(t.split()) for _, t in texts)
    assert abs(sum(len(r["text"].split()) for r in rows) - words) <= 5


def test_packing_stage_keeps_every_id(spark, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = STAGES["packing"](spark, docs, "").collect()
    sizes = sorted(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in _rows())
    whole = sorted(r["doc_tokens"] for r in rows if r["start"] == 0)
    assert whole == sizes and sum(r["length"] for r in rows) == sum(sizes)
    one = next(r for r in rows if r["doc_id"] == 101 and r["start"] == 0)
    ids = model.encode(next(t for i, t, *_ in _rows() if i == 101), add_special_tokens=False).ids + [1]
    assert one["ids_crc32"] == zlib.crc32(np.array(ids[: one["length"]], "<u4").tobytes())


def test_stages_on_an_empty_table(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_all_stages_in_a_row(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} - {None} <= set(range(60)) | {101}
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(used.values()) <= 2048
