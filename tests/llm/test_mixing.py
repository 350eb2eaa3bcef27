"""The mix against its plan read out plainly, over several shards, and the rows that it takes."""

from collections import Counter

import pytest

from tagweave.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    long = [(i, " ".join(f"d{i}w{j}" for j in range(40 + 211 * i)), "en", "abc"[i % 3], 0) for i in range(12)]
    shared = [(7, "s1 s2 s3", "en", "a", 0), (7, "t1 t2", "en", "b", 0), (None, "n1 n2", "en", "a", 0), (None, "m1 m2 m3 m4", "en", "a", 0)]
    return [*long, *shared, (90, "", "en", "b", 0), (91, None, "en", None, 0), (92, "o1 o2", None, None, 0)]


@pytest.mark.parametrize(("block", "shard"), [(64, 65_536), (16, 40), (1, 100)])
def test_every_row_takes_what_the_plan_says(spark, block, shard):
    docs = mixing.numbered(spark.createDataFrame(_rows(), SCHEMA).repartition(3))
    text = {(r["_mix_file"], r["_mix_at"]): r["text"] for r in docs.collect()}
    key = mixing.KEY
    mixed = mixing.mix(docs, block_words=block, key=key, shard_slots=shard).collect()
    assert len(mixed) == len(text)
    sized = mixing.sizes(docs, key)
    sources = mixing.source_targets(sized)
    stream = {}
    table = spark.createDataFrame([tuple(r.values()) for r in sources], "source string, source_index int, source_size long, target double")
    for r in mixing.placed(sized, table, 15, key).where("size > 0").collect():
        at = (r["_mix_file"], r["_mix_at"])
        stream.setdefault(r["source_index"], []).append((r["start"], at, text[at].split()))
    stream = {s: [(at, w) for _, at, ws in sorted(x) for w in ws] for s, x in stream.items()}
    taken, plan = Counter(), mixing.mix_plan(spark, sources, block, shard).collect()
    for r in plan:
        at = r["block"] * block
        taken.update(x for x, _ in stream[r["source_index"]][at : at + min(r["words"], block)])
    assert {(r["_mix_file"], r["_mix_at"]): r["taken"] for r in mixed if r["taken"]} == dict(taken)
    for s in sources:
        got = sum(r["taken"] for r in mixed if r["source_index"] == s["source_index"])
        assert abs(got - s["target"]) <= 1 and s["target"] <= 3 * s["source_size"]
    assert all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert sum(s["target"] for s in sources) == pytest.approx(sum(s["source_size"] for s in sources))
    shards = {r["shard"] for r in plan}
    assert len(shards) > 1 or shard > 1000


def test_taken_rows_hold_the_words_drawn(spark):
    """Rows that share an id or have none keep their own takings; extra columns with odd names stay."""
    docs = spark.createDataFrame([(*r, 5, "x") for r in _rows()], SCHEMA + ", copies int, taken string")
    want = Counter()
    numbered = mixing.numbered(docs.coalesce(1))
    for r in mixing.mix(numbered, key=mixing.KEY).collect():
        want[r["doc_id"], r["size"]] += r["taken"]
    rows = mixing.take_mixed(docs.coalesce(1)).collect()
    texts = {}
    for i, t, *_ in _rows():
        texts.setdefault(i, []).append(t)
    got = Counter()
    for r in rows:
        whole = [t for t in texts[r["doc_id"]] if t and all(x.strip() in t for x in r["text"].split("\n"))]
        assert len(whole) == 1 and r["n_chars"] == len(r["text"]) and (r["copies"], r["taken"]) == (5, "x")
        got[r["doc_id"], len(whole[0].split())] += len(r["text"].split())
    assert got == Counter({k: n for k, n in want.items() if n})
    cut = [r for r in rows if r["text"] not in texts[r["doc_id"]]]
    assert any(not any(t.startswith(r["text"]) for t in texts[r["doc_id"]]) for r in cut)
    assert mixing.take_mixed(docs.limit(0)).count() == 0


def test_files_tell_rows_apart_without_a_copy(spark, tmp_path):
    spark.createDataFrame(_rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    keyed = mixing.numbered(docs)
    assert not hasattr(keyed, "_saved_path") and keyed.select(*mixing.KEY).distinct().count() == len(_rows())
    first = sorted((r["doc_id"] or -1, r["text"]) for r in mixing.take_mixed(docs).collect())
    assert first == sorted((r["doc_id"] or -1, r["text"]) for r in mixing.take_mixed(docs).collect())
