"""Each operator on small tables with every awkward case, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tagweave.llm import curve_search, html_text, language, mixing, ngram_join, packing, pii, pivot_dedup, quality, substring
from tagweave.llm._graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, size long, key string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _texts():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rng.choice(words) for _ in range(120))
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = {1: base, 2: base.replace(" ", "\n", 3), 3: base.upper(), 5: None, 6: "", 7: " \t ", 8: "one two", 9: "one two", 10: "one"}
    for i in range(11, 20):
        w = base.split()
        for _ in range(i - 10):
            w[rng.randrange(len(w))] = f"x{rng.random()}"
        out[i] = " ".join(w)
    out |= {20: "Élan " + passage + " fin", 21: passage + " " + passage, 22: "z " * 3000 + passage, 23: " ".join(rng.choice(words) for _ in range(80))}
    return out


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", None, "de"][i % 3], ["a", "b", None][i % 3], 0, 1, 2, "k") for i, t in TEXTS.items()]
    rows += [rows[0], (None, "one two", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def _shingles(t):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = [bytes(x) for x in WORD.findall((t or "").encode().translate(low))]
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def test_ngram_join(spark, docs):
    sets = {i: _shingles(t) for i, t in TEXTS.items()}
    low = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    rows = ngram_join.link_groups(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), low[r["doc_id"]])
    assert ngram_join.link_groups(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}


def _vocabulary():
    public = pytest.importorskip("public_tokenizers")
    return public.path("byte_bpe_50k.json")


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = _vocabulary()
    model = Tokenizer.from_file(path)
    rows = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    for i, t in TEXTS.items():
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
            raw = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(raw))
            at += r["length"]
        assert at == len(ids)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_token_runs_equal_the_tokenizer():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer
    import pyarrow as pa

    from tagweave.llm._bytes import text_bytes

    path = _vocabulary()
    model = Tokenizer.from_file(path)
    cutter = packing.Cutter(path)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab'sé1 .\n\t\r 　 😀!-"), max_size=30), max_size=4))
    def check(texts):
        ids, bound, _ = cutter.ids(*text_bytes(pa.array(texts, pa.string())), 1)
        for i, t in enumerate(texts):
            assert ids[bound[i] : bound[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids + [1]

    check()
    texts = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>", "<|endoftext |>"]
    ids, bound, _ = cutter.ids(*text_bytes(pa.array(texts, pa.string())), 1)
    for i, t in enumerate(texts):
        assert ids[bound[i] : bound[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids + [1]
    assert 50256 in ids.tolist()


def test_runs_under_one_hash_keep_their_own_ids(monkeypatch):
    import pyarrow as pa

    from tagweave.llm._bytes import text_bytes

    cutter = packing.Cutter(_vocabulary())
    monkeypatch.setattr(packing, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    for text in ("one two three", "four two one"):
        ids, _, _ = cutter.ids(*text_bytes(pa.array([text])), 1)
        assert ids.tolist() == cutter.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_packing_over_many_blocks(spark):
    """Blocks of 300 ids: sequences go on, and long documents are carried, over block ends; some stop at a power of two."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["word", "other.", "Élan", "so"]) for _ in range(rng.choice([0, 3, 40, 126, 900]))) for i in range(60)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").coalesce(1)
    model = Tokenizer.from_file(_vocabulary())
    rows = packing.pack(docs, _vocabulary(), window=256, block=300, with_ids=True).collect()
    total = {}
    for i, t in texts.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        ids = model.encode(t, add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r["ids"]] == ids and [r["start"] for r in own] == [sum(len(x["ids"]) for x in own[:k]) for k in range(len(own))]
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 256 and 128 in total.values()
    assert sum(256 - n for n in total.values() if n & (n - 1)) <= 0.1 * sum(total.values())


@pytest.mark.parametrize(("window", "total", "seed"), [(64, 140, 0), (512, 2600, 1), (300, 1900, 2), (2048, 9000, 3)])
def test_cuts_are_the_cheapest(window, total, seed):
    """Against all windows between all places, those of a power of two from 128 on without padding."""
    rng = np.random.default_rng(seed)
    docs = np.unique(np.append(rng.integers(1, total, 8), total))
    sentences = np.unique(rng.integers(1, total, 30))
    got = packing.cuts(total, docs, sentences, window)
    soft = sorted({0, *docs.tolist(), *sentences.tolist(), total})
    places = sorted({*soft, *(x for a, b in zip(soft[:-1], soft[1:], strict=True) for x in range(a + packing.STRIDE, b, packing.STRIDE))})
    fee = {p: packing.HARD for p in places} | {p: packing.SENTENCE for p in sentences.tolist()} | {p: 0.0 for p in docs.tolist()}

    def padding(n: int) -> int:
        return 0 if n >= 128 and not n & (n - 1) else window - n

    best = {0: 0.0}
    for p in places[1:]:
        best[p] = min(best[q] + padding(p - q) for q in places if q < p and p - q <= window and q in best) + fee[p]
    assert got[0] == 0 and got[-1] == total and max(np.diff(got)) <= window and set(got) <= set(places)
    assert best[total] == sum(fee[b] + padding(b - a) for a, b in zip(got[:-1], got[1:], strict=True))


PAGE = "<html><head><title>t</title></head><body class='has-sidebar'><nav>menu</nav><div class=ad>buy</div>{}<script>var a='</p>'</script><footer>f</footer>"


def test_html(spark):
    pages = [
        (1, "http://h/1", PAGE.format("<article><header><h1>A &amp; B</h1></header><p>one\n two<br>x<p>three<div class='comments'>no</div><form>f</form></article>")),
        (2, None, None), (3, "http://h/3", ""),
        *[(i, f"http://h/{i}", f"<div><p>Shared words stand on every page of this host always</p><p>own text number {i} differs in each of them</p></div>") for i in range(10, 16)],
    ]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got[1] == "A & B\n\none two x\n\nthree" and got[2] == "" and got[3] == ""
    assert got[12] == "own text number 12 differs in each of them"
    assert html_text.main_text(df.limit(0)).count() == 0


def _text(page):
    return "\n\n".join(t for t, role in html_text.page_blocks(page) if role == html_text.MAIN)


def test_names_take_nothing_from_an_article():
    assert _text("<article class='post comments-open'><p>a</p></article>") == "a"
    assert _text("<article><p class='share-price'>a</p><section id='notice-period'><p>b</p></section><p class='ad-free menu-1a'>c</p></article>") == "a\n\nb\n\nc"
    assert _text("<main id=content class='main sidebar-right'><p>a</p></main>") == "a"
    assert _text("<article role=main><div role=note>a</div><div class='searching'>b</div></article>") == "a\n\nb"


def test_what_stands_beside_an_article_goes():
    inside = "<div class='comment-list'>x</div><ul id='comments'><li>x</ul><div class=\"ad\">x</div><div class='social share-buttons'>x</div><aside>x</aside><form>x</form><article class=comment>x</article>"
    assert _text(f"<nav>x</nav><article><p>a</p>{inside}<p>b <span class=ad>x</span> c <button>x</button>d</p></article><footer>x</footer><div class='cookie-notice'>x</div>") == "a\n\nb c d"
    assert _text("<div class='sidebar-1'><article><p>a</p></article></div>") == "a"
    roles = [role for _, role in html_text.page_blocks("<header>h</header><div>open</div><nav>n</nav><div role=contentinfo>f</div>")]
    assert roles == [html_text.BESIDE, html_text.OPEN, html_text.BESIDE, html_text.BESIDE]


def test_repeated_blocks_around_the_text_are_found_by_the_array(spark):
    """Menus in plain elements: repeated ones go, by runs or whole; the same menu declared elsewhere counts too."""
    menu, note = "home news about contact imprint privacy terms jobs", "short note"
    rows = [(i, f"http://h/{i}", f"<div>{menu}</div><div>{note}</div><div>own text {i} of a page without an article {i}</div>") for i in range(2)]
    rows += [(9, "http://h/9", f"<nav>{menu}</nav><footer>{note}</footer><article><p>{menu}</p><p>kept</p></article>"), (10, "http://other/", f"<div>{menu}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {0: "own text 0 of a page without an article 0", 1: "own text 1 of a page without an article 1", 9: menu + "\n\nkept", 10: menu}
    assert html_text.boilerplate(df).count() == 2


def test_a_very_long_page_and_clashing_columns(spark):
    long = "word &amp; " * 300_000
    df = spark.createDataFrame([(1, None, f"<article><p>{long}</article>", 1, "x"), (1, None, f"<article><p>{long}</article>", 2, "y"), (None, "", "plain", 3, "z")], "page_id long, url string, html string, _row int, _blocks string")
    rows = html_text.main_text(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in rows) == [(0, 5), (1, 2_099_999), (1, 2_099_999)]
    assert {r["text"] for r in rows if r["page_id"] == 1} == {" ".join(["word &"] * 300_000)}


def test_suffix_runs():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 6, 400).astype(np.int64)
    page = np.repeat(np.arange(4), 100)
    tokens[99::100] = (1 << 32) + np.arange(4)
    seen = {}
    for i in range(len(tokens) - 3):
        seen.setdefault(tuple(tokens[i : i + 4]), set()).add(page[i])
    want = np.zeros(400, bool)
    for i in range(len(tokens) - 3):
        if len(seen[tuple(tokens[i : i + 4])]) >= 3:
            want[i : i + 4] = True
    assert (html_text.shared_runs(tokens, page, run=4, pages=3) == want).all()


def test_quality(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(60)) if i % 2 else "SPAM!! $$$ " * rng.randint(3, 60)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(None, 1), (3, None)], "doc_id long, label int")
    model = quality.fit(df, labels)
    score = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert np.mean([(score[i] >= 0.5) == (i % 2 == 1) for i in range(160, 240)]) > 0.95
    assert quality.score(docs, model).where("score between 0 and 1").count() == docs.count()
    assert quality.score(df.limit(0), model).count() == 0
    assert quality.score(df.limit(2), quality.fit(df, labels.limit(0))).first()["score"] == pytest.approx(0.5)


def _deduped(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall((texts[i] or "").encode())
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            k = tuple(w[a : a + 20])
            if seen.setdefault(k, (i, a)) != (i, a):
                gone[a : a + 20] = [True] * 20
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substring(spark, docs):
    want = _deduped(TEXTS)
    for r in substring.dedup(docs).collect():
        if r["doc_id"] is not None:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
    assert substring.dedup(docs.limit(0)).count() == 0


def test_language(spark, docs):
    rng = random.Random(3)
    word = {"aa": ["the", "and", "with"], "bb": ["und", "mit", "ein"], "cc": ["les", "des", "avec"]}
    rows = [(i, " ".join(rng.choice(word[k]) for _ in range(20)), k) for i, k in enumerate(list(word) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df.where("doc_id < 90"))
    got = {r["doc_id"]: r for r in language.identify(df.select("doc_id", "text"), model).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "é"), (5, "the and " * 20000)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] in word and got[5] == "aa"
    assert {r["lang_pred"] for r in language.identify(odd, language.fit(df.limit(0))).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_codewords():
    for n in (2, 3, 4, 5, 9):
        code = language.codewords(n)
        apart = [(code[a] != code[b]).sum() for a in range(n) for b in range(a)]
        assert min(apart) >= 1 and (np.abs(code.sum(0)) < n).all() and (n < 3 or min(apart) >= 2)


def _vectors():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[200:240] = x[0] + rng.normal(scale=0.05, size=(40, 16))
    x[250] = x[1]
    return x


def test_vectors(spark):
    x = _vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    y = x / np.linalg.norm(x, axis=1)[:, None]
    link = y @ y.T >= 0.9
    np.fill_diagonal(link, False)
    got = pivot_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert sum(by[i]["n_links"] for i in range(300)) >= 0.9 * link.sum() and all(by[i]["n_links"] <= link[i].sum() for i in range(300))
    assert by[220]["component_id"] == 0 and not by[220]["kept"] and by[900]["kept"] and by[902]["n_links"] == 0
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0
    found = curve_search.search(df, top=5).collect()
    want = {}
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want[q] = set(np.lexsort((np.arange(300), -s))[:5].tolist())
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in found)
    assert len(found) == 75 and hits >= 0.9 * 75
    assert all(r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]])) for r in found)
    assert curve_search.search(df.limit(0)).count() == 0


def test_hilbert_is_a_curve():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    path = cells[np.argsort(curve_search.hilbert(cells, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


PII = {1: "mail a.b@c.de, +1 (555) 123-4567 x 4111 1111 1111 1111 ip 1.2.3.004 é 9.9.9.9", 2: None, 3: "", 4: "1.2.3.4.5.6.7.8 x@y.com_z@w.org 999.1.1.1", 5: "a" * 5000, 6: "1 " * 3000}
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            odd = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in odd) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            out += [f"{kind}:{m.start()}:{m.end()}"] * good
    return ",".join(out)


def test_pii(spark):
    df = spark.createDataFrame([(i, t, "kind") for i, t in PII.items()], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in pii.digest(pii.find(df)).collect()}
    for i, t in PII.items():
        assert got[i]["base_sha256"] == hashlib.sha256(_spans(t).encode()).hexdigest() and got[i]["spans"] == _spans(t)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[1] == "mail [EMAIL], [PHONE] x [CARD] ip [IP] é [IP]" and red[2] is None and red[5] == PII[5]
    assert pii.find(df.limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    seeds = [(i, f"please reach me at mailbox u{i}@mail.example.com thanks a lot") for i in range(12)]
    odd = [(50, "please reach me at mailbox someone(at)host7 thanks a lot"), (51, "chapter 7 of the book")]
    df = spark.createDataFrame(seeds + odd, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(df)).collect()}
    at = odd[0][1].index("someone")
    assert got[50] == f"email:{at}:{at + len('someone(at)host7')}" and got[51] == ""


def test_pii_bootstraps_beyond_the_first_contexts(spark):
    """Handles are learned from addresses' context, then make another context known that no address has; labels reach over words."""
    rows = [f"write to u{i}@mail.example.com today" for i in range(30)]
    rows += [f"write to user{i}@intern today" for i in range(4)] + [f"account user{i}@intern is closed" for i in range(4)]
    rows += ["account user77@intern is closed"]
    rows += [f"phone: my home +1 (555) 010-{i:04d}x ok" for i in range(5)] + ["phone: at work (555)010-4444 ok", "phone: (555)010-5555 ok"]
    rows += [f"phone: call ({i}55)010-{i:04d} or +1 (555) 019-{i:04d}" for i in range(3)]
    rows += ["see chapter 7 of " + "w" * 200 + "to user9@nowhere", "room 12 and 14"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = [r["spans"] for r in pii.digest(pii.find(df)).orderBy("doc_id").collect()]
    at = [i for i, t in enumerate(rows) if "user77" in t][0]
    assert got[at] == "email:8:21" and all(got[30 + i] == "email:9:21" for i in range(4))
    assert got[-1] == "" and "email" not in got[-2]


def test_pii_in_a_very_long_text(spark):
    text = "x" * 200_000 + " a@b.cd " + "word " * 200_000 + "10.0.0.1"
    rows = [(1, text, "k"), (1, text, "k"), (None, "a@b.cd", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r["doc_id"] or 0, r["spans"]) for r in pii.digest(pii.find(df)).collect())
    ip = len(text) - len("10.0.0.1")
    assert got == [(0, "email:0:6"), *[(1, f"email:200001:200007,ip:{ip}:{len(text)}")] * 2]


def test_mixing(spark, docs):
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    sums = {}
    for r in mixed:
        t = sums.setdefault(r["source_index"], [r["target"], 0])
        t[1] += r["taken"]
    assert all(abs(t - got) <= 1 for t, got in sums.values())
    again = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.mix(docs).collect())
    assert again == sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixed)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_and_permutation(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 10), ("c", 1), (None, 100)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sized)}
    assert got["a"] == 30.0 and got["c"] == 3.0 and got["b"] == pytest.approx(30.0) and got[None] == pytest.approx(58.0)
    for n in (1, 2, 7, 1000):
        keys = mixing._keys(1, 2, 0)
        p = mixing.permuted(np.arange(n), n, keys)
        assert sorted(p.tolist()) == list(range(n)) and (mixing.permuted(p, n, keys, back=True) == np.arange(n)).all()
    slots = np.array([500, 20, 3])
    for stratum in (1, 4, 100):
        parts = [mixing.shard_counts(slots, i, 6, 100, 9, stratum) for i in range(6)]
        assert (sum(p for p, _ in parts) == slots).all() and all(80 <= p.sum() <= 95 for p, _ in parts)
        assert all((b == sum([p for p, _ in parts[:i]], start=0 * slots)).all() for i, (_, b) in enumerate(parts))
