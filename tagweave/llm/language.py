"""Language identification by error-correcting output codes.

Every language has a codeword. One binary classifier over hashed byte trigrams predicts each bit; a text's bit
margins are decoded to the language whose codeword has the least logistic loss, and the text is called ambiguous when
the second language comes close. Only the classifier is fitted on a bounded sample (PER_LANGUAGE rows a language, by
hash of the id, and no more than MOST_ROWS rows in all, an equal number a language); every whole text is scored. Rows
that share an id and a language are one of the sample (the one whose trigram shares come first in order of bytes).

Defined cases: a null text, or one without a letter of any script, is `und` with score 0; a null lang teaches nothing;
without any labelled row all texts are `und`; rows repeat and ties fall to the smaller code point; columns other than
the id, the text and the label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm._bytes import lowered, pieces, text_bytes
from tagweave.llm._sample import least_hashes

BITS = 13
PER_LANGUAGE = 400
CLOSE = 0.15
PIECE = 1 << 20
SCALE = 60.0
MOST_ROWS, AT_ONCE = 8_000, 1 << 16
_LETTER = regex.compile(r"\p{L}")
_ASCII = np.zeros(256, bool)
_ASCII[[*range(65, 91), *range(97, 123)]] = True


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1. Up to 5 classes all useful splits; beyond that the best of some random codes, by least distance."""
    if n <= 5:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if not row else 1 - 2 * ((b + 1) >> (row - 1) & 1) for b in range(bits)] for row in range(n)], np.float64)
    rng, bits = np.random.default_rng(seed), max(15, int(np.ceil(10 * np.log2(n))))
    best, most = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2
        least = (apart + bits * np.eye(n)).min()
        if least > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, least
    return best


def _trigrams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hashed trigram id at every byte; 2**BITS where none begins within the text."""
    if not len(data):
        return np.zeros(0, np.int64)
    b = lowered(data).astype(np.uint32)
    t = b << np.uint32(16)
    t[:-1] |= b[1:] << np.uint32(8)
    t[:-2] |= b[2:]
    out = ((t * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    for back in (1, 2):
        at = off[1:] - back
        out[at[(at >= off[:-1])]] = 1 << BITS
    return out


def _sums(table: np.ndarray, ids: np.ndarray, off: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
    """Sums of table[ids] over each text's range, at_once ids at a time; empty ranges give zeros."""
    out = np.zeros((len(off) - 1, table.shape[1]))
    for low in range(0, len(ids), at_once):
        rows = table[ids[low : low + at_once]]
        first, last = np.searchsorted(off, [low, low + len(rows) - 1], "right") - 1
        at = np.clip(off[first : last + 2] - low, 0, len(rows))
        some = np.flatnonzero(at[1:] > at[:-1])
        out[first + some] += np.add.reduceat(rows, at[:-1][some], axis=0)
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        data, off = text_bytes(batch.column("text"))
        ids = _trigrams(data, off)
        rows = []
        for i in range(batch.num_rows):
            own = np.bincount(ids[off[i] : off[i + 1]], minlength=(1 << BITS) + 1)[:-1]
            rows.append((own / max(1, own.sum())).astype(np.float16).tobytes())
        yield pa.record_batch({"lang": batch.column("lang"), "doc_id": batch.column("doc_id"), "x": pa.array(rows, pa.binary())})


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, steps: int = 150) -> dict:
    """labelled (doc_id, text, lang) -> languages, codewords and weights. Learns from per_language rows a language.

    The ids of the sample are broadcast: MOST_ROWS at most.
    """
    known = labelled.where("lang is not null").select("lang").distinct().limit(MOST_ROWS + 1).count()
    if known > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} languages")
    few = least_hashes(labelled.where("text is not null").select("lang", "doc_id"), "lang", "doc_id", min(per_language, MOST_ROWS // max(1, known)))
    some = labelled.select("lang", "doc_id", "text").where("text is not null").join(F.broadcast(few), ["lang", "doc_id"])
    rows = some.mapInArrow(_features, "lang string, doc_id long, x binary").groupBy("lang", "doc_id").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return {"langs": [], "code": np.zeros((0, 1)), "w": np.zeros(((1 << BITS) + 1, 1), np.float32), "b": np.zeros(1)}
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float32) * SCALE
    code = codewords(len(langs))
    of = np.array([langs.index(r["lang"]) for r in rows])
    y = code[of].astype(np.float32)
    share = (1.0 / np.bincount(of)[of]).astype(np.float32)[:, None] / len(langs)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        g = -y * share / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        gw, gb = x.T @ g + 1e-6 * w, g.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        rate, c1, c2 = 0.05, 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return {"langs": langs, "code": code, "w": np.vstack([w * SCALE, np.zeros((1, w.shape[1]))]).astype(np.float32), "b": b}


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword of each row of margins, its share of softmax(-loss), and whether the second is close."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(2)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    p /= p.sum(1, keepdims=True)
    best = loss.argmin(1)
    ranked = np.sort(loss, axis=1)
    close = (ranked[:, 1] - ranked[:, 0] < CLOSE) if loss.shape[1] > 1 else np.zeros(len(best), bool)
    return best, p[np.arange(len(p)), best], close


def _lettered(data: np.ndarray, off: np.ndarray, column: pa.Array) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII[data])])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = bool(_LETTER.search(column[int(i)].as_py()))
    return out


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns and lang_pred, score, ambiguous for every row; the whole text is read in pieces of rows."""
    langs = np.array([*model["langs"], "und"], object)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            column = batch.column("text")
            data, off = text_bytes(column)
            sums = _sums(model["w"], _trigrams(data, off), off)
            best, p, close = np.full(batch.num_rows, len(langs) - 1), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if len(langs) > 1 and batch.num_rows:
                best, p, close = decode(sums / np.maximum(off[1:] - off[:-1] - 2, 1)[:, None] + model["b"], model["code"])
                none = ~_lettered(data, off, column)
                best[none], p[none], close[none] = len(langs) - 1, 0, False
            made = {"lang_pred": pa.array(langs[best].tolist(), pa.string()), "score": pa.array(p, pa.float64()), "ambiguous": pa.array(close)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{kind}, lang_pred string, score double, ambiguous boolean")
