"""Quality scoring by a byte-level convolutional network in numpy.

The network: filters of four bytes at every second byte, max-pooled over overlapping chunks of 1024 bytes that cover
the whole text, rectified, averaged over the chunks and put through a logistic unit. It is fitted by Adam on a bounded
sample (PER_CLASS texts a class by hash of the id, at most CHUNKS evenly spaced chunks of each); every whole text is
scored, in blocks of 256 bytes whose maxima are combined. Beside the text and a padded copy of it, memory holds the
outputs of 1024 blocks and 24 numbers a block.

Rows that share an id and a label are one of the sample (the one whose chunks come first in order of bytes).

Defined cases: null and empty texts are scored as a chunk of padding; null labels teach nothing; repeated label rows
count once; without labels of both classes every score is the share of label 1 (0.5 without any); an empty table gives
an empty result; columns other than doc_id and text are never read when scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm._bytes import pieces, text_bytes
from tagweave.llm._sample import least_hashes

FILTERS, KERNEL, STEP = 24, 4, 2
UNIT, SPAN, HOP = 256, 4, 3  # bytes a block; blocks a chunk; blocks between chunks
PER_CLASS, CHUNKS = 1500, 4
BATCH, LEAST_STEPS = 48, 240
CROPPED = 0.35  # share of the texts that a training step sees only the beginning of a chunk of, so that short texts are learned too
PIECE = 1 << 18
THRESHOLD = 0.7


def blocks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each text padded by zeros to whole blocks (and by KERNEL at least), and the texts' block offsets."""
    size = np.diff(off)
    count = -(-(size + KERNEL) // UNIT)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * UNIT + KERNEL, np.uint8)
    for to, a, b in zip((first[:-1] * UNIT).tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
        out[to : to + b - a] = data[a:b]
    return out, first


def chunk_blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SPAN blocks of every chunk (the last block repeats at a text's end), and each chunk's text."""
    count = np.diff(first)
    number = -(-np.maximum(count - 1, 1) // HOP)
    owner = np.repeat(np.arange(len(count)), number)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    rows = first[:-1][owner][:, None] + k[:, None] * HOP + np.arange(SPAN)
    return np.minimum(rows, first[1:][owner][:, None] - 1), owner


def pair_tables(e: np.ndarray) -> list[np.ndarray]:
    """Filter outputs for all pairs of bytes: one table for each two bytes of the kernel."""
    return [(e[j][:, None, :] + e[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, KERNEL, 2)]


def block_maxima(data: np.ndarray, tables: list[np.ndarray], last: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """Each block's largest output of each filter, from at_once blocks at a time.

    last: blocks that end a text. Their last place would read the next text; it sees padding like the place before.
    """
    total = (len(data) - KERNEL) // UNIT
    out = np.empty((total, tables[0].shape[1]), np.float32)
    for low in range(0, total, at_once):
        high = min(total, low + at_once)
        own = data[low * UNIT : high * UNIT + KERNEL]
        pairs = own[:-1].astype(np.int32) * 256 + own[1:]
        n = (len(own) - KERNEL) // STEP
        act = tables[0][pairs[0 : n * STEP : STEP]]
        for j, t in enumerate(tables[1:], 1):
            act += t[pairs[2 * j : 2 * j + n * STEP : STEP]]
        act = act.reshape(-1, UNIT // STEP, act.shape[1])
        end = last[(last >= low) & (last < high)] - low
        act[end, -1] = act[end, -2]
        act.max(1, out=out[low:high])
    return out


def forward(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    padded, first = blocks(data, off)
    rows, owner = chunk_blocks(first)
    top = block_maxima(padded, model["tables"], first[1:] - 1)[rows].max(1)
    hidden = np.maximum(top + model["bias"], 0)
    z = np.bincount(owner, hidden @ model["w"], len(off) - 1) / np.bincount(owner, minlength=len(off) - 1) + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _chunks(text: bytes) -> list[bytes]:
    """At most CHUNKS chunks of a text, evenly spaced over all it has."""
    data, first = blocks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    rows, _ = chunk_blocks(first)
    some = np.unique(np.linspace(0, len(rows) - 1, CHUNKS).round().astype(int))
    flat = data[:-KERNEL].reshape(-1, UNIT)
    return [flat[rows[i]].tobytes() for i in some]


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [b"".join(_chunks((t or "").encode())) for t in batch.column("text").to_pylist()]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "label": batch.column("label"), "x": pa.array(made, pa.binary())})


def _cropped(chunks: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    one = chunks[rng.integers(len(chunks))][None].copy()
    one[:, int(np.exp(rng.uniform(np.log(8), np.log(one.shape[1])))) :] = 0
    return one


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, epochs: int = 8, seed: int = 3) -> dict:
    """docs (doc_id, text), labels (doc_id, label 0/1) -> model. Learns from at most per_class texts a class.

    The sampled label rows are broadcast: they number at most twice per_class.
    """
    rows = least_hashes(labels.where("doc_id is not null").select("doc_id", "label"), "label", "doc_id", per_class)
    cut = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").mapInArrow(_samples, "doc_id long, label int, x binary")
    got = cut.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["x"])))
    return train([(r["label"], r["x"]) for r in got], epochs, seed)


def train(got: list[tuple[int, bytes]], epochs: int = 8, seed: int = 3) -> dict:
    """(label, chunks) of each sampled text -> model."""
    y = np.array([label for label, _ in got], np.float64)
    rng, width = np.random.default_rng(seed), SPAN * UNIT
    e = rng.normal(0, 0.3, (KERNEL, 256, FILTERS)).astype(np.float32)
    p = {"e": e, "bias": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.3, FILTERS).astype(np.float32), "b": np.zeros(1, np.float32)}
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5
        p["w"][:], p["b"][:] = 0, np.log(share / (1 - share))
        return {"tables": pair_tables(p["e"]), "bias": p["bias"], "w": p["w"], "b": p["b"]}
    texts = [np.frombuffer(x, np.uint8).reshape(-1, width) for _, x in got]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    at = np.arange(0, width - KERNEL, STEP)
    t = 0
    for _ in range(max(epochs, -(-LEAST_STEPS * BATCH // len(texts)))):
        order = rng.permutation(len(texts))
        for part in np.array_split(order, max(1, len(order) // BATCH)):
            t += 1
            shown = [_cropped(texts[i], rng) if rng.random() < CROPPED else texts[i] for i in part]
            x = np.concatenate(shown)
            owner = np.repeat(np.arange(len(part)), [len(c) for c in shown])
            act = p["e"][0][x[:, at]]
            for j in range(1, KERNEL):
                act += p["e"][j][x[:, at + j]]
            best = act.argmax(1)
            top = np.take_along_axis(act, best[:, None, :], 1)[:, 0] + p["bias"]
            hidden, share = np.maximum(top, 0), 1 / np.bincount(owner)
            z = np.bincount(owner, hidden @ p["w"]) * share + p["b"]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) * weight[part] / len(part)
            back = (g * share)[owner][:, None]
            grad = {"w": (back * hidden).sum(0) + 1e-4 * p["w"], "b": np.array([g.sum()])}
            inner = np.where(top > 0, back * p["w"], 0).astype(np.float32)
            grad["bias"] = inner.sum(0)
            grad["e"] = np.zeros_like(p["e"])
            row, f = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
            for j in range(KERNEL):
                np.add.at(grad["e"][j], (x[row, at[best] + j], np.broadcast_to(f, best.shape)), inner)
            for k, v in p.items():
                m = moment[k]
                m[0] = 0.9 * m[0] + 0.1 * grad[k]
                m[1] = 0.999 * m[1] + 0.001 * grad[k] ** 2
                v -= (0.01 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return {"tables": pair_tables(p["e"]), "bias": p["bias"], "w": p["w"], "b": p["b"]}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns and `score`, the probability of label 1, for every row and its whole text."""
    kept = {k: v for k, v in model.items() if k != "tables"} | {"half": [t.astype(np.float16) for t in model["tables"]]}
    shared = docs.sparkSession.sparkContext.broadcast(kept)  # two tables of 65,536 rows and FILTERS columns, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {**shared.value, "tables": [t.astype(np.float32) for t in shared.value["half"]]}
        for batch in pieces(batches, "text", PIECE):
            p = forward(own, *text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64))], [*batch.schema.names, "score"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kind}, score double")
