"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.common import map_arrow

#: A chunk is CHUNK bytes, a new one starts every HOP bytes; both are multiples of the pooled block.
BLOCK, CHUNK, HOP = 128, 512, 256
WIDTH, DIM, FILTERS = 6, 8, 16
#: Bound of the training sample: labelled rows for each class. Chunks that one epoch draws, anew, from the whole text of a row.
SAMPLE_ROWS, EPOCH_CHUNKS = 2000, 8
EPOCHS, BATCH, RATE, DECAY = 12, 32, 0.02, 1e-4
THRESHOLD = 0.7
#: Labels are learnt from rows whose crc32(doc_id) is not HELD_OUT modulo FOLDS.
FOLDS, HELD_OUT = 4, 2
#: Positions that are convolved at once.
SLAB = 1 << 13


@dataclass
class Model:
    """tables: for each place in the filter window, the response of all filters to each byte; then weights and bias of the output."""

    tables: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: float


def pooled_blocks(data: np.ndarray, m: Model) -> np.ndarray:
    """Largest response of each filter in each BLOCK of positions; data has WIDTH - 1 bytes more than whole blocks."""
    n = (len(data) - WIDTH + 1) // BLOCK
    pooled = np.empty((n, m.tables.shape[2]), np.float32)
    step = SLAB // BLOCK
    for a in range(0, n, step):
        z = min(n, a + step)
        size = (z - a) * BLOCK
        y = m.tables[0][data[a * BLOCK : a * BLOCK + size]]
        for j in range(1, WIDTH):
            y += m.tables[j][data[a * BLOCK + j : a * BLOCK + j + size]]
        pooled[a:z] = y.reshape(z - a, BLOCK, -1).max(axis=1)
    return pooled


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of chunks and of blocks that cover each text: at least one chunk, the last one padded with zero bytes."""
    chunks = 1 + np.maximum(0, -(-(sizes - CHUNK) // HOP))
    return chunks, ((chunks - 1) * HOP + CHUNK) // BLOCK


def scores(texts: list[bytes], m: Model) -> np.ndarray:
    """The model's probability of each whole text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chunks, blocks = layout(sizes)
    starts = np.cumsum(blocks + 1) - blocks - 1  # an empty block after each text, so that no filter sees two texts
    data = np.zeros(int((blocks + 1).sum()) * BLOCK + WIDTH - 1, np.uint8)
    for t, s in zip(texts, starts.tolist(), strict=True):
        data[s * BLOCK : s * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    pooled = pooled_blocks(data, m)
    per, hop = CHUNK // BLOCK, HOP // BLOCK
    first = np.repeat(starts, chunks) + hop * (np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    chunk = pooled[first]
    for k in range(1, per):
        np.maximum(chunk, pooled[first + k], out=chunk)
    features = np.maximum(chunk + m.shift, 0)
    logits = np.add.reduceat(features @ m.out, np.cumsum(chunks) - chunks) / chunks + m.bias
    return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def train(chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray, positive_share: float, drawn: np.ndarray | None = None, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fits the network by Adam. chunks: (n, CHUNK + WIDTH - 1) bytes, owner: the row of each chunk, in order; labels: 0 or 1 per row.

    drawn: for each chunk, a bit for each epoch that learns from it; all do without it. Each row has a chunk in each epoch.
    positive_share: of label 1 among all labelled rows; the sample is balanced and the bias is set back to that share.
    """
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, DIM)), "w": rng.normal(0, 0.3, (WIDTH, DIM, FILTERS)), "s": np.zeros(FILTERS), "o": rng.normal(0, 0.3, FILTERS), "b": np.zeros(1)}
    mean, var = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    n = len(labels)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (labels == 0).sum())) * n
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        at_hand = np.arange(len(owner)) if drawn is None else np.flatnonzero(drawn >> epoch & 1)
        first = np.searchsorted(owner[at_hand], np.arange(n + 1))
        for a in range(0, n, BATCH):
            rows = order[a : a + BATCH]
            take = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
            which = np.repeat(np.arange(len(rows)), first[rows + 1] - first[rows])
            x = chunks[at_hand[take]]
            tables = (p["e"] @ p["w"]).astype(np.float32)  # WIDTH x 256 x FILTERS
            y = sum(tables[j][x[:, j : j + CHUNK]] for j in range(WIDTH))
            best = y.argmax(axis=1)
            top = np.take_along_axis(y, best[:, None], 1)[:, 0] + p["s"]
            act = np.maximum(top, 0)
            size = np.bincount(which, minlength=len(rows))
            mean_act = np.stack([np.bincount(which, act[:, f], len(rows)) for f in range(FILTERS)], 1) / size[:, None]
            prob = 1 / (1 + np.exp(-np.clip(mean_act @ p["o"] + p["b"], -50, 50)))
            err = (prob - labels[rows]) * weight[rows] / len(rows)
            g = {k: DECAY * v for k, v in p.items()}
            g["o"] = g["o"] + mean_act.T @ err
            g["b"] = np.array([err.sum()])
            back = (err / size)[which][:, None] * p["o"] * (top > 0)
            g["s"] = g["s"] + back.sum(0)
            for j in range(WIDTH):
                at = x[np.arange(len(x))[:, None], best + j].astype(np.int64)  # the byte under each filter's best place
                flat = np.bincount((at * FILTERS + np.arange(FILTERS)).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                g["w"][j] += p["e"].T @ flat
                g["e"] += flat @ p["w"][j].T
            step += 1
            for k in p:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                var[k] = 0.999 * var[k] + 0.001 * g[k] ** 2
                rate = RATE * (1 - step * BATCH / (n * epochs + BATCH)) / (1 - 0.9**step)
                p[k] = p[k] - rate * mean[k] / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    prior = min(max(positive_share, 1e-6), 1 - 1e-6)
    return Model((p["e"] @ p["w"]).astype(np.float32), p["s"].astype(np.float32), p["o"].astype(np.float32), float(p["b"][0]) + math.log(prior / (1 - prior)))


def constant(positive_share: float | None) -> Model:
    """The model where there is nothing to learn: one class alone, or no labels (then 0.5)."""
    prior = 0.5 if positive_share is None else min(max(positive_share, 0.01), 0.99)
    return Model(np.zeros((WIDTH, 256, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), math.log(prior / (1 - prior)))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def draws(n: int, seed: int, epochs: int = EPOCHS, each: int = EPOCH_CHUNKS) -> dict[int, int]:
    """The chunks, of n, that some epoch draws, with a bit for each such epoch: all of them if there are no more than `each`, else
    `each` at random, anew in each epoch."""
    if n <= each:
        return dict.fromkeys(range(n), (1 << epochs) - 1)
    rng = np.random.default_rng(seed)
    found: dict[int, int] = {}
    for e in range(epochs):
        for k in rng.choice(n, each, replace=False).tolist():
            found[k] = found.get(k, 0) | 1 << e
    return found


def _sample_chunks(batches):
    for b in batches:
        ids, labels, out, drawn = [], [], [], []
        for i, q, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()), strict=True):
            text = x.as_py() or b""
            for k, bits in draws(int(layout(np.array([len(text)]))[0][0]), i & 0xFFFFFFFF).items():
                ids.append(i)
                labels.append(q)
                drawn.append(bits)
                out.append(text[k * HOP : k * HOP + CHUNK + WIDTH - 1].ljust(CHUNK + WIDTH - 1, b"\0"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array(out, pa.binary()), pa.array(drawn, pa.int64())], names=["doc_id", "quality", "chunk", "drawn"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Trains on at most `rows` labelled rows of each class outside the held-out fold; each epoch draws EPOCH_CHUNKS chunks of each
    row anew from its whole text.

    Rows are chosen by the order of a hash of their id, so more data give the same kind of sample. Labels that are null, neither 0
    nor 1, or contradict each other for one doc_id are left out; rows that repeat a doc_id count as one text, of all their chunks.
    Without labels, documents, or rows of both classes, the model is constant. The bound on what reaches the driver is
    2 * rows * EPOCHS * EPOCH_CHUNKS * (CHUNK + WIDTH - 1) bytes (about 200 MB; some 20 MB for texts of 2 KB).
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return constant(counts.get(1, 0) / total if total else None)
    chosen = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id").select("doc_id", "quality", "text")
    got = map_arrow(sample, _sample_chunks, "doc_id long, quality int, chunk binary, drawn long").toArrow()
    ids_, labels_ = got["doc_id"].to_numpy(), got["quality"].to_numpy()
    if len(set(labels_.tolist())) < 2:
        return constant(counts[1] / total)
    data = np.frombuffer(b"".join(got["chunk"].to_pylist()), np.uint8).reshape(len(ids_), -1)
    order = np.lexsort((np.arange(len(ids_)), ids_))
    uniq, owner = np.unique(ids_[order], return_inverse=True)
    row_labels = np.zeros(len(uniq), int)
    row_labels[owner] = labels_[order]
    return train(data[order], owner, row_labels, counts[1] / total, got["drawn"].to_numpy()[order])


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double (0 to 1, higher: better) and predicted int, from the whole text of each row.

    A null or empty text is one chunk of padding and gets the model's score for that. Equal texts get equal scores, rows that
    repeat a doc_id are scored one by one, no rows give none; no other column is looked at. Columns score and predicted of docs
    are replaced.
    """
    own = docs.drop("score", "predicted")
    at = own.columns.index("text")
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in own.schema.fields), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = np.empty(b.num_rows)
            texts, size, a = [], 0, 0
            for k, x in enumerate(b.column(at).cast(pa.binary())):
                texts.append(x.as_py() or b"")
                size += len(texts[-1])
                if size > 1 << 20 or k == b.num_rows - 1:  # a few MB of features at a time
                    got[a : k + 1] = scores(texts, held.value)
                    texts, size, a = [], 0, k + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=schema.names)

    return map_arrow(own, run, schema)
