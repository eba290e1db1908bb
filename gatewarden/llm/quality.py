"""Quality classifier: a byte-level convolutional network in numpy.

Each text is read as UTF-8 bytes. Learned filters of 8 bytes, placed every 4 bytes, run over overlapping
chunks of 512 bytes that cover the whole document; each filter's largest response in a chunk is kept, the
chunks' features are averaged and a logistic layer gives one probability.

Defined results: a null or empty text is one chunk of padding and gets that chunk's probability; repeated rows are
scored each, alike; extra columns stay, and one named like the score is replaced; an empty training set gives 0.5
for all; an empty table gives an empty table. A very long text is cut into blocks of chunks like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, released, table, utf8

WIDTH, STRIDE, CHUNK, HOP, DIM, FILTERS = 8, 4, 512, 448, 6, 16
PER_CHUNK = (CHUNK - WIDTH) // STRIDE + 1
#: Bounds of the training sample: rows, and bytes of a row that may be in it.
TRAIN_ROWS, TRAIN_ROW_BYTES = 3000, 20_000
#: Chunks scored at once: about 4 MB of windows.
BLOCK_CHUNKS = 128


@dataclass
class Net:
    emb: np.ndarray  # 256 x DIM
    filt: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    out_bias: float


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the overlapping chunks that cover n bytes; one at least."""
    return np.arange(0, max(1, n - CHUNK + HOP), HOP)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each chunk, its first byte) for all rows."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-(np.maximum(sizes - CHUNK, 0)) // HOP) + 1)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, offsets[row] + nth * HOP


def gather(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Chunk bytes, padded with 0 past the end of the row."""
    at = start[:, None] + np.arange(CHUNK)
    inside = at < offsets[row + 1][:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def windows(net: Net, chunks: np.ndarray) -> np.ndarray:
    emb = net.emb[chunks].reshape(len(chunks), CHUNK * DIM)
    view = np.lib.stride_tricks.as_strided(emb, (len(chunks), PER_CHUNK, WIDTH * DIM), (emb.strides[0], STRIDE * DIM * emb.itemsize, emb.itemsize))
    return view.reshape(-1, WIDTH * DIM)


def features(net: Net, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(max-pooled responses, where each maximum stands)."""
    resp = (windows(net, chunks) @ net.filt).reshape(len(chunks), PER_CHUNK, FILTERS)
    best = resp.argmax(axis=1)
    top = np.take_along_axis(resp, best[:, None, :], axis=1)[:, 0, :]
    return np.maximum(top + net.bias, 0), best


def score_rows(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    row, start = cut(data, offsets)
    total = np.zeros((len(offsets) - 1, FILTERS))
    for a in range(0, len(row), BLOCK_CHUNKS):
        part = slice(a, a + BLOCK_CHUNKS)
        f, _ = features(net, gather(data, offsets, row[part], start[part]))
        np.add.at(total, row[part], f)
    mean = total / np.maximum(1, np.bincount(row, minlength=len(total)))[:, None]
    return 1 / (1 + np.exp(-np.clip(mean @ net.out + net.out_bias, -30, 30)))


def train(texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the logistic loss, with the gradient through the maxima."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.2, (WIDTH * DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, FILTERS).astype(np.float32), 0.0)
    if not len(texts) or labels.min() == labels.max():
        net.out[:] = 0
        net.out_bias = 0.0 if not len(texts) else (2.0 if labels[0] else -2.0)
        return net
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    row, start = cut(data, offsets)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = [net.emb, net.filt, net.bias, net.out, np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), 32):
            docs = order[a : a + 32]
            pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            chunks = gather(data, offsets, row[pick], start[pick])
            f, best = features(net, chunks)
            n = np.bincount(owner, minlength=len(docs)).astype(np.float32)
            mean = np.zeros((len(docs), FILTERS), np.float32)
            np.add.at(mean, owner, f)
            mean /= n[:, None]
            p = 1 / (1 + np.exp(-np.clip(mean @ net.out + params[4][0], -30, 30)))
            g = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            g_feat = (g[:, None] * net.out)[owner] / n[owner][:, None] * (f > 0)
            at = best * STRIDE
            took = chunks[np.arange(len(chunks))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
            x = net.emb[took].reshape(len(chunks), FILTERS, WIDTH * DIM)
            g_filt = np.einsum("cf,cfx->xf", g_feat, x)
            g_emb = np.zeros_like(net.emb)
            np.add.at(g_emb, took, (g_feat[:, :, None] * net.filt.T[None]).reshape(len(chunks), FILTERS, WIDTH, DIM))
            grads = [g_emb, g_filt, g_feat.sum(0), mean.T @ g + 1e-4 * net.out, np.array([g.sum()], np.float32)]
            step += 1
            for k, (p_, g_) in enumerate(zip(params, grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g_
                v[k] = 0.999 * v[k] + 0.001 * g_ * g_
                p_ -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.out_bias = float(params[4][0])
    return net


def training_rows(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, row_bytes: int = TRAIN_ROW_BYTES) -> DataFrame:
    """The bounded training sample: at most `rows` labelled documents in order of a hash of doc_id.

    Only ids are put in order; the chosen ids, `rows` at most, are broadcast to the documents.
    """
    known = labels.where(F.col("quality").isin(0, 1) & open_for_training(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    docs = documents.where(F.octet_length("text") <= row_bytes).select("doc_id", "text")
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id")).select("text", "quality")


def open_for_training(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Net:
    got = training_rows(documents, labels, rows).toPandas()
    return train(list(got["text"]), got["quality"].to_numpy(dtype=np.float32))


def with_quality(documents: DataFrame, net: Net, text: str = "text", score: str = "quality_score") -> DataFrame:
    """documents with the probability of good quality of each whole text; a column of that name is replaced."""
    documents = documents.drop(score)

    def run(batches):
        for b in batches:
            data, offsets = utf8(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_rows(net, data, offsets), pa.float64())], names=[*b.schema.names, score])

    return documents.mapInArrow(released(run), plus(documents, **{score: "double"}))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    slim = with_quality(docs, net).select("doc_id", (~F.coalesce(open_for_training(F.col("doc_id")), F.lit(True))).alias("held_out"), F.col("quality_score").alias("score"))
    return slim.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
