"""A byte-level convolutional network for quality, in numpy.

The bytes of a whole text are cut into overlapping chunks. Learned filters slide over
the embedded bytes of each chunk, and their largest responses are the chunk's
features; a second learned layer reads these, its largest responses over all chunks
are the document's features, and a logistic unit makes one probability of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold_of, sample
from .session import bound_batches
from .textbytes import runs

CHUNK, STEP = 256, 240
WIDTH, STRIDE = 8, 2
EMBED, FILTERS, HIDDEN = 4, 24, 16
PAD = 256
#: Bounds of the labelled sample: rows, and bytes of all their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
THRESHOLD = 0.3
CHUNKS_AT_ONCE = 512


def chunks_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of each text of a run (text i is data[bounds[i]:bounds[i + 1]]), and the first chunk of each; at least one a text."""
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-np.maximum(sizes - (CHUNK - STEP), 0) // STEP))
    first = np.concatenate(([0], np.cumsum(counts)))
    text = np.repeat(np.arange(len(sizes)), counts)
    start = bounds[text] + (np.arange(first[-1]) - first[text]) * STEP
    padded = np.concatenate((data.astype(np.int16), np.full(CHUNK, PAD, np.int16)))
    out = padded[start[:, None] + np.arange(CHUNK)[None, :]]
    out[(start[:, None] + np.arange(CHUNK)[None, :]) >= bounds[text + 1][:, None]] = PAD
    return out, first


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            draw(0.5, PAD + 1, EMBED), draw((WIDTH * EMBED) ** -0.5 * 1.5, WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32),
            draw(FILTERS**-0.5, FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN**-0.5, HIDDEN), np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.filter_bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def respond(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and the window it comes from."""
        n = len(chunks)
        x = np.ascontiguousarray(self.embed[chunks])
        windows = (CHUNK - WIDTH) // STRIDE + 1
        a, b, c = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, windows, WIDTH * EMBED), (a, STRIDE * b, c))
        y = view.reshape(n * windows, WIDTH * EMBED) @ self.filters
        y = y.reshape(n, windows, FILTERS)
        at = y.argmax(1)
        return np.take_along_axis(y, at[:, None, :], 1)[:, 0] + self.filter_bias, at

    def chunk_features(self, chunks: np.ndarray) -> np.ndarray:
        """What the logistic unit sees of each chunk."""
        out = [np.maximum(np.maximum(self.respond(chunks[i : i + CHUNKS_AT_ONCE])[0], 0) @ self.hidden + self.hidden_bias, 0) for i in range(0, len(chunks), CHUNKS_AT_ONCE)]
        return np.concatenate(out)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One probability per text."""
        chunks, first = chunks_of(data, bounds)
        top = np.maximum.reduceat(self.chunk_features(chunks), first[:-1], axis=0)
        return 1 / (1 + np.exp(-np.clip((top @ self.out + self.out_bias).astype(np.float64), -30, 30)))

    def gradient(self, chunks: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        raw, at = zip(*(self.respond(chunks[i : i + CHUNKS_AT_ONCE]) for i in range(0, len(chunks), CHUNKS_AT_ONCE)), strict=True)
        raw, at = np.concatenate(raw), np.concatenate(at)
        h = np.maximum(raw, 0)
        z_raw = h @ self.hidden + self.hidden_bias
        z = np.maximum(z_raw, 0)
        top = np.maximum.reduceat(z, first[:-1], axis=0)
        p = 1 / (1 + np.exp(-np.clip(top @ self.out + self.out_bias, -30, 30)))
        d_out = ((p - label) * weight / len(label)).astype(np.float32)
        g_out, g_out_bias = top.T @ d_out, np.array([d_out.sum()], np.float32)
        d_z = np.zeros_like(z)
        for i in range(len(label)):
            part = z[first[i] : first[i + 1]]
            rows = part.argmax(0)
            d_z[first[i] + rows, np.arange(HIDDEN)] += d_out[i] * self.out
        d_z[z_raw <= 0] = 0
        used = np.flatnonzero(np.abs(d_z).sum(1) > 0)
        d_z, h_used = d_z[used], h[used]
        g_hidden, g_hidden_bias = h_used.T @ d_z, d_z.sum(0)
        d_h = (d_z @ self.hidden.T) * (raw[used] > 0)
        byte = chunks[used[:, None, None], at[used][:, :, None] * STRIDE + np.arange(WIDTH)[None, None, :]]
        seen = self.embed[byte].reshape(len(used), FILTERS, WIDTH * EMBED)
        g_filters = np.einsum("nf,nfk->kf", d_h, seen)
        d_x = (d_h[:, :, None] * self.filters.T[None]).reshape(-1, EMBED)
        flat = byte.reshape(-1)
        g_embed = np.stack([np.bincount(flat, d_x[:, e], PAD + 1) for e in range(EMBED)], 1).astype(np.float32)
        return [g_embed, g_filters, d_h.sum(0), g_hidden, g_hidden_bias, g_out, g_out_bias]


def fit(rows: list[tuple[str, int]], epochs: int = 10, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the log loss; a falling rate. ``rows``: text and label 0 or 1."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if not rows or len({y for _, y in rows}) < 2:
        net.out[:] = 0
        net.out_bias[:] = 0 if not rows else (4 if rows[0][1] else -4)
        return net
    raw = [np.frombuffer(t.encode(), np.uint8) for t, _ in rows]
    labels = np.array([y for _, y in rows], np.float32)
    share = labels.mean()
    weight = np.where(labels == 1, 1, min(4.0, (share / (1 - share)) ** 0.5)).astype(np.float32)
    means = [np.zeros_like(p) for p in net.parts()]
    squares = [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            bounds = np.concatenate(([0], np.cumsum([len(raw[j]) for j in pick])))
            chunks, first = chunks_of(np.concatenate([raw[j] for j in pick]), bounds)
            step += 1
            pace = rate * (1 - step / (steps + 1)) ** 0.9
            for p, g, m, s in zip(net.parts(), net.gradient(chunks, first, labels[pick], weight[pick]), means, squares, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Network:
    """Fitted on a sample of the labelled rows that are not held out."""
    return fit([(text, y) for _, text, y in sample(docs, labels, "quality", rows, most_bytes, fold_of(F.col("doc_id")) != 0)])


def score_documents(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """Scores each whole text. One row per row of ``docs``, null or repeated ids included.

    Only doc_id and text are read. A null text counts as empty; an empty text is one
    chunk of padding. ``held_out`` is null for a null id.
    """
    bound_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1), 1 << 18):
                ids = batch.column(0).slice(run.first, run.last - run.first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(net.score(run.data, run.bounds))], names=["doc_id", "score"])

    scored = read.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
