"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded, filters slide over them, and each filter's largest answer is kept per chunk.  Chunks
of CHUNK bytes overlap by half and cover the whole document.  The mean and the maximum of the chunks'
answers go through one linear layer to a probability.  Everything is learnt together by gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import give_back, held_out, labelled_texts, slices, small_batches, table, utf8

#: Labelled documents per class that the network learns from, about.
SAMPLE = 1000
EPOCHS, RATE, BATCH = 6, 0.01, 32
DEPTH, WIDTH, STRIDE, FILTERS = 8, 8, 2, 16
#: Bytes of a chunk; the next begins half a chunk later.
CHUNK = 512
HALF = CHUNK // 2
CUT = 0.3
#: Bytes that go through the filters at once.
STEP_BYTES = 1 << 19


@dataclass
class Network:
    """Embedding (257 x DEPTH, the last for padding), filters (taps x inputs x FILTERS), and the linear layer."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.weights, self.offset]


def new_network(seed: int = 3) -> Network:
    r = np.random.default_rng(seed)
    make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        make(257, DEPTH, scale=0.5), make(WIDTH // STRIDE, STRIDE * DEPTH, FILTERS, scale=(1 / (WIDTH * DEPTH)) ** 0.5),
        np.zeros(FILTERS, np.float32), make(2 * FILTERS, scale=0.1), np.zeros(1, np.float32),
    )


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each behind WIDTH times 256, so that no filter sees two texts, and padded likewise to whole
    half-chunks; and their half-chunks' numbers."""
    halves = -(-(np.array([len(t) for t in texts]) + WIDTH) // HALF)
    data = np.full(int(halves.sum()) * HALF + WIDTH, 256, np.int32)
    at = 0
    for text, n in zip(texts, halves):
        data[at + WIDTH : at + WIDTH + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * HALF
    return data, halves


def _filter(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs in steps of STRIDE bytes, and the filters' answers at each step: one product per tap, no copies."""
    inputs = net.embedding[data].reshape(-1, STRIDE * DEPTH)
    n = (len(data) - WIDTH) // STRIDE
    out = inputs[:n] @ net.filters[0]
    for tap in range(1, WIDTH // STRIDE):
        out += inputs[tap : tap + n] @ net.filters[tap]
    return inputs, out


def _pool(halves_max: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk maxima from those of half-chunks (a text of one half-chunk is one chunk), the texts they belong to,
    and the half-chunk that each maximum came from."""
    first = np.concatenate(([0], np.cumsum(halves)[:-1]))
    chunks = np.maximum(1, halves - 1)
    owner = np.repeat(np.arange(len(halves)), chunks)
    left = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks) + first[owner]
    right = np.where(halves[owner] > 1, left + 1, left)
    takes_right = halves_max[right] > halves_max[left]
    return np.maximum(halves_max[left], halves_max[right]), owner, np.where(takes_right, right[:, None], left[:, None])


def _document(net: Network, chunk_max: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document features (mean, maximum over chunks), the number of chunks, and the chunk of each maximum."""
    active = np.maximum(chunk_max + net.bias, 0)
    starts = np.searchsorted(owner, np.arange(n))
    counts = np.bincount(owner, minlength=n)
    mean = np.add.reduceat(active, starts, axis=0) / counts[:, None]
    top = np.maximum.reduceat(active, starts, axis=0)
    return np.hstack([mean, top]).astype(np.float32), counts, starts


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each whole text; the empty text has one too.  Six decimals: the order of additions
    in a matrix product follows the batch, and further digits would too."""
    out = np.zeros(len(texts))
    for a, b in slices(np.array([len(t) + HALF for t in texts]), STEP_BYTES):
        data, halves = _layout(texts[a:b])
        best = []
        for lo in range(0, len(data) - WIDTH, STEP_BYTES):  # a very long text alone passes in pieces
            hi = min(lo + STEP_BYTES, len(data) - WIDTH)
            answers = _filter(net, data[lo : hi + WIDTH])[1]
            best.append(answers.reshape(-1, HALF // STRIDE, FILTERS).max(1))
        chunk_max, owner, _ = _pool(np.concatenate(best), halves)
        features, _, _ = _document(net, chunk_max, owner, b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))
    return np.round(out, 6)


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data, halves = _layout(texts)
    inputs, answers = _filter(net, data)
    cells = answers.reshape(-1, HALF // STRIDE, FILTERS)
    where = cells.argmax(1)
    chunk_max, owner, source = _pool(np.take_along_axis(cells, where[:, None], 1)[:, 0], halves)
    features, counts, starts = _document(net, chunk_max, owner, len(texts))
    p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.offset, -30, 30)))
    slope = ((p - labels) / len(texts)).astype(np.float32)
    d_features = slope[:, None] * net.weights
    active = np.maximum(chunk_max + net.bias, 0)
    is_top = active == features[owner, FILTERS:]
    first_top = is_top & (np.cumsum(is_top, 0) - (np.cumsum(is_top, 0) - is_top)[starts][owner] == 1)
    d_chunk = (d_features[:, :FILTERS] / counts[:, None])[owner] + d_features[owner, FILTERS:] * first_top
    d_chunk *= active > 0
    d_filters, d_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    for f in range(FILTERS):
        live = np.flatnonzero(d_chunk[:, f])
        half = source[live, f]
        step = half * (HALF // STRIDE) + where[half, f]
        d = d_chunk[live, f]
        for tap in range(WIDTH // STRIDE):
            d_filters[tap, :, f] = d @ inputs[step + tap]
            back = d[:, None] * net.filters[tap, :, f]
            for k in range(STRIDE):
                np.add.at(d_embedding, data[(step + tap) * STRIDE + k], back[:, k * DEPTH : (k + 1) * DEPTH])
    return [d_embedding, d_filters, d_chunk.sum(0), features.T @ slope, np.array([slope.sum()], np.float32)]


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 3) -> Network:
    """Adam on shuffled batches, both classes weighing the same.  One class only: its share is the score."""
    net, r = new_network(seed), np.random.default_rng(seed)
    if len(set(labels.tolist())) < 2:
        net.weights[:] = 0
        net.offset[:] = 0 if not len(labels) else (4 if labels[0] else -4)
        return net
    by_class = [np.flatnonzero(labels == k) for k in (0, 1)]
    size = max(map(len, by_class))
    parts, step = net.parts(), 0
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for _ in range(epochs):
        order = np.stack([np.resize(r.permutation(rows), size) for rows in by_class], 1).ravel()
        for lo in range(0, len(order), BATCH):
            rows, step = order[lo : lo + BATCH], step + 1
            for p, g, m, v in zip(parts, _gradients(net, [texts[i] for i in rows], labels[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Network:
    """A network from about `per_class` documents of each label outside the held-out fold."""
    rows = labelled_texts(documents, labels, "quality", per_class).toPandas().sort_values("doc_id")
    return train(utf8(rows["text"]), rows["label"].to_numpy(np.float32))


def quality_score(text: Column, net: Network) -> Column:
    """Probability that a whole text is of good quality.  Null counts as the empty text.  Equal texts score alike."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(net, utf8(texts)))
        give_back()

    return run(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = table(spark, sf_dir, "documents")
    net = fit(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
