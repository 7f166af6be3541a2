"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over the whole document, and each
filter's strongest answer is taken in every chunk of ``2 * HALF`` places; chunks
overlap by half.  The mean and the maximum over all chunks pass a small hidden
layer and become one probability.  Long documents are read in blocks that give
the same result as one pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, pick, remainder, with_result

DIM, FILTERS, WIDTH, STRIDE, HIDDEN = 8, 32, 12, 4, 16
#: Places of half a chunk.
HALF = 8
#: Labelled documents that are learned from, at most (about; chosen by hash of
#: the id), and the longest that is; training reads a random stretch of each
#: per epoch, scoring reads everything.
MAX_LABELLED, MAX_BYTES, STRETCH, EPOCHS, BATCH = 2_500, 1 << 20, 4_096, 8, 16
THRESHOLD = 0.3
#: Half chunks that are computed at once.
_BLOCK = 2_048


def held_out(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))


def _windows(data: bytes, embed: np.ndarray) -> np.ndarray:
    """The embedded bytes at every place: (half chunks * HALF, WIDTH * DIM)."""
    step = STRIDE * HALF
    n = max(1, -(-len(data) // step)) * step
    padded = np.zeros(n + WIDTH - STRIDE, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)[:len(padded)]
    x = embed[padded].reshape(-1)
    places = np.lib.stride_tricks.sliding_window_view(x, WIDTH * DIM)[::STRIDE * DIM]
    return np.ascontiguousarray(places)


class Network:
    """Weights, scoring of whole texts, and one training step."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.w = {
            "embed": normal(256, DIM, scale=0.5),
            "filters": normal(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN ** -0.5),
            "out_bias": np.zeros((), np.float32),
        }

    def _half_maxima(self, data: bytes) -> np.ndarray:
        answers = _windows(data, self.w["embed"]) @ self.w["filters"]
        return np.maximum(answers.reshape(-1, HALF, FILTERS).max(1) + self.w["bias"], 0)

    def pooled(self, data: bytes) -> np.ndarray:
        """Mean and maximum over the overlapping chunks of the whole document."""
        step, total, n = STRIDE * HALF, np.zeros(FILTERS), 0
        top, last = np.zeros(FILTERS, np.float32), None
        for at in range(0, max(len(data), 1), step * _BLOCK):
            # Filters at a block's end see the first bytes of the next one.
            got = self._half_maxima(data[at:at + step * _BLOCK]) if at + step * _BLOCK >= len(data) else \
                self._half_maxima_inner(data[at:at + step * _BLOCK + WIDTH - STRIDE])
            if last is not None:
                got = np.concatenate([last, got])
            chunks = np.maximum(got[:-1], got[1:]) if len(got) > 1 else got[:0]
            total += chunks.sum(0, dtype=float)
            n += len(chunks)
            top = np.maximum(top, got.max(0))
            last = got[-1:]
        if not n:  # one half chunk is the whole document
            total, n = last[0].astype(float), 1
        return np.concatenate([total / n, top]).astype(np.float32)

    def _half_maxima_inner(self, data: bytes) -> np.ndarray:
        return self._half_maxima(data)[:_BLOCK]

    def score(self, text: str) -> float:
        w = self.w
        h = np.tanh(self.pooled(text.encode("utf-8", "surrogatepass")) @ w["hidden"] + w["hidden_bias"])
        return float(1 / (1 + np.exp(-np.float64(h @ w["out"] + w["out_bias"]))))

    def gradients(self, data: bytes, label: int, weight: float) -> dict[str, np.ndarray]:
        """Of the weighted log loss of one stretch."""
        w, step = self.w, STRIDE * HALF
        x = _windows(data, w["embed"])
        answers = (x @ w["filters"]).reshape(-1, HALF, FILTERS)
        place = answers.argmax(1)
        half = np.take_along_axis(answers, place[:, None], 1)[:, 0] + w["bias"]
        halves = np.maximum(half, 0)
        if len(halves) > 1:
            first = halves[:-1] >= halves[1:]
            mean = np.where(first, halves[:-1], halves[1:]).mean(0)
        else:
            mean = halves[0]
        top_at = halves.argmax(0)
        pooled = np.concatenate([mean, halves[top_at, np.arange(FILTERS)]])
        h = np.tanh(pooled @ w["hidden"] + w["hidden_bias"])
        d_out = np.float32(weight * (1 / (1 + np.exp(-(h @ w["out"] + w["out_bias"]))) - label))
        d_h = d_out * w["out"] * (1 - h * h)
        d_pooled = w["hidden"] @ d_h
        d_half = np.zeros_like(halves)
        if len(halves) > 1:
            share = d_pooled[:FILTERS] / np.float32(len(halves) - 1)
            d_half[:-1] += first * share
            d_half[1:] += ~first * share
        else:
            d_half[0] += d_pooled[:FILTERS]
        d_half[top_at, np.arange(FILTERS)] += d_pooled[FILTERS:]
        d_half *= half > 0
        d_answers = np.zeros_like(answers)
        np.put_along_axis(d_answers, place[:, None], d_half[:, None], 1)
        d_answers = d_answers.reshape(-1, FILTERS)
        d_x = (d_answers @ w["filters"].T).reshape(-1, WIDTH, DIM)
        # Back to bytes: window p covers bytes p * STRIDE to p * STRIDE + WIDTH.
        d_bytes = np.zeros((len(d_x) * STRIDE + WIDTH - STRIDE, DIM), np.float32)
        for k in range(0, WIDTH, STRIDE):
            d_bytes[k:k + len(d_x) * STRIDE] += d_x[:, k:k + STRIDE].reshape(-1, DIM)
        codes = np.zeros(len(d_bytes), np.uint8)
        codes[:len(data)] = np.frombuffer(data, np.uint8)[:len(codes)]
        d_embed = np.stack([np.bincount(codes, d_bytes[:, k], 256) for k in range(DIM)], 1)
        return {"embed": d_embed, "filters": x.T @ d_answers, "bias": d_half.sum(0), "hidden": np.outer(pooled, d_h),
                "hidden_bias": d_h, "out": d_out * h, "out_bias": d_out}


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Adam over shuffled batches; every epoch reads another stretch of long texts."""
    net, r = Network(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    share = float(np.mean(labels)) if labels else 0.5
    if not 0 < share < 1:  # one kind of label only, or none: the score is its share
        net.w["out"][:] = 0
        net.w["out_bias"] = np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    t, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            batch, t = order[lo:lo + BATCH], t + 1
            total: dict = {}
            for i in batch.tolist():
                data = texts[i]
                at = int(r.integers(0, max(1, len(data) - STRETCH + 1)))
                for k, g in net.gradients(data[at:at + STRETCH], labels[i], 1 / len(batch)).items():
                    total[k] = total[k] + g if k in total else g
            rate = 0.006 * min(1, t / 30) * (1 - 0.95 * t / steps)
            for k, g in total.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                change = rate * (mean[k] / (1 - 0.9 ** t)) / (np.sqrt(square[k] / (1 - 0.99 ** t)) + 1e-7)
                net.w[k] = (net.w[k] * np.float32(1 - rate * 0.02) - change).astype(np.float32)
    return net


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Network:
    """A network learned from labelled documents that are not held out.

    A document with several labels counts with the lowest; rows without id or
    label teach nothing, nor do texts over MAX_BYTES.
    """
    marks = (pick(labels, "doc_id", "quality").dropna().filter(remainder(F.col("doc_id"), 5) != 0)
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    marks = marks.filter(by_hash(F.col("doc_id"), marks.count(), max_labelled))
    # The ids are bounded by max_labelled, so they may be sent to all tasks.
    rows = pick(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id").filter(F.octet_length("text") <= MAX_BYTES)
    got = sorted((r["doc_id"], r["quality"], r["text"]) for r in rows.collect())
    return train([t.encode("utf-8", "surrogatepass") for _, _, t in got], [int(q > 0) for _, q, _ in got])


def rate(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text scores as the empty text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels) if network is None else network)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    rows, name = with_result(pick(docs, "doc_id", "text"), score.asNondeterministic(), "text")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(name).alias("score"),
                       (F.col(name) >= THRESHOLD).cast("int").alias("predicted"))
