"""Quality classification by a byte-level convolutional network in numpy.

Bytes are embedded in EMBED numbers. FILTERS learned filters look at overlapping chunks of 2 * STEP bytes, one every STEP bytes,
through the whole document; each filter's greatest response over all chunks is kept (max-pooling). A hidden layer combines the
pooled responses and the logarithm of the length into one probability. As only the chunk with the greatest response carries a
gradient, a training step costs little more than a forward pass.

The network is fitted on at most SAMPLE labelled rows, the ones with the smallest hash of their id (documented bound), never on held-out
rows; scoring reads every byte of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl, fold, per_document

EMBED, FILTERS, HIDDEN, STEP = 8, 32, 16, 8
SAMPLE = 6000
EPOCHS, BATCH, RATE = 5, 16, 0.004
#: Small samples are gone through more often, for as many steps.
LEAST_STEPS = 1500
FOLDS = 5
CUTOFF = 0.3


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in rows of STEP, each text padded with zeros to two rows at least; and each text's number of rows."""
    size = np.fromiter((max(2, -(-len(t) // STEP)) for t in texts), np.int64, len(texts))
    a = np.frombuffer(b"".join(t.ljust(int(n) * STEP, b"\0") for t, n in zip(texts, size, strict=True)), np.uint8)
    return a.reshape(-1, STEP), size


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": f32(256, EMBED, scale=0.5),
            "filter": f32(STEP * EMBED, 2 * FILTERS, scale=0.12),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": f32(FILTERS + 1, HIDDEN, scale=0.2),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": f32(HIDDEN, scale=0.3),
            "out_shift": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def pooled(self, rows: np.ndarray, size: np.ndarray, where: bool = False):
        """Greatest response of each filter in each text; with `where` also the chunk it comes from."""
        half = self.p["embed"][rows].reshape(len(rows), -1) @ self.p["filter"]
        r = half[:-1, :FILTERS] + half[1:, FILTERS:]  # a chunk is a row and the next one
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        r[first[1:] - 1] = -np.inf  # would span two texts
        top = np.maximum.reduceat(r, first, axis=0)
        if not where:
            return top + self.p["shift"], None
        same = r == np.repeat(top, size, axis=0)[: len(r)]
        place = np.where(same, np.arange(len(r))[:, None], len(r))
        return top + self.p["shift"], np.minimum.reduceat(place, first, axis=0)

    def forward(self, top: np.ndarray, length: np.ndarray):
        x = np.concatenate([np.maximum(top, 0), length[:, None]], axis=1)
        h = np.tanh(x @ self.p["hidden"] + self.p["hidden_shift"])
        return x, h, 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_shift"], -30, 30)))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        rows, size = blocks(texts)
        top, _ = self.pooled(rows, size)
        return self.forward(top, _length(texts))[2].astype(np.float64)

    def gradient(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        rows, size = blocks(texts)
        top, at = self.pooled(rows, size, where=True)
        x, h, p = self.forward(top, _length(texts))
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"out": h.T @ d, "out_shift": d.sum(keepdims=True)}
        dh = np.outer(d, self.p["out"]) * (1 - h * h)
        g["hidden"], g["hidden_shift"] = x.T @ dh, dh.sum(axis=0)
        dtop = (dh @ self.p["hidden"].T)[:, :FILTERS] * (top > 0)
        g["shift"] = dtop.sum(axis=0)
        g["filter"] = np.zeros_like(self.p["filter"])
        g["embed"] = np.zeros_like(self.p["embed"])
        for f in range(FILTERS):
            for side, column in ((0, f), (1, FILTERS + f)):
                codes = rows[at[:, f] + side]
                seen = self.p["embed"][codes]
                g["filter"][:, column] = seen.reshape(len(codes), -1).T @ dtop[:, f]
                w = self.p["filter"][:, column].reshape(STEP, EMBED)
                np.add.at(g["embed"], codes.reshape(-1), (dtop[:, f, None, None] * w).reshape(-1, EMBED))
        return g


def _length(texts: list[bytes]) -> np.ndarray:
    return np.array([np.log1p(len(t)) / 4 - 1.8 for t in texts], np.float32)


def fit(texts: list[bytes], labels: list[int], seed: int = 11) -> Network:
    """Adam on the logarithmic loss. With one label or none the score is that label's share, or one half."""
    net, y = Network(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    r = np.random.default_rng(seed)
    m, v, t = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    each = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-LEAST_STEPS // each))
    steps = epochs * each
    for _ in range(epochs):
        order = r.permutation(len(y))
        for a in range(0, len(y), BATCH):
            some = order[a : a + BATCH]
            t += 1
            rate = RATE * (0.5 + 0.5 * np.cos(np.pi * t / steps))
            for k, g in net.gradient([texts[i] for i in some], y[some]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.p[k] = net.p[k] - (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, sample: int = SAMPLE) -> Network:
    """Fits on whole texts of at most `sample` labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not chosen:
        return fit([], [])
    asked = spark.createDataFrame([(r["doc_id"], r["quality"]) for r in chosen], "i long, quality int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.join(F.broadcast(asked), F.col("doc_id") == F.col("i")).select("doc_id", "text", "quality").collect()
    found = sorted((r["doc_id"], r["text"], r["quality"]) for r in found)[:sample]
    return fit([t.encode() for _, t, _ in found], [q for _, _, q in found])


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null text counts as empty; an empty text is two blank rows to the network. Repeated rows each get their row. Labels for the same
    document count once (the lower one). Without usable labels every score is one half. An empty table gives an empty result.
    """
    net = train(docs, labels, folds)

    def score(texts: list[bytes]):
        s = np.concatenate([net.score(texts[a:b]) for a, b in chunked(texts, 1 << 20)])
        return [s, (s >= cutoff).astype(np.int32)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    return rows.mapInArrow(per_document(score, OUT, ("doc_id", "held_out")), ddl(OUT))
