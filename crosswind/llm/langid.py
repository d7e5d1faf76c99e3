"""Language identification by nearest centroids.

A text is lower-cased, everything in ASCII but letters becomes a space, and its overlapping three-byte strings are counted in DIMS
hashed places. Counts are damped by a square root, weighted by the inverse document frequency over all training
documents, and normalised. Each language has up to CENTROIDS centroids, found by spherical k-means over a sample of at most SAMPLE
training documents per language, the ones with the smallest hash of their id (documented bound). A text gets the language of the
centroid with the highest cosine. It is rejected if it has no letter, or if that cosine is below REJECT times the
lowest centile that training documents of that language reach among themselves. A text with few distinct strings cannot come as near to
a centroid as a long one, so below FULL distinct strings the bound sinks with the square root of their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl, fold, per_document, texts_of

DIMS = 4096
CENTROIDS = 4
SAMPLE = 600
SHARES = 16
REJECT = 0.5
FULL = 200
UNKNOWN = "und"
FOLDS = 5

_LETTERS = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def counts(texts: list[bytes]) -> np.ndarray:
    """Texts x DIMS counts of three-byte strings, a text framed by spaces; strings of spaces alone are left out."""
    clean = [b" " + t.decode().lower().encode().translate(_LETTERS) + b" " for t in texts]
    a = np.frombuffer(b"".join(clean), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, clean), np.int64, len(clean))
    if len(a) < 3:
        return np.zeros((len(texts), DIMS), np.float32)
    gram = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
    owner = np.repeat(np.arange(len(texts)), sizes)
    good = (owner[:-2] == owner[2:]) & (gram != 0x202020)
    place = (gram[good] * np.uint32(0x9E3779B1)) >> np.uint32(20)
    return np.bincount(owner[:-2][good] * DIMS + place, minlength=len(texts) * DIMS).reshape(len(texts), DIMS).astype(np.float32)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(c) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def cluster(v: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the vector nearest the mean and then the ones farthest from all starts."""
    starts = [int((v @ v.mean(axis=0)).argmax())]
    while len(starts) < min(k, len(v)):
        starts.append(int((v @ v[starts].T).max(axis=1).argmin()))
    c = v[starts]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, samples: dict[str, list[bytes]]):
        self.idf = idf.astype(np.float32)
        self.langs = sorted(samples)
        centroids, self.owner, floors = [], [], []
        for n, lang in enumerate(self.langs):
            v = np.concatenate([weighted(counts(samples[lang][a:b]), self.idf) for a, b in chunked(samples[lang])])
            c = cluster(v)
            centroids.append(c)
            self.owner += [n] * len(c)
            floors.append(REJECT * float(np.percentile((v @ c.T).max(axis=1), 1)))
        self.centroids = np.concatenate(centroids).T.copy() if centroids else None
        self.owner, self.floors = np.array(self.owner, int), np.array(floors)

    def predict(self, texts: list[bytes]) -> list[list]:
        """Languages, cosines in 0 .. 1, and whether each text is rejected."""
        letters = np.array([has_letter(t) for t in texts], bool)
        if self.centroids is None:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)]
        c = counts(texts)
        near = weighted(c, self.idf) @ self.centroids
        room = np.sqrt(np.minimum((c > 0).sum(axis=1) / FULL, 1.0))
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(float)
        lang = self.owner[best]
        rejected = ~letters | (cosine < self.floors[lang] * room)
        names = [self.langs[n] if yes else UNKNOWN for n, yes in zip(lang, letters, strict=True)]
        return [names, np.where(letters, cosine, 0.0).tolist(), rejected.tolist()]


def _frequencies(batches):
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for a, b in chunked(texts):
            total += (counts(texts[a:b]) > 0).sum(axis=0)
            n += b - a
    if n:
        yield pa.RecordBatch.from_pydict({"place": np.arange(-1, DIMS), "n": np.concatenate(([n], total))}, schema=pa.schema([("place", pa.int32()), ("n", pa.int64())]))


def train(docs: DataFrame, folds: int = FOLDS) -> Model:
    """Learns from text and non-null lang of the documents whose fold is not 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((fold(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # DIMS + 1 rows whatever the input
    df = {r["place"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + df.get(-1, 0)) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))) + 1
    from pyspark.sql import Window

    # The smallest of each share of a language first, so that the last step ranks SHARES * SAMPLE rows of it at most, however many tasks read the table.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("size")]
    chosen = rows.select("doc_id", "lang", F.octet_length("text").alias("size"), F.pmod(F.hash("doc_id"), F.lit(SHARES)).alias("share"))
    for by in (["lang", "share"], ["lang"]):
        chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= SAMPLE).drop("rank")
    ids = [(r["doc_id"], r["lang"], r["size"]) for r in chosen.collect()]  # at most SAMPLE for each language
    samples: dict[str, list[bytes]] = {}
    if ids:
        asked = spark.createDataFrame(sorted(set(ids), key=str), "doc_id long, lang string, size int").withColumnsRenamed({"doc_id": "i", "lang": "l", "size": "s"})
        found = rows.join(F.broadcast(asked), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("lang") == F.col("l")) & (F.octet_length("text") == F.col("s")))
        for r in sorted(found.select("lang", "text").collect(), key=lambda r: r["text"]):
            if (t := r["text"].encode()) and has_letter(t):
                samples.setdefault(r["lang"], []).append(t)
    return Model(idf, samples)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def predict(docs: DataFrame, model: Model, folds: int = FOLDS) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    return rows.mapInArrow(per_document(model.predict, OUT, ("doc_id", "held_out")), ddl(OUT))


def identify(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    `lang_pred` is a learned language, or `und` if the text is null or has no letter; then score is 0. `rejected` marks those and texts far from
    all centroids. Ties go to the first language by name. Without training rows all is `und`. An empty table gives an empty result.
    """
    return predict(docs, train(docs, folds), folds)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns they came with."""
    model = train(docs)

    def keep(batches):
        for batch in batches:
            texts = texts_of(batch.column("text"))
            flags = [x for a, b in chunked(texts) for x in model.predict(texts[a:b])[2]]
            yield batch.filter(pa.array([not f for f in flags], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
