"""Token counts through a cache keyed by digests.

Content is normalised no further than null to the empty text, since a tokenizer may see any other change. Its SHA-256 and
the digest of the tokenizer (model file, library and its version) are the key of a stored count. Only contents without a stored count are
encoded, each once, and appended to the cache; the counts of all rows are then read from it. The cache is a Parquet folder, so a
second run, or a run over more documents, encodes only what is new.
"""

from __future__ import annotations

import hashlib
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl
from crosswind.session import durable, scratch_path

LIMIT = 4096
COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
STORED = "digest binary, tokenizer string, n_tokens long"


class Tokenizer:
    """A tokenizer file by its kind: .json for tokenizers, .model for sentencepiece. Its bytes travel to the workers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        self.library = "tokenizers" if path.endswith(".json") else "sentencepiece"
        self.digest = hashlib.sha256(self.data + f"{self.library} {version(self.library)}".encode()).hexdigest()

    def counter(self):
        """A function from texts to their numbers of tokens, without added special tokens."""
        if self.library == "tokenizers":
            from tokenizers import Tokenizer as Json

            t = Json.from_str(self.data.decode())
            t.no_truncation()
            t.no_padding()
            return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=self.data)
        return lambda texts: [len(ids) for ids in sp.encode(texts, add_bos=False, add_eos=False, num_threads=1)]


def _encode(tokenizer: Tokenizer):
    def run(batches):
        count, last = tokenizer.counter(), None
        for batch in batches:
            names = batch.column("digest").to_pylist()
            batch = batch.filter(pa.array([own != before for own, before in zip(names, [last, *names], strict=False)], pa.bool_()))
            last = names[-1] if names else last
            texts, digests = batch.column("text").to_pylist(), batch.column("digest")
            for a, b in chunked(texts, 1 << 20):
                yield pa.RecordBatch.from_arrays([digests.slice(a, b - a), pa.array(count(texts[a:b]), pa.int64())], schema=COUNTS)

    return run


def count_tokens(docs: DataFrame, model: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    `model` is the path of the tokenizer file, `cache` the folder of stored counts in a store all executors share (a new one in the
    shared folder if not given). Null text counts as empty. Repeated rows and copies are encoded once.
    """
    spark = docs.sparkSession
    tokenizer = Tokenizer(model)
    cache = cache or scratch_path(spark, "token-counts")
    spark.createDataFrame([], STORED).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(STORED).parquet(cache).where(F.col("tokenizer") == tokenizer.digest).select("digest", "n_tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = durable(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    # one speaker for each distinct miss; rows that repeat it come side by side, ordered by digest, and are encoded once
    misses = keys.join(stored(), "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("speaker"))
    asked = rows.join(misses, "digest").where(F.col("doc_id").eqNullSafe(F.col("speaker"))).select("digest", "text")
    fresh = asked.mapInArrow(_encode(tokenizer), ddl(COUNTS)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(tokenizer.digest).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return keys.join(stored(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
