"""What the operators share: folds, whole texts as bytes, bounded chunks of rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into arrays at a time.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds).cast("int")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunked(texts: list[bytes], limit: int = CHUNK_BYTES, rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes; a longer text stands alone and stays whole."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t) > limit or i - start >= rows):
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def per_document(score, out: pa.Schema, keep: tuple[str, ...] = ("doc_id",), text: str = "text"):
    """A mapInArrow function: `score` gets the texts of a chunk and returns one list per new column."""
    names = [n for n in out.names if n not in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(text))
            for a, b in chunked(texts):
                cols = dict(zip(names, score(texts[a:b]), strict=True))
                cols |= {k: batch.column(k).slice(a, b - a) for k in keep}
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in names else cols[f.name].cast(f.type) for f in out], schema=out)

    return run


def ddl(schema: pa.Schema) -> str:
    """The same schema for Spark."""
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema)
