"""SimHash near-duplicates by an inverted index of positional bytes with count filtering.

A fingerprint has 64 bits, so 8 bytes at fixed positions. Two fingerprints that differ in at most two bits
differ in at most two bytes and so share at least SHARED = 6 positional bytes. The index posts each distinct
fingerprint under its positional bytes. A posting list of one byte would hold 1/256 of all fingerprints, so bytes are
posted in fixed combinations: the 8 positions make four blocks of two bytes; with two bytes altered at least two blocks
are whole, so every such pair meets in at least one of the 6 lists of two whole blocks (4 bytes). For each pair that meets,
the shared positional bytes are tallied, pairs below SHARED are dropped, the rest is verified bit by bit.

Long lists are not paired as they stand: a list over SPLIT members is posted anew with two more bytes (again every
wanted pair meets, as of the other four bytes two are whole), and a list that is still over SPLIT looks its
members' altered forms up directly: its members are equal in six bytes, so the at most two altered bits lie in the
other 16, and there are 136 forms. No list is dropped or cut. Copies are collapsed to one fingerprint beforehand.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import ddl, per_document
from crosswind.llm.components import components
from crosswind.session import durable

SEED = 42
WORDS = 3
BITS = 2
SHARED = 8 - BITS
#: Members of a posting list that are compared with one another; longer lists are split.
SPLIT = 64


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The 64-bit fingerprint of one text: majority bits of its shingles' hashes; no words gives 0."""
    tokens = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    n = len(tokens)
    if n <= words:
        joined = [b" ".join(tokens)] if n else []
        hashes = [xxhash.xxh64_intdigest(x, SEED) for x in joined]
    else:
        line = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


OUT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; null text counts as empty."""
    run = per_document(lambda texts: [[_signed(fingerprint(t)) for t in texts]], OUT)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl(OUT))


def _byte(fp: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255))


def _post(rows: DataFrame, blocks, key: list[str]) -> DataFrame:
    """One row per combination: the key holds the combination's number and its bytes."""

    def packed(positions) -> Column:
        out = F.lit(0).cast("long")
        for p in positions:
            out = out * 256 + _byte("fp", p)
        return out

    kinds = [F.struct(F.lit(i).alias("c"), packed(positions).alias("k")) for i, positions in enumerate(blocks)]
    return rows.select("fp", *key, F.explode(F.array(*kinds)).alias("p")).select("fp", *key, "p.c", "p.k")


def _meet(lists: DataFrame, key: list[str]) -> DataFrame:
    """Pairs that share a list, with the tally of shared positional bytes as filter and the bits as proof."""
    other = lists.select(*key, F.col("fp").alias("gp"))
    pairs = lists.join(other, key).where("fp < gp")
    shared = sum(((_byte("fp", i) == _byte("gp", i)).cast("int") for i in range(8)), F.lit(0))
    return pairs.where(shared >= SHARED).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("gp"))) <= BITS).select("fp", "gp")


def links(distinct: DataFrame, split: int = SPLIT) -> DataFrame:
    """All pairs (fp < gp) of distinct fingerprints that differ in at most BITS bits. `distinct` has fp, each once."""
    two = [(0, 1), (2, 3), (4, 5), (6, 7)]
    first = [a + b for a, b in combinations(two, 2)]
    posted = _post(distinct.select("fp"), first, [])
    sizes = posted.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    lists = durable(posted.join(sizes, ["c", "k"]))
    out = _meet(lists.where(F.col("n") <= split).select("fp", "c", "k"), ["c", "k"])

    long = lists.where(F.col("n") > split).select("fp", F.col("c").alias("c1"), F.col("k").alias("k1"))
    halves = []
    for i, whole in enumerate(first):
        rest = [p for p in range(8) if p not in whole]
        halves.append((F.col("c1") == i, list(combinations(rest, 2)), rest))
    again = None
    for hit, pairs, _ in halves:
        part = _post(long.where(hit), pairs, ["c1", "k1"])
        again = part if again is None else again.union(part)
    key = ["c1", "k1", "c", "k"]
    sizes = again.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    again = durable(again.join(sizes, key))
    out = out.union(_meet(again.where(F.col("n") <= split).select("fp", *key), key))

    forms = []
    for i, whole in enumerate(first):
        rest = [p for p in range(8) if p not in whole]
        for j, more in enumerate(combinations(rest, 2)):
            free = [8 * p + b for p in rest if p not in more for b in range(8)]
            masks = [1 << a for a in free] + [(1 << a) | (1 << b) for a, b in combinations(free, 2)]
            masks = [F.lit(_signed(m)) for m in masks]
            forms.append(F.when((F.col("c1") == i) & (F.col("c") == j), F.array(*masks)))
    dense = again.where(F.col("n") > split)
    probes = dense.select("fp", F.explode(F.coalesce(*forms)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("gp")).where("fp < gp")
    out = out.union(probes.join(distinct.select(F.col("fp").alias("gp")), "gp", "left_semi").select("fp", "gp"))
    return out.distinct()


def grouped(each: DataFrame) -> DataFrame:
    """(fp, component_id) of all distinct fingerprints of `each` (doc_id, fp); the smallest doc_id names a component."""
    distinct = durable(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    group = components(links(distinct).select(F.col("fp").alias("u"), F.col("gp").alias("v")))
    member = distinct.join(group.withColumnsRenamed({"id": "fp", "component_id": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = durable(member)
    names = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return member.join(names, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows each get their row.
    A null doc_id takes part in links but is never the smallest; a component of null ids alone is named null. An empty
    table gives an empty result.
    """
    each = durable(fingerprints(docs))
    return each.join(grouped(each), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component with all its columns: the smallest doc_id, then the smallest text hash; of repeated rows one.

    Null and empty texts are one text; null ids come last. Columns of any name pass through. An empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = pa.schema([*OUT, ("h", pa.int64())])
    run = per_document(lambda texts: [[_signed(fingerprint(t)) for t in texts]], out, ("doc_id", "h"))
    each = durable(rows.withColumn("h", F.xxhash64("text", F.coalesce(F.octet_length("text"), F.lit(-1)))).mapInArrow(run, ddl(out)))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("best")
    stay = durable(each.join(grouped(each), "fp").groupBy("root").agg(best).select("best.doc_id", "best.h"))
    repeats = each.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    stay = durable(stay.join(repeats, same(stay, repeats), "left").select(stay["doc_id"].alias("_i"), stay["h"].alias("_h"), F.col("n").isNotNull().alias("_many")))
    # the row travels as one struct, so that its names cannot meet those used here
    key = F.xxhash64(F.col("text").cast("string"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)))
    here = docs.select(F.struct(*docs.columns).alias("_doc"), key.alias("_key"))
    hit = here.join(stay, (F.col("_key") == F.col("_h")) & F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_i")))
    # rows that repeat as a whole are the only case of more than one row for an id and text
    return hit.where("not _many").select("_doc.*").union(hit.where("_many").dropDuplicates(["_i", "_h"]).select("_doc.*"))
