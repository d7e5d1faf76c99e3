"""Removal of repeated strings of LENGTH bytes by a logarithmic family of suffix indexes.

Sorting every suffix of every text would move each byte several hundred times. The suffix arrays here are sparse: of all
LENGTH - ANCHOR + 1 places in a LENGTH-byte string where ANCHOR bytes start, the one with the smallest hash (the leftmost such) is
the string's anchor. The choice depends on the string alone, so two equal strings have their anchors at the same offset. A
maximal run of string starts with one anchor is a segment; about one byte in 170 is an anchor.

* Each batch of documents gets a suffix array of its anchored suffixes, ordered by the digest of the ANCHOR bytes since only
  equality matters, with the number of its suffixes and its least and greatest segment digest.
* The array enters the family as level 0. Levels of equal size are merge-scanned: one pass over both in order gives the level of twice
  the size, in which a suffix met on both sides has its numbers added. So n batches leave at most log2(n) + 1 levels and each
  suffix is rewritten at most log2(n) times; a last scan over the levels that are left gives all suffixes met twice, the hits.
* Hits are settled exactly. If all segments around an anchor are equal, all their strings repeat. A segment that occurs twice repeats as
  a whole. Of other segments each distinct one is compared with those around the same anchor: what two have in
  common to the left and right of it, if LENGTH bytes or more, repeats. Around an anchor with more than PAIRED distinct segments no pairs
  are made: there each segment gives the 128-bit digests of its strings, and a digest met twice is a string that repeats. All strings of a
  segment overlap in the anchor, so what they cover is one range, and a minimum and a maximum describe it.

Counts and extremes are combined before each shuffle, so no group of equal passages is collected. Segments are equal if two
64-bit digests (anchor and segment) are.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl, texts_of
from crosswind.session import durable

LENGTH = 400
ANCHOR = 64
BATCHES = 2
#: Distinct segments around one anchor that are compared pair by pair.
PAIRED = 64

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the worker's life up to a chunk's size."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def _order(blob: np.ndarray, anchor: int) -> np.ndarray:
    """For each start of `anchor` bytes: 32 bits of hash, then the place, so that the minimum is the leftmost smallest."""
    up, down = _power(len(blob) + 1)
    sums = np.zeros(len(blob) + 1, np.uint64)
    np.cumsum(_BYTE[blob] * up[: len(blob)], out=sums[1:])
    h = (sums[anchor:] - sums[:-anchor]) * down[: len(blob) - anchor + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours: running minima from both ends of blocks of that width."""
    n = len(x)
    blocks = np.full((-(-n // width), width), np.iinfo(np.uint64).max, np.uint64)
    blocks.reshape(-1)[:n] = x
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(texts: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> list[tuple[int, int, int, int]]:
    """(text, anchor place, first start, last start) of all segments, in order."""
    out: list[tuple[int, int, int, int]] = []
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    if not long:
        return out
    sizes = np.array([len(texts[i]) for i in long])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    blob = np.frombuffer(b"".join(texts[i] for i in long), np.uint8)
    at = (_sliding_min(_order(blob, anchor), length - anchor + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(long)), sizes)[: len(at)]
    inside = np.arange(len(at)) + length <= (first + sizes)[owner]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    edge = np.flatnonzero(new | ~inside)
    ends = np.append(edge, len(at))[np.searchsorted(edge, starts, side="right")] - 1
    who = owner[starts]
    shift = first[who]
    for w, a, b, c in zip(who.tolist(), (at[starts] - shift).tolist(), (starts - shift).tolist(), (ends - shift).tolist(), strict=True):
        out.append((long[w], a, b, c))
    return out


SCAN = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("suffix", pa.int64()), ("segment", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]
)


def _joined(spans) -> list[tuple[int, int]]:
    """Overlapping or touching ranges made one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan(length: int, anchor: int):
    """One row per document (with sha), one per anchored suffix (with suffix), and one per range that repeats inside a document.

    Segments that a document holds more than once, as periodic texts do, become one suffix that stands for two, and ranges.
    """

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            texts, keys, ids = texts_of(batch.column("text")), batch.column("key").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in chunked(texts):
                part = texts[a:b]
                rows = [(keys[a + i], ids[a + i], len(t), hashlib.sha256(t).hexdigest(), None, None, None, None, None, None) for i, t in enumerate(part)]
                for i, own in groupby(segments(part, length, anchor), key=lambda f: f[0]):
                    view, seen = memoryview(part[i]), {}
                    for _, m, s, e in own:
                        name = digest(view[m : m + anchor]) - (1 << 63), digest(view[s : e + length]) - (1 << 63)
                        seen.setdefault(name, []).append((m, s, e))
                    more = []
                    for (suffix, segment), places in seen.items():
                        m, s, e = places[0]
                        rows.append((keys[a + i], ids[a + i], None, None, suffix, segment, s, e, m, min(len(places), 2)))
                        more += [(s, e + length) for _, s, e in places[1:]]
                    rows += [(keys[a + i], ids[a + i], None, None, None, None, s, e, None, None) for s, e in _joined(more)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCAN, strict=True)], schema=SCAN)

    return run


def scan(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The anchored suffixes of `docs` (key, doc_id, text), written once."""
    return durable(docs.mapInArrow(_scan(length, anchor), ddl(SCAN)))


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (suffix, n, least, most) with each suffix once, in order. `most` is null where it equals `least`."""
    most = F.max(F.coalesce("most", "least"))
    least = F.min("least")
    return rows.groupBy("suffix").agg(F.sum("n").alias("n"), least.alias("least"), F.when(most > least, most).alias("most")).sortWithinPartitions("suffix")


class IndexFamily:
    """Levels of suffix arrays whose sizes double."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def add(self, batch: DataFrame) -> None:
        """batch: (suffix, segment, n). Merges it with all full levels below the first free one in one pass."""
        rows, size = batch.select("suffix", F.col("n").cast("long").alias("n"), F.col("segment").alias("least"), F.lit(None).cast("long").alias("most")), 0
        while size in self.levels:
            rows = rows.union(self.levels.pop(size))
            size += 1
        self.levels[size] = durable(_ordered(rows))

    def hits(self) -> DataFrame:
        """(suffix, same): suffixes that occur more than once in all levels; same: all their segments are equal."""
        levels = list(self.levels.values())
        rows = levels[0]
        for level in levels[1:]:
            rows = rows.union(level)
        rows = rows if len(levels) == 1 else _ordered(rows)
        return rows.where("n > 1").select("suffix", F.col("most").isNull().alias("same"))


PIECES = pa.schema([("suffix", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("at", pa.int32()), ("many", pa.bool_()), ("piece", pa.binary())])
SPANS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
STRINGS = pa.schema([("digest", pa.binary()), ("key", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("start", pa.int32()), ("many", pa.bool_())])


def _asked(schema: pa.Schema, rows_of):
    """Rows that `rows_of` makes of a text and one of its asked segments, in batches of bounded size."""

    def run(batches):
        rows: list[tuple] = []
        for batch in batches:
            docs = zip(texts_of(batch.column("text")), batch.column("key").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ask").to_pylist(), strict=True)
            for text, key, doc, ask in docs:
                for x in ask:
                    rows += rows_of(memoryview(text), key, doc, x)
                    if len(rows) > 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The length of the common start of two byte arrays."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def repeats_of(group: list[tuple], length: int) -> list[tuple[int, int, int, int]]:
    """(key, doc_id, a, b) that pairs of pieces around one anchor show to repeat; pieces as in PIECES."""
    sides = []
    for _, _, _, lo, at, _, piece in group:
        x = np.frombuffer(piece, np.uint8)
        sides.append((x[: at - lo][::-1], x[at - lo :]))
    found: list[list[tuple[int, int]]] = [[] for _ in group]
    for i in range(len(group)):
        for j in range(i):
            if group[i][5] and group[j][5]:
                continue
            left, right = _common(sides[i][0], sides[j][0]), _common(sides[i][1], sides[j][1])
            if left + right >= length:
                for k in (i, j):
                    at = group[k][4]
                    found[k].append((at - left, at + right))
    return [(g[1], g[2], a, b) for g, f in zip(group, found, strict=True) if not g[5] for a, b in _joined(f)]


def _paired(length: int):
    """Rows come in the order of suffix; a group that goes on in the next batch is held over. Groups have at most PAIRED rows."""

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(n).to_pylist() for n in PIECES.names), strict=True):
                if held and held[0][0] != row[0]:
                    out += repeats_of(held, length)
                    held = []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPANS, strict=True)], schema=SPANS)
        if out := repeats_of(held, length) if held else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPANS, strict=True)], schema=SPANS)

    return run


REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text without the spans, the bytes removed and the number of maximal runs."""
    runs = _joined(spans)
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in runs), len(runs)


def _remove(batches):
    for batch in batches:
        texts, marks = texts_of(batch.column("text")), batch.column("marks").to_pylist()
        rows = [cut(t, [(m["a"], m["b"]) for m in ms or []]) for t, ms in zip(texts, marks, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string()), pa.array([r[0] for r in rows], pa.binary()),
            ],
            schema=REMOVED,
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES, texts: bool = True, paired: int = PAIRED) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `texts` also kept, the remaining bytes.

    Null text counts as empty. Texts shorter than `length` lose nothing. A repeated row is a second occurrence of all its
    strings. `kept` is null for documents that lose nothing. An empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    found = scan(rows.select("key", "doc_id", "text"), length, anchor)
    suffixes = found.where("suffix is not null").select("key", "doc_id", "suffix", "segment", "lo", "hi", "at", "n")
    family = IndexFamily()
    for i in range(batches):
        family.add(suffixes.where(F.pmod(F.col("key"), F.lit(batches)) == i))
    hit = durable(suffixes.join(family.hits(), "suffix"))

    end = (F.col("hi") + length).alias("b")
    whole = found.where("suffix is null and sha is null").select("key", "doc_id", F.col("lo").alias("a"), F.col("hi").alias("b"))
    whole = whole.union(hit.where("same").select("key", "doc_id", F.col("lo").alias("a"), end))
    mixed = hit.where("not same")
    # one speaker for each distinct segment; `many` says that the whole segment repeats
    distinct = mixed.groupBy("suffix", "segment").agg(F.min(F.struct("key", "doc_id", "lo", "hi", "at")).alias("who"), F.sum("n").alias("n"))
    whole = whole.union(mixed.join(distinct.where("n > 1").select("suffix", "segment"), ["suffix", "segment"], "left_semi").select("key", "doc_id", F.col("lo").alias("a"), end))
    wide = distinct.groupBy("suffix").agg((F.count("*") > paired).alias("wide"))
    ask = distinct.join(wide, "suffix").select("suffix", "who.*", (F.col("n") > 1).alias("many"), "wide")
    asked = ask.groupBy("key", "doc_id").agg(F.collect_list(F.struct("suffix", "lo", "hi", "at", "many", "wide")).alias("ask"))
    touched = whole.select("key", "doc_id").union(hit.select("key", "doc_id")).distinct().join(asked, ["key", "doc_id"], "left")
    same_id = F.col("doc_id").eqNullSafe(F.col("d"))
    held = durable(rows.join(touched.select("key", F.col("doc_id").alias("d"), "ask"), "key").where(same_id).drop("d"))

    some = held.where("ask is not null").select("text", "key", "doc_id", "ask")
    pieces = some.withColumn("ask", F.filter("ask", lambda x: ~x["wide"])).where("size(ask) > 0")
    pieces = pieces.mapInArrow(_asked(PIECES, lambda t, k, d, x: [(x["suffix"], k, d, x["lo"], x["at"], x["many"], bytes(t[x["lo"] : x["hi"] + length]))]), ddl(PIECES))
    pairs = pieces.repartition("suffix").sortWithinPartitions("suffix", "key", "doc_id", "lo").mapInArrow(_paired(length), ddl(SPANS))
    strings = some.withColumn("ask", F.filter("ask", lambda x: x["wide"])).where("size(ask) > 0")
    digest = xxhash.xxh3_128_digest
    strings = durable(strings.mapInArrow(_asked(STRINGS, lambda t, k, d, x: [(digest(t[s : s + length]), k, d, x["lo"], s, x["many"]) for s in range(x["lo"], x["hi"] + 1)]), ddl(STRINGS)))
    twice = strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    shown = strings.where("not many").join(twice, "digest", "left_semi").groupBy("key", "doc_id", "lo").agg(F.min("start").alias("a"), (F.max("start") + length).alias("b"))
    marks = whole.union(pairs).union(shown.select("key", "doc_id", "a", "b")).groupBy("key", "doc_id").agg(F.collect_set(F.struct("a", "b")).alias("marks"))
    marks = durable(marks.select("key", F.col("doc_id").alias("d"), "marks"))

    changed = held.select("key", "doc_id", "text").join(marks, "key").where(same_id)
    changed = changed.select("doc_id", "text", "marks").mapInArrow(_remove, ddl(REMOVED))
    plain = found.where("sha is not null").join(marks.select(F.col("key").alias("k"), "d"), (F.col("key") == F.col("k")) & same_id, "left_anti")
    plain = plain.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    out = changed.union(plain)
    return out if texts else out.drop("kept")
