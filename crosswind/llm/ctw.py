"""Language-model scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z) and read as bytes with one end symbol (0xFF, which UTF-8 never uses). Each symbol is decided
in eight binary steps. A node of the tree is a context of d previous bytes, d = 0 .. DEPTH, with the bits of the symbol decided so
far; it holds how often a zero and a one followed in the training texts. Its Krichevsky-Trofimov estimate of all it has
seen is Pe, and the weighted probability of the tree below it is

    Pw(node) = Pe(node)                                   at depth DEPTH
    Pw(node) = 1/2 Pe(node) + 1/2 prod Pw(longer contexts)    above it.

A bit's probability mixes the estimates of all depths on its path: at each depth the own estimate has the weight
Pe / (Pe + prod Pw), the longer contexts have the rest. A context that training never saw passes the whole weight to the last one it did see.
Summed over bits and bytes this is the code length; scores are log10 probabilities.

Nothing of the corpus is broadcast but the nodes of depths 0 and 1, at most 257 x 255 rows. A symbol's probability depends on the symbol
and its DEPTH preceding bytes alone, so the model is one value for each distinct string of DEPTH + 1 bytes (a gram). Grams, and
words by a 63-bit hash for the base score, share one space of keys. Each task adds up the keys of about BLOCK_BYTES of text at a time
before they are summed by key. To score, documents are dealt to blocks of about BLOCK_BYTES; a block asks for each of its
distinct keys once, the values are joined to that, and the block scores its texts. Values are computed by groups of grams with the same last two
context bytes, so no group is larger than the distinct grams below one context, however often these occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl, fold, texts_of
from crosswind.session import durable

DEPTH = 5
END = 0xFF
#: Text that a task holds at a time; with the distinct keys of its chunks and their counts it takes about seven times as much.
BLOCK_BYTES = 24 << 20
#: Text that is scored at a time.
SCORED_BYTES = 1 << 19
#: Rows of a record batch of keys.
SLICE = 1 << 16
FOLDS, HELD_OUT = 5, 1
TOP = 2  # contexts shorter than this are the shared top of the tree


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol of the texts with its context as one number (nearest byte first, the symbol last), and its text's index."""
    pad = bytes([END]) * DEPTH
    blob = np.frombuffer(pad + pad.join(t.lower() + b"\xff" for t in texts), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    g = np.zeros(len(blob) - DEPTH, np.uint64)
    for d in range(DEPTH, -1, -1):  # d = 0 is the symbol, then the bytes before it
        shift = 0 if d == 0 else 8 * (DEPTH + 1 - d)
        g |= blob[DEPTH - d : len(blob) - d].astype(np.uint64) << np.uint64(shift)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return g[np.arange(len(owner)) + owner * DEPTH], owner


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in a sorted array."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1)) if len(x) else np.zeros(0, np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of (keys, counts) by key, in key order."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_slices(texts: list[bytes], trains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams of the texts, in order, and how often they occur in texts that train, some SLICE at a time.

    Every chunk's distinct grams wait in order; they are merged range by range, so that no merge holds them all twice.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in chunked(texts):
        for seen in (True, False):
            some = [t for t, y in zip(texts[a:b], trains[a:b], strict=True) if y == seen]
            if some:
                g = np.sort(grams(some)[0])
                at = _runs(g)
                n = np.diff(np.append(at, len(g))) if seen else np.zeros(len(at), np.int64)
                parts.append((g[at], n.astype(np.int32)))
    if not parts:
        return
    largest = max((k for k, _ in parts), key=len)
    step = max(1, SLICE * len(largest) // max(sum(len(k) for k, _ in parts), 1))
    cuts = [np.concatenate(([0], np.searchsorted(k, largest[step::step]), [len(k)])) for k, _ in parts]
    for i in range(len(cuts[0]) - 1):
        keys, n = _merged([(k[c[i] : c[i + 1]], n[c[i] : c[i + 1]]) for (k, n), c in zip(parts, cuts, strict=True)])
        if len(keys):
            yield keys, n.astype(np.int64)


def count_grams(texts: list[bytes], trains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All slices of ``count_slices`` together."""
    found = list(count_slices(texts, trains))
    return (np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


WORD = 1 << 63  # the top bit tells words from grams; as a long, words are negative


def word_keys(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) | WORD for w in words), np.uint64, len(words))


COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _sums(texts: list[bytes], trains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Distinct grams and words of the texts, with their number in those that train, in slices."""
    words: Counter = Counter()
    rest: set = set()
    for text, yes in zip(texts, trains, strict=True):
        (words if yes else rest).update(text.lower().split())
    rest.difference_update(words)
    of_words = ((word_keys(list(words)), np.fromiter(words.values(), np.int64, len(words))), (word_keys(list(rest)), np.zeros(len(rest), np.int64)))
    del words, rest
    for k, c in chain(of_words, count_slices(texts, trains)):
        for at in range(0, len(k), SLICE):
            part = [pa.array(k[at : at + SLICE].view(np.int64)), pa.array(c[at : at + SLICE].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(part, schema=COUNTS)


def _partial(limit: int):
    def run(batches):
        texts, trains, size = [], [], 0
        for batch in batches:
            for t, y in zip(texts_of(batch.column("text")), batch.column("trains").to_pylist(), strict=True):
                texts.append(t)
                trains.append(y)
                size += len(t) + 1
                if size >= limit:
                    yield from _sums(texts, np.array(trains, bool))
                    texts, trains, size = [], [], 0
        if texts:
            yield from _sums(texts, np.array(trains, bool))

    return run


ASKED = pa.schema([("block", pa.int32()), ("key", pa.int64())])


def _block_keys(t: pa.Table) -> pa.Table:
    """Each distinct gram and word of one block once."""
    texts, words, parts = texts_of(t.column("text")), set(), []
    for a, b in chunked(texts):
        parts.append(np.unique(grams(texts[a:b])[0]))
        if len(parts) > 8:
            parts = [np.unique(np.concatenate(parts))]
        for text in texts[a:b]:
            words.update(text.lower().split())
    keys = np.concatenate([np.unique(np.concatenate(parts)), word_keys(list(words))])
    return pa.table([pa.array(np.full(len(keys), t.column("block")[0].as_py()), pa.int32()), pa.array(keys.view(np.int64))], schema=ASKED)


def _log_gamma_half(n: np.ndarray, shift: float) -> np.ndarray:
    """log Gamma(n + shift), by Stirling's series after eight steps of the recurrence."""
    x = n + shift
    y = x + 8
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.ones_like(x)
    for k in range(8):
        product *= x + k
    return out - np.log(product)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return _log_gamma_half(zeros, 0.5) + _log_gamma_half(ones, 0.5) - _log_gamma_half(zeros + ones, 1.0) - 1.1447298858494002


class Level:
    """All nodes of one context length: their keys (context, depth in the symbol, bits so far), counts and weights."""

    def __init__(self, d: int, keys: np.ndarray, n: np.ndarray):
        """keys: distinct context + symbol, sorted, the context in front."""
        self.d = d
        context, symbol = keys >> np.uint64(8), keys & np.uint64(255)
        parts = []
        for k in range(8):
            prefix = symbol >> np.uint64(8 - k) | np.uint64(1 << k)  # a leading one marks the number of bits
            parts.append((context << np.uint64(8) | prefix, n * (symbol >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64), n))
        keys = np.concatenate([p[0] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = _runs(keys)
        self.keys = keys[at]
        ones = np.concatenate([p[1] for p in parts])[order]
        every = np.concatenate([p[2] for p in parts])[order]
        self.ones = np.add.reduceat(ones, at) if len(at) else ones
        self.zeros = (np.add.reduceat(every, at) if len(at) else every) - self.ones
        self.pe = log_kt(self.zeros, self.ones)
        self.pw = self.pe
        self.own = np.ones(len(self.keys))

    def parent_keys(self) -> np.ndarray:
        """The same nodes under the context that is one byte shorter (the farthest byte leaves)."""
        return self.keys >> np.uint64(16) << np.uint64(8) | self.keys & np.uint64(255)

    def weigh(self, children: np.ndarray) -> None:
        """children: the sum of log Pw over the longer contexts of each node."""
        self.pw = np.logaddexp(self.pe, children) - np.log(2.0)
        self.own = 1 / (1 + np.exp(np.clip(children - self.pe, -700, 700)))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def _shorten(keys: np.ndarray, d: int) -> np.ndarray:
    """Grams with only the d nearest context bytes."""
    return keys >> np.uint64(8 * (DEPTH + 1 - d)) << np.uint64(8) | keys & np.uint64(255)


def levels(keys: np.ndarray, n: np.ndarray, top: int = 0) -> list[Level]:
    """The trained tree of sorted grams with their counts, for contexts of `top` to DEPTH bytes."""
    keys, n = keys[n > 0], n[n > 0]
    out: list[Level] = []
    for d in range(DEPTH, top - 1, -1):
        level = Level(d, *_merged([(_shorten(keys, d), n)]))
        if out:
            child = out[-1]
            at, _ = level.find(child.parent_keys())
            level.weigh(np.bincount(at, child.pw, len(level.keys)))
        out.append(level)
    return out[::-1]


def mix(keys: np.ndarray, tree: list[Level], upper: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of each gram's symbol in its context. `tree`: levels from the shortest context on."""
    symbol = keys & np.uint64(255)
    out = np.zeros(len(keys))
    for k in range(8):
        bit = (symbol >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        prefix = symbol >> np.uint64(8 - k) | np.uint64(1 << k)
        p, left = np.zeros(len(keys)), np.ones(len(keys))
        last = np.full(len(keys), 0.5)
        for level in tree:
            at, there = level.find(_shorten(keys, level.d) & ~np.uint64(255) | prefix)
            if not len(level.keys):
                break
            kt = (np.where(bit, level.ones[at], level.zeros[at]) + 0.5) / (level.zeros[at] + level.ones[at] + 1.0)
            last = np.where(there, kt, last)
            own = np.where(there, level.own[at], 0.0)
            p += left * own * kt
            left *= 1 - own
        out += np.log10(p + left * last)
    return out


NODES = "d int, key long, zeros long, ones long, pw double"
VALUES = "gram long, value double"


def _subtree_roots(f: pd.DataFrame) -> pd.DataFrame:
    """The nodes at depth TOP of one group, for the tree above."""
    f = f.sort_values("gram")
    level = levels(f["gram"].to_numpy(np.uint64), f["n"].to_numpy(np.int64), TOP)[0]
    return pd.DataFrame({"d": TOP, "key": level.keys.astype(np.int64), "zeros": level.zeros, "ones": level.ones, "pw": level.pw})


def _top_tree(nodes: pd.DataFrame) -> list[Level]:
    """Depths 0 .. TOP - 1 from the depth-TOP nodes, summed by their parents beforehand."""
    out: list[Level] = []
    for d in range(TOP - 1, -1, -1):
        level = Level.__new__(Level)
        level.d = d
        f = nodes.sort_values("key")
        level.keys = f["key"].to_numpy(np.uint64)
        level.zeros, level.ones = f["zeros"].to_numpy(np.int64), f["ones"].to_numpy(np.int64)
        level.pe = log_kt(level.zeros, level.ones)
        level.weigh(f["pw"].to_numpy())
        out.append(level)
        nodes = pd.DataFrame({"key": level.parent_keys(), "zeros": level.zeros, "ones": level.ones, "pw": level.pw}).groupby("key", as_index=False).sum()
    return out[::-1]


def _gram_values(top: list[Level]):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("gram")
        keys, n = f["gram"].to_numpy(np.uint64), f["n"].to_numpy(np.int64)
        return pd.DataFrame({"gram": keys.astype(np.int64), "value": mix(keys, top + levels(keys, n, TOP))})

    return run


def gram_values(counts: DataFrame) -> DataFrame:
    """(gram, n) of all grams -> (gram, value), the model's log10 probability of the symbol after its context."""
    group = F.shiftright("gram", 8 * (DEPTH + 1 - TOP)).alias("group")
    trained = counts.where("n > 0").groupBy(group).applyInPandas(_subtree_roots, NODES)
    parent = F.shiftleft(F.shiftright("key", 16), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    # at most 256 contexts of one byte with 255 nodes each
    nodes = trained.groupBy(parent.alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("pw").alias("pw")).toPandas()
    return counts.groupBy(group).applyInPandas(_gram_values(_top_tree(nodes)), VALUES)


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
)


def _score_block(below: float, ends: int):
    """below: the denominator of the base estimate; ends: how often the end token was seen."""

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        texts = texts_of(docs.column("text"))
        keys, v = values.column("key").to_numpy().view(np.uint64), values.column("value").to_numpy()
        order = np.argsort(keys)
        keys, v = keys[order], v[order]
        score, base, n_tokens, n_known = (np.zeros(len(texts)) for _ in range(4))
        for a, b in chunked(texts, SCORED_BYTES):
            x, owner = grams(texts[a:b])
            x = np.sort(x << np.uint64(16) | owner.astype(np.uint64))  # 48 bits of gram, 16 of owner
            gram, owner = x >> np.uint64(16), (x & np.uint64(65535)).astype(np.int64)
            at = _runs(gram)
            each = v[np.searchsorted(keys, gram[at])]
            score[a:b] = np.bincount(owner, np.repeat(each, np.diff(np.append(at, len(gram)))), b - a)
            split = [t.lower().split() for t in texts[a:b]]
            place = {w: i for i, w in enumerate({w for words in split for w in words})}
            seen = v[np.searchsorted(keys, word_keys(list(place)))]
            worth = np.log10((seen + 0.5) / below)
            for i, words in enumerate(split, a):
                index = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
                n_tokens[i] = len(words) + 1
                n_known[i] = (seen[index] > 0).sum() + (ends > 0)
                base[i] = worth[index].sum() + np.log10((ends + 0.5) / below)
        size = np.fromiter((len(t) + 1 for t in texts), np.float64, len(texts))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": pa.array(~docs.column("trains").to_numpy(zero_copy_only=False).astype(bool)), "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64),
                "base_score": base, "score": score, "bits_per_byte": -score * np.log2(10.0) / size,
            }
        ).cast(SCORED)

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null text counts as empty: one end token, and one end symbol. Repeated rows count as often as they occur. A table without
    training rows gives the symbols even odds bit by bit and each token the smoothing alone. An empty table gives an empty result.
    """
    trains = fold(F.col("doc_id"), folds) != held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), trains.alias("trains"))
    size = rows.agg(F.sum(F.octet_length("text") + 1), F.sum(F.col("trains").cast("long"))).first()
    blocks = max(1, -(-(size[0] or 0) // block_bytes))
    sums = durable(rows.select("text", "trains").mapInArrow(_partial(block_bytes), ddl(COUNTS)).groupBy("key").agg(F.sum("n").alias("n")))
    words = sums.where("key < 0")
    total = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    ends = size[1] or 0
    n, distinct = (total[0] or 0) + ends, total[1] + (ends > 0)
    below = n + 0.5 * (distinct + 1)
    # a gram's value travels with the digits of a float; a word's is its count
    values = gram_values(sums.where("key >= 0").withColumnRenamed("key", "gram")).select(F.col("gram").alias("key"), F.col("value").cast("float").cast("double").alias("value"))
    values = values.union(words.select("key", F.col("n").cast("double")))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(blocks)).cast("int"))
    asked = dealt.groupBy("block").applyInArrow(_block_keys, ddl(ASKED))
    answers = asked.join(values, "key").select("block", "key", "value")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(below, ends), ddl(SCORED))
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))
