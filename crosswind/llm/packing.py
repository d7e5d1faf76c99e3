"""Sum-of-squares packing of tokenised documents into sequences of a fixed capacity.

A document is its token ids and one end id. Only documents longer than the capacity are cut, into full pieces and a rest. Pieces that are
full make a sequence each; the others are dealt at random into blocks of about BLOCK pieces, and a block is packed by itself: pieces come
from long to short, and each goes to the open bin, or to a new one, that leaves the sum over all gaps of (open bins with that gap)² smallest;
equal sums leave the smaller gap. Bins that end up full are done. The pieces of bins that are still open meet those of other blocks in the
next round, so the waste is that of one block in the end, whatever the input. The rounds stop at one block, or when a round saves no bin.

White space of ASCII parts words for this tokenizer family (it is dropped and nothing joins across it), so each distinct word of a
worker is encoded once and texts are put together from the words' ids; a test holds this against the library on whole texts. Where the file's
rules leave a word of lower-case letters alone, the library's model gets it without them.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import CHUNK_BYTES, chunked, ddl, texts_of
from crosswind.session import durable

CAPACITY = 4096
END = 1
#: Pieces that one task packs together.
BLOCK = 8192
#: Words a worker keeps, about 200 MB; beyond it the cache starts anew. Longer words are encoded each time.
CACHED_WORDS = 1 << 20
CACHED_BYTES = 48

PIECES = pa.schema(
    [("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
)
PLACES = pa.schema([("key", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("place", pa.int64()), ("open", pa.bool_())])

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: A file with these rules lower-cases and parts a letter from the signs after it.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RULES = ("NFC", "Replace", "Lowercase")
#: Signs that may follow a word's last letter, ASCII or Latin-1; no apostrophe among them, and no < as in a special string.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")


class WordEncoder:
    """Little-endian 32-bit ids of texts, by a tokenizers file that drops white space and joins nothing across it."""

    _held: dict[bytes, "WordEncoder"] = {}

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parting = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.parting = parting[0] if len(parting) == 1 else None
        self.words: dict[bytes, bytes] = {}
        file = json.loads(data)
        self.tails = _parts_signs(file)
        self.bare = self.tokenizer.model if self.tails and _keeps_letters(file) else None

    @classmethod
    def of(cls, data: bytes) -> "WordEncoder":
        """One for each worker process and file."""
        if data not in cls._held:
            cls._held = {data: cls(data)}
        return cls._held[data]

    def _encoded(self, texts: list[bytes]) -> list[bytes]:
        if self.bare and all(t.isalpha() and t.islower() for t in texts):
            # The rules leave lower-case ASCII letters as they are, so they go to the library's model at once.
            found = [[t.id for t in self.bare.tokenize(w.decode())] for w in texts]
            return [struct.pack(f"<{len(ids)}I", *ids) for ids in found]
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _new_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words side by side in one text, parted by a lone zero, which no word among them holds."""
        odd = [w for w in words if b"0" in w or len(w) > CACHED_BYTES or self.parting is None]
        yield from zip(odd, self._encoded(odd), strict=True)
        plain = list(set(words).difference(odd)) if odd else words
        if self.bare:
            letters = [w for w in plain if w.isalpha() and w.islower()]
            yield from zip(letters, self._encoded(letters), strict=True)
            plain = list(set(plain).difference(letters))
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            raw = self._encoded([b" 0 ".join(part)])[0]
            cut = np.flatnonzero(np.frombuffer(raw, "<u4") == self.parting) * 4
            if len(cut) != len(part) - 1:
                raise ValueError("the tokenizer does not part words at white space")
            yield from zip(part, [raw[a:b] for a, b in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)], strict=True)], strict=True)

    def _learn(self, unseen: set[bytes]) -> None:
        """Ids of new words; where signs are parted from letters, words that differ in signs at the end or in case are encoded once."""
        known, parted, plain = self.words, [], unseen
        if self.tails:
            known[b""], plain = b"", set()
            for w in unseen:
                stem = w.rstrip(_SIGNS) if len(w) <= CACHED_BYTES else b""
                if not stem.isalpha():
                    ends = stem[-1:].isalpha() or (stem[-2:-1] == b"\xc3" and stem[-1] not in b"\x97\xb7")
                    if not ends or b"<" in stem or b"0" in stem:
                        plain.add(w)
                        continue
                low = stem.lower() if stem.isascii() else stem
                plain.add(low)
                if low != w:
                    tail = w[len(stem) :]
                    plain.add(tail)
                    parted.append((w, low, tail))
            plain = plain.difference(known)
        known.update(self._new_words(list(plain)))
        for w, stem, tail in parted:
            known[w] = known[stem] + known[tail]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        split = [t.split() for t in texts]
        known = self.words
        unseen = set(chain.from_iterable(split)).difference(known)
        self._learn(unseen)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in unseen:
            if len(w) > CACHED_BYTES:
                del known[w]
        return out

    def long(self, text: bytes) -> bytes:
        """A text of any length, in segments that end at white space."""
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, min(at + CHUNK_BYTES, len(text)))
            end = cut.start() if cut else len(text)
            out += self([text[at:end]])
            at = end
        return b"".join(out)


def _parts_signs(file: dict) -> bool:
    rules = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    split = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    way = (split.get("pattern", {}).get("Regex"), split.get("behavior"), split.get("invert"))
    return tuple(rules) == RULES and way == (PARTS, "Removed", True) and all(t["content"].startswith("<") for t in file.get("added_tokens", []))


def _keeps_letters(file: dict) -> bool:
    rest = (file.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[1:]
    return all((t["type"], t.get("add_prefix_space"), t.get("use_regex")) == ("ByteLevel", False, False) for t in rest)


def _cut(data: bytes, capacity: int, end: int):
    def run(batches):
        encode, last = WordEncoder.of(data), np.array([end], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, names = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in chunked(texts):
                ids = encode(texts[a:b]) if len(texts[a]) <= CHUNK_BYTES else [encode.long(texts[a])]
                rows, size = [], 0
                for name, own in zip(names[a:b], ids, strict=True):
                    own += last
                    for piece, start in enumerate(range(0, len(own) // 4, capacity)):
                        part = own[start * 4 : (start + capacity) * 4]
                        rows.append((number, name, piece, start, len(part) // 4, part))
                        number, size = number + 1, size + len(part)
                        if size > 4 * CHUNK_BYTES:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all documents: key (a number of its own), doc_id, piece, start, length, ids (32-bit little-endian, with the end id).

    `tokenizer` is the path of a tokenizers .json file, read on the driver. Null text is empty, so its document is the end id alone.
    Repeated rows are documents of their own. Other columns do not matter. `key` is fixed once the result is written.
    """
    with open(tokenizer, "rb") as f:
        data = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(data, capacity, end), ddl(PIECES))


def sum_of_squares(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, place in it) of each piece, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; none at 0 (full) and at capacity (empty)
    bins: list[list[int]] = [[] for _ in range(capacity)]
    out, made = [], 0
    for size in lengths:
        # gap g to g - size changes the sum by 2 (count[g - size] - count[g] + 1), one less if the bin is then full
        change = 2 * (count[: capacity - size] - count[size:capacity]) + 2
        if len(change):
            change[0] -= 1
            change[count[size:capacity] == 0] = np.iinfo(np.int64).max
            left = int(change.argmin())
        if len(change) and change[left] < np.iinfo(np.int64).max:
            b = bins[left + size].pop()
            count[left + size] -= 1
            out.append((b, capacity - left - size))
        else:
            b, left, made = made, capacity - size, made + 1
            out.append((b, 0))
        if left:
            bins[left].append(b)
            count[left] += 1
    return out


def _pack_block(lengths: np.ndarray, capacity: int, again: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place and open flag of each piece; the open bins are packed anew as long as that saves one."""
    order = np.argsort(-lengths, kind="stable")
    bins, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    todo, first, best = order, 0, None
    for turn in range(again + 1):
        found = np.array(sum_of_squares(lengths[todo].tolist(), capacity), np.int64).reshape(-1, 2)
        made = int(found[:, 0].max()) + 1
        if best is not None and made > best:
            break
        bins[todo], place[todo] = found[:, 0] + first, found[:, 1]
        used = np.bincount(found[:, 0], lengths[todo], made)
        first, best = first + made, int((used < capacity).sum())
        todo = todo[used[found[:, 0]] < capacity]
        if not len(todo):
            break
    is_open = np.zeros(len(lengths), bool)
    is_open[todo] = True
    return bins, place, is_open


def _round(capacity: int, turn: int, again: int):
    def run(block, table):
        table = table.sort_by("key")  # the same result however the rows arrive
        lengths = table.column("length").to_numpy()
        bins, place, is_open = _pack_block(lengths, capacity, again)
        base = (turn << 56) + (block[0].as_py() << 24)
        cols = [table.column("key"), table.column("length"), pa.array(bins + base), pa.array(place), pa.array(is_open)]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], schema=PLACES)

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """`rows` (key, length and any columns but sequence_id and offset) with sequence_id and offset.

    Every key is unique and every length from 1 to the capacity. The rows are written once, so that keys made on the way stay fixed.
    No rows: an empty result.
    """
    rows = durable(rows)
    short = F.col("length") < capacity
    pool, done, before, turn = rows.where(short).select("key", "length"), [], None, 0
    n = pool.count()
    while n:
        blocks = max(1, round(n / block))
        dealt = pool.select("key", "length", F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(blocks)).cast("long").alias("block"))
        placed = durable(dealt.groupBy("block").applyInArrow(_round(capacity, turn, 3 if blocks == 1 else 0), ddl(PLACES)))
        now = placed.agg(F.count_distinct("bin").alias("made"), F.count_distinct(F.when(F.col("open"), F.col("bin"))).alias("open"), F.count_if("open").alias("n")).first()
        if before is not None and now["made"] >= before[1]:
            done.append(before[0])
            break
        if before is not None:
            done.append(before[0].where("not open"))
        before, pool, n, turn = (placed, now["open"]), placed.where("open").select("key", "length"), now["n"], turn + 1
        if blocks == 1 or not n:
            done.append(placed)
            break
    full = rows.where(~short).select("*", (-1 - F.col("key")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not done:
        return full
    places = done[0].select("key", "bin", "place")
    for more in done[1:]:
        places = places.union(more.select("key", "bin", "place"))
    return full.unionByName(rows.join(places, "key").withColumnsRenamed({"bin": "sequence_id", "place": "offset"}))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length and ids of whole sequences, from packed pieces that still have their ids; a sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(parts, F.lit(b""), lambda whole, part: F.concat(whole, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), ids.alias("ids"))
