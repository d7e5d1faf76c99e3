"""Benchmark decontamination: an inverted index of the test items, asked with every passage of the training texts.

Items, and the questions of items that have an answer, are entries of the index by their words with BM25 impacts, divided by the score
an entry gives itself and by the entry's own threshold: THRESHOLD, or less where OVERLAP of the entry's shingles can stand in a passage
that scores less. So retrieval loses nothing that step 4 would confirm. Posting lists are cut into blocks of BLOCK entries, each with its
greatest impact (block-max). Every text is cut into overlapping passages that hold any item of the index whole. For all passages of a
chunk at once:

1. WAND's test on whole lists: a passage whose words' greatest impacts sum to less than the threshold is left out.
2. The same on blocks: only (passage, block) pairs whose block maxima reach the threshold go on.
3. Their postings are added up exactly, and every entry at or above the threshold is retrieved; the bounds never lose one.
4. Retrieved items are verified by their word shingles. A document holds an item if OVERLAP of the whole item's shingles stand in a stretch
   of as many words as the item has, or OVERLAP of its question's in a stretch of the question's length and OVERLAP of its answer's anywhere
   in the document. A question alone counts too, as it gives the item away, if it has SHINGLE words at least; a shorter one needs its answer.
   A stretch depends on the item alone, and every stretch lies in a passage, so other items of the index change nothing.

The index is sent to the workers, so it is built for POSTINGS postings at a time at most (documented bound; about 40 MB); a
larger benchmark takes several passes over the documents. Word statistics are those of all items.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl, texts_of
from crosswind.session import durable

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 32
POSTINGS = 1_000_000

_WORD = re.compile(r"\w+")
_LAST = re.compile(r"(?<=[.!?])\s+(?=\S[^.!?]*[.!?]*\s*$)")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's last sentence is its answer, the rest its question; one sentence is a question without answer."""
    at = _LAST.search(text)
    return (words(text[: at.start()]), words(text[at.end() :])) if at else (words(text), [])


def shingles(tokens: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + size]) for i in range(len(tokens) - size + 1)} if tokens else set()


def share(part: list[str], passage: list[str]) -> float | None:
    """The share of a part's shingles that the passage holds; null for an empty part. A short part is one shingle."""
    if not part:
        return None
    size = min(SHINGLE, len(part))
    own = shingles(part, size)
    return len(own & shingles(passage, size)) / len(own)


def nearest_share(part: list[str], passage: list[str]) -> float:
    """The greatest share of a part's shingles in a stretch of the passage that has the part's length."""
    size = min(SHINGLE, len(part))
    own = shingles(part, size)
    at = [(i, x) for i in range(len(passage) - size + 1) if (x := tuple(passage[i : i + size])) in own]
    held: Counter = Counter()
    best, left = 0, 0
    for i, x in at:
        held[x] += 1
        while at[left][0] < i - (len(part) - size):
            held[at[left][1]] -= 1
            if not held[at[left][1]]:
                del held[at[left][1]]
            left += 1
        best = max(best, len(held))
    return best / len(own)


def least_score(tokens: list[str], impact: dict[str, float]) -> float:
    """A bound below which no text with OVERLAP of the shingles can score, as a share of the score of all words.

    An absent word takes all its shingles along, and a shingle is lost to `size` words at most; so absent words have at most size
    times the shingles that may be missing. The greatest impact of such words is bounded by filling up in order of impact a shingle.
    """
    size = min(SHINGLE, len(tokens))
    own = shingles(tokens, size)
    missing = len(own) - math.ceil(OVERLAP * len(own) - 1e-9)
    held = Counter(w for x in own for w in set(x))
    room, lost = float(size * missing), 0.0
    for w in sorted((w for w in impact if held[w] <= missing), key=lambda w: -impact[w] / held[w]):
        part = min(1.0, room / held[w])
        lost, room = lost + part * impact[w], room - part * held[w]
        if room <= 0:
            break
    return 1 - lost / sum(impact.values())


class Index:
    """Block-max postings of a bounded set of items."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[str, int], n_items: int, mean_length: float, threshold: float = THRESHOLD):
        self.items = [(i, *question_answer(t), words(t)) for i, t in items]
        self.items = [x for x in self.items if x[3]]
        self.longest = max((len(x[3]) for x in self.items), default=0)
        #: (item, words) of whole items and of questions that have an answer
        self.entries = [(n, tokens) for n, (_, question, answer, whole) in enumerate(self.items) for tokens in ([whole, question] if question and answer else [whole])]
        postings: dict[str, list[tuple[int, float]]] = {}
        self.threshold = np.zeros(len(self.entries))
        for n, (_, tokens) in enumerate(self.entries):
            impact = {}
            for w, tf in Counter(tokens).items():
                idf = math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5))
                impact[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / mean_length))
            self.threshold[n] = max(min(threshold, least_score(tokens, impact)), 1e-6)
            own = sum(impact.values()) * self.threshold[n]
            for w, x in impact.items():
                postings.setdefault(w, []).append((n, x / own))
        self.term = {w: i for i, w in enumerate(postings)}
        flat = [(t, n // BLOCK, n, x) for t, row in enumerate(postings.values()) for n, x in row]
        t, block, self.item, self.impact = (np.array(c) for c in zip(*flat, strict=True)) if flat else (np.zeros(0, int),) * 4
        self.blocks = len(self.entries) // BLOCK + 1
        cell = t * self.blocks + block
        start = np.concatenate(([0], np.flatnonzero(cell[1:] != cell[:-1]) + 1)) if len(cell) else np.zeros(0, int)
        self.cell_start, self.cell_end = start, np.append(start[1:], len(cell)).astype(int)
        self.cell_block = block[start] if len(cell) else block
        self.cell_max = np.maximum.reduceat(self.impact, start) if len(cell) else np.zeros(0)
        owner = t[start] if len(cell) else t
        self.first = np.searchsorted(owner, np.arange(len(postings) + 1))
        self.most = np.maximum.reduceat(self.cell_max, self.first[:-1]) if len(postings) else np.zeros(0)

    def retrieve(self, texts: list[list[str]]) -> list[tuple[int, int, int, float]]:
        """(text, first word of the passage, entry, score) of everything at or above its threshold."""
        if not self.items:
            return []
        stride = self.longest
        get, ids, place, passages, base = self.term.get, [], [], [], 0
        for n, tokens in enumerate(texts):
            own = np.array([get(w, -1) for w in tokens], np.int64)
            at = np.flatnonzero(own >= 0)
            ids.append(own[at])
            place.append(base + at // stride + 1)  # its own passage starts here, and the one before covers it too
            count = len(tokens) // stride + 2
            passages.append(np.stack([np.full(count, n), (np.arange(count) - 1) * stride], axis=1))
            base += count
        terms = len(self.term)
        t, p = np.concatenate(ids), np.concatenate(place)
        pairs = _distinct(np.concatenate([p * terms + t, (p - 1) * terms + t]))
        p, t = pairs // terms, pairs % terms
        hopeful = np.bincount(p, self.most[t], base) >= 1 - 1e-9
        p, t = p[hopeful[p]], t[hopeful[p]]
        if not len(p):
            return []
        names, p = _numbered(p)
        cells, q = _expand(self.first[t], self.first[t + 1], p)
        pair = q * self.blocks + self.cell_block[cells]
        go = np.bincount(pair, self.cell_max[cells], len(names) * self.blocks) >= 1 - 1e-9
        cells, left = cells[go[pair]], np.flatnonzero(go)
        # the pairs that go on, numbered; each has a place for every item of its block
        q = np.searchsorted(left, pair[go[pair]])
        posting, q = _expand(self.cell_start[cells], self.cell_end[cells], q)
        scores = np.bincount(q * BLOCK + self.item[posting] % BLOCK, self.impact[posting], len(left) * BLOCK)
        spans = np.concatenate(passages)
        out = []
        for k in np.flatnonzero(scores >= 1 - 1e-9):
            passage, block = divmod(left[k // BLOCK], self.blocks)
            n, start = spans[names[passage]]
            entry = int(block * BLOCK + k % BLOCK)
            out.append((int(n), int(start), entry, float(scores[k] * self.threshold[entry])))
        return out

    def verified(self, texts: list[list[str]]) -> list[tuple[int, int, float, float, float, float | None]]:
        """(text, item id, score, overlap, question overlap, answer overlap) of each text and item it holds, best values."""
        found: dict[tuple[int, int], list] = {}
        for n, start, entry, score in self.retrieve(texts):
            found.setdefault((n, self.entries[entry][0]), []).append((start, score))
        out: dict[tuple[int, int], tuple] = {}
        for (n, item), places in found.items():
            name, question, answer, whole = self.items[item]
            passages = [texts[n][max(start, 0) : start + 2 * self.longest] for start in {start for start, _ in places}]
            overlap = max(nearest_share(whole, p) for p in passages)
            asked = max((nearest_share(question, p) for p in passages), default=None) if question else None
            told = None
            if overlap >= OVERLAP or (asked or 0) >= OVERLAP:
                told = share(answer, texts[n])
            alone = len(question) >= SHINGLE or not answer or (told or 0) >= OVERLAP
            if overlap >= OVERLAP or ((asked or 0) >= OVERLAP and alone):
                row = (overlap, max(score for _, score in places), asked, told)
                out[n, name] = max(out.get((n, name), row), row, key=lambda r: r[:2])
        return [(n, name, r[1], r[0], r[2], r[3]) for (n, name), r in sorted(out.items())]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and for each element the number of its value."""
    new = np.concatenate(([True], x[1:] != x[:-1]))
    return x[new], np.cumsum(new) - 1


def _expand(start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and each one's owner."""
    size = end - start
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) if len(size) else start
    return np.arange(size.sum()) + shift, np.repeat(owner, size)


HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])


def _search(index: Index):
    def run(batches):
        for batch in batches:
            texts, ids = texts_of(batch.column("text")), batch.column("doc_id").to_pylist()
            for a, b in chunked(texts):
                found = index.verified([words(t.decode()) for t in texts[a:b]])
                if found:
                    cols = [[ids[a + f[0]] for f in found], *[[f[k] for f in found] for k in range(1, 6)]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, HITS, strict=True)], schema=HITS)

    return run


def _item_words(batches):
    for batch in batches:
        rows = [(w, len(tokens)) for t in texts_of(batch.column("text")) for tokens in [words(t.decode())] for w in set(tokens)]
        yield pa.RecordBatch.from_pydict({"word": [r[0] for r in rows]}, schema=pa.schema([("word", pa.string())]))


def _lengths(batches):
    for batch in batches:
        texts = [t.decode() for t in texts_of(batch.column("text"))]
        sizes, parts = [words(t) for t in texts], [question_answer(t) for t in texts]
        postings = [len(set(s)) + (len(set(q)) if q and a else 0) for s, (q, a) in zip(sizes, parts, strict=True)]
        yield pa.RecordBatch.from_pydict({"n": [len(s) for s in sizes], "d": postings}, schema=pa.schema([("n", pa.int64()), ("d", pa.int64())]))


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, postings: int = POSTINGS):
    """The indexes of all items, one after the other, of about `postings` postings each."""
    items = durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null"))
    size = items.mapInArrow(_lengths, "n long, d long").agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.sum("d").alias("postings")).first()
    if not size["items"]:
        return
    frequency = durable(items.mapInArrow(_item_words, "word string").groupBy("word").agg(F.count("*").alias("n")))
    parts = max(1, -(-(size["postings"] or 1) // postings))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for i in range(parts):
        own = items.where(part == i)
        some = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=str)  # bounded by `postings`
        df = {r["word"]: r["n"] for r in frequency.join(own.mapInArrow(_item_words, "word string").distinct(), "word").collect()}
        yield Index(some, df, size["items"], max(size["mean"], 1.0), threshold)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, postings: int = POSTINGS) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, overlap, question_overlap, answer_overlap.

    A document holds an item by the rule of step 4 above: the whole item or its question in one passage, a question of less than SHINGLE
    words only with its answer. `overlap` and `question_overlap` are the greatest shares in a stretch of a passage that was retrieved, `answer_overlap`
    is that of the document (null if the item has one sentence), `score` the greatest of the item's entries. Null and empty texts and items match
    nothing. Repeated rows give one row with the highest values. No benchmark or no documents: an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    out = docs.sparkSession.createDataFrame([], ddl(HITS))
    for index in indexes(benchmark, threshold, postings):
        out = out.union(rows.mapInArrow(_search(index), ddl(HITS)))
    best = F.max(F.struct("overlap", "score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.score", "best.overlap", "best.question_overlap", "best.answer_overlap")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they came with, of any name.

    Null and empty texts hold nothing and stay; repeated rows stay or go together. Null and empty items match nothing. No benchmark:
    all documents stay; no documents: an empty result.
    """

    def clean(index: Index):
        def run(batches):
            for batch in batches:
                texts, keep = texts_of(batch.column("text")), []
                for a, b in chunked(texts):
                    hit = {f[0] for f in index.verified([words(t.decode()) for t in texts[a:b]])}
                    keep += [n not in hit for n in range(b - a)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return run

    for index in indexes(benchmark):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
