"""Ranked search of many queries at once, with the work they share done once.

Queries (test items) are sets of terms with a weight each; a document's score for a query is a sum over its terms, so any set of terms that
several queries hold can be summed once. The shared sets are mined before the search: again and again the pair of terms or sets that most
queries hold becomes a set of its own and takes the pair's place in them (`plan`). What comes out is a DAG: terms below, shared sets above
them, queries on top. A task scores a block of documents at a time: it materialises one accumulator over the block for each shared
set, from the accumulators below it, and then puts each query together from its sets and its remaining terms.

The corpus is read once. That pass counts the terms of all documents, and keeps for each the query terms it holds with their frequencies, as a table
of its own; document frequencies and lengths are sums over that table, and scores are computed from it. Every block gives its best documents a
query, so what moves is bounded by the number of blocks times K a query, and ranks are cut twice, first within salted parts of a query.

The plan is sent to the workers, so queries come in parts of about POSTINGS terms (documented bound; some 10 MB); more queries take several
passes over the documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswind.llm.common import chunked, ddl, texts_of
from crosswind.session import durable

K = 50
SCALE = 1_000_000_000
POSTINGS = 50_000
#: Documents scored together, and the bytes that a task's accumulators may take.
BLOCK = 4096
BLOCK_BYTES = 96 << 20
#: Pairs are mined among so many neighbouring terms of a query, by falling frequency, so that the work on a query of n terms is RUN times n.
RUN = 32
SALTS = 64

# A term byte stays (A-Z as a-z), every other byte of ASCII parts terms. Bytes from 0x80 on belong to characters that are parts of terms.
_TERM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order: maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased."""
    return text.translate(_TERM).split()


class Plan:
    """A query-sharing DAG over queries given as sets of terms.

    Nodes 0 to n_terms - 1 are terms; node n_terms + i is the set that joins the nodes `pairs[i]`. `queries` has the nodes whose sum is
    each query: no term is counted twice, as a set stands in the place of its parts.
    """

    def __init__(self, queries: list[set[int]], n_terms: int, run: int = RUN):
        self.n_terms = n_terms
        self.pairs: list[tuple[int, int]] = []
        self.queries: list[list[int]] = [[] for _ in queries]
        often = Counter(t for q in queries for t in q)
        runs: list[tuple[int, set[int]]] = []
        for n, q in enumerate(queries):
            shared = sorted((t for t in q if often[t] > 1), key=lambda t: (-often[t], t))
            self.queries[n] = sorted(t for t in q if often[t] == 1)
            runs += [(n, set(shared[i : i + run])) for i in range(0, len(shared), run)]
        self._mine([r for _, r in runs])
        for n, r in runs:
            self.queries[n] += sorted(r)

    def _mine(self, runs: list[set[int]]) -> None:
        holders: dict[tuple[int, int], set[int]] = {}

        def hold(a: int, b: int, r: int) -> tuple[int, int]:
            pair = (a, b) if a < b else (b, a)
            holders.setdefault(pair, set()).add(r)
            return pair

        for r, nodes in enumerate(runs):
            own = sorted(nodes)
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    hold(a, b, r)
        heap = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            held = holders.get(pair, ())
            if len(held) < 2:
                continue
            if len(held) != -n:  # the entry is out of date
                heapq.heappush(heap, (-len(held), pair))
                continue
            node = self.n_terms + len(self.pairs)
            self.pairs.append(pair)
            made = set()
            for r in list(held):
                nodes = runs[r]
                for old in pair:
                    nodes.discard(old)
                for other in nodes:
                    for old in pair:
                        holders[min(old, other), max(old, other)].discard(r)
                    made.add(hold(node, other, r))
                nodes.add(node)
            del holders[pair]
            for new in made:
                if len(holders[new]) > 1:
                    heapq.heappush(heap, (-len(holders[new]), new))

    def additions(self) -> int:
        """Accumulator additions a document block takes; one for each term of each query, less one, without sharing."""
        return len(self.pairs) + sum(max(len(q) - 1, 0) for q in self.queries)


class Scorer:
    """Evaluates a plan over blocks of documents."""

    def __init__(self, plan: Plan, weights: np.ndarray):
        self.plan, self.weights = plan, weights
        uses = Counter(n for p in plan.pairs for n in p) + Counter(n for q in plan.queries for n in q if n >= plan.n_terms)
        self.uses = uses

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        """One accumulator over `docs` documents for each query, from (document, term, contribution) sorted by term."""
        plan, first = self.plan, np.searchsorted(term, np.arange(self.plan.n_terms + 1))
        left, held = dict(self.uses), {}

        def add(into: np.ndarray, node: int) -> None:
            if node < plan.n_terms:
                a, b = first[node], first[node + 1]
                into[doc[a:b]] += value[a:b]  # a document holds a term once
                return
            into += held[node]
            left[node] -= 1
            if not left[node]:
                del held[node]

        for i, pair in enumerate(plan.pairs):
            sums = np.zeros(docs, np.int64)
            for node in pair:
                add(sums, node)
            held[plan.n_terms + i] = sums
        out = []
        for nodes in plan.queries:
            sums = np.zeros(docs, np.int64)
            for node in nodes:
                add(sums, node)
            out.append(sums)
        return out


COUNTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
HITS = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _count(vocabulary: list[bytes]):
    """doc_id, number of terms, and the query terms with their frequencies, for each document."""

    def run(batches):
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in chunked(texts):
                found = [terms(t) for t in texts[a:b]]
                sizes = np.fromiter(map(len, found), np.int64, b - a)
                get = number.get
                own = np.fromiter((get(t, -1) for doc in found for t in doc), np.int64, int(sizes.sum()))
                at = np.repeat(np.arange(b - a), sizes)[own >= 0]
                pair, tf = np.unique(at * max(len(number), 1) + own[own >= 0], return_counts=True)
                doc, term = np.divmod(pair, max(len(number), 1))
                ends = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes), *lists], schema=COUNTS)

    return run


def _rank(scorer: Scorer, items: list[int | None], documents: int, length: int, k: int):
    """The k best documents a block for each query."""

    def run(batches):
        named = pa.array(items, pa.int64())
        size = max(64, min(BLOCK, BLOCK_BYTES // 8 // max(len(scorer.plan.pairs) + len(scorer.plan.queries), 1)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = part.column("doc_id")
                n = part.column("n").to_numpy()
                m = 100 - 50 + (50 * n * documents) // length
                term = part.column("term").flatten().to_numpy().astype(np.int64)
                tf = part.column("tf").flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), part.column("term").value_lengths().to_numpy())
                value = scorer.weights[term] * ((SCALE * tf) // (1000 * tf + 20 * m[doc]))
                order = np.argsort(term, kind="stable")
                names = ids.to_numpy(zero_copy_only=False) if not ids.null_count else ids.fill_null(np.iinfo(np.int64).min).to_numpy()
                rows = []
                for q, sums in enumerate(scorer.scores(part.num_rows, doc[order], term[order], value[order])):
                    best = np.flatnonzero(sums > 0)
                    if len(best) > k:
                        least = np.partition(sums[best], len(best) - k)[len(best) - k]
                        best = best[sums[best] >= least]
                        best = best[np.lexsort((names[best], -sums[best]))[:k]]
                    rows.append((np.full(len(best), q), best, sums[best]))
                q, best, sums = (np.concatenate(c) for c in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([named.take(pa.array(q)), ids.take(pa.array(best)), pa.array(sums)], schema=HITS)

    return run


def _query_terms(batches):
    out = pa.schema([("item_id", pa.int64()), ("term", pa.binary())])
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch.column("text")), strict=True):
            own = sorted(set(terms(text)))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], schema=out)


def _best(hits: DataFrame, k: int, *by: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = K, postings: int = POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, equal scores by ascending doc_id (nulls first).

    Items that share an item_id are one query with the terms of all their texts. Null and empty texts have no terms. Every row of `docs` is a
    document, so a repeated row is ranked as often as it is there. Other columns do not matter. No items, no documents or no terms: an empty result.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    wanted = durable(wanted.mapInArrow(_query_terms, "item_id long, term binary").distinct())
    parts = max(1, -(-wanted.count() // postings))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in range(parts):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()  # bounded by `postings`
        vocabulary = sorted({bytes(r["term"]) for r in own})
        names = sorted({r["item_id"] for r in own}, key=lambda i: (i is not None, i or 0))
        number, place = {t: i for i, t in enumerate(vocabulary)}, {i: n for n, i in enumerate(names)}
        queries: list[set[int]] = [set() for _ in names]
        for r in own:
            queries[place[r["item_id"]]].add(number[bytes(r["term"])])
        if not names:
            continue
        counts = durable(rows.mapInArrow(_count(vocabulary), ddl(COUNTS)))
        total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
        if not total["terms"]:
            continue
        held = counts.select(F.explode("term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # bounded by the vocabulary
        weights = np.array([weight(total["documents"], 0)] * len(vocabulary), np.int64)
        for r in held:
            weights[r["term"]] = weight(total["documents"], r["df"])
        scorer = Scorer(Plan(queries, len(vocabulary)), weights)
        hits = counts.where(F.size("term") > 0).mapInArrow(_rank(scorer, names, total["documents"], total["terms"], k), ddl(HITS))
        salted = _best(hits.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "item_id", "salt")
        out = out.union(_best(salted, k, "item_id").select("item_id", "rank", "doc_id", "score"))
    return out
