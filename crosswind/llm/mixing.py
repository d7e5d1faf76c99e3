"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p ** a. The exponent a between 0 (all sources alike) and 1 (as
they are) is found by bisection: the largest a whose weights have the target entropy, or the smallest a that repeats no
source more than REPEATS times, whichever is larger. Each step of the search cuts the interval into PIECES parts and evaluates all their ends in one
aggregate over the table of sources.

The weights are realised as budgeted block permutations. The documents of a source are dealt to BLOCKS blocks by hash. Each pass over a source (an epoch) takes its
blocks in a new seeded order; within a block documents stand in hash order. Whole epochs take every document, the last
one takes documents as long as they fit the source's budget. The place of a row in the mix is its source's used share of the
budget, so that any stretch of the mix has about the target weights. Prefix sums run over blocks (at most BLOCKS rows for a source and epoch)
and over the documents of one block, so no task holds a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.session import durable

EVENNESS = 0.98
REPEATS = 4.0
BUDGET = 1.0
BLOCKS = 4096
PIECES = 32
ROUNDS = 6
SEED = 20


def token_count(text: Column) -> Column:
    """Words between ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _search(sources: DataFrame, total: int, good) -> float:
    """The largest a in [0, 1] for which good(log Z, mean log p, smallest p) holds; it holds below and fails above. 0 if it never does."""
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        ends = [low + (high - low) * i / PIECES for i in range(PIECES + 1)]
        p = F.col("tokens") / F.lit(total)
        terms = [x for a in ends for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = sources.agg(F.min(p), *terms).first()
        holds = [good(a, row[1 + 2 * i], row[2 + 2 * i], row[0]) for i, a in enumerate(ends)]
        last = max((i for i, ok in enumerate(holds) if ok), default=-1)
        if last < 0:
            return low
        if last == PIECES:
            return high
        low, high = ends[last], ends[last + 1]
    return low


def exponent(sources: DataFrame, total: int, count: int, budget: float, evenness: float = EVENNESS, repeats: float = REPEATS) -> float:
    """sources: (source, tokens > 0). The exponent whose weights meet the target entropy, raised to keep the repetition limit."""
    target = evenness * math.log(count)
    flat = _search(sources, total, lambda a, z, e, _: math.log(z) - a * e / z >= target - 1e-12)
    # repetitions of a source are budget * p ** a / z / (total * p), greatest for the smallest source
    over = _search(sources, total, lambda a, z, _, p: budget / total * p ** (a - 1) / z > repeats)
    # `over` is the last exponent that still breaks the limit; the next representable step keeps it
    return min(1.0, max(flat, over + (high_step() if over > 0 else 0.0)))


def high_step() -> float:
    """The width of the last interval of the search."""
    return PIECES ** -float(ROUNDS)


def weights(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS, budget: float | None = None, share: float = BUDGET) -> DataFrame:
    """(source, tokens, weight, target): each source's tokens, its weight and its token budget. Written once.

    `budget` is the number of tokens of the mix, by default `share` times the tokens of all documents. Sources without
    tokens get no weight. A null source is a source of its own.
    """
    sources = durable(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"))
    total, count = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    budget = share * total if budget is None else budget
    a = exponent(sources, total, count, budget, evenness, repeats)
    z = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(total), F.lit(a)))).first()[0]
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(a)) / F.lit(z)
    return sources.select("source", "tokens", weight.alias("weight"), (weight * F.lit(float(budget))).alias("target"))


#: The columns that the mix adds.
MIX = ("mix_tokens", "mix_epoch", "mix_place", "mix_weight")


def mix(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS, budget: float | None = None, share: float = BUDGET, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """The chosen rows of `docs` with all their columns and mix_tokens, mix_epoch, mix_place, mix_weight.

    Order by mix_place for the mixed sequence. Null text and texts without words have no tokens and are not chosen. Repeated
    rows are documents of their own. An empty table, or one without tokens, gives an empty result. Columns of `docs` with the names of
    the mix's are replaced by them; all others pass through.
    """
    names = [c for c in docs.columns if c not in MIX]
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    # the row travels as one struct, so that its names cannot meet those used here; a hash of the text settles the order of documents with one id
    rows = docs.select(
        F.struct(*names).alias("_doc"), F.col("source").cast("string").alias("_source"), token_count(F.col("text")).alias("mix_tokens"),
        key.alias("_key"), F.col("doc_id").alias("_number"), F.xxhash64(F.col("text").cast("string")).alias("_tie"),
    ).where("mix_tokens > 0").withColumn("_block", F.pmod("_key", F.lit(blocks)).cast("int"))
    sums = durable(rows.groupBy("_source", "_block").agg(F.sum("mix_tokens").alias("block_tokens")))
    plan = durable(weights(sums.select(F.col("_source").alias("source"), F.col("block_tokens").alias("n_tokens")), evenness, repeats, budget, share))
    turns = sums.join(plan, F.col("_source").eqNullSafe(F.col("source"))).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.floor(F.col("target") / F.col("tokens")).cast("int"))))
    order = Window.partitionBy("_source", "mix_epoch").orderBy(F.xxhash64(F.lit(seed), "mix_epoch", "_block"), "_block")
    before = F.sum("block_tokens").over(order) - F.col("block_tokens")
    turns = turns.withColumn("_begin", before).select(
        F.col("_source").alias("_s"), F.col("_block").alias("_b"), "mix_epoch", "_begin", "tokens", "target", F.col("weight").alias("mix_weight"), (F.col("target") - F.col("mix_epoch") * F.col("tokens")).alias("_left")
    )
    turns = turns.where("_begin < _left")
    inside = Window.partitionBy("_source", "_block").orderBy("_key", "_number", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_upto", F.sum("mix_tokens").over(inside))
    out = placed.join(turns, placed["_source"].eqNullSafe(turns["_s"]) & (F.col("_block") == F.col("_b"))).where("_begin + _upto <= _left")
    place = (F.col("mix_epoch") * F.col("tokens") + F.col("_begin") + F.col("_upto") - F.col("mix_tokens")) / F.col("target")
    return out.select("_doc.*", "mix_tokens", "mix_epoch", place.alias("mix_place"), "mix_weight")
