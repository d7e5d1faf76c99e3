"""Embedding near-duplicates by sorted projection passes.

Each pass draws random hyperplanes, strings the signs of a vector's projections together to one key, and puts the
vectors in the lexicographic order of these keys, within equal labels. Similar vectors tend to share long key
prefixes, so each vector is compared with its WINDOW neighbours in that order. Verified pairs of all passes are united to components.

Each label has a depth of `bits`: vectors that share that many first signs of a pass are a cell. A cell of WINDOW vectors at most lies
inside the window; a larger one is compared whole, in pairs of blocks of WIDE. So a pass finds every pair that shares a cell, and
a pair at the threshold does so with probability agree ** bits, agree = 1 - angle / 180 degrees, however the vectors lie.
`passes_for` takes as many passes as RECALL needs at that depth. `planned` measures the cells of every depth over all rows and takes the
cheapest for each label; a label that fits the window is one cell. Every other label goes through its passes, whatever its size.

Windows only have to connect a group, not to show all its pairs: an exact check follows that counts all links inside
each component, blocks of BLOCK vectors against one another. A pair of blocks is skipped or counted as a whole where the
angles between their centres and around them prove that none or all of its pairs link. Exact copies are one class with
a multiplicity. So results are whole for every component of any size; a link can only be missed if no pass shows it and
nothing else connects its two ends.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.llm.components import components
from crosswind.session import durable

THRESHOLD = 0.93
WINDOW = 64
BLOCK = 512
BITS = 48
RECALL = 0.9999
WIDE = 2048
#: Depths that a label may take, and the passes that measure their cells.
DEPTHS = (1, 2, *range(3, BITS + 1, 3))
MEASURED = 2
#: What moving a vector to another task costs, in comparisons of two vectors.
MOVE = 4096
#: Room for rounding where a block pair is decided by angles alone.
SLACK = 1e-7


def passes_for(bits: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if p >= recall else max(2, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def valid(embedding: str = "embedding"):
    """Not null or empty, finite in every component, not zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(vectors) -> np.ndarray:
    """Rows of length one in double precision; dividing by the largest component first keeps squares in range."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


KEYED = "turn int, label long, dim int, n long, bits int, key long, id long"


def _keys(names: list[str]):
    weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(frames):
        for f in frames:
            for dim, g in f.groupby("dim", sort=False):
                x, passes = unit(g["embedding"]), g["passes"].to_numpy()
                for turn in range(int(passes.max())):
                    on = passes > turn
                    planes = np.random.default_rng([int(dim), turn]).standard_normal((int(dim), BITS))
                    yield g[on].assign(turn=turn, key=(x[on] @ planes >= 0).astype(np.int64) @ weights)[names]

    return run


def _cell(bits: str = "bits"):
    return F.expr(f"shiftright(key, {BITS} - {bits})")


def _whole(size, move: int):
    """The cost of comparing `size` vectors with one another in blocks of WIDE."""
    return size * size / 2 + size * F.ceil(size / WIDE) * move


def planned(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, move: int = MOVE) -> DataFrame:
    """(label, dim, n, bits, passes): the depth of every label that costs least. Recall does not hang on it."""
    sizes = durable(classes.groupBy("label", "dim").agg(F.count("*").alias("n")))
    ways = F.array(*[F.struct(F.lit(b).alias("bits"), F.lit(passes_for(b, threshold)).alias("passes")) for b in DEPTHS])
    grid = sizes.where(F.col("n") > window).select("label", "dim", "n", F.explode(ways).alias("way")).select("label", "dim", "n", "way.*")
    grid = durable(grid)
    tried = classes.join(grid.select("label", "dim").distinct(), ["label", "dim"], "left_semi")
    names = ["turn", "label", "dim", "key"]
    keyed = tried.select("label", "dim", "embedding", F.lit(MEASURED).alias("passes")).mapInPandas(_keys(names), "turn int, label long, dim int, key long")
    keyed = keyed.groupBy(*names).agg(F.count("*").alias("c"))
    cells = keyed.join(grid.select("label", "dim", "bits"), ["label", "dim"]).groupBy("label", "dim", "bits", "turn", _cell().alias("cell")).agg(F.sum("c").alias("size"))
    cells = cells.where(F.col("size") > window).groupBy("label", "dim", "bits").agg((F.sum(_whole(F.col("size"), move)) / MEASURED).alias("large"))
    cost = F.col("passes") * F.col("n") * move + F.col("passes") * F.coalesce("large", F.lit(0.0))
    best = grid.join(cells, ["label", "dim", "bits"], "left").groupBy("label", "dim").agg(F.min(F.struct(cost.alias("cost"), "bits", "passes", "n")).alias("w"))
    small = sizes.where(F.col("n") <= window).select("label", "dim", "n", F.lit(0).alias("bits"), F.lit(1).alias("passes"))
    return durable(small.union(best.select("label", "dim", "w.n", "w.bits", "w.passes")))


def _numbered(frames):
    """The place of each row in its sorted partition."""
    n = 0
    for f in frames:
        yield f.assign(place=np.arange(n, n + len(f)))
        n += len(f)


def _stars(threshold: float, window: int):
    """Compares a block with its neighbours; returns links from each vector to the smallest id it is connected to here."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("place", kind="stable")
        ids, out = f["id"].to_numpy(), []
        for _, at in f.groupby(["turn", "label", "dim"], sort=False).indices.items():
            x, own = unit(f["embedding"].to_numpy()[at]), ids[at]
            near = x @ x.T >= threshold
            near &= np.abs(np.subtract.outer(np.arange(len(at)), np.arange(len(at)))) <= window
            low = own.copy()
            while True:
                least = np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1)
                if (least == low).all():
                    break
                low = least
            out.append(pd.DataFrame({"u": own[own != low], "v": low[own != low]}))
        return pd.concat(out) if out else pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})

    return run


def _cell_stars(threshold: float):
    """Compares two blocks of a cell (or one with itself) whole; returns links as `_stars` does."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        x, ids, block = unit(f["embedding"]), f["id"].to_numpy(), f["block"].to_numpy()
        same = f["a"].iat[0] == f["b"].iat[0]
        left = np.flatnonzero(block == f["a"].iat[0])
        right = left if same else np.flatnonzero(block == f["b"].iat[0])
        near = x[left] @ x[right].T >= threshold
        if same:
            np.fill_diagonal(near, False)
        r, c = near.any(axis=1), near.any(axis=0)
        near, left, right = near[r][:, c], left[r], right[c]
        low = ids.copy()
        while len(left):
            before = low.copy()
            low[left] = np.minimum(low[left], np.where(near, low[right][None, :], np.iinfo(np.int64).max).min(axis=1))
            low[right] = np.minimum(low[right], np.where(near, low[left][:, None], np.iinfo(np.int64).max).min(axis=0))
            if (before == low).all():
                break
        return pd.DataFrame({"u": ids[ids != low], "v": low[ids != low]})

    return run


def window_links(classes: DataFrame, plan: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Links (u, v) that the passes prove, as stars. `classes`: id, label, dim, embedding; `plan` as `planned` gives it."""
    spark = classes.sparkSession
    order = ["turn", "label", "dim", "key", "id"]
    names = ["turn", "label", "dim", "n", "bits", "key", "id", "embedding"]
    fields = f"{KEYED}, embedding array<double>"
    keyed = classes.select("id", "label", "dim", "embedding").join(plan, ["label", "dim"]).mapInPandas(_keys(names), fields)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = durable(ordered.mapInPandas(_numbered, f"{fields}, place long").withColumn("part", F.spark_partition_id()))
    # one row for each partition: where its first row stands in the whole order
    ends, start, rows = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect(), 0, []
    for r in ends:
        rows.append((r["part"], start))
        start += r["n"]
    first = spark.createDataFrame(rows, "part int, start long")
    whole = placed.join(first, "part").withColumn("place", F.col("start") + F.col("place")).select("turn", "label", "dim", "id", "embedding", "place")
    at = F.floor(F.col("place") / block)
    halo = F.when(F.col("place") % block < window, F.array(at, at - 1)).otherwise(F.array(at))
    near = whole.withColumn("block", F.explode(halo)).groupBy("block").applyInPandas(_stars(threshold, window), "u long, v long")

    key = ["turn", "label", "dim", "cell"]
    celled = placed.withColumn("cell", _cell())
    large = celled.groupBy(*key).agg(F.count("*").alias("members")).where(F.col("members") > window)
    blocks = F.ceil(F.col("members") / wide).cast("int")
    member = celled.join(large, key).select(*key, "id", "embedding", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = member.select(*key, "id", "embedding", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    return near.union(member.groupBy(*key, "a", "b").applyInPandas(_cell_stars(threshold), "u long, v long"))


def _block_pairs(threshold: float):
    limit = math.acos(threshold)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block of a component against another of the same component (or itself)."""
        if not len(left) or not len(right):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64")})
        x, y = unit(left["embedding"]), unit(right["embedding"])
        n = right["n"].to_numpy()
        cx, cy = x.mean(axis=0), y.mean(axis=0)
        sure = None
        if (cx @ cx) > 0 and (cy @ cy) > 0:
            cx, cy = cx / math.sqrt(cx @ cx), cy / math.sqrt(cy @ cy)
            rx, ry = (float(np.arccos(np.clip(v @ c, -1, 1)).max()) for v, c in ((x, cx), (y, cy)))
            between = math.acos(max(-1.0, min(1.0, float(cx @ cy))))
            if between + rx + ry <= limit - SLACK:
                sure = np.full(len(x), n.sum())
            elif between - rx - ry > limit + SLACK:
                sure = np.zeros(len(x), np.int64)
        counts = sure if sure is not None else (x @ y.T >= threshold) @ n
        return pd.DataFrame({"id": left["id"].to_numpy(), "n": counts})

    return run


def _small_components(threshold: float):
    count = _block_pairs(threshold)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([count(g, g) for _, g in f.groupby("component_id", sort=False)])

    return run


def link_counts(classes: DataFrame, group: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, links): rows that a class links with inside its component, itself included. Exact.

    Components are cut into cells of about `block` members; each ordered pair of cells is one task's group. Components
    of one cell are taken many together, so that groups are never far more numerous than cells.
    """
    sizes = group.groupBy("component_id").agg(F.count("*").alias("members"))
    cells = F.ceil(F.col("members") / block).cast("int")
    member = classes.join(group, "id").join(sizes, "component_id").withColumn("cells", cells)
    member = durable(member.select("component_id", "cells", "id", "n", "embedding", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell")))
    one = member.where("cells = 1")
    bundles = max(1, -(-one.count() // (4 * block)))
    bundle = F.pmod(F.xxhash64("component_id"), F.lit(bundles)).alias("bundle")
    small = one.select("component_id", "id", "n", "embedding", bundle).groupBy("bundle").applyInPandas(_small_components(threshold), "id long, n long")
    large = member.where("cells > 1")
    left = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    right = large.select("component_id", F.col("cell").alias("other"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "n", "embedding")
    key = ["component_id", "cell", "other"]
    found = left.select(*key, "id", "embedding").groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_block_pairs(threshold), "id long, n long")
    return small.union(found).groupBy("id").agg(F.sum("n").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, move: int = MOVE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    A vector that is null, zero or not finite, or whose label is null, links with nothing and is its own component. Vectors of
    different length link with nothing between them. Repeated rows are vectors of their own that link with each other. Rows of one
    vec_id with different vectors or labels are told apart. Null ids link like any other but name no component: one of null ids
    alone is null, and so is `kept` of a null id.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("good", valid() & F.col("label").isNotNull())
    # a class of copies has an id of its own, as a vec_id may repeat or be null; writing fixes it
    classes = rows.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    classes = durable(classes.withColumn("dim", F.size("embedding")).withColumn("id", F.monotonically_increasing_id()))
    if classes.isEmpty():
        linked = classes.select("id", F.col("low").alias("lowest"), F.lit(None).cast("long").alias("links"))
    else:
        group = durable(components(window_links(classes, planned(classes, threshold, move=move), threshold)))
        lowest = group.join(classes.select("id", "low"), "id").groupBy("component_id").agg(F.min("low").alias("lowest"))
        linked = group.join(lowest, "component_id").join(link_counts(classes, group, threshold), "id", "left").select("id", "lowest", "links")
    found = classes.join(linked, "id", "left").select(
        F.col("label").alias("l"), F.col("embedding").alias("e"), F.coalesce("links", "n").alias("links"), F.coalesce("lowest", "low").alias("c")
    )
    joined = rows.join(found, rows.good & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("c", "vec_id")
    return joined.select(
        "vec_id", (F.coalesce("links", F.lit(1)) - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
