"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswind.session import durable


def _print(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links between long ids -> (id, component_id) of all linked ids, the smallest id of each component.

    Alternates large-star and small-star steps until the table stays the same, which takes a
    logarithmic number of rounds. Each round is a written table in the shared folder, so a lost executor
    costs no more than the running round. No row holds a group: a node's links stay rows, and the smallest
    neighbour is an aggregate that is combined before the shuffle. Self links and nulls are ignored.
    """
    e = edges.where("u is not null and v is not null and u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _print(e)
    while seen[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = durable(small.select("e.*").where("u <> v").distinct())
        now = _print(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(e.select("v", "v")).distinct()
