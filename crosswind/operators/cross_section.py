"""Cross-sectional operators as DataFrame transforms, with a path for any group size.

A cross-section that fits one task is a plain window. A wider one is never held by one
task: aggregates are combined map-side and joined back, and order statistics come from one
range sort over (keys, value, instrument), whose per-partition counts give every row its
exact position. Which path to take is decided from a checked bound, not a guess.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions import signals as S
from crosswind.session import WIDE_GROUP_ROWS, durable


def range_positions(df: DataFrame, by: tuple[str, ...], order: list[str], pos: str, size: str) -> DataFrame:
    """Position of each row in its group's total order, and the group size.

    Groups may span many tasks: rows are range-partitioned on (by, order), numbered inside
    their partition, and shifted by the group's row count in earlier partitions. The numbered
    rows are stored so that both reads below see the same partition numbers.
    """
    laid = durable(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_gid", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_gid", 33))
    parts = laid.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_gid").alias("_first"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *by,
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias(size),
    )
    joined = laid.join(parts, [*by, "_part"])
    return joined.withColumn(pos, F.col("_gid") - F.col("_first") + 1 + F.col("_before")).drop(
        "_gid", "_part", "_first", "_before"
    )


@dataclass(frozen=True)
class CrossSection:
    """Operators over ``keys.cross`` groups. ``wide`` selects the multi-task path."""

    keys: S.Keys = S.KEYS
    wide: bool = False

    @classmethod
    def sized(cls, group_rows: int, keys: S.Keys = S.KEYS, limit: int = WIDE_GROUP_ROWS) -> "CrossSection":
        """Pick the path from a proven upper bound of one group's rows.

        (date, instrument) is unique, so the number of instruments bounds a cross-section.
        """
        return cls(keys, group_rows > limit)

    # -- building blocks

    def ordinal(self, df: DataFrame, x: str, pos: str = "pos", size: str = "n", by: tuple[str, ...] | None = None) -> DataFrame:
        """1-based position by (x, instrument) and group size; ``x`` must not be null."""
        by = by or self.keys.cross
        order = [x, self.keys.instrument]
        if self.wide:
            return range_positions(df, by, order, pos, size)
        w = Window.partitionBy(*by)
        return df.withColumn(pos, F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn(
            size, F.count(F.lit(1)).over(w)
        )

    def stats(self, df: DataFrame, by: tuple[str, ...] | None = None, **aggs: Column) -> DataFrame:
        """Attach group aggregates to every row."""
        by = by or self.keys.cross
        if not self.wide:
            w = Window.partitionBy(*by)
            return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})
        found = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in aggs.items()])
        renamed = found.select(*[F.col(c).alias(f"_{c}") for c in by], *aggs)
        match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        return df.join(renamed, match, "left").drop(*[f"_{c}" for c in by])

    def average_rank(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """Average-tie rank 1..n of the non-null values (null stays null)."""
        by = self.keys.cross
        if not self.wide:
            ordered = Window.partitionBy(*by).orderBy(F.col(x).asc_nulls_last())
            mean_place = F.rank().over(ordered) + (F.count(x).over(S.peers(ordered)) - 1) / 2.0
            return df.withColumn(out, F.when(F.col(x).isNotNull(), mean_place))
        placed = self.ordinal(df.where(F.col(x).isNotNull()).select(*self.keys.row, x), x, "_pos", "_n")
        ties = placed.groupBy(*by, x).agg(((F.min("_pos") + F.max("_pos")) / 2.0).alias(out))
        return df.join(ties, [*by, x], "left").select(*df.columns, out)

    # -- operators

    def rank(self, df: DataFrame, x: str, out: str) -> DataFrame:
        if not self.wide:
            return df.withColumn(out, S.rank_column(F.col(x), self.keys))
        ranked = self.stats(self.average_rank(df, x, "_r"), _c=F.count(x))
        return ranked.withColumn(out, F.try_divide("_r", "_c")).drop("_r", "_c")

    def ntile(self, df: DataFrame, x: str, n: int, out: str) -> DataFrame:
        S.check_buckets(n)
        ranked = self.rank(df, x, "_p")
        bucket = F.least(F.greatest(F.ceil(F.col("_p") * n), F.lit(1)), F.lit(n)).cast("double")
        return ranked.withColumn(out, F.when(F.col(x).isNotNull(), bucket)).drop("_p")

    def zscore(self, df: DataFrame, x: str, out: str) -> DataFrame:
        s = self.stats(df, _m=F.avg(x), _s=F.stddev_samp(x), _lo=F.min(x), _hi=F.max(x))
        spread = F.when(F.col("_lo") < F.col("_hi"), F.col("_s"))
        return s.withColumn(out, F.try_divide(F.col(x) - F.col("_m"), spread)).drop("_m", "_s", "_lo", "_hi")

    def scale(self, df: DataFrame, x: str, out: str, target: float = 1.0) -> DataFrame:
        s = self.stats(df, _t=F.sum(F.abs(x)))
        return s.withColumn(out, F.try_divide(F.col(x), F.col("_t")) * F.lit(float(target))).drop("_t")

    def group_neutralize(self, df: DataFrame, x: str, group: str, out: str) -> DataFrame:
        s = self.stats(df, (*self.keys.cross, group), _m=F.avg(x))
        return s.withColumn(out, F.when(F.col(group).isNotNull(), F.col(x) - F.col("_m"))).drop("_m")

    def residualize(self, df: DataFrame, y: str, x: str, out: str) -> DataFrame:
        a, b = S.finite_pair(F.col(y), F.col(x))
        d = df.withColumns({"_a": a, "_b": b})
        s = self.stats(
            d,
            _ma=F.avg("_a"),
            _mb=F.avg("_b"),
            _cov=F.covar_pop("_a", "_b"),
            _var=F.var_pop("_b"),
            _lo=F.min("_b"),
            _hi=F.max("_b"),
        )
        slope = F.try_divide("_cov", "_var")
        value = F.col("_a") - (F.col("_ma") + slope * (F.col("_b") - F.col("_mb")))
        return s.withColumn(out, F.when(F.col("_lo") < F.col("_hi"), value)).drop(
            "_a", "_b", "_ma", "_mb", "_cov", "_var", "_lo", "_hi"
        )

    def winsorize(self, df: DataFrame, x: str, q: float, out: str) -> DataFrame:
        S.check_tail(q)
        if not self.wide:
            return df.withColumn(out, S.winsorize(F.col(x), q, self.keys).col)
        by = self.keys.cross
        placed = self.ordinal(df.where(F.col(x).isNotNull()).select(*self.keys.row, x), x, "_pos", "_n")

        def at(share: float, name: str):
            """Linear interpolation between the two rows around the quantile."""
            h = F.lit(share) * (F.col("_n") - 1)
            low = F.max(F.when(F.col("_pos") == F.floor(h) + 1, F.col(x)))
            high = F.max(F.when(F.col("_pos") == F.ceil(h) + 1, F.col(x)))
            part = F.max(h - F.floor(h))
            return (low + (high - low) * part).alias(name)

        bounds = placed.groupBy(*by).agg(at(q, "_low"), at(1.0 - q, "_high"))
        joined = df.join(bounds, list(by), "left")
        clipped = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_low")), F.col("_high")))
        return joined.withColumn(out, clipped).select(*df.columns, out)
