"""Falsification diagnostics on a labelled frame: placebo, lagged IC, half-life, date blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswind.functions.signals import KEYS
from crosswind.operators.cross_section import CrossSection
from crosswind.operators.evaluate import daily_rank_ic
from crosswind.session import durable
from crosswind.sources.panel import duplicate_keys

# Fixed values.
MIN_DATES = 30
MAX_LAG = 5
PERMUTATIONS = 50
BLOCKS = 3
MIN_LAG_DATES = 2
#: Rows hashed at once.
STRETCH = 16384
MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
MD5_SHIFTS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], np.uint32)


def frame_checks(frame: DataFrame) -> DataFrame:
    """Missing columns and duplicate keys, one row per problem."""
    need = ("trade_date", "instrument", "score", "forward_return")
    missing = [c for c in need if c not in frame.columns]
    if missing:
        raise ValueError(f"labelled frame is missing columns: {missing}")
    return duplicate_keys(frame)


def lagged_ic(frame: DataFrame, xs: CrossSection, max_lag: int = MAX_LAG) -> DataFrame:
    """Mean rank IC of scores shifted by 1..max_lag rows; null below two dates.

    All lags share one window and one ranking job, keyed by lag.
    """
    w = KEYS.over_series()
    cells = [F.struct(F.lit(k).alias("lag"), F.lag("score", k).over(w).alias("score")) for k in range(1, max_lag + 1)]
    shifted = frame.select("trade_date", "instrument", "forward_return", F.array(*cells).alias("_c"))
    long = shifted.select("trade_date", "instrument", "forward_return", F.inline("_c"))
    return _lag_means(daily_rank_ic(long, xs, ("lag",)))


def _lag_means(daily: DataFrame) -> DataFrame:
    per_lag = daily.groupBy("lag").agg(F.count("ic").alias("dates"), F.avg("ic").alias("mean_ic"))
    return per_lag.select("lag", "dates", F.when(F.col("dates") >= MIN_LAG_DATES, F.col("mean_ic")).alias("mean_ic"))


def half_life(lags: DataFrame) -> DataFrame:
    """Log-linear decay of the positive lagged ICs (at most one row per lag)."""
    points = lags.where(F.col("mean_ic") > 0).select("lag", F.ln("mean_ic").alias("y"))
    fit = points.agg(F.count(F.lit(1)).alias("points"), F.regr_slope("y", "lag").alias("slope"))
    falling = (F.col("points") >= 2) & (F.col("slope") < 0)
    return fit.select(
        "points",
        F.when(falling, -F.col("slope")).alias("decay_rate"),
        F.when(falling, F.try_divide(F.ln(F.lit(2.0)), -F.col("slope"))).alias("half_life"),
        F.when(F.col("points") < 2, "INSUFFICIENT_POSITIVE_LAG_ICS")
        .when(F.col("slope") >= 0, "NON_POSITIVE_IC_DECAY")
        .otherwise("")
        .alias("warning"),
    )


def date_blocks(daily: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Near-equal consecutive blocks of evaluable dates; the first blocks take the extra."""
    dated = daily.where(F.col("ic").isNotNull()).select(
        "trade_date", "ic", F.ntile(blocks).over(Window.orderBy("trade_date")).alias("block")
    )
    return dated.groupBy("block").agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg("ic").alias("mean_ic"),
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
    )


def block_stability(block_rows: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Spread of block means and agreement of their signs."""
    a = block_rows.agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("mean_ic") - F.min("mean_ic")).alias("spread"),
        (F.abs(F.sum(F.signum("mean_ic"))) / blocks).alias("consistency"),
    )
    ok = F.col("n") == blocks
    return a.select(
        F.when(ok, F.col("spread")).alias("spread"),
        F.when(ok, F.col("consistency")).alias("sign_consistency"),
        F.when(ok & (F.col("consistency") < 1), "WEAK_BLOCK_SIGN_CONSISTENCY").otherwise("").alias("warning"),
    )


def _standard_ranks(x: np.ndarray) -> np.ndarray | None:
    """Average-tie ranks less their mean over their spread; none if all are equal."""
    _, place, count = np.unique(x, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2.0)[place]
    spread = ranks.std()
    return (ranks - ranks.mean()) / spread if spread > 0 else None


def _hash_order(prefix: bytes, names: list[bytes]) -> np.ndarray:
    """The rows, given in order of their names, by the md5 of prefix and name."""
    digests = np.frombuffer(b"".join([hashlib.md5(prefix + n).digest() for n in names]), ">u8").reshape(-1, 2)
    return np.lexsort((digests[:, 1], digests[:, 0]))


def _md5_heads(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes of the md5 of each row of ``text``, of one block: 64 bytes, zero beyond its length, which is 55 at most."""
    text[np.arange(len(text)), lengths] = 0x80
    words = np.ascontiguousarray(text.view("<u4").T)
    words[14] = lengths * 8
    used = [w.any() for w in words]
    a, b, c, d = (np.full(len(text), x, np.uint32) for x in MD5_START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
        elif turn == 1:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
        elif turn == 2:
            np.bitwise_xor(b, c, f)
            f ^= d
        else:
            np.invert(d, f)
            f |= b
            f ^= c
        f += a
        f += MD5_SINES[i]
        word = (i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16
        if used[word]:
            f += words[word]
        left = MD5_SHIFTS[turn, i % 4]
        np.left_shift(f, left, t)
        f >>= np.uint32(32) - left
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += MD5_START[0]
    b += MD5_START[1]
    return (a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()


def _hash_orders(prefixes: list[bytes], names: list[bytes]) -> Iterator[np.ndarray]:
    """``_hash_order`` for each prefix, a stretch of texts at once; long texts and equal heads go the plain way."""
    width = max(1, max(map(len, names)))
    if max(map(len, prefixes)) + width > 55:
        yield from (_hash_order(prefix, names) for prefix in prefixes)
        return
    laid = np.array(names, f"S{width}").view(np.uint8).reshape(-1, width)
    lengths = np.array([len(n) for n in names])
    together = max(1, STRETCH // len(names))
    for first in range(0, len(prefixes), together):
        some = prefixes[first : first + together]
        heads = np.empty((len(some), len(names)), np.uint64)
        for at in range(0, len(names), STRETCH):
            part = laid[at : at + STRETCH]
            text = np.zeros((len(some), len(part), 64), np.uint8)
            for rows, prefix in zip(text, some):
                rows[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
                rows[:, len(prefix) : len(prefix) + width] = part
            sizes = np.add.outer([len(prefix) for prefix in some], lengths[at : at + STRETCH])
            heads[:, at : at + STRETCH] = _md5_heads(text.reshape(-1, 64), sizes.ravel()).reshape(len(some), -1)
        for prefix, own in zip(some, heads):
            order = np.argsort(own)
            ties = (own[order[1:]] == own[order[:-1]]).any()
            yield _hash_order(prefix, names) if ties else order


DAY_ICS = "trade_date date, ic double, perms array<double>, lags array<double>"


def day_ics(frame: DataFrame, seed: int, permutations: int, lagged: tuple[str, ...] = ()) -> DataFrame:
    """Per date: `ic`, the rank IC of `score`, `perms`, that of each permutation, and `lags`, that of each column of ``lagged``.

    One exchange by date carries all of them. An IC without spread is null. A date is bounded by the number of instruments (see
    ``CrossSection.sized``).
    """
    frame = frame.select(
        F.col("trade_date").cast("date").alias("trade_date"), "instrument", *[F.col(c).cast("double").alias(c) for c in ("score", "forward_return", *lagged)]
    )
    schema = pa.schema([("trade_date", pa.date32()), ("ic", pa.float64()), ("perms", pa.list_(pa.float64())), ("lags", pa.list_(pa.float64()))])

    def day(key, table):
        held = {c: table.column(c).is_valid().to_numpy() for c in ("score", "forward_return", *lagged)}
        values = {c: table.column(c).to_numpy() for c in held}

        def ranks(score, rows):
            zs, zf = (_standard_ranks(values[c][rows]) if len(rows) else None for c in (score, "forward_return"))
            return None if zs is None or zf is None else (zs, zf)

        def ic(pair):
            return None if pair is None else float(pair[0] @ pair[1]) / len(pair[0])

        date, rows = key[0].as_py(), np.flatnonzero(held["score"] & held["forward_return"])
        names = [n.encode() for n in table.column("instrument").take(pa.array(rows)).to_pylist()]
        order = sorted(range(len(names)), key=names.__getitem__)
        pair, perms = ranks("score", rows[order]), None
        if pair is not None and permutations:
            prefixes = [f"{seed}|{p}|{date}|".encode() for p in range(1, permutations + 1)]
            perms = [ic((pair[0], pair[1][place])) for place in _hash_orders(prefixes, [names[i] for i in order])]
        lags = [ic(ranks(c, np.flatnonzero(held[c] & held["forward_return"]))) for c in lagged]
        return pa.table([[date], [ic(pair)], [perms], [lags]], schema=schema)

    return frame.groupBy("trade_date").applyInArrow(day, DAY_ICS)


def placebo_day_ics(both: DataFrame, seed: int, permutations: int) -> DataFrame:
    """Per date: `ic`, the real rank IC, and `perms`, that of each permutation; dates without spread are left out."""
    return day_ics(both, seed, permutations).where("ic is not null").drop("lags")


def placebo_percentile(frame: DataFrame, xs: CrossSection, seed: int, permutations: int = PERMUTATIONS) -> DataFrame:
    """Where the real mean IC falls among within-date permutations of the scores.

    A permutation gives each row the score rank held by the row with the same place in a
    hash order. Since every permutation of a date holds the same ranks, its IC only needs
    the cross product. A date that fits one task does all permutations there (``placebo_day_ics``). A wider one is sorted once
    for each permutation across tasks, so there the rows that move grow with the permutations; the deviations are summed map-side.
    """
    both = frame.where(F.col("score").isNotNull() & F.col("forward_return").isNotNull()).select(
        F.col("trade_date").cast("date").alias("trade_date"), "instrument", F.col("score").cast("double").alias("score"), F.col("forward_return").cast("double").alias("forward_return")
    )
    if not xs.wide:
        return _day_percentile(durable(placebo_day_ics(both, seed, permutations)))
    ranked = xs.average_rank(xs.average_rank(both, "score", "rs"), "forward_return", "rf")
    by_day = xs.stats(
        ranked, ("trade_date",), _ms=F.avg("rs"), _mf=F.avg("rf"), _ss=F.stddev_pop("rs"), _sf=F.stddev_pop("rf"), _n=F.count(F.lit(1))
    ).where((F.col("_ss") > 0) & (F.col("_sf") > 0))
    base = by_day.select(
        "trade_date",
        "instrument",
        ((F.col("rs") - F.col("_ms")) / F.col("_ss")).alias("zs"),
        ((F.col("rf") - F.col("_mf")) / F.col("_sf")).alias("zf"),
        "_n",
    )
    base = durable(base)
    perms = base.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    perms = perms.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), "perm", "trade_date", "instrument")))
    keys = ("perm", "trade_date")
    # Places by instrument and by hash; the row at hash place p receives the score of row p.
    by_name = xs.ordinal(base.withColumn("_o", F.lit(0)), "_o", "_place", "_c", ("trade_date",)).select("trade_date", "_place", "zs", "_n")
    by_hash = xs.ordinal(perms, "_h", "_place", "_c", keys).select(*keys, "_place", "zf")
    ic = by_hash.join(by_name, ["trade_date", "_place"]).groupBy(*keys).agg((F.sum(F.col("zs") * F.col("zf")) / F.max("_n")).alias("ic"))
    real_daily = base.groupBy("trade_date").agg((F.sum(F.col("zs") * F.col("zf")) / F.max("_n")).alias("ic"))
    return _percentile(ic, real_daily)


def _day_percentile(days: DataFrame) -> DataFrame:
    return _percentile(days.select("trade_date", F.posexplode("perms").alias("perm", "ic")), days)


def _percentile(ic: DataFrame, real_daily: DataFrame) -> DataFrame:
    """The place of the real mean of daily ICs among those of the permutations (perm, trade_date, ic)."""
    means = ic.groupBy("perm").agg(F.avg("ic").alias("mean_ic"))
    real = real_daily.agg(F.avg("ic").alias("real"), F.count(F.lit(1)).alias("dates"))
    pooled = means.select("mean_ic", F.lit(None).cast("double").alias("real"), F.lit(None).cast("bigint").alias("dates")).unionByName(
        real.select(F.lit(None).cast("double").alias("mean_ic"), "real", "dates")
    )
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per permutation plus the real one: a fixed, tiny set.
    scored = pooled.withColumns({"_real": F.max("real").over(whole), "_dates": F.max("dates").over(whole)}).where("mean_ic is not null")
    below = F.sum((F.col("mean_ic") < F.col("_real")).cast("double") + 0.5 * (F.col("mean_ic") == F.col("_real")).cast("double"))
    return scored.agg(
        (below / F.count(F.lit(1))).alias("percentile"),
        F.count(F.lit(1)).alias("permutations"),
        F.max("_dates").alias("evaluable_dates"),
        F.max("_real").alias("real_mean_ic"),
    )


def floor_status(daily: DataFrame, minimum: int = MIN_DATES) -> DataFrame:
    """Evaluable dates and the status every diagnostic gets from them."""
    enough = F.col("evaluable_dates") >= minimum
    return daily.agg(F.count("ic").alias("evaluable_dates"), F.avg("ic").alias("mean_ic")).select(
        "evaluable_dates",
        F.when(enough, F.col("mean_ic")).alias("real_rank_ic_mean"),
        F.when(enough, "available").otherwise("insufficient_sample").alias("status"),
        F.when(enough, "").otherwise("BELOW_FALSIFICATION_SAMPLE_FLOOR").alias("warning"),
    )


def falsification_report(frame: DataFrame, xs: CrossSection, seed: int, permutations: int = PERMUTATIONS) -> DataFrame:
    """All diagnostics as (metric, segment, value, observations) rows.

    Where a date fits one task, one exchange by date gives its real, lagged and permuted ICs; all diagnostics come from these.
    """
    frame = frame.select("trade_date", "instrument", "score", "forward_return")
    if xs.wide:
        frame = durable(frame)
        daily = durable(daily_rank_ic(frame, xs, ()))
        lags = durable(lagged_ic(frame, xs))
        placebo = placebo_percentile(frame, xs, seed, permutations)
    else:
        w, names = KEYS.over_series(), tuple(f"_lag{k}" for k in range(1, MAX_LAG + 1))
        shifted = frame.withColumns({name: F.lag("score", k).over(w) for k, name in enumerate(names, 1)})
        daily = durable(day_ics(shifted, seed, permutations, names))
        lags = durable(_lag_means(daily.select(F.posexplode("lags").alias("lag", "ic")).withColumn("lag", F.col("lag") + 1)))
        placebo = _day_percentile(daily.where("ic is not null"))

    def rows(df, metric, segment: Column, value: str, n: Column):
        return df.select(F.lit(metric).alias("metric"), segment.alias("segment"), F.col(value).alias("value"), n.cast("bigint").alias("observations"))

    floor = floor_status(daily)
    blocks = date_blocks(daily)
    none = F.lit("")
    out = rows(floor, "real_rank_ic_mean", none, "real_rank_ic_mean", F.col("evaluable_dates"))
    for part in (
        rows(placebo, "placebo_percentile", none, "percentile", F.col("evaluable_dates")),
        rows(lags, "lag_ic", F.concat(F.lit("lag_"), F.col("lag").cast("string")), "mean_ic", F.col("dates")),
        rows(half_life(lags), "ic_half_life", none, "half_life", F.col("points")),
        rows(half_life(lags), "ic_decay_rate", none, "decay_rate", F.col("points")),
        rows(blocks, "block_ic", F.concat(F.lit("block_"), F.col("block").cast("string")), "mean_ic", F.col("dates")),
        rows(block_stability(blocks), "block_ic_spread", none, "spread", F.lit(BLOCKS)),
        rows(block_stability(blocks), "block_sign_consistency", none, "sign_consistency", F.lit(BLOCKS)),
    ):
        out = out.unionByName(part)
    # Below the sample floor every diagnostic is insufficient; the first row tells.
    dates = F.max(F.when(F.col("metric") == "real_rank_ic_mean", F.col("observations"))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return out.withColumn("value", F.when(dates >= MIN_DATES, F.col("value")))
