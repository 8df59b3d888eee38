"""Bootstrap of Sharpe ratios and of paired differences.

All strategies of a series are resampled with the same draws, so one set of replicates serves the
interval of every strategy and every paired comparison.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DEFAULT_CHUNKING
from ..functions import chunks
from ..functions.columns import zero
from ..functions.staging import stage
from ..schema import KEYS, TS
from .backtest import STRATEGY, sharpe

MIN_ITERATIONS = 20


def wide_returns(rows: DataFrame, streams, keys=KEYS, ts: str = TS, value: str = "strategy_return") -> DataFrame:
    """One row per (series, time) with one return column per strategy and a row number.

    The pivot is a plain grouped aggregate on (series, time) over the fixed list of streams.
    """
    wide = rows.groupBy(*keys, ts).agg(
        *[F.max(F.when(F.col(STRATEGY) == s, zero(F.col(value)))).alias(s) for s in streams]
    )
    return chunks.number_rows(wide, keys, ts)


def draw(*parts) -> Column:
    """A 48-bit number from the MD5 of the parts, joined by dashes; any SQL engine can repeat it."""
    text = F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def _centres(wide: DataFrame, streams, keys) -> DataFrame:
    """Per series its length ``_n`` and a value near the middle of each stream, so that sums of squares never cancel."""
    centre = lambda s: F.when(F.min(s) == F.max(s), F.min(s)).otherwise(F.avg(s)).alias(f"_m_{s}")
    return wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[centre(s) for s in streams])


def _summary(streams, annualization: int) -> list[Column]:
    """Sharpe and mean of every stream from ``_w``, ``_a_<s>`` and ``_q_<s>``: count, sum and squares around the centre."""
    n, out = F.sum("_w"), []
    for s in streams:
        a, q, centre = F.sum(f"_a_{s}"), F.sum(f"_q_{s}"), F.first(f"_m_{s}")
        spread = q - a * F.try_divide(a, n)
        # Draws of a single value leave only the rounding of their sums.
        std = F.sqrt(F.try_divide(F.when(spread > q * 1e-12, spread), n - 1))
        mean = centre + F.try_divide(a, n)
        ratio = F.try_divide(mean, std) * math.sqrt(annualization)
        out += [F.coalesce(ratio, F.lit(0.0)).alias(f"sharpe__{s}"), F.coalesce(mean, F.lit(0.0)).alias(f"mean__{s}")]
    return out


def bootstrap(
    wide: DataFrame, streams, annualization: int = 24, iterations: int = 250, seed: int = 42, keys=KEYS,
    method: str = "iid", index: str = chunks.ROW, block: int = DEFAULT_CHUNKING.rows,
) -> DataFrame:
    """One row per (series, replicate): Sharpe and mean of every stream.

    ``iid`` draws n rows with replacement. The draws of a replicate are first split over blocks of ``block`` rows,
    in proportion to their rows, then drawn inside each block from its values, which are one row of arrays. What is
    shuffled are blocks and, for series of several blocks, one count per (block, replicate): no draw ever moves.
    ``poisson`` gives every row an independent Poisson(1) weight per replicate instead (the streaming approximation
    for very long series): all sums are reduced before the shuffle.
    """
    iterations = max(iterations, MIN_ITERATIONS)
    streams = list(streams)
    centres = _centres(wide, streams, keys)
    reps = F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("replicate")
    if method == "poisson":
        return _poisson(wide, centres, streams, annualization, seed, keys, index, reps)
    values = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), *streams)))
    blocks = wide.groupBy(*keys, F.floor(F.col(index) / block).alias("_block")).agg(values.alias("_rows"))
    blocks = blocks.join(centres, list(keys)).withColumn("_size", F.size("_rows"))
    blocks = stage(
        blocks.withColumns({s: _column_of(s) for s in streams}).drop("_rows")
    )
    one = blocks.where(F.col("_n") <= block).select("*", reps, F.col("_n").alias("_w"))
    several = blocks.where(F.col("_n") > block)
    counts = _split_draws(several.select(*keys, "_n", "_block", "_size", reps), seed, keys, block)
    drawn = one.unionByName(several.join(counts, [*keys, "_block"]).select(*one.columns))
    pick = lambda k: F.pmod(draw(seed, F.col("replicate"), F.col("_block"), k), F.col("_size")).cast("int")
    drawn = drawn.withColumn("_picks", F.transform(F.sequence(F.lit(0).cast("long"), F.col("_w") - 1), pick))
    total = lambda s, f: F.aggregate("_picks", F.lit(0.0), lambda a, i: a + f(F.get(F.col(s), i)))
    sums = {}
    for s in streams:
        sums[f"_a_{s}"], sums[f"_q_{s}"] = total(s, lambda x: x), total(s, lambda x: x * x)
    return drawn.withColumns(sums).groupBy(*keys, "replicate").agg(*_summary(streams, annualization))


def _column_of(stream: str) -> Column:
    """The values of one stream in a block, around its centre."""
    return F.transform("_rows", lambda r: r[stream] - F.col(f"_m_{stream}"))


def _split_draws(blocks: DataFrame, seed: int, keys, block: int) -> DataFrame:
    """(keys, replicate, block, _w): how many of the n draws of a replicate fall into each block.

    Every slot draws a row number and only its block counts. The slots of a replicate are dealt over the blocks' own
    tasks and counted there before the shuffle, so at most one row per task, block and replicate moves.
    """
    slots = F.explode(F.sequence(F.col("_block") * block, F.col("_block") * block + F.col("_size") - 1)).alias("slot")
    to = F.floor(F.pmod(draw(seed, F.col("replicate"), "block", F.col("slot")), F.col("_n")) / block)
    spread = blocks.select(*keys, "replicate", "_n", "_block", "_size").select(*keys, "replicate", "_n", slots)
    return spread.groupBy(*keys, "replicate", to.alias("_block")).agg(F.count(F.lit(1)).alias("_w"))


def _poisson(wide, centres, streams, annualization, seed, keys, index, reps) -> DataFrame:
    # Inverse transform of a 48-bit uniform. Steps go on until no draw can lie beyond the last one.
    cuts, mass, total, k = [], math.exp(-1.0), math.exp(-1.0), 0
    while total <= 1.0 - 2.0**-48:
        cuts.append(total)
        k += 1
        mass /= k
        total += mass
    centred = chunks.attach(wide, centres.drop("_n"), keys, TS)
    rows = centred.select(*keys, index, *[f"_m_{s}" for s in streams], *[(F.col(s) - F.col(f"_m_{s}")).alias(s) for s in streams], reps)
    u = draw(seed, F.col("replicate"), F.col(index)) / F.lit(float(1 << 48))
    weight = F.lit(0.0)
    for c in cuts:
        weight = weight + (u >= c).cast("double")
    rows = rows.withColumn("_w", weight)
    sums = {}
    for s in streams:
        sums[f"_a_{s}"], sums[f"_q_{s}"] = F.col("_w") * F.col(s), F.col("_w") * F.col(s) * F.col(s)
    return rows.withColumns(sums).groupBy(*keys, "replicate").agg(*_summary(streams, annualization))


def _quantile(x: Column, q: float) -> Column:
    return F.percentile(x, F.lit(q))


def sharpe_intervals(boot: DataFrame, streams, keys=KEYS) -> DataFrame:
    """95% interval of each stream's Sharpe ratio, over the fixed number of replicates."""
    made = [
        F.struct(
            F.lit(s).alias(STRATEGY),
            _quantile(F.col(f"sharpe__{s}"), 0.025).alias("sharpe_ci_lower"),
            _quantile(F.col(f"sharpe__{s}"), 0.975).alias("sharpe_ci_upper"),
        ).alias(f"_r{i}")
        for i, s in enumerate(streams)
    ]
    wide = boot.groupBy(*keys).agg(*made)
    return wide.select(*keys, F.inline(F.array(*[F.col(f"_r{i}") for i in range(len(streams))])))


def paired(boot: DataFrame, pairs, keys=KEYS) -> DataFrame:
    """Mean difference, interval and verdict for each (strategy, baseline) pair."""
    made = []
    for i, (a, b) in enumerate(pairs):
        gap = F.col(f"sharpe__{a}") - F.col(f"sharpe__{b}")
        made.append(
            F.struct(
                F.lit(a).alias(STRATEGY),
                F.lit(b).alias("baseline_name"),
                F.avg(gap).alias("sharpe_diff"),
                F.avg(F.col(f"mean__{a}") - F.col(f"mean__{b}")).alias("pnl_diff_mean"),
                _quantile(gap, 0.025).alias("sharpe_diff_ci_lower"),
                _quantile(gap, 0.975).alias("sharpe_diff_ci_upper"),
                (_quantile(gap, 0.025) > 0).alias("significant_outperformance"),
            ).alias(f"_r{i}")
        )
    wide = boot.groupBy(*keys).agg(*made)
    return wide.select(*keys, F.inline(F.array(*[F.col(f"_r{i}") for i in range(len(pairs))])))


def bootstrap_sharpe(
    df: DataFrame, annualization: int = 24, iterations: int = 250, seed: int = 42, keys=KEYS, ts: str = TS,
    value: str = "strategy_return", method: str = "iid",
) -> DataFrame:
    """Sharpe ratio and its 95% interval for one return stream per series."""
    wide = chunks.number_rows(df.select(*keys, F.col(ts).alias(TS), zero(F.col(value)).alias("own")), keys, TS)
    point = wide.groupBy(*keys).agg(sharpe(F.col("own"), annualization).alias("sharpe"))
    boot = bootstrap(wide, ["own"], annualization, iterations, seed, keys, method)
    ci = sharpe_intervals(boot, ["own"], keys).drop(STRATEGY)
    return point.join(ci, list(keys)).withColumnsRenamed({"sharpe_ci_lower": "ci_lower", "sharpe_ci_upper": "ci_upper"})


def compare_streams(
    a: DataFrame, b: DataFrame, annualization: int = 24, iterations: int = 250, seed: int = 42, keys=KEYS,
    ts: str = TS, value: str = "strategy_return", method: str = "iid",
) -> DataFrame:
    """Paired bootstrap of two return streams, matched by position and cut to the shorter."""
    from .joins import pair_streams

    wide = pair_streams(a, b, keys, ts, value).withColumnsRenamed({ts: TS})
    wide = wide.withColumns({"a": zero(F.col("a")), "b": zero(F.col("b"))})
    return paired(bootstrap(wide, ["a", "b"], annualization, iterations, seed, keys, method), [("a", "b")], keys).drop(
        STRATEGY, "baseline_name"
    )
