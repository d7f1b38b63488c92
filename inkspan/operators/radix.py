"""Order statistics by radix selection over order-preserving integers.

A 64-bit key is read in digits from the top. Each round counts, per group, how often each digit occurs
among the keys that share the prefix followed so far, and goes on only into the digit that holds a
target rank. No group is ever sorted or collected: a round moves at most one counter per (group, digit).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.session import materialize

#: Targets up to this many rows are broadcast to filter a round; beyond it the filter is a shuffled join.
MAX_BROADCAST_TARGETS = 200_000


@F.pandas_udf(T.LongType())
def ordered_bits(s: pd.Series) -> pd.Series:
    """Double to BIGINT so that the order of the integers is that of the doubles (-0.0 equals 0.0)."""
    b = (s.to_numpy("float64") + 0.0).view("int64")
    return pd.Series(b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(s: pd.Series) -> pd.Series:
    b = s.to_numpy("int64")
    return pd.Series((b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF)).view("float64"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST_TARGETS else df


def histogram(df: DataFrame, groups: Sequence[str], key: str, bits: int, weight: Column | None = None) -> DataFrame:
    """Counts per group and per prefix of ``bits`` bits of the ordered key: ``groups, prefix, n``.

    Histograms of separate partitions or days are combined by adding ``n`` up.
    """
    w = F.lit(1) if weight is None else weight
    return df.groupBy(*groups, F.shiftright(F.col(key), 64 - bits).alias("prefix")).agg(F.sum(w).cast("bigint").alias("n"))


def _code(groups: Sequence[str]) -> Column:
    """One number for a group, NULLs told apart by their place: later passes shuffle it instead of the group's names."""
    return F.xxhash64(*[F.col(g) for g in groups], *[F.col(g).isNull() for g in groups])


def _follow(hist: DataFrame, targets: DataFrame, groups: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """From each target rank into the digit that holds it: adds prefix, and makes the rank relative to it.

    ``hist`` has one row per (groups, prefix): at most 2**digit rows per window.
    """
    w = W.partitionBy(*groups).orderBy("prefix")
    cum = hist.withColumn("hi", F.sum("n").over(w)).withColumn("lo", F.col("hi") - F.col("n")).drop("n")
    j = cum.join(targets, list(groups))
    return j.filter("rank > lo and rank <= hi").select(*groups, *tags, "prefix", (F.col("rank") - F.col("lo")).alias("rank"))


def select_ranks(
    df: DataFrame,
    groups: Sequence[str],
    key: str,
    targets,
    tags: Sequence[str],
    first_bits: int = 16,
    digit_bits: int = 16,
) -> DataFrame:
    """The keys at the given ranks: one row ``groups, tags, key`` per target.

    ``targets`` is a function of the group sizes (``groups, n``) that returns ``groups, tags, rank`` with
    1 <= rank <= n. Rows whose key is NULL are left out; NULL is a group like any other if ``targets`` keeps it. The
    source is read twice: for the first digit, and for the keys behind the digits followed, which are counted per
    distinct key at once; all later digits work on that count table. Groups are named in the first pass and go by a
    64-bit code afterwards.
    """
    src = df.filter(F.col(key).isNotNull())
    hist = materialize(histogram(src, groups, key, first_bits), "radix-h")
    sizes = hist.groupBy(*groups).agg(F.sum("n").alias("n"))
    goals = targets(sizes).select(_code(groups).alias("_g"), *groups, *tags, "rank")
    names = [*groups, *tags]
    state = materialize(_follow(hist.select(_code(groups).alias("_g"), "prefix", "n"), goals, ["_g"], names), "radix-t")
    wanted = state.select("_g", "prefix").distinct()
    pref = F.shiftright(F.col(key), 64 - first_bits)
    left = src.select(_code(groups).alias("_g"), F.col(key).alias("_radix"), pref.alias("prefix")).join(
        _small(wanted, state.count()), ["_g", "prefix"], "left_semi"
    )
    counts = materialize(left.groupBy("_g", "prefix", "_radix").agg(F.count(F.lit(1)).alias("n")), "radix-k")
    done = first_bits
    while done < 64:
        step = min(digit_bits, 64 - done)
        done += step
        prev = state.withColumnRenamed("prefix", "parent")
        h = counts.join(state.select("_g", "prefix").distinct(), ["_g", "prefix"], "left_semi").groupBy(
            "_g", F.col("prefix").alias("parent"), F.shiftright("_radix", 64 - done).alias("prefix")
        ).agg(F.sum("n").alias("n"))
        state = materialize(_follow(h, prev, ["_g", "parent"], names).drop("parent"), "radix-t")
        if done < 64:
            counts = counts.withColumn("prefix", F.shiftright("_radix", 64 - done))
    return state.select(*groups, *tags, F.col("prefix").alias(key))


def percentile_targets(qs: Sequence[float]):
    """Ranks ceil(q * n), at least 1, for each quantile: the nearest-rank definition."""
    arr = F.array(*[F.lit(float(q)) for q in qs])

    def make(sizes: DataFrame) -> DataFrame:
        return sizes.select("*", F.explode(arr).alias("q")).withColumn(
            "rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))).cast("bigint")
        )

    return make


def percentiles(df: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact nearest-rank percentiles per group: ``groups, q, n, value``.

    NULL and NaN are no values; infinities are the extremes; -0.0 equals 0.0. A group without values
    gives no row. Percentiles of an empty table are an empty table.
    """
    return key_percentiles(df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*groups, ordered_bits(value).alias("_key")), groups, "_key", qs)


def key_percentiles(df: DataFrame, groups: Sequence[str], key: str, qs: Sequence[float]) -> DataFrame:
    """``percentiles`` of values that are given by their ordered bits."""
    sel = select_ranks(df.select(*groups, key), groups, key, percentile_targets(qs), ["q", "n"])
    return sel.select(*groups, "q", "n", from_ordered_bits(key).alias("value"))


def merge_percentiles(hist: DataFrame, groups: Sequence[str], qs: Sequence[float], bits: int) -> DataFrame:
    """Percentiles from combined prefix histograms (``groups, prefix, n``; partial rows are added up).

    Each value is the lower edge of the prefix cell that holds the rank, so the relative error of a normal
    number is below 2**(12 - bits), and the result does not depend on how the data were cut into parts.
    """
    h = materialize(hist.groupBy(*groups, "prefix").agg(F.sum("n").alias("n")), "radix-m")
    sizes = h.groupBy(*groups).agg(F.sum("n").alias("n"))
    t = materialize(percentile_targets(qs)(sizes), "radix-t")
    st = _follow(h, _small(t.withColumnRenamed("n", "total"), t.count()), groups, ["q", "total"])
    edge = F.shiftleft(F.col("prefix"), 64 - bits)
    return st.select(*groups, "q", F.col("total").alias("n"), from_ordered_bits(edge).alias("value"))
