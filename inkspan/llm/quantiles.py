"""Problem 6: percentiles of very large numeric columns, by radix selection (``inkspan.operators.radix``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import name_key
from inkspan.operators.radix import MAX_BROADCAST_TARGETS, histogram, key_percentiles, merge_percentiles, ordered_bits
from inkspan.session import materialize

QS = (0.01, 0.25, 0.5, 0.75, 0.99)
GROUPS = ("measure", "kind", "grp")


def _kinds(**kinds: Column) -> Column:
    """The groups a value belongs to, as (kind, group) pairs."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("grp")) for k, v in kinds.items()])).alias("g")


def _day(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def measures(features: DataFrame, evidence: DataFrame, essays: DataFrame) -> DataFrame:
    """``measure, kind, grp, day, key``: every value once per kind of group (prompt, generator, family, day), with its day.

    Names of prompts and generators group by their reduced form; missing names are the group ''. Keys absent
    from a map give no row. ``key`` holds the ordered bits of the value. Names, days and bits are worked out once per
    value and written; the kinds are told apart only where that table is read.
    """
    none = F.lit(None).cast("string")
    f = features.select(
        F.explode("feature_values").alias("measure", "value"), name_key("prompt_name").alias("p"), name_key("generator").alias("q"), none.alias("fam"), _day("extracted_at").alias("day"))
    e = evidence.select(F.lit("z_score").alias("measure"), F.col("z_score").alias("value"), none.alias("p"), none.alias("q"), F.coalesce("family", F.lit("")).alias("fam"), _day("scored_at").alias("day"))
    s = essays.select(
        F.lit("label").alias("measure"), F.col("label").cast("double").alias("value"), name_key("prompt_name").alias("p"), name_key("generator").alias("q"), none.alias("fam"), _day("collected_at").alias("day"))
    v = f.unionByName(e).unionByName(s).filter("value is not null and not isnan(value)")
    t = materialize(v.select("measure", "p", "q", "fam", "day", ordered_bits("value").alias("key")), "p6-values")
    kinds = _kinds(prompt=F.col("p"), generator=F.col("q"), family=F.col("fam"), day=F.col("day"))
    return t.select("measure", "day", "key", kinds).filter("g.grp is not null").select("measure", "g.kind", "g.grp", "day", "key")


def _keyed(values: DataFrame) -> DataFrame:
    """Values by their ordered bits; NULL and NaN are no values."""
    if "key" in values.columns:
        return values
    return values.filter("value is not null and not isnan(value)").withColumn("key", ordered_bits("value"))


def group_percentiles(values: DataFrame, qs: Sequence[float] = QS) -> DataFrame:
    """``measure, kind, grp, q, n, value``: exact nearest-rank percentiles (stated error: none)."""
    return key_percentiles(_keyed(values), GROUPS, "key", qs)


def coded_sketch(values: DataFrame, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The mergeable part of each group and day as ``(counts: code, prefix, n; names: code, measure, kind, grp, day)``.

    Counts carry a 64-bit code of their group and day instead of its names: at most 2**bits counters each.
    """
    every = F.col("kind") == "day"
    day = F.col("day") if "day" in values.columns else F.when(every, F.col("grp"))
    v = _keyed(values).select(
        "measure", F.when(every, "all").otherwise(F.col("kind")).alias("kind"), F.when(every, "").otherwise(F.col("grp")).alias("grp"), day.alias("day"), "key")
    v = v.withColumn("code", F.xxhash64("measure", "kind", "grp", F.coalesce("day", F.lit("")), F.col("day").isNull()))
    counts = materialize(histogram(v, ["code"], "key", bits), "p6-sketch")
    return counts, materialize(v.select("code", *GROUPS, "day").distinct(), "p6-names")


def day_sketch(values: DataFrame, bits: int = 24) -> DataFrame:
    """``measure, kind, grp, day, prefix, n``: the mergeable part of each group and day, at most 2**bits counters of one.

    The rows of kind 'day' are those of the group of all values (kind 'all', group '').
    """
    counts, names = coded_sketch(values, bits)
    return counts.join(names, "code").drop("code")


def combined_percentiles(values: DataFrame, qs: Sequence[float] = QS, bits: int = 24) -> DataFrame:
    """``measure, kind, grp, q, n, value``: percentiles of each group, and of all values, over all days from the
    combined day sketches: relative error below 2**(12 - bits).
    """
    counts, names = coded_sketch(values, bits)
    group = names.select("code", F.xxhash64(*GROUPS).alias("group"))
    group = F.broadcast(group) if names.count() <= MAX_BROADCAST_TARGETS else group
    p = merge_percentiles(counts.join(group, "code").select("group", "prefix", "n"), ["group"], qs, bits)
    return p.join(names.select(F.xxhash64(*GROUPS).alias("group"), *GROUPS).distinct(), "group").select(*GROUPS, "q", "n", "value")
