"""Partly rewritten texts: choice of sentences, rebuilding with spans, resumable appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.operators.corpus import MINHASH_SEED, order_key

LOW, HIGH, MIN_SENTENCES, VARIANTS = 0.30, 0.60, 8, 5


def choose(sent: DataFrame, id_col: str = "essay_id", seed: int = MINHASH_SEED) -> DataFrame:
    """Adds ``chosen``: in texts of at least eight sentences a share between 0.3 and 0.6 of them, by least random key."""
    doc = W.partitionBy(id_col)
    s = sent.withColumn("n", F.count(F.lit(1)).over(doc)).filter(F.col("n") >= MIN_SENTENCES)
    unit = F.pmod(order_key(id_col, seed), F.lit(1000)) / 1000.0
    k = F.greatest(F.lit(1), F.bround(F.col("n") * (LOW + (HIGH - LOW) * unit), 0).cast("int"))
    key = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.col("sent_idx").cast("string"), F.lit(str(seed))))
    r = F.row_number().over(doc.orderBy(key, "sent_idx"))
    return s.withColumn("chosen", r <= k).drop("n")


def rebuild(chosen: DataFrame, rewrite: Callable[[Column], Column], id_col: str = "essay_id") -> DataFrame:
    """``id, sent_idx, start_char, end_char, is_rewritten, text``: sentences joined by a blank, with their new offsets.

    A rewrite that is empty or changes nothing leaves the sentence as it was.
    """
    new = rewrite(F.col("text"))
    use = F.col("chosen") & new.isNotNull() & (F.trim(new) != "") & (new != F.col("text"))
    t = chosen.select(id_col, "sent_idx", F.when(use, new).otherwise(F.col("text")).alias("text"), use.alias("is_rewritten"))
    before = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy(id_col).orderBy("sent_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return t.select(id_col, "sent_idx", before.alias("start_char"), (before + F.length("text")).alias("end_char"), "is_rewritten", "text")


def variant(df: DataFrame, id_col: str = "essay_id") -> Column:
    """Instruction variant, round robin in hashed order of the ids."""
    return F.pmod(F.xxhash64(id_col), F.lit(VARIANTS)).cast("int")


def pending(todo: DataFrame, done: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """What a restarted run has left to do."""
    return todo.join(done.select(id_col), id_col, "left_anti")
