"""Pairs of items that share a bucket, whatever the sizes of the buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of one bucket that meet in one cell of the pair matrix: a task's unit of work is its square.
BLOCK = 2048


def bucket_pairs(rows: DataFrame, key: str, item: str, block: int = BLOCK) -> DataFrame:
    """``a, b`` (a < b): every pair of items of one bucket, once per bucket; ``rows`` holds ``key, item``, repeats allowed.

    Buckets of two, nearly all of those that matter, come out of one aggregation. Larger ones are cut into blocks of
    items, and each pair of blocks is a cell of its own, so that no bucket, however hot, meets in one task.
    """
    # The same filter in all three readers, so that they share one shuffle of the rows.
    rows = rows.select(key, item).filter(F.col(key).isNotNull() & F.col(item).isNotNull())
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(item).alias("a"), F.max(item).alias("b"))
    two = n.filter("_n = 2 and a < b").select("a", "b")
    more = n.filter("_n > 2 and a < b").select(key, F.ceil(F.col("_n") / block).cast("int").alias("_m"))
    r = rows.join(more.hint("shuffle_hash"), key).distinct().withColumn("_i", F.pmod(F.xxhash64(item, F.lit("block")), F.col("_m")).cast("int"))
    # Block i stands in the cells (i, k) as rows and in the cells (k, i) as columns; a cell on the diagonal is both.
    own = F.transform(F.sequence("_i", F.col("_m") - 1), lambda k: F.struct(F.col("_i").alias("r"), k.alias("c"), F.lit(True).alias("row")))
    other = F.transform(F.sequence(F.lit(0), F.col("_i") - 1), lambda k: F.struct(k.alias("r"), F.col("_i").alias("c"), F.lit(False).alias("row")))
    cell = r.select(key, F.col(item).alias("x"), F.explode(F.when(F.col("_i") > 0, F.concat(own, other)).otherwise(own)).alias("_c"))
    # A cell's two lists hold about a block each.
    g = cell.groupBy(key, "_c.r", "_c.c").agg(F.collect_list(F.when(F.col("_c.row"), F.col("x"))).alias("xs"), F.collect_list(F.when(~F.col("_c.row"), F.col("x"))).alias("ys"))
    g = g.withColumn("ys", F.when(F.col("r") == F.col("c"), F.col("xs")).otherwise(F.col("ys")))
    p = g.select("r", "c", "ys", F.explode("xs").alias("x")).select("r", "c", "x", F.explode("ys").alias("y")).filter("r < c or x < y")
    return two.unionAll(p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
