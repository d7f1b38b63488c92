"""Minimum spanning forests by repeated minimum-edge contraction (Boruvka)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import materialize


def spanning_forest(nodes: DataFrame, edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """Returns ``(labels, forest)``: ``id, root`` for every node and the chosen edges ``u, v, w``.

    ``nodes`` has a BIGINT ``id``; ``edges`` has BIGINT ``u, v`` and a comparable ``w``. Every round each
    component takes its least edge by the total order (w, u, v) to another component; the chosen edges are
    contracted by pointer jumping. Components at least halve per round, so there are at most log2(n)
    rounds. Every state is a table in the shared folder. Self loops and repeated edges are harmless, nodes
    without edges keep themselves as root; roots are the least id of a contraction's 2-cycle, and the final
    root of a component is its least node id.
    """
    labels = materialize(nodes.select("id").distinct().withColumn("root", F.col("id")), "forest-l")
    e = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").distinct()
    live = materialize(e.withColumn("cu", F.col("u")).withColumn("cv", F.col("v")), "forest-e")
    chosen = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        pick = F.struct("w", "u", "v", "cu", "cv")
        both = live.select(F.col("cu").alias("c"), pick.alias("e")).unionAll(live.select(F.col("cv").alias("c"), pick.alias("e")))
        best = materialize(both.groupBy("c").agg(F.min("e").alias("e")), "forest-b")
        part = best.select("e.u", "e.v", "e.w").distinct()
        chosen = part if chosen is None else chosen.unionAll(part)
        hook = best.select("c", F.when(F.col("c") == F.col("e.cu"), F.col("e.cv")).otherwise(F.col("e.cu")).alias("p"))
        back = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        up = hook.join(back, "p", "left").select(
            "c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
        )
        up = materialize(up, "forest-p")
        while True:  # pointer jumping: a tree of depth d takes log2(d) rounds
            g = up.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            nxt = materialize(up.join(g, "p", "left").select("c", "p", F.coalesce("pp", "p").alias("q")), "forest-p")
            moved = nxt.filter("p <> q").isEmpty()
            up = nxt.select("c", F.col("q").alias("p"))
            if moved:
                break
        to = up.select(F.col("c").alias("root"), F.col("p").alias("to"))
        labels = materialize(labels.join(to, "root", "left").select("id", F.coalesce("to", "root").alias("root")), "forest-l")
        m = live
        for c in ("cu", "cv"):
            m = m.join(to.select(F.col("root").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        live = materialize(m.filter("cu <> cv").select("u", "v", "w", "cu", "cv"), "forest-e")
    least = labels.groupBy("root").agg(F.min("id").alias("least"))
    labels = materialize(labels.join(least, "root").select("id", F.col("least").alias("root")), "forest-l")
    if chosen is None:
        chosen = e.limit(0)
    return labels, chosen
