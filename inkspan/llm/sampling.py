"""Problem 7: a sample that matches target proportions.

Count the categories, allocate whole quotas by largest remainder with floors and availability caps, select the
rows with the smallest random keys of each category, and report what falls short.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import name_key
from inkspan.operators.radix import select_ranks
from inkspan.session import materialize

#: Plans are lists written by people; more cells than this are refused rather than collected.
MAX_CELLS = 100_000
DIMENSIONS = ("prompt_name", "generator")


def cell_counts(df: DataFrame, targets: DataFrame) -> DataFrame:
    """``plan_id, cell_id, available``: the rows that match each cell, NULL in a cell meaning any value."""
    keys = [name_key(c).alias(f"k_{c}") for c in DIMENSIONS]
    counts = materialize(df.select(*keys, F.col("label").alias("k_label")).groupBy("k_prompt_name", "k_generator", "k_label").agg(F.count(F.lit(1)).alias("n")), "p7-counts")
    return _match(counts, targets).groupBy("plan_id", "cell_id").agg(F.sum("n").alias("available"))


def _match(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows joined to all cells they match; one equi-join per pattern of given dimensions."""
    t = targets.select(
        "plan_id", "cell_id",
        *[F.when(F.col(c).isNotNull(), name_key(c)).alias(f"k_{c}") for c in DIMENSIONS], F.col("label").alias("k_label"),
    )
    cols = [f"k_{c}" for c in DIMENSIONS] + ["k_label"]
    patterns = [tuple(r) for r in t.select(*[F.col(c).isNotNull() for c in cols]).distinct().collect()]  # at most 8
    parts = []
    for p in sorted(patterns):
        on = [c for c, given in zip(cols, p, strict=True) if given]
        cells = reduce(lambda d, x: d.filter(F.col(x[0]).isNotNull() if x[1] else F.col(x[0]).isNull()), zip(cols, p, strict=True), t)
        cells = F.broadcast(cells.select("plan_id", "cell_id", *on))  # MAX_CELLS rows at most
        parts.append(rows.join(cells, on) if on else rows.crossJoin(cells))
    if not parts:
        return rows.crossJoin(t.select("plan_id", "cell_id").limit(0))
    return reduce(lambda a, b: a.unionByName(b.select(a.columns)), parts)


def allocate(size: int, cells: list[dict]) -> list[int]:
    """Whole quotas of one plan. ``cells``: share, floor, available.

    Largest remainder on ``share * size``; then every cell gets at least min(floor, available) and at most
    what is available; rows that capped cells leave over go to the others in proportion to their shares, by
    largest remainder again, and floors are paid for by the cells furthest above their share. Ties go to
    the cell listed first.
    """
    low = [min(c["floor"], c["available"]) for c in cells]
    quota, open_ = [0] * len(cells), set(range(len(cells)))
    while open_:
        left = size - sum(quota[i] for i in range(len(cells)) if i not in open_)
        mass = sum(cells[i]["share"] for i in open_)
        want = {i: max(0, left) * cells[i]["share"] / mass if mass > 0 else 0.0 for i in open_}
        bound = {i: cells[i]["available"] for i in open_ if want[i] > cells[i]["available"]}
        if not bound:
            bound = {i: low[i] for i in open_ if want[i] < low[i]}
        if bound:
            for i, q in bound.items():
                quota[i] = q
            open_ -= set(bound)
            continue
        base = {i: math.floor(want[i] + 1e-9) for i in open_}
        more = (max(0, left) if mass > 0 else 0) - sum(base.values())
        for i in sorted(open_, key=lambda i: (-(want[i] - base[i]), i)):
            if more > 0 and base[i] < cells[i]["available"]:
                base[i], more = base[i] + 1, more - 1
        for i in open_:
            quota[i] = base[i]
        break
    return quota


def plan_report(df: DataFrame, targets: DataFrame, one_in: int = 10) -> DataFrame:
    """One row per cell: available rows, demand, quota, shortfall.

    The sample of a plan has floor(rows / one_in) rows. ``demand`` is max(min_rows, ceil(share * size)); a
    cell falls short if fewer rows than that are available. NULL shares and floors count as 0.
    """
    size = df.count() // one_in
    have = cell_counts(df, targets)
    t = targets.select("plan_id", "cell_id", F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("min_rows", F.lit(0)).alias("floor"))
    rows = t.join(have, ["plan_id", "cell_id"], "left").select("*").limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    out = []
    for plan in sorted({r["plan_id"] for r in rows}):
        own = sorted((r for r in rows if r["plan_id"] == plan), key=lambda r: r["cell_id"])
        cells = [{"share": r["share"], "floor": r["floor"], "available": r["available"] or 0} for r in own]
        for r, c, q in zip(own, cells, allocate(size, cells), strict=True):
            demand = max(c["floor"], math.ceil(c["share"] * size))
            out.append((plan, r["cell_id"], c["share"], int(c["floor"]), int(c["available"]), demand, q, max(0, demand - c["available"]), size))
    schema = "plan_id int, cell_id int, target_share double, min_rows bigint, available bigint, demand bigint, quota bigint, shortfall bigint, sample_size bigint"
    return df.sparkSession.createDataFrame(out, schema)


def found(df: DataFrame, targets: DataFrame) -> DataFrame:
    return plan_report(df, targets).filter("shortfall > 0").select("plan_id", "cell_id")


def draw(df: DataFrame, targets: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """``plan_id, cell_id, id``: in each cell the rows with the smallest random keys, as many as its quota.

    The cutoff key of each cell is found by radix selection, so no cell is sorted or collected. Rows repeated under one id
    have equal keys; at the cutoff as many of them are taken as the quota still lacks, so every quota is met to the row.
    """
    rep = plan_report(df, targets)
    rows = df.select(F.col(id_col).alias("rid"), *[name_key(c).alias(f"k_{c}") for c in DIMENSIONS], F.col("label").alias("k_label"))
    m = _match(rows, targets).select("plan_id", "cell_id", "rid", F.xxhash64("rid", F.lit(seed)).alias("key"))
    quota = F.broadcast(rep.filter("quota > 0").select("plan_id", "cell_id", F.col("quota").alias("rank")))  # MAX_CELLS rows at most
    cut = select_ranks(m, ["plan_id", "cell_id"], "key", lambda sizes: sizes.join(quota, ["plan_id", "cell_id"]).drop("n"), [])
    m = materialize(m.join(F.broadcast(cut.withColumnRenamed("key", "cut")), ["plan_id", "cell_id"]).filter("key <= cut"), "p7-drawn")
    # What the cutoff's id still gives: one row per id and cell, whose repeats are written out again.
    below = m.filter("key < cut").groupBy("plan_id", "cell_id").agg(F.count(F.lit(1)).alias("have"))
    at = m.filter("key = cut").groupBy("plan_id", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rid"))
    at = at.join(quota, ["plan_id", "cell_id"]).join(below, ["plan_id", "cell_id"], "left")
    lack = F.least("n", F.col("rank") - F.coalesce("have", F.lit(0))).cast("int")
    rows = m.filter("key < cut").select("plan_id", "cell_id", "rid").unionAll(at.select("plan_id", "cell_id", F.explode(F.array_repeat("rid", lack)).alias("rid")))
    return rows.withColumnRenamed("rid", id_col)
