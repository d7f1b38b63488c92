"""Problem 4: train, validation and test splits that keep related records together.

Records are linked through their entity values. Value spellings are the nodes of a graph; a spanning forest
built by minimum-edge contraction joins the spellings of one entity; its roots are stratified by size band and
dealt systematically to the splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkspan.functions.text import name_key
from inkspan.llm.forest import spanning_forest
from inkspan.session import materialize

#: Groups of at least this share of all rows are dealt one by one, largest first; there are at most 1/share of them.
LARGE_SHARE = 1 / 2000


def spelling_forest(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``values``: distinct ``raw`` spellings. Returns ``raw, id, root`` and the forest's edges ``u, v, w``, both as written tables.

    Spellings whose reduced forms are equal are linked to the least of them and to the least of their own length, with the
    edit distance as weight, so that contraction keeps the closest of these links; null and blank names are no nodes.
    """
    v = values.select("raw", name_key("raw").alias("key")).filter("key <> ''").distinct()
    v = materialize(v.withColumn("id", F.monotonically_increasing_id()), "p4-nodes")
    v = v.withColumn("size", F.length("raw"))
    edges = []
    for same in (["key"], ["key", "size"]):  # pre-aggregated: a name of many spellings is no hot row
        hub = v.groupBy(*same).agg(F.min(F.struct("raw", "id")).alias("h"))
        edges.append(v.join(hub, same).select(F.col("id").alias("u"), F.col("h.id").alias("v"), F.levenshtein("raw", F.col("h.raw")).alias("w")))
    edges = edges[0].unionAll(edges[1]).filter("u <> v")
    labels, forest = spanning_forest(v.select("id"), edges)
    return materialize(v.join(labels, "id").select("raw", "key", "id", "root"), "p4-forest"), materialize(forest, "p4-edges")


def forest_report(df: DataFrame, entity_col: str) -> DataFrame:
    """``name_key, n_spellings, n_edges``: the size of each tree of the forest over the spellings of an entity."""
    forest, edges = spelling_forest(df.select(F.col(entity_col).alias("raw")).distinct())
    m = edges.join(forest.select(F.col("id").alias("u"), "key"), "u").groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    n = forest.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("root").alias("r")).join(m, "key", "left")
    return n.select(F.col("key").alias("name_key"), F.col("n").alias("n_spellings"), F.coalesce("m", F.lit(0)).alias("n_edges"), F.col("r").alias("n_roots"))


def _unit(c: Column) -> Column:
    """Uniform number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(c, F.lit("deal")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def deal(roots: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """``roots``: ``root, n``. Adds ``split``.

    Roots are stratified by size band (the power of two of their size). The few large ones, at most
    1 / LARGE_SHARE, go largest first to the split that lacks most rows; in the other bands each
    sub-stratum of hashed order is dealt systematically, at equal steps of the cumulative ratios.
    """
    total = roots.agg(F.sum("n")).first()[0] or 0
    names = list(ratios)
    cut = max(1.0, total * LARGE_SHARE)
    large = roots.filter(F.col("n") >= cut).collect()  # at most 1 / LARGE_SHARE rows
    lack = {s: r * total for s, r in ratios.items()}
    got = []
    for r in sorted(large, key=lambda r: (-(r["n"].bit_length()), -r["n"], r["root"])):
        s = max(names, key=lambda x: (lack[x], -names.index(x)))
        lack[s] -= r["n"]
        got.append((r["root"], r["n"], s))
    rest = {s: max(0.0, v) for s, v in lack.items()}
    mass = sum(rest.values()) or 1.0
    spark = roots.sparkSession
    small = roots.filter(F.col("n") < cut).withColumn("band", F.floor(F.log2("n")).cast("int"))
    small = small.withColumn("stratum", F.pmod(F.xxhash64("root"), F.lit(4096)))
    w = Window.partitionBy("band", "stratum").orderBy(F.xxhash64("root", F.lit("order")), "root")
    share = F.pmod((F.row_number().over(w) - 1) * F.lit(0.6180339887498949) + _unit(F.concat_ws("/", "band", "stratum")), F.lit(1.0))
    pick, acc = F.lit(names[-1]), 0.0
    for s in reversed(names[:-1]):
        acc = sum(rest[x] for x in names[: names.index(s) + 1]) / mass
        pick = F.when(share < acc, F.lit(s)).otherwise(pick)
    dealt = small.select("root", "n", pick.alias("split"))
    if got:
        dealt = dealt.unionByName(spark.createDataFrame(got, roots.select("root", "n").schema.add("split", "string")))
    return dealt


def assign_splits(df: DataFrame, id_col: str, entity_col: str, ratios: dict[str, float]) -> DataFrame:
    """``id, split`` for every row: all rows of one entity share a split, the counts come near the ratios.

    Rows with a null or blank entity are entities of their own, dealt by the hash of their id. Repeated
    rows stay together. Ties and orders depend on hashes of the entity only, so the result is stable.
    """
    rows = df.select(F.col(id_col).alias("rid"), F.col(entity_col).alias("raw"))
    counts = materialize(rows.filter(name_key("raw") != "").groupBy("raw").agg(F.count(F.lit(1)).alias("n")), "p4-counts")
    forest, _ = spelling_forest(counts.select("raw"))
    # The node ids depend on partition order; the deal is keyed by the reduced name, which doesn't.
    sized = forest.join(counts, "raw").groupBy("root").agg(F.sum("n").alias("n"), F.min(name_key("raw")).alias("key"))
    dealt = deal(sized.select(F.col("key").alias("root"), "n"), ratios).select(F.col("root").alias("key"), "split")
    to = materialize(forest.join(sized.select("root", "key"), "root").join(dealt, "key").select("raw", "split"), "p4-to")
    acc, pick = 0.0, F.lit(list(ratios)[-1])
    for s in reversed(list(ratios)[:-1]):
        acc = sum(list(ratios.values())[: list(ratios).index(s) + 1])
        pick = F.when(_unit(F.col("rid")) < acc, F.lit(s)).otherwise(pick)
    return rows.join(to, "raw", "left").select(F.col("rid").alias(id_col), F.coalesce("split", pick).alias("split"))


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """The manifest row with the latest ``created_at`` (ISO 8601), ties by the largest manifest_id."""
    ts = F.try_to_timestamp("created_at")
    return manifest.orderBy(ts.desc_nulls_last(), F.col("manifest_id").desc_nulls_last()).limit(1)


def manifest_ratios(manifest: DataFrame) -> dict[str, float]:
    r = latest_manifest(manifest).select("ratios").first()
    return dict(sorted(r[0].items(), key=lambda x: -x[1])) if r and r[0] else {"train": 1.0}


def found(df: DataFrame, id_col: str, entity_col: str, split_col: str, manifest: DataFrame) -> DataFrame:
    """Rows whose recorded split differs from the one the latest manifest gives to their entity.

    The manifest's names are nodes of the same forest as the table's spellings. Rows without a split or an
    entity, and entities the manifest doesn't assign, are no cases.
    """
    given = latest_manifest(manifest).select(F.explode("group_assignment").alias("raw", "should"))
    given = materialize(given, "p4-given")
    rows = df.select(F.col(id_col).alias("rid"), F.col(entity_col).alias("raw"), F.col(split_col).alias("is"))
    forest, _ = spelling_forest(rows.select("raw").unionAll(given.select("raw")).distinct())
    should = given.join(forest, "raw").groupBy("root").agg(F.min("should").alias("should"))
    to = forest.join(should, "root").select("raw", "should")
    return rows.filter(F.col("is").isNotNull()).join(to, "raw").filter("`is` <> should").select(F.col("rid").alias(id_col))


def checks(df: DataFrame, id_col: str, entity_col: str, ratios: dict[str, float]) -> DataFrame:
    """One row: ``n_rows``, ``mixed_entities`` (entities with rows in more than one split) and ``near_ratios``, whether the
    share of each split differs from its ratio by no more than the share of the largest entity.
    """
    a = materialize(assign_splits(df, id_col, entity_col, ratios), "p4-dealt")
    k = a.join(df.select(F.col(id_col).alias("_id"), name_key(entity_col).alias("k")), F.col(id_col) == F.col("_id"))
    per = materialize(k.groupBy("k", "split").agg(F.count(F.lit(1)).alias("n")), "p4-per")
    e = per.filter("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("splits"), F.sum("n").alias("n")).agg(F.count_if(F.col("splits") > 1).alias("mixed"), F.max("n").alias("top"))
    want = F.create_map(*[x for r in ratios.items() for x in map(F.lit, r)])
    n = F.col("n_rows")
    total = a.agg(F.count(F.lit(1)).alias("n_rows"))
    off = per.groupBy("split").agg(F.sum("n").alias("n")).crossJoin(total).agg(F.max(F.abs(F.col("n") / n - want[F.col("split")])).alias("off"))  # one row each
    return total.crossJoin(e).crossJoin(off).select("n_rows", F.col("mixed").alias("mixed_entities"), (F.col("off") <= F.col("top") / n + 0.01).alias("near_ratios"))


def report(df: DataFrame, id_col: str, entity_col: str, ratios: dict[str, float]) -> DataFrame:
    """Rows and share per split."""
    a = assign_splits(df, id_col, entity_col, ratios).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return a.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))
