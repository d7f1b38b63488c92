"""Feature matrix, logistic regression, scores and their exact decomposition."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.operators.radix import from_ordered_bits, ordered_bits, select_ranks

MIN_DEFINED, MIN_VARIANCE = 0.30, 1e-10
# Columns that are never features, and those that only measure length.
NON_FEATURES = frozenset("essay_id label split prompt_name generator ell_status grade_level sentence_index start end is_scorable text".split())
LENGTH_ARTEFACTS = frozenset("doc_token_count doc_unique_count doc_sentence_count sentscore_scorable_count total_sentence_count".split())


def candidate_columns(df: DataFrame, with_length: bool = False) -> list[str]:
    numeric = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return sorted(c for c, t in df.dtypes if t in numeric and c not in NON_FEATURES and (with_length or c not in LENGTH_ARTEFACTS))


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians (the mean of the middle two) by radix selection: no column's values meet in one task."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value").filter("value is not null")
    keys = long.select("feature", ordered_bits("value").alias("_k"))

    def middle(sizes: DataFrame) -> DataFrame:
        n = F.col("n")
        return sizes.select("feature", F.explode(F.array_distinct(F.array(F.floor((n + 1) / 2), F.floor(n / 2) + 1))).alias("rank"))

    got: dict[str, list[float]] = {}
    for r in select_ranks(keys, ["feature"], "_k", middle, [], digit_bits=24).select("feature", from_ordered_bits("_k").alias("v")).collect():
        got.setdefault(r["feature"], []).append(r["v"])
    return {c: v[0] if len(v) == 1 else (v[0] + v[1]) / 2 for c, v in got.items()}


def fit_statistics(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``feature, median, mean, sd, has_indicator`` of the kept columns.

    Kept are columns defined in at least 30 % of the rows whose sample variance reaches 1e-10; mean and
    deviation (of the population, 0 becomes 1) are those after filling gaps with the median.
    """
    cols = cols or candidate_columns(df)
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.count(F.lit(1)).alias("t"), F.var_samp(c).alias("v")).alias(c) for c in cols]).first()
    keep = [(c, one[c]) for c in cols if one[c]["t"] and one[c]["n"] / one[c]["t"] >= MIN_DEFINED and one[c]["v"] is not None and one[c]["v"] >= MIN_VARIANCE]
    if not keep:
        return df.sparkSession.createDataFrame([], "feature string, median double, mean double, sd double, has_indicator boolean")
    med = medians(df, [c for c, _ in keep])
    x = [F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c, _ in keep]
    two = df.agg(*[F.struct(F.avg(v).alias("a"), F.stddev_pop(v).alias("s")).alias(c) for (c, _), v in zip(keep, x, strict=True)]).first()
    rows = [(c, med[c], two[c]["a"], two[c]["s"] if two[c]["s"] > 0 else 1.0, s["n"] < s["t"]) for c, s in keep]
    return df.sparkSession.createDataFrame(rows, "feature string, median double, mean double, sd double, has_indicator boolean")


def matrix_columns(stats: list, available: list[str]) -> dict[str, Column]:
    """Standardised columns, then the indicators of gaps; an absent column counts as all gaps."""
    out: dict[str, Column] = {}
    for r in stats:
        c = F.col(r["feature"]).cast("double") if r["feature"] in available else F.lit(None).cast("double")
        out[r["feature"]] = (F.coalesce(c, F.lit(r["median"])) - F.lit(r["mean"])) / F.lit(r["sd"])
        if r["has_indicator"]:
            out[f"{r['feature']}__missing"] = c.isNull().cast("double")
    return dict([x for x in out.items() if not x[0].endswith("__missing")] + [x for x in out.items() if x[0].endswith("__missing")])


def transform(df: DataFrame, stats: DataFrame, keep: list[str]) -> DataFrame:
    """The matrix in long column form; the statistics have one row per feature."""
    return df.select(*keep, *[c.alias(k) for k, c in matrix_columns(stats.collect(), df.columns).items()])


def fit_logistic(df: DataFrame, cols: list[str], label: str = "label") -> tuple[dict[str, float], float]:
    """Balanced L2 logistic regression at C = 1: coefficients by column, and the intercept."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.lit(0.0)
    for k, v in counts.items():
        weight = F.when(F.col(label) == k, n / (len(counts) * v)).otherwise(weight)
    v = VectorAssembler(inputCols=cols, outputCol="_x").transform(df.withColumn("_w", weight))
    m = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10).fit(v)
    return dict(zip(cols, m.coefficients.toArray().tolist(), strict=True)), float(m.intercept)


def log_odds(coefs: dict[str, float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for k, b in sorted(coefs.items()):
        out = out + F.lit(float(b)) * F.col(k)
    return out


def probability(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def contributions(df: DataFrame, coefs: dict[str, float], keep: list[str]) -> DataFrame:
    """Long form ``keep, feature, contribution``; with the intercept they sum to the log-odds."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), (F.lit(float(b)) * F.col(k)).alias("contribution")) for k, b in sorted(coefs.items())])
    return df.select(*keep, F.explode(pairs).alias("c")).select(*keep, "c.feature", "c.contribution")


def save(path: str, coefs: dict[str, float], intercept: float) -> None:
    with open(path, "w") as f:
        json.dump({"coefficients": coefs, "intercept": intercept}, f, sort_keys=True)


def load(path: str) -> tuple[dict[str, float], float]:
    with open(path) as f:
        d = json.load(f)
    if not all(math.isfinite(x) for x in [*d["coefficients"].values(), d["intercept"]]):
        raise ValueError("coefficients must be finite")
    return d["coefficients"], d["intercept"]
