"""Metrics, calibration, intervals, subgroup rates and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.session import materialize

THRESHOLD, HIGH_RISK, QUANTILES = 0.5, 0.60, (0.10, 0.25, 0.50, 0.75, 0.90)
Z95 = 1.96


def r6(c: Column) -> Column:
    return F.round(c, 6)


def score_summary(df: DataFrame, key: str, score: str) -> DataFrame:
    """Mean, deviation, extremes, quantiles, share of high scores, count, range and mean of the top quarter per key."""
    g = df.filter(F.col(score).isNotNull()).groupBy(key).agg(
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.percentile(F.col(score), F.array(*map(F.lit, QUANTILES))).alias("q"), F.avg((F.col(score) >= HIGH_RISK).cast("double")).alias("hi"), F.count(F.lit(1)).alias("count"))
    top = df.join(g.select(key, F.col("q")[3].alias("q75")), key).filter(F.col(score) >= F.col("q75")).groupBy(key).agg(F.avg(score).alias("top"))
    qs = [r6(F.col("q")[i]).alias(f"sentscore_q{int(q * 100)}") for i, q in enumerate(QUANTILES)]
    return g.join(top, key).select(
        key, r6(F.col("mean")).alias("sentscore_mean"), r6(F.col("std")).alias("sentscore_std"), r6(F.col("min")).alias("sentscore_min"), r6(F.col("max")).alias("sentscore_max"), *qs,
        r6(F.col("hi")).alias("sentscore_high_risk_fraction"), F.col("count").alias("sentscore_scorable_count"), r6(F.col("max") - F.col("min")).alias("sentscore_range"), r6(F.col("top")).alias("sentscore_top_quartile_mean"))


def confidence(df: DataFrame, key: str, score: str) -> DataFrame:
    """min(1, n / 12) * n / total * (1 - min(1, 2 sd)), 0 without scores, and its band."""
    g = df.groupBy(key).agg(F.count(score).alias("n"), F.count(F.lit(1)).alias("t"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("sd"))
    c = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("n") / 12.0) * F.col("n") / F.col("t") * (1 - F.least(F.lit(1.0), 2 * F.col("sd"))))
    band = F.when(c <= 0.34, "low").when(c >= 0.67, "high").otherwise("medium")
    return g.select(key, r6(c).alias("confidence"), band.alias("confidence_band"))


def classification(df: DataFrame, label: str, p: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates at 0.5 (inclusive); FPR and FNR NULL where undefined; Brier NULL with one class."""
    by = by or []
    y, f = F.col(label) == 1, F.col(p) >= THRESHOLD
    g = df.filter(F.col(label).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.count_if(y & f).alias("tp"), F.count_if(~y & f).alias("fp"), F.count_if(~y & ~f).alias("tn"), F.count_if(y & ~f).alias("fn"), F.avg(F.pow(F.col(p) - F.col(label), 2)).alias("b"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    prec, rec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return g.select(*by, "tp", "fp", "tn", "fn", r6(F.try_divide(tp + tn, tp + fp + tn + fn)).alias("accuracy"), r6(prec).alias("precision"), r6(rec).alias("recall"),
                    r6(F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))).alias("f1"), r6(F.try_divide(fp, fp + tn)).alias("fpr"), r6(F.try_divide(fn, fn + tp)).alias("fnr"),
                    r6(F.when((tp + fn > 0) & (fp + tn > 0), F.col("b"))).alias("brier"))


def running_total(df: DataFrame, by: list[str], order: str, col: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``col`` over the earlier rows of the group, by ``order`` (distinct within it).

    Rows are cut into ranges of the order; each range adds up its own, and starts from the total of the ranges before it,
    so that no group is sorted in one task.
    """
    t = materialize(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = t.groupBy(*by, "_part").agg(F.sum(col).alias("_t"))
    before = F.coalesce(F.sum("_t").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    per = per.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_g"), before.alias("_before"))
    on = F.col("_part") == F.col("_g")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    own = F.coalesce(F.sum(col).over(W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_own", own).join(per, on).withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_g", "_own", "_before", *[f"_g_{c}" for c in by])


def roc_auc(df: DataFrame, label: str, value: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve with average ranks, NULL with one class.

    Values are first counted per distinct value, so ranks come from a running sum over distinct values.
    """
    by = by or []
    n = df.filter(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) != 1).alias("_q"))
    n = running_total(n, by, "_v", "_q", "_below")
    u = n.withColumn("u", F.col("_p") * (F.col("_below") + F.col("_q") / 2.0)).groupBy(*by).agg(F.sum("u").alias("u"), F.sum("_p").alias("np"), F.sum("_q").alias("nq"))
    return u.select(*by, r6(F.try_divide(F.col("u"), (F.col("np") * F.col("nq")).cast("double"))).alias("auc"))


def cohens_d(df: DataFrame, label: str, value: str, by: list[str]) -> DataFrame:
    """Standardised difference of the class means (pooled sample variance), class means and the defined share."""
    one, zero = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    g = df.filter(F.col(label).isNotNull()).groupBy(*by).agg(
        F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.var_samp(one).alias("v1"), F.var_samp(zero).alias("v0"), F.count(value).alias("k"), F.count(F.lit(1)).alias("t"))
    pooled = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), (F.col("n1") + F.col("n0") - 2).cast("double"))
    d = F.when((F.col("n1") >= 2) & (F.col("n0") >= 2) & (pooled > 0), (F.col("m1") - F.col("m0")) / F.sqrt(pooled))
    return g.select(*by, r6(d).alias("cohens_d"), r6(F.col("m1")).alias("machine_mean"), r6(F.col("m0")).alias("human_mean"), r6(F.col("k") / F.col("t")).alias("defined_fraction"))


def reliability(df: DataFrame, label: str, p: str, bins: int = 10) -> DataFrame:
    """Equal bins [lo, hi), the last closed; empty bins are dropped. Edges are i / bins as doubles."""
    edges = [i / bins for i in range(1, bins)]
    b = sum(((F.col(p) >= e).cast("int") for e in edges), F.lit(0))
    g = df.filter(F.col(label).isNotNull() & F.col(p).between(0.0, 1.0)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(F.col(label).cast("double")).alias("mo"))
    return g.select("bin", "n", F.col("mp").alias("mean_predicted"), F.col("mo").alias("observed"))


def expected_calibration_error(df: DataFrame, label: str, p: str) -> DataFrame:
    r = reliability(df, label, p)
    return r.agg(r6(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed"))), F.sum("n").cast("double"))).alias("ece"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % interval of a share, clamped to [0, 1]; NULL if n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    z2 = Z95 * Z95
    mid, den = p + F.try_divide(F.lit(z2 / 2), n), 1 + F.try_divide(F.lit(z2), n)
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2 / 4), n * n))
    return F.greatest(F.lit(0.0), (mid - half) / den), F.least(F.lit(1.0), (mid + half) / den)


def rates(df: DataFrame, label: str, p: str, by: str) -> DataFrame:
    """Per group and class: n, how many are flagged, the rate (recall for machine texts, FPR for human ones) and its interval."""
    g = df.filter(F.col(label).isNotNull() & F.col(p).isNotNull()).groupBy(by, label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(p) >= THRESHOLD).alias("flagged"), F.avg(p).alias("mp"))
    lo, hi = wilson(F.col("flagged"), F.col("n"))
    return g.select(by, F.when(F.col(label) == 1, "machine").otherwise("human").alias("kind"), "n", "flagged", r6(F.col("flagged") / F.col("n")).alias("rate"), r6(lo).alias("ci_low"), r6(hi).alias("ci_high"), r6(F.col("mp")).alias("mean_p"))


def overlap_labels(sentences: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Share of each sentence that lies in the spans of its text, and whether it is above one half.

    ``sentences``: key, sent_idx, start_char, end_char; ``spans``: key, s, e. The range condition rides on the equality of the key.
    """
    j = sentences.join(spans, key, "left")
    part = F.greatest(F.lit(0), F.least("end_char", "e") - F.greatest("start_char", "s"))
    g = j.groupBy(key, "sent_idx", "start_char", "end_char").agg(F.coalesce(F.sum(part), F.lit(0)).alias("o"))
    share = F.coalesce(F.try_divide(F.col("o").cast("double"), (F.col("end_char") - F.col("start_char")).cast("double")), F.lit(0.0))
    return g.select(key, "sent_idx", r6(share).alias("overlap"), (share > 0.5).alias("is_rewritten"))


def document_scores(df: DataFrame, key: str, score: str) -> DataFrame:
    """``score_summary`` of every text with sentences, all 0 for those without scores, and ``total_sentence_count``."""
    total = df.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("total_sentence_count"))
    s = score_summary(df, key, score)
    names = [c for c in s.columns if c != key]
    return total.join(s, key, "left").select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names], "total_sentence_count")


def band_summary(df: DataFrame, key: str, score: str, band: Column) -> DataFrame:
    """Per text: sentences, those of each risk band, those without a score, and the mean score."""
    counts = [F.count_if(band == b).alias(f"{b}_risk_sentences") for b in ("high", "medium", "low")]
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("sentence_count"), *counts, F.count_if(F.col(score).isNull()).alias("unscored_sentences"), r6(F.avg(score)).alias("mean_sentence_risk"))


def rate_gap(rates_: DataFrame, by: str, one: str, other: str) -> DataFrame:
    """One row from ``rates`` of two groups: the difference of their rates and whether their intervals overlap."""
    a, b = (rates_.filter(F.col(by) == g).select(*[F.col(c).alias(f"{c}_{k}") for c in ("n", "flagged", "rate", "ci_low", "ci_high")]) for k, g in (("a", one), ("b", other)))
    overlap = (F.col("ci_low_a") <= F.col("ci_high_b")) & (F.col("ci_low_b") <= F.col("ci_high_a"))
    return a.crossJoin(b).select("n_a", "n_b", "rate_a", "rate_b", r6(F.col("rate_a") - F.col("rate_b")).alias("rate_difference"), overlap.alias("intervals_overlap"))  # one row each


#: Numbers of sentences at which the length grid measures.
LENGTHS = (3, 5, 8, 12, 16, 20, 25)


def length_grid(sent: DataFrame, labels: DataFrame, key: str, score: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Accuracy, false-positive rate, recall and mean confidence on the first n sentences, for each n of the grid.

    ``sent``: ``key, sent_idx, score`` with one row per sentence (NULL if unscorable); ``labels``: ``key, label``. A text's
    score is the mean of its sentences'; texts with fewer sentences than n, or without any score among them, don't count.
    A sentence is repeated once per length it belongs to, at most len(lengths) times.
    """
    r = F.row_number().over(W.partitionBy(key).orderBy("sent_idx"))
    x = sent.withColumn("_r", r).filter(F.col("_r") <= max(lengths))
    x = x.select(key, score, F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n >= F.col("_r"))).alias("sentences"))
    t = x.groupBy(key, "sentences").agg(F.count(F.lit(1)).alias("t"), F.count(score).alias("n"), F.avg(score).alias("p"), F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("sd"))
    t = t.filter("t = sentences and n > 0").join(labels.filter("label is not null"), key)
    conf = F.least(F.lit(1.0), F.col("n") / 12.0) * F.col("n") / F.col("t") * (1 - F.least(F.lit(1.0), 2 * F.col("sd")))
    hit = (F.col("p") >= THRESHOLD).cast("double")
    human, machine = F.when(F.col("label") == 0, hit), F.when(F.col("label") == 1, hit)
    return t.groupBy("sentences").agg(
        F.count(F.lit(1)).alias("essays_scored"), r6(F.avg(F.when(F.col("label") == 1, hit).otherwise(1 - hit))).alias("accuracy"), r6(F.avg(human)).alias("false_positive_rate"),
        r6(F.avg(machine)).alias("recall"), r6(F.avg(conf)).alias("mean_confidence"))
