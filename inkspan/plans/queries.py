"""Named queries over the test tables; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions import features as X
from inkspan.functions import normalize as N
from inkspan.functions.text import name_key
from inkspan.operators import corpus as C
from inkspan.operators import evaluate as V
from inkspan.operators import evidence as E
from inkspan.operators import model as M
from inkspan.operators import ngram as G
from inkspan.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]
ESSAYS = "train_v2_drcat_02"


def essays(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, ESSAYS).drop("essay_id").withColumnRenamed("row_id", "essay_id")


def sents(s: SparkSession, d: str) -> DataFrame:
    return N.sentences(essays(s, d).filter(F.col("text").isNotNull()))


def scores(s: SparkSession, d: str) -> DataFrame:
    """``essay_id, label, generator, prompt_name, ell_status, p``: the logistic of the summed evidence of each essay."""
    e = table(s, d, "signal_evidence").groupBy("row_id").agg(F.sum("contribution").alias("z"))
    j = essays(s, d).select("essay_id", "label", "generator", "prompt_name", "ell_status", "split").join(e.withColumnRenamed("row_id", "essay_id"), "essay_id")
    return j.filter("label is not null").withColumn("p", F.round(M.probability(F.col("z")), 4))


def finite(v: Column) -> Column:
    """NaN and the infinities are no measurements; every finite value is one, however extreme."""
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def sentence_scores(s: SparkSession, d: str) -> DataFrame:
    """A stand-in score per scorable sentence: its type-token ratio, as recorded."""
    f = table(s, d, "sentence_features")
    return f.select("row_id", "sentence_index", "label", "prompt_name", "is_scorable", F.when(F.col("is_scorable"), finite(F.col("feature_values")["lex_ttr"])).alias("score"))


def wide_features(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "sentence_features")
    names = ("lex_ttr", "lex_mtld", "punct_comma_density", "pred_cross_entropy", "form_hedge_density", "rep_repeated_word_ratio")
    cols = [finite(F.col("feature_values")[n]).alias(n) for n in names]
    return f.select("row_id", "sentence_index", "label", "is_scorable", *cols)


def _canonical(s: SparkSession, d: str) -> DataFrame:
    t = essays(s, d).filter(F.col("text").isNotNull())
    return t.select("essay_id", N.content_id("text").alias("content_id"), N.word_count("text").alias("n_words"), F.length("text").alias("n_chars"),
                    F.nullif(F.trim("ell_status"), F.lit("")).alias("ell_status"), N.word_count("text").between(50, 1000).alias("in_band"),
                    (F.length("text").between(1, 100_000) & (N.canonical("text") != "")).alias("accepted"))


def _normalized(s: SparkSession, d: str) -> DataFrame:
    t = essays(s, d).filter(F.col("text").isNotNull()).select("essay_id", "text", N.normalize("text").alias("n"))
    return t.select("essay_id", F.sha2("n", 256).alias("digest"), (F.length("n") == F.length("text")).alias("same_length"))


def _retokenize(s: SparkSession, d: str) -> DataFrame:
    """Words again from the stored offsets, without segmenting."""
    t = essays(s, d).filter(F.col("text").isNotNull()).select("essay_id", N.normalize("text").alias("n"))
    j = sents(s, d).select("essay_id", "sent_idx", "start_char", "end_char").join(t, "essay_id")
    cut = F.substring("n", F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))
    return j.select("essay_id", "sent_idx", F.size(N.words(cut)).alias("n_words"), F.md5(cut).alias("digest"))


def _features(*families: str) -> Query:
    return lambda s, d: X.rounded(X.sentence_features(sents(s, d), *families))


def _lm(s: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    tokens = materialize(G.raw_tokens(sents(s, d)), "lm-tokens")
    human = essays(s, d).filter("label = 0 and split = 'train'").select("essay_id")
    return tokens, G.fit_tokens(tokens.join(human, "essay_id", "left_semi"))


def _lm_scores(s: SparkSession, d: str) -> DataFrame:
    tokens, m = _lm(s, d)
    return X.rounded(G.score_tokens(tokens, m), 4)


def _lm_counts(s: SparkSession, d: str) -> DataFrame:
    _, m = _lm(s, d)
    return m["trigram"].select("w2", "w1", "w", "n")


def _held_out(s: SparkSession, d: str) -> DataFrame:
    """Essays of the prompts that the latest manifest gives to validation or test, whatever split a row records."""
    m = table(s, d, "split_manifest").orderBy(F.desc("created_at"), F.desc("manifest_id")).limit(1)
    held = m.select(F.explode("group_assignment").alias("name", "should")).filter("should in ('validation', 'test')")
    return essays(s, d).withColumn("_k", name_key("prompt_name")).join(held.select(name_key("name").alias("_k")).filter("_k <> ''"), "_k", "left_semi").drop("_k")


def _folds(s: SparkSession, d: str) -> DataFrame:
    return C.group_fold_frame(essays(s, d).filter("split = 'train'"), "prompt_name")


def _separation(s: SparkSession, d: str) -> DataFrame:
    w = wide_features(s, d)
    names = [c for c in w.columns if c not in ("row_id", "sentence_index", "label", "is_scorable")]
    long = w.unpivot(["label"], names, "feature", "value")
    j = V.roc_auc(long, "label", "value", ["feature"]).join(V.cohens_d(long, "label", "value", ["feature"]), "feature").filter("defined_fraction >= 0.5")
    return j.withColumn("separation", F.round(F.abs(F.col("auc") - 0.5), 6)).orderBy(F.desc("separation"), "feature")


# Fixed coefficients of the scoring query.
COEFS = {"form_hedge_density": 0.4, "lex_mtld": -0.3, "lex_mtld__missing": 0.2, "lex_ttr": 0.8, "pred_cross_entropy": -0.6, "punct_comma_density": 0.5}


def _matrix(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    w = wide_features(s, d)
    stats = M.fit_statistics(w.filter("is_scorable and label is not null"), [c for c in w.columns if c in COEFS])
    return w, stats


def _linear(s: SparkSession, d: str) -> DataFrame:
    w, stats = _matrix(s, d)
    m = M.transform(w, stats, ["row_id", "sentence_index"])
    have = {k: b for k, b in COEFS.items() if k in m.columns}
    return m.select("row_id", "sentence_index", F.round(M.probability(M.log_odds(have, -0.1)), 6).alias("p"))


def _contributions(s: SparkSession, d: str) -> DataFrame:
    w, stats = _matrix(s, d)
    m = M.transform(w, stats, ["row_id", "sentence_index"])
    c = M.contributions(m, {k: b for k, b in COEFS.items() if k in m.columns}, ["row_id"])
    return c.groupBy("row_id", "feature").agg(F.round(F.sum("contribution"), 5).alias("contribution"))


def _trained(s: SparkSession, d: str) -> DataFrame:
    w, stats = _matrix(s, d)
    m = M.transform(w.filter("is_scorable and label is not null"), stats, ["label"])
    coefs, b = M.fit_logistic(m, [c for c in m.columns if c != "label"])
    return s.createDataFrame([*coefs.items(), ("intercept", b)], "feature string, coefficient double")


def _failures(s: SparkSession, d: str) -> DataFrame:
    x = scores(s, d).filter((F.col("p") >= 0.5) != (F.col("label") == 1))
    return x.select("essay_id", "label", "p", F.round(F.abs(F.col("p") - F.col("label")), 4).alias("distance")).orderBy(F.desc("distance"), "essay_id").limit(3)


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "sentence_features").groupBy(F.col("row_id").alias("essay_id")).agg(F.count_if("is_scorable").alias("n"))
    j = scores(s, d).join(n, "essay_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("risk", E.risk_score(F.col("p")))
    return j.select("essay_id", "risk", E.risk_band(F.col("risk")).alias("band"), E.assessment(F.col("n"), F.col("risk")).alias("assessment"))


def _described(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "signal_evidence").withColumn("v", finite(F.col("measured_value")))
    ref = e.filter("direction = 'human'").groupBy("measured_feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("sd"))
    j = e.join(ref, "measured_feature", "left")
    z = F.try_divide(F.col("v") - F.col("m"), F.nullif("sd", F.lit(0.0)))
    return j.select("evidence_id", E.family(F.col("measured_feature")).alias("family"), F.round(z, 3).alias("z"), E.descriptor(F.round(z, 3), F.col("contribution")).alias("descriptor"))


def _explanations(s: SparkSession, d: str) -> DataFrame:
    sig = E.signals(table(s, d, "signal_evidence").withColumnRenamed("row_id", "essay_id"), "essay_id")
    return E.explanation(sig, scores(s, d).select("essay_id", "p"), "essay_id")


def _response(s: SparkSession, d: str) -> DataFrame:
    from inkspan.plans.analyze import analyze
    from inkspan.plans.detector import prepare, train

    docs = essays(s, d).select("essay_id", "text")
    parts = prepare(docs)
    return analyze(docs, train(essays(s, d).filter("split = 'train'"), parts=parts), parts=parts)


def _passages(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    x = sentence_scores(s, d).groupBy("row_id", "sentence_index").agg(F.max("score").alias("score"))
    w = W.partitionBy("row_id").orderBy("sentence_index").rowsBetween(0, 3)
    p = x.select("row_id", F.col("sentence_index").alias("start_idx"), F.last("sentence_index").over(w).alias("end_idx"), F.count(F.lit(1)).over(w).alias("k"), F.round(F.avg("score").over(w), 6).alias("score"))
    return p.filter("k = 4 and score is not null").drop("k")


def _overlap(s: SparkSession, d: str) -> DataFrame:
    u = table(s, d, "sentence")
    spans = u.filter("is_scorable").select(F.col("row_id").alias("essay_id"), F.col("start_char").alias("s"), F.col("end_char").alias("e")).distinct()
    ours = sents(s, d).join(u.select(F.col("row_id").alias("essay_id")).distinct(), "essay_id", "left_semi")
    return V.overlap_labels(ours.select("essay_id", "sent_idx", "start_char", "end_char"), spans, "essay_id")


def _hybrids(s: SparkSession, d: str) -> DataFrame:
    from inkspan.operators.hybrid import choose, rebuild

    sent = sents(s, d)
    human = essays(s, d).filter("label = 0 and split in ('validation', 'test')").select("essay_id")
    return rebuild(choose(sent.join(human, "essay_id", "left_semi")), lambda c: F.concat(F.lit("In other words: "), c))


def _unique_scores(s: SparkSession, d: str) -> DataFrame:
    """One stand-in score per sentence, the largest of those recorded for it."""
    return sentence_scores(s, d).groupBy(F.col("row_id").alias("essay_id"), F.col("sentence_index").alias("sent_idx")).agg(F.max("score").alias("score"))


def _metadata(s: SparkSession, d: str) -> DataFrame:
    t = C.attach_metadata(table(s, d, "documents").select("doc_id", "text"), essays(s, d), ["ell_status", "grade_level"])
    return t.select("doc_id", F.nullif(F.trim("ell_status"), F.lit("")).alias("ell_status"), "grade_level")


def _prompt_split(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "split_manifest").orderBy(F.desc("created_at"), F.desc("manifest_id")).limit(1)
    to = m.select(F.explode("group_assignment").alias("prompt_name", "assigned"))
    return essays(s, d).select("essay_id", "prompt_name").join(to, "prompt_name", "left").select("essay_id", "assigned")


def _scored_documents(s: SparkSession, d: str) -> DataFrame:
    e = essays(s, d).select("essay_id", "label", "split")
    return e.join(V.document_scores(sentence_scores(s, d).withColumnRenamed("row_id", "essay_id"), "essay_id", "score"), "essay_id")


def _predicted(s: SparkSession, d: str) -> DataFrame:
    tokens, m = _lm(s, d)
    h = G.score_tokens(tokens, m).groupBy("essay_id").agg(F.avg("pred_cross_entropy").alias("m"), F.when(F.count(F.lit(1)) > 1, F.stddev_pop("pred_cross_entropy")).alias("sd"))
    return essays(s, d).select("essay_id", "label", "split").join(h, "essay_id", "left").select(
        "essay_id", "label", "split", F.round("m", 4).alias("docmean_pred_cross_entropy"), F.round("sd", 4).alias("docstd_pred_cross_entropy"))


def _lm_oof(s: SparkSession, d: str) -> DataFrame:
    folds = _folds(s, d)
    e = essays(s, d).filter("split = 'train' and text is not null").join(folds.select("prompt_name", "fold"), "prompt_name").select("essay_id", "fold", "label")
    tokens = materialize(G.raw_tokens(sents(s, d)).join(e, "essay_id"), "oof-tokens")
    return X.rounded(C.out_of_fold(tokens, folds, F.col("label") == 0, G.fit_tokens, G.score_tokens), 4)


def _rest(s: SparkSession, d: str) -> DataFrame:
    taken = C.sample_per_cell(essays(s, d), ["prompt_name", "label"], 5).select("essay_id")
    return essays(s, d).select("essay_id").join(taken, "essay_id", "left_anti")


def _cross_validation(s: SparkSession, d: str) -> DataFrame:
    x = scores(s, d)
    x = materialize(x.join(C.group_fold_frame(x, "prompt_name").select("prompt_name", "fold"), "prompt_name"), "cv")
    j = V.classification(x, "label", "p", ["fold"]).join(V.roc_auc(x, "label", "p", ["fold"]), "fold")
    return j.agg(*[F.round(f(c), 5).alias(f"{k}_{c}") for c in ("accuracy", "auc") for k, f in (("mean", F.avg), ("std", F.stddev_pop))])


def _reference_train(s: SparkSession, d: str) -> DataFrame:
    train = essays(s, d).filter("split = 'train' and label = 0").select(F.col("essay_id").alias("row_id"))
    names = ["lex_ttr", "lex_mtld", "punct_comma_density", "pred_cross_entropy", "form_hedge_density", "rep_repeated_word_ratio"]
    w = wide_features(s, d).filter("is_scorable").join(train, "row_id", "left_semi")
    return w.unpivot(["row_id"], names, "feature", "value").groupBy("feature").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("sd")).filter("mean is not null")


def _top_contributions(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("row_id").orderBy(F.abs("contribution").desc(), "feature")
    return _contributions(s, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 3")


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "proj_canonical": _canonical,
        "n_normalized": _normalized,
        "n_paragraphs": lambda s, d: N.paragraphs(essays(s, d).filter("text is not null")),
        "n_sentences": sents,
        "n_first_sentences": lambda s, d: N.first_sentences(sents(s, d), 3),
        "n_retokenized": _retokenize,
        "f_structure": _features("structure"),
        "f_lexical": _features("lexical"),
        "f_punctuation": _features("punctuation"),
        "f_repetition": _features("repetition"),
        "f_formulaic": _features("formulaic"),
        "f_syntax": _features("syntax"),
        "f_mtld": lambda s, d: X.rounded(X.with_words(sents(s, d)).select("essay_id", "sent_idx", X.mtld("w").alias("lex_mtld"))),
        "c_context": lambda s, d: X.rounded(X.contextual_features(sents(s, d))),
        "w_rhythm": lambda s, d: X.rounded(X.rhythm(sents(s, d))),
        "w_windows": lambda s, d: X.rounded(X.sliding_windows(sents(s, d))),
        "w_passages": _passages,
        "g_document_features": lambda s, d: X.rounded(X.document_features(sents(s, d))),
        "g_document_mtld": lambda s, d: X.rounded(X.document_mtld(sents(s, d))),
        "lm_trigrams": _lm_counts,
        "lm_scores": _lm_scores,
        "d_exact": lambda s, d: C.exact_duplicates(essays(s, d)),
        "d_near": lambda s, d: C.near_duplicates(essays(s, d).filter("text is not null")),
        "s_cells": lambda s, d: C.sample_per_cell(essays(s, d), ["prompt_name", "label"], 5).select("essay_id", "prompt_name", "label"),
        "s_matched": lambda s, d: C.matched_sample(_held_out(s, d).filter("label = 0"), "prompt_name", "ell_status"),
        "s_groups": lambda s, d: C.group_splits(essays(s, d), "prompt_name"),
        "s_hash": lambda s, d: C.split_hash_frame(essays(s, d).filter("split is not null and prompt_name is not null").groupBy("prompt_name").agg(F.min("split").alias("split")), "prompt_name"),
        "s_validation": lambda s, d: C.validate_splits(essays(s, d)),
        "s_folds": _folds,
        "s_counts": lambda s, d: essays(s, d).groupBy("split", "generator").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prompt_name").alias("n_prompts")),
        "m_statistics": lambda s, d: X.rounded(_matrix(s, d)[1], 5),
        "m_linear": _linear,
        "m_contributions": _contributions,
        "m_trained": _trained,
        "a_score_summary": lambda s, d: V.score_summary(sentence_scores(s, d), "row_id", "score"),
        "a_confidence": lambda s, d: V.confidence(sentence_scores(s, d), "row_id", "score"),
        "a_metrics": lambda s, d: V.classification(scores(s, d), "label", "p"),
        "a_auc": lambda s, d: V.roc_auc(scores(s, d), "label", "p"),
        "a_separation": _separation,
        "a_reliability": lambda s, d: X.rounded(V.reliability(scores(s, d), "label", "p")),
        "a_ece": lambda s, d: V.expected_calibration_error(scores(s, d), "label", "p"),
        "a_generator_rates": lambda s, d: V.rates(scores(s, d), "label", "p", "generator"),
        "a_fairness": lambda s, d: V.rates(scores(s, d).filter("label = 0 and ell_status is not null"), "label", "p", "ell_status"),
        "a_pivot": lambda s, d: scores(s, d).groupBy("split").pivot("label", [0, 1]).agg(F.round(F.avg("p"), 6)).withColumnsRenamed({"0": "human", "1": "machine"}),
        "a_buckets": lambda s, d: scores(s, d).groupBy(F.when(F.col("p") <= 0.35, "a").when(F.col("p") <= 0.45, "b").when(F.col("p") <= 0.55, "c").otherwise("d").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") >= 0.5).alias("detected"), F.round(F.avg("p"), 6).alias("mean_p")),
        "a_reference": lambda s, d: wide_features(s, d).filter("label = 0 and is_scorable").unpivot(["label"], ["lex_ttr", "lex_mtld", "pred_cross_entropy", "punct_comma_density"], "feature", "value").groupBy("feature").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("sd")),
        "a_reference_train": _reference_train,
        "a_document_summary": lambda s, d: V.band_summary(sentence_scores(s, d), "row_id", "score", E.risk_band(E.risk_score(F.col("score")))),
        "a_fairness_gap": lambda s, d: V.rate_gap(V.rates(scores(s, d).filter("label = 0"), "label", "p", "ell_status"), "ell_status", "Yes", "No"),
        "a_pivot_entropy": lambda s, d: _predicted(s, d).groupBy("split").pivot("label", [0, 1]).agg(F.round(F.avg("docmean_pred_cross_entropy"), 3)).withColumnsRenamed({"0": "human", "1": "machine"}),
        "a_folds": _cross_validation,
        "a_length": lambda s, d: V.length_grid(_unique_scores(s, d), essays(s, d).select("essay_id", "label"), "essay_id", "score"),
        "lm_out_of_fold": _lm_oof,
        "j_metadata": _metadata,
        "j_prompt_split": _prompt_split,
        "j_scored_documents": _scored_documents,
        "j_predicted": _predicted,
        "j_rest": _rest,
        "j_held_out": lambda s, d: _held_out(s, d).select("essay_id"),
        "m_top_contributions": _top_contributions,
        "a_bands": lambda s, d: sentence_scores(s, d).groupBy(E.risk_band(E.risk_score(F.col("score"))).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")),
        "a_failures": _failures,
        "e_signals": lambda s, d: E.signals(table(s, d, "signal_evidence"), "row_id"),
        "e_described": _described,
        "e_verdicts": _verdicts,
        "e_explanations": _explanations,
        "e_response": _response,
        "j_overlap": _overlap,
        "h_rebuilt": _hybrids,
    }
    return q
