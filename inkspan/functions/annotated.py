"""Features that need a parser, from a token table: one row per token of an external annotation.

Contract: ``<keys>, tok_idx, word, pos, tag, dep, head_idx, is_punct, is_space`` (universal part of speech, fine tag,
dependency label; a root is its own head). Where no annotation exists these features are undefined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkspan.functions import lexicon as L
from inkspan.functions.features import dependency_depths, ratio

# Parts of speech with a ratio, labels of clauses, and parts of speech that open a fronted adverbial.
RATIOS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "PROPN", "ADP", "CCONJ")
CLAUSES = ("advcl", "ccomp", "xcomp", "relcl", "acl", "csubj", "conj")
FRONTING = ("ADP", "ADV", "SCONJ")
FRONT_TOKENS, TEMPLATE_TOKENS, MIN_NOMINAL = 8, 4, 7


def token_features(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence (``keys``) that has tokens: ratios of parts of speech, dependency depth, clauses, branching,
    fronted adverbials, hedges, nominalisations and specificity.

    T counts tokens that are no white space, C those that are no punctuation either; a ratio over none is NULL.
    """
    t = tokens.withColumns({"_t": ~F.col("is_space"), "_c": ~F.col("is_space") & ~F.col("is_punct")})
    depth = dependency_depths(tokens, keys).withColumnRenamed("depth", "_d")
    children = tokens.filter("tok_idx <> head_idx").groupBy(*keys, F.col("head_idx").alias("tok_idx")).agg(F.count(F.lit(1)).alias("_k"))
    t = t.join(depth, [*keys, "tok_idx"]).join(children, [*keys, "tok_idx"], "left")
    order = W.partitionBy(*keys).orderBy("tok_idx")
    t = t.withColumn("_i", F.sum(F.col("_t").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    on, every, word = F.col("_c"), F.col("_t"), F.lower("word")

    def n(c: Column) -> Column:
        return F.count_if(F.coalesce(c, F.lit(False)))

    nominal = (F.length(word) >= MIN_NOMINAL) & word.rlike("(" + "|".join(L.NOMINAL_SUFFIXES) + ")$")
    g = t.groupBy(*keys).agg(
        n(every).alias("tn"), n(on).alias("cn"), *[n(on & (F.col("pos") == p)).alias(p) for p in RATIOS],
        n(on & (F.col("pos") == "PRON") & word.isin(*L.FIRST_PERSON)).alias("first"),
        F.max(F.when(every, F.col("_d"))).alias("deep"), F.sum(F.when(every, F.col("_d"))).alias("depths"),
        n(every & F.col("dep").isin(*CLAUSES)).alias("clauses"), F.sum(F.when(every, F.coalesce("_k", F.lit(0)))).alias("children"),
        n(every & (F.col("_i") == 1) & F.col("pos").isin(*FRONTING)).alias("front"), n(every & (F.col("_i") <= FRONT_TOKENS) & (word == ",")).alias("comma"),
        n(on & ((F.col("tag") == "MD") | word.isin(*L.HEDGES))).alias("hedge"), n(on & (F.col("pos") == "NOUN") & nominal).alias("nominal"),
        n(on & F.col("pos").isin("PROPN", "NUM")).alias("specific"))
    tn, cn = F.col("tn"), F.col("cn")
    return g.select(
        *keys, *[ratio(F.col(p), cn).alias(f"syn_{p.lower()}_ratio") for p in RATIOS], ratio(F.col("first"), cn).alias("syn_first_person_ratio"),
        F.col("deep").cast("double").alias("syn_max_dependency_depth"), ratio(F.col("depths"), tn).alias("syn_mean_dependency_depth"),
        (F.col("clauses") + 1).cast("double").alias("syn_clause_count"), ratio(F.col("clauses") + 1, cn).alias("syn_clauses_per_token"),
        ratio(F.col("children"), tn).alias("syn_mean_branching_factor"),
        F.when((F.col("front") > 0) & (F.col("comma") > 0), 1.0).otherwise(0.0).alias("form_has_fronted_adverbial"), ratio(F.col("hedge"), cn).alias("form_hedge_density"),
        ratio(F.col("nominal"), cn).alias("form_nominalization_density"), ratio(F.col("specific"), cn).alias("form_specificity_density"))


def template_echo(tokens: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """``id, sent_idx, repctx_template_echo``: the share of the text's other sentences that open with the same four parts
    of speech (punctuation aside); 0 for a sentence of punctuation only, NULL for the only sentence of a text.
    """
    word = ~F.col("is_space") & ~F.col("is_punct")
    w = W.partitionBy(id_col, "sent_idx").orderBy("tok_idx").rowsBetween(W.unboundedPreceding, 0)
    t = tokens.withColumn("_r", F.when(word, F.sum(word.cast("int")).over(w)))
    first = F.array_sort(F.collect_list(F.when(F.col("_r") <= TEMPLATE_TOKENS, F.struct("_r", "pos"))))
    s = t.groupBy(id_col, "sent_idx").agg(F.array_join(F.transform(first, lambda x: x["pos"]), " ").alias("_p"))
    same, every = F.count(F.lit(1)).over(W.partitionBy(id_col, "_p")), F.count(F.lit(1)).over(W.partitionBy(id_col))
    return s.select(id_col, "sent_idx", F.when(every > 1, F.when(F.col("_p") == "", 0.0).otherwise((same - 1) / (every - 1))).alias("repctx_template_echo"))
