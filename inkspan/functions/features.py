"""Sentence, contextual and document features as column expressions over a sentence table.

NULL means undefined and differs from 0; no value is ever NaN. ``rounded`` rounds the doubles of a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.functions import lexicon as L
from inkspan.functions.normalize import PUNCTUATION, words
from inkspan.session import materialize

MTLD_THRESHOLD, MTLD_MIN = 0.72, 10
MIN_RHYTHM = 4


def ratio(x: Column, y: Column) -> Column:
    return F.try_divide(x.cast("double"), y.cast("double"))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _mtld_one(w: list) -> float:
    factors, seen, n = 0.0, set(), 0
    for x in w:
        n += 1
        seen.add(x)
        if len(seen) / n <= MTLD_THRESHOLD:
            factors, seen, n = factors + 1, set(), 0
    if n:
        factors += (1 - len(seen) / n) / (1 - MTLD_THRESHOLD)
    return len(w) / max(factors, 1.0)


def mtld_of(w) -> float | None:
    """Mean of the forward and backward measure of textual lexical diversity; None under ten words."""
    if w is None or len(w) < MTLD_MIN:
        return None
    w = list(w)
    return (_mtld_one(w) + _mtld_one(w[::-1])) / 2


@F.pandas_udf(T.DoubleType())
def mtld(w: pd.Series) -> pd.Series:
    return w.map(mtld_of).astype("float64").replace({np.nan: None})


def in_list(w: Column, items: list[str]) -> Column:
    return w.isin(*items)


def with_words(sent: DataFrame) -> DataFrame:
    """Adds the columns the features share: ``w`` words, ``wn`` their number, ``pn`` punctuation tokens, ``tn`` tokens."""
    s = sent.withColumn("w", words(F.col("text"))).withColumn("wn", F.size("w"))
    return s.withColumn("pn", F.regexp_count("text", F.lit(PUNCTUATION))).withColumn("tn", F.col("wn") + F.col("pn"))


def with_runs(s: DataFrame, **items: Column) -> DataFrame:
    """Adds for each array how often each of its distinct items occurs (``array<int>``, in the order of the items).

    The array is sorted once and equal neighbours are counted, so the cost is that of the sort, however long a text
    without sentence marks is. Each step is a column of its own, as the lambdas read it at every position.
    """
    s = s.withColumns({f"_s_{k}": F.sort_array(v) for k, v in items.items()})

    def starts(c: str) -> Column:
        first = F.transform(c, lambda x, i: F.when((i == 0) | (F.get(c, i - 1) != x), i))
        return F.filter(first, lambda i: i.isNotNull())

    def lengths(starts: str, whole: str) -> Column:
        return F.transform(starts, lambda b, i: F.coalesce(F.get(starts, i + 1), F.size(whole)) - b)

    s = s.withColumns({f"_b_{k}": starts(f"_s_{k}") for k in items})
    s = s.withColumns({k: lengths(f"_b_{k}", f"_s_{k}") for k in items})
    return s.drop(*[f"_{x}_{k}" for k in items for x in "sb"])


def count_where(arr: str, test) -> Column:
    return F.size(F.filter(arr, test))


def structure_features() -> dict[str, Column]:
    return {
        "struct_token_count": F.col("wn").cast("double"),
        "struct_character_count": F.length("text").cast("double"),
        "struct_mean_character_per_token": ratio(F.length("text"), F.col("wn")),
    }


def lexical_features() -> dict[str, Column]:
    """Needs ``runs``, the occurrences of each distinct word."""
    u = F.size("runs")
    n = F.col("wn")
    return {
        "lex_token_count": n.cast("double"),
        "lex_unique_count": u.cast("double"),
        "lex_ttr": ratio(u, n),
        "lex_root_ttr": F.try_divide(u.cast("double"), F.sqrt(n.cast("double"))),
        "lex_hapax_ratio": ratio(count_where("runs", lambda k: k == 1), n),
        "lex_repeated_word_ratio": ratio(n - u, n),
        "lex_mean_word_length": ratio(F.length(F.array_join("w", "")), n),
        "lex_stopword_ratio": ratio(count_where("w", lambda x: in_list(x, L.STOPWORDS)), F.col("tn")),
        "lex_content_word_ratio": ratio(count_where("w", lambda x: ~in_list(x, L.STOPWORDS)), F.col("tn")),
        "lex_long_word_ratio": ratio(count_where("w", lambda x: F.length(x) >= 7), n),
    }


# The characters of each density.
PUNCTUATION_CLASSES = {"comma": ",", "semicolon": ";", "colon": ":", "period": ".", "question": "?", "exclamation": "!", "dash": "-", "quote": "\"'", "parenthesis": "()"}


def occurrences(c: str, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def punctuation_features() -> dict[str, Column]:
    out = {f"punct_{k}_density": ratio(occurrences("text", v), F.col("tn")) for k, v in PUNCTUATION_CLASSES.items()}
    out["punct_total_density"] = ratio(F.col("pn"), F.col("tn"))
    three = F.try_divide(F.length("text") - F.length(F.replace(F.col("text"), F.lit("..."), F.lit(""))), F.lit(3))
    out["punct_ellipsis_count"] = (three + occurrences("text", "…")).cast("double")
    return out


def ngrams(n: int) -> Column:
    """N-grams of the words as strings; empty for fewer words."""
    def at(i: Column) -> Column:
        return F.array_join(F.slice("w", i, F.lit(n)), " ")

    return F.when(F.col("wn") >= n, F.transform(F.sequence(F.lit(1), F.col("wn") - (n - 1)), at)).otherwise(F.array().cast("array<string>"))


def repeated_ratio(runs: str, n: Column) -> Column:
    """Share of the n-grams that occur more than once, all their occurrences counted."""
    return ratio(n - count_where(runs, lambda k: k == 1), F.nullif(n, F.lit(0)))


def repetition_features() -> dict[str, Column]:
    """Needs ``runs``, ``runs2`` and ``runs3``, the occurrences of each distinct word, bigram and trigram."""
    nxt = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.col("wn") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.col("wn") - 1, F.lit(0))), lambda a, b: a == b)
    return {
        "rep_repeated_bigram_ratio": F.when(F.col("wn") >= 2, repeated_ratio("runs2", F.col("wn") - 1)),
        "rep_repeated_trigram_ratio": F.when(F.col("wn") >= 2, repeated_ratio("runs3", F.col("wn") - 2)),
        "rep_adjacent_duplicate_ratio": ratio(F.size(F.filter(nxt, lambda x: x)), F.col("wn")),
        "rep_max_word_frequency": ratio(F.array_max("runs"), F.col("wn")),
    }


def formulaic_features() -> dict[str, Column]:
    phrase = F.lower(F.trim(F.regexp_extract("text", r"^([^,]{1,40}),", 1)))
    single = [x for x in L.CONNECTIVES if " " not in x]
    first = F.get("w", F.lit(0))
    n = F.col("wn")
    nominal = r"(" + "|".join(L.NOMINAL_SUFFIXES) + r")$"
    fronted = first.isin(*L.ADPOSITIONS, *L.SUBORDINATORS) | first.rlike("ly$")
    return {
        "form_opens_with_connective": F.when(phrase.isin(*L.CONNECTIVES) | F.coalesce(first.isin(*L.CONNECTIVES), F.lit(False)), 1.0).otherwise(0.0),
        "form_has_fronted_adverbial": F.when(F.coalesce(fronted, F.lit(False)) & F.regexp_like("text", F.lit(r"^[^,]{1,60},")), 1.0).otherwise(0.0),
        "form_connective_density": ratio(count_where("w", lambda x: in_list(x, single)), n),
        "form_hedge_density": ratio(count_where("w", lambda x: in_list(x, L.HEDGES + L.MODALS)), n),
        "form_nominalization_density": ratio(count_where("w", lambda x: (F.length(x) >= 7) & x.rlike(nominal)), n),
        "form_specificity_density": ratio(F.size(F.regexp_extract_all("text", F.lit(r"\s\p{Lu}[\p{L}\p{N}]*|[0-9]+"), F.lit(0))), n),
    }


def syntax_features() -> dict[str, Column]:
    """From the closed-class annotator. Open classes are guessed by suffix; depths need a parser's table and are NULL here."""
    n = F.col("wn")
    closed = L.PRONOUNS + L.ADPOSITIONS + L.CONJUNCTIONS + L.SUBORDINATORS + L.DETERMINERS + L.AUXILIARIES + L.MODALS
    return {
        "syn_pron_ratio": ratio(count_where("w", lambda x: in_list(x, L.PRONOUNS)), n),
        "syn_adp_ratio": ratio(count_where("w", lambda x: in_list(x, L.ADPOSITIONS)), n),
        "syn_cconj_ratio": ratio(count_where("w", lambda x: in_list(x, L.CONJUNCTIONS)), n),
        "syn_adv_ratio": ratio(count_where("w", lambda x: x.rlike("ly$") & (F.length(x) > 3)), n),
        "syn_verb_ratio": ratio(count_where("w", lambda x: in_list(x, L.AUXILIARIES + L.MODALS) | (x.rlike("(ed|ing)$") & (F.length(x) > 4))), n),
        "syn_adj_ratio": ratio(count_where("w", lambda x: x.rlike("(ful|less|ous|ive|able|al|ic)$") & (F.length(x) > 4)), n),
        "syn_noun_ratio": ratio(count_where("w", lambda x: ~in_list(x, closed) & ~x.rlike("(ly|ed|ing|ful|less|ous|ive|able|al|ic)$") & x.rlike(r"^\p{L}")), n),
        "syn_propn_ratio": ratio(F.size(F.regexp_extract_all("text", F.lit(r"\s\p{Lu}[\p{L}]*"), F.lit(0))), n),
        "syn_first_person_ratio": ratio(count_where("w", lambda x: in_list(x, L.FIRST_PERSON)), n),
        "syn_clause_count": (count_where("w", lambda x: in_list(x, L.SUBORDINATORS + L.CONJUNCTIONS)) + 1).cast("double"),
        "syn_clauses_per_token": ratio(count_where("w", lambda x: in_list(x, L.SUBORDINATORS + L.CONJUNCTIONS)) + 1, n),
        "syn_max_dependency_depth": F.lit(None).cast("double"),
        "syn_mean_dependency_depth": F.lit(None).cast("double"),
        "syn_mean_branching_factor": F.lit(None).cast("double"),
    }


FAMILIES = {
    "structure": structure_features, "lexical": lexical_features, "punctuation": punctuation_features,
    "repetition": repetition_features, "formulaic": formulaic_features, "syntax": syntax_features,
}


def sentence_features(sent: DataFrame, *families: str, id_col: str = "essay_id", more: dict[str, Column] | None = None) -> DataFrame:
    """One row per sentence with the features of the given families (all by default) and ``more`` columns of its words ``w``."""
    cols = [c.alias(k) for f in families or FAMILIES for k, c in FAMILIES[f]().items()]
    runs = {}
    if not families or {"lexical", "repetition"} & set(families):
        runs["runs"] = F.col("w")
    if not families or "repetition" in families:
        runs |= {"runs2": ngrams(2), "runs3": ngrams(3)}
    s = with_words(sent)
    return (with_runs(s, **runs) if runs else s).select(id_col, "sent_idx", "is_scorable", *cols, *[c.alias(k) for k, c in (more or {}).items()])


def dependency_depths(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Depth per token of an external annotation (``keys, tok_idx, head_idx``; a root is its own head), by pointer doubling.

    A chain of d links takes log2(d) rounds. A token whose head is missing is a root; a cycle of heads is refused.
    """
    t = tokens.select(*keys, "tok_idx", F.col("head_idx").alias("anc"), (F.col("tok_idx") != F.col("head_idx")).cast("int").alias("depth"))
    for _ in range(40):
        up = t.select(*keys, F.col("tok_idx").alias("anc"), F.col("anc").alias("anc2"), F.col("depth").alias("d2"))
        t2 = materialize(t.join(up, [*keys, "anc"], "left").select(
            *keys, "tok_idx", F.coalesce("anc2", "anc").alias("anc"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), (F.coalesce("d2", F.lit(0)) > 0).alias("moved")), "depths")
        more = not t2.filter("moved").isEmpty()
        t = t2.drop("moved")
        if not more:
            return t.select(*keys, "tok_idx", "depth")
    raise ValueError("heads form a cycle")


def contextual_features(sent: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """Features of a sentence relative to the others of its text: length z-score and ratio, vocabulary, bigram and opening echo."""
    s = with_words(sent)
    doc = W.partitionBy(id_col)
    base = s.select(
        id_col, "sent_idx", "w", "wn", F.count(F.lit(1)).over(doc).alias("ns"),
        F.try_divide(F.col("wn") - F.avg("wn").over(doc), F.nullif(F.stddev_pop("wn").over(doc), F.lit(0.0))).alias("structctx_length_z_score"),
        F.try_divide(F.col("wn").cast("double"), F.avg("wn").over(doc)).alias("structctx_length_ratio"),
    )

    def echo(items: Column, name: str) -> DataFrame:
        x = base.select(id_col, "sent_idx", F.explode(F.array_distinct(items)).alias("x"))
        x = x.withColumn("shared", F.count(F.lit(1)).over(W.partitionBy(id_col, "x")) > 1)
        return x.groupBy(id_col, "sent_idx").agg(F.avg(F.col("shared").cast("double")).alias(name))

    opening = F.array_join(F.slice("w", 1, 4), " ")
    same = F.count(F.lit(1)).over(W.partitionBy(id_col, opening))
    template = F.when(F.col("ns") > 1, F.when(F.col("wn") == 0, 0.0).otherwise((same - 1) / (F.col("ns") - 1)))
    out = base.withColumn("repctx_template_echo", template)
    for items, name in ((F.col("w"), "repctx_vocabulary_echo"), (ngrams(2), "repctx_bigram_echo")):
        out = out.join(echo(items, name), [id_col, "sent_idx"], "left").withColumn(name, F.when(F.col("ns") > 1, F.col(name)))
    return out.drop("w", "wn", "ns")


def rhythm(sent: DataFrame, id_col: str = "essay_id", n_col: str = "token_count") -> DataFrame:
    """Rhythm of sentence lengths per text; all but the mean need four sentences."""
    lag = F.abs(F.col(n_col) - F.lag(n_col).over(W.partitionBy(id_col).orderBy("sent_idx")))
    g = sent.select(id_col, n_col, lag.alias("step")).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"), F.avg(n_col).alias("m"), F.stddev_pop(n_col).alias("sd"), F.avg("step").alias("msd"))
    enough = F.col("n") >= MIN_RHYTHM
    m, sd, msd = F.col("m"), F.col("sd"), F.col("msd")
    return g.select(
        id_col, m.alias("rhythm_mean_length"), F.when(enough, sd).alias("rhythm_length_std"),
        F.when(enough, F.try_divide(sd, m)).alias("rhythm_coefficient_of_variation"),
        F.when(enough, F.try_divide(sd - m, sd + m)).alias("rhythm_burstiness"),
        F.when(enough, msd).alias("rhythm_mean_successive_difference"),
        F.when(enough, F.try_divide(msd, m)).alias("rhythm_normalized_successive_difference"))


def sliding_windows(sent: DataFrame, size: int = 4, id_col: str = "essay_id", n_col: str = "token_count") -> DataFrame:
    """Each window of ``size`` consecutive sentences: first and last index and its mean length and deviation."""
    w = W.partitionBy(id_col).orderBy("sent_idx").rowsBetween(0, size - 1)
    s = sent.select(id_col, F.col("sent_idx").alias("start_idx"), F.last("sent_idx").over(w).alias("end_idx"), F.count(F.lit(1)).over(w).alias("k"), F.avg(n_col).over(w).alias("mean_length"), F.stddev_pop(n_col).over(w).alias("length_std"))
    return s.filter(F.col("k") == size).drop("k")


SUMMARISED = ("lex_ttr", "lex_stopword_ratio", "syn_first_person_ratio", "syn_clauses_per_token", "punct_total_density", "punct_comma_density", "form_hedge_density", "form_nominalization_density", "form_specificity_density")


def document_features(sent: DataFrame, id_col: str = "essay_id") -> DataFrame:
    """One row per text: word totals, rhythm, and mean and deviation of the sentence features. One aggregation by id.

    Texts without sentences have no row.
    """
    f = with_runs(with_words(sent), runs=F.col("w"))
    allf = {k: c for fam in FAMILIES.values() for k, c in fam().items()}
    f = f.select(id_col, "sent_idx", "w", "wn", *[allf[k].alias(k) for k in SUMMARISED])
    aggs = []
    for k in SUMMARISED:
        aggs += [F.avg(k).alias(f"docmean_{k}"), F.when(F.count(k) > 1, F.stddev_pop(k)).alias(f"docstd_{k}")]
    g = f.groupBy(id_col).agg(F.sum("wn").cast("double").alias("doc_token_count"), F.size(F.array_distinct(F.flatten(F.collect_list("w")))).cast("double").alias("doc_unique_count"), F.count(F.lit(1)).cast("double").alias("doc_sentence_count"), *aggs)
    g = g.withColumn("doc_ttr", ratio(F.col("doc_unique_count"), F.col("doc_token_count")))
    return g.join(rhythm(sent, id_col), id_col)


def document_mtld(sent: DataFrame, id_col: str = "essay_id") -> DataFrame:
    g = sent.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("sent_idx", words(F.col("text")).alias("w")))).alias("s"))
    return g.select(id_col, mtld(F.flatten(F.transform("s", lambda x: x["w"]))).alias("doc_mtld"))
