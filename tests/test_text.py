import math

import pytest
from pyspark.sql import functions as F

from inkspan.functions import features as X
from inkspan.functions import normalize as N

EDGE = ["", "   ", "a—b–c−d", "First line.\r\nSecond line.", "lone\rCR", "nb sp", "z​w﻿", "“q” ‘x’", "c\x07t", None]


def sents(spark, *texts):
    return N.sentences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "essay_id bigint, text string").filter("text is not null"))


def test_normalize_keeps_length(spark):
    rows = spark.createDataFrame([(t,) for t in EDGE], "t string").select("t", N.normalize("t").alias("n")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["n"] is None
        else:
            assert len(r["n"]) == len(r["t"])
    got = {r["t"]: r["n"] for r in rows}
    assert got["a—b–c−d"] == "a-b-c-d"
    assert got["First line.\r\nSecond line."] == "First line. \nSecond line."


@pytest.mark.parametrize("text,n", [("I met Dr. Chen in St. Louis. He changed my mind.", 2), ("It cost 3.14 euros. Really?", 2), ("", 0), ("One\n\nTwo\n \nThree", 3), ("Wait... what?!", 2)])
def test_sentences(spark, text, n):
    rows = sents(spark, text).orderBy("sent_idx").collect()
    assert len(rows) == n
    for i, r in enumerate(rows):
        assert r["sent_idx"] == i
        assert text[r["start_char"] : r["end_char"]] == r["text"]


def test_scorable(spark):
    rows = sents(spark, "Yes. I had never seen anything quite like it before.").orderBy("sent_idx").collect()
    assert [r["is_scorable"] for r in rows] == [False, True]


def feats(spark, text, *fam):
    return X.rounded(X.sentence_features(sents(spark, text), *fam)).first().asDict()


def test_lexical(spark):
    f = feats(spark, "the cat sat on the mat", "lexical")
    assert (f["lex_token_count"], f["lex_unique_count"]) == (6, 5)
    assert f["lex_ttr"] == pytest.approx(5 / 6, abs=1e-6) and f["lex_repeated_word_ratio"] == pytest.approx(1 / 6, abs=1e-6)
    assert f["lex_hapax_ratio"] == pytest.approx(4 / 6, abs=1e-6)
    assert feats(spark, "...", "lexical")["lex_ttr"] is None


def test_punctuation_zero_is_not_null(spark):
    f = feats(spark, "no punctuation here", "punctuation")
    assert f["punct_semicolon_density"] == 0.0 and f["punct_comma_density"] == 0.0
    assert X.sentence_features(sents(spark, "I waited... then left."), "punctuation").agg(F.sum("punct_ellipsis_count")).first()[0] == 1.0


def test_repetition_and_formulaic(spark):
    assert feats(spark, "we must act now we must act now", "repetition")["rep_repeated_bigram_ratio"] == pytest.approx(6 / 7, abs=1e-6)
    assert feats(spark, "Moreover, the results were encouraging.", "formulaic")["form_opens_with_connective"] == 1.0
    assert feats(spark, "I dropped the pan on the floor.", "formulaic")["form_opens_with_connective"] == 0.0
    assert feats(spark, "Across my many varied pursuits, I have grown considerably.", "formulaic")["form_has_fronted_adverbial"] == 1.0


def test_mtld():
    assert X.mtld_of(["a"] * 3) is None
    assert X.mtld_of([f"w{i}" for i in range(25)]) == 25.0
    assert X.mtld_of(["a", "b"] * 20) < 10


@pytest.mark.parametrize("lens,cv,burst", [([20] * 5, 0.0, -1.0), ([12, 14], None, None)])
def test_rhythm(spark, lens, cv, burst):
    s = spark.createDataFrame([(1, i, n) for i, n in enumerate(lens)], "essay_id bigint, sent_idx int, token_count int")
    r = X.rhythm(s).first()
    assert r["rhythm_coefficient_of_variation"] == cv and r["rhythm_burstiness"] == burst
    s = spark.createDataFrame([(1, i, n) for i, n in enumerate([10, 20, 30, 20])], "essay_id bigint, sent_idx int, token_count int")
    assert X.rhythm(s).first()["rhythm_length_std"] == pytest.approx(math.sqrt(50))


def test_windows_need_a_full_frame(spark):
    s = spark.createDataFrame([(1, i, 5) for i in range(5)] + [(2, 0, 5)], "essay_id bigint, sent_idx int, token_count int")
    assert sorted((r["start_idx"], r["end_idx"]) for r in X.sliding_windows(s).collect()) == [(0, 3), (1, 4)]


def test_dependency_depth(spark):
    t = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 3, 2)], "sent_idx int, tok_idx int, head_idx int")
    assert {r["tok_idx"]: r["depth"] for r in X.dependency_depths(t, ["sent_idx"]).collect()} == {0: 1, 1: 0, 2: 1, 3: 2}


def test_token_features(spark):
    from inkspan.functions import annotated as A

    cols = "essay_id bigint, sent_idx int, tok_idx int, word string, pos string, tag string, dep string, head_idx int, is_punct boolean, is_space boolean"
    # "In May, I may measure the situation that Ann knows." with its heads
    words = [("In", "ADP", "IN", "prep", 5), ("May", "PROPN", "NNP", "pobj", 0), (",", "PUNCT", ",", "punct", 5), ("I", "PRON", "PRP", "nsubj", 5), ("may", "AUX", "MD", "aux", 5), ("measure", "VERB", "VB", "ROOT", 5),
             ("the", "DET", "DT", "det", 7), ("situation", "NOUN", "NN", "dobj", 5), ("that", "PRON", "WDT", "dobj", 10), ("Ann", "PROPN", "NNP", "nsubj", 10), ("knows", "VERB", "VBZ", "relcl", 7), (".", "PUNCT", ".", "punct", 5)]
    rows = [(1, 0, i, w, p, t, d, h, p == "PUNCT", False) for i, (w, p, t, d, h) in enumerate(words)]
    rows += [(1, 1, 0, "...", "PUNCT", ":", "ROOT", 0, True, False), (1, 2, 0, " ", "SPACE", "_SP", "ROOT", 0, False, True)]
    rows += [(1, s, i, w, p, "", "x", 0, False, False) for s, ps in ((3, "ADP PROPN PRON AUX"), (4, "ADP PROPN PRON AUX DET")) for i, (w, p) in enumerate(zip("abcde", ps.split(), strict=False))]
    d = spark.createDataFrame(rows, cols)
    got = {r["sent_idx"]: r.asDict() for r in A.token_features(d, ["essay_id", "sent_idx"]).collect()}
    want = {"syn_noun_ratio": 0.1, "syn_propn_ratio": 0.2, "syn_pron_ratio": 0.2, "syn_first_person_ratio": 0.1, "syn_max_dependency_depth": 3.0, "syn_mean_dependency_depth": 1.5,
            "syn_clause_count": 2.0, "syn_clauses_per_token": 0.2, "syn_mean_branching_factor": 11 / 12, "form_has_fronted_adverbial": 1.0, "form_hedge_density": 0.1, "form_nominalization_density": 0.1, "form_specificity_density": 0.2}
    assert {k: round(got[0][k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}
    assert got[1]["syn_noun_ratio"] is None and got[1]["syn_max_dependency_depth"] == 0.0 and got[2]["syn_max_dependency_depth"] is None
    echo = {r["sent_idx"]: r["repctx_template_echo"] for r in A.template_echo(d).collect()}
    assert echo[1] == 0.0 and echo[3] == echo[4] == echo[0] == 0.5
