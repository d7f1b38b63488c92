import hashlib
import math
import random
import statistics
import zlib

import pytest
from pyspark.sql import functions as F

from inkspan.operators import corpus as C
from inkspan.operators import evaluate as V
from inkspan.operators import evidence as E
from inkspan.operators import hybrid as H
from inkspan.operators import model as M
from inkspan.operators import ngram as G

BASE = "The quick brown fox jumps over the lazy dog near the river bank while the sun sets slowly behind the distant hills and the birds sing."
NEAR = BASE.replace("lazy", "sleepy")
OTHER = "Nothing in this sentence has anything to do with animals; it speaks of taxes, parliament and the price of paper in autumn markets."


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "essay_id bigint, text string")


def test_exact_duplicates(spark):
    d = docs(spark, BASE, OTHER, BASE, BASE.upper(), None)
    got = {r[0]: r[1] for r in C.exact_duplicates(d).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}
    assert sorted(r[0] for r in C.without_exact_duplicates(d).collect()) == [0, 1]


def test_near_duplicates(spark):
    got = {r["essay_id"]: (r["cluster_id"], r["is_kept"]) for r in C.near_duplicates(docs(spark, BASE, NEAR, OTHER, BASE)).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (2, True), 3: (0, False)}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (4, 1)], "a bigint, b bigint")
    got = {r["id"]: r["root"] for r in C.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7}


def test_bucket_pairs(spark):
    from inkspan.operators.pairs import bucket_pairs

    rng = random.Random(5)
    rows = [(k, i) for k in range(40) for i in rng.sample(range(60), rng.choice((1, 2, 2, 3, 5, 25)))]
    want = sorted((a, b) for k in range(40) for _, a in [r for r in rows if r[0] == k] for _, b in [r for r in rows if r[0] == k] if a < b)
    d = spark.createDataFrame(rows + rows[::3] + [(None, 1), (None, 2), (3, None)], "k bigint, i bigint")
    for block in (1, 4, 2048):
        assert sorted(tuple(r) for r in bucket_pairs(d, "k", "i", block).collect()) == want
    assert bucket_pairs(d.limit(0), "k", "i").count() == 0


def test_running_total_and_medians(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", None, "b"]), v, rng.randint(0, 9)) for v in rng.sample(range(10000), 300)]
    d = spark.createDataFrame(rows, "g string, v int, n int")
    got = {(r["g"], r["v"]): r["t"] for r in V.running_total(d, ["g"], "v", "n", "t").collect()}
    assert got == {(g, v): sum(n for h, u, n in rows if h == g and u < v) for g, v, _ in rows}
    for k in (1, 2, 7, 8):
        m = M.medians(d.filter("g = 'a'").limit(k), ["v", "n"])
        kept = d.filter("g = 'a'").limit(k).collect()
        assert m == {c: float(statistics.median(r[c] for r in kept)) for c in ("v", "n")}


def test_shingle_hashes():
    rng = random.Random(7)
    for n in (0, 1, 4, 5, 6, 80):
        t = "".join(rng.choice("abc d é中🙂") for _ in range(n))
        assert set(C.shingle_hashes(t).tolist()) == {zlib.crc32(s.encode()) % C.MODULUS for s in C.shingle_set(t)}
    h = C.shingle_hashes("x" * 3 + "".join(map(chr, range(300, 9000))))
    want = ((C._A[:, None] * h[None, :] + C._B[:, None]) % C.MODULUS).min(axis=1)
    assert (C.signature("x" * 3 + "".join(map(chr, range(300, 9000)))) == want).all()


def test_groups_and_hash(spark):
    a = C.greedy_groups({"a": 70, "b": 15, "c": 15})
    assert a == {"a": "train", "b": "validation", "c": "test"}
    f = spark.createDataFrame(list(a.items()), "g string, split string")
    assert C.split_hash_frame(f, "g").first()[0] == C.split_hash(a) == hashlib.sha256(b"a\ttrain\nb\tvalidation\nc\ttest").hexdigest()
    with pytest.raises(ValueError):
        C.greedy_groups({"a": 1}, {"train": 0.5})
    assert set(C.group_folds({c: 1 for c in "abcde"}).values()) == set(range(5))


def test_fold_frame(spark):
    d = spark.createDataFrame([(g,) for g in "aaabbcd"] + [(None,)], "g string")
    assert {r["g"]: (r["fold"], r["n"]) for r in C.group_fold_frame(d, "g", 4).collect()} == {"a": (0, 3), "b": (1, 2), "c": (2, 1), "d": (3, 1)}
    with pytest.raises(ValueError):
        C.group_fold_frame(d, "g", 3)


def test_matched_sample(spark):
    rows = [(i, "P one", "Yes") for i in range(5)] + [(10 + i, "p-ONE", "No") for i in range(3)] + [(20, "Q", "Yes")] + [(30 + i, "q!", "No") for i in range(4)] + [(40, None, "No"), (41, "Q", None)]
    d = spark.createDataFrame(rows, "essay_id bigint, prompt_name string, ell_status string")
    got = {r["essay_id"]: r["ell_status"] for r in C.matched_sample(d, "prompt_name", "ell_status").collect()}
    assert {i for i, f in got.items() if f == "Yes"} == {0, 1, 2, 3, 4, 20}
    no = {i for i, f in got.items() if f == "No"}
    assert {10, 11, 12} <= no and len(no) == 4
    assert C.matched_sample(d.filter("ell_status = 'Yes'"), "prompt_name", "ell_status").count() == 0


def test_matched_query(spark):
    from inkspan.plans.queries import queries

    d = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{d}/train_v2_drcat_02.parquet").select("row_id", "label", "prompt_name", "ell_status").collect()
    m = max(spark.read.parquet(f"{d}/split_manifest.parquet").collect(), key=lambda r: (r["created_at"], r["manifest_id"]))["group_assignment"]
    red = lambda x: "".join(c for c in (x or "").lower() if c.isalnum())
    held = {red(k) for k, v in m.items() if v != "train"}
    human = [r for r in e if r["label"] == 0 and red(r["prompt_name"]) in held]
    got = {r["essay_id"]: r["ell_status"] for r in queries()["s_matched"](spark, d).collect()}
    assert {i for i, f in got.items() if f == "Yes"} == {r["row_id"] for r in human if r["ell_status"] == "Yes"}
    per = {}
    for r in human:
        y, n, k = per.get(red(r["prompt_name"]), (0, 0, 0))
        per[red(r["prompt_name"])] = (y + (r["ell_status"] == "Yes"), n + (r["ell_status"] == "No"), k + (got.get(r["row_id"]) == "No"))
    assert per and all(k == min(y, n) for y, n, k in per.values()) and set(got) <= {r["row_id"] for r in human}


def test_language_model(spark):
    s = spark.createDataFrame([(1, 0, "the cat sat"), (2, 0, "the cat ran"), (3, 0, "...")], "essay_id bigint, sent_idx int, text string")
    m = G.fit(s)
    r = {x["essay_id"]: x["pred_cross_entropy"] for x in G.score(s, m).collect()}
    assert set(r) == {1, 2} and r[1] == pytest.approx(r[2])
    uni, v, n = (2 + 0.4) / (6 + 0.4 * 5), 4, 6
    first = -math.log2(0.5 * 1 + 0.3 * 1 + 0.2 * uni)
    last = -math.log2(0.3 * 0.5 + 0.2 * (1 + 0.4) / (n + 0.4 * (v + 1)))
    assert r[1] == pytest.approx((first + first + last) / 3)


def test_matrix_and_model(spark, tmp_path):
    rows = [(i, i % 2, i / 20 if i else None, 1 - i / 20, 1.0) for i in range(20)]
    d = spark.createDataFrame(rows, "essay_id bigint, label int, alpha double, beta double, constant double")
    st = M.fit_statistics(d)
    by = {r["feature"]: r for r in st.collect()}
    assert set(by) == {"alpha", "beta"} and by["alpha"]["has_indicator"] and not by["beta"]["has_indicator"]
    m = M.transform(d, st, ["essay_id", "label"])
    cols = [c for c in m.columns if c not in ("essay_id", "label")]
    coefs, b = M.fit_logistic(m, cols)
    z = m.select("essay_id", M.log_odds(coefs, b).alias("z"))
    c = M.contributions(m, coefs, ["essay_id"]).groupBy("essay_id").agg((F.sum("contribution") + b).alias("s"))
    assert z.join(c, "essay_id").filter("abs(z - s) > 1e-6").isEmpty()
    M.save(str(tmp_path / "m.json"), coefs, b)
    assert M.load(str(tmp_path / "m.json")) == (coefs, b)


def test_metrics(spark):
    d = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.4), (0, 0.6), (None, 0.1)], "label int, p double")
    r = V.classification(d, "label", "p").first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 0)
    assert V.roc_auc(d, "label", "p").first()["auc"] == 0.75
    assert V.roc_auc(d.filter("label = 1"), "label", "p").first()["auc"] is None
    assert V.reliability(spark.createDataFrame([(1, 1.0), (0, 0.3)], "label int, p double"), "label", "p").orderBy("bin").select("bin").collect()[-1][0] == 9
    lo, hi = V.wilson(F.col("k"), F.col("n"))
    x = spark.createDataFrame([(29, 609), (0, 0)], "k int, n int").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (round(x[0]["lo"], 4), round(x[0]["hi"], 4)) == (0.0334, 0.0676) and x[1]["lo"] is None or x[1]["lo"] == 0.0


def test_overlap(spark):
    s = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 11, 20), (2, 0, 0, 0)], "k int, sent_idx int, start_char int, end_char int")
    sp = spark.createDataFrame([(1, 5, 18)], "k int, s int, e int")
    got = {(r["k"], r["sent_idx"]): (r["overlap"], r["is_rewritten"]) for r in V.overlap_labels(s, sp, "k").collect()}
    assert got[(1, 0)] == (0.5, False) and got[(1, 1)][1] and got[(2, 0)] == (0.0, False)


def test_evidence(spark):
    f = spark.createDataFrame([("docmean_punct_comma_density",), ("docstd_lex_mtld__missing",), ("total_sentence_count",), ("doc_ttr",)], "f string")
    assert [r[0] for r in f.select(E.family(F.col("f"))).collect()] == ["Punctuation", "Lexical diversity", "Other", "Lexical diversity"]
    e = spark.createDataFrame([(1, "punct_comma_density", 0.001), (1, "lex_ttr", 1.5), (2, "lex_ttr", None)], "k int, measured_feature string, contribution double")
    s = E.signals(e, "k").collect()
    assert [(r["family"], r["direction"]) for r in s] == [("Lexical diversity", "machine")]
    p = spark.createDataFrame([(1, 0.9), (2, 0.1)], "k int, p double")
    told = {r["k"]: r["explanation"] for r in E.explanation(E.signals(e, "k"), p, "k").collect()}
    assert told[1] == "Scored machine-like, driven mainly by lexical diversity, which is above typical." and told[2] == E.NOTHING
    many = [(1, f, c, z) for f, c, z in (("lex_ttr", 2.0, 2.5), ("pred_x__missing", 1.5, None), ("rep_x", 1.0, -1.2), ("syn_x", 0.9, 0.1), ("punct_x", -0.8, float("nan")))]
    s = E.signals(spark.createDataFrame(many, "k int, measured_feature string, contribution double, z_score double"), "k")
    assert [(r["strongest_feature"], r["z_score"]) for r in s.orderBy("rank").collect()] == [("lex_ttr", 2.5), ("pred_x", None), ("rep_x", -1.2), ("syn_x", 0.1), ("punct_x", None)]
    text = {r["p"]: E.explanation(s, spark.createDataFrame([(1, r["p"])], "k int, p double"), "k").first()["explanation"] for r in p.collect()}
    assert text[0.9] == (
        "Scored machine-like, driven mainly by lexical diversity, which is far above the human average. "
        "Also contributing: predictability (above typical), repetition (noticeably below the human average). Pushing the other way: punctuation, below typical.")
    assert text[0.1].startswith("Scored consistent with human writing, driven mainly by punctuation") and "Pushing the other way: lexical diversity, far" in text[0.1]
    v = spark.createDataFrame([(4, 99), (6, 30), (6, 90), (12, 65), (12, 50)], "n int, s int").select(E.assessment(F.col("n"), F.col("s"))).collect()
    assert [r[0] for r in v] == ["insufficient_text", "likely_human", "mixed_signals", "likely_machine", "mixed_signals"]


def test_ranked_signals(spark):
    rows = [(1, 0.4, -1.0, 3.0, 0.02), (2, -0.03, 0.01, 0.0, 0.0), (3, 0.2, -0.2, -0.5, 0.0)]
    d = spark.createDataFrame(rows, "k int, lex_ttr double, lex_mtld__missing double, docmean_punct_comma_density double, pred_cross_entropy double")
    names = d.columns[1:]
    long = d.unpivot(["k"], names, "measured_feature", "contribution")
    want = {}
    for r in E.signals(long, "k").collect():
        want.setdefault(r["k"], []).append((r["rank"], r["family"], r["direction"], r["contribution"], r["strongest_feature"].removesuffix("__missing")))
    got = d.select("k", E.ranked({n: F.col(n) for n in names}, ["lex_ttr"], {"lex_ttr": (0.1, 0.1)}).alias("s")).collect()
    keys = ("rank", "family", "direction", "contribution", "strongest_feature")
    assert {r["k"]: [tuple(x[c] for c in keys) for x in r["s"]] for r in got if r["s"]} == {k: sorted(v) for k, v in want.items()}
    assert all(E.family_of(n) == f for n, f in d.select(*[E.family(F.lit(n)).alias(n) for n in names]).first().asDict().items())


def test_analysis(spark):
    import random

    from inkspan.functions import normalize as N
    from inkspan.plans import detector as D
    from inkspan.plans.analyze import analyze

    rng = random.Random(3)
    some = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]

    def essay(machine: bool) -> str:
        out = []
        for _ in range(rng.randint(6, 15)):
            w = [rng.choice(some[:20] if machine else some) for _ in range(rng.randint(9, 12) if machine else rng.randint(5, 18))]
            out.append((("Moreover, " if machine and rng.random() < 0.8 else "") + " ".join(w)).capitalize() + ".")
        return " ".join(out)

    rows = [(i, essay(i % 2 == 1), i % 2, f"Prompt {i // 2 % 2}") for i in range(40)]
    train = spark.createDataFrame(rows, "essay_id bigint, text string, label int, prompt_name string")
    det = D.train(train)
    new = [(100 + i, essay(i % 2 == 1)) for i in range(10)] + [(200, None), (201, "  "), (202, "Only a few words here. No.")]
    docs = spark.createDataFrame(new, "essay_id bigint, text string")
    got = {r["essay_id"]: r for r in analyze(docs, det).collect()}
    assert set(got) == {i for i, _ in new}
    for i in (200, 201):
        r = got[i]
        assert (r["risk_score"], r["confidence"], r["confidence_band"], r["assessment"], r["signals"], r["sentences"], r["passages"]) == (0, 0.0, "low", "insufficient_text", [], [], [])
    assert got[202]["assessment"] == "insufficient_text" and got[202]["passages"] == [] and [x["risk_score"] is None for x in got[202]["sentences"]] == [False, True]
    right = sum((got[100 + i]["risk_score"] >= 50) == (i % 2 == 1) for i in range(10))
    assert right >= 8
    for i in range(10):
        r = got[100 + i]
        s = r["sentences"]
        assert len(r["passages"]) == len(s) - 3 and r["signals"] and any(x["signals"] for x in s)
        assert all(x["risk_score"] is not None for x in s) and 0 < r["confidence"] <= min(1, len(s) / 12)
        for k, x in enumerate(r["passages"]):
            assert (x["start_sentence_index"], x["end_sentence_index"], x["start"], x["end"]) == (k, k + 3, s[k]["start"], s[k + 3]["end"])
            assert abs(x["risk_score"] - sum(y["risk_score"] for y in s[k : k + 4]) / 4) <= 1
    # With the intercept the contributions of the document model are the log-odds of the risk.
    sent = N.sentences(docs.filter("text is not null"))
    f = D.sentence_table(sent, G.score(sent, det.language))
    d = D.document_table(sent, f, f.filter("is_scorable").select("essay_id", det.sentence.probability(f.columns).alias("score")))
    c = d.select("essay_id", *[x.alias(k) for k, x in det.document.contributions(d.columns).items()])
    for r in c.collect():
        z = det.document.intercept + sum(v for k, v in r.asDict().items() if k != "essay_id")
        assert abs(100 / (1 + math.exp(-z)) - got[r["essay_id"]]["risk_score"]) <= 0.51
    with pytest.raises(ValueError):
        D.train(train.filter("prompt_name = 'Prompt 0'"))


def test_fits_of_subsets(spark, monkeypatch):
    """Several models in a few passes: those that medians, matrix statistics and the library's fit give for each subset."""
    import random

    from inkspan.operators import fit as Z
    from inkspan.session import materialize

    rng, rows = random.Random(5), []
    for _ in range(600):
        x = [rng.gauss(0, 1), round(rng.gauss(0, 1) * 3) / 7, rng.gauss(5000, 1000)]
        y = int(rng.random() < 1 / (1 + math.exp(-x[0] - x[1])))
        rows.append((rng.randrange(6) * 2 + y, x[0], None if rng.random() < 0.2 else x[1], x[2], 1.0, x[0] if rng.random() < 0.2 else None))
    df = materialize(spark.createDataFrame(rows, "_group int, a double, b double, c double, same double, rare double").repartition(3))
    cols, subsets = df.columns[1:], [{g for g in range(12) if g // 4 != i} for i in range(3)] + [{g for g in range(12) if g // 2 % 2}]
    wanted = []
    for s in subsets[2:]:
        d = df.filter(F.col("_group").isin(*s)).withColumn("label", F.col("_group") % 2)
        want = M.fit_statistics(d, cols).collect()
        x = M.matrix_columns(want, d.columns)
        wanted.append((want, *M.fit_logistic(d.select("label", *[v.alias(k) for k, v in x.items()]), list(x))))
    for start in (40, 10_000):  # a start from a few rows, and from all
        monkeypatch.setattr(Z, "START_ROWS", start)
        spark.sparkContext.setJobGroup(f"fits-{start}", "")
        got, moments = Z.fit_subsets(df, cols, subsets, 12)
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits-{start}")) <= 20
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for (stats, coefs, b), (want, c, a) in zip(got[2:], wanted, strict=True):
            assert [(r["feature"], r["median"], r["has_indicator"]) for r in stats] == [(r["feature"], r["median"], r["has_indicator"]) for r in want]
            assert all(abs(r[k] - q[k]) <= 1e-9 * max(1, abs(q[k])) for r, q in zip(stats, want, strict=True) for k in ("mean", "sd"))
            assert set(c) == set(coefs) and abs(a - b) < 1e-5 and all(abs(c[k] - coefs[k]) < 1e-5 for k in c)
        n, m, sd = moments({0, 2, 4})["b"]
        r = df.filter("_group in (0, 2, 4)").agg(F.count("b"), F.avg("b"), F.stddev_pop("b")).first()
        assert n == r[0] and abs(m - r[1]) < 1e-9 and abs(sd - r[2]) < 1e-9
    models = {0: got[0], 3: got[1]}
    p = {(r["a"], r["_group"]): r["score"] for r in Z.apply_by_group(df, ["a", "_group"], models).collect()}
    for g, (stats, coefs, b) in models.items():
        z = sum((F.lit(coefs[k]) * c for k, c in M.matrix_columns(stats, df.columns).items()), F.lit(b))
        own = df.filter(F.col("_group") == g).select("a", M.probability(z).alias("p")).collect()
        assert len(own) == sum(k[1] == g for k in p) and all(abs(p[r["a"], g] - r["p"]) < 1e-9 for r in own)
    one = df.filter("_group % 2 = 1")  # one class only
    assert math.isinf(Z.fit_subsets(one, ["a", "c"], [set(range(12))], 12)[0][0][2])


def test_hybrid(spark):
    s = spark.createDataFrame([(1, i, f"Sentence number {i}.") for i in range(10)] + [(2, 0, "Short.")], "essay_id bigint, sent_idx int, text string")
    r = H.rebuild(H.choose(s), lambda c: F.upper(c)).orderBy("sent_idx").collect()
    text = " ".join(x["text"] for x in r)
    assert len(r) == 10 and all(text[x["start_char"] : x["end_char"]] == x["text"] for x in r) and 1 <= sum(x["is_rewritten"] for x in r) <= 6


def test_entry_and_queries(spark):
    import __spark_entry__ as entry
    from inkspan.plans import oracle

    q = entry.queries()
    assert set(oracle.oracle_sql()) <= set(q)
    assert entry.entry(spark).count() > 0


def test_sources(spark, tmp_path):
    from inkspan.sources import tables as S

    (tmp_path / "a.txt").write_text("fine text")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_text("  \n")
    (tmp_path / "d.md").write_text("x")
    ok, bad = S.read_texts(spark, str(tmp_path))
    assert [r["text"] for r in ok.collect()] == ["fine text"]
    assert sorted(r["reason"] for r in bad.collect()) == ["blank", "encoding", "extension"]


def test_stream(spark, tmp_path):
    from inkspan.streaming.analyze import stream_features

    docs(spark, BASE, OTHER).write.parquet(str(tmp_path / "in"))
    q = stream_features(spark, str(tmp_path / "in"), "essay_id bigint, text string", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scores_and_grid(spark):
    rows = [(1, i, 0.1 * i) for i in range(10)] + [(2, i, None) for i in range(5)] + [(3, 0, 0.9)]
    d = spark.createDataFrame(rows, "k bigint, sent_idx int, score double")
    s = {r["k"]: r.asDict() for r in V.document_scores(d, "k", "score").collect()}
    assert s[2]["sentscore_mean"] == 0.0 and s[2]["total_sentence_count"] == 5.0 and s[1]["sentscore_q50"] == 0.45 and s[3]["sentscore_std"] == 0.0
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None)], "k bigint, label int")
    g = {r["sentences"]: r.asDict() for r in V.length_grid(d, labels, "k", "score").collect()}
    assert set(g) == {3, 5, 8} and g[5]["essays_scored"] == 1 and g[5]["accuracy"] == 1.0 and g[5]["recall"] is None
    b = {r["k"]: r.asDict() for r in V.band_summary(d, "k", "score", E.risk_band(E.risk_score(F.col("score")))).collect()}
    assert (b[1]["low_risk_sentences"], b[1]["medium_risk_sentences"], b[1]["high_risk_sentences"], b[2]["unscored_sentences"]) == (4, 3, 3, 5)
    assert V.length_grid(d.limit(0), labels, "k", "score").count() == 0


def test_metadata(spark):
    d = docs(spark, "A  b", "c", None)
    src = spark.createDataFrame([(9, "A b", "late"), (3, "A\tb ", "early"), (4, None, "none")], "essay_id bigint, text string, flag string")
    assert {r["essay_id"]: r["flag"] for r in C.attach_metadata(d, src, ["flag"]).collect()} == {0: "early", 1: None, 2: None}


def test_more_sources(spark, tmp_path):
    from inkspan.sources import tables as S

    (tmp_path / "a.csv").write_text('text,source\n"two\nlines, ""quoted""",gen\n')
    r = S.read_corpus_csv(spark, str(tmp_path / "a.csv"), "text string, source string", {"source": "generator"}).collect()
    assert [tuple(x) for x in r] == [('two\nlines, "quoted"', "gen")]
    d = spark.createDataFrame([(1, "x"), (2, None)], "essay_id bigint, text string")
    S.append_jsonl(d, str(tmp_path / "j"))
    S.append_jsonl(d.filter("essay_id = 2").selectExpr("essay_id + 1 as essay_id", "text"), str(tmp_path / "j"))
    done = S.read_jsonl(spark, str(tmp_path / "j"), "essay_id bigint, text string")
    assert sorted(x[0] for x in done.collect()) == [1, 2, 3]
    assert [x[0] for x in H.pending(spark.range(6).withColumnRenamed("id", "essay_id"), done).orderBy("essay_id").collect()] == [0, 4, 5]
    S.write_parquet(d, str(tmp_path / "p"))
    S.write_csv(d, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    S.write_report(d.limit(1), str(tmp_path / "r.json"))
    assert "essay_id" in (tmp_path / "r.json").read_text()
    assert S.health({"a": str(tmp_path / "r.json")})["status"] == "ok" and S.health({"a": "/nowhere"}) == {"status": "degraded", "missing": ["a"]}
