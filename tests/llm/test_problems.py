import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkspan.llm import copies, encoding, leaks, neardup, quantiles, repetition, sampling, sentences, splits, truncation
from inkspan.llm.forest import spanning_forest
from inkspan.operators import radix

TEXT = "The harbor was quiet and the lanterns burned until the last boat came home with its nets full of silver fish. "


def essays(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, text string, n string, txt string")


def frame(spark, texts):
    # columns with the names the operators use inside
    return essays(spark, [(i + 1, t, "x", "y") for i, t in enumerate(texts)])


EDGE = [None, "", "  \n", "!!!", "a"]


def test_copies(spark):
    t = ["Name: Ann Lee\nClass: 5B\n\nHello, big World!", "CLASS : 5b | name:ann  lee\n \nhello big wor​ld", "Hello big world", "hello... BIG world", "Name: Ann Lee\n\nHello big world", *EDGE, "a"]
    got = sorted(tuple(r) for r in copies.found(frame(spark, t), "row_id", "text").collect())
    assert got == [(1, 2), (3, 4), (10, 11)]
    rec = {r[0]: r[1] for r in copies.collapse(frame(spark, t), "row_id", "text").collect()}
    assert rec == {1: 2, 3: 2, 5: 1, 10: 2}
    assert copies.found(frame(spark, t).limit(0), "row_id", "text").count() == 0
    # rows repeated under one id
    assert copies.collapse(frame(spark, ["x y"]).union(frame(spark, ["x y"])), "row_id", "text").first()["n_copies"] == 2


def brute_share(x, k=24):
    seen, mark = set(), [False] * len(x)
    for i in range(len(x) - k + 1):
        if x[i : i + k] in seen:
            mark[i : i + k] = [True] * k
        seen.add(x[i : i + k])
    return sum(mark) / len(x) if x else 0.0


def test_repetition(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = []
    for share in (0, 0.1, 0.3, 0.5, 0.9):
        for n in (20, 100, 600):
            w = [rng.choice(words) for _ in range(n)]
            texts.append("".join(w + w[: int(n * share)]))
    for x in texts:
        assert repetition.repeated_share(x) == pytest.approx(brute_share(x))
    got = {r["row_id"] for r in repetition.found(frame(spark, texts + EDGE), "row_id", "text").collect()}
    assert got == {i + 1 for i, x in enumerate(texts) if brute_share(x) >= 0.25}
    every = repetition.repetition(frame(spark, texts + EDGE), "row_id", "text")
    assert every.count() == len(texts) + len(EDGE) and every.filter("band = 'empty'").count() == 4
    long = TEXT * 20000
    assert repetition.found(frame(spark, [long]), "row_id", "text").count() == 1


def test_repetition_of_any_ratio(spark):
    rng = random.Random(8)
    texts = []
    for n in (70, 110, 134, 200, 260, 600):  # ideographs compress badly, repeated or not
        for _ in range(20):
            x = "".join(chr(0x4E00 + int(2500 * rng.random() ** 2)) for _ in range(n))
            texts.append(x + x[: int(n * rng.uniform(0.2, 0.5))])
    shares = [brute_share(x) for x in texts]
    got = {r["row_id"] for r in repetition.found(frame(spark, texts), "row_id", "text").collect()}
    assert got == {i + 1 for i, x in enumerate(shares) if x >= 0.25}
    every = {r["row_id"]: r["share"] for r in repetition.repetition(frame(spark, texts), "row_id", "text").collect()}
    assert [every[i + 1] for i in range(len(texts))] == pytest.approx(shares)


def test_repetition_with_equal_hashes(monkeypatch):
    x = "".join(random.Random(9).choice("abcd") for _ in range(300))
    want = [brute_share(t) for t in (x, x + x[:150])]
    monkeypatch.setattr(repetition, "_hashes", lambda a, length: np.zeros(len(a) - length + 1, np.uint64))
    assert [repetition.repeated_share(t) for t in (x, x + x[:150])] == pytest.approx(want)


def test_sentences(spark):
    train = ["He saw Dr. Brown at 6 p.m. by the pier. The fish was good! Was it cheap? It was.\n\nMrs. Lee left. We waited... and then it rained.\n\nThe end came."] * 50
    w = sentences.fit(frame(spark, train), "row_id", "text")
    cut = lambda x: [x[a:b] for a, b in sentences.segment(x, w)]
    assert cut("Dr. Brown paid 4.5 coins. The fish was good!") == ["Dr. Brown paid 4.5 coins.", "The fish was good!"]
    assert cut("他说：“走吧！”然后走了。好。") == ["他说：“走吧！”然后走了。", "好。"]
    assert cut("One\n\nTwo") == ["One", "Two"]
    assert cut("ดี 5 วัน มาก แล้ว") == ["ดี 5 วัน", "มาก", "แล้ว"]
    assert cut("क्या हुआ? वह गया। 5 दिन।") == ["क्या हुआ?", "वह गया।", "5 दिन।"]
    for x in EDGE[1:3]:
        assert sentences.segment(x, w) == []
    out = sentences.split(frame(spark, EDGE), "row_id", "text", w)
    assert out.filter("end_char <= start_char").count() == 0 and out.filter("row_id = 5").count() == 1


def test_forest(spark):
    n = spark.range(9)
    e = spark.createDataFrame([(0, 1, 3), (1, 2, 1), (2, 0, 2), (3, 4, 1), (4, 5, 1), (5, 6, 1), (7, 7, 1)], "u bigint, v bigint, w int")
    labels, forest = spanning_forest(n, e)
    assert {r["id"]: r["root"] for r in labels.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 8}
    assert forest.distinct().count() == 5


def test_splits(spark):
    rows = [(i, f"Topic {i % 40}" if i % 3 else f"topic-{i % 40}!", "train") for i in range(4000)] + [(4000 + i, None, "test") for i in range(200)]
    d = spark.createDataFrame(rows, "row_id bigint, prompt_name string, split string")
    a = splits.assign_splits(d, "row_id", "prompt_name", {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert a.count() == 4200
    per = a.join(d.select("row_id", "prompt_name"), "row_id").filter("prompt_name is not null").groupBy(F.regexp_replace(F.lower("prompt_name"), "[^a-z0-9]", "")).agg(F.count_distinct("split").alias("k"))
    assert per.agg(F.max("k")).first()[0] == 1
    n = {r[0]: r[1] for r in a.groupBy("split").count().collect()}
    assert abs(n["train"] / 4200 - 0.7) < 0.05
    m = spark.createDataFrame([(1, "2025-01-01T00:00:00+00:00", {"Topic 1": "test"}), (2, "2025-02-01T00:00:00+00:00", {"TOPIC 1": "validation"})], "manifest_id int, created_at string, group_assignment map<string,string>")
    assert splits.found(d, "row_id", "prompt_name", "split", m).count() == sum(1 for r in rows if r[1] and r[1].lower().strip("!").replace("-", " ") == "topic 1")
    assert splits.assign_splits(d.limit(0), "row_id", "prompt_name", {"train": 0.7, "test": 0.3}).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    texts = []
    for n in (3, 6, 12, 25, 60, 150):
        for _ in range(6):
            w = [rng.choice(words) for _ in range(n)]
            texts.append(" ".join(w))
            for k in (1, 2, 4):
                v = list(w)
                for _ in range(max(1, n * k // 50)):
                    v[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(v))
    texts += [texts[0], texts[0].upper() + "!", *EDGE]
    want = set()
    live = [(i + 1, t) for i, t in enumerate(texts) if t and len(t) >= 5]
    norm = {i: "".join(c if c.isalnum() else " " for c in t.lower()).strip() for i, t in live}
    for x in range(len(live)):
        for y in range(x + 1, len(live)):
            a, b = norm[live[x][0]], norm[live[y][0]]
            if a.replace(" ", "") != b.replace(" ", "") and neardup.jaccard(a, b) >= 0.75:
                want.add((live[x][0], live[y][0]))
    got = {tuple(r) for r in neardup.found(frame(spark, texts), "row_id", "text").collect()}
    assert len(want) > 20 and got == want
    c = neardup.classes(frame(spark, texts), "row_id", "text")
    assert c.count() == len(live) and c.filter("row_id = class_id").count() < len(live)
    assert neardup.found(frame(spark, texts).limit(0), "row_id", "text").count() == 0


def test_percentiles(spark):
    rng = random.Random(5)
    vals = [("a", v) for v in [rng.choice([0.0, -0.0, 1.5, -2.25, math.inf, -math.inf, 1e300, 5e-324, rng.gauss(0, 1)]) for _ in range(500)]] + [("a", None), ("a", math.nan), ("b", 7.0), ("c", None)]
    d = spark.createDataFrame(vals, "g string, value double")
    got = {(r["g"], r["q"]): r["value"] for r in radix.percentiles(d, ["g"], "value", [0.0, 0.25, 0.5, 1.0]).collect()}
    s = sorted(v for g, v in vals if g == "a" and v is not None and not math.isnan(v))
    for q in (0.0, 0.25, 0.5, 1.0):
        assert got[("a", q)] == s[max(1, math.ceil(q * len(s))) - 1]
    assert got[("b", 0.5)] == 7.0 and ("c", 0.5) not in got
    day = spark.createDataFrame([("m", "day", f"d{i % 3}", rng.expovariate(1) + 0.01) for i in range(900)], "measure string, kind string, grp string, value double")
    both = {r["q"]: r["value"] for r in quantiles.combined_percentiles(day, bits=24).collect()}
    s = sorted(r["value"] for r in day.collect())
    for q, v in both.items():
        exact = s[max(1, math.ceil(q * len(s))) - 1]
        assert 0 <= exact - v <= exact * 2.0 ** (12 - 24)
    assert radix.percentiles(d.limit(0), ["g"], "value", [0.5]).count() == 0


def test_combined_groups(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        day, v = f"d{i % 4}", rng.expovariate(1) + 0.01
        rows += [("m", "prompt", f"p{i % 7}", day, v), ("m", "generator", f"g{i % 2}", day, v), ("m", "day", day, day, v)]
    values = spark.createDataFrame(rows, "measure string, kind string, grp string, day string, value double")
    sketch = quantiles.day_sketch(values)
    assert {(r["kind"], r["grp"], r["day"]) for r in sketch.select("kind", "grp", "day").distinct().collect()} == {(k if k != "day" else "all", g if k != "day" else "", d) for _, k, g, d, _ in rows}

    def close(got, kept):
        groups = {}
        for _, k, g, d, v in rows:
            if d in kept:
                groups.setdefault((k, g) if k != "day" else ("all", ""), []).append(v)
        assert set(got) == {(k, g, q) for k, g in groups for q in quantiles.QS}
        for (k, g, q), (n, v) in got.items():
            s = sorted(groups[k, g])
            exact = s[max(1, math.ceil(q * len(s))) - 1]
            assert n == len(s) and 0 <= exact - v <= exact * 2.0 ** (12 - 24)

    read = lambda x: {(r["kind"], r["grp"], r["q"]): (r["n"], r["value"]) for r in x.collect()}
    close(read(quantiles.combined_percentiles(values)), {"d0", "d1", "d2", "d3"})
    close(read(radix.merge_percentiles(sketch.filter("day in ('d1', 'd3')"), quantiles.GROUPS, quantiles.QS, 24)), {"d1", "d3"})


def test_sampling(spark):
    assert sampling.allocate(10, [{"share": 0.5, "floor": 0, "available": 3}, {"share": 0.5, "floor": 0, "available": 99}]) == [3, 7]
    assert sampling.allocate(10, [{"share": 0.0, "floor": 2, "available": 5}, {"share": 1.0, "floor": 0, "available": 99}]) == [2, 8]
    assert sum(sampling.allocate(10, [{"share": 1 / 3, "floor": 0, "available": 99}] * 3)) == 10
    rows = [(i, f"P {i % 2}", "Gen", i % 2) for i in range(100)] + [(100, None, None, None)]
    d = spark.createDataFrame(rows, "row_id bigint, prompt_name string, generator string, label int")
    t = spark.createDataFrame([(1, 1, "p-0", None, None, 0.75, 0), (1, 2, "p-1", None, None, 0.25, 0), (2, 1, None, "gen", 1, 0.9, 60), (2, 2, "nope", None, None, 0.1, 1)], "plan_id int, cell_id int, prompt_name string, generator string, label int, target_share double, min_rows bigint")
    assert sorted(tuple(r) for r in sampling.found(d, t).collect()) == [(2, 1), (2, 2)]
    n = {(r[0], r[1]): r[2] for r in sampling.draw(d, t, "row_id").groupBy("plan_id", "cell_id").count().collect()}
    assert n[(1, 1)] in (7, 8) and n[(1, 1)] + n[(1, 2)] == 10
    many = d.filter("row_id < 3").join(spark.range(40).select(), how="cross")  # rows repeated under one id
    t1 = t.filter("plan_id = 1")
    want = {(r["plan_id"], r["cell_id"]): r["quota"] for r in sampling.plan_report(many, t1).collect()}
    assert {(r[0], r[1]): r[2] for r in sampling.draw(many, t1, "row_id").groupBy("plan_id", "cell_id").count().collect()} == want


def test_encoding(spark):
    rng = random.Random(2)
    alphabet = list("abc d'  \n\t12é中🙂.,!s") + ["'ll", "'re", "   ", "　", "้"]
    docs = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["", None, "a" * 500, " " * 300 + "x"]
    enc = encoding.encoder(encoding.DEFAULT_VOCABULARY)
    want = [enc.encode_ordinary(t) if t else [] for t in docs]
    for chunk, over in ((40, 30), (100, 40), (1 << 18, 1 << 12)):
        assert [encoding.encode_text(t, chunk=chunk, overlap=over) for t in docs] == want
    got = {r["row_id"]: list(r["ids"]) for r in encoding.encode_corpus(frame(spark, docs), "row_id", "text", chunk=120, overlap=40).collect()}
    assert [got[i + 1] for i in range(len(docs))] == want
    far = encoding.encode_corpus(frame(spark, docs), "row_id", "text", chunk=40, overlap=30, spread=120)
    got = {r["row_id"]: list(r["ids"]) for r in far.collect()}
    assert [got[i + 1] for i in range(len(docs))] == want
    for t in ("a  \n\n b " * 300, "\n \t" * 900, "x" * 3000, "it's we'll " * 200):
        for chunk in (7, 64, 1024):
            ps = encoding.pieces(t, chunk, 16)
            assert "".join(ps) == t and encoding.encode_text(t, chunk=chunk, overlap=16) == enc.encode_ordinary(t)
    assert all(encoding.decode(i).decode() == (t or "") for i, t in zip(want, docs, strict=True))


def test_leaks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 40))) for _ in range(8)]
    docs = []
    for k in range(60):
        x = [rng.choice(words) for _ in range(30)]
        s = rng.choice(items).split()
        n = rng.randint(8, 20)
        docs.append(" ".join(x[:15] + s[:n] + x[15:]).upper().replace(" ", ", ", 3))
    want = set()
    for i, d in enumerate(docs):
        w = d.lower().replace(",", "").split()
        grams = {tuple(w[j : j + 13]) for j in range(len(w) - 12)}
        for k, t in enumerate(items):
            s = t.split()
            if grams & {tuple(s[j : j + 13]) for j in range(len(s) - 12)}:
                want.add((i + 1, k + 1))
    it = frame(spark, items + EDGE).withColumnRenamed("row_id", "item_id")
    got = [tuple(r) for r in leaks.found(frame(spark, docs + EDGE), "row_id", "text", it, "item_id", "text").collect()]
    assert want and set(got) == want and len(got) == len(want)
    assert leaks.found(frame(spark, docs), "row_id", "text", it.limit(0), "item_id", "text").count() == 0
    near = {(r[0], r[1]) for r in leaks.proximity(frame(spark, docs), "row_id", "text", it, "item_id", "text").collect()}
    assert near


def test_proximity(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(90)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 40))) for _ in range(8)]
    docs = []
    for k in range(120):
        s = rng.choice(items).split()
        j = rng.randrange(max(1, len(s) - 12))
        x = s[j : j + 13]
        if k % 3:
            rng.shuffle(x)
        for _ in range(rng.randint(0, 16)):
            x.insert(rng.randint(1, len(x)), f"other{rng.randint(0, 9)}")
        docs.append(" ".join([rng.choice(words) for _ in range(rng.randint(0, 9))] + x + ["end"] * rng.randint(0, 3)))
    want = {}
    for i, d in enumerate(docs):
        w = d.split()
        have = [set(w[a : a + 26]) for a in range(max(1, len(w) - 25))]
        for k, t in enumerate(items):
            s = t.split()
            for j in range(len(s) - 12):
                x = set(s[j : j + 13])
                if any(x <= h for h in have):
                    want[i + 1, k + 1] = max(want.get((i + 1, k + 1), 0), len(x))
    it = frame(spark, items + EDGE).withColumnRenamed("row_id", "item_id")
    near = lambda x, y: [tuple(r) for r in leaks.proximity(x, "row_id", "text", y, "item_id", "text").collect()]
    got = near(frame(spark, docs + EDGE), it)
    assert 40 < len(want) < 120 and len(got) == len(want) and {(a, b): n for a, b, n in got} == want
    monkeypatch.setattr(leaks, "CANDIDATES", 3)
    parts = leaks._items(it, "item_id", "text", 13)
    ids = np.arange(1, len(docs) + 1)
    small = leaks._near(parts, *leaks._shard(parts, ids, docs), ids, np.array(parts.ids), 26)
    assert {(a, b): n for a, b, n in small.itertuples(index=False)} == want
    assert near(frame(spark, docs), it.limit(0)) == [] and near(frame(spark, EDGE), it) == []


def test_truncation():
    rng = np.random.default_rng(0)
    mu, sd = truncation.censored_fit(500, 500 * 6.0, 500 * (36 + 0.25), 0, 7.0)
    assert mu == pytest.approx(6.0) and sd == pytest.approx(0.5)
    x = rng.normal(6, 0.5, 20000)
    o = x[x < 6.2]
    mu, sd = truncation.censored_fit(len(o), o.sum(), (o * o).sum(), (x >= 6.2).sum(), 6.2)
    assert mu == pytest.approx(6.0, abs=0.02) and sd == pytest.approx(0.5, abs=0.02)
    e = truncation.Ending("The fish was good.\n\n— Ann B., grade 6")
    assert e.closed and not e.trace
    assert truncation.Ending("He went to the [...]").trace and not truncation.Ending("It was Dr.").closed


def test_truncation_found(spark):
    rng = random.Random(6)
    subj, verb, obj = ["The cat", "My uncle", "A sailor", "Our teacher", "The baker"], ["found", "sold", "painted", "lost"], ["a green lamp", "the old boat", "some bread", "a letter"]
    rows = []
    for i in range(1500):
        t = " ".join(f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)} {rng.choice(['today', 'at night', 'in May'])}." for _ in range(rng.randint(5, 14)))
        whole = len(t)
        if i % 3 == 0:
            t = t[:300]
        rows.append((i, t, "limited" if i % 3 == 0 else "free", whole if i % 2 else None, "n"))
    d = spark.createDataFrame(rows + [(9001, None, None, None, "n"), (9002, "", "free", 3, "n"), (9003, "!!", None, None, "n")], "doc_id bigint, text string, source string, n_chars bigint, tail string")
    want = {r[0] for r in rows if len(r[1]) == 300 and not r[1].endswith(".")}
    got = {r[0] for r in truncation.found(d).collect()}
    assert len(got & want) / len(want) > 0.97 and len(got - want) <= 0.03 * len(want)
    assert {r["source"]: r["n_cut"] for r in truncation.rates(d).collect()}["free"] <= 5


def test_truncation_of_short_texts(spark):
    one, open_, long = "One short sentence about the harbor.", "no mark at all in this text", "word " * 200 + "end."
    for texts in ([], [one], [open_], [long], ["."], ["ไทย"], [one, "A. B. C. D.", open_]):
        w = truncation.fit_ending(texts)
        assert w.shape == (1 << 16,) and np.isfinite(w).all()
    xs, ys = truncation._examples([one])
    assert sorted(ys) == [0, 1] and len(xs) == 2
    assert truncation._examples([long]) == ([], [])  # its only sentence begins before the tail
    for texts in ([one], [open_], [], EDGE):
        rows = [(i, t, "s", None) for i, t in enumerate(texts)]
        d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
        live = sum(1 for t in texts if t and any(c.isalnum() for c in t))
        assert truncation.rates(d).agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0] == live


def test_index_blocks(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)]
    docs = [" ".join([rng.choice(words)] * 3 + rng.choice(items).split()[k % 9 : k % 9 + 16]) for k in range(50)] + EDGE
    it = frame(spark, items + EDGE).withColumnRenamed("row_id", "item_id")
    read = lambda: sorted(tuple(r) for r in leaks.found(frame(spark, docs), "row_id", "text", it, "item_id", "text").collect())
    want = read()
    assert len(want) >= 50
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 400)  # several blocks of items
    monkeypatch.setattr(leaks, "CANDIDATES", 5)
    assert read() == want
    index = leaks.build_index(frame(spark, docs), "row_id", "text").collect()
    n = sum(len(r["positions"]) for r in index)
    assert n == sum(len("".join(c if c.isalnum() else " " for c in (t or "").lower()).split()) for t in docs)
    assert all(sum(r["counts"]) == len(r["positions"]) == len(set(r["positions"])) for r in index)


def test_split_checks(spark):
    rows = [(i, f"Topic {i % 30}" + "!" * (i % 3)) for i in range(3000)] + [(3000 + i, None) for i in range(100)]
    d = spark.createDataFrame(rows, "row_id bigint, prompt_name string")
    assert tuple(splits.checks(d, "row_id", "prompt_name", {"train": 0.6, "test": 0.4}).first()) == (3100, 0, True)
    f = splits.forest_report(d, "prompt_name").collect()
    assert len(f) == 30 and all(r["n_edges"] == r["n_spellings"] - 1 and r["n_roots"] == 1 for r in f)
