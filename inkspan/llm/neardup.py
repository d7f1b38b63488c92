"""Problem 5: near-duplicate records with small edits.

Universe partition: tokens (5-character substrings) are hashed into segments, and records that agree on a key made
of segments become candidates, which are verified exactly.

Small sets (size bands up to SMALL tokens) use the pigeonhole bound: two sets of similarity at least t differ in at
most H = (1-t)/(1+t) * (a+b) tokens, so of e exact segments and d segments indexed with their one-deletion
neighbourhood, e + 2d > H, at least one must meet; segments empty in both sets give no key and are made up for by
more segments. The split into e and d is the cheapest by a cost model of the band.

For larger sets that bound needs hundreds of segments of three or four tokens, at which unrelated essays meet. They
index segment subsets instead: the universe is cut into ROUNDS * SEGMENTS segments, each segment stands for its
least token, and a subset is ROUNDS of them. Two sets of similarity s meet in a subset with probability
s**ROUNDS, hence are missed with probability (1 - s**ROUNDS)**SEGMENTS: 1e-3 at 0.75, 1e-4 at 0.78, 8e-6 at 0.8.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import reduced, spaced
from inkspan.llm.copies import _split
from inkspan.operators.pairs import bucket_pairs
from inkspan.session import materialize

WIDTH = 5
ROUNDS, SEGMENTS = 8, 64
SMALL = 64
#: Up to this many ids are broadcast to pick their texts from the table; more are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; wraps around."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def tokens(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the substrings."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(a) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Two lanes of 21 bits a character hold a substring exactly before mixing.
    lo = a[:n] | (a[1 : n + 1] << _U(21)) | (a[2 : n + 2] << _U(42))
    hi = a[3 : n + 3] | (a[4 : n + 4] << _U(21))
    h = np.sort(_mix(lo + _mix(hi + _U(0x9E3779B97F4A7C15))))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


_EDGES = np.concatenate([np.arange(ROUNDS * SEGMENTS, dtype=np.uint64) * _U(((1 << 64) - 1) // (ROUNDS * SEGMENTS)), np.array([(1 << 64) - 1], np.uint64)])

_ODD = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64))[:, None] | _U(1)


@functools.cache
def _band_plan(band: int, threshold: float) -> tuple[int, int]:
    """(exact segments, one-deletion segments) of a size band."""
    top = _band_top(band, threshold)
    h = math.floor((1 - threshold) / (1 + threshold) * 2 * top + 1e-9)
    best = None
    # Tiny sets leave exact segments empty too often: theirs are all deletion segments, which have keys when empty.
    for d in range((h + 2) // 2 if top <= 20 else 0, (h + 2) // 2 + 1):
        e = max(0, h + 1 - 2 * d)
        if e + d == 0:
            continue
        if e:  # segments that are empty in both sets agree without a key: as many more as are expected, twice over
            e += math.ceil(2 * (e + d) * math.exp(-threshold * top / (e + d)))
        t = top / (e + d)
        keys = e + d * (1 + t)
        meets = e * math.exp(-1.6 * t) + d * 2 * t * math.exp(-1.6 * max(t - 1, 0))
        cost = keys + 2000 * meets
        if best is None or cost < best[0]:
            best = (cost, e, d)
    return best[1], best[2]


def _band(n: int, threshold: float) -> int:
    return int(math.floor(math.log(n) / math.log(1 / threshold) + 1e-9))


def _band_top(band: int, threshold: float) -> int:
    return math.ceil((1 / threshold) ** (band + 1))


def _small_keys(t: np.ndarray, threshold: float) -> np.ndarray:
    """Pigeonhole keys of a set in its own size band and in those its larger partners may lie in."""
    n = len(t)
    out = []
    for b in range(_band(n, threshold), _band(max(n, math.floor(n / threshold + 1e-9)), threshold) + 1):
        e, d = _band_plan(b, threshold)
        m = e + d
        seg = (_mix(t ^ _U(b + 101)) % _U(m)).astype(np.int64)
        h = _mix(t + _U(0x5851F42D4C957F2D))
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, seg, h)
        filled = np.bincount(seg, minlength=m) > 0
        tag = _mix(np.arange(m, dtype=np.uint64) + _U((b + 1) << 32))
        whole = _mix(sums + tag)
        # An empty exact segment says nothing; an empty deletion segment is met by a segment of one token.
        out.append(whole[filled | (np.arange(m) >= e)])
        dele = seg >= e
        out.append(_mix(sums[seg[dele]] - h[dele] + tag[seg[dele]]))
    return np.concatenate(out)


@functools.cache
def _probes() -> np.ndarray:
    """For each segment the others it borrows from, in order, if it is empty."""
    n = ROUNDS * SEGMENTS
    i = np.arange(n, dtype=np.uint64)[:, None] * _U(1 << 20) + np.arange(256, dtype=np.uint64)[None, :]
    return (_mix(i + _U(0x9FB21C651E98DF25)) % _U(n)).astype(np.int32)


def _subset_keys(t: np.ndarray) -> np.ndarray:
    """One partition of the universe into ROUNDS * SEGMENTS segments; a segment stands for its least token."""
    n, h = ROUNDS * SEGMENTS, t  # the hashes are mixed and sorted already
    at = np.searchsorted(h, _EDGES)
    full = at[1:] > at[:-1]
    low = h[np.minimum(at[:-1], len(h) - 1)].copy()
    empty = np.flatnonzero(~full)
    if len(empty):  # an empty segment borrows from those its own number names, the same in every record
        p = _probes()[empty]
        ok = full[p[:, :16]]
        first = ok.argmax(axis=1)
        for k in np.flatnonzero(~ok.any(axis=1)):
            first[k] = full[p[k]].argmax()
        low[empty] = low[p[np.arange(len(empty)), first]] + (first + 1).astype(np.uint64)
    return _mix((low.reshape(ROUNDS, SEGMENTS) * _ODD).sum(axis=0) + np.arange(SEGMENTS, dtype=np.uint64))


def keys(text: str, threshold: float = 0.75) -> np.ndarray:
    """All index keys of a text, distinct."""
    t = tokens(text)
    n = len(t)
    if not n:
        return t
    out = []
    if n <= math.ceil(SMALL / threshold):
        out.append(_small_keys(t, threshold))
    if n > SMALL:
        out.append(_subset_keys(t))
    return out[0] if len(out) == 1 and n > SMALL else np.unique(np.concatenate(out))


def jaccard(a: str, b: str, width: int = WIDTH) -> float:
    """Exact similarity of the substring sets."""
    x = {a[i : i + width] for i in range(len(a) - width + 1)}
    y = {b[i : i + width] for i in range(len(b) - width + 1)}
    both = len(x & y)
    whole = len(x) + len(y) - both
    return both / whole if whole else 0.0


def _copy_key(text: Column, norm: Column) -> Column:
    """64-bit name of the group of formatting copies (problem 1) a text belongs to."""
    fields, body = _split(text)
    none = F.array().cast("array<string>")
    maybe = (F.instr(text, ":") > 0) | (F.instr(text, "：") > 0)  # a field needs a colon; most texts have none
    keys = F.array_sort(F.array_distinct(F.transform(fields, lambda x: reduced(x))))
    return F.when(maybe, F.xxhash64(reduced(body), keys)).otherwise(F.xxhash64(F.replace(norm, F.lit(" "), F.lit("")), none))


def _base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt"))
    t = t.filter(F.col("txt").isNotNull()).select("rid", "txt", spaced("txt").alias("norm"))
    return t.select("rid", "norm", _copy_key(F.col("txt"), F.col("norm")).alias("g"))


def _emit(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # repeated texts of this partition are indexed once
        for pdf in batches:
            ks, gs = [], []
            for g, x in zip(pdf["g"].to_numpy(), pdf["norm"], strict=True):
                if (c := (int(g), hash(x))) in seen:
                    continue
                seen.add(c)
                k = keys(x, threshold).view(np.int64)
                ks.append(k)
                gs.append(np.full(len(k), g, np.int64))
            if ks:
                yield pd.DataFrame({"key": np.concatenate(ks), "g": np.concatenate(gs)})

    return run


def _texts_of(base: DataFrame, reps: DataFrame) -> DataFrame:
    """``rep, norm`` of the given row ids."""
    ids = reps.select(F.col("rep").alias("rid")).distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    return base.select("rid", "norm").join(ids, "rid").groupBy(F.col("rid").alias("rep")).agg(F.min("norm").alias("norm"))


def links(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Returns ``(pairs, members)``.

    ``pairs`` (``ga, da, gb, db, similarity``) links classes of equal normalised texts (d) within groups of
    formatting copies (g), ga < gb; ``members`` (``rid, g, d``) has a row for each text. Texts whose
    normalised form has under five characters have no substrings and no links.
    """
    # Normalised once; the three readers below take the columns they need from the written table.
    # The filter stands behind the table: before it, it would normalise a second time.
    base = materialize(_base(df, id_col, text_col).withColumn("d", F.xxhash64("norm")), "p5-base").filter(F.length("norm") >= WIDTH)
    members = base.select("rid", "g", "d")
    index = base.select("norm", "g").mapInPandas(_emit(threshold), "key bigint, g bigint").repartition("key")
    # Keys of two groups come out of one aggregation; a key of many is cut into cells, so none meets in one task.
    cand = materialize(bucket_pairs(index, "key", "g").toDF("ga", "gb").distinct(), "p5-cand")
    some = cand.select(F.col("ga").alias("g")).unionAll(cand.select("gb")).distinct()
    classes = materialize(members.join(some, "g").groupBy("g", "d").agg(F.min("rid").alias("rep")), "p5-classes")
    # A row id may be repeated with other texts: the class is told by the text's own hash again.
    texts = materialize(_texts_of(base, classes), "p5-texts")
    side = {s: classes.select(F.col("g").alias(f"g{s}"), F.col("d").alias(f"d{s}"), F.col("rep").alias(f"r{s}")) for s in "ab"}
    pairs = cand.join(side["a"], "ga").join(side["b"], "gb")
    pairs = pairs.join(texts.select(F.col("rep").alias("ra"), F.col("norm").alias("ta")), "ra").join(texts.select(F.col("rep").alias("rb"), F.col("norm").alias("tb")), "rb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = functools.lru_cache(4096)(tokens)
        for pdf in batches:
            sims = []
            for x, y in zip(pdf["ta"], pdf["tb"], strict=True):
                # The hashed tokens decide unless a few collisions could matter; then the strings themselves do.
                p, q = cut(x), cut(y)
                lo, hi = sorted((len(p), len(q)))
                if lo < threshold * hi - 1e-9:
                    sims.append(0.0)
                    continue
                both = np.intersect1d(p, q, assume_unique=True).size
                sim = both / (lo + hi - both)
                sims.append(jaccard(x, y) if abs(sim - threshold) * lo <= 4 else sim)
            yield pdf[["ga", "da", "gb", "db"]].assign(similarity=np.array(sims, float))

    out = pairs.select("ga", "da", "gb", "db", "ta", "tb").mapInPandas(verify, "ga bigint, da bigint, gb bigint, db bigint, similarity double")
    near = materialize(out.filter(F.col("similarity") >= threshold), "p5-links")
    return near, members


def found(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.75) -> DataFrame:
    """``<id>_a, <id>_b``: all pairs of rows that are near duplicates and no formatting copies, each once."""
    near, members = links(df, id_col, text_col, threshold)
    mem = {s: members.select(F.col("g").alias(f"g{s}"), F.col("d").alias(f"d{s}"), F.col("rid").alias(f"i{s}")) for s in "ab"}
    rows = near.join(mem["a"], ["ga", "da"]).join(mem["b"], ["gb", "db"])
    across = rows.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))
    # Equal normalised texts in different copy groups (a header in one of them) are pairs of similarity 1.
    sub = members.groupBy("d", "g").agg(F.count(F.lit(1)).alias("n"))
    many = sub.groupBy("d").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("d")
    sub = sub.join(many, "d").select("d", "g")
    same = sub.select("d", F.col("g").alias("ga")).join(sub.select("d", F.col("g").alias("gb")), "d").filter("ga < gb")
    same = same.join(mem["a"].withColumnRenamed("da", "d"), ["ga", "d"]).join(mem["b"].withColumnRenamed("db", "d"), ["gb", "d"])
    same = same.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))
    return across.unionAll(same).filter(f"{id_col}_a < {id_col}_b").distinct()


def classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.75) -> DataFrame:
    """One row per text: ``id, class_id`` (least id of its copy group) and ``n_links``, the near-duplicate groups it links to."""
    near, members = links(df, id_col, text_col, threshold)
    both = near.select(F.col("ga").alias("g"), F.col("da").alias("d"), F.col("gb").alias("o")).unionAll(near.select("gb", "db", "ga"))
    n = both.groupBy("g", "d").agg(F.count_distinct("o").alias("n_links"))
    first = members.groupBy("g").agg(F.min("rid").alias("class_id"))
    j = members.join(n, ["g", "d"], "left").join(first, "g")
    return j.select(F.col("rid").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
