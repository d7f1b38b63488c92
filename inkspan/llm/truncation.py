"""Problem 10: text cut off by field limits or in transfer.

Per source the lengths (characters, bytes, words) are modelled as a log-normal distribution that is right-censored at
a candidate limit; the censoring posterior of a value at the limit is combined with the evidence of its ending: a
maximum-entropy classifier of whether the last sentence is complete, traces of a cut, and the length the
source reported. The classifier learns from whole texts, which are cut at random places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm import maxent
from inkspan.session import materialize

#: The classifier is fitted on this many texts, those with the smallest hash; everything else covers all rows.
TRAIN_TEXTS = 8_000
TAIL = 400
MEASURES = ("chars", "bytes", "words")

# Marks that end a sentence, what may close behind them, and abbreviations that don't end one.
TERMINATORS = ".!?。！？．।؟…"
CLOSERS = "\"'”’»›)]」』）】*_"
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st mt rm no vs approx ca bzw z.b d.h u.a fr hr str e.g i.e j r sr sra srta dra dña av núm p.ej m mme mlle".split()
)
# Whole texts may close with one of these; they are no part of the last sentence.
_TRAILER = regex.compile(
    r"(?:\s|\p{Cf}|\p{Cc}|[\p{So}\p{Sk}️]|[:;]-?[)(DP]|</?\w+\s*/?>|\n[ \t]*\*(?:[ \t]*\*)+|\n\W*word count:? *\d+|\n\W*the end\b[.!]?|\n\W*thank you for reading[.!]?"
    r"|\n[—–-]\s*\p{L}[^\n]{0,50},\s*grade\s*\d+)+\Z", regex.I)
# Traces that a cut leaves behind; an ellipsis may also be the author's.
_TRACE = regex.compile(
    r"(?:\[(?:\.\.\.|…)\]?|\((?:\.\.\.|…)\)?|[\[(]\s*(?:cont|more|trunc|cut|read|snip|see)[^\n\])]{0,24}[\])]?|(?:read|see|show) more\W{0,4}|&[a-z]{0,6};?|&#\d{0,5}|<[/a-z]{0,8}|�+|%[0-9a-f]?|\\u?[0-9a-f]{0,3})\s*\Z", regex.I)
_DOTS = regex.compile(r"\s*(?:\.\.\.+|…+)\s*\Z")
_PLAIN_END = tuple(".!?。！？।؟")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’]+")
_END = regex.compile(rf"[{TERMINATORS}][{regex.escape(CLOSERS)}]*(?=\s|\Z)|[。！？]")


class Ending:
    """What a text ends with."""

    __slots__ = ("closed", "dots", "marks", "tail", "trace", "thai")

    def __init__(self, text: str):
        t = text[-TAIL:]
        if t[-1:] in _PLAIN_END and t[-2:-1] not in TERMINATORS and t[-40:].rsplit(None, 1)[-1][:-1].lower() not in ABBREVIATIONS:
            self.trace = self.dots = False  # the usual ending
            self.closed, self.tail, self.marks, self.thai = True, t, 1, False
            return
        cut = _TRAILER.sub("", t)
        m = _TRACE.search(cut)
        self.trace = bool(m) and m.start() > 0
        if self.trace:
            cut = cut[: m.start()].rstrip()
        d = _DOTS.search(cut)
        self.dots = bool(d)
        if d:
            cut = cut[: d.start()]
        body = cut.rstrip()
        bare = body.rstrip(CLOSERS + " ")
        last = bare[-1:] if not self.dots else ""
        self.closed = bool(last) and last in TERMINATORS
        if self.closed and last == ".":
            word = bare[:-1].rsplit(None, 1)[-1:] or [""]
            w = word[0].lstrip(CLOSERS + "(„“«").lower()
            self.closed = w not in ABBREVIATIONS
        self.marks = len(_END.findall(t))
        self.tail = body
        self.thai = bool(regex.search(r"\p{Thai}", body[-20:]))


def _tail_features(tail: str) -> list[int]:
    """Hashed features of a bare ending: last characters, last words, their shape and the length of the open segment."""
    ms = list(_END.finditer(tail))
    seg = tail[ms[-1].end() :] if ms else tail
    words = _WORD.findall(seg[-160:])
    last = words[-1] if words else ""
    prev = words[-2] if len(words) > 1 else ""
    prev2 = words[-3] if len(words) > 2 else ""
    low = [w.lower() for w in (prev2, prev, last)]
    n = len(words)
    f = ["bias", f"w1={low[2]}", f"w2={low[1]} {low[2]}", f"w3={low[0]} {low[1]} {low[2]}", f"p={low[1]}", f"n={min(n, 30)}", f"nb={min(n // 3, 8)}|{low[2]}"]
    f += [f"c{k}={tail[-k:].lower()}" for k in (1, 2, 3, 4, 5)]
    f += [f"cap={last[:1].isupper()}|{prev[-2:].lower()}", f"first={words[0].lower() if words else ''}|{min(n, 14)}", f"f={words[0].lower() if words else ''}|{low[2]}", f"sp={tail[-1:].isspace()}", f"open={tail.count(chr(34)) % 2}", f"len={min(len(seg) // 4, 30)}|{last.isascii()}"]
    f += [f"comma={',' in seg}|{min(n, 14)}|{last.isascii()}"]
    return maxent.hashed(f)


def _examples(texts: list[str], seed: int = 1) -> tuple[list[list[int]], list[int]]:
    """Endings of whole texts without their mark (0), and the same last sentences cut inside (1)."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for t in texts:
        e = Ending(t)
        if not e.closed or e.trace or e.thai:
            continue
        bare = e.tail.rstrip(CLOSERS + TERMINATORS + " ")
        # Starts of sentences that lie whole in the tail; the first of a short text starts with the text itself.
        ms = ([0] if len(t) < TAIL else []) + [m.end() for m in _END.finditer(e.tail) if m.end() < len(bare) - 1]
        # The last sentences of the tail serve each: cut inside, and bare at its end.
        for a, b in zip(ms, [*ms[1:], len(bare)], strict=False):
            b0 = len(e.tail[:b].rstrip(CLOSERS + TERMINATORS + " "))
            if b0 - a < 4:
                continue
            plain = regex.sub(r"[^\w\s]", "", e.tail[:b0]).lower() if rng.random() < 0.15 else e.tail[:b0]
            xs.append(_tail_features(plain))
            ys.append(0)
            k = int(rng.integers(a + 2, b0)) - (len(e.tail[:b0]) - len(plain))
            if rng.random() < 0.4:
                k = max(plain.rfind(" ", 0, k), min(a + 2, k))
            xs.append(_tail_features(plain[: max(2, k)].rstrip()))
            ys.append(1)
    return xs, ys


def fit_ending(texts: list[str]) -> np.ndarray:
    """Weights of the classifier: log-odds that the last sentence is cut; all 0 if no text is of use."""
    xs, ys = _examples(texts)
    return maxent.fit(np.array(xs), np.array(ys, float))


def censored_fit(n: float, s1: float, s2: float, n_c: float, c: float, rounds: int = 60) -> tuple[float, float]:
    """Maximum likelihood (mu, sigma) of a normal variable observed exactly n times (sums s1, s2) and n_c times as >= c (EM)."""
    mu = s1 / n if n else c
    sd = math.sqrt(max(s2 / n - mu * mu, 1e-4)) if n else 1.0
    for _ in range(rounds if n_c else 0):
        z = (c - mu) / sd
        tail = 0.5 * math.erfc(z / math.sqrt(2))
        h = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail if tail > 1e-12 else z + 1 / max(z, 1)
        e1 = mu + sd * h
        e2 = mu * mu + sd * sd + sd * (c + mu) * h
        m = (s1 + n_c * e1) / (n + n_c)
        v = (s2 + n_c * e2) / (n + n_c) - m * m
        mu, sd = m, math.sqrt(max(v, 1e-4))
    return mu, sd


def fit_limits(lengths: DataFrame) -> DataFrame:
    """``lengths``: source, measure, value, n. Returns ``source, measure, limit, posterior, n_at`` of the limits found.

    A candidate limit is a value that few values exceed (one in fifty, for texts that something was added to) and at
    which more values pile up than the distribution fitted with it as censoring point expects, by a
    factor of 6 and by at least 4 rows. The posterior is the share of the values there that were cut.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (source, measure), g in pdf.groupby(["source", "measure"], dropna=False):
            g = g.sort_values("value")
            v, n = g["value"].to_numpy(float), g["n"].to_numpy(float)
            total = n.sum()
            above = total - np.cumsum(n)
            best = None
            for i in np.flatnonzero((above <= total / 50) & (n >= 4)):
                c, x = v[i], np.log(v[:i])
                mu, sd = censored_fit(n[:i].sum(), (n[:i] * x).sum(), (n[:i] * x * x).sum(), n[i] + above[i], math.log(c))
                z = (math.log(c) - mu) / sd
                density = total * math.exp(-z * z / 2) / (sd * c * math.sqrt(2 * math.pi))
                local = n[(v < c) & (v >= 0.9 * c)].sum() / max(1.0, 0.1 * c)
                expect = max(density, local, 1e-9)
                if n[i] >= max(6 * expect, 4) and (best is None or n[i] / expect > best[0]):
                    best = (n[i] / expect, c, 1 - expect / n[i], n[i])
            if best:
                rows.append((source, measure, int(best[1]), float(best[2]), int(best[3])))
        return pd.DataFrame(rows, columns=["source", "measure", "lim", "posterior", "n_at"])

    # A group is the length histogram of one source: bounded by the distinct lengths, not by its rows.
    return lengths.groupBy("source").applyInPandas(fit, "source string, measure string, lim bigint, posterior double, n_at bigint")


def _lengths(cols: DataFrame) -> DataFrame:
    """Lengths after what a cut may have added (trailing white space and traces) is taken off."""
    body = F.regexp_replace("txt", r"(?i)\s*(\[(\.\.\.|…)\]|[\[(](cont|more|trunc|cut|read|snip)[^\n\])]{0,24}[\])]?|…|\.\.\.)?\s*$", "")
    stack = F.explode(F.array(
        F.struct(F.lit("chars").alias("measure"), F.length("txt").cast("bigint").alias("value")),
        F.struct(F.lit("bytes").alias("measure"), F.octet_length("txt").cast("bigint").alias("value")),
        F.struct(F.lit("words").alias("measure"), F.size(F.split(F.trim(body), r"\s+")).cast("bigint").alias("value")),
    )).alias("m")
    return cols.select("source", stack).filter("m.value > 0").groupBy("source", "m.measure", "m.value").agg(F.count(F.lit(1)).alias("n"))


def score(text: str, n_chars: float | None, limits: dict[str, tuple[int, float]], w: np.ndarray) -> float:
    """Log-odds that a text was cut inside its last sentence."""
    e = Ending(text)
    n, nb = len(text), len(text.encode("utf-8", "surrogatepass"))
    words = len(text.split())
    prior = -3.0
    for measure, (lim, post) in limits.items():
        near = {"chars": (lim - 1 <= n <= lim), "bytes": (lim - 3 <= nb <= lim), "words": lim - 1 <= words <= lim}[measure]
        exact = {"chars": n == lim, "bytes": nb == lim, "words": words == lim}[measure]
        if exact or (near and (measure == "bytes" or text[-1:].isspace() or e.trace or e.dots)):
            prior = max(prior, math.log(max(post, 0.02) / max(1 - post, 0.002)))
    lost = n_chars is not None and n_chars > n + 3 and n_chars != nb and n_chars != len(text.encode("utf-16-le", "surrogatepass")) // 2
    if lost:
        prior = max(prior + 4.0, 4.0)
    if e.thai:
        # Thai marks no sentence end: only the limit, the length lost or a trace can tell.
        return prior - 1.0 + (6.0 if e.trace else 0.0)
    if e.closed:
        unclosed = e.tail.count('"') % 2 == 1 and e.tail[-1:] != '"' and e.marks > 0
        return prior - 9.0 + (3.0 if unclosed and prior > 0 else 0.0) + (3.0 if e.trace else 0.0)
    ev = float(np.clip(w[_tail_features(e.tail)].sum(), -6, 6))
    if e.trace:
        return prior + ev + 7.0
    if e.dots:
        return prior + ev - 1.0
    if e.marks == 0 and not e.dots and len(e.tail) >= 100 and (len(e.tail) >= 300 or e.tail == e.tail.lower() != e.tail.upper()):
        return prior + min(ev, 2.0) - (0.0 if prior > 0 else 1.0)  # written without marks: their absence says nothing
    return prior + ev + 2.5


def assess(docs: DataFrame, id_col: str, text_col: str, source_col: str, n_chars_col: str, train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """``id, source, log_odds`` for every text with letters, marks or digits; it counts as cut if log_odds > 0.

    Null and empty texts are no cases and have no row; repeated rows give one each; a missing source is a
    source of its own.
    """
    t = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(n_chars_col).cast("double").alias("n_chars"))
    t = t.filter(F.col("txt").rlike(r"[\p{L}\p{M}\p{N}]"))
    lim = fit_limits(_lengths(t)).groupBy("source").agg(F.collect_list(F.struct("measure", "lim", "posterior")).alias("limits"))
    lim = materialize(lim, "p10-limits")
    tails = maxent.bounded_sample(t.withColumn("tail", F.substring("txt", -TAIL, TAIL)), "rid", "tail", train_texts, "train")
    weights = t.sparkSession.sparkContext.broadcast(fit_ending(tails).astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for pdf in batches:
            s = []
            for x, n, ls in zip(pdf["txt"], pdf["n_chars"], pdf["limits"], strict=True):
                known = {} if ls is None else {a["measure"]: (a["lim"], a["posterior"]) for a in ls}
                s.append(score(x, None if n is None or n != n else float(n), known, w))
            yield pd.DataFrame({"rid": pdf["rid"], "source": pdf["source"], "log_odds": s})

    # One row per source: small unless there are millions of sources; the planner broadcasts it by its size.
    j = t.join(lim, "source", "left")
    return j.mapInPandas(run, "rid bigint, source string, log_odds double").withColumnRenamed("rid", id_col)


def found(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return assess(docs, id_col, "text", "source", "n_chars").filter("log_odds > 0").select(id_col)


def rates(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``source, n_docs, n_cut, rate``."""
    a = assess(docs, id_col, "text", "source", "n_chars")
    return a.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("log_odds") > 0).alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("n_docs"))
