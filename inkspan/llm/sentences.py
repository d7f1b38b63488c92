"""Problem 3: sentence boundaries across languages and scripts.

Candidate boundaries (closing marks outside quotations and brackets that stand inside a sentence, whatever their script,
and the spaces of Thai) are classified by a maximum-entropy model over the neighbouring tokens, their case, length,
digits and script. It is trained on reliable boundaries: the ends of paragraphs with the first word of the next, marks
of scripts whose marks do nothing else, spaces in Thai that touch no digit, and marks and spaces that can't end a sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm import maxent

#: The model is fitted on this many texts, those with the smallest hash.
TRAIN_TEXTS = 4_000

# Closing marks, pairs of quotation marks and brackets, and what is known of abbreviations.
MARKS = ".!?…。！？．।॥؟۔｡"
WIDE = "。！？．｡"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "‹": "›", "(": ")", "（": "）", "[": "]", "【": "】"}
BRACKETS = "(（[【"
TITLES = frozenset("dr mr mrs ms prof sr sra srta d dña m mm mme mlle fr hr herr st av no nr núm núms nº rm डॉ श्री د أ marktstr str art fig".split())
INNER = frozenset("approx ca vs etc bzw i.e e.g z b d.h h u.a co bros inc ltd sept oct nov dec jan feb aug p ej p.ej a.m p.m ph.d lb kg".split())

_BLANK = regex.compile(r"\n[^\S\n]*(?:\p{Cf}[^\S\n]*)*\n\s*")
#: Marks that do nothing but end sentences: reliable examples. A bar written for the danda is one of them.
SURE = WIDE + "।॥؟۔|"
_RUN = regex.compile(rf"(?:[{regex.escape(MARKS)}]|(?<=\p{{Devanagari}})\s?\|)+(?:[^\S\n]+[!?](?=\s|$))?")
_THAI = regex.compile(r"\p{Thai}")
_CF = regex.compile(r"\p{Cf}")
_LEFT = regex.compile(r"[^\s\"“„«「『(（\[]*$")
_RIGHT = regex.compile(r"[\s\"“„«「『‘'(（\[¿¡—–-]*([\p{L}\p{M}\p{N}\p{Cf}'’.]+)")


def _spans(t: str) -> list[tuple[int, int, bool]]:
    """Outermost closed quotations and brackets: (start, end excluded, is bracket). Unclosed ones are none."""
    out, stack = [], []
    for i, c in enumerate(t):
        if stack and c == stack[-1][1]:
            a, _, bracket = stack.pop()
            if not stack:
                out.append((a, i + 1, bracket))
        elif c in PAIRS:
            if not (stack and stack[-1][0] >= 0 and stack[-1][1] == c):
                stack.append((i, PAIRS[c], c in BRACKETS))
        elif c == '"':
            before, after = t[i - 1 : i], t[i + 1 : i + 2]
            if after and not after.isspace() and (not before or before.isspace() or before in "([（「«—"):
                stack.append((i, '"', False))
        if len(stack) > 8:
            stack = stack[-4:]
    if stack:  # what an unclosed mark hid
        a = stack[0][0]
        inner = [(x + a + 1, y + a + 1, z) for x, y, z in _spans(t[a + 1 :])] if len(stack) < 4 else []
        out += inner
    return sorted(out)


def _script(c: str) -> str:
    o = ord(c[0]) if c else 0
    return "lat" if o < 0x250 else "ara" if 0x600 <= o < 0x780 else "dev" if 0x900 <= o < 0x980 else "tha" if 0xE00 <= o < 0xE80 else "cjk" if o >= 0x2E80 else "oth"


def _shape(w: str) -> str:
    return ("0" if not w else "U" if w.isupper() and len(w) > 1 else "u" if w[:1].isupper() else "9" if w[:1].isdigit() else "l" if w[:1].islower() else "c") + ("." if "." in w else "")


class Candidate:
    __slots__ = ("end", "left", "mark", "prev", "right", "space", "start")

    def __init__(self, t: str, m, nxt: str = ""):
        """A run of marks in a paragraph; ``nxt`` follows if the paragraph ends there."""
        self.start, self.end, self.mark = m.start(), m.end(), m.group()
        before = t[max(0, m.start() - 60) : m.start()]
        left = _LEFT.search(before).group()
        head = before[: len(before) - len(left)].rstrip()
        self.prev = _CF.sub("", _LEFT.search(head).group()).lower()[-12:]
        self.left = _CF.sub("", left)
        after = t[m.end() : m.end() + 60] or nxt[:60]
        r = _RIGHT.match(after)
        self.space = not t[m.end() : m.end() + 1] or t[m.end()].isspace()
        self.right = _CF.sub("", r.group(1)) if r else ""

    def features(self) -> list[int]:
        l, r = self.left.lower(), self.right.lower().strip(".'’")
        ls, rs = _shape(self.left), _shape(self.right)
        mk = self.mark[:1] + (str(min(len(self.mark), 3)) if self.mark[:1] in ".…" else "")
        known = "t" if l in TITLES else "i" if l in INNER else "1" if len(l) == 1 and l.isalpha() else "n" if l.isdigit() else "-"
        sc = _script(self.left[-1:])
        return maxent.hashed([
            "bias", f"m={mk}", f"l={l[-12:]}", f"r={r[:12]}", f"k={known}", f"ks={known}|{rs[:1]}", f"kr={known}|{r[:12]}", f"lr={l[-8:]}|{rs}", f"pl={self.prev}|{l[-8:]}",
            f"ls={ls}|{rs}", f"n={min(len(l), 8)}|{rs[:1]}", f"sc={sc}|{mk}", f"mr={mk}|{rs[:1]}", f"mrr={mk}|{r[:12]}", f"lll={l[-8:]}|{r[:8]}",
        ])


def _thai(p: str) -> bool:
    """Whether a paragraph is mostly Thai, which ends sentences by spaces."""
    return len(_THAI.findall(p)) * 2 > sum(c.isalpha() for c in p)


def _gaps(p: str) -> list[tuple[int, int, list[int]]]:
    """The inner spaces of a Thai paragraph: (start, end, features). As many features as marks have."""
    out = []
    for m in regex.finditer(r"\s+", p):
        a, b = p[m.start() - 1 : m.start()], p[m.end() : m.end() + 1]
        if a and b:
            sides = ["9" if x.isdigit() else _script(x) if x.isalpha() else "." for x in (a, b)]
            f = ["thai", f"ta={sides[0]}", f"tb={sides[1]}", f"tt={'9' in sides}", f"tab={sides[0]}|{sides[1]}"]
            out.append((m.start(), m.end(), maxent.hashed((f * 3)[:15])))
    return out


def _plain(t: str, c: Candidate) -> bool:
    """Whether a run of marks may be a boundary at all, by what touches it."""
    nxt = t[c.end : c.end + 1]
    if not nxt or nxt.isspace() or c.mark[-1] in SURE or c.mark[0] in "…" and not nxt.isalnum():
        return True
    if nxt in ",;:،؛،、，；：-–—)’'":
        return False
    if nxt.isalnum():
        # No space after the mark: an ending only behind a plain word, before a letter.
        if c.mark == "." and (not nxt.isalpha() or len(c.left) < 3 or not c.left.isalpha() or c.left.lower() in TITLES | INNER):
            return False
        return not (c.left[-1:].isdigit() and nxt.isdigit())
    return True


def _closed(t: str, i: int) -> int:
    """The position after closing quotation marks and brackets that follow a mark directly."""
    while i < len(t) and t[i] in "\"”’»」』)）]】›":
        i += 1
    return i


def paragraph_ends(t: str, w: np.ndarray | None) -> list[int]:
    """Ends (excluded, closers included) of the sentences of one paragraph; the rest after the last one is the caller's."""
    spans, k, start, out = _spans(t), 0, 0, []
    for m in _RUN.finditer(t):
        if m.start() < start:
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        inside = k < len(spans) and spans[k][0] <= m.start() < spans[k][1]
        c = Candidate(t, m)
        if inside:
            a, b, bracket = spans[k]
            if t[m.end() : b].strip("\"”’»」』)）]】› \t\n "):
                continue  # more text of the quotation follows
            own = not t[start:a].strip()
            r = _RIGHT.match(t[b : b + 60])
            nxt = t[b:].lstrip()
            if not nxt:
                out.append(b)
                break
            if nxt[0] in ",;:،、，；-–—.!?…。！？":
                continue
            if bracket and own:
                out.append(b)
                start = b
            elif not bracket and not own and r and r.group(1)[:1].isupper() and m.group()[0] in ".!?…":
                out.append(b)
                start = b
            continue
        if not _plain(t, c):
            continue
        if w is None or w[c.features()].sum() > 0:
            e = _closed(t, m.end()) if '"' not in t[m.end() : m.end() + 1] else m.end()
            out.append(e)
            start = e
    return out


def segment(text: str, w: np.ndarray | None) -> list[tuple[int, int]]:
    """Sentences of a text: (start, end) in code points, end excluded, without outer white space."""
    out: list[tuple[int, int]] = []

    def add(a: int, b: int) -> None:
        x = text[a:b]
        a += len(x) - len(x.lstrip())
        b = a + len(x.strip())
        if b > a:
            if not regex.search(r"[\p{L}\p{M}\p{N}]", text[a:b]) and out and a >= out[-1][1] and "\n\n" not in text[out[-1][1] : a]:
                return  # stray marks are no sentence
            out.append((a, b))

    at = 0
    for m in [*_BLANK.finditer(text), None]:
        z = m.start() if m else len(text)
        p = text[at:z]
        if p.strip():
            begin = 0
            if _thai(p):
                for a, b, f in _gaps(p):
                    if w is None or w[f].sum() > 0:
                        add(at + begin, at + a)
                        begin = b
            else:
                for e in paragraph_ends(p, w):
                    add(at + begin, at + e)
                    begin = e
            add(at + begin, z)
        at = m.end() if m else z
    return out


# Short texts of every script whose boundaries are sure: they stand in each training sample, so that a sample without
# a script leaves its marks to no chance.
SEEDS = (
    "他走了。天黑了！5天后呢？好。\n\n雨停了。", "静かだ。雨が降る！なぜ？はい｡ 3日後。\n\n夜だ。", "वह गया। 5 दिन। रात हुई॥ घर आया | अब सोया।\n\nसुबह हुई।",
    "وہ گیا۔ رات ہوئی۔ 5 دن۔\n\nصبح ہوئی۔", "ذهب؟ نعم. عاد؟ 5 أيام؟\n\nنام.", "ดี 5 วัน มาก แล้ว ไป 10 ปี กลับ บ้าน\n\nนอน หลับ",
)
SEED_TIMES = 20


def examples(texts: list[str]) -> tuple[list[list[int]], list[int]]:
    """Reliable boundaries (1) and non-boundaries (0) of a sample and of the seeds."""
    texts = [*texts, *SEEDS * SEED_TIMES]
    paras = [[p for p in _BLANK.split(t) if p and p.strip()] for t in texts]
    first: dict[str, int] = {}
    for ps in paras:
        for p in ps:
            r = _RIGHT.match(p.strip()[:60])
            if r:
                k = _CF.sub("", r.group(1)).lower()
                first[k] = first.get(k, 0) + 1
    xs, ys = [], []
    for ps in paras:
        for i, p in enumerate(ps):
            q = p.strip()
            if _thai(q):
                for a, b, f in _gaps(q):  # reliable by the digits they touch
                    xs.append(f)
                    ys.append(0 if q[a - 1].isdigit() or q[b].isdigit() else 1)
                continue
            spans = _spans(q)
            for m in _RUN.finditer(q):
                if any(a <= m.start() < b for a, b, _ in spans):
                    continue
                c = Candidate(q, m, ps[i + 1].strip() if i + 1 < len(ps) else "")
                if not _plain(q, c):
                    continue
                if m.end() == len(q):
                    if i + 1 < len(ps):
                        xs.append(c.features())
                        ys.append(1)
                    continue
                l, r = c.left.lower(), c.right
                title = l in TITLES or (len(l) == 1 and l.isalpha() and c.mark == "." and l not in "imh")
                low = r[:1].islower() or r[:1].isdigit()
                seldom = first.get(r.lower(), 0) == 0
                if c.mark[-1] in SURE:
                    xs.append(c.features())
                    ys.append(1)
                    continue
                pause = len(c.mark) > 2 or c.mark == "…" or len(l) < 3
                if (title and c.mark == ".") or (low and l in INNER) or (low and seldom and pause and r[:1].isalpha()) or (l.isdigit() and c.mark == "." and r[:1].isupper() and seldom):
                    xs.append(c.features())
                    ys.append(0)
                elif not title and l not in INNER and len(l) > 2 and not l.isdigit() and not seldom and (r[:1].isupper() or _script(r) != "lat") and len(c.mark) < 2:
                    xs.append(c.features())  # a plain word before, a word that begins paragraphs behind
                    ys.append(1)
    return xs, ys


def fit(df: DataFrame, id_col: str, text_col: str, train_texts: int = TRAIN_TEXTS) -> np.ndarray:
    t = df.filter(F.col(text_col).isNotNull())
    xs, ys = examples(maxent.bounded_sample(t, id_col, text_col, train_texts, "sentences"))
    return maxent.fit(np.array(xs), np.array(ys, float))


def split(df: DataFrame, id_col: str, text_col: str, weights: np.ndarray) -> DataFrame:
    """``id, start_char, end_char``: one row per sentence.

    Null texts and texts of white space have no sentences; repeated rows have theirs each. A text without any mark
    is one sentence per paragraph.
    """
    b = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = b.value
        for pdf in batches:
            rid, a, z = [], [], []
            for i, x in zip(pdf["rid"].to_numpy(), pdf["txt"], strict=True):
                for s, e in segment(x, w):
                    rid.append(i)
                    a.append(s)
                    z.append(e)
            yield pd.DataFrame({"rid": np.array(rid, np.int64), "a": np.array(a, np.int32), "z": np.array(z, np.int32)})

    t = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt")).filter(F.col("txt").isNotNull())
    return t.mapInPandas(run, "rid bigint, a int, z int").select(F.col("rid").alias(id_col), F.col("a").alias("start_char"), F.col("z").alias("end_char"))


def found(essays: DataFrame, sentence: DataFrame) -> DataFrame:
    """``src, rec_id, start_char, end_char`` of the audited essays and the earlier segmenter's units."""
    w = fit(essays, "row_id", "text")
    a = split(essays.filter("seg_audit"), "row_id", "text", w).withColumnRenamed("row_id", "rec_id")
    b = split(sentence, "sentence_id", "text", w).withColumnRenamed("sentence_id", "rec_id")
    cols = ("rec_id", "start_char", "end_char")
    return a.select(F.lit("essay").alias("src"), *cols).unionAll(b.select(F.lit("sentence").alias("src"), *cols))
