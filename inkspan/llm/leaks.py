"""Problem 9: evaluation texts leaking into training text.

A positional inverted index of the corpus is built once and stored: for each shard of documents the distinct terms (64-bit
hashes of the words), and for each term its postings, the positions at which it stands. The frequencies of the test
terms are added up over all shards. Each window of a test item is then looked up from its globally rarest term: the
offset-adjusted lists of the neighbouring terms are intersected with that term's, and a run of enough of them is an
exact phrase. Proximity matches come from the same lists. No posting leaves its shard; only frequencies are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import word_string
from inkspan.session import materialize

#: Test items are looked up in blocks of about this many characters, which bounds what is broadcast at once.
BLOCK_CHARS = 4 << 20
#: Words of a shard, unless one document has more.
SHARD_WORDS = 1 << 19
#: Positions of rarest terms that a search holds at once, but for those of one window.
CANDIDATES = 1 << 20
#: What a text without words splits into: the hash of the empty string.
NO_WORD = np.array([xxhash.xxh64(b"", seed=42).intdigest()], np.uint64).view(np.int64)[0]
INDEX = "docs array<bigint>, starts array<int>, terms array<bigint>, counts array<int>, positions array<int>"


class Items:
    """Test items as arrays of term numbers, concatenated with separators that match nothing."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], least: int):
        self.ids = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.ids)}
        rows = [(at[i], np.asarray(h, np.int64)) for i, h in rows]
        self.vocab = np.unique(np.concatenate([h for _, h in rows])) if rows else np.empty(0, np.int64)
        pad = np.full(least, -2, np.int64)
        seq, item, start = [pad], [np.full(least, -1)], [np.zeros(least, bool)]
        for k, h in rows:
            if len(h) >= least:
                seq += [np.searchsorted(self.vocab, h), pad[:1]]
                item.append(np.full(len(h) + 1, k))
                start.append(np.arange(len(h) + 1) + least <= len(h))
        self.seq, self.item = np.concatenate([*seq, pad]), np.concatenate([*item, np.full(least, -1)])
        self.starts = np.flatnonzero(np.concatenate([*start, np.zeros(least, bool)]))
        self.least = least
        self.df = np.ones(len(self.vocab), np.int64)

    def rank(self, frequency: dict[int, int]) -> None:
        """Takes the terms' frequencies in the corpus: windows with an unknown term are dropped, the others anchored at their rarest."""
        self.df = np.array([frequency.get(int(t), 0) for t in self.vocab], np.int64)
        if len(self.starts):
            f = self.df[self.seq[self.starts[:, None] + np.arange(self.least)]]
            live = f.min(axis=1) > 0
            self.starts, f = self.starts[live], f[live]
            # Windows anchored at the same position of an item are looked up together.
            self.anchors = np.unique(self.starts + f.argmin(axis=1)) if len(f) else self.starts
        else:
            self.anchors = self.starts


def _hashes(words: Column) -> Column:
    return F.transform(F.split(words, " "), lambda x: F.xxhash64(x))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if (bare := flat == NO_WORD).any():
            n = n - np.bincount(np.repeat(np.arange(len(n)), n)[bare], minlength=len(n))
            flat, ids, n = flat[~bare], ids[n > 0], n[n > 0]
        end = np.cumsum(n)
        for own in np.split(np.arange(len(n)), np.flatnonzero(np.diff((end - 1) // SHARD_WORDS)) + 1):
            if not len(own):
                continue
            k = n[own]
            h = flat[end[own[0]] - k[0] : end[own[-1]]]
            # A position without a term parts neighbouring documents.
            where = (np.arange(len(h)) + np.repeat(np.arange(len(own)), k)).astype(np.int32)
            order = np.argsort(h, kind="stable")
            s = h[order]
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            starts = (np.cumsum(k + 1) - (k + 1)).astype(np.int32)
            row = (ids[own], starts, s[first], np.diff(np.append(first, len(s))).astype(np.int32), where[order])
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["docs", "starts", "terms", "counts", "positions"])


def build_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The stored positional index of all texts, one row per shard; null texts and those without words have no postings."""
    # Texts without words are left out where the lists are read: a filter on the words would work them out twice.
    w = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("rid"), _hashes(word_string(text)).alias("h"))
    return materialize(w.mapInArrow(_shards, INDEX), "p9-index")


def _frequencies(index: DataFrame, vocab: np.ndarray) -> dict[int, int]:
    """How often each term of a block of test items stands in the corpus: at most as many rows as the block has terms."""
    known = index.sparkSession.sparkContext.broadcast(vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, c in zip(b.column(0), b.column(1), strict=True):
                terms, counts = t.values.to_numpy(), c.values.to_numpy()
                at = np.minimum(np.searchsorted(terms, known.value), len(terms) - 1)
                ok = terms[at] == known.value
                yield pa.RecordBatch.from_arrays([pa.array(known.value[ok]), pa.array(counts[at[ok]].astype(np.int64))], names=["t", "n"])

    n = index.select("terms", "counts").mapInArrow(count, "t bigint, n bigint")
    return {r[0]: r[1] for r in n.groupBy("t").agg(F.sum("n")).collect()}


def _open(it: Items, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
    """The postings of a shard for the test terms: (term at each position, or -1; document of each position; positions
    by term; how many each term has). Positions are shifted by the length of a window.
    """
    m = it.least
    n = int(positions.max()) + 1
    at = np.minimum(np.searchsorted(terms, it.vocab), len(terms) - 1)
    have = np.where(terms[at] == it.vocab, counts[at], 0).astype(np.int64)
    begin = (np.cumsum(counts) - counts)[at]
    order = positions[np.repeat(begin - (np.cumsum(have) - have), have) + np.arange(have.sum())].astype(np.int64) + m
    flat = np.full(n + 2 * m, -1, np.int64)
    flat[order] = np.repeat(np.arange(len(have)), have)
    owner = np.searchsorted(starts + m, np.arange(n + 2 * m), side="right") - 1
    return flat, owner, order, have


def _shard(items: Items, docs: np.ndarray, texts: list[str]):
    """(term at each position, document of each position) of texts of words, as ``_open`` gives them from an index."""
    lists = [np.array([xxhash.xxh64(w.encode(), seed=42).intdigest() for w in t.split(" ")], np.uint64).view(np.int64) for t in texts]
    b = pa.RecordBatch.from_arrays([pa.array(np.asarray(docs)), pa.array(lists, pa.list_(pa.int64()))], names=["rid", "h"])
    (row,) = _shards(iter([b]))
    return _open(items, *[row.column(k).values.to_numpy() for k in range(1, 5)])[:2]


def lookup(it: Items, flat: np.ndarray, owner: np.ndarray, order: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Unique (document index, item index) pairs that share a run of ``least`` terms."""
    m, term = it.least, it.seq[it.anchors]
    begin, size = np.cumsum(have) - have, have[term]
    out = [np.empty((0, 2), np.int64)]
    for part in np.split(np.arange(len(term)), np.flatnonzero(np.diff(np.cumsum(size) // CANDIDATES)) + 1):
        k = size[part]
        a = np.repeat(part, k)  # each posting of the anchor's term
        pos = order[np.repeat(begin[term[part]] - (np.cumsum(k) - k), k) + np.arange(len(a))]
        at = it.anchors[a]
        run = np.ones(len(a), np.int64)
        for step in (-1, 1):
            alive = np.arange(len(a))
            for x in range(1, m):
                alive = alive[flat[pos[alive] + step * x] == it.seq[at[alive] + step * x]]
                if not len(alive):
                    break
                run[alive] += 1
        hit = run >= m
        out.append(np.stack([owner[pos[hit]], it.item[at[hit]]], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def _items(items: DataFrame, item_id: str, item_text: str, least: int) -> Items:
    w = items.select(F.col(item_id), word_string(item_text).alias("w")).filter("w is not null and w <> ''").select(item_id, _hashes(F.col("w")))
    return Items(sorted(((r[0], r[1]) for r in w.collect()), key=lambda r: r[0]), least)


def _blocks(items: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    """The test items in blocks of about BLOCK_CHARS, all rows of one id in one block."""
    size = items.agg(F.sum(F.length(item_text).cast("bigint"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    return [items.filter(F.pmod(F.xxhash64(item_id, F.lit("block")), F.lit(n)) == k) if n > 1 else items for k in range(max(1, n))]


def _search(index: DataFrame, block: DataFrame, item_id: str, item_text: str, least: int, schema: str, match) -> DataFrame:
    it = _items(block, item_id, item_text, least)
    it.rank(_frequencies(index, it.vocab) if len(it.vocab) else {})
    b = index.sparkSession.sparkContext.broadcast(it)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(b.value.ids or [0])
        for x in batches:
            for k in range(x.num_rows):
                docs, *shard = [x.column(c)[k].values.to_numpy() for c in range(5)]
                if len(b.value.starts):
                    yield pa.RecordBatch.from_pandas(match(b.value, docs, names, *_open(b.value, *shard)), preserve_index=False)

    return index.mapInArrow(run, schema)


def found(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 13) -> DataFrame:
    """``doc_id, item_id``: pairs that have at least ``least`` consecutive words in common, each once.

    Null and empty texts, and those with fewer words than that, match nothing. Rows repeated under one id
    give one pair each; an item's rows count as one item. Words are compared by 64-bit hashes, ``least`` of which in a
    row don't agree by chance.
    """
    index = build_index(docs, doc_id, text)

    def match(it, ids, names, *shard) -> pd.DataFrame:
        hits = lookup(it, *shard)
        return pd.DataFrame({doc_id: ids[hits[:, 0]], item_id: names[hits[:, 1]]})

    parts = [_search(index, b, item_id, item_text, least, f"{doc_id} bigint, {item_id} bigint", match) for b in _blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionAll, parts)


def leaked_items(pairs: DataFrame, items: DataFrame, item_id: str) -> DataFrame:
    """For every test item the number of documents that leak it."""
    n = pairs.groupBy(item_id).agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select(item_id).join(n, item_id, "left").select(item_id, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def proximity(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 13, within: int = 26) -> DataFrame:
    """``doc_id, item_id, n_terms``: documents in which a stretch of ``within`` words holds, in any order and with other
    words between, every distinct word of some stretch of ``least`` words of an item, wherever in the item that begins.
    One row per pair with the most distinct words found; rows repeated under one id give one row each.
    """
    index = build_index(docs, doc_id, text)

    def match(it, ids, names, flat, owner, order, have) -> pd.DataFrame:
        return _near(it, flat, owner, ids, names, within, order, have).rename(columns={"d": doc_id, "i": item_id})

    schema = f"{doc_id} bigint, {item_id} bigint, n_terms int"
    return reduce(DataFrame.unionAll, [_search(index, b, item_id, item_text, least, schema, match) for b in _blocks(items, item_id, item_text)])


def _near(it: Items, flat: np.ndarray, owner: np.ndarray, ids: np.ndarray, names: np.ndarray, within: int, order=None, df=None) -> pd.DataFrame:
    """Every window is looked up at all positions of its rarest term; positions are dropped term by term, rarest first."""
    m, n, far = it.least, len(flat), within - 1
    none = pd.DataFrame({"d": ids[:0], "i": names[:0], "n_terms": np.empty(0, np.int32)})
    if order is None:
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0) :]
        df = np.bincount(flat[order], minlength=len(it.vocab))
    occ = flat[order] * n + order  # sorted by term, then position
    lo = np.concatenate([[0], np.cumsum(df)])
    terms = it.seq[it.starts[:, None] + np.arange(m)] if len(it.starts) else np.empty((0, m), np.int64)
    live = (df[terms] > 0).all(axis=1)
    terms, item = terms[live], it.item[it.starts[live]]
    if not len(terms):
        return none
    ranked = np.sort(terms, axis=1)
    distinct = 1 + (ranked[:, 1:] != ranked[:, :-1]).sum(axis=1)
    terms = np.take_along_axis(terms, np.argsort(it.df[terms], axis=1, kind="stable"), axis=1)
    # The bounds of the document that a position lies in; the gaps between documents hold no term.
    first = np.searchsorted(owner, np.arange(owner[-1] + 1))
    last = np.searchsorted(owner, np.arange(owner[-1] + 1), side="right") - 1
    size = df[terms[:, 0]]
    found: list[np.ndarray] = []
    for part in np.split(np.arange(len(terms)), np.flatnonzero(np.diff(np.cumsum(size) // CANDIDATES)) + 1):
        w = np.repeat(part, size[part])
        skip = np.repeat(np.cumsum(size[part]) - size[part], size[part])
        pos = order[lo[terms[w, 0]] + np.arange(len(w)) - skip]
        for k in range(1, m):
            t, d = terms[w, k] * n, owner[pos]
            at = np.searchsorted(occ, t + np.maximum(pos - far, first[d]))
            ok = occ[np.minimum(at, len(occ) - 1)] <= t + np.minimum(pos + far, last[d])
            ok &= at < len(occ)
            w, pos = w[ok], pos[ok]
        # All terms lie within reach of the position; one stretch must hold them together.
        for x in range(0, len(w), 4096):
            v, q = w[x : x + 4096], pos[x : x + 4096]
            at = q[:, None] + np.arange(-far, far + 1)
            near = np.where((at >= first[owner[q]][:, None]) & (at <= last[owner[q]][:, None]), flat[np.clip(at, 0, n - 1)], -1)
            whole = np.ones((len(q), within), bool)
            for k in range(m):
                c = np.cumsum(near == terms[v, k][:, None], axis=1)
                c = np.concatenate([np.zeros((len(q), 1), c.dtype), c], axis=1)
                whole &= c[:, within:] > c[:, :-within]
            hit = whole.any(axis=1)
            found.append(np.stack([owner[q[hit]], item[v[hit]], distinct[v[hit]]], axis=1))
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if not len(rows):
        return none
    best = pd.DataFrame(rows, columns=["d", "i", "n_terms"]).groupby(["d", "i"], as_index=False)["n_terms"].max()
    return pd.DataFrame({"d": ids[best["d"]], "i": names[best["i"]], "n_terms": best["n_terms"].astype(np.int32)})
