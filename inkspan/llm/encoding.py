"""Problem 8: encoding of a corpus with a public tokenizer.

Overlapping chunk encoding: long texts are cut into overlapping chunks that are pre-tokenised in parallel;
neighbouring chunks are stitched at the first pre-token boundary both of them have in the overlap, and the
pieces are encoded. Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.session import materialize

DEFAULT_VOCABULARY = os.environ.get("INKSPAN_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of more characters than CHUNK are cut into chunks; those of more than SPREAD into chunks of different tasks.
CHUNK, OVERLAP, SPREAD = 1 << 10, 1 << 7, 1 << 18


@functools.lru_cache(4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(4)
def encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(chunk: str) -> list[int]:
    """Starts of the pre-tokens of a chunk, and its end."""
    return [m.start() for m in _pattern().finditer(chunk)] + [len(chunk)]


def stitch(parts: list[tuple[int, list[int], bool]]) -> list[int]:
    """Boundaries of a whole text from those of its chunks, in order: (offset, boundaries in the chunk, is last).

    The last pre-tokens of a cut chunk may depend on what follows, so a boundary counts only up to the one before
    the last pre-token that ends before the cut. From a common boundary on, the matches of both chunks are
    the same. If an overlap holds no common boundary (one pre-token longer than it), the gap is reported by
    raising ``LookupError``, and the caller pre-tokenises the text as a whole.
    """
    out: list[int] = [0]
    for k, (off, bs, last) in enumerate(parts):
        own = [off + b for b in bs]
        own = own if last else own[:-2]
        if k:
            here = set(own)
            meet = next((b for b in reversed(out) if b in here), None)
            if meet is None:
                raise LookupError("no common boundary")
            while out[-1] != meet:
                out.pop()
            own = [b for b in own if b > meet]
        else:
            own = own[1:]
        out += own
    return out


def cut_points(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Pre-token boundaries of a text from those of its overlapping chunks, stitched."""
    parts = [(o, boundaries(text[o : o + chunk + overlap]), o + chunk + overlap >= len(text)) for o in range(0, len(text), chunk)]
    parts = parts[: next(i for i, p in enumerate(parts) if p[2]) + 1]
    try:
        return stitch(parts)
    except LookupError:
        return boundaries(text)


def pieces(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """A text as pieces of about ``chunk`` characters that can be encoded each for itself.

    A piece ends at a stitched boundary behind a character that is no white space: only white space is pre-tokenised
    by what follows it.
    """
    if len(text) <= chunk:
        return [text]
    out, at = [], 0
    for c in cut_points(text, chunk, overlap):
        if c - at >= chunk and not text[c - 1].isspace():
            out.append(text[at:c])
            at = c
    return [*out, text[at:]] if at < len(text) else out


def encode_text(text: str | None, path: str = DEFAULT_VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of one text; null and empty texts have no ids. Chunks are stitched as in the distributed path."""
    enc = encoder(path)
    return [i for p in pieces(text, chunk, overlap) for i in enc.encode_ordinary(p)] if text else []


def decode(ids: list[int], path: str = DEFAULT_VOCABULARY) -> bytes:
    """The raw bytes of a list of ids."""
    return encoder(path).decode_bytes(list(ids))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT_VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """``id, ids`` for every row.

    Null and empty texts have the empty list; repeated rows give a result each; special tokens' strings are
    ordinary text. Texts of more than ``chunk`` characters are cut into overlapping chunks, pre-tokenised, stitched and
    encoded piece by piece where they are read, with no shuffle; those of more than ``spread`` have their
    chunks and pieces spread over tasks.
    """
    schema = "rid bigint, ids array<int>"

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            own = [pieces(x or "", chunk, overlap) for x in pdf["txt"]]
            ids = iter(enc.encode_ordinary_batch([p for ps in own for p in ps], num_threads=1))
            yield pd.DataFrame({"rid": pdf["rid"], "ids": [next(ids) if len(ps) == 1 else [i for _ in ps for i in next(ids)] for ps in own]})

    t = df.select(F.col(id_col).alias("rid"), F.col(text_col).alias("txt"))
    n = F.coalesce(F.length("txt"), F.lit(0))
    a = t.filter(n <= spread).mapInPandas(short, schema)
    return a.unionByName(_encode_long(t.filter(n > spread), path, spread, max(overlap, spread >> 6))).withColumnRenamed("rid", id_col)


def _encode_long(t: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Chunk rows -> boundaries per chunk, in parallel -> stitched pieces -> ids, in parallel -> one list per text."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bs = [boundaries(x) for x in pdf["part"]]
            ends = [[b for b in own if b and not x[b - 1].isspace()] for own, x in zip(bs, pdf["part"], strict=True)]
            yield pd.DataFrame({"uid": pdf["uid"], "rid": pdf["rid"], "o": pdf["o"], "last": pdf["last"], "bs": bs, "ends": ends})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        marks = [0]
        try:
            cuts = stitch([(int(o), list(b), bool(x)) for o, b, x in zip(pdf["o"], pdf["bs"], pdf["last"], strict=True)])
            free = {int(o) + int(b) for o, own in zip(pdf["o"], pdf["ends"], strict=True) for b in own}
            for c in cuts[:-1]:
                if c - marks[-1] >= chunk and c in free:
                    marks.append(c)
        except LookupError:
            pass  # one piece: the whole text
        m = len(marks)
        return pd.DataFrame({"uid": [pdf["uid"].iloc[0]] * m, "rid": [pdf["rid"].iloc[0]] * m, "k": range(m), "a": marks, "z": [*marks[1:], -1]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            yield pd.DataFrame({"uid": pdf["uid"], "rid": pdf["rid"], "k": pdf["k"], "ids": enc.encode_ordinary_batch(list(pdf["part"]), num_threads=1)})

    t = materialize(t.withColumn("uid", F.monotonically_increasing_id()), "p8-long")
    n = F.length("txt")
    offs = t.select("uid", "rid", "txt", F.explode(F.sequence(F.lit(0), n - 1, F.lit(chunk))).alias("o"))
    rows = offs.filter((F.col("o") == 0) | (F.col("o") + overlap < n)).select(
        "uid", "rid", "o", (F.col("o") + chunk + overlap >= n).alias("last"), F.substring("txt", F.col("o") + 1, F.lit(chunk + overlap)).alias("part"))
    cuts = rows.repartition("uid", "o").mapInPandas(cut, "uid bigint, rid bigint, o int, last boolean, bs array<int>, ends array<int>")
    pieces = cuts.groupBy("uid").applyInPandas(join, "uid bigint, rid bigint, k int, a int, z int")
    parts = pieces.join(t.select("uid", "txt"), "uid").withColumn("z", F.when(F.col("z") < 0, F.length("txt")).otherwise(F.col("z")))
    parts = parts.select("uid", "rid", "k", F.substring("txt", F.col("a") + 1, F.col("z") - F.col("a")).alias("part"))
    enc = parts.repartition("uid", "k").mapInPandas(encode, "uid bigint, rid bigint, k int, ids array<int>")
    return enc.groupBy("uid", "rid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("x")).select("rid", F.flatten(F.transform("x", lambda s: s["ids"])).alias("ids"))
