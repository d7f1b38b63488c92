"""Problem 2: repetition inside a single document.

Every text gets the exact share of characters that lie in a sequence which also starts earlier. The zstandard
ratios of the whole reduced text and of fixed chunks, held against limits by length, only name its band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import reduced

#: (bytes below which the band holds, ratio at or under which a text is suspected of repetition). The limits
#: depend on script and length and decide nothing but the band; shares are computed whatever the ratio.
BANDS = ((200, 1.01), (400, 0.74), (800, 0.64), (1600, 0.60), (1 << 62, 0.58))
#: Ratios above this limit mark incompressible text (random strings, encoded data), from this many bytes on.
INCOMPRESSIBLE = (400, 0.80)
CHUNK = 4096
LENGTH = 24
#: Odd multipliers of the window hashes, one for each doubling.
MULTIPLIERS = tuple(np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def limit(n_bytes: int) -> float:
    return next(r for b, r in BANDS if n_bytes < b)


def repeated_share(text: str, length: int = LENGTH) -> float:
    """Share of the characters that lie in a ``length``-character sequence that also starts at an earlier position.

    Exact: equal windows have equal hashes, so a text without equal hashes repeats nothing; where hashes are equal
    the characters are compared, and ranks decide if any two differ.
    """
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a)
    if n <= length:
        return 0.0
    h = _hashes(a, length)
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0.0
    again, first = _again(h)
    if any((a[again + k] != a[first + k]).any() for k in range(length)):
        again, _ = _again(_ranks(a, length))
    edge = np.bincount(again, minlength=n + 1) - np.bincount(again + length, minlength=n + 1)
    return float(np.count_nonzero(np.cumsum(edge[:-1])) / n)


def _hashes(a: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each window, by doubling; windows of equal characters have equal hashes."""
    h, size, mult = a.astype(np.uint64) * MULTIPLIERS[0], 1, 1
    while size * 2 <= length:
        h = h[:-size] * MULTIPLIERS[mult] + h[size:]
        h ^= h >> np.uint64(29)
        size, mult = size * 2, mult + 1
    d = length - size  # two overlapping windows of `size` cover `length`
    return h[: len(h) - d] * MULTIPLIERS[mult] + h[d:] if d else h


def _ranks(a: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the windows by doubling: equal ranks mean equal characters. O(n log n)."""
    r, size = np.unique(a, return_inverse=True)[1].astype(np.int64), 1
    while size * 2 <= length:
        r = np.unique(r[:-size] * (len(a) + 1) + r[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    d = length - size
    return r[: len(r) - d] * (len(a) + 1) + r[d:] if d else r


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key also stands earlier, and the first position of each of these keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
    return order[~new], head[~new]


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zstandard

    def compressor(n: int):
        # The window must span the text, or repeats far apart would not be seen.
        log = max(10, min(31, n.bit_length() + 1))
        p = zstandard.ZstdCompressionParameters.from_level(3, window_log=log) if n > 1 << 20 else None
        return zstandard.ZstdCompressor(compression_params=p) if p else usual

    usual = zstandard.ZstdCompressor(level=3)
    for pdf in batches:
        out = []
        for x in pdf["red"]:
            if not x:
                out.append((None, None, None, None, "empty", None))
                continue
            b = x.encode("utf-8", "surrogatepass")
            n = len(b)
            whole = len(compressor(n).compress(b)) / n
            chunks = [whole]
            if n > CHUNK:
                chunks = [len(usual.compress(b[i : i + CHUNK])) / len(b[i : i + CHUNK]) for i in range(0, n, CHUNK)]
            low = min(chunks)
            suspect = whole <= limit(n) or any(r <= limit(min(n - i * CHUNK, CHUNK)) for i, r in enumerate(chunks))
            band = "repetitive" if suspect else "incompressible" if n >= INCOMPRESSIBLE[0] and whole > INCOMPRESSIBLE[1] else "ordinary"
            out.append((n, whole, low, max(chunks), band, repeated_share(x)))
        res = pd.DataFrame(out, columns=["n_bytes", "ratio", "chunk_min", "chunk_max", "band", "share"], index=pdf.index).astype({"n_bytes": "Int64"})
        yield pd.concat([pdf[["rid"]], res], axis=1)


def repetition(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: size, ratios, band and the exact share of repeated content.

    Null texts and texts without letters, marks and digits get the band 'empty' and NULL measures. Repeated
    rows give one result each.
    """
    t = df.select(F.col(id_col).alias("rid"), reduced(text_col).alias("red"))
    schema = "rid bigint, n_bytes bigint, ratio double, chunk_min double, chunk_max double, band string, share double"
    return t.mapInPandas(_measure, schema).withColumnRenamed("rid", id_col)


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"rid": pdf["rid"], "share": pd.array([repeated_share(x) if x else None for x in pdf["red"]], "Float64")})


def shares(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, share``: the exact share of repeated content of every row; NULL for null texts and those without letters, marks and digits."""
    t = df.select(F.col(id_col).alias("rid"), reduced(text_col).alias("red"))
    return t.mapInPandas(_shares, "rid bigint, share double").select(F.col("rid").alias(id_col), F.round("share", 9).alias("share"))


def found(df: DataFrame, id_col: str, text_col: str, share: float = 0.25) -> DataFrame:
    t = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("rid"), reduced(text_col).alias("red"))
    return t.mapInPandas(_shares, "rid bigint, share double").filter(F.col("share") >= share).select(F.col("rid").alias(id_col))
