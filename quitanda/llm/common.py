"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MUL = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of a string column, None for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on the whole value."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


# Words are hashed all at once: with a number T[b] per byte and powers of an odd base, the sum of
# T[b] * base ** place over a stretch of text is a difference of two running sums, whatever the stretch.
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWERED = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)])
_CHUNK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, _CHUNK), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.multiply.accumulate(known)
    return known[:n]


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the stretches ``data[first:end]``, none of them empty; with ``lower``, A-Z count as a-z."""
    if not len(first):
        return np.zeros(0, np.uint64)
    upto = np.cumsum((_BYTE[_LOWERED] if lower else _BYTE)[data] * _power(_BASE, len(data)))
    last = end - 1
    under = np.where(first > 0, upto[first - 1], np.uint64(0))
    return mix((upto[last] - under) * _power(_INVERSE, len(data))[first] + (last - first).astype(np.uint64) * _MUL)


def _hash_chunk(data: np.ndarray, bounds: np.ndarray, lower: bool) -> list[np.ndarray]:
    n = len(data)
    if not n:
        return [np.zeros(0, np.uint64)] * (len(bounds) - 1)
    word = ~_SPACE[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner], after[inner - 1] = False, False
    first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    hashes = span_hashes(data, first, last + 1, lower)
    cut = np.searchsorted(first, bounds)
    return [hashes[a:b] for a, b in zip(cut, cut[1:])]


def word_hashes(column: pa.Array, lower: bool) -> list[np.ndarray]:
    """Per text the 64-bit hashes of its words, maximal runs without ASCII white space; null has none.

    With ``lower``, A-Z count as a-z. Texts are taken together up to a chunk size; a longer text is a
    chunk of its own.
    """
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else [0]
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out: list[np.ndarray] = []
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _CHUNK, "right")) - 1)
        out += _hash_chunk(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], lower)
        lo = hi
        if len(_powers.get(_BASE, ())) > 16 * _CHUNK:
            _powers.clear()  # after an uncommonly long text
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    hashes = np.sort(hashes)
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]] if len(hashes) else hashes


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per window of ``k`` words; a shorter text is one window, no words give none."""
    if not len(words):
        return words
    size = min(k, len(words))
    h = words[:len(words) - size + 1].copy()
    for i in range(1, size):
        h = h * _MUL + words[i:len(words) - size + 1 + i]
    return mix(h + np.uint64(size))


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; the check that comes before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` when it is measured to be small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if small_enough(df, rows) else df


def filesystem(uri: str):
    """(file system, path) that a task can open for a folder every executor shares."""
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def spread(df: DataFrame, seed: int = 7) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions, whatever file they came from."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
