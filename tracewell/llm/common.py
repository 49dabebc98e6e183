"""What the operators of this folder share: tables, written tables, words of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import settled as written
from ..sources.tables import table

__all__ = ["table", "written"]

#: Bytes of text that a Python worker takes at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 18
#: Bytes of a batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow over batches of few megabytes, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def schema_of(df: DataFrame, keep, more: str) -> StructType:
    """The schema of the kept columns of df and further ones, as DDL."""
    return StructType([*df.select(*keep).schema.fields, *StructType.fromDDL(more).fields])


def with_columns_of(df: DataFrame, *need: tuple[str, str]) -> DataFrame:
    """Exactly the columns asked for, cast; a missing one is null.  Other columns are left behind."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in need])


def text_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows in them; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of rows of about `most` bytes, whole rows each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# -- words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the text with A-Z lower-cased, found on bytes ----------------------

_MIX = np.random.default_rng(0x5EED)
_BYTE = _MIX.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BYTE_LOW = _BYTE[_LOWER]
_WORD_LOW = _WORD[_LOWER]
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        n = max(n, CHUNK_BYTES + 4096)
        for k, b in (("p", _BASE), ("q", _BASE_INV)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            _POW[k] = np.cumprod(x)
    return _POW["p"], _POW["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(raw: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values[byte] * base^i before each place, and the inverse powers: hash(s, e) = (P[e]-P[s]) * Q[s]."""
    p, q = _powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * p[: len(raw)], out=out[1:])
    return out, q


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the rows raw[off[i]:off[i+1]], in order; a word never crosses rows."""
    if len(raw) > 4 * CHUNK_BYTES and len(off) == 2:  # one very long text: in pieces that end between words
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + CHUNK_BYTES)
            while end < len(raw) and _WORD_LOW[raw[end]]:
                end += 1
            h, s, e = words_of(raw[at:end], np.array([0, end - at, end - at]))
            parts.append((h, s + at, e + at))
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts))
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    w = _WORD_LOW[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = w[cut]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cut - 1] = w[cut - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = prefix_hash(raw, _BYTE_LOW)
    return mix64((p[e] - p[s]) * q[s]), s, e


def shingles_of(h: np.ndarray, ws: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first words and lengths of all runs of k words, and the first shingle of each row (with end).

    ws holds each row's first word (with end).
    A row of fewer words, but not none, has one shingle, of all its words.
    """
    n = np.diff(ws)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    first = np.concatenate([[0], np.cumsum(count)])
    if not first[-1]:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, first
    at = np.repeat(ws[:-1] - first[:-1], count) + np.arange(first[-1])
    length = np.repeat(np.minimum(n, k), count)
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    for j in range(k):
        use = length > j
        if use.all():
            out = (out ^ h[at + j]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        else:
            x = (out[use] ^ h[at[use] + j]) * np.uint64(0xD6E8FEB86659FD93)
            out[use] = x ^ (x >> np.uint64(32))
    return mix64(out), at, length, first
