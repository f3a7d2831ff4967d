"""Vectorised word splitting over Arrow string columns.

A word is a maximal run of digits, ASCII letters (A-Z lower-cased) and non-ASCII
characters.  In UTF-8 that is a property of single bytes, so whole batches are split
with numpy and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTE = np.arange(256)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTE >= 128)
_BASE = 0x9E3779B97F4A7C15
_power = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of an odd base modulo 2**64."""
    global _power
    if len(_power) < n:
        grown = np.full(max(n, 256), _BASE, np.uint64)
        grown[0] = 1
        _power = np.cumprod(grown)
    return _power[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and offsets (one more than rows); null is empty."""
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each; a longer text is alone in its slice."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """Words of several texts: a hash, the row and the byte span (in the column's bytes) of each."""

    hashes: np.ndarray
    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row the index of its first word; one more than rows
    data: np.ndarray
    offsets: np.ndarray


def split(column: pa.Array) -> Words:
    data, offsets = utf8(column)
    inside = IS_WORD[data]
    place = np.flatnonzero(inside)
    n = len(offsets) - 1
    if not len(place):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, none, np.zeros(n + 1, np.int64), data, offsets)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    opens = np.empty(len(place), bool)
    opens[0] = True
    np.not_equal(place[1:], place[:-1] + 1, out=opens[1:])
    opens |= edge[place]
    head = np.flatnonzero(opens)
    sizes = np.diff(head, append=len(place))
    at = np.arange(len(place)) - np.repeat(head, sizes)
    value = (LOWER[data[place]].astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[at]
    hashes = mix(np.add.reduceat(value, head) + sizes.astype(np.uint64))
    begin = place[head]
    first = np.searchsorted(begin, offsets)
    rows = np.repeat(np.arange(n), np.diff(first))
    return Words(hashes, rows, begin, begin + sizes, first, data, offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` consecutive word hashes (order-sensitive)."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + hashes[i : len(hashes) - k + 1 + i]
    return mix(out)


def set_aside(documents: DataFrame, keep: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``documents`` with all other columns renamed, so that an operator's own columns clash with
    none, and the columns that restore them."""
    names = {c: c if c in keep else f"u{i}" for i, c in enumerate(documents.columns)}
    held = documents.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return held, [F.col(n).alias(c) for c, n in names.items()]
