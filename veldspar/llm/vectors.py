"""Vectors of embedding tables: which take part, Arrow batches as matrices, exact integer products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

GREATEST = np.iinfo(np.int64).max
EXACT = 2.0**53  # sums of integers below this are exact in doubles


def sound(column: str) -> Column:
    """Neither null nor empty, and no component null or non-finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(column) > 0) & ~bad, F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows as doubles) of the vectors of each length in a list column without nulls."""
    at = column.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(at), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = at - at[0] if len(at) else at
    for dim in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == dim)
        yield pick, flat[(at[pick][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)


def listed(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, dim = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(rows.ravel()))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), at most the greatest double."""
    most = np.finfo(np.float64).max
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -most, most)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs (rows of q by rows of x), saturated at the ends of the range.

    Rows whose products fit doubles exactly go through one matrix product; the others, with huge
    components, through Python's integers.
    """
    big_q, big_x = np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)
    dim = max(1, q.shape[1])
    common = np.sqrt(EXACT / dim)
    wide_q, wide_x = big_q >= common, big_x >= common
    if not wide_q.any() and not wide_x.any():
        return (q @ x.T).astype(np.int64)
    out = np.empty((len(q), len(x)), np.int64)
    for side in (False, True):
        rows = np.flatnonzero(wide_q == side)
        cols = np.flatnonzero(~wide_x) if not side else np.arange(len(x))
        if not side:
            out[np.ix_(rows, cols)] = (q[rows] @ x[cols].T).astype(np.int64)
            cols = np.flatnonzero(wide_x)
        if len(rows) and len(cols):
            a = np.array([[int(v) for v in r] for r in q[rows]], object)
            b = np.array([[int(v) for v in r] for r in x[cols]], object)
            exact = a.dot(b.T)
            out[np.ix_(rows, cols)] = np.minimum(np.maximum(exact, -GREATEST - 1), GREATEST).astype(np.int64)
    return out


def first_by_score(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score (descending), then id (ascending)."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:  # only what reaches the k-th score is sorted
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]
