"""Exact top-k inner-product search by aggregation without random access.

Vectors are packed into blocks; a block holds, for each component, its rows in order of
that component, the sorted list.  A query reads each list from the end that its own sign
prefers.  After each round of sequential reads every row has a lower bound (what was
read, plus the least that the unread lists can give) and an upper bound (what was read,
plus the value that each unread list stands at).  Rows whose upper bound is below the
k-th best lower bound are outsiders and leave; reading stops when no outsider can still
qualify, and the final scores of those that remain are resolved.  All bounds are sums of
integers in doubles, exact below 2**53; blocks whose scores could reach that are not bounded
but resolved at once, in Python's integers, and scores saturate at the ends of the long range.

The query set (every hundredth row) grows with the table, so neither side is broadcast:
packed query blocks meet packed candidate blocks on a grid of (query block, lane) keys,
and only k rows per query and cell go on to the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm import vectors

BLOCK_ROWS = 4096
QUERY_ROWS = 2048
LANE_ROWS = 1 << 14
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2)
_MOST = float(np.finfo(np.float64).max)


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<double>): integer components floor(scale * x).

    Vectors that are null or hold a null or non-finite component take no part, nor do empty
    ones; a null id takes no part.  Repeated ids stay separate candidates.  Components beyond
    the greatest double are that.
    """
    good = vectors.sound("embedding") & F.col("vec_id").isNotNull()

    def whole(x: Column) -> Column:  # at 2**53 and beyond a double is an integer
        y = x.cast("double") * scale
        y = F.least(F.greatest(y, F.lit(-_MOST)), F.lit(_MOST))
        return F.when(F.abs(y) >= vectors.EXACT, y).otherwise(F.floor(y).cast("double"))

    v = F.transform("embedding", whole)
    return embeddings.where(good).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))


def _packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows packed as (dim, ids, matrix) blocks, within their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            got = held.pop(dim)
            ids, x = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], names=["dim", "n", "ids", "x"])

        for batch in batches:
            v = batch.column("v")
            sizes, flat = np.diff(v.offsets.to_numpy()), v.flatten().to_numpy(zero_copy_only=False)
            ids, at = batch.column("vec_id").to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
            for dim in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == dim)
                x = flat[(at[pick][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                for a in range(0, len(pick), rows):
                    held.setdefault(dim, []).append((ids[pick[a : a + rows]].astype(np.int64), x[a : a + rows]))
                    if sum(len(g[0]) for g in held[dim]) >= rows:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return vectors.mapInArrow(run, "dim int, n int, ids binary, x binary")


def aggregate_lists(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """The k best rows of a block for each query, by bounded sequential reads.

    ``own``: each query's id, which is no candidate of its own.  ``floor``: k-th best scores
    that earlier blocks have reached.  Also returned: how many (query, row) pairs were resolved.

    A round reads every list on to the next of ``DEPTHS``.  What is read of a row counts as it
    is; an unread value lies between the value that its list stands at and the list's end.
    A query stops when it has no outsider left, that is at most k rows that can still qualify;
    rows that no query needs any more leave the block.
    """
    n = len(x)
    listed = np.sort(x, axis=0)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = ids[None, :] != own[:, None]
    reach = floor.copy()
    for share in DEPTHS if n > 4 * k else ():
        depth = max(1, int(share * n))
        asking, rows = np.flatnonzero(alive.sum(axis=1) > k), np.flatnonzero(alive.any(axis=0))
        if not len(asking) or len(rows) <= k:
            break
        rows = np.flatnonzero(alive[asking].any(axis=0))
        some, high, low = x[rows], listed[n - depth], listed[depth - 1]  # where the lists stand, read from above and from below
        a, b = up[asking], down[asking]
        upper = a @ np.maximum(some, high).T + b @ np.minimum(some, low).T
        lower = a @ np.where(some >= high, some, listed[0]).T + b @ np.where(some <= low, some, listed[-1]).T
        here = alive[np.ix_(asking, rows)]
        lower[~here] = -np.inf
        if len(rows) > k:
            reach[asking] = np.maximum(reach[asking], np.partition(lower, len(rows) - k, axis=1)[:, len(rows) - k])
        alive[np.ix_(asking, rows)] = here & (upper >= reach[asking, None])
    out, resolved = [], 0
    for q in range(len(queries)):
        rows = np.flatnonzero(alive[q])
        resolved += len(rows)
        scores = x[rows] @ queries[q]
        best = vectors.first_by_score(scores.astype(np.int64), ids[rows], k)
        out.append((rows[best], scores[best].astype(np.int64)))
    return out, resolved


def resolved_at_once(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same without bounds, for scores that doubles don't hold."""
    out = []
    for scores, mine in zip(vectors.products(queries, x), own, strict=True):
        rows = np.flatnonzero(ids != mine)
        best = vectors.first_by_score(scores[rows], ids[rows], k)
        out.append((rows[best], scores[rows][best]))
    return out


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest inner products.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows of other
    ids with as many components.  Ties go to the smaller id.  Rows that repeat a query's id
    share its one list; repeated candidates stay apart.  Scores beyond a long are its ends.  Extra columns are ignored; an empty
    table gives no rows.
    """
    v = quantised(embeddings, scale)
    n = v.count()
    lanes = max(1, -(-n // LANE_ROWS))
    groups = max(1, -(-n // every // QUERY_ROWS))
    cand = _packed(v, BLOCK_ROWS).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    cand = cand.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = v.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    asked = asked.repartition(groups, "grp")
    asked = _packed(asked.select("vec_id", "v"), QUERY_ROWS).withColumn("grp", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        for dim, qs in q.groupby("dim"):
            qx = np.concatenate([np.frombuffer(b).reshape(-1, dim) for b in qs.x])
            qid = np.concatenate([np.frombuffer(b, np.int64) for b in qs.ids])
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in qid]
            floor = np.full(len(qid), -np.inf)
            for row in c[c.dim == dim].itertuples():
                x, ids = np.frombuffer(row.x).reshape(-1, dim), np.frombuffer(row.ids, np.int64)
                huge = dim * np.abs(x).max(initial=0) * np.abs(qx).max(initial=0) >= vectors.EXACT
                for a in range(0, len(qid), 256):
                    if huge:
                        got = resolved_at_once(x, ids, qx[a : a + 256], qid[a : a + 256], k)
                    else:
                        got, _ = aggregate_lists(x, ids, qx[a : a + 256], qid[a : a + 256], k, floor[a : a + 256])
                    for j, (rows, scores) in enumerate(got, a):
                        i, s = np.r_[held[j][0], ids[rows]], np.r_[held[j][1], scores]
                        best = vectors.first_by_score(s, i, k)
                        held[j] = (i[best], s[best])
                        if len(best) == k:
                            floor[j] = np.nextafter(float(s[best[-1]]), -np.inf)
            found += [pd.DataFrame({"query_id": qid[j], "vec_id": i, "score": s}) for j, (i, s) in enumerate(held) if len(i)]
        return pd.concat(found) if found else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})

    best = cand.groupBy("grp", "lane").cogroup(asked.groupBy("grp", "lane")).applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
