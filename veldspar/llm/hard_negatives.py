"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join.

The greatest inner products are the nearest neighbours once norms are levelled: with M the
greatest norm, a row s gets one more component sqrt(M^2 - |s|^2) and an anchor q a 0, and then
|q - s|^2 = |q|^2 + M^2 - 2 q.s.  In that space

1. ``PIVOTS`` rows at most, drawn by a hash, are pivots; every row and every anchor belongs to
   the cell of its nearest pivot.  Cells of few anchors that lie near each other are one group,
   cells of many are several, so a group has about ``ANCHORS`` of them.
2. Anchors of cell i lie between L and U from its pivot.  A row at distance d from that pivot
   is at least max(d - U, L - d) and at most d + U from each.  It is copied to the group only
   if an anchor there may need it: for positives, if the least distance is within U plus the
   k-th distance of the cell's own rows of that label, which bounds the k-th neighbour; for
   negatives, if the range of distances meets that of the scores wanted.
3. Each group's rows are dealt into lanes, and a lane joins its anchors exactly in integers.
   The first k of all lanes are the answer.

Bounds are doubles with a slack; rows and anchors for which they cannot be trusted (huge
components, lengths without a pivot) are copied everywhere, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.llm import vectors
from veldspar.session import written

PIVOTS = 256
CELL_ROWS = 4096
ANCHORS = 4096
LANE_ROWS = 1 << 15
BATCH = 4096
SLACK = 1e-6
HUGE = 2.0**40


@dataclass
class Space:
    """Pivots by length of vector, as (first cell, rows with their levelled component), and M^2."""

    pivots: dict[int, tuple[int, np.ndarray]]
    cells: int
    most: float

    def distances(self, x: np.ndarray, anchors: bool) -> tuple[int, np.ndarray] | None:
        """(first cell, distance of each row to each pivot of its length)."""
        held = self.pivots.get(x.shape[1])
        if held is None:
            return None
        first, p = held
        n2 = (x * x).sum(axis=1)
        dot, own = x @ p[:, :-1].T, n2
        if not anchors:
            dot, own = dot + np.sqrt(np.maximum(self.most - n2, 0))[:, None] * p[:, -1], np.full(len(x), self.most)
        return first, np.sqrt(np.maximum(own[:, None] + self.most - 2 * dot, 0))


def prepared(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v, n2) of the rows that take part; v are integers as doubles, n2 is -1 where they are huge."""
    keep = vectors.sound("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    rows = embeddings.where(keep).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in vectors.matrices(batch.column("v")):
                w = vectors.whole(x, scale)
                n2 = np.full(len(w), -1.0)
                fits = np.abs(w).max(axis=1) < HUGE
                n2[fits] = (w[fits] ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), vectors.listed(w), pa.array(n2)], names=["vec_id", "label", "v", "n2"])

    return written(rows.mapInArrow(run, "vec_id bigint, label bigint, v array<double>, n2 double"), "negatives-rows")


def space_of(rows: DataFrame, most_pivots: int = PIVOTS, cell_rows: int = CELL_ROWS) -> Space:
    """Pivots from the rows of least hash: at most ``most_pivots`` rows come to the driver."""
    seen = rows.agg(F.count("*").alias("n"), F.max("n2").alias("m")).first()
    wanted = max(1, min(most_pivots, seen.n // cell_rows))
    drawn = rows.where("n2 >= 0").orderBy(F.xxhash64("vec_id", F.lit("pivot")), "vec_id").limit(wanted).select("v").collect()
    by: dict[int, list] = {}
    for r in drawn:
        by.setdefault(len(r.v), []).append(r.v)
    most, pivots, first = max(seen.m or 0.0, 0.0), {}, 0
    for dim, held in by.items():
        x = np.unique(np.array(held, float), axis=0)
        pivots[dim] = (first, np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))])
        first += len(x)
    return Space(pivots, first, most)


def _celled(rows: DataFrame, space: Space, anchors: bool) -> DataFrame:
    """``rows`` with ``cell`` (the nearest pivot's, -1 without one) and ``d``, the distance to it."""
    names = ["vec_id", "label", "v", "n2", *(["aid"] if anchors else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n2 = batch.column("n2").to_numpy(zero_copy_only=False)
            cell, d = np.full(batch.num_rows, -1, np.int32), np.full(batch.num_rows, np.inf)
            for at, x in vectors.matrices(batch.column("v")):
                fits = n2[at] >= 0
                got = space.distances(x[fits], anchors)
                if got is not None and fits.any():
                    near = got[1].argmin(axis=1)
                    cell[at[fits]], d[at[fits]] = got[0] + near, got[1][np.arange(len(near)), near]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(cell), pa.array(d)], names=[*names, "cell", "d"])

    kinds = dict(rows.dtypes)
    return rows.select(*names).mapInArrow(run, ", ".join([*(f"{n} {kinds[n]}" for n in names), "cell int", "d double"]))


def groups(counts: dict[int, int], space: Space, size: int = ANCHORS) -> dict[int, tuple[int, int]]:
    """{cell: (first group, how many)}: near cells of few anchors share one, a cell of
    many has several.  There are at most ``PIVOTS`` cells, which are walked from each to the
    nearest that is left."""
    left = {c for c, n in counts.items() if n}
    order: list[int] = []
    for first, p in space.pivots.values():
        mine = [c for c in left if first <= c < first + len(p)]
        while mine:
            last = order[-1] - first if order and first <= order[-1] < first + len(p) else mine[0] - first
            mine.sort(key=lambda c: ((p[c - first] - p[last]) ** 2).sum())
            order.append(mine.pop(0))
    order += sorted(left - set(order))
    dealt, n, held = {}, 0, 0
    for c in order:
        if counts[c] > size:
            n, held = n + (held > 0), 0
            dealt[c] = (n, -(-counts[c] // size))
            n += dealt[c][1]
            continue
        if held + counts[c] > size:
            n, held = n + 1, 0
        dealt[c] = (n, 1)
        held += counts[c]
    return dealt or {-1: (0, 1)}


Needed = Callable[[pa.RecordBatch, np.ndarray, np.ndarray | None, int], np.ndarray]
Each = Callable[[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, dict], None]


def _copied(rows: DataFrame, space: Space, dealt: dict[int, tuple[int, int]], lanes: int, needed: Needed) -> DataFrame:
    """Packed blocks (grp, lane, dim, ids, labels, x) of the rows that each group may need.

    ``needed(batch, places, distances, first)`` says which rows (by place) which cells need, as
    a matrix of rows and the cells in ``dealt``; distances are null where there are no bounds.
    """
    cells = sorted(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() * 7919
        for big in batches:
            for start in range(0, big.num_rows, BATCH):
                batch = big.slice(start, BATCH)
                ids, labels, n2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "n2"))
                out: list[tuple] = []
                for at, x in vectors.matrices(batch.column("v")):
                    for fits in (True, False):
                        pick = np.flatnonzero((n2[at] >= 0) == fits)
                        if not len(pick):
                            continue
                        got = space.distances(x[pick], False) if fits else None
                        asked = needed(batch, at[pick], None if got is None else got[1], 0 if got is None else got[0])
                        to: dict[int, np.ndarray] = {}
                        for j, c in enumerate(cells):
                            for g in range(dealt[c][0], sum(dealt[c])):
                                to[g] = to[g] | asked[:, j] if g in to else asked[:, j]
                        for g, which in to.items():
                            if which.any():
                                some = pick[which]
                                turn += 1
                                out.append((g, turn % lanes, x.shape[1], ids[at[some]].tobytes(), labels[at[some]].tobytes(), x[some].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["grp", "lane", "dim", "ids", "labels", "x"])

    return rows.mapInArrow(run, "grp int, lane int, dim int, ids binary, labels binary, x binary")


def _grouped(anchors: DataFrame, dealt: dict[int, tuple[int, int]], lanes: int) -> DataFrame:
    """Anchors with their ``grp``, in every lane."""
    first, many = (F.create_map(*(F.lit(int(v)) for c, (a, n) in dealt.items() for v in (c, (a, n)[i])))[F.col("cell")] for i in (0, 1))
    out = anchors.withColumn("grp", (first + F.pmod(F.xxhash64("aid"), many)).cast("int"))
    return out.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))


def _joined(copies: DataFrame, anchors: DataFrame, each: Each, names: list[str]) -> DataFrame:
    """The exact join within each (group, lane): ``each`` takes a block's exact products with the
    anchors of its length, and keeps the first ids and scores of its keys."""

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        kept: dict = {}
        dims = q.v.map(len).to_numpy()
        for row in c.itertuples():
            some = q[dims == row.dim]
            x, ids, labels = np.frombuffer(row.x).reshape(-1, row.dim), np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
            for a in range(0, len(some), 512):
                asked = some.iloc[a : a + 512]
                each(asked, vectors.products(np.stack(asked.v.to_list()), x), ids, labels, kept)
        keys = np.array([key for key, (i, _) in kept.items() for _ in i], np.int64).reshape(-1, len(names) - 2)
        ids, scores = (np.concatenate([np.zeros(0, np.int64), *(held[i] for held in kept.values())]) for i in (0, 1))
        return pd.DataFrame(dict(zip(names, [*keys.T, ids, scores], strict=True)))

    return copies.groupBy("grp", "lane").cogroup(anchors.groupBy("grp", "lane")).applyInPandas(cell, ", ".join(f"{n} bigint" for n in names))


def _more(kept: dict, key: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """The k first of a key so far and of a block."""
    if key in kept:
        ids, scores = np.r_[kept[key][0], ids], np.r_[kept[key][1], scores]
    best = vectors.first_by_score(scores, ids, k)
    kept[key] = ids[best], scores[best]


def positives(rows: DataFrame, anchors: DataFrame, space: Space, dealt: dict[int, tuple[int, int]], ranges: dict[int, tuple[float, float]], lanes: int, k: int) -> DataFrame:
    """(aid, positive_id, score): each anchor's k first other rows of its label."""
    home = rows.where("cell >= 0 and not asked").select("label", "cell", "d")
    nearest = home.withColumn("n", F.row_number().over(Window.partitionBy("label", "cell").orderBy("d"))).where(F.col("n") <= k)
    reach = nearest.groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("d").alias("kth")).where(F.col("n") == k).drop("n")
    here = anchors.select("label", "cell").distinct().join(reach, ["label", "cell"], "left")
    wanted = written(here.groupBy("label").agg(F.collect_list(F.struct("cell", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))).alias("reach")), "negatives-reach")  # a cell each
    cells = {c: j for j, c in enumerate(sorted(dealt))}

    def needed(batch: pa.RecordBatch, at: np.ndarray, d: np.ndarray | None, first: int) -> np.ndarray:
        out = np.zeros((len(at), len(cells)), bool)
        told = batch.column("reach").take(pa.array(at))
        own, flat = np.repeat(np.arange(len(at)), pc.list_value_length(told).to_numpy()), told.flatten()
        cell, kth = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("cell", "kth"))
        far = np.full(len(cell), -np.inf)  # the least distance that the bounds allow
        reached = np.full(len(cell), np.inf)
        if d is not None:
            known = (cell >= first) & (cell < first + d.shape[1])
            low, high = (np.array([ranges[c][i] for c in cell[known]]) for i in (0, 1))
            mine = d[own[known], cell[known] - first]
            far[known], reached[known] = np.maximum(mine - high, low - mine), high + kth[known]
        out[own, [cells[c] for c in cell]] = far <= reached * (1 + SLACK) + SLACK
        return out

    def each(asked: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, kept: dict) -> None:
        for j, (aid, vec_id, label) in enumerate(zip(asked.aid, asked.vec_id, asked.label, strict=True)):
            same = np.flatnonzero((labels == label) & (ids != vec_id))
            if len(same):
                _more(kept, (aid,), ids[same], scores[j, same], k)

    copies = _copied(rows.drop("cell", "d", "asked").join(wanted, "label"), space, dealt, lanes, needed)
    asked = _grouped(anchors, dealt, lanes).select("grp", "lane", "aid", "vec_id", "label", "v")
    got = _joined(copies, asked, each, ["aid", "positive_id", "score"])
    return got.withColumn("n", F.row_number().over(Window.partitionBy("aid").orderBy(F.desc("score"), "positive_id"))).where(F.col("n") <= k)


def negatives(rows: DataFrame, anchors: DataFrame, space: Space, lanes: int, k: int) -> DataFrame:
    """(aid, n, negative_id, score): the k first rows of other labels whose score is from 80 to 100 % of each positive's.

    ``anchors`` has ``pos``, the positives' scores by their place n.
    """
    low, high = F.array_min("pos"), F.array_max("pos")
    away = lambda s: F.sqrt(F.greatest(F.col("n2") + space.most - 2 * s.cast("double"), F.lit(0.0)))
    stats = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), F.min(away(high)).alias("near"), F.max(away(low * 0.8)).alias("far")).collect()  # a row for each pivot at most
    dealt = groups({r.cell: r.n for r in stats}, space)
    bounds = {r.cell: (r.low, r.high, r.near, r.far) for r in stats}
    cells = sorted(dealt)

    def needed(batch: pa.RecordBatch, at: np.ndarray, d: np.ndarray | None, first: int) -> np.ndarray:
        out = np.ones((len(at), len(cells)), bool)
        for j, c in enumerate(cells):
            if d is not None and first <= c < first + d.shape[1]:
                low, high, near, far = bounds[c]
                mine = d[:, c - first]
                slack = SLACK * (1 + far + high)
                out[:, j] = (np.maximum(mine - high, low - mine) <= far + slack) & (mine + high >= near - slack)
        return out

    def each(asked: pd.DataFrame, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, kept: dict) -> None:
        for j, (aid, label, pos) in enumerate(zip(asked.aid, asked.label, asked.pos, strict=True)):
            least = [p - p // 5 for p in pos]  # 80 * p <= 100 * s, in whole numbers
            some = np.flatnonzero((scores[j] <= max(pos)) & (scores[j] >= min(least)) & (labels != label))
            if not len(some):
                continue
            s, i = scores[j, some], ids[some]
            for n, (p, low) in enumerate(zip(pos, least, strict=True), 1):
                fit = np.flatnonzero((s <= p) & (s >= low))
                if len(fit):
                    _more(kept, (aid, n), i[fit], s[fit], k)

    copies = _copied(rows.select("vec_id", "label", "v", "n2"), space, dealt, lanes, needed)
    asked = _grouped(anchors, dealt, lanes).select("grp", "lane", "aid", "vec_id", "label", "v", "pos")
    got = _joined(copies, asked, each, ["aid", "n", "negative_id", "score"])
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("aid", "n").orderBy(F.desc("score"), "negative_id"))).where(F.col("rank") <= k)


def mined(embeddings: DataFrame, n_positives: int = 5, n_negatives: int = 5, every: int = 100, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``, positives each anchor's first
    rows of its label and other ids, negatives each positive's first rows of other labels
    whose score is from 80 to 100 % of the positive's.  Scores are inner products of
    floor(``scale`` * x), saturated at the ends of the long range; ties go to the smaller id.
    Rows with a null id or label, and vectors that are null, empty or hold null or non-finite
    components, take no part; only vectors of one length meet.  Repeated rows are rows of their
    own, as positives and as negatives, but no anchor's own id is its positive; anchors that
    are equal in all of id, label and vector are one, others of one id are several.  Extra
    columns are ignored; an empty table gives no rows.
    """
    rows = prepared(embeddings, scale)
    space = space_of(rows)
    asked = F.pmod("vec_id", F.lit(every)) == 0
    anchors = written(rows.where(asked).distinct().withColumn("aid", F.monotonically_increasing_id()), "negatives-anchors")
    anchors = written(_celled(anchors, space, True), "negatives-anchors")
    rows = written(_celled(rows, space, False).withColumn("asked", asked), "negatives-cells")
    stats = anchors.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()  # a row for each pivot at most
    lanes = max(1, -(-rows.count() // LANE_ROWS))
    dealt, ranges = groups({r.cell: r.n for r in stats}, space), {r.cell: (r.low, r.high) for r in stats}
    first = written(positives(rows, anchors, space, dealt, ranges, lanes, n_positives), "negatives-positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("n", "score"))), lambda x: x["score"])  # ``n_positives`` of them
    hard = negatives(rows, anchors.join(first.groupBy("aid").agg(scores.alias("pos")), "aid"), space, lanes, n_negatives)
    told = first.select("aid", F.col("n").cast("bigint").alias("n"), "positive_id", F.col("score").alias("positive_score")).join(anchors.select("aid", F.col("vec_id").alias("anchor_id")), "aid")
    return hard.join(told, ["aid", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's rows: the label of each seventh id moves on by one of ten."""
    label = F.when(F.pmod(F.col("vec_id").cast("bigint"), F.lit(7)) == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return mined(embeddings.select("vec_id", label.alias("label"), "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id AS id, q.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
         id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
