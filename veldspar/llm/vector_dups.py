"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

1. Equal vectors are one node with a weight.
2. A bounded sample of nodes fits the index: at most ``LISTS`` coarse centroids, no two of them
   begun within the linking distance, and for the residuals to them ``PARTS`` subspaces of
   ``CODES`` codewords.  Every node is indexed: its home is the list of its nearest centroid,
   its code a byte for each subspace, and the error of its code is kept.
3. A node probes each other list whose border lies within a share of the linking distance.  At
   half of it the probes would suffice for any pair, as the borders of both cells lie between
   the two and either may probe; where components share the displacement evenly, its part
   along one direction is about 1 / sqrt(length) of it, so ``SURE`` times that suffices (and
   a ``sure`` of sqrt(length) or more loses nothing).
4. Nodes within half the linking angle of their centroid, the core of a list, are all linked
   with each other: they are counted, not compared, so a hot group of near copies costs no
   pairs.  Others are compared with a core only if their angle to the centroid allows it.
5. Asked members and asking nodes of a list meet in a grid of bounded cells.  Distances come
   from tables of an asking node's residual against the codewords, looked up by code; a code's
   own error bounds what they miss, so no pair of a cell is lost.  What may be near enough is
   reranked by cosine in double precision, beside the vectors in the cell.  A pair that could
   meet in two lists is compared in one.
6. A cell gives each node's number of links and one link to a member of its class there; links
   become components by alternating star steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm import vectors
from veldspar.llm.near_dups import components
from veldspar.session import written

COSINE = 0.95
LISTS = 1024
LIST_ROWS = 512
FIT_ROWS = 16384
FIT_BYTES = 1 << 26
PARTS = 8
CODES = 256
SURE = 4.0
ASKED = 4096
ASKING = 1 << 14
ROUNDS = 8
TINY = 1e-6


def units(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, by their greatest component first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Of each row the nearest centre."""
    return ((centres * centres).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def k_means(x: np.ndarray, centres: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's steps; a centre without rows stays."""
    for _ in range(rounds):
        at = nearest(x, centres)
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        centres = centres.copy()
        centres[own] = np.add.reduceat(x[order], first) / np.diff(first, append=len(x))[:, None]
    return centres


@dataclass
class Index:
    """Centroids and codewords for vectors of one length; others have no lists and are compared within their length."""

    dim: int
    centres: np.ndarray
    parts: list[tuple[int, int]]
    words: list[np.ndarray]
    cosine: float
    sure: float = SURE

    @property
    def apart(self) -> float:
        """The greatest distance of two linked unit vectors."""
        return math.sqrt(2 - 2 * self.cosine)

    def angle(self, u: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Angles of rows to the centroids of their lists; a centroid at the origin is at no angle."""
        c = self.centres[lists]
        norm = np.sqrt((c * c).sum(axis=-1))
        return np.where(norm > TINY, np.arccos(np.clip((u * c).sum(axis=-1) / np.maximum(norm, TINY), -1, 1)), np.pi)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors) of residuals."""
        codes, rest = np.zeros((len(residual), len(self.parts)), np.uint8), np.zeros(len(residual))
        for i, ((a, b), words) in enumerate(zip(self.parts, self.words, strict=True)):
            codes[:, i] = nearest(residual[:, a:b], words)
            rest += ((residual[:, a:b] - words[codes[:, i]]) ** 2).sum(axis=1)
        return codes, np.sqrt(rest)

    def looked_up(self, residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of asking residuals (rows) to coded ones (columns): a table for each subspace, added up by code."""
        out = np.zeros((len(residual), len(codes)))
        for i, ((a, b), words) in enumerate(zip(self.parts, self.words, strict=True)):
            r = residual[:, a:b]
            table = (r * r).sum(axis=1)[:, None] + (words * words).sum(axis=1) - 2 * r @ words.T
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))

    def probes(self, u: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which lists each row probes besides its home."""
        square = (self.centres**2).sum(axis=1)
        d2 = square - 2 * u @ self.centres.T
        between = np.sqrt(np.maximum(square[home][:, None] + square - 2 * self.centres[home] @ self.centres.T, 0))
        border = (d2 - d2[np.arange(len(u)), home][:, None]) / np.maximum(2 * between, TINY)
        out = border <= 0.5 * min(1.0, self.sure / math.sqrt(self.dim)) * self.apart + TINY
        out[np.arange(len(u)), home] = False
        return out


def fitted(nodes: DataFrame, cosine: float = COSINE, sure: float = SURE) -> Index | None:
    """The index from a sample of at most ``FIT_ROWS`` rows and ``FIT_BYTES`` on the driver, those of least hash."""
    drawn = nodes.orderBy(F.xxhash64("a", F.lit("fit")), "a", "b").limit(64).select(F.size("x").alias("n")).collect()
    if not drawn:
        return None
    dim = max({r.n for r in drawn}, key=lambda n: (sum(r.n == n for r in drawn), n))
    n = nodes.where(F.size("x") == dim).count()
    rows = max(CODES, min(FIT_ROWS, FIT_BYTES // (8 * dim)))
    x = nodes.where(F.size("x") == dim).orderBy(F.xxhash64("a", F.lit("fit")), "a", "b").limit(rows).select("x").collect()
    u = units(np.array([r.x for r in x], float))
    wanted = max(1, min(LISTS, n // LIST_ROWS))
    chosen = u[:1]
    for a in range(1, len(u), 256):
        if len(chosen) >= wanted:
            break
        some = u[a : a + 256]
        far = some[(some @ chosen.T).max(axis=1) < cosine]
        while len(far) and len(chosen) < wanted:  # one by one, as they may be near each other
            chosen, far = np.r_[chosen, far[:1]], far[1:]
            far = far[far @ chosen[-1] < cosine] if len(far) else far
    centres = k_means(u, chosen)
    edges = np.linspace(0, dim, min(PARTS, dim) + 1).astype(int)
    parts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    rest = u - centres[nearest(u, centres)]
    words = [k_means(rest[:, a:b], rest[: min(CODES, len(rest)), a:b]) for a, b in parts]
    return Index(dim, centres, parts, words, cosine, sure)


def _nodes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: row, vec_id, a, b; nodes: node, weight, least, a, b, x); rows that link with nothing have no a.

    Vectors of equal pairs of 64-bit hashes are equal.
    """
    wide = F.col("embedding") if dict(embeddings.dtypes)["embedding"] in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    some = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), wide.alias("x"))
    ok = vectors.sound("x") & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    rows = some.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.when(ok, F.xxhash64("x")).alias("a"), F.when(ok, F.xxhash64(F.lit("second"), "x")).alias("b"), F.when(ok, F.col("x")).alias("x"))
    rows = written(rows, "vectors-rows")
    nodes = rows.where("a is not null").groupBy("a", "b").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("least"), F.first("x").alias("x"))
    return rows.drop("x"), written(nodes, "vectors-nodes")


def indexed(nodes: DataFrame, index: Index) -> DataFrame:
    """Every node with ``home``, ``core``, ``angle`` to its centroid, ``probes`` and ``angles`` to theirs, ``codes`` and ``error``."""
    kind = dict(nodes.dtypes)["x"]
    half = math.acos(index.cosine) / 2 - TINY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                for at, x in vectors.matrices(batch.column("x")):
                    u, n = units(x), len(x)
                    if x.shape[1] == index.dim:
                        home = nearest(u, index.centres)
                        angle = index.angle(u, home)
                        asks = index.probes(u, home)
                        row, to = np.nonzero(asks)
                        codes, error = index.encode(u - index.centres[home])
                        angles, ends = index.angle(u[row], to), np.r_[0, np.cumsum(asks.sum(axis=1))]
                    else:
                        home, angle, to, angles, ends = np.full(n, -x.shape[1]), np.full(n, np.pi), np.zeros(0, int), np.zeros(0), np.zeros(n + 1, int)
                        codes, error = np.zeros((n, 0), np.uint8), np.full(n, np.inf)
                    ends, took = pa.array(ends.astype(np.int32)), pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(took), batch.column("weight").take(took), batch.column("x").take(took), pa.array(home.astype(np.int32)), pa.array(angle <= half), pa.array(angle)]
                        + [pa.ListArray.from_arrays(ends, pa.array(to.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(angles)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                        names=["node", "weight", "x", "home", "core", "angle", "probes", "angles", "codes", "error"],
                    )

    return nodes.select("node", "weight", "x").mapInArrow(run, f"node bigint, weight bigint, x {kind}, home int, core boolean, angle double, probes array<int>, angles array<double>, codes binary, error double")


def _asking(rows: DataFrame, reach: dict[int, float]) -> DataFrame:
    """``rows`` with ``keys``: what each node asks, 2 * list for the others of a list and 2 * list + 1 for its core.

    ``reach``: the greatest angle at which a list's core may have a link.
    """
    near = F.create_map(*(F.lit(v) for k, a in reach.items() for v in (k, a))) if reach else F.lit(None).cast("map<int,double>")
    within = lambda j, angle: F.coalesce(angle <= F.try_element_at(near, j), F.lit(False))
    visits = F.flatten(F.transform(F.arrays_zip("probes", "angles"), lambda p: F.when(within(p["probes"], p["angles"]), F.array(p["probes"] * 2, p["probes"] * 2 + 1)).otherwise(F.array(p["probes"] * 2))))
    own = F.when(F.col("core"), F.array().cast("array<int>")).when(within(F.col("home"), F.col("angle")), F.array(F.col("home") * 2, F.col("home") * 2 + 1)).otherwise(F.array(F.col("home") * 2))
    return rows.withColumn("keys", F.concat(own, visits))


def compared(index: Index, key: int, asked: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
    """(node, peer, n) of a cell: links found, and a node of the class that a node has here."""
    dim, home = len(asked.x.iloc[0]), key // 2
    unit = lambda rows: units(np.stack(rows.x.to_list()).astype(np.float64))
    u, node, weight = unit(asked), asked.node.to_numpy(), asked.weight.to_numpy()
    coded = dim == index.dim and home >= 0
    if coded:
        codes, error = np.frombuffer(b"".join(asked.codes), np.uint8).reshape(len(u), -1), asked.error.to_numpy()
        visits = np.zeros((len(index.centres), len(u)), bool)
        for s, lists in enumerate(asked.probes):
            visits[lists, s] = True
    n_asked, label, out, held = np.zeros(len(u), np.int64), np.arange(len(u)), [], []
    touched = np.zeros(len(u), bool)
    for a in range(0, len(asking), 512):
        some = asking.iloc[a : a + 512]
        v, own, from_ = unit(some), some.node.to_numpy(), some.home.to_numpy()
        near = own[:, None] != node
        if coded:
            near &= index.looked_up(v - index.centres[home], codes) <= index.apart + error + TINY
            lesser = np.flatnonzero(from_ < home)  # if both probe, they meet in the lesser list
            near[lesser] &= ~visits[from_[lesser]]
        if near.mean() > 0.02:
            link = near & (v @ u.T >= index.cosine)
        else:
            i, j = np.nonzero(near)
            link = np.zeros(near.shape, bool)
            for c in range(0, len(i), 1 << 16):
                x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                link[x, y] = np.einsum("ij,ij->i", v[x], u[y]) >= index.cosine
        hit = np.flatnonzero(link.any(axis=1))
        if not len(hit):
            continue
        link, own, wb = link[hit], own[hit], some.weight.to_numpy()[hit]
        both = (from_[hit] != home) | (key % 2 == 1)  # members of the list ask each other both ways
        n_asked += wb[both] @ link[both]
        touched |= link.any(axis=0)
        while True:  # the least label of what an asking node links is the label of all of their classes
            least = np.where(link, label, len(u)).min(axis=1)
            best = np.where(link, least[:, None], len(u)).min(axis=0)
            new = np.arange(len(u))
            np.minimum.at(new, label, np.minimum(best, label))
            if (new[label] == label).all():
                break
            label = new[label]
        out.append((own, link @ weight))
        held.append(link.argmax(axis=1))
    rows = [(own, node[label[first]], n) for (own, n), first in zip(out, held, strict=True)]
    some = np.flatnonzero(touched)
    rows.append((node[some], node[label[some]], n_asked[some]))
    return pd.DataFrame(dict(zip(("node", "peer", "n"), (np.concatenate(c) for c in zip(*rows, strict=True)), strict=True)))


def links(nodes: DataFrame, index: Index) -> DataFrame:
    """(node, peer, n): links of each node counted, and links that join the same nodes as all links do."""
    rows = written(indexed(nodes, index), "vectors-index")
    cores = rows.where("core").groupBy("home").agg(F.sum("weight").alias("w"), F.min("node").alias("first"), F.max("angle").alias("far")).collect()  # a row for each list
    rows = _asking(rows, {r.home: math.acos(index.cosine) + r.far + TINY for r in cores})
    member = F.col("home") * 2 + F.col("core").cast("int")
    sizes = {r.key: r for r in rows.select(F.explode(F.concat(F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(1).alias("q"))), F.array(F.struct(member.alias("key"), F.lit(0).alias("q"))))).alias("k")).groupBy("k.key").agg(F.sum("k.q").alias("asking"), F.sum(1 - F.col("k.q")).alias("asked")).collect()}  # two rows for each list and one for each other length
    grid = {k: (-(-r.asked // ASKED), -(-r.asking // ASKING)) for k, r in sizes.items() if r.asked and r.asking}
    if not grid:
        grid = {0: (0, 0)}
    x, y = (F.create_map(*(F.lit(int(v)) for k, g in grid.items() for v in (k, g[i]))) for i in (0, 1))
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    some = F.xxhash64("node")
    asked = rows.select("node", "weight", "x", "codes", "error", "probes", member.alias("key")).withColumn("ny", F.try_element_at(y, F.col("key"))).where("ny > 0")
    asked = asked.withColumn("cx", F.pmod(some, F.try_element_at(x, F.col("key"))).cast("int")).withColumn("cy", spread(F.col("ny"))).drop("ny")
    asking = rows.select("node", "weight", "x", "home", F.explode("keys").alias("key")).withColumn("nx", F.try_element_at(x, F.col("key"))).where("nx > 0")
    asking = asking.withColumn("cy", F.pmod(some, F.try_element_at(y, F.col("key"))).cast("int")).withColumn("cx", spread(F.col("nx"))).drop("nx")

    def cell(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("node", "peer", "n")})
        return compared(index, int(key[0]), p, q)

    by = ("key", "cx", "cy")
    found = asked.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(cell, "node bigint, peer bigint, n bigint")
    if not cores:
        return found
    w, first = (F.create_map(*(F.lit(int(v)) for r in cores for v in (r.home, r[c]))) for c in ("w", "first"))
    return found.union(rows.where("core").select("node", F.element_at(first, F.col("home")).alias("peer"), (F.element_at(w, F.col("home")) - F.col("weight")).alias("n")))


def grouped(embeddings: DataFrame, cosine: float = COSINE, sure: float = SURE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, a row for each row of ``embeddings``.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing.  Only vectors of one length are compared.  Repeated rows are rows of their own
    that link with each other; a null id takes part, and is a component's id only where no
    other is (then ``kept`` is false).  Extra columns are ignored; an empty table gives no rows.
    """
    rows, nodes = _nodes(embeddings)
    index = fitted(nodes, cosine, sure)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = written(links(nodes, index), "vectors-links")
    labels = components(found.select("node", "peer"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    held = nodes.drop("x").join(counts, "node", "left").join(labels, "node", "left")
    held = written(held.select("a", "b", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("label", "node").alias("label")), "vectors-held")
    least = written(held.groupBy("label").agg(F.min("least").alias("component_id")), "vectors-least")
    told = written(held.join(least, "label").select("a", "b", "n_links", "component_id"), "vectors-told")
    out = rows.join(told, ["a", "b"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("a").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS id, vec_id, embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings
), l AS (
  SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.ok AND b.ok AND a.id <> b.id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), r AS (SELECT id, id AS other FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.other = l.a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least AS component_id, coalesce(v.vec_id = least, FALSE) AS kept
FROM v JOIN (SELECT r.id, min(o.vec_id) AS least FROM r JOIN v o ON r.other = o.id GROUP BY r.id) c ON v.id = c.id
  LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON v.id = k.a
"""
