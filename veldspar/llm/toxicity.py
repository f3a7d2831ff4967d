"""Toxicity classifier: FTRL-proximal logistic regression over hashed word features.

Features of a document are the distinct hashes (``BITS`` bits) of its words, word pairs and
skip-grams (pairs with one word between).  Training keeps per-coordinate learning rates and
an L1 penalty, so nearly all weights are exactly zero and the rest, a few thousand at most,
travel to the executors as one small broadcast.

The model is fitted on a sample of at most about ``MAX_TRAIN`` labelled documents, chosen
by a hash of their ids, whose texts are read whole; shards of about ``SHARD_ROWS`` of them
train apart and their weights are averaged.  Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm import words as W

BITS = 26
MAX_TRAIN = 20_000
SHARD_ROWS = 5_000
EPOCHS = 4
BATCH = 32
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
LEAST_DOCS = 3
THRESHOLD = 0.3
_MASK = np.uint64((1 << BITS) - 1)


def features(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, pair and skip-gram, repeats included."""
    h = w.hashes
    rows, ids = [w.rows], [h & _MASK]
    for gap, salt in ((1, 0x5851F42D4C957F2D), (2, 0x14057B7EF767814F)):
        if len(h) > gap:
            same = w.rows[gap:] == w.rows[:-gap]
            rows.append(w.rows[gap:][same])
            ids.append(W.mix(h[:-gap][same] * np.uint64(salt) + h[gap:][same]) & _MASK)
    return np.concatenate(rows), np.concatenate(ids)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) by FTRL-proximal in small batches; zero weights are left out."""
    n = len(labels)
    parts = []
    for a in range(0, n, 256):
        rows, ids = features(W.split(texts.slice(a, 256)))
        parts.append(np.unique((rows.astype(np.uint64) + np.uint64(a)) << np.uint64(BITS) | ids))
    pairs = np.concatenate([*parts, np.zeros(0, np.uint64)])
    del parts
    ids = (pairs & _MASK).astype(np.uint32)
    listed = np.sort(ids)  # sorted alone, and looked up below: an inverse of all pairs would take several times the room
    first = np.flatnonzero(np.r_[True, listed[1:] != listed[:-1]]) if len(listed) else np.zeros(0, np.int64)
    kept = listed[first][np.diff(first, append=len(listed)) >= LEAST_DOCS]
    dim = len(kept)
    del listed, first
    use, place = np.zeros(len(ids), bool), []
    for a in range(0, len(ids) if dim else 0, 1 << 20):
        some = ids[a : a + (1 << 20)]
        at = np.minimum(np.searchsorted(kept, some), dim - 1).astype(np.int32)
        use[a : a + (1 << 20)] = kept[at] == some
        place.append(at[use[a : a + (1 << 20)]])
    place = np.concatenate([*place, np.zeros(0, np.int32)])
    doc = (pairs[use] >> np.uint64(BITS)).astype(np.int64)
    del pairs, ids, use
    kept = kept.astype(np.uint64)
    bounds = np.searchsorted(doc, np.arange(n + 1))
    z, g2 = np.zeros(dim + 1), np.zeros(dim + 1)  # the last is the bias
    rng = np.random.default_rng(seed)

    def weights() -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(g2)) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0
        w[dim] = -z[dim] / ((BETA + np.sqrt(g2[dim])) / ALPHA)
        return w

    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            pick = order[a : a + BATCH]
            sizes = bounds[pick + 1] - bounds[pick]
            own = np.repeat(np.arange(len(pick)), sizes)
            flat = place[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[pick], sizes)]
            w = weights()
            margin = np.bincount(own, w[flat], len(pick)) + w[dim]
            off = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[pick]
            grad = np.bincount(flat, off[own], dim + 1)
            grad[dim] = off.sum()
            sigma = (np.sqrt(g2 + grad * grad) - np.sqrt(g2)) / ALPHA
            z += grad - sigma * w
            g2 += grad * grad
    w = weights()
    some = np.flatnonzero(w[:dim])
    return kept[some], w[some], float(w[dim])


def held_out(doc_id: Column) -> Column:
    """Whether crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The averaged model of the training shards, from rows that are not held out.

    A document with several labels counts as toxic if one of them is; null labels and ids
    are left out.  Without any labelled document every score is 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    shards = max(1, round(min(total, MAX_TRAIN) / SHARD_ROWS))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40))
    chosen = known.where(spot < int(min(1.0, MAX_TRAIN / max(total, 1)) * (1 << 40)))  # about MAX_TRAIN rows: small enough to broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(shards)).cast("int"))

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("doc_id", kind="stable")
        ids, w, bias = fit(pa.array(shard.text, pa.large_string(), from_pandas=True), shard.toxic.to_numpy(np.float64))
        return pd.DataFrame({"feature": np.r_[ids.astype(np.int64), -1], "weight": np.r_[w, bias]})

    fitted = texts.groupBy("shard").applyInPandas(one, "feature bigint, weight double").toPandas()
    if fitted.empty:
        return np.zeros(0, np.uint64), np.zeros(0), -1e9
    mean = fitted.groupby("feature").weight.sum().sort_index() / (fitted.feature == -1).sum()
    bias = mean.pop(-1)
    return mean.index.to_numpy().astype(np.uint64), mean.to_numpy(), float(bias)


def _scorer(model: tuple[np.ndarray, np.ndarray, float]):
    ids, weights, bias = model
    maybe = np.zeros(1 << 18, bool)
    maybe[(ids & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def score(column: pa.Array) -> np.ndarray:
        rows, found = features(W.split(column))
        near = maybe[(found & np.uint64((1 << 18) - 1)).astype(np.int64)]
        rows, found = rows[near], found[near]
        margin = np.full(len(column), bias)
        if len(found) and len(ids):
            at = np.minimum(np.searchsorted(ids, found), len(ids) - 1)
            real = ids[at] == found
            pair = np.unique(rows[real] * len(ids) + at[real])
            margin += np.bincount(pair // len(ids), weights[pair % len(ids)], len(column))
        return 1 / (1 + np.exp(-np.clip(margin, -700, 35)))

    return score


def scored(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "toxicity") -> DataFrame:
    """``documents`` with a column ``name`` from their texts alone; null scores as empty, and a
    column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(shared.value)
        for batch in batches:
            for part in W.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score(part.column("text")))], names=[*part.schema.names, name])

    docs = documents.drop(name)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score, repeated rows one by one; an empty table gives no rows."""
    rows = scored(documents.select("doc_id", "text"), train(documents, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, unchanged.

    Null and empty texts score by the bias alone; repeated rows are judged alike; extra columns
    of any name keep their values; an empty table gives no rows.
    """
    held, columns = W.set_aside(documents, ("doc_id", "text"))
    return scored(held, train(documents, labels)).where(F.col("toxicity") < threshold).select(*columns)
