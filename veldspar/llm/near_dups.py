"""Near-duplicate classes with Order MinHash over occurrence-labelled word k-mers.

A document's k-mers are its runs of ``K`` words, each labelled with how many equal ones came
before it, so the labelled k-mers of a text are distinct.  A sketch takes, for one hash
function, the ``L`` labelled k-mers of least hash and keeps them in their order in the text:
equal sketches are likely where texts are close by edits, not only as bags of k-mers.

1. Texts of equal words are one node, named by a 64-bit hash of the words; names that another
   64-bit hash shows to be shared by different words are split.
2. The ``SKETCHES`` sketches of a node are its candidate keys.  The members of a key are
   paired with one of them, its centre, so pairs grow with the members and not their square.
3. Pairs are verified by banded alignment of their words: similarity is 1 - edits / longer
   length, and ``SIMILARITY`` of it links.  (A Jaccard similarity of 0.8 on five-word
   shingles is about 0.98 here, as one edited word touches five shingles of both texts.)
4. Links become classes by alternating large-star and small-star steps.
5. Keys whose members are still in several classes pair one member of each class with a
   centre drawn anew, round by round, as long as that joins many of them.  It only makes
   classes fewer, so that less is left for the next step, which misses nothing.
6. Every pair of different classes' members that shares a key is compared, key by key in
   blocks of at most ``GROUP`` members; larger groups are dealt into bands of lengths and
   chunks that meet two by two, whatever their size.  Words lie beside the members, and only links leave the block.

Before words of pairs move (3, 5) or are aligned (6), a pair must have lengths that allow the similarity and bags that agree in
``LEAST_BAG`` of ``BAG`` places.  A bag is a MinHash of single words; at similarity 0.9 two
texts share 9 of 11 words at least, so 52 places agree on average and fewer than 38 in about
one of a million pairs, while a shared passage or line alone does not get there.

Counts, centres and labels are aggregates with map-side combining; the joins on hot keys
and centres are plain joins, which adaptive execution splits.  Every intermediate table is
written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.llm import words as W
from veldspar.session import written

K = 5
L = 2
SKETCHES = 32
SIMILARITY = 0.9
BAG = 64
LEAST_BAG = 38
GROUP = 4096
WORTH = 8  # a round of draws is followed by another if one pair in so many was a link
BAND = -math.log(SIMILARITY - 0.01)  # texts that can be similar are in one band or neighbouring ones


def labelled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers of a text, each mixed with its count of equal ones before it."""
    grams = W.windows(hashes, k) if len(hashes) >= k else W.windows(hashes, max(1, len(hashes)))
    if not len(grams):
        return grams
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    seen = np.arange(len(grams)) - np.repeat(first, np.diff(first, append=len(grams)))
    label = np.empty(len(grams), np.uint64)
    label[order] = seen.astype(np.uint64)
    return W.mix(grams + label * np.uint64(0xD1B54A32D192ED03))


_FACTORS = W.mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(hashes: np.ndarray, k: int = K, take: int = L, m: int = SKETCHES) -> np.ndarray:
    """``m`` Order MinHash values of a text's word hashes; none for a text without words."""
    grams = labelled(hashes, k)
    if not len(grams):
        return grams
    take = min(take, len(grams))
    rows = max(1, min(m, (1 << 21) // len(grams)))
    out = []
    for a in range(0, m, rows):
        value = grams[None, :] * _FACTORS[a : min(m, a + rows), None]
        least = np.empty((len(value), take), np.int64)
        every = np.arange(len(value))
        for i in range(take):
            least[:, i] = value.argmin(axis=1)
            value[every, least[:, i]] = _MOST
        least.sort(axis=1)  # text order
        total = np.arange(a + 1, a + 1 + len(value), dtype=np.uint64)
        for i in range(take):
            total = total * _FACTORS[-1] + grams[least[:, i]]
        out.append(total)
    return W.mix(np.concatenate(out))


def bag(hashes: np.ndarray, m: int = BAG) -> bytes:
    """``m`` MinHash values, a byte each, of a text's words labelled with their counts before."""
    words = labelled(hashes, 1)
    if not len(words):
        return bytes(m)
    rows = max(1, (1 << 21) // len(words))
    least = [(words[None, :] * _FACTORS[a : min(m, a + rows), None]).min(axis=1) for a in range(0, m, rows)]
    return W.mix(np.concatenate(least)).astype(np.uint8).tobytes()


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edit distance of ``a`` and ``b`` if it is at most ``most``, else ``most + 1``.

    Bit-parallel alignment in a band of ``most`` diagonals on each side: integers hold the
    differences between neighbouring cells of the band, which moves along with the text.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if n == m and np.array_equal(a, b):
        return 0
    if most >= n:  # the band covers everything
        row = list(range(m + 1))
        for i, x in enumerate(a.tolist(), 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b.tolist(), 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row[-1], most + 1)
    width = 2 * most + 2
    full, top, edge = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    up, down, cost, shift = (full << (width - most - 1)) & full, 0, most, most + 1 - width
    for j, y in enumerate(b.tolist()):
        match = places.get(y, 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        same = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(same | up)) & full, same & up
        if j < n - most:
            cost += not same & top
            if cost > 2 * most + m - n:
                return most + 1
        else:
            cost += bool(right & edge) - bool(left & edge)
            edge >>= 1
        up, down = (left | ~((same >> 1) | right)) & full, (same >> 1) & right
        shift += 1
    return min(cost, most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the similarity of two texts' words is at least ``least``."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    kinds, count = np.unique(np.r_[a, b], return_inverse=True)
    common = np.minimum(np.bincount(count[: len(a)], minlength=len(kinds)), np.bincount(count[len(a) :], minlength=len(kinds))).sum()
    if longer - common > most:  # words without a partner need an edit each
        return False
    return edits(a, b, most) <= most


def _node(h: np.ndarray, salt: int = 0) -> int:
    """A 64-bit name of a text's words; another salt gives an independent one."""
    h = W.mix(h ^ np.uint64(salt)) if salt else h
    return int(W.mix(np.sum(h * W.powers(len(h) + 1)[1:], dtype=np.uint64)[None] + np.uint64(len(h))).view(np.int64)[0])


def _sketched(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__row`` (unique), ``__node`` (null without words), ``__check``, ``__bag``, ``__size`` and ``__keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.split(part.column("text"))
                texts = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                keys = [sketches(h).view(np.int64) for h in texts]
                bags = pa.array([bag(h) for h in texts], pa.binary())
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                nodes = pa.array([_node(h) if len(h) else None for h in texts], pa.int64())
                checks = pa.array([_node(h, 0x6A09E667F3BCC908) for h in texts], pa.int64())
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, rows, nodes, checks, bags, pa.array(np.diff(w.first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))], names=[*part.schema.names, "__row", "__node", "__check", "__bag", "__size", "__keys"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(run, f"{fields}, __row bigint, __node bigint, __check bigint, __bag binary, __size int, __keys array<bigint>")


def _words(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, words, bag, sig) of the wanted nodes: the words of each text as compressed 32-bit
    hashes, and 31 bits of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in W.chunks(batch, "text"):
                w = W.split(part.column("text"))
                packed = [press.compress(w.hashes[a:b].astype(np.uint32).tobytes()) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                sigs = [_short(np.array(k, np.int64)).tobytes() for k in part.column("__keys").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("__node"), pa.array(packed, pa.binary()), part.column("__bag"), pa.array(sigs, pa.binary())], names=["node", "words", "bag", "sig"])

    packed = found.where(F.col("__node").isNotNull()).select("__node", "text", "__bag", "__keys").mapInArrow(run, "node bigint, words binary, bag binary, sig binary")
    return packed.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def _short(keys: np.ndarray) -> np.ndarray:
    return (keys & np.int64((1 << 31) - 1)).astype(np.int32)


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The (node, peer) pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load = lambda x: np.frombuffer(zstandard.decompress(x), np.uint32)
        for batch in batches:
            keep = [similar(load(a), load(b)) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["node", "peer"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(words.select("node", F.col("words").alias("a")), "node")
    both = both.join(words.select(F.col("node").alias("peer"), F.col("words").alias("b")), "peer")
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work
    return both.select("node", "peer", "a", "b").repartition(spread, "node", "peer").mapInArrow(run, "node bigint, peer bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node but the least of each class, which is the label."""
    edges = links.select(F.greatest("node", "peer").alias("u"), F.least("node", "peer").alias("v")).where("u <> v").distinct()
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(new.select("e.u", "e.v").where("u <> v").distinct(), "near-edges")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("n")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up"))))
        if ends.isEmpty():  # every node has one edge up or is the least of its class
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _close(a: str, b: str) -> Column:
    """Whether the lengths alone allow two texts to be similar."""
    return F.least(a, b) >= SIMILARITY * F.greatest(a, b)


def _alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose bags agree enough: much less to move than words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BAG) for c in ("a", "b"))
            yield batch.select(["node", "peer"]).filter(pa.array((a == b).sum(axis=1) >= LEAST_BAG))

    both = pairs.join(nodes.select("node", F.col("bag").alias("a")), "node").join(nodes.select(F.col("node").alias("peer"), F.col("bag").alias("b")), "peer")
    return both.select("node", "peer", "a", "b").mapInArrow(run, "node bigint, peer bigint")


def _compared(cells: DataFrame) -> DataFrame:
    """(node, peer) links between rows of a cell that differ in label and chunk.

    ``cells``: (cell, key, node, n, label, chunk, bag, sig, words); a null chunk differs from
    every other, and a null key is no key of one place.  Pairs are tested by length, by bags
    and, in the cell of the first key that both have, by alignment; what a cell has linked is
    not tested again.  Only links leave.
    """
    load = lambda x: np.frombuffer(zstandard.decompress(x), np.uint32)

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        cell, node, n, label = (rows.column(c).to_numpy() for c in ("cell", "node", "n", "label"))
        chunk, free = rows.column("chunk").fill_null(0).to_numpy(), rows.column("chunk").is_null().to_numpy()
        bag = np.frombuffer(b"".join(rows.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.int32).reshape(len(cell), -1)
        key, words = rows.column("key"), rows.column("words")
        own = np.where(key.is_null().to_numpy(), -1, (sig == _short(key.fill_null(0).to_numpy())[:, None]).argmax(axis=1))
        top: dict[tuple, tuple] = {}  # classes joined within a cell
        found: list[tuple[int, int]] = []

        def class_of(i: int) -> tuple:
            c = cell[i], label[i]
            while c in top:
                c = top[c]
            return c

        at, step = np.arange(len(cell)), 0
        while len(at):  # rows that still have a longer row of their cell ``step`` places on
            step += 1
            at = at[at + step < len(cell)]
            at = at[(cell[at] == cell[at + step]) & (n[at] >= SIMILARITY * n[at + step])]
            some = at[(label[at] != label[at + step]) & (free[at] | (chunk[at] != chunk[at + step]))]
            for a in range(0, len(some), 1 << 16):
                x = some[a : a + (1 << 16)]
                x = x[(bag[x] == bag[x + step]).sum(axis=1) >= LEAST_BAG]
                x = x[(own[x] < 0) | ((sig[x] == sig[x + step]).argmax(axis=1) == own[x])]
                for i in x.tolist():
                    a_class, b_class = class_of(i), class_of(i + step)
                    if a_class != b_class and similar(load(words[i].as_py()), load(words[i + step].as_py())):
                        top[a_class] = b_class
                        found.append((int(node[i]), int(node[i + step])))
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["node", "peer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if held and (cut or held[-1].column("cell")[held[-1].num_rows - 1].as_py() != cell[-1]):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield pairs(pa.Table.from_batches(held))

    dealt = cells.select("cell", "key", "node", "n", "label", "chunk", "bag", "sig", "words").repartition("cell").sortWithinPartitions("cell", "n")
    return dealt.mapInArrow(run, "node bigint, peer bigint")


def _gridded(rows: DataFrame) -> DataFrame:
    """Cells of groups of more than ``GROUP`` rows: chunks of a group meet two by two, but for
    chunks of one class alone.  Groups are first dealt into bands of lengths, each of which
    meets itself and the next."""
    band = F.floor(F.log("n") / BAND)
    rows = rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("own", band)
    rows = rows.withColumn("cell", F.xxhash64("cell", "band")).drop("band")
    per = rows.groupBy("cell", "label").agg(F.count("*").alias("c"))
    whole = per.groupBy("cell").agg(F.sum("c").alias("t"), F.count("*").alias("k")).where("k > 1").select("cell", "t")
    dealt = rows.join(whole, "cell").join(per, ["cell", "label"])
    half = GROUP // 2
    pure = F.col("c") > half
    part = F.when(pure, F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / half))).otherwise(F.pmod(F.xxhash64("label"), F.ceil(F.col("t") / half)))
    dealt = dealt.withColumn("alone", F.when(pure, F.col("label"))).withColumn("chunk", F.xxhash64("alone", part)).drop("t", "c")
    dealt = written(dealt, "near-chunks")
    chunks = dealt.select("cell", "chunk", "alone").distinct()
    others = chunks.select("cell", F.col("chunk").alias("with"), F.col("alone").alias("b"))
    met = chunks.join(others, "cell").where((F.col("chunk") <= F.col("with")) & (F.col("alone").isNull() | F.col("b").isNull() | (F.col("alone") != F.col("b"))))
    sides = met.select("cell", "with", F.col("chunk").alias("first"), F.explode(F.array_distinct(F.array("chunk", "with"))).alias("chunk"))
    out = dealt.join(sides, ["cell", "chunk"]).withColumn("cell", F.xxhash64("cell", "first", "with"))
    return out.withColumn("chunk", F.when(F.col("first") != F.col("with"), F.col("chunk")))


def _apart(shared: DataFrame, labels: DataFrame, words: DataFrame) -> DataFrame:
    """Links (node, peer) between different classes of nodes with a common key.

    The counts are written before they are joined, so that a hot key can be split.
    """
    held = shared.select("key", "node", "n").join(labels, "node", "left").select("key", F.col("key").alias("cell"), "node", "n", F.coalesce("label", "node").alias("label"))
    per = held.groupBy("cell").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c")).where("a < b").select("cell", "c")
    held = written(held.join(written(per, "near-cells"), "cell"), "near-apart")
    most = held.agg(F.max("c").alias("c")).first().c or 0
    cells = held.where(F.col("c") <= GROUP).drop("c").withColumn("chunk", F.lit(None).cast("bigint"))
    if most > GROUP:
        cells = cells.unionByName(_gridded(held.where(F.col("c") > GROUP).drop("c")).select(*cells.columns))
    return _compared(cells.join(words, "node"))


def _nodes(found: DataFrame) -> DataFrame:
    """(node, n, keys, bag, least, most) of each node; least and most check are equal unless texts of other words have its name."""
    rows = found.where(F.col("__node").isNotNull()).groupBy(F.col("__node").alias("node"))
    return written(rows.agg(F.first("__size").alias("n"), F.first("__keys").alias("keys"), F.first("__bag").alias("bag"), F.min("__check").alias("least"), F.max("__check").alias("most")), "near-nodes")


def _labels(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label) of nodes whose class has a lesser node."""
    postings = nodes.select(F.explode("keys").alias("key"), "node", "n")
    centres = postings.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("peer"), F.min_by("n", "node").alias("m")).where("c > 1").drop("c")
    centres = written(centres, "near-centres")
    shared = written(postings.join(centres, "key"), "near-shared")
    pairs = shared.where((F.col("node") != F.col("peer")) & _close("n", "m")).select("node", "peer").distinct()
    words = written(_words(found, shared.select("node").distinct()), "near-words")
    links = written(_verified(_alike(pairs, nodes), words), "near-links")
    labels, r = components(links), 0
    while True:  # further draws pay only while they join many classes
        r += 1
        held = shared.select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        draw = F.xxhash64("node", F.lit(r))
        held = held.groupBy("key", "label").agg(F.min_by("node", draw).alias("node"), F.min_by("n", draw).alias("n"), F.min(draw).alias("h"))  # one of each class
        held = written(held, "near-held")
        again = held.groupBy("key").agg(F.count("*").alias("c"), F.min_by("node", "h").alias("peer"), F.min_by("n", "h").alias("m")).where("c > 1").drop("c")
        again = written(again, "near-centres")
        pairs = written(held.join(again, "key").where((F.col("node") != F.col("peer")) & _close("n", "m")).select("node", "peer").distinct(), "near-pairs")
        links = written(_verified(_alike(pairs, nodes), words), "near-links")
        n = links.count()
        labels = _joined(labels, links) if n else labels
        if n * WORTH <= pairs.count():
            break
    links = written(_apart(shared, labels, words), "near-links")
    return labels if links.isEmpty() else _joined(labels, links)


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The classes of ``labels`` joined by more links."""
    return components(labels.select("node", F.col("label").alias("peer")).union(links))


def _classed(documents: DataFrame) -> DataFrame:
    """``documents`` with ``__row`` and ``__class``, written to the shared folder."""
    found = written(_sketched(documents), "near-sketches")
    nodes = _nodes(found)
    twins = nodes.where("least <> most").select(F.col("node").alias("__node"), F.lit(True).alias("__twin"))
    if not twins.isEmpty():  # names that texts of different words share are told apart by the second hash
        name = F.when(F.col("__twin"), F.xxhash64("__node", "__check")).otherwise(F.col("__node"))
        found = written(found.join(twins, "__node", "left").withColumn("__node", name).drop("__twin"), "near-sketches")
        nodes = _nodes(found)
    labels = _labels(found, nodes)
    named = found.drop("__keys", "__bag", "__size", "__check").join(labels.select(F.col("node").alias("__node"), F.col("label").alias("__label")), "__node", "left")
    own = F.xxhash64("__row", F.lit("no words"))
    return named.withColumn("__class", F.coalesce("__label", "__node", own)).drop("__label", "__node")


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id``: every document with the least ``doc_id`` of its class.

    Documents without words (null, empty, marks only) are classes of their own; repeated rows
    are copies; a class of null ids has a null class id; extra columns are ignored; an empty
    table gives no rows.
    """
    rows = _classed(documents.select("doc_id", "text")).drop("text")
    least = rows.groupBy("__class").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "__class").select("doc_id", "class_id")


def kept(documents: DataFrame) -> DataFrame:
    """One document of each class, that of the least ``doc_id``, in the columns of ``documents``.

    Of rows that share the least id one stays; null ids come last; extra columns of any name
    keep their values; cases are those of :func:`classes`.
    """
    held, columns = W.set_aside(documents, ("doc_id", "text"))
    rows = _classed(held)
    first = rows.groupBy("__class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("f")).select(F.col("f.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*columns)
