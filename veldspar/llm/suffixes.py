"""Removal of repeated 200-byte strings with two-stage suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere else, in
any document.  Texts are keyed by 128 bits of their SHA-256, so copies share what is found.

1. Anchors.  Of every ``length`` bytes the ``K``-gram with the least hash is the anchor, so
   equal strings have equal anchors at equal places.  All strings of one anchor start side
   by side; that run of starts is a *piece*, its bytes the run and ``length - 1`` bytes more.
2. Counts.  Pieces are counted by anchor, then by (anchor, whole piece) where an anchor has
   different pieces, both with map-side combining.  An anchor that occurs once rules out every string of its piece; a whole piece
   that occurs twice settles all of them.  Only what is left, the borders of shared passages
   and the surroundings of edits, goes on with its bytes.
3. Suffixes.  The pieces that are left meet by anchor, are laid end to end in blocks, and
   their suffixes are sorted: those smaller than their successors directly, the others by
   scans of the buckets.  Neighbours with a common prefix of ``length`` bytes repeat.
4. An anchor with more than ``GROUP`` different pieces (a passage in very many documents) is
   split rather than gathered: each piece is cut into parts, and these are counted again as
   in 2, under the bytes that all their strings share as the new anchor.  A part of one
   string is settled by the counts alone, so this ends with the last of ``PARTS``.

No step gathers an anchor, a text's copies or a group of texts in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.llm import words as W
from veldspar.session import written

LENGTH = 200
K = 64
GROUP = 2048
BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Grams:
    """Hashes of any substring of some bytes, modulo 2**64, from one cumulative sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = np.full(n + 1, _INVERSE, np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * W.powers(n), out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        """A 64-bit hash of each ``data[begin:end]``."""
        raw = (self.sums[end] - self.sums[begin]) * self.back[begin]
        return W.mix(W.mix(raw ^ np.uint64(seed)) + (end - begin).astype(np.uint64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def pieces(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor's distance from the first start, anchor hash, piece hash)."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = Grams(data)
    n = len(data) - K + 1
    hashes = W.mix((grams.sums[K:] - grams.sums[:-K]) * grams.back[:n])
    least = _least((hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64), length - K + 1)  # the leftmost of equals
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    n = np.diff(cut, append=len(least))
    anchor = (least[cut] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return cut, n, anchor - cut, hashes[anchor], grams.of(cut, cut + n + length - 1, 0x51)


_PIECE = "key binary, at int, n int, off int, anchor bigint, whole bigint"
_ARROW_PIECE = [("key", pa.binary()), ("at", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("anchor", pa.int64()), ("whole", pa.int64())]
#: Starts that a part of a hot piece has at most, round by round.
PARTS = (64, 16, 4, 1)


def _all_pieces(rows: DataFrame, length: int) -> DataFrame:
    """The pieces of every text of ``rows`` (key, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.chunks(batch, "raw"):
                data, offsets = W.utf8(part.column("raw"))
                found = [pieces(data[a:b], length) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                own = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                cols = [np.concatenate([f[i] for f in found]) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column("key").cast(pa.binary()).take(pa.array(own)), *(pa.array(c.astype(np.int32)) for c in cols[:3]), *(pa.array(c.view(np.int64)) for c in cols[3:])], names=["key", "at", "n", "off", "anchor", "whole"])

    return rows.mapInArrow(run, _PIECE)


def suffix_order(text: np.ndarray, depth: int, grams: Grams | None = None) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes, by two-stage sorting.

    Only suffixes smaller than their successors are compared; each of the others is put in
    its bucket when its successor is passed in the scan from the least bucket up.  Where
    ``depth`` bytes agree, the order is left open.  The end of the text counts as smaller
    than any byte.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(-1)))  # above 0: the next byte is larger
    known = np.flatnonzero(step)
    up = step[known[np.searchsorted(known, np.arange(n))]] > 0  # runs of one byte go by the byte after
    direct = np.flatnonzero(up)
    direct = direct[_once(text, direct, depth, grams or Grams(text))]
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    lists[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        done = 0
        while done < len(lists[byte]):  # the induced part grows while it is scanned
            part = lists[byte][done]
            done += 1
            out.append(part)
            _induce(text, up, part, lists)
        part = direct[bounds[byte] : bounds[byte + 1]]
        if len(part):
            out.append(part)
            _induce(text, up, part, lists)
    return np.concatenate(out)


def _induce(text: np.ndarray, up: np.ndarray, part: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Put the predecessors that are not sorted directly at the ends of their buckets, in order."""
    before = part[part > 0] - 1
    before = before[~up[before]]
    if not len(before):
        return
    byte = text[before]
    order = np.argsort(byte, kind="stable")
    before, byte = before[order], byte[order]
    cut = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
    for a, b in zip(cut, np.append(cut[1:], len(byte)), strict=True):
        lists[byte[a]].append(before[a:b])


def _once(text: np.ndarray, at: np.ndarray, depth: int, grams: Grams) -> np.ndarray:
    """The order of the suffixes at ``at``: of those whose ``depth`` bytes have one hash a single one is compared."""
    if not len(at):
        return at
    _, first, kind = np.unique(grams.of(at, np.minimum(at + depth, len(text)), 0x77), return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[_direct_order(text, at[first], depth, grams)] = np.arange(len(first))
    return np.argsort(rank[kind], kind="stable")


def _twins(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, grams: Grams) -> np.ndarray:
    """Whether each suffix at ``a`` is greater than that at ``b``, by the byte after their common
    prefix, whose length is found by halving."""
    most = np.minimum(depth, len(text) - np.maximum(a, b))
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = grams.of(a, a + mid, 0x77) == grams.of(b, b + mid, 0x77)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    after = lambda x: np.where(x + low < len(text), text[np.minimum(x + low, len(text) - 1)].astype(np.int16), -1)
    return (low < depth) & (after(a) > after(b))


def _direct_order(text: np.ndarray, at: np.ndarray, depth: int, grams: Grams) -> np.ndarray:
    """The order of the suffixes at ``at``, seven bytes at a time and only among ties of more than two."""
    padded = np.zeros(len(text) + depth + 16, np.uint64)
    padded[: len(text)] = text.astype(np.uint64) + np.uint64(1)
    word = np.zeros(len(text) + depth + 8, np.uint64)
    for i in range(7):  # seven 9-bit symbols, so that the end differs from byte 0
        word = (word << np.uint64(9)) | padded[i : i + len(word)]
    order = np.argsort(word[at], kind="stable")
    rank = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))  # places in ``order`` that are not settled
    value = word[at[order]]
    rank = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1 if len(at) else rank
    for skip in range(7, depth + 7, 7):
        size = np.bincount(rank, minlength=1)[rank]
        two = todo[np.flatnonzero(size == 2)[::2]]
        swap = two[_twins(text, at[order[two]], at[order[two + 1]], depth, grams)]
        order[swap], order[swap + 1] = order[swap + 1], order[swap]
        todo, rank = todo[size > 2], rank[size > 2]
        if not len(todo) or skip >= depth:
            break
        value = word[at[order[todo]] + skip]
        by = np.lexsort((value, rank))
        order[todo] = order[todo][by]
        rank, value = rank[by], value[by]
        rank = np.cumsum(np.r_[True, (rank[1:] != rank[:-1]) | (value[1:] != value[:-1])]) - 1
    return order


def repeated_starts(block: np.ndarray, active: np.ndarray, length: int) -> np.ndarray:
    """Of the ``active`` places of a block those whose ``length`` bytes start at another active place."""
    grams = Grams(block)
    order = suffix_order(block, length, grams)
    order = order[active[order]]
    if len(order) < 2:
        return np.zeros(0, np.int64)
    near = grams.of(order, order + length, 0x77)
    at = np.flatnonzero(near[1:] == near[:-1])
    left, right = order[at], order[at + 1]
    same = np.ones(len(at), bool)
    raw = np.ndarray((len(block) - 7,), np.uint64, block.tobytes(), 0, (1,)) if length >= 8 else block
    step = 8 if length >= 8 else 1
    for skip in [*range(0, length - step, step), length - step]:  # common prefixes of neighbours, eight bytes at a time
        same &= raw[left + skip] == raw[right + skip]
    at = at[same]
    return np.unique(np.r_[order[at], order[at + 1]])


def _sorted_runs(left: DataFrame, length: int) -> DataFrame:
    """(key, at, n) runs of repeated starts among pieces that share anchors."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(h[3]) for h in held])
        base = np.cumsum(sizes) - sizes
        block = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        active = np.zeros(len(block), bool)
        for b, h in zip(base.tolist(), held, strict=True):
            active[b : b + h[2]] = True
        found = repeated_starts(block, active, length)
        own = np.searchsorted(base, found, "right") - 1
        first = np.r_[True, (np.diff(found) != 1) | (np.diff(own) != 0)] if len(found) else np.zeros(0, bool)
        heads = np.flatnonzero(first)
        n = np.diff(heads, append=len(found))
        owner = own[heads]
        at = np.array([h[1] for h in held])[owner] + found[heads] - base[owner] if len(heads) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array([held[o][0] for o in owner.tolist()], pa.binary()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            keys, ats, ns, anchors, raws = (batch.column(c).to_pylist() for c in ("key", "at", "n", "anchor", "raw"))
            for key, at, n, anchor, raw in zip(keys, ats, ns, anchors, raws, strict=True):
                if size >= BLOCK_BYTES and anchor != last:
                    yield settle(held)
                    held, size = [], 0
                held.append((key, at, n, raw))
                size += len(raw)
                last = anchor
        if held:
            yield settle(held)

    dealt = left.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.select("key", "at", "n", "anchor", "raw").mapInArrow(run, "key binary, at int, n int")


def _parted(hot: DataFrame, most: int, length: int) -> DataFrame:
    """Parts of pieces, aligned by distance from the anchor; a part's new anchor is what all
    strings of its distances share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                far = r["off"]
                while far > r["off"] - r["n"]:
                    block = far // most
                    near = max(block * most, r["off"] - r["n"] + 1)
                    skip, n = r["off"] - far, far - near + 1
                    raw = r["raw"][skip : skip + n + length - 1]
                    core = raw[far - block * most : far - block * most - most + 1 + length]
                    keyed = hashlib.blake2b(core, digest_size=8, key=b"%d %d %d" % (r["anchor"], most, block)).digest()
                    whole = hashlib.blake2b(raw, digest_size=8, key=b"%d" % far).digest()
                    rows.append({"key": r["key"], "at": r["at"] + skip, "n": n, "off": far, "anchor": int.from_bytes(keyed, "little", signed=True), "whole": int.from_bytes(whole, "little", signed=True), "raw": raw})
                    far = near - 1
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*_ARROW_PIECE, ("raw", pa.binary())]))

    return hot.select("key", "at", "n", "off", "anchor", "raw").mapInArrow(run, f"{_PIECE}, raw binary")


def _counted(found: DataFrame) -> DataFrame:
    """``anchor, whole, times, kinds`` of the anchors that occur more than once."""
    per = written(found.groupBy("anchor", "whole").agg(F.count("*").alias("times")), "suffix-kinds")
    total = per.groupBy("anchor").agg(F.sum("times").alias("total"), F.count("*").alias("kinds"))
    total = written(total.where(F.col("total") > 1).drop("total"), "suffix-totals")  # joins of written tables can be split where a key is hot
    return written(per.join(total, "anchor"), "suffix-counted")


def _packed(rows: DataFrame, raw: str) -> DataFrame:
    """``raw`` compressed, for the two times that texts are shuffled; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in W.chunks(batch, raw):
                data, offsets = W.utf8(part.column(raw))
                view = memoryview(np.ascontiguousarray(data))
                small = pa.array([press.compress(view[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([small if c == raw else part.column(c) for c in part.schema.names], names=part.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _unpacked(small: bytes) -> bytes:
    return zstandard.decompress(small)


def _cut_out(texts: DataFrame, marks: DataFrame, length: int) -> DataFrame:
    """The pieces in ``marks`` with their bytes, ``raw``."""
    names = ["at", "n", "off", "anchor", "whole", "kinds"]
    held = marks.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("p"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw, found in zip(*(batch.column(c).to_pylist() for c in ("key", "raw", "p")), strict=True):
                raw = _unpacked(raw)
                cut = pa.array([raw[p["at"] : p["at"] + p["n"] + length - 1] for p in found], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.binary()), *(pa.array([p[c] for p in found], t) for c, t in zip(names, (pa.int32(),) * 3 + (pa.int64(),) * 3, strict=True)), cut], names=["key", *names, "raw"])

    return held.join(_packed(texts, "raw"), "key").select("key", "raw", "p").mapInArrow(run, f"{_PIECE}, kinds bigint, raw binary")


def _one_of_each(found: DataFrame, names: list[str]) -> DataFrame:
    """One piece of each kind (anchor, whole)."""
    kept = found.groupBy("anchor", "whole").agg(F.min_by(F.struct(*names), F.struct("key", "at")).alias("m"))
    return kept.select("anchor", "whole", *(f"m.{c}" for c in names))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, runs) of texts (key, raw; equal keys have equal texts): runs (at, n) of starts of
    repeated strings."""
    found = _all_pieces(texts, length)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("total"), F.min("whole").alias("least"), F.max("whole").alias("most"))
    again = written(anchors.where(F.col("total") > 1).select("anchor", (F.col("least") < F.col("most")).alias("mixed")), "suffix-anchors")
    shared = written(found.join(again, "anchor"), "suffix-shared")
    runs = [shared.where(~F.col("mixed")).select("key", "at", "n")]
    mixed = shared.where("mixed").drop("mixed")
    marked = written(mixed.join(_counted(mixed), ["anchor", "whole"]), "suffix-marked")
    settled = marked.where(F.col("times") > 1)
    runs.append(settled.select("key", "at", "n"))
    names = ["key", "at", "n", "off", "kinds"]
    # one of the pieces that are settled stands for its kind among the others
    spare = _one_of_each(settled.where(F.col("kinds") > 1), names)
    left = marked.where(F.col("times") == 1).select(*spare.columns).union(spare)
    left = written(_cut_out(texts, left, length).dropDuplicates(["key", "at"]), "suffix-left")  # copies have cut out the same
    for most in PARTS:
        runs.append(_sorted_runs(left.where(F.col("kinds") <= GROUP), length))
        hot = left.where(F.col("kinds") > GROUP)
        if hot.isEmpty():
            break
        parts = written(_parted(hot, most, length), "suffix-parts")
        marked = written(parts.join(_counted(parts), ["anchor", "whole"]), "suffix-marked")
        runs.append(marked.where(F.col("times") > 1).select("key", "at", "n"))
        if most > 1:
            left = _one_of_each(marked.where(F.col("kinds") > 1), [*names, "raw"])
    whole = runs[0]
    for more in runs[1:]:
        whole = whole.union(more)
    return whole.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("runs"))


def deduplicated(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: each document's bytes without repeats.

    A null text is empty; texts shorter than ``length`` bytes stay whole; repeated rows are
    copies of each other; null ids are kept; extra columns are ignored; an empty table gives
    no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", F.unhex(F.substring(F.sha2(raw, 256), 1, 32)).alias("key"), raw.alias("raw"))
    long = F.octet_length("raw") >= length
    found = repeats(rows.where(long).select("key", "raw"), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for raw, marks in zip(batch.column("raw").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                whole = np.frombuffer(_unpacked(raw), np.uint8)
                edge = np.zeros(len(whole) + 1, np.int64)
                for m in marks or ():
                    edge[m["at"]] += 1
                    edge[m["at"] + m["n"] + length - 1] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                sizes.append(len(whole))
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1)))
                kept.append(whole[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(documents.dtypes)["doc_id"]
    joined = _packed(rows.where(long), "raw").join(found, "key", "left").select("doc_id", "runs", "raw")
    cut = joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    none = F.lit(0).cast("bigint")
    short = rows.where(~long).select("doc_id", F.octet_length("raw").cast("bigint").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.col("raw").alias("kept"))
    return cut.union(short)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
