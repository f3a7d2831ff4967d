"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model.

Tokens are runs of letters and digits or runs of marks, as they are written, and are named
by 64-bit hashes.  Every token of trusted text is in the vocabulary; a token outside it has
the share of the uniform distribution that the single tokens leave it.

1. Documents become blocks of consecutive rows in the shared folder: the letters of a block's
   distinct tokens and every token as a place among them.  Labels join by ids alone.
2. Trusted documents (but for a share kept for calibration) send their distinct trigrams to
   groups by the hash of the last two tokens.  There trigrams and bigrams are complete and are
   counted: the discounts come from their counts of counts, and every token gets its
   continuation count and its sums as a context.
3. Blocks are written again with numbers for tokens: those of trusted text get small ones where
   they are frequent, all others are 0.  What is known of a token stands beside its number.
4. In each of up to ``PASSES`` passes the trigrams of all documents whose middle token is in the
   pass go to groups twice, by their first and by their last two tokens, with what trusted
   documents counted.  A pass holds all that its trigrams need; groups split hot tokens.  The
   answers meet their block, which adds up logarithms by document.  Rows are sorted and
   packed arrays; shuffle files go when a pass is written, so the disk holds one pass's.
5. A language's threshold is a quantile of the perplexities of its trusted documents that
   the model has not seen, drawn smoothly towards all languages' quantile: the fewer
   documents, the more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from veldspar.llm import words as W
from veldspar.session import emptied, shuffles_freed, written, written_apart

BLOCK_TOKENS = 1 << 20
BLOCK_ROWS = 1 << 16
START = 0x2545F4914F6CDD1D
CALIBRATION = 8
QUANTILE = 0.995
PRIOR = 100
STEP = 0.001
PASSES = 8  # at most, so that a pass's shuffles are small beside the input
PORTIONS = 4  # of blocks, so that few are there both with letters and with numbers
PASS = 1 << 20  # tokens that are not worth another pass
SLOTS = 1024  # of tokens, dealt to passes by weight
GROUP = 1 << 20  # tokens of a pass in a group, about

_BYTE = np.arange(256)
_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_KIND = np.where(_BYTE <= 32, 0, np.where(_WORD, 1, 2))  # space, word, marks


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # masks of the first n of eight bytes
_LONG = 4096


def _hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash of each run of bytes: eight at a time, what follows ``_LONG`` as a polynomial."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out, on = size.astype(np.uint64), np.arange(len(begin))
    for i in range(0, _LONG, 8):
        left = size[on] - i
        out[on] = W.mix(out[on] ^ (eights[begin[on] + i] & _FIRST[np.minimum(left, 8)]))
        on = on[left > 8]
        if not len(on):
            break
    for j in on:
        rest = data[begin[j] + _LONG : begin[j] + size[j]].astype(np.uint64) + np.uint64(1)
        out[j] = W.mix(out[j : j + 1] ^ np.sum(rest * W.powers(len(rest)), dtype=np.uint64))[0]
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every token of the texts its hash, first byte and size; of each text its first token's index; the bytes."""
    data, offsets = W.utf8(column)
    kind = _KIND[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64), data
    opens = np.empty(len(data), bool)
    opens[0] = True
    np.not_equal(kind[1:], kind[:-1], out=opens[1:])
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(opens)
    size = np.diff(begin, append=len(data))
    real = kind[begin] > 0
    begin, size = begin[real], size[real]
    return _hashes(data, begin, size), begin, size, np.searchsorted(begin, offsets), data


def _pressed(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as bytes: all first bytes of numbers, then all second ones, and so on, compressed."""
    parts = []
    for x in arrays:
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
        parts += [np.array([len(x), ord(x.dtype.char)], np.int64).tobytes(), planes.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def _opened(data: bytes) -> list[np.ndarray]:
    """The arrays of ``_pressed``."""
    raw, at, out = np.frombuffer(zstandard.decompress(data), np.uint8), 0, []
    while at < len(raw):
        n, kind = raw[at : at + 16].view(np.int64)
        kind = np.dtype(chr(kind))
        end = at + 16 + int(n) * kind.itemsize
        out.append(np.ascontiguousarray(raw[at + 16 : end].reshape(kind.itemsize, int(n)).T).view(kind).reshape(int(n)))
        at = end
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Ascending numbers as differences."""
    return np.diff(x, prepend=np.uint64(0))


def _blocks(documents: DataFrame) -> DataFrame:
    """Blocks of rows: ``block, packed`` (see ``_Block``), the rows' ``sizes``, the tokens of each ``slot`` and the rows' own columns as a list."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, count, held, own = TaskContext.get().partitionId() << 24, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, size, count
            hashes, begin, sizes, n, data = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = pa.concat_arrays(own)
            words, first, at, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            begin, sizes = begin[first], sizes[first]
            head = np.zeros(len(words), np.uint64)
            for i in range(4):
                head = head << np.uint64(8) | np.where(sizes > i, data[np.minimum(begin + i, len(data) - 1)] if len(data) else 0, 0).astype(np.uint64)
            order = np.lexsort((head, -often))  # frequent ones first: small numbers compress
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            begin, sizes = begin[order], sizes[order]
            letters = data[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            packed = _pressed(letters, sizes.astype(np.uint32), place[at], n.astype(np.uint32), level=3)
            before = np.bincount((words % np.uint64(SLOTS)).astype(np.int64), often, SLOTS).astype(np.int64)
            before[START % SLOTS] += len(rows)
            fields = [pa.array([block], pa.int64()), pa.array([packed], pa.binary()), pa.array([_pressed(n.astype(np.uint32))], pa.binary()), pa.array([before.tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)]
            block, size, count = block + 1, 0, 0
            held.clear()
            own.clear()
            return pa.RecordBatch.from_arrays(fields, names=["block", "packed", "sizes", "slots", "own"])

        end = 0
        for batch in batches:
            for part in W.chunks(batch, "text"):
                for a in range(0, part.num_rows, 256):
                    some = part.slice(a, 256)
                    hashes, begin, sizes, first, data = tokens(some.column("text"))
                    end = end if held else 0
                    held.append((hashes, begin + end, sizes, np.diff(first), data))
                    own.append(pa.StructArray.from_arrays([some.column("doc_id"), some.column("lang")], names=["doc_id", "lang"]))
                    end, size, count = end + len(data), size + len(hashes), count + some.num_rows
                    if size >= BLOCK_TOKENS or count >= BLOCK_ROWS:
                        yield flush()
        if own:
            yield flush()

    return documents.select("doc_id", "lang", "text").mapInArrow(run, f"block bigint, packed binary, sizes binary, slots array<bigint>, own array<struct<doc_id:{kind},lang:string>>")


def _marks(blocks: DataFrame, good: DataFrame) -> DataFrame:
    """(block, marks): ``use`` of a block's rows, a compressed byte each."""

    def run(rows: pa.Table) -> pa.Table:
        at = rows.column("at").to_numpy()
        use = np.zeros(int(at.max()) + 1, np.uint8)
        use[at] = rows.column("use").to_numpy()
        return pa.table({"block": rows.column("block").slice(0, 1), "marks": pa.array([_pressed(use)], pa.binary())})

    rows = blocks.select("block", F.posexplode("own").alias("at", "o")).select("block", "at", F.col("o.doc_id").alias("doc_id"))
    return rows.join(good, "doc_id").select("block", "at", "use").groupBy("block").applyInArrow(run, "block bigint, marks binary")


def _use(marks: bytes | None, n: int) -> np.ndarray:
    """``use`` of all ``n`` rows of a block."""
    found = np.zeros(0, np.uint8) if marks is None else _opened(marks)[0]
    return np.append(found, np.zeros(n - len(found), np.uint8))


class _Sequence:
    """A block's rows: ``two, one, last`` are places among ``words`` tokens at every token, the last of them is START."""

    def __init__(self, last: np.ndarray, n: np.ndarray, words: int, marks: bytes | None) -> None:
        self.last, self.n = last, n
        start, self.ends = words - 1, np.cumsum(n, dtype=np.int64)
        first = (self.ends - n)[n > 0]
        self.one, self.two = np.r_[np.uint32(start), last[:-1]][: len(last)], np.r_[np.uint32([start, start]), last[:-2]][: len(last)]
        self.one[first] = start
        self.two[first] = start
        second = first + 1
        self.two[second[second < len(last)]] = start
        self.use = _use(marks, len(n))

    def rows(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


class _Block(_Sequence):
    """A block whose tokens, ``words``, are hashes."""

    def __init__(self, packed: bytes, marks: bytes | None) -> None:
        letters, sizes, last, n = _opened(packed)
        sizes = sizes.astype(np.int64)
        self.words = np.append(_hashes(letters, np.cumsum(sizes) - sizes, sizes), np.uint64(START))
        super().__init__(last, n, len(self.words), marks)

    def taken(self, turn: np.ndarray, wanted: int) -> np.ndarray:
        """The tokens after one whose slot has the wanted turn."""
        return np.flatnonzero((turn[(self.words % np.uint64(SLOTS)).astype(np.int64)] == wanted)[self.one])


class _Numbered(_Sequence):
    """A block whose tokens have a ``number``, 0 if unknown, and the counts ``known`` of them."""

    def __init__(self, packed: bytes, marks: bytes | None) -> None:
        last, n, self.number, *self.known = _opened(packed)
        super().__init__(last, n, len(self.number), marks)


def _slots(number: np.ndarray) -> np.ndarray:
    """Slots of numbered tokens; a block asks nothing about unknown ones, so any slot does."""
    return np.where(number > 0, number, np.arange(len(number), dtype=np.uint32)) % SLOTS


_TURN = np.uint64(21)
_CUT = np.uint64(24)  # beside the hash of two tokens, 40 bits tell the third


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of the token ``a`` followed by ``b``."""
    return W.mix((a << _TURN | a >> np.uint64(43)) ^ b)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Of each of ``n`` rows the number of its run."""
    out = np.zeros(n, np.int64)
    out[starts[1:]] = 1
    return np.cumsum(out)


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of numbers."""
    return W.mix(a + b * np.uint64(0x9E3779B97F4A7C15))


def _summed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, dtype=x.dtype) if len(starts) else np.zeros(0, x.dtype)


def _bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` even ranges of hashes begins among ascending keys, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of the ranges of ``_bounds`` a hash is in."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts < 1 << 16 else np.uint32)


def _ordered(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The order of triples of places below ``n``."""
    bits = n.bit_length()
    return np.argsort((a.astype(np.uint64) << bits | b) << bits | c) if 3 * bits <= 64 else np.lexsort((c, b, a))


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    dest, block, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["dest", "block", "data"])


_ROWS = "dest int, block bigint, data binary"


def _counted(blocks: DataFrame, turn: np.ndarray, wanted: int, parts: int) -> DataFrame:
    """(kind, word, a, b, c, d, e) of the trigrams of training documents in a pass.

    Of kind 1: a token's continuation count, and as a context the sum of counts and how many
    are one, two and more.  Of kinds 2 and 3: how many bigrams and trigrams count one to four.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block(r["packed"], r["marks"])
                at = b.taken(turn, wanted)
                at = at[b.use[b.rows(at)] == 1]
                u, v, w = b.two[at], b.one[at], b.last[at]
                part = _part(_pair(b.words[v], b.words[w]), parts)
                order = _ordered(v, w, u, len(b.words))
                order = order[np.argsort(part[order], kind="stable")]
                part, u, v, w = (x[order] for x in (part, u, v, w))
                three = _runs(part, v, w, u)
                count = np.diff(three, append=len(order)).astype(np.uint32)
                part, u, v, w = part[three], b.words[u[three]] >> _CUT, v[three], w[three]
                two = _runs(part, v, w)
                many, end, part, v, w = np.diff(two, append=len(part)).astype(np.uint32), np.append(two, len(part)), part[two], v[two], b.words[w[two]]
                one = _runs(part, v)
                often, part, v = np.diff(one, append=len(part)).astype(np.uint32), part[one], b.words[v[one]]
                high, low, rows = np.append(one, len(w)), np.searchsorted(part, np.arange(parts + 1)), []
                for s in range(parts):
                    a, z = low[s], low[s + 1]
                    if a < z:
                        pairs, some = slice(high[a], high[z]), slice(end[high[a]], end[high[z]])
                        rows.append((s, r["block"], _pressed(v[a:z], often[a:z], w[pairs], many[pairs], u[some], count[some])))
                if rows:
                    yield _batch(rows)

    def count(rows: pa.Table) -> pa.Table:
        v, often, w, many, u, c = (np.concatenate(x) for x in zip(*(_opened(x) for x in rows.column("data").to_pylist()), strict=True))
        v, w = np.repeat(np.repeat(v, often), many), np.repeat(w, many)
        key = _pair(v, w)
        name = _named(key, u)
        order = np.argsort(name)
        at = _runs(name[order])
        c3, order = _summed(c[order].astype(np.int64), at), order[at]
        key, v, w = key[order], v[order], w[order]
        order = np.argsort(key)
        c3, key, v, w = c3[order], key[order], v[order], w[order]
        at = _runs(key)
        v, w = v[at], w[at]
        # nothing but the start mark precedes itself, so pairs that it begins are counted as they occur
        c2 = np.where(v == np.uint64(START), _summed(c3, at), np.diff(at, append=len(key)))
        words, place = np.unique(np.concatenate([v, w]), return_inverse=True)
        v, w = place[: len(v)], place[len(v) :]
        per = lambda at, x=None: np.bincount(at, x, len(words)).astype(np.int64)
        found = [per(w), per(v, c2), per(v, c2 == 1), per(v, c2 == 2), per(v, c2 > 2)]
        often = [np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (c2, c3)]
        kind = np.r_[np.ones(len(words), np.int32), np.int32([2, 3])]
        table = {"kind": kind, "word": np.append(words.view(np.int64), [0, 0])}
        table |= {n: np.append(found[i], [often[0][i], often[1][i]] if i < 4 else [0, 0]) for i, n in enumerate("abcde")}
        return pa.table(table)

    asked = blocks.select("block", "packed", "marks").mapInArrow(ask, _ROWS)
    return asked.groupBy("dest").applyInArrow(count, "kind int, word bigint, a bigint, b bigint, c bigint, d bigint, e bigint")


def _totals(counted: DataFrame) -> DataFrame:
    return counted.groupBy("kind", "word").agg(*(F.sum(x).alias(x) for x in "abcde"))


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two and more, from how many count one to four."""
    if not all(n):
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    found = [c - (c + 1) * y * n[c] / n[c - 1] for c in (1, 2, 3)]
    return tuple(min(max(d, 0.05), c - 0.05) for c, d in zip((1, 2, 3), found, strict=True))


def _known(blocks: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """(dest, block, data): numbers of each block's tokens and what is known of them, in the order of their hashes.

    A number is unique: it counts the more frequent tokens of its group, in steps of ``parts``.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.sort(_Block(r["packed"], None).words)
                at = _bounds(keys, parts)
                yield _batch([(s, r["block"], _pressed(_steps(keys[at[s] : at[s + 1]]))) for s in range(parts) if at[s] < at[s + 1]])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right.column("word").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        keys = np.append(keys[order], np.uint64(0))
        values = [np.append(right.column(x).to_numpy()[order], 0) for x in "abcde"]
        number = np.zeros(len(keys), np.int64)
        if len(order):
            dest = left.column("dest")[0].as_py()
            number[np.lexsort((keys[:-1], -values[1][:-1]))] = np.arange(len(order)) * parts + dest + 1
            if number.max() >> 32:
                raise OverflowError("more tokens than numbers of 32 bits")
        out = []
        for r in left.to_pylist():
            wanted = np.cumsum(_opened(r["data"])[0])
            at = np.searchsorted(keys[:-1], wanted)
            found = (keys[at] == wanted) & (at < len(order))
            out.append((r["dest"], r["block"], _pressed(*(np.where(found, x[at], 0) for x in (number, *values)))))
        return pa.Table.from_batches([_batch(out)] if out else [], pa.schema([("dest", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))

    asked = blocks.select("block", "packed").mapInArrow(ask, _ROWS)
    dest = F.shiftrightunsigned(F.shiftrightunsigned("word", 32) * parts, 32).cast("int")
    return asked.groupBy("dest").cogroup(words.withColumn("dest", dest).groupBy("dest")).applyInArrow(answer, _ROWS)


def _numbered(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``blocks`` with numbers for tokens (see ``_Numbered``), and the tokens of each slot of numbers."""
    columns = ["block", "packed", "sizes", "slots", "marks", "own"]
    kind = blocks.schema["own"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = _Block(left.column("packed")[0].as_py(), None)
        found = [_opened(r["data"]) for r in sorted(right.to_pylist(), key=lambda r: r["dest"])]
        order, values = np.argsort(b.words), []
        for x in zip(*found, strict=True):
            value = np.empty(len(order), np.int64)
            value[order] = np.concatenate(x)
            values.append(value.astype(np.uint32) if value.max() < 1 << 32 else value)
        packed = _pressed(b.last, b.n, *values, level=3)
        slots = np.bincount(_slots(values[0])[b.one], minlength=SLOTS).astype(np.int64)
        left = left.set_column(left.column_names.index("packed"), "packed", pa.array([packed], pa.binary()))
        return left.append_column("slots", pa.array([slots.tolist()], pa.list_(pa.int64()))).select(columns)

    pairs = blocks.drop("slots").groupBy("block").cogroup(known.groupBy("block"))
    return pairs.applyInArrow(run, f"block bigint, packed binary, sizes binary, slots array<bigint>, marks binary, own {kind}")


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two numbers of 32 bits as one."""
    return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)


def _dealt(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """The part that answers for each pair of tokens; those with an unknown token come last and are not asked."""
    part = _part(W.mix(_paired(a, b)), parts)
    part[(a == 0) | (b == 0)] = parts
    return part


def _scored(blocks: DataFrame, turn: np.ndarray, wanted: int, parts: int, d: list[tuple[float, float, float]], single: tuple[int, float, int]) -> DataFrame:
    """(block, sums): of each block's rows the sum of the logarithms of a pass's tokens' probabilities."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Numbered(r["packed"], r["marks"])
                chosen = turn[_slots(b.number)] == wanted
                at = np.flatnonzero(chosen[b.one])
                if not len(at):
                    continue
                row, number, rows = b.rows(at), b.number, []
                u, v, w = b.two[at], b.one[at], b.last[at]
                order = _ordered(v, u, w, len(number))
                part = _dealt(number[u], number[v], parts)
                order = order[np.argsort(part[order], kind="stable")]
                row, part, u, v, w = (x[order] for x in (row, part, u, v, w))
                at = _runs(part, v, u, w)
                often = np.diff(at, append=len(order)).astype(np.uint32)
                count = _summed((b.use[row] == 1).astype(np.uint32), at)
                part, u, v, w = (x[at] for x in (part, u, v, w))
                at = _runs(part, v, u)
                end, many = np.append(at, len(part)), np.diff(at, append=len(part)).astype(np.uint32)
                one, two, third, low = number[v[at]], number[u[at]], number[w], np.searchsorted(part[at], np.arange(parts + 1))
                for s in range(parts):
                    if low[s] < low[s + 1]:
                        own, some = slice(low[s], low[s + 1]), slice(end[low[s]], end[low[s + 1]])
                        rows.append((s, r["block"], _pressed(one[own], two[own], many[own], third[some], count[some])))
                order = np.argsort(_paired(v, w))
                part = _dealt(number[v], number[w], parts)
                order = order[np.argsort(part[order], kind="stable")]
                part, u, v, w, count = (x[order] for x in (part, u, v, w, count))
                at = _runs(part, v, w)
                pair = np.empty(len(order), np.uint32)
                pair[order] = _spread(at, len(order))
                # of pairs that the start mark begins occurrences count, of others the tokens before them
                third, led, trained = number[u], np.where(v == len(number) - 1, count, 0).astype(np.uint32), count > 0
                part, v, w, end, many = part[at], v[at], w[at], np.append(at, len(order)), _summed(trained.astype(np.uint32), at)
                one, two, low = number[v], number[w], np.searchsorted(part, np.arange(parts + 1))
                for s in range(parts):
                    if low[s] < low[s + 1]:
                        own, some = slice(low[s], low[s + 1]), slice(end[low[s]], end[low[s + 1]])
                        on = trained[some]
                        rows.append((parts + s, r["block"], _pressed(one[own], two[own], many[own], third[some][on], led[some][on])))
                place = (np.cumsum(chosen) - 1).astype(np.uint32)[v]
                own = (row.astype(np.uint32), often, pair, b.known[0][w], np.diff(place, prepend=np.uint32(0)), *(x[chosen] for x in b.known[1:]))
                rows.append((2 * parts + r["block"] % parts, r["block"], _pressed(*own, np.array([len(b.n)], np.uint32))))
                yield _batch(rows)

    def answer(rows: pa.Table) -> pa.Table:
        dest, block = rows.column("dest")[0].as_py(), rows.column("block").to_pylist()
        if dest >= 2 * parts:
            return rows.select(["dest", "block", "data"])
        data = [_opened(x) for x in rows.column("data").to_pylist()]
        cuts = np.cumsum([len(x[0]) for x in data])[:-1]
        a, b, many, third, c = (np.concatenate(x) for x in zip(*data, strict=True))
        keys, key = np.unique(_paired(a, b), return_inverse=True)
        of = np.repeat(key, many)
        if dest < parts:
            name = _paired(of, third)
            order = np.argsort(name)
            name = name[order]
            at = _runs(name)
            three, place = _summed(c[order].astype(np.int64), at), np.empty(len(order), np.int64)
            place[order] = _spread(at, len(order))
            at = _runs(name[at] >> np.uint64(32))  # one for each of the keys
            after = [_summed(x.astype(np.int64), at)[key] for x in (three, three == 1, three == 2, three > 2)]
            split = [np.split(three[place], np.cumsum([len(x[3]) for x in data])[:-1]), *(np.split(x, cuts) for x in (many, *after))]
        else:
            plain = c == 0
            two = np.bincount(of[~plain], c[~plain], len(keys)).astype(np.int64)
            name = np.unique(_paired(of[plain], third[plain])) >> np.uint64(32)
            two += np.bincount(name.astype(np.int64), minlength=len(keys))
            split = [np.split(two[key], cuts)]
        return pa.Table.from_batches([_batch([(dest, n, _pressed(*x)) for n, *x in zip(block, *split, strict=True)])])

    def kept(c: np.ndarray, order: int) -> np.ndarray:
        """Counts less their discounts."""
        return c - np.array([0.0, *d[order - 1]])[np.minimum(c, 3)]

    def mixed(c: np.ndarray, order: int, context: list[np.ndarray], low: np.ndarray) -> np.ndarray:
        whole, freed = context[0], sum(x * y for x, y in zip(context[1:], d[order - 1], strict=True))
        return np.where(whole > 0, (kept(c, order) + freed * low) / np.maximum(whole, 1), low)

    def add(rows: pa.Table) -> pa.Table:
        found: dict[int, list] = {0: [], 1: [], 2: []}
        for r in sorted(rows.select(["dest", "data"]).to_pylist(), key=lambda r: r["dest"]):
            found[r["dest"] // parts].append(_opened(r["data"]))
        row, often, pair, after, place, *context, rows_here = found[2][0]
        whole, freed, number = single
        p = (kept(after, 1) + freed / (number + 1)) / whole if whole else np.full(len(after), 1.0)
        if found[1]:  # what was not asked comes last
            two, place = np.concatenate([x[0] for x in found[1]]), np.cumsum(place, dtype=np.uint32)
            two = np.append(two, np.zeros(len(p) - len(two), np.int64))
        else:
            two, place = np.zeros(len(p), np.int64), np.cumsum(place, dtype=np.uint32)
        p = mixed(two, 2, [x[place] for x in context], p)[pair]
        if found[0]:
            three, many, *context = (np.concatenate(x) for x in zip(*found[0], strict=True))
            at = np.repeat(np.arange(len(many)), many)
            p[: len(three)] = mixed(three, 3, [x[at] for x in context], p[: len(three)])
        sums = np.bincount(row, np.repeat(np.log(p), often), int(rows_here[0]))
        return pa.table({"block": rows.column("block").slice(0, 1), "sums": pa.array([_pressed(sums)], pa.binary())})

    answers = blocks.select("block", "packed", "marks").mapInArrow(ask, _ROWS).groupBy("dest").applyInArrow(answer, _ROWS)
    return answers.groupBy("block").applyInArrow(add, "block bigint, sums binary")


def _rows(blocks: DataFrame, sums: DataFrame) -> DataFrame:
    """``doc_id, lang, use, n_tokens, perplexity`` of every document."""
    kind = blocks.schema["own"].dataType.elementType["doc_id"].dataType
    own = pa.struct([("doc_id", to_arrow_type(kind)), ("lang", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            n, use = _opened(r["sizes"])[0].astype(np.int64), _use(r["marks"], len(r["own"]))
            mean = sum((_opened(x)[0] for x in right.column("sums").to_pylist()), np.zeros(len(n))) / np.maximum(n, 1)
            rows = pa.array(r["own"], own)
            out.append(pa.table([rows.field(0), rows.field(1), pa.array(use.astype(np.int32)), pa.array(n), pa.array(np.exp(-mean), mask=n == 0)], names=["doc_id", "lang", "use", "n_tokens", "perplexity"]))
        return pa.concat_tables(out)

    pairs = blocks.select("block", "sizes", "marks", "own").groupBy("block").cogroup(sums.groupBy("block"))
    return pairs.applyInArrow(run, f"doc_id {kind.simpleString()}, lang string, use int, n_tokens bigint, perplexity double")


def _weights(blocks: DataFrame) -> np.ndarray:
    """How many tokens each slot has."""
    slots = blocks.select(F.posexplode("slots").alias("slot", "n")).groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS rows
    weights = np.zeros(SLOTS, np.int64)
    for r in slots:
        weights[r.slot] = r.n
    return weights


def _turns(weights: np.ndarray, passes: int) -> np.ndarray:
    """The pass of each slot: the heaviest slots go first, each to the lightest pass."""
    turn, load = np.zeros(len(weights), np.int64), np.zeros(passes, np.int64)
    for s in np.argsort(-weights, kind="stable"):
        turn[s] = np.argmin(load)
        load[turn[s]] += weights[s]
    return turn


def scored(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, threshold, keep`` of every document.

    Trusted are documents with a label of quality 1 and none of 0; they must be labelled by
    ``doc_id``.  One in ``CALIBRATION`` of them, by a hash of the id, sets the thresholds.  A
    document is kept if its perplexity is at most its language's threshold.  Documents
    without tokens (null, empty, blank) have no perplexity and are not kept; a null language
    is a language; repeated rows are scored one by one; without trusted documents everything
    with tokens is kept; an empty table gives no rows.
    """
    spark = documents.sparkSession
    good = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    calibrate = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(CALIBRATION)) == 0
    good = good.select("doc_id", F.when(calibrate, 2).otherwise(1).alias("use"))
    with shuffles_freed(spark):
        turn = F.pmod(F.shiftright("block", 24) + F.col("block").bitwiseAND((1 << 24) - 1), F.lit(PORTIONS))
        blocks, portions = written_apart(_blocks(documents), "perplexity-blocks", turn)
        marks = written(_marks(blocks, good), "perplexity-marks")
        weights = _weights(blocks)
        size, least = int(weights.sum()), 2 * spark.sparkContext.defaultParallelism
        passes = min(PASSES, size // PASS + 1)
        fewer = passes // 3 + 1  # counting moves less
        parts = lambda passes: max(least, math.ceil(size / passes / GROUP))
        # two bits a document or less are broadcast, so that blocks move once alone
        marks = F.broadcast(marks) if marks.count() <= 20_000 else marks
        blocks = blocks.join(marks, "block", "left")
        turn = _turns(weights, fewer)
        counted = [written(_totals(_counted(blocks, turn, p, parts(fewer))), "perplexity-counts") for p in range(fewer)]
        done, counted = counted, reduce(DataFrame.union, counted)
        n = {r.kind: [r.a, r.b, r.c, r.d] for r in _totals(counted.where("kind > 1")).collect()}  # two rows
        words = _totals(counted.where("kind = 1"))
        ones = words.where("a > 0").groupBy(F.least("a", F.lit(5)).alias("c")).agg(F.count("*").alias("n"), F.sum("a").alias("a")).collect()  # at most 5 rows
        many = {r.c: r.n for r in ones}
        d = [_discounts([many.get(c, 0) for c in (1, 2, 3, 4)]), *(_discounts(n.get(k, [0] * 4)) for k in (2, 3))]
        single = (sum(r.a for r in ones), sum(r.n * d[0][min(r.c, 3) - 1] for r in ones), sum(many.values()))
        numbered = []
        for some in portions:
            known = written(_known(some, words, parts(passes)), "perplexity-known")
            numbered.append(written(_numbered(some.join(marks, "block", "left"), known), "perplexity-numbers"))
            for x in (some, known):
                emptied(x)
        for x in done:
            emptied(x)
        blocks = reduce(DataFrame.union, numbered)
        turn = _turns(_weights(blocks), passes)
        sums = [written(_scored(blocks, turn, p, parts(passes), d, single), "perplexity-sums") for p in range(passes)]
        rows = written(_rows(blocks, reduce(DataFrame.union, sums)), "perplexity-scores")
    return _judged(rows, quantile)


def _judged(rows: DataFrame, quantile: float) -> DataFrame:
    """``rows`` with their language's threshold and ``keep``.

    Quantiles come from counts of logarithms in steps of ``STEP``.  A language's is drawn
    towards the quantile of all languages as if that had been seen in ``PRIOR`` documents.
    """
    seen = rows.where((F.col("use") == 2) & F.col("perplexity").isNotNull())
    bins = seen.groupBy(F.col("lang").alias("l"), F.floor(F.log("perplexity") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    bins = written(bins, "perplexity-bins")

    def at(counted: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("bin")  # as many rows as there are steps
        held = counted.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
        return held.where(F.col("upto") >= quantile * F.col("all")).groupBy(*by, "all").agg(((F.min("bin") + 1) * STEP).alias("t"))

    whole = at(bins.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("g", F.lit(1)), "g").first()
    whole = math.inf if whole is None else whole.t
    per = at(bins, "l").select("l", F.exp((F.col("all") * F.col("t") + PRIOR * whole) / (F.col("all") + PRIOR)).alias("t"))
    limit = F.coalesce("t", F.lit(math.exp(whole) if whole < 700 else math.inf))
    out = rows.join(F.broadcast(per) if per.count() <= 10_000 else per, F.col("lang").eqNullSafe(F.col("l")), "left")
    return out.select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep"))
