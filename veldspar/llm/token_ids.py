"""Token-ID output in Simple-8b blocks.

Format ``s8b``: a folder of Parquet part files, a row for each block.  A block holds whole
documents in ascending id order:

* ``shard``, ``block``: place in the output; shards and their blocks are in id order
* ``doc_ids``: binary, little-endian int64, null ids as the smallest int64
* ``ends``: binary, little-endian uint32; ids of the block up to and with each document
* ``words``: binary, little-endian uint64 Simple-8b words
* ``starts``: binary, little-endian uint32; of every 256th word the index of its first id,
  so that a reader can begin in the middle
* ``escapes``: binary, little-endian uint64; values too large for 60 bits, in order
* ``n_ids``: number of ids; ``first``: ids of the shard before this block

Simple-8b word: the low 4 bits are a selector, the other 60 hold as many ids as the
selector says, each in the same number of bits, lowest first.  Selector 15 is the escape:
the word's id is the next of ``escapes``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm import words as W
from veldspar.session import shared_dir

#: Ids in a word and bits of each, by selector.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
STRIDE = 256
BLOCK_IDS = 1 << 16
TASK_ROWS = 100_000


_NEED = np.searchsorted(1 << WIDTHS, np.arange(1 << 16), "right").astype(np.int8)  # least selector by width


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts, escapes) of non-negative ids below 2**64."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    if ids.max() < len(_NEED):
        need = _NEED[ids]
    else:
        need = np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), ids, "right").astype(np.int8)
        need[ids >> np.uint64(60) != 0] = 100
    fits = np.full(n, ESCAPE, np.int8)
    small = np.flatnonzero(need < 100)
    for sel in range(len(COUNTS) - 1, -1, -1):  # earlier selectors pack more ids
        last = COUNTS[sel] - 1
        small = small[need[small] <= sel]
        if len(small) > last:
            first = small[: len(small) - last]
            fits[first[small[last:] - first == last]] = sel
    sizes = np.append(COUNTS, [0, 1])[fits].tolist()
    heads, i = [], 0
    while i < n:
        heads.append(i)
        i += sizes[i]
    first = np.array(heads)
    sels = fits[first]
    words = sels.astype(np.uint64)
    for sel in np.unique(sels).tolist():
        if sel == ESCAPE:
            continue
        at = np.flatnonzero(sels == sel)
        for j in range(COUNTS[sel]):
            words[at] |= ids[first[at] + j] << np.uint64(4 + j * WIDTHS[sel])
    return words, first[::STRIDE].astype(np.uint32), ids[first[sels == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of a block of words, a few vectorised steps for each selector in use."""
    sels = (words & np.uint64(15)).astype(np.int64)
    sizes = np.append(COUNTS, [0, 1])[sels]
    first = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint64)
    for sel in np.unique(sels).tolist():
        at = np.flatnonzero(sels == sel)
        if sel == ESCAPE:
            out[first[at]] = escapes
            continue
        mask = np.uint64((1 << int(WIDTHS[sel])) - 1)
        for j in range(COUNTS[sel]):
            out[first[at] + j] = (words[at] >> np.uint64(4 + j * WIDTHS[sel])) & mask
    return out


#: Kinds of bytes: 0 anything else, 1 letter, 2 digit, 3 mark, 4 apostrophe, 5 space, 6 line end.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[39], _KIND[32], _KIND[10] = 4, 5, 6
_LETTERS = np.zeros(256, bool)  # first bytes of two-byte characters that are all letters, but for the signs of 0xC3
_LETTERS[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xD0, 0xD1]] = True


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = _KIND[data]
    lead = np.flatnonzero(_LETTERS[data])
    if len(lead):
        after = data[lead + 1]
        lead = lead[(data[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))]
        kind[lead] = 1
        kind[lead + 1] = 1
    return kind


def borders(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where byte-level pieces surely begin, by the kinds of all bytes: a flag for each.

    Between two visible characters of known kinds a piece begins at a single space, before
    and after a single line end, where letters and digits meet, and before and after marks
    (but not after an apostrophe that letters follow).  Other pieces may begin elsewhere too.
    """
    cut = np.zeros(len(kind), bool)
    if len(kind) > 1:
        a, b = kind[:-1], kind[1:]
        word_a, word_b, mark_b = (a == 1) | (a == 2), (b == 1) | (b == 2), (b == 3) | (b == 4)
        cut[1:] = (word_a & (mark_b | (word_b & (a != b)))) | ((a == 3) & word_b) | ((a == 4) & (b == 2))
    if len(kind) > 2:
        seen = (kind > 0) & (kind < 5)
        lone = seen[:-2] & seen[2:]
        cut[1:-1] |= lone & (kind[1:-1] >= 5)
        cut[2:] |= lone & (kind[1:-1] == 6)
    cut[offsets[:-1][offsets[:-1] < len(kind)]] = True
    return cut


class Encoder:
    """The library's ids of whole texts, each distinct piece being encoded by it once.

    A text is cut at ``borders``; pieces are looked up by 96-bit hashes in a table that is
    bounded and begun anew when it is full.  New pieces of one kind of character are encoded
    together, as the lines of one text; other pieces, and whole texts that hold an added
    token, are encoded by themselves.  Where the file is not a plain byte-level BPE, so are
    all texts.
    """

    SLOTS = 1 << 22
    MOST_IDS = 1 << 24
    LONGEST = 64  # bytes of a piece that is kept
    PORTION = 1 << 21

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        about = json.loads(self.library.to_str())
        step, model = about["pre_tokenizer"] or {}, about["model"]
        self.plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step.get("add_prefix_space", True)
        self.plain &= model["type"] == "BPE" and not any(about[k] for k in ("normalizer", "truncation", "padding")) and not model.get("dropout")
        self.added = [t["content"].encode() for t in about["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
        rest = [b for b in range(256) if b not in shown]
        self.signs = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.line = self.library.token_to_id(self.signs[10])
        self.plain &= self.line is not None
        self.lines = Tokenizer.from_file(path)
        self.lines.pre_tokenizer = pre_tokenizers.Split(self.signs[10], "isolated")
        self.clear()

    def clear(self) -> None:
        self.keys, self.check = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint32)
        self.place = np.zeros(self.SLOTS, np.int32)
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.n = self.held = 0

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The entry of each piece, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), (key & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            there = self.keys[slot]
            hit = (there == key[todo]) & (self.check[slot] == check[todo])
            out[todo[hit]] = self.place[slot[hit]]
            on = (there != 0) & ~hit
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def _keep(self, key: np.ndarray, check: np.ndarray, entry: np.ndarray) -> None:
        slot = (key & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(key):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = key[free]
            won = free & (self.keys[slot] == key)
            self.check[slot[won]] = check[won]
            self.place[slot[won]] = entry[won]
            on = ~won
            key, check, entry, slot = key[on], check[on], entry[on], (slot[on] + 1) & (self.SLOTS - 1)

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """More entries, their ids one after the other."""
        while self.n + len(counts) > len(self.begin):
            self.begin, self.count = np.append(self.begin, self.begin), np.append(self.count, self.count)
        while self.held + len(ids) > len(self.pool):
            self.pool = np.append(self.pool, self.pool)
        self.begin[self.n : self.n + len(counts)] = self.held + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(counts)] = counts
        self.pool[self.held : self.held + len(ids)] = ids
        self.n, self.held = self.n + len(counts), self.held + len(ids)

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, odd: np.ndarray) -> None:
        """Entries for new pieces, those of one kind first; ``odd`` ones are at the end."""
        n_plain = int(len(odd) - odd.sum())
        for a in range(0, n_plain, 8192):
            b = min(a + 8192, n_plain)
            size = end[a:b] - begin[a:b] + 1  # and a line end before each
            first = np.cumsum(size) - size
            text = data[np.arange(size.sum()) + np.repeat(begin[a:b] - 1 - first, size)]
            text[first] = 10
            ids = np.array(self.lines.encode_batch_fast([text.tobytes().decode("latin-1").translate(self.signs)], add_special_tokens=False)[0].ids, np.uint32)
            heads = np.flatnonzero(ids == self.line)
            counts = np.diff(heads, append=len(ids)) - 1
            self._add(ids[ids != self.line], counts)
        for a in range(n_plain, len(odd), 1024):
            texts = [data[i:j].tobytes().decode() for i, j in zip(begin[a : a + 1024].tolist(), end[a : a + 1024].tolist(), strict=True)]
            found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            self._add(np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64))

    def _portions(self, data: np.ndarray) -> list[np.ndarray]:
        """A very long text, cut at single spaces between ASCII letters where there are any."""
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        out, begin = [], 0
        while len(data) - begin > 2 * self.PORTION:
            near = data[begin + self.PORTION : begin + 2 * self.PORTION]
            at = np.flatnonzero(letter[near[:-2]] & (near[1:-1] == 32) & letter[near[2:]])
            if not len(at):
                break
            end = begin + self.PORTION + int(at[0]) + 1
            out.append(data[begin:end])
            begin = end
        return [*out, data[begin:]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        data, offsets = W.utf8(column)
        n_rows = len(offsets) - 1
        if n_rows == 1 and self.plain and len(data) > 2 * self.PORTION and not self._with_added(data, offsets).any():
            cut = self._portions(data)
            if len(cut) > 1:
                ids = np.concatenate([self.encode(pa.array([x.tobytes()], pa.large_binary()))[0] for x in cut])
                return ids, np.array([len(ids)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        if self.n > self.SLOTS // 2 or self.held > self.MOST_IDS:
            self.clear()
        kind = _kinds(data)
        cut = borders(kind, offsets)
        whole = np.ones(n_rows, bool) if not self.plain else self._with_added(data, offsets)
        for r in np.flatnonzero(whole).tolist():
            cut[offsets[r] + 1 : offsets[r + 1]] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(data))
        key, check = self._hashes(data, begin, end)
        entry = self._find(key, check)
        new = np.flatnonzero(entry < 0)
        kept = self.n, self.held
        if len(new):
            _, first, at = np.unique(key[new], return_index=True, return_inverse=True)
            other = np.flatnonzero(check[new] != check[new[first[at]]])  # equal keys of different pieces
            at[other] = len(first) + np.arange(len(other))
            lone = new[np.append(first, other)]
            odd = self._odd(kind, begin[lone], end[lone]) | whole[np.searchsorted(offsets, begin[lone], "right") - 1]
            long = (end[lone] - begin[lone] > self.LONGEST) | (np.arange(len(lone)) >= self.SLOTS * 3 // 4 - self.n)
            order = np.lexsort((odd, long))  # long ones come last and are forgotten
            where = np.empty(len(lone), np.int64)
            where[order] = np.arange(len(lone))
            lone, odd, long = lone[order], odd[order], long[order]
            short = int(len(long) - long.sum())
            self._learn(data, begin[lone[:short]], end[lone[:short]], odd[:short])
            kept = self.n, self.held
            self._learn(data, begin[lone[short:]], end[lone[short:]], odd[short:])
            base = self.n - len(lone)
            self._keep(key[lone[:short]], check[lone[:short]], base + np.arange(short))
            entry[new] = base + where[at]
        size = self.count[entry]
        ends = np.cumsum(size)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.begin[entry] - (ends - size), size)]
        self.n, self.held = kept
        upto = np.append(0, ends)[np.searchsorted(begin, offsets)]
        return ids, np.diff(upto)

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that hold an added token's text."""
        raw, found = data.tobytes(), np.zeros(len(offsets) - 1, bool)
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                r = int(np.searchsorted(offsets, at, "right")) - 1
                found[r] = True
                at = raw.find(token, int(offsets[r + 1]))
        return found

    @staticmethod
    def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - begin
        place = np.arange(len(data)) - np.repeat(begin, size)
        value = data.astype(np.uint64) + np.uint64(1)
        power = W.powers(int(size.max()) + 1)
        key = W.mix(np.add.reduceat(value * power[place], begin) + size.astype(np.uint64))
        key[key == 0] = 1
        other = np.add.reduceat((value * value + np.uint64(0x9E37)) * power[place + 1], begin)
        return key, (W.mix(other) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _odd(kinds: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether a piece is anything else than letters, digits or marks alone, or these after a space."""
        size = end - begin
        first = np.cumsum(size) - size
        kind = kinds[np.arange(size.sum()) + np.repeat(begin - first, size)]
        head = kind[first]
        kind[first] = np.where((head == 5) & (size > 1), kind[np.minimum(first + 1, len(kind) - 1)], head)
        group = np.where(kind == 4, 3, kind)
        least, most = np.minimum.reduceat(group, first), np.maximum.reduceat(group, first)
        return (least != most) | (least == 0) | (most > 3)


@lru_cache(2)  # a worker keeps it from task to task
def encoder(path: str) -> Encoder:
    return Encoder(path)


_NULL = np.iinfo(np.int64).min


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> str:
    """Encode every whole text, append ``end_id``, and write blocks in ascending id order.

    A null or empty text is its end id alone; null ids come first; repeated ids stay separate
    documents.  An empty table writes a folder without rows.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-documents.count() // TASK_ROWS))
    # a fixed number of ranges: the sampling pass reads the input, not its encoding
    ordered = docs.repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, shard = encoder(tokenizer), TaskContext.get().partitionId()
        held_docs: list[np.ndarray] = []
        held_sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = block = first = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, block, first
            words, starts, escapes = pack(np.concatenate(held))
            ends = np.cumsum(np.concatenate(held_sizes)).astype("<u4")
            raw = [np.concatenate(held_docs).astype("<i8"), ends, words.astype("<u8"), starts.astype("<u4"), escapes.astype("<u8")]
            cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([size], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in raw)]
            for x in (held_docs, held_sizes, held):
                x.clear()
            block, first, size = block + 1, first + size, 0
            return pa.RecordBatch.from_arrays(cols, names=["shard", "block", "first", "n_ids", "doc_ids", "ends", "words", "starts", "escapes"])

        for batch in batches:
            for part in W.chunks(batch, "text", 1 << 20):
                ids, sizes = library.encode(part.column("text"))
                ends = np.cumsum(sizes)
                ids = np.insert(ids, ends, end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                docs_of = part.column("doc_id").fill_null(_NULL).to_numpy()
                a = 0
                while a < len(sizes):  # whole documents up to a full block
                    base = ends[a - 1] if a else 0
                    b = min(int(np.searchsorted(ends, base + BLOCK_IDS - size)) + 1, len(sizes))
                    held_docs.append(docs_of[a:b])
                    held_sizes.append(sizes[a:b])
                    held.append(ids[base : ends[b - 1]])
                    size += int(ends[b - 1] - base)
                    if size >= BLOCK_IDS:
                        yield flush()
                    a = b
        if held:
            yield flush()

    blocks = ordered.mapInArrow(run, "shard int, block int, first bigint, n_ids bigint, doc_ids binary, ends binary, words binary, starts binary, escapes binary")
    blocks.write.option("compression", "zstd").parquet(path)
    return path


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids of all blocks before them.

    A row for each shard, of which there are as many as tasks wrote, is added up in one place and broadcast.
    """
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    return blocks.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files at ``path``.

    ``start`` counts the ids of all documents before it.  Decoding runs block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"))
                ends = np.frombuffer(row["ends"], "<u4").astype(np.int64)
                begins = np.r_[0, ends[:-1]]
                raw = memoryview(ids.astype("<u4").tobytes())
                docs = np.frombuffer(row["doc_ids"], "<i8")
                cols = [pa.array(docs, mask=docs == _NULL), pa.array(row["start"] + begins), pa.array(ends - begins), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, path).select("start", "doc_ids", "ends", "words", "escapes").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def part(words: np.ndarray, starts: np.ndarray, escapes: np.ndarray, begin: int, end: int) -> np.ndarray:
    """The ids ``begin`` to ``end`` of a block, decoding only the words from the ``starts`` around them."""
    if begin >= end:
        return np.zeros(0, np.uint64)
    low = int(np.searchsorted(starts, begin, "right")) - 1
    high = int(np.searchsorted(starts, end, "left"))
    before = int(np.count_nonzero((words[: low * STRIDE] & np.uint64(15)) == ESCAPE))
    some = words[low * STRIDE : high * STRIDE]
    n = int(np.count_nonzero((some & np.uint64(15)) == ESCAPE))
    return unpack(some, escapes[before : before + n])[begin - int(starts[low]) : end - int(starts[low])]


def sequences(spark: SparkSession, path: str, length: int) -> DataFrame:
    """``place, doc_id, ids``: the id stream in windows of ``length``, cut at block ends.

    ``place`` is the window's first id in the whole stream, ``doc_id`` the document it lies
    in; windows are decoded one by one, from the nearest entry of ``starts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, starts, escapes = (np.frombuffer(row[c], t) for c, t in (("words", "<u8"), ("starts", "<u4"), ("escapes", "<u8")))
                ends, docs = np.frombuffer(row["ends"], "<u4"), np.frombuffer(row["doc_ids"], "<i8")
                for a in range(0, row["n_ids"], 64 * length):
                    heads = np.arange(a, min(a + 64 * length, row["n_ids"]), length)
                    own = docs[np.searchsorted(ends, heads, "right")]
                    ids = [part(words, starts, escapes, h, min(h + length, row["n_ids"])).astype(np.int64) for h in heads.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(row["start"] + heads), pa.array(own, mask=own == _NULL), pa.array(ids, pa.list_(pa.int64()))], names=["place", "doc_id", "ids"])

    return _placed(spark, path).select("start", "n_ids", "doc_ids", "ends", "words", "starts", "escapes").mapInArrow(run, "place bigint, doc_id bigint, ids array<bigint>")


def token_output(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``documents`` to the shared folder and read the files back."""
    spark = documents.sparkSession
    return read(spark, write(documents, f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}", tokenizer, end_id))
